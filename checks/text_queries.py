"""Documents, feed records, messages, requests and labels over whole tables."""

from __future__ import annotations

import uuid
import zipfile

import pyarrow as pa
from pyspark.sql import functions as F

from checks import views as V
from tallyline.sources import archives
from tallyline.functions import confidence, messages, outcomes, requests, scoring, text
from tallyline.sources import documents as D
from tallyline.sources import feed as L
from tallyline.session import ensure_checkpoint_dir, staged

QUERIES, SQL = {}, {}


def query(name, sql=None):
    def register(fn):
        QUERIES[name] = fn
        if sql is not None:
            SQL[name] = sql
        return fn

    return register


@query(
    "zip_members",
    "SELECT CAST(doc_id AS VARCHAR) AS member, length(text) AS n_chars, md5(text) AS digest FROM documents WHERE text IS NOT NULL",
)
def zip_members(spark, sf):
    """Every document written into zip archives, one for each task, and read back member by member."""
    folder = f"{ensure_checkpoint_dir(spark)}/archives-{uuid.uuid4().hex}"
    archives.opened(folder)[0].create_dir(archives.opened(folder)[1])

    def write(batches):
        system, inner = archives.opened(folder)
        n = 0
        with system.open_output_stream(f"{inner}/{uuid.uuid4().hex}.zip") as out, zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
            for batch in batches:
                for doc, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                    z.writestr(f"{doc}.txt", text)
                    n += 1
        yield pa.record_batch({"n": pa.array([n], pa.int64())})

    docs = V.table(spark, sf, "documents").where("text IS NOT NULL").select("doc_id", "text")
    docs.mapInArrow(write, "n long").agg(F.sum("n")).collect()
    members = archives.read_archives(spark, folder, split_bytes=1 << 18)
    return members.select(
        F.regexp_replace("member", r"\.txt$", "").alias("member"), F.length("text").cast("long").alias("n_chars"), F.md5("text").alias("digest")
    )


# --- match documents: one JSON text per order --------------------------------
DOCUMENTS_PER_FILE = 20_000


def match_documents(spark, sf):
    c = F.col

    def delivery(key, i):
        sixth = (key + i) % 6
        kind = F.when(sixth == 0, "caught").when(sixth == 1, "Retired Hurt")
        return F.struct(
            F.concat(F.lit("p"), (i % 4).cast("string")).alias("batter"),
            F.concat(F.lit("q"), (i % 3).cast("string")).alias("bowler"),
            F.struct(((key + i * 7) % 7).alias("total"), ((key + i * 7) % 7).alias("batter")).alias("runs"),
            F.when((key + i) % 5 == 0, F.struct(F.lit(1).alias("wides"))).alias("extras"),
            F.when(kind.isNotNull(), F.array(F.struct(kind.alias("kind"), F.lit("p0").alias("player_out")))).alias("wickets"),
        )

    def side(team, key, n, target):
        balls = F.transform(F.sequence(F.lit(1), n.cast("int")), lambda i: delivery(key, i))
        return F.struct(
            F.lit(team).alias("team"),
            target.alias("target"),
            F.array(F.struct(F.lit(0).alias("over"), balls.alias("deliveries"))).alias("overs"),
        )

    order, cust = c("o_orderkey"), c("o_custkey")
    won = F.when(c("o_orderstatus") == "F", "Reds").when(c("o_orderstatus") == "O", "Blues")
    doc = F.struct(
        F.struct(
            F.array(F.date_format("o_orderdate", "yyyy-MM-dd")).alias("dates"),
            F.lit("T20").alias("match_type"),
            F.when(order % 3 == 0, "international").otherwise("club").alias("team_type"),
            F.when(order % 50 == 1, F.array(F.lit("Reds"))).otherwise(F.array(F.lit("Reds"), F.lit("Blues"))).alias("teams"),
            F.struct(won.alias("winner"), F.when(won.isNull(), "tie").alias("result")).alias("outcome"),
            c("o_orderpriority").alias("venue"),
            F.lit(20).alias("overs"),
        ).alias("info"),
        F.array(
            side("Reds", order, 1 + order % 13, F.lit(None).cast("struct<runs:int>")),
            side("Blues", cust, 1 + cust % 7, F.struct(F.lit(30).alias("runs"))),
        ).alias("innings"),
    )
    body = F.when(order % 50 == 0, '{"info": ').otherwise(F.to_json(doc))
    return V.table(spark, sf, "orders").select(
        F.concat(order.cast("string"), F.lit(".json")).alias("path"), order.cast("string").alias("match_id"),
        body.alias("text"),
    )


def parsed(spark, sf):
    # As in a build: texts are stored, spread over files, before they are parsed. Texts shrink much when they are
    # stored, so their number, not their bytes, says how many files there are.
    parts = max(spark.sparkContext.defaultParallelism, -(-V.table(spark, sf, "orders").count() // DOCUMENTS_PER_FILE))
    return D.parse_documents(staged(match_documents(spark, sf).repartition(parts, "path")))


BALLS = """
balls AS (
  SELECT o_orderkey, 1 AS innings, unnest(range(1, CAST(2 + o_orderkey % 13 AS BIGINT))) AS i, o_orderkey AS key
  FROM orders WHERE o_orderkey % 50 > 1
  UNION ALL
  SELECT o_orderkey, 2, unnest(range(1, CAST(2 + o_custkey % 7 AS BIGINT))), o_custkey FROM orders WHERE o_orderkey % 50 > 1
),
d AS (
  SELECT CAST(o_orderkey AS VARCHAR) AS match_id, innings, i, (key + i * 7) % 7 AS total,
    ((key + i) % 5 = 0) AS wide, ((key + i) % 6 = 0) AS wicket FROM balls
)
"""


@query(
    "document_matches",
    """SELECT CAST(o_orderkey AS VARCHAR) AS match_id, CASE WHEN o_orderkey % 3 = 0 THEN 'T20I' ELSE 'T20' END AS format,
  CAST(o_orderdate AS DATE) AS date, 'Reds' AS team1, 'Blues' AS team2,
  CASE o_orderstatus WHEN 'F' THEN 'Reds' WHEN 'O' THEN 'Blues' END AS winner,
  CASE WHEN o_orderstatus IN ('F', 'O') THEN 'win' ELSE 'tie' END AS result_type, o_orderpriority AS venue, 20 AS scheduled_overs
FROM orders WHERE o_orderkey % 50 > 1""",
)
def document_matches(spark, sf):
    return D.matches(parsed(spark, sf)).select(
        "match_id", "format", "date", "team1", "team2", "winner", "result_type", "venue", "scheduled_overs"
    )


@query(
    "document_innings",
    f"""WITH {BALLS}, t AS (SELECT match_id, innings, CAST(sum(total) AS BIGINT) AS runs, count(*) FILTER (WHERE wicket) AS wickets,
  count(*) FILTER (WHERE NOT wide) AS balls FROM d GROUP BY 1, 2)
SELECT match_id, innings AS innings_number, CASE innings WHEN 1 THEN 'Reds' ELSE 'Blues' END AS batting_team,
  CASE innings WHEN 1 THEN 'Blues' ELSE 'Reds' END AS bowling_team, runs, wickets, balls,
  CASE WHEN innings = 2 THEN 30 END AS target, CASE WHEN innings = 2 THEN 30 - runs END AS required_runs,
  round(balls // 6 + (balls % 6) / 10.0, 6) AS overs FROM t""",
)
def document_innings(spark, sf):
    return D.innings(parsed(spark, sf)).select(
        "match_id", "innings_number", "batting_team", "bowling_team", "runs", "wickets", "balls", "target",
        "required_runs", F.round("overs", 6).alias("overs"),
    )


@query(
    "document_deliveries",
    f"""WITH {BALLS} SELECT match_id, innings, i AS ball, 'p' || (i % 4) AS striker, 'q' || (i % 3) AS bowler, total AS runs_total,
  wicket, wide AS is_wide, CASE WHEN wicket THEN 'caught' END AS wicket_type FROM d""",
)
def document_deliveries(spark, sf):
    return D.deliveries(parsed(spark, sf)).select(
        "match_id", "innings", "ball", "striker", "bowler", "runs_total", "wicket", "is_wide", "wicket_type"
    )


@query(
    "document_quarantine",
    f"""SELECT CAST(o_orderkey AS VARCHAR) AS match_id, CASE o_orderkey % 50 WHEN 0 THEN '{D.MALFORMED}' ELSE '{D.NO_TEAMS}' END AS reason
FROM orders WHERE o_orderkey % 50 <= 1""",
)
def document_quarantine(spark, sf):
    return D.quarantine(parsed(spark, sf)).select("match_id", "reason")


@query("json_props", "SELECT event_id, CAST(json_extract(props, '$.k') AS BIGINT) AS k FROM events")
def json_props(spark, sf):
    props = F.from_json("props", "struct<k:long>")
    return V.table(spark, sf, "events").select("event_id", props["k"].alias("k"))


# --- feed records: one per order ---------------------------------------------
def feed(spark, sf):
    k, c = F.col("o_orderkey"), F.col("o_custkey")
    status = (
        F.when(k % 6 == 0, F.concat(F.lit("Beta need "), (c % 90).cast("string"), F.lit(" runs")))
        .when(k % 6 == 1, F.concat(F.lit("Target: "), (c % 200).cast("string")))
        .when(k % 6 == 2, "15 overs game due to rain")
        .when(k % 6 == 3, "Alpha won by 3 runs")
        .otherwise("in progress")
    )
    name = F.when(k % 4 == 0, "Alpha vs Beta, 2nd T20I").when(k % 4 == 1, "Alpha vs Beta, Indian Premier League").otherwise(
        "Alpha Women vs Beta, The Hundred"
    )

    def score(runs, wickets, balls, label):
        overs = F.concat(F.floor(balls / 6).cast("string"), F.lit("."), (balls % 6).cast("string"))
        return F.struct(runs.cast("string").alias("r"), wickets.cast("string").alias("w"), overs.alias("o"), label.alias("inning"))

    second = F.when(k % 7 == 0, "Alpha,Beta Inning 2").otherwise("Beta Inning 1")
    raw = F.struct(
        k.cast("string").alias("id"), name.alias("name"), F.lit("t20").alias("matchType"), status.alias("status"),
        F.lit(None).cast("string").alias("venue"), F.date_format("o_orderdate", "yyyy-MM-dd").alias("date"),
        F.lit(None).cast("string").alias("dateTimeGMT"), F.array(F.lit("Alpha"), F.lit("Beta")).alias("teams"),
        F.lit("Alpha").alias("tossWinner"), F.lit("bowl").alias("tossChoice"),
        F.lit("true").alias("matchStarted"), F.when(k % 11 == 0, "true").otherwise("false").alias("matchEnded"),
        F.array(
            score(k % 250, k % 10, F.lit(120), F.lit("Alpha Inning 1")),
            score(c % 200, c % 10, c % 121, second),
        ).alias("score"),
    )
    return L.normalize(V.table(spark, sf, "orders").select(raw.alias("raw")))


FEED = """
f AS (
  SELECT CAST(o_orderkey AS VARCHAR) AS match_id, CASE o_orderkey % 4 WHEN 0 THEN 'T20I' WHEN 1 THEN 'T20' ELSE 'HUNDRED' END AS format,
    CASE o_orderkey % 4 WHEN 0 THEN NULL WHEN 1 THEN 'IPL' ELSE 'The Hundred' END AS competition,
    CASE WHEN o_orderkey % 4 < 2 THEN 'male' ELSE 'female' END AS gender,
    CASE o_orderkey % 6 WHEN 0 THEN o_custkey % 200 + o_custkey % 90 WHEN 1 THEN o_custkey % 200 WHEN 2 THEN NULL
      ELSE o_orderkey % 250 + 1 END AS target,
    CASE WHEN o_orderkey % 4 < 2 THEN o_custkey % 121 END AS legal_balls, o_custkey % 200 AS runs,
    (o_orderkey % 6 = 3 OR o_orderkey % 11 = 0) AS terminal
  FROM orders
),
g AS (SELECT *, (NOT terminal AND format <> 'HUNDRED' AND target IS NOT NULL) AS predictable FROM f)
"""


@query(
    "feed_records",
    f"""WITH {FEED} SELECT match_id, format, competition, gender, target, legal_balls, runs, terminal, predictable,
  'Beta' AS batting_team, 'field' AS toss_decision FROM g""",
)
def feed_records(spark, sf):
    return feed(spark, sf).select(
        "match_id", "format", "competition", "gender", "target", "legal_balls", "runs", "terminal", "predictable",
        "batting_team", "toss_decision",
    )


@query(
    "feed_listing",
    f"""WITH {FEED} SELECT match_id, CASE WHEN predictable THEN 'LIVE/PREDICTABLE' WHEN terminal THEN 'ENDED/TERMINAL'
  WHEN format = 'HUNDRED' THEN 'UNSUPPORTED/HUNDRED' ELSE 'LIVE/AMBIGUOUS' END AS state FROM g""",
)
def feed_listing(spark, sf):
    return L.listing(feed(spark, sf)).select("match_id", "state")


@query(
    "feed_scoreboard",
    f"""WITH {FEED}, h AS (SELECT *, CASE WHEN legal_balls IS NOT NULL THEN greatest(120 - legal_balls, 0) END AS remaining FROM g)
SELECT match_id, runs, target - runs AS required_runs, remaining AS balls_remaining,
  CASE WHEN legal_balls > 0 THEN round(runs / (legal_balls / 6.0), 6) END AS current_run_rate,
  CASE WHEN remaining > 0 THEN round((target - runs) / (remaining / 6.0), 6) END AS required_run_rate FROM h""",
)
def feed_scoreboard(spark, sf):
    return L.current_innings(feed(spark, sf)).select(
        "match_id", "runs", "required_runs", "balls_remaining",
        *[F.round(n, 6).alias(n) for n in ("current_run_rate", "required_run_rate")],
    )


@query(
    "feed_requests",
    f"""WITH {FEED} SELECT match_id, format, gender, 2 AS innings, runs, legal_balls, target FROM g WHERE predictable""",
)
def feed_requests(spark, sf):
    return L.scoring_requests(feed(spark, sf)).select(
        "match_id", "format", "gender", "innings", "runs", "legal_balls", "target"
    )


# --- messages ----------------------------------------------------------------
def _rules_sql(text_sql: str) -> str:
    cases = " ".join(f"WHEN regexp_matches({text_sql}, '{p}') THEN '{n}'" for p, n in messages.INTENT_RULES)
    return f"CASE {cases} ELSE 'unknown' END"


@query(
    "intent_tags",
    f"""WITH t AS (SELECT conv_id, turn, role, lower(trim(text)) AS m FROM conversations)
SELECT conv_id, turn, role, {_rules_sql('m')} AS intent,
  CASE WHEN contains(m, 't20i') OR contains(m, 'twenty20 international') THEN 'T20I' WHEN contains(m, 'hundred') THEN 'HUNDRED'
    WHEN regexp_matches(m, '\\bodi\\b') THEN 'ODI' WHEN regexp_matches(m, '\\bt20\\b') OR contains(m, 'ipl') THEN 'T20' END AS format,
  CASE WHEN regexp_matches(m, 'after toss|post[ -]toss') THEN 'POST_TOSS' WHEN regexp_matches(m, 'before toss|pre[ -]toss') THEN 'PRE_TOSS'
    WHEN contains(m, 'live') OR contains(m, 'need ') THEN 'LIVE' END AS mode FROM t""",
)
def intent_tags(spark, sf):
    m = F.col("text")
    return V.table(spark, sf, "conversations").select(
        "conv_id", "turn", "role", messages.intent(m).alias("intent"),
        messages.format_hint(m).alias("format"), messages.mode_hint(F.trim(m)).alias("mode"),
    )


QUESTIONS = """
q AS (
  SELECT o_orderkey AS id, h.n_name AS a, n.n_name AS b, o_orderkey % 4 AS form, CAST(o_orderdate AS DATE) AS day
  FROM orders JOIN nation h ON h.n_nationkey = o_custkey % 25 JOIN nation n ON n.n_nationkey = o_orderkey % 25
)
"""


@query(
    "message_tags",
    f"""WITH {QUESTIONS} SELECT id, CASE WHEN a <> b THEN CASE WHEN form = 3 THEN 'Mumbai Indians' ELSE a END END AS team1,
  CASE WHEN a <> b OR form = 3 THEN CASE form WHEN 3 THEN 'India' ELSE b END END AS team2,
  CASE form WHEN 1 THEN 'T20I' WHEN 2 THEN 'T20' END AS format,
  CASE form WHEN 2 THEN 'IPL' END AS competition,
  CASE form WHEN 0 THEN day + 1 WHEN 1 THEN day WHEN 2 THEN DATE '2026-05-04' END AS date FROM q
""".replace("CASE WHEN a <> b THEN CASE WHEN form = 3", "CASE WHEN a <> b OR form = 3 THEN CASE WHEN form = 3"),
)
def message_tags(spark, sf):
    nation = V.table(spark, sf, "nation")
    orders = V.table(spark, sf, "orders")
    a = nation.select((F.col("n_nationkey").cast("long")).alias("_a"), F.col("n_name").alias("a"))
    b = nation.select((F.col("n_nationkey").cast("long")).alias("_b"), F.col("n_name").alias("b"))
    q = orders.select(
        F.col("o_orderkey").alias("id"), (F.col("o_custkey") % 25).alias("_a"), (F.col("o_orderkey") % 25).alias("_b"),
        (F.col("o_orderkey") % 4).alias("form"), F.col("o_orderdate").cast("date").alias("day"),
    ).join(a, "_a").join(b, "_b")
    form = F.col("form")
    text_ = (
        F.when(form == 0, F.concat(F.lit("Who will win "), "a", F.lit(" vs. "), "b", F.lit(" tomorrow?")))
        .when(form == 1, F.concat(F.lit("predict "), "a", F.lit("  VS "), "b", F.lit(", T20I today")))
        .when(form == 2, F.concat("a", F.lit(" versus "), "b", F.lit(" on 2026-05-04 in the IPL")))
        .otherwise("please predict MI vs ind")
    )
    q = q.withColumn("m", text_)
    one, two = messages.teams(F.col("m"))
    return q.select(
        "id", one.alias("team1"), two.alias("team2"), messages.format_hint(F.col("m")).alias("format"),
        messages.competition_hint(F.col("m")).alias("competition"),
        messages.date_hint(F.col("m"), F.col("day")).alias("date"),
    )


# --- names, labels, requests -------------------------------------------------
@query(
    "team_names",
    """SELECT p_partkey, CASE p_partkey % 5 WHEN 0 THEN 'Punjab Kings' WHEN 1 THEN '' ELSE p_name END AS team,
  CASE p_partkey % 3 WHEN 0 THEN 'WBBL' WHEN 1 THEN NULL ELSE p_type END AS competition FROM part""",
)
def team_names(spark, sf):
    k = F.col("p_partkey")
    raw = F.when(k % 5 == 0, "  kings   XI Punjab ").when(k % 5 == 1, F.lit("  ")).otherwise(
        F.concat(F.lit(" "), F.replace(F.col("p_name"), F.lit(" "), F.lit("  ")), F.lit(" "))
    )
    event = F.when(k % 3 == 0, " Women's Big  Bash League").when(k % 3 == 1, "").otherwise(F.concat(F.lit(" "), "p_type"))
    return V.table(spark, sf, "part").select(
        "p_partkey", text.canonical_team(raw).alias("team"), text.canonical_competition(event).alias("competition")
    )


@query(
    "contest_formats",
    """SELECT p_partkey, CASE WHEN p_size = 5 THEN 'HUNDRED' WHEN p_partkey % 10 = 9 THEN 'T10' ELSE
  CASE p_partkey % 7 WHEN 0 THEN 'TEST' WHEN 1 THEN CASE WHEN p_brand < 'Brand#2' THEN 'T20I' ELSE 'T20' END WHEN 2 THEN 'FIRST_CLASS'
    WHEN 3 THEN 'LIST_A' WHEN 4 THEN 'ODI' WHEN 5 THEN CASE WHEN p_brand < 'Brand#2' THEN 'T20I' ELSE 'T20' END ELSE 'OTHER' END END AS format
FROM part""",
)
def contest_formats(spark, sf):
    k = F.col("p_partkey")
    names = ["Test", "t20", "MDM", "odm", "Womens ODI", "twenty20 cup", "beach"]
    kind = F.element_at(F.array(*map(F.lit, names)), (k % 7 + 1).cast("int"))
    team_type = F.when(F.col("p_brand") < "Brand#2", " International ").otherwise("club")
    overs = F.when(k % 10 == 9, 10).otherwise(20)
    return V.table(spark, sf, "part").select(
        "p_partkey", text.contest_format(kind, team_type, F.col("p_type"), F.col("p_size"), overs).alias("format")
    )


@query(
    "filtered_contests",
    f"""WITH {V.CONTESTS} SELECT match_id, format, competition FROM contests
WHERE format IN ('T20', 'T20I') AND (contains(lower(competition), 'asia') OR contains(lower(competition), 'merica'))""",
)
def filtered_contests(spark, sf):
    keep = text.passes_filters(F.col("format"), F.col("competition"), ["t20", "T20I"], ["ASIA", "merica"])
    return V.contests(spark, sf).where(keep).select("match_id", "format", "competition")


@query(
    "exclusion_reason",
    f"""WITH {V.CONTESTS} SELECT match_id, CASE WHEN match_id % 9 = 0 THEN 'missing_date' WHEN result_type <> 'win' THEN result_type
  WHEN match_id % 7 = 0 THEN 'winner_not_in_teams' END AS reason FROM contests""",
)
def exclusion_reason(spark, sf):
    date = F.when(F.col("match_id") % 9 > 0, F.col("date"))
    winner = F.when(F.col("match_id") % 7 == 0, "Nobody").otherwise(F.col("winner"))
    reason = outcomes.exclusion_reason(date, F.col("result_type"), winner, F.col("team1"), F.col("team2"))
    return V.contests(spark, sf).select("match_id", reason.alias("reason"))


@query(
    "toss_columns",
    f"""WITH {V.CONTESTS} SELECT match_id, side, mode, CASE WHEN mode = 'POST_TOSS' THEN toss_decision END AS toss_decision,
  CASE WHEN mode = 'POST_TOSS' THEN toss_winner = team END AS team_won_toss,
  CAST(CASE WHEN toss_decision = 'bat' THEN CASE WHEN toss_winner = team THEN 1 ELSE -1 END ELSE 0 END AS DOUBLE) AS bat,
  CAST(CASE WHEN toss_decision = 'field' THEN CASE WHEN toss_winner = team THEN 1 ELSE -1 END ELSE 0 END AS DOUBLE) AS field
FROM team_log CROSS JOIN (VALUES ('PRE_TOSS'), ('POST_TOSS')) m(mode)""",
)
def toss_columns(spark, sf):
    from tallyline.operators import contests as C

    rows = C.team_rows(C.prepare(V.contests(spark, sf))).withColumn(
        "mode", F.explode(F.array(*[F.lit(m) for m in text.MODES]))
    )
    toss = outcomes.toss_columns(F.col("mode"), F.col("team"), F.col("toss_winner"), F.col("toss_decision"))
    bat, field = outcomes.signed_toss_for(F.col("team"), F.col("toss_winner"), F.col("toss_decision"))
    return rows.select(
        "match_id", "side", "mode", toss["toss_decision"].alias("toss_decision"),
        toss["team_won_toss"].alias("team_won_toss"), bat.alias("bat"), field.alias("field"),
    )


@query(
    "overs_text",
    """SELECT l_orderkey, l_linenumber, l_quantity, count(*) AS n,
  CASE WHEN l_linenumber < 6 THEN CAST(l_quantity AS INT) * 6 + l_linenumber END AS balls,
  CASE WHEN l_linenumber >= 6 THEN 'Invalid cricket over notation ''' || CAST(l_quantity AS INT) || '.' || l_linenumber || ''': ball component must be 0-5' END AS reason
FROM lineitem GROUP BY l_orderkey, l_linenumber, l_quantity""",
)
def overs_text(spark, sf):
    lines = V.table(spark, sf, "lineitem").groupBy("l_orderkey", "l_linenumber", "l_quantity").agg(
        F.count(F.lit(1)).alias("n")
    )
    t = F.concat_ws(".", F.col("l_quantity").cast("int").cast("string"), F.col("l_linenumber").cast("string"))
    return lines.select(
        "*", scoring.overs_text_to_balls(t).alias("balls"), scoring.overs_reject_reason(t).alias("reason")
    )


@query(
    "edge_label",
    f"""WITH {V.SCORED}, e AS (SELECT *, greatest(p, 1 - p) AS w FROM scored)
SELECT match_id, CASE WHEN w < 0.55 THEN 'very close' WHEN w < 0.62 THEN 'slight' WHEN w < 0.72 THEN 'moderate' ELSE 'strong' END AS edge,
  CASE WHEN p >= 1 - p THEN 'A' ELSE 'B' END AS favourite, round(1 / (1 + pow(10, -(n_chars - 500) / 400.0)), 6) AS elo_p FROM e""",
)
def edge_label(spark, sf):
    p = F.col("p")
    return V.scored(spark, sf).select(
        "match_id", outcomes.edge_label(p).alias("edge"),
        outcomes.favourite(F.lit("A"), F.lit("B"), p).alias("favourite"),
        F.round(scoring.elo_probability(F.col("n_chars") - 500), 6).alias("elo_p"),
    )


@query(
    "terminal_chase",
    f"""WITH {V.DELIVERIES}, s AS (SELECT match_id, innings, count(*) AS balls, CAST(sum(runs_total) AS BIGINT) AS runs,
  count(*) FILTER (WHERE wicket) AS wickets FROM deliveries GROUP BY 1, 2),
r AS (SELECT *, greatest(40 - balls, 0) AS remaining, 700 AS target FROM s)
SELECT match_id, innings, CAST(CASE WHEN innings <> 2 THEN NULL WHEN runs >= target THEN 1 WHEN wickets >= 10 THEN 0
  WHEN remaining = 0 AND runs = target - 1 THEN 0.5 WHEN remaining = 0 THEN 0 END AS DOUBLE) AS p FROM r""",
)
def terminal_chase(spark, sf):
    s = V.deliveries(spark, sf).groupBy("match_id", "innings").agg(
        F.count(F.lit(1)).alias("balls"), F.sum("runs_total").alias("runs"), F.count_if("wicket").alias("wickets")
    )
    p, _ = scoring.terminal_chase(
        F.col("innings"), F.lit(700), F.col("runs"), F.col("wickets"), F.greatest(40 - F.col("balls"), F.lit(0))
    )
    return s.select("match_id", "innings", p.alias("p"))


ASSESSED = f"""
{V.SCORED}, a AS (
  SELECT match_id, p, greatest(p, 1 - p) AS w, CASE lang WHEN 'en' THEN 'T20' WHEN 'de' THEN 'T20I' ELSE 'T20' END AS format,
    CASE match_id % 3 WHEN 0 THEN 'PRE_TOSS' WHEN 1 THEN 'POST_TOSS' ELSE 'LIVE' END AS mode,
    n_chars % 30 AS h1, n_chars % 23 AS h2, (match_id % 5 > 0) AS venue_known, (match_id % 4 > 0) AS xi_known FROM scored
)
"""


@query(
    "confidence_label",
    f"""WITH {ASSESSED}, r AS (SELECT *,
  CASE WHEN w < 0.55 THEN 0 WHEN w < 0.72 THEN 1 ELSE 2 END AS sep,
  CASE WHEN mode = 'LIVE' THEN 2 WHEN format = 'T20I' THEN 2 WHEN mode = 'PRE_TOSS' AND w < 0.62 THEN 0 ELSE 1 END AS dom,
  CASE WHEN least(h1, h2) < 5 THEN 0 WHEN least(h1, h2) < 15 THEN 1 ELSE 2 END AS evi,
  CASE WHEN NOT xi_known AND mode = 'PRE_TOSS' THEN 0 WHEN NOT xi_known THEN 1 ELSE 2 END AS xi,
  CASE WHEN NOT venue_known AND mode <> 'LIVE' THEN 1 ELSE 2 END AS ven FROM a)
SELECT match_id, CASE least(sep, dom, evi, xi, ven) WHEN 0 THEN 'LOW' WHEN 1 THEN 'MEDIUM' ELSE 'HIGH' END AS confidence,
  3 + CAST(NOT xi_known AS INT) + CAST(NOT venue_known AND mode <> 'LIVE' AS INT) AS reasons FROM r""",
)
def confidence_label(spark, sf):
    k, n = F.col("match_id"), F.col("n_chars")
    mode = F.when(k % 3 == 0, "PRE_TOSS").when(k % 3 == 1, "POST_TOSS").otherwise("LIVE")
    xi = k % 4 > 0
    label, reasons = confidence.assess(
        probability=F.col("p"), format_=F.when(F.col("lang") == "de", "T20I").otherwise("T20"), mode=mode,
        history1=n % 30, history2=n % 23, venue_known=k % 5 > 0,
        previous_xi_complete=F.when(mode == "PRE_TOSS", xi), lineup_complete=F.when(mode != "PRE_TOSS", xi),
        parse_errors=F.lit(0), terminal=F.lit(False), innings=F.lit(2), balls=F.lit(30),
    )
    return V.scored(spark, sf).select("match_id", label.alias("confidence"), F.size(reasons).alias("reasons"))


@query(
    "request_rules",
    """WITH r AS (
  SELECT c_custkey, CASE c_custkey % 4 WHEN 0 THEN 'pre-toss' WHEN 1 THEN 'POSTTOSS' WHEN 2 THEN 'live' ELSE 'soon' END AS mode,
    CASE c_custkey % 5 WHEN 0 THEN 'ODI' WHEN 1 THEN 'the hundred' WHEN 2 THEN 'chess' ELSE 't20' END AS format,
    c_nationkey = c_custkey % 25 AS same, c_custkey % 7 AS v FROM customer)
SELECT c_custkey, CAST(mode = 'soon' AS INT) + CAST(format <> 't20' AS INT) + CAST(same AS INT)
  + CASE WHEN mode = 'POSTTOSS' THEN CASE WHEN v = 0 THEN 1 WHEN v = 1 THEN 2 ELSE 0 END ELSE 0 END
  + CASE WHEN mode = 'live' THEN CASE WHEN v = 0 THEN 2 WHEN v = 1 THEN 1 WHEN v = 2 THEN 2 ELSE 0 END ELSE 0 END AS reasons FROM r""",
)
def request_rules(spark, sf):
    c, k = F.col, F.col("c_custkey")
    v = k % 7
    mode = F.when(k % 4 == 0, "pre-toss").when(k % 4 == 1, "POSTTOSS").when(k % 4 == 2, "live").otherwise("soon")
    kind = F.when(k % 5 == 0, "ODI").when(k % 5 == 1, "the hundred").when(k % 5 == 2, "chess").otherwise("t20")
    one = F.concat(F.lit("N"), c("c_nationkey").cast("string"))
    two = F.concat(F.lit("N"), (k % 25).cast("string"))
    asked = V.table(spark, sf, "customer").select(
        "c_custkey", mode.alias("mode"), kind.alias("format"), one.alias("team1"), two.alias("team2"),
        F.lit("male").alias("gender"), F.lit(None).cast("string").alias("venue"), F.lit(None).cast("string").alias("competition"),
        F.when(v == 0, None).when(v == 1, "Stranger").otherwise(one).alias("toss_winner"),
        F.when(v == 1, "swim").otherwise("bowl").alias("toss_decision"),
        F.array(one).alias("team1_xi"), F.array().cast("array<string>").alias("team2_xi"),
        F.when(v == 0, "Stranger").otherwise(two).alias("batting_team"), F.lit(2).alias("innings"),
        F.when(v == 2, -1).otherwise(50).alias("runs"), F.when(v == 2, 11).otherwise(3).alias("wickets"),
        F.lit(60).alias("legal_balls"), F.when(v == 1, "10.7").alias("overs"), F.when(v == 0, -5).otherwise(160).alias("target"),
    )
    return requests.validate(asked).select("c_custkey", F.size("reject_reasons").alias("reasons"))

"""Training, scoring, streams and build counters over whole tables."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from checks import frame_queries as Q
from checks import history_queries as H
from checks import views as V
from tallyline.operators import contests as C
from tallyline.operators import frames, metrics
from tallyline.operators.elo import contest_scores
from tallyline.plans import models as M
from tallyline.plans import score as S
from tallyline.plans import train as T
from tallyline.plans.build import counters
from tallyline.session import ensure_checkpoint_dir, staged
from tallyline.streaming import live as R
from tallyline.streaming import ordered as O
from tallyline.streaming import pages as P

QUERIES, SQL = {}, {}


def query(name, sql=None):
    def register(fn):
        QUERIES[name] = fn
        if sql is not None:
            SQL[name] = sql
        return fn

    return register


ENDS = {"train_end": "1998-12-31", "valid_end": "1999-12-31"}
LOGISTIC = (M.Candidate(M.LOGISTIC),)
TREES = M.PAIRED_CANDIDATES[1:]


def paired(spark, sf):
    return frames.checked_pairs(Q.pairs(spark, sf))


@query("train_logistic")
def train_logistic(spark, sf):
    return T.train_domain(paired(spark, sf), mode="PRE_TOSS", domain="ALL", features=Q.DIFFS, candidates=LOGISTIC, **ENDS)[1]


@query("train_trees")
def train_trees(spark, sf):
    return T.train_domain(paired(spark, sf), mode="PRE_TOSS", domain="ALL", features=Q.DIFFS, candidates=TREES, **ENDS)[1]


@query("train_router")
def train_router(spark, sf):
    return T.train_router(paired(spark, sf), mode="PRE_TOSS", features=Q.DIFFS, **ENDS)[1]


@query("feature_group_folds")
def feature_group_folds(spark, sf):
    folds = (("1997", "1996-12-31", "1997-12-31"), ("1998", "1997-12-31", "1998-12-31"), ("1999", "1998-12-31", "1999-12-31"))
    groups = {"venue": Q.DIFFS[3:], "meetings": Q.DIFFS[2:3]}
    return T.feature_group_folds(paired(spark, sf), Q.DIFFS[:2], groups, folds)[1]


@query("finalize_candidate")
def finalize_candidate(spark, sf):
    return T.finalize_candidate(
        paired(spark, sf), mode="PRE_TOSS", base=Q.DIFFS[:2], extra=Q.DIFFS[2:], **ENDS
    )[1]


@query("train_live_model")
def train_live_model(spark, sf):
    """Score states of each line of an order, weighted so that orders count the same."""
    lines = V.table(spark, sf, "lineitem").select(
        F.col("l_orderkey").alias("match_id"), F.col("l_shipdate").cast("date").alias("date"),
        F.lit(1).alias("innings_number"), F.col("l_quantity").alias("runs"), F.col("l_linenumber").alias("wickets"),
        (F.col("l_discount") * 100).alias("elo_difference"),
        (F.col("l_returnflag") == "R").cast("int").alias("batting_team_eventual_win"),
    )
    return T.train_live(
        lines, innings_number=1, features=["runs", "wickets", "elo_difference"],
        candidates=(M.Candidate(M.LOGISTIC, intercept=True),), **ENDS,
    )[1]


@query(
    "elo_baseline",
    f"""WITH {V.CONTESTS}, {Q.FEATURES}, src AS (SELECT match_id, team_a_win AS y, 1 / (1 + pow(10, -matches_before_diff / 400.0)) AS p FROM sides),
{Q._metrics_sql(None)}""",
)
def elo_baseline(spark, sf):
    bundle = M.Bundle(M.ELO, ("matches_before_diff",), "PRE_TOSS", "ALL")
    scored = M.probability(bundle, Q.pairs(spark, sf))
    return Q._metric_columns(metrics.binary_metrics(scored, "team_a_win", "p", matches="match_id"))


@query("compare_models")
def compare_models(spark, sf):
    rows = paired(spark, sf)
    old = M.Bundle(M.ELO, ("matches_before_diff",), "PRE_TOSS", "ALL")
    new = M.Bundle(M.ELO, ("team_matches_at_venue_diff",), "PRE_TOSS", "ALL")
    return T.compare(rows, rows, old, new, "2000-01-01")


# The rating formula on other columns stands for fitted models, so that SQL can follow.
@query(
    "global_vs_routed",
    f"""WITH {V.CONTESTS}, {Q.FEATURES},
long AS (
  SELECT match_id, team_a_win AS y, m.model, d.dimension, d.grp AS grp0,
    1 / (1 + pow(10, -CASE WHEN m.model = 'global' OR format = 'T20I' THEN matches_before_diff ELSE team_matches_at_venue_diff END / 400.0)) AS p
  FROM sides, (VALUES ('global'), ('routed')) m(model),
    LATERAL (VALUES ('all', 'all'), ('format', format), ('competition', coalesce(competition, '(none)'))) d(dimension, grp)
  WHERE date >= DATE '1996-01-01'
),
src AS (SELECT *, model || '|' || dimension || '|' || grp0 AS grp FROM long),
m AS (WITH {Q._metrics_sql("grp").lstrip()}),
parts AS (SELECT *, split_part(grp, '|', 1) AS model, split_part(grp, '|', 2) AS dimension, split_part(grp, '|', 3) AS g FROM m)
SELECT a.dimension, a.g AS "group", a.n AS matches, a.brier_score AS global_brier_score, b.brier_score AS routed_brier_score,
  a.accuracy AS global_accuracy, b.accuracy AS routed_accuracy, a.roc_auc AS global_roc_auc, b.roc_auc AS routed_roc_auc,
  a.log_loss AS global_log_loss, b.log_loss AS routed_log_loss, a.ece_10 AS global_ece_10, b.ece_10 AS routed_ece_10
FROM parts a JOIN parts b ON a.dimension = b.dimension AND a.g = b.g AND a.model = 'global' AND b.model = 'routed'
WHERE a.dimension <> 'competition' OR a.n >= 20""",
)
def global_vs_routed(spark, sf):
    whole = M.Bundle(M.ELO, ("matches_before_diff",), "PRE_TOSS", "ALL")
    venue = M.Bundle(M.ELO, ("team_matches_at_venue_diff",), "PRE_TOSS", "T20")
    rows = paired(spark, sf)
    router = {f.format: whole if f.format == "T20I" else venue for f in rows.select("format").distinct().orderBy("format").collect()}
    out = T.global_vs_routed(rows, whole, router, "1996-01-01")
    return out.select("dimension", "group", "matches", *[F.round(f"{k}_{n}", 6).alias(f"{k}_{n}") for n in T.NAMES for k in ("global", "routed")])


SCORE_SQL = H._elo_sql(f"""
, {V.REQUESTS},
ratings AS (
  SELECT f.format, f.gender, c.date, f.k, f.ratings FROM fold f JOIN contests c USING (match_id)
  QUALIFY row_number() OVER (PARTITION BY f.format, f.gender, c.date ORDER BY f.k DESC) = 1
),
{H.DATE_FORM},
asked AS (
  SELECT r.*, h.n_nationkey + 1 AS i, a.n_nationkey + 1 AS j FROM requests r
  JOIN nation h ON h.n_name = r.team1 JOIN nation a ON a.n_name = r.team2
),
rated AS (
  SELECT a.*, coalesce(e.ratings[a.i] - e.ratings[a.j], 0) AS gap FROM asked a
  ASOF LEFT JOIN ratings e ON a.format = e.format AND a.gender = e.gender AND a.date > e.date
),
one AS (SELECT r.*, coalesce(d.n, 0) AS n1 FROM rated r ASOF LEFT JOIN daily d
  ON r.format = d.format AND r.gender = d.gender AND r.team1 = d.team AND r.date > d.date),
two AS (SELECT r.*, coalesce(d.n, 0) AS n2 FROM one r ASOF LEFT JOIN daily d
  ON r.format = d.format AND r.gender = d.gender AND r.team2 = d.team AND r.date > d.date),
p AS (SELECT *, 1 / (1 + pow(10, -gap / 400)) AS p1 FROM two)
SELECT match_id AS request_id, team1, team2, round(p1, 6) AS team1_probability, n1 AS team1_history_matches, n2 AS team2_history_matches,
  CASE WHEN greatest(p1, 1 - p1) < 0.55 THEN 'very close' WHEN greatest(p1, 1 - p1) < 0.62 THEN 'slight'
    WHEN greatest(p1, 1 - p1) < 0.72 THEN 'moderate' ELSE 'strong' END AS edge FROM p
""", tie="CAST(match_id AS VARCHAR)")  # served ids are text, and so is their order


def scoring_requests(spark, sf):
    nobody = F.array().cast("array<string>")
    none = F.lit(None)
    return V.requests(spark, sf).select(
        F.col("match_id").alias("request_id"), "date", "format", F.lit("pre-toss").alias("mode"), "gender", "venue",
        none.cast("string").alias("competition"), "team1", "team2", none.cast("string").alias("toss_winner"),
        none.cast("string").alias("toss_decision"), nobody.alias("team1_xi"), nobody.alias("team2_xi"),
        none.cast("string").alias("batting_team"),
        *[none.cast("int").alias(n) for n in ("innings", "runs", "wickets", "legal_balls")],
        none.cast("string").alias("overs"), none.cast("int").alias("target"),
    )


@query("batch_score", SCORE_SQL)
def batch_score(spark, sf):
    bundles = [
        M.Bundle(M.ELO, (M.ELO_FEATURE,), "PRE_TOSS", "T20I"),
        M.Bundle(M.ELO, (M.ELO_FEATURE,), "PRE_TOSS", "T20", feature_family=M.ROSTER_FAMILY),
    ]
    good, _ = S.score_requests(
        scoring_requests(spark, sf), V.contests_with_lineups(spark, sf), *V.batting_and_bowling(spark, sf), bundles
    )
    return good.select(
        "request_id", "team1", "team2", F.round("team1_probability", 6).alias("team1_probability"),
        "team1_history_matches", "team2_history_matches", "edge",
    )


# --- streams: one pass over what is there, then stop -------------------------
def _sink(spark) -> tuple[str, str]:
    base = f"{ensure_checkpoint_dir(spark)}/stream-{uuid.uuid4().hex}"
    return f"{base}/out", f"{base}/checkpoint"


def delivery_stream(spark, sf):
    # One of the tables in the folder; a file source filters by name.
    events = spark.readStream.schema(V.SCHEMAS["events"]).option("pathGlobFilter", "events.parquet").parquet(sf)
    kind = F.col("event_type")
    return events.select(
        F.col("user_id").alias("match_id"), F.when(F.dayofmonth("ts") <= 15, 1).otherwise(2).alias("innings"),
        F.col("event_id").alias("seq"), "ts", F.lit("A").alias("batting_team"),
        F.floor("value").alias("runs_total"), (kind == "purchase").alias("wicket"),
        (kind == "error").alias("is_wide"), (kind == "signup").alias("is_noball"),
    )


STREAM_SQL = f"""
WITH {V.DELIVERIES}
SELECT CAST(match_id AS VARCHAR) AS match_id, innings, seq, CAST(sum(runs_total) OVER w AS BIGINT) AS runs,
  CAST(sum(CAST(wicket AS INT)) OVER w AS BIGINT) AS wickets,
  CAST(sum(CAST(NOT is_wide AND NOT is_noball AS INT)) OVER w AS BIGINT) AS legal_balls_bowled
FROM deliveries WINDOW w AS (PARTITION BY match_id, innings ORDER BY seq ROWS UNBOUNDED PRECEDING)
"""


@query("stream_live_states", STREAM_SQL)
def stream_live_states(spark, sf):
    out, checkpoint = _sink(spark)
    scores = R.on_time(R.running_score(delivery_stream(spark, sf))).drop("ts", "batting_team", "late")
    R.run_available(scores.writeStream.format("parquet").option("path", out), checkpoint)
    return spark.read.schema(scores.schema).parquet(out)


@query(
    "stream_win_probability",
    f"""WITH s AS ({STREAM_SQL}) SELECT match_id, innings, seq, runs,
  round(1 / (1 + pow(10, -(CAST(match_id AS BIGINT) % 50 - 25) / 400.0)), 6) AS batting_probability FROM s WHERE innings = 2""",
)
def stream_win_probability(spark, sf):
    out, checkpoint = _sink(spark)
    context = V.table(spark, sf, "events").select("user_id").distinct().select(
        F.col("user_id").cast("string").alias("match_id"), F.lit("A").alias("batting_team"),
        (F.col("user_id") % 50 - 25).cast("double").alias("elo_difference"), F.lit(4000).alias("goal"),
    )
    bundle = M.Bundle(M.ELO, ("elo_difference",), M.LIVE_MODE, "LIVE", innings_number=2)
    p = R.win_probability(
        R.running_score(delivery_stream(spark, sf)), context, bundle, F.lit(120), F.lit(6)
    ).select("match_id", "innings", "seq", "runs", F.round("batting_probability", 6).alias("batting_probability"))
    R.run_available(p.writeStream.format("parquet").option("path", out), checkpoint)
    return spark.read.schema(p.schema).parquet(out)


@query("stream_ratings", H.SQL["elo_after"])
def stream_ratings(spark, sf):
    out, checkpoint = _sink(spark)
    contests = staged(V.contests(spark, sf))
    source = contests.inputFiles()[0].rsplit("/", 1)[0]
    stream = spark.readStream.schema(contests.schema).parquet(source)
    R.run_available(R.update_ratings(stream, out), checkpoint)
    return spark.read.parquet(f"{out}/version=0").select("format", "sex", "team", F.round("rating", 6).alias("rating"))


@query("stream_late_ratings", H.SQL["elo_after"])
def stream_late_ratings(spark, sf):
    """Contests of three periods in four micro-batches: one in ten comes a batch late and is replayed."""
    out, checkpoint = _sink(spark)
    source = f"{out}-arrived"
    period = F.when(F.year("date") < 1994, 0).when(F.year("date") < 1996, 1).otherwise(2)
    contests = V.contests(spark, sf)
    arrives = (period + (F.crc32(F.col("match_id").cast("string")) % 10 == 0).cast("int")).alias("arrives")
    # One pass deals the contests to their micro-batches.
    dealt = staged(contests.select("*", arrives))
    for b in range(4):
        dealt.where(F.col("arrives") == b).drop("arrives").write.mode("append").parquet(source)
        R.run_available(R.update_ratings(spark.readStream.schema(contests.schema).parquet(source), out), checkpoint)
    return spark.read.parquet(f"{out}/version=3").select("format", "sex", "team", F.round("rating", 6).alias("rating"))


HALF_DAY = 12 * 3600

ORDERED_SQL = f"""
WITH balls AS (SELECT user_id, event_id, ts, event_type AS e, value, CASE WHEN day(ts) <= 15 THEN 1 ELSE 2 END AS innings,
  epoch_us(ts) * 1000 + event_id % 1000 AS seq FROM events),
scores AS (SELECT CAST(user_id AS VARCHAR) AS match_id, innings, seq, epoch_ms(ts) AS ms,
  CAST(sum(CAST(floor(value) AS BIGINT)) OVER w AS BIGINT) AS runs, CAST(sum(CAST(e = 'purchase' AS INT)) OVER w AS BIGINT) AS wickets,
  CAST(sum(CAST(e NOT IN ('error', 'signup') AS INT)) OVER w AS BIGINT) AS legal_balls_bowled
  FROM balls WINDOW w AS (PARTITION BY user_id, innings ORDER BY seq ROWS UNBOUNDED PRECEDING))
SELECT match_id, innings, seq, runs, wickets, legal_balls_bowled, false AS late FROM scores
WHERE ms < (SELECT max(epoch_ms(ts)) FROM events) - {HALF_DAY * 1000}
"""


@query("stream_ordered_scores", ORDERED_SQL)
def stream_ordered_scores(spark, sf):
    """Deliveries up to half a day out of order in four micro-batches; those of the last half day are still held."""
    out, checkpoint = _sink(spark)
    source = f"{out}-arrived"
    events = V.table(spark, sf, "events")
    noise = F.crc32(F.col("event_id").cast("string")) % HALF_DAY
    week = F.floor((F.unix_seconds(F.col("ts").cast("timestamp")) + noise - F.unix_seconds(F.lit("2024-01-01").cast("timestamp"))) / (7 * 24 * 3600))
    kind = F.col("event_type")
    balls = events.select(
        F.col("user_id").alias("match_id"), F.when(F.dayofmonth("ts") <= 15, 1).otherwise(2).alias("innings"),
        (F.unix_micros(F.col("ts").cast("timestamp")) * 1000 + F.col("event_id") % 1000).alias("seq"),
        F.col("ts").cast("timestamp").alias("ts"), F.lit("A").alias("batting_team"), F.floor("value").alias("runs_total"),
        (kind == "purchase").alias("wicket"), (kind == "error").alias("is_wide"), (kind == "signup").alias("is_noball"),
        F.least(F.greatest(week, F.lit(0)), F.lit(3)).alias("arrives"),
    )
    dealt = staged(balls)
    arrived = dealt.drop("arrives").schema
    for b in range(4):
        dealt.where(F.col("arrives") == b).drop("arrives").write.mode("append").parquet(source)
        scores = O.ordered_score(spark.readStream.schema(arrived).parquet(source), delay=f"{HALF_DAY} seconds")
        R.run_available(scores.writeStream.format("parquet").option("path", out), checkpoint)
    return spark.read.schema(scores.schema).parquet(out).select(
        "match_id", "innings", "seq", "runs", "wickets", "legal_balls_bowled", "late"
    )


# Orders as records of their customer's match, in pages of one period each.
PAGE_RECORDS = 2000

NEWEST_SQL = """
WITH r AS (SELECT o_custkey, o_orderkey, floor(o_totalprice) % 400 AS runs,
  CASE WHEN year(o_orderdate) < 1994 THEN 0 WHEN year(o_orderdate) < 1996 THEN 1 ELSE 2 END AS period FROM orders)
SELECT CAST(o_custkey AS VARCHAR) AS match_id, 'ball ' || arg_max(o_orderkey, period * 1000000000000 + o_orderkey) AS status,
  CAST(arg_max(runs, period * 1000000000000 + o_orderkey) AS INT) AS runs FROM r GROUP BY o_custkey
"""


def write_pages(spark, sf, period, folder):
    """A file for each page: the records of some customers, each customer's in the order of its orders."""
    c = F.col
    when = F.when(F.year("o_orderdate") < 1994, 0).when(F.year("o_orderdate") < 1996, 1).otherwise(2)
    orders = V.table(spark, sf, "orders").where(when == period).select("o_custkey", "o_orderkey", "o_totalprice")
    score = F.struct((F.floor("o_totalprice") % 400).cast("int").alias("r"), F.lit(0).alias("w"), F.lit(2).alias("o"), F.lit("A Inning 1").alias("inning"))
    record = F.struct(
        c("o_orderkey").alias("_at"), c("o_custkey").cast("string").alias("id"), F.lit("A vs B").alias("name"), F.lit("t20").alias("matchType"),
        F.concat(F.lit("ball "), c("o_orderkey").cast("string")).alias("status"), F.lit("2024-01-01").alias("date"),
        F.array(F.lit("A"), F.lit("B")).alias("teams"), F.lit(True).alias("matchStarted"), F.lit(False).alias("matchEnded"),
        F.array(score).alias("score"),
    )
    pages = max(1, -(-orders.count() // PAGE_RECORDS))
    page = F.pmod(F.xxhash64("o_custkey"), F.lit(pages))
    body = orders.groupBy(page.alias("page")).agg(F.array_sort(F.collect_list(record)).alias("data"))
    # A record's place in the order goes out with it; the reader takes the fields it knows.
    text = F.to_json(F.struct(F.lit("success").alias("status"), "data"))
    body.select(text.alias("value")).write.mode("append").option("maxRecordsPerFile", 1).text(folder)


@query("stream_feed_newest", NEWEST_SQL)
def stream_feed_newest(spark, sf):
    """Three micro-batches of feed pages; the newest record of every match is what remains."""
    out, checkpoint = _sink(spark)
    folder = f"{out}-pages"
    for period in range(3):
        write_pages(spark, sf, period, folder)
        rows = P.newest_records(spark, folder)
        R.run_available(rows.writeStream.format("parquet").option("path", out), checkpoint)
    newest = P.current(spark.read.schema(rows.schema).parquet(out))
    return newest.select("match_id", "status", F.get("scores", F.lit(0))["runs"].cast("int").alias("runs"))


# --- build bookkeeping --------------------------------------------------------
@query(
    "build_counters",
    f"""WITH {V.CONTESTS}, r AS (SELECT format, competition, CASE WHEN result_type <> 'win' THEN result_type END AS excluded FROM contests)
SELECT 'format' AS kind, format AS name, count(*) AS n FROM r GROUP BY format
UNION ALL SELECT 'competition', competition, count(*) FROM r GROUP BY competition
UNION ALL SELECT 'excluded', excluded, count(*) FROM r WHERE excluded IS NOT NULL GROUP BY excluded""",
)
def build_counters(spark, sf):
    return counters(V.contests(spark, sf))


@query(
    "first_contests",
    f"WITH {V.CONTESTS} SELECT match_id, date FROM contests ORDER BY date, match_id LIMIT 100",
)
def first_contests(spark, sf):
    return V.contests(spark, sf).select("match_id", "date").orderBy("date", "match_id").limit(100)


@query(
    "unique_matches",
    "SELECT l_orderkey AS match_id, min(l_suppkey || '/' || l_linenumber) AS path FROM lineitem GROUP BY l_orderkey",
)
def unique_matches(spark, sf):
    copies = V.table(spark, sf, "lineitem").select(
        F.col("l_orderkey").alias("match_id"),
        F.concat_ws("/", F.col("l_suppkey").cast("string"), F.col("l_linenumber").cast("string")).alias("path"),
    )
    return C.dedupe_contests(copies.distinct())


@query(
    "rating_scores",
    f"""WITH {V.CONTESTS} SELECT match_id, CAST(CASE WHEN winner = team1 THEN 1 WHEN winner = team2 THEN 0 WHEN result_type = 'draw' THEN 0.5 END AS DOUBLE) AS score FROM contests""",
)
def rating_scores(spark, sf):
    return contest_scores(C.prepare(V.contests(spark, sf))).select("match_id", "score")

"""Live states, model frames, metrics, audits, quality and resolution."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from checks import history_queries as H
from checks import views as V
from tallyline.functions.scoring import ball_limit, notation_to_balls, overs_notation
from tallyline.operators import audit, contests as C, frames, live, metrics, participants as P, quality, resolve
from tallyline.operators.sizing import key_limit, long_side
from tallyline.plans import audit as audit_plan
from tallyline.plans.features import prematch_features
from tallyline.session import ensure_checkpoint_dir, staged

QUERIES, SQL = {}, {}


def query(name, sql=None):
    def register(fn):
        QUERIES[name] = fn
        if sql is not None:
            SQL[name] = sql
        return fn

    return register


def _r(*names, digits=6):
    return [F.round(n, digits).alias(n) for n in names]


# --- live states -------------------------------------------------------------
RUNNING = """
states AS (
  SELECT match_id, innings, seq, sum(runs_total) OVER w AS runs, sum(CAST(wicket AS INT)) OVER w AS wickets,
    sum(CAST(NOT is_wide AND NOT is_noball AS INT)) OVER w AS legal_balls_bowled
  FROM deliveries
  WINDOW w AS (PARTITION BY match_id, innings ORDER BY ts, seq ROWS UNBOUNDED PRECEDING)
)
"""
LIVE_SQL = f"WITH {V.DELIVERIES}, {RUNNING} SELECT match_id, innings, seq, CAST(runs AS BIGINT) AS runs, CAST(wickets AS BIGINT) AS wickets, CAST(legal_balls_bowled AS BIGINT) AS legal_balls_bowled FROM states"


def _states(spark, sf, max_rows=None):
    return live.running_score(V.deliveries(spark, sf), order=("ts", "seq"), max_rows=max_rows)


def _live_columns(df):
    return df.select("match_id", "innings", "seq", "runs", "wickets", "legal_balls_bowled")


query("live_states", LIVE_SQL)(lambda spark, sf: _live_columns(_states(spark, sf)))
query("live_states_split_keys", LIVE_SQL)(lambda spark, sf: _live_columns(_states(spark, sf, max_rows=20)))


@query(
    "live_rates",
    f"""
WITH {V.DELIVERIES}, {RUNNING},
m AS (SELECT *, 120 AS lim, CASE WHEN innings = 2 THEN 4000 END AS target FROM states),
r AS (
  SELECT *, greatest(lim - legal_balls_bowled, 0) AS balls_remaining, target - runs AS runs_required,
    CASE WHEN legal_balls_bowled <> 0 THEN runs / (legal_balls_bowled / 6.0) END AS current_run_rate
  FROM m
),
q AS (
  SELECT *, CASE WHEN balls_remaining > 0 THEN runs_required / (balls_remaining / 6.0) END AS required_run_rate
  FROM r
)
SELECT match_id, innings, seq, round(legal_balls_bowled // 6 + (legal_balls_bowled % 6) / 10.0, 6) AS overs,
  CAST(balls_remaining AS BIGINT) AS balls_remaining, round(current_run_rate, 6) AS current_run_rate,
  CAST(runs_required AS BIGINT) AS runs_required, round(required_run_rate, 6) AS required_run_rate,
  round(current_run_rate - required_run_rate, 6) AS run_rate_difference,
  CAST(10 - wickets AS BIGINT) AS wickets_in_hand
FROM q
""",
)
def live_rates(spark, sf):
    target = F.when(F.col("innings") == 2, 4000)
    out = live.with_metrics(_states(spark, sf), F.lit(120), F.lit(6), target)
    return out.select(
        "match_id", "innings", "seq", "balls_remaining", "runs_required", "wickets_in_hand",
        *_r("overs", "current_run_rate", "required_run_rate", "run_rate_difference"),
    )


@query(
    "last_delivery",
    """
SELECT user_id AS match_id, arg_max('s' || (event_id % 9), (innings, event_id)) AS striker,
  arg_max('n' || (event_id % 8), (innings, event_id)) AS non_striker,
  arg_max('b' || (event_id % 7), (innings, event_id)) AS bowler
FROM (SELECT *, CASE WHEN day(ts) <= 15 THEN 1 ELSE 2 END AS innings FROM events) GROUP BY user_id
""",
)
def last_delivery(spark, sf):
    def named(letter, n):
        return F.concat(F.lit(letter), (F.col("seq") % n).cast("string"))

    d = V.deliveries(spark, sf).withColumns(
        {"striker": named("s", 9), "non_striker": named("n", 8), "bowler": named("b", 7)}
    )
    return live.last_delivery(d)


@query(
    "innings_totals",
    f"""
WITH {V.DELIVERIES}
SELECT match_id, innings, CAST(sum(runs_total) AS BIGINT) AS runs, count(*) FILTER (WHERE wicket) AS wickets,
  count(*) FILTER (WHERE NOT is_wide AND NOT is_noball) AS balls
FROM deliveries GROUP BY match_id, innings
""",
)
def innings_totals(spark, sf):
    legal = ~F.col("is_wide") & ~F.col("is_noball")
    return V.deliveries(spark, sf).groupBy("match_id", "innings").agg(
        F.sum("runs_total").alias("runs"), F.count_if("wicket").alias("wickets"),
        F.count_if(legal).alias("balls"),
    )


@query(
    "over_notation",
    """
SELECT l_orderkey, l_suppkey, l_linenumber, l_quantity, count(*) AS n,
  round(CAST(l_quantity AS INT) // 6 + (CAST(l_quantity AS INT) % 6) / 10.0, 6) AS overs,
  CAST(l_quantity AS INT) AS balls_back
FROM lineitem GROUP BY l_orderkey, l_suppkey, l_linenumber, l_quantity
""",
)
def over_notation(spark, sf):
    overs = overs_notation(F.col("l_quantity").cast("int"), F.lit(6))
    lines = V.table(spark, sf, "lineitem").groupBy(
        "l_orderkey", "l_suppkey", "l_linenumber", "l_quantity"
    ).agg(F.count(F.lit(1)).alias("n"))
    return lines.withColumn("overs", overs).withColumns(
        {"balls_back": notation_to_balls(F.col("overs"), F.lit(6)), "overs": F.round("overs", 6)}
    )


@query(
    "ball_limits",
    f"""
WITH {V.CONTESTS}, c AS (
  SELECT match_id, format, CASE WHEN match_id % 5 < 4 THEN CASE match_id % 4 WHEN 0 THEN 20 WHEN 1 THEN 50 WHEN 2 THEN 10 ELSE 0 END END AS planned,
    CASE WHEN match_id % 7 = 0 THEN 12.3 END AS target_overs FROM contests
)
SELECT match_id, CASE WHEN format = 'TEST' THEN NULL
  WHEN target_overs IS NOT NULL THEN CASE WHEN format = 'HUNDRED' THEN 63 ELSE 75 END
  WHEN format = 'HUNDRED' THEN CASE WHEN planned = 10 THEN 50 ELSE 100 END
  WHEN planned > 0 THEN planned * 6
  WHEN format = 'ODI' THEN 300 ELSE 120 END AS ball_limit
FROM c
""",
)
def ball_limits(spark, sf):
    key = F.col("match_id")
    planned = F.when(key % 4 == 0, 20).when(key % 4 == 1, 50).when(key % 4 == 2, 10).otherwise(0)
    planned = F.when(key % 5 < 4, planned)
    target = F.when(key % 7 == 0, 12.3)
    none = F.lit(None).cast("int")
    return V.contests(spark, sf).select(
        "match_id", ball_limit(F.col("format"), planned, none, target).alias("ball_limit")
    )


# --- feature tables shared by the frame and audit queries --------------------
def features(spark, sf, lineups=False):
    """Form, meetings and venue per side and mode: the whole table, without ratings."""
    source = V.contests_with_lineups(spark, sf) if lineups else staged(V.contests(spark, sf))
    prepared = C.prepare(source)
    rows = C.team_rows(prepared)
    if lineups:
        # Lists are rated from the plain rows and stored; the windows below carry a word for each, not the list.
        members = P.lineup_members(rows, F.col("xi"))
        snapshot = staged(P.lineup_snapshot(P.player_state(prepared, *V.batting_and_bowling(spark, sf), members)))
        rows = rows.withColumn(
            "lineup_status",
            F.when(F.col("xi").isNotNull(), "LINEUP_KNOWN").otherwise("LINEUP_UNKNOWN"),
        )
    # All three keys begin with the team's, which is counted once for them.
    limit = key_limit(rows, [*C.POOL, "team"])
    rows = C.team_at_venue(C.head_to_head(C.team_form(rows, limit), limit), limit)
    if lineups:
        rows = rows.join(long_side(snapshot), ["match_id", "side"], "left")
    return prematch_features(rows)


FEATURES = f"""
features AS (
  SELECT match_id, date, format, gender, competition, side, team, won AS team_win, result_type,
    toss_winner, toss_decision,
    coalesce(sum(CAST(played AS INT)) OVER t, 0) AS matches_before,
    coalesce(sum(CASE WHEN played THEN won ELSE 0 END) OVER t, 0) AS wins_before,
    coalesce(sum(CAST(decisive AS INT)) OVER h, 0) AS h2h_matches_before,
    coalesce(sum(CAST(decisive AS INT)) OVER v, 0) AS team_matches_at_venue
  FROM flagged
  WINDOW t AS (PARTITION BY format, gender, team ORDER BY date, match_id
               ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING),
    h AS (PARTITION BY format, gender, team, opponent ORDER BY date, match_id
          ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING),
    v AS (PARTITION BY format, gender, team, venue ORDER BY date, match_id
          ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)
),
rated AS (
  SELECT *, wins_before / nullif(matches_before, 0) AS win_rate_before FROM features
  WHERE result_type = 'win'
),
sides AS (
  SELECT a.match_id, a.date, a.format, a.competition, a.gender, a.team AS team_a, b.team AS team_b,
    a.team_win AS team_a_win, CAST(a.matches_before - b.matches_before AS DOUBLE) AS matches_before_diff,
    a.win_rate_before - b.win_rate_before AS win_rate_before_diff,
    CAST(a.h2h_matches_before - b.h2h_matches_before AS DOUBLE) AS h2h_matches_before_diff,
    CAST(a.team_matches_at_venue - b.team_matches_at_venue AS DOUBLE) AS team_matches_at_venue_diff,
    CASE WHEN a.toss_winner = a.team THEN 1.0 ELSE -1.0 END AS sign, a.toss_decision
  FROM rated a JOIN rated b ON a.match_id = b.match_id AND a.team < b.team
)
"""
SOURCES = ("matches_before", "win_rate_before", "h2h_matches_before", "team_matches_at_venue")
DIFFS = [f"{n}_diff" for n in SOURCES]


def pairs(spark, sf, mode="PRE_TOSS"):
    return frames.pair_rows(features(spark, sf), mode, SOURCES)


_PAIR_COLUMNS = """match_id, date, format, competition, gender, team_a, team_b, team_a_win,
  matches_before_diff, round(win_rate_before_diff, 6) AS win_rate_before_diff,
  h2h_matches_before_diff, team_matches_at_venue_diff"""


@query("pair_sides", f"WITH {V.CONTESTS}, {FEATURES} SELECT {_PAIR_COLUMNS} FROM sides")
def pair_sides(spark, sf):
    out = frames.checked_pairs(pairs(spark, sf))
    return out.withColumn("win_rate_before_diff", F.round("win_rate_before_diff", 6))


@query(
    "pair_after_toss",
    f"""WITH {V.CONTESTS}, {FEATURES} SELECT {_PAIR_COLUMNS},
  CAST(CASE WHEN toss_decision = 'bat' THEN sign ELSE 0 END AS DOUBLE) AS toss_bat_advantage,
  CAST(CASE WHEN toss_decision = 'field' THEN sign ELSE 0 END AS DOUBLE) AS toss_field_advantage FROM sides""",
)
def pair_after_toss(spark, sf):
    out = frames.checked_pairs(pairs(spark, sf, "POST_TOSS"))
    return out.withColumn("win_rate_before_diff", F.round("win_rate_before_diff", 6))


@query(
    "mirrored",
    f"""WITH {V.CONTESTS}, {FEATURES}, m AS (
  SELECT match_id, team_a_win, 1 AS sign, matches_before_diff AS x, h2h_matches_before_diff AS y FROM sides
  UNION ALL
  SELECT match_id, 1 - team_a_win, -1, 0 - matches_before_diff, 0 - h2h_matches_before_diff FROM sides)
SELECT match_id, team_a_win, sign, x AS matches_before_diff, y AS h2h_matches_before_diff FROM m""",
)
def mirrored(spark, sf):
    base = pairs(spark, sf).select("match_id", "team_a_win", "matches_before_diff", "h2h_matches_before_diff")
    return frames.mirrored(base, ["matches_before_diff", "h2h_matches_before_diff"], "team_a_win").withColumns(
        {c: F.col(c) + F.lit(0.0) for c in ("matches_before_diff", "h2h_matches_before_diff")}
    )


SPLIT = ("1998-12-31", "1999-12-31")


@query(
    "temporal_split",
    f"""WITH {V.DELIVERIES}, d AS (SELECT match_id, seq, CAST(ts AS DATE) AS date FROM deliveries),
f AS (SELECT match_id, min(date) AS first FROM d GROUP BY match_id)
SELECT d.match_id, d.seq, CASE WHEN first <= DATE '2024-01-01' THEN 'train'
  WHEN first <= DATE '2024-01-02' THEN 'valid' ELSE 'test' END AS split FROM d JOIN f USING (match_id)""",
)
def temporal_split(spark, sf):
    d = V.deliveries(spark, sf).select("match_id", "seq", F.col("ts").cast("date").alias("date"))
    return frames.temporal_split(d, "2024-01-01", "2024-01-02").select("match_id", "seq", "split")


@query(
    "split_ranges",
    f"""WITH {V.CONTESTS}, s AS (SELECT match_id, date, CASE WHEN date <= DATE '{SPLIT[0]}' THEN 'train'
  WHEN date <= DATE '{SPLIT[1]}' THEN 'valid' ELSE 'test' END AS split FROM team_log)
SELECT split, count(*) AS n, count(DISTINCT match_id) AS matches, min(date) AS start, max(date) AS "end" FROM s GROUP BY split""",
)
def split_ranges(spark, sf):
    log = C.team_rows(C.prepare(V.contests(spark, sf))).select("match_id", "date")
    return metrics.split_ranges(frames.temporal_split(log, *SPLIT))


@query(
    "equal_weights",
    f"""WITH {V.DELIVERIES}, n AS (SELECT match_id, count(*) AS c FROM deliveries GROUP BY match_id),
t AS (SELECT sum(c) AS rows, count(*) AS groups FROM n)
SELECT d.match_id, d.seq, round(t.rows / (t.groups * n.c), 9) AS weight FROM deliveries d JOIN n USING (match_id), t""",
)
def equal_weights(spark, sf):
    d = V.deliveries(spark, sf).select("match_id", "seq")
    return frames.equal_weights(d).select("match_id", "seq", F.round("weight", 9).alias("weight"))


@query(
    "many_to_one_join",
    """SELECT l_orderkey, count(*) AS n, sum(CAST(o_orderstatus = 'F' AS INT)) AS won
FROM lineitem JOIN orders ON l_orderkey = o_orderkey GROUP BY l_orderkey""",
)
def many_to_one_join(spark, sf):
    lines = V.table(spark, sf, "lineitem").select("l_orderkey")
    orders = V.table(spark, sf, "orders").select(F.col("o_orderkey").alias("l_orderkey"), "o_orderstatus")
    joined = frames.join_many_to_one(lines, orders, ["l_orderkey"])
    return joined.groupBy("l_orderkey").agg(
        F.count(F.lit(1)).alias("n"),
        F.sum((F.col("o_orderstatus") == "F").cast("int")).alias("won"),
    )


@query(
    "common_ids",
    """SELECT l_orderkey AS match_id FROM lineitem WHERE l_returnflag = 'R' INTERSECT
SELECT o_orderkey FROM orders WHERE o_orderstatus = 'F'""",
)
def common_ids(spark, sf):
    left = V.table(spark, sf, "lineitem").where("l_returnflag = 'R'").select(F.col("l_orderkey").alias("match_id"))
    right = V.table(spark, sf, "orders").where("o_orderstatus = 'F'").select(F.col("o_orderkey").alias("match_id"))
    return frames.common_ids(left, right)


@query(
    "target_conflicts",
    """SELECT doc_id AS match_id, quality AS left_target, toxic AS right_target FROM labels WHERE quality <> toxic""",
)
def target_conflicts(spark, sf):
    labels = V.table(spark, sf, "labels")
    left = labels.select(F.col("doc_id").alias("match_id"), F.col("quality").alias("team_a_win"))
    right = labels.select(F.col("doc_id").alias("match_id"), F.col("toxic").alias("team_a_win"))
    return frames.target_conflicts(left, right)


@query(
    "roster_differences",
    f"""WITH {V.CONTESTS}, {V.LINEUPS}, {FEATURES}, {H.PREVIOUS_XI}
SELECT s.match_id, s.team_a, s.team_b, CAST(a.rest_days - b.rest_days AS DOUBLE) AS rest_days_diff
FROM sides s LEFT JOIN previous a ON a.match_id = s.match_id AND a.team = s.team_a
LEFT JOIN previous b ON b.match_id = s.match_id AND b.team = s.team_b""",
)
def roster_differences(spark, sf):
    from tallyline.operators import participants as P

    rows = P.previous_lineups(C.team_rows(C.prepare(V.contests_with_lineups(spark, sf))))
    side = rows.select("match_id", "team", "rest_days")
    paired = pairs(spark, sf).select("match_id", "team_a", "team_b")
    return frames.append_differences(paired, side, ["rest_days"])


@query(
    "live_training_frame",
    f"""WITH {V.CONTESTS}, {FEATURES}, d AS (
  SELECT l_orderkey AS match_id, l_linenumber, count(*) AS n FROM lineitem GROUP BY 1, 2)
SELECT d.match_id, d.l_linenumber AS seq, r.team AS batting_team, r.matches_before,
  CAST(CASE WHEN r.toss_decision = 'bat' THEN CASE WHEN r.toss_winner = r.team THEN 1 ELSE -1 END ELSE 0 END AS DOUBLE) AS toss_bat_signed,
  CAST(r.format = 'T20I' AS DOUBLE) AS is_t20i, CAST(r.gender = 'male' AS DOUBLE) AS is_male
FROM d JOIN contests c USING (match_id) JOIN rated r ON r.match_id = d.match_id AND r.team = c.team1""",
)
def live_training_frame(spark, sf):
    states = (
        V.table(spark, sf, "lineitem")
        .select(F.col("l_orderkey").alias("match_id"), F.col("l_linenumber").alias("seq"))
        .distinct()
        .join(V.contests(spark, sf).select("match_id", "format", F.col("team1").alias("batting_team")), "match_id")
        .select("*", F.lit(1).alias("innings_number"), F.lit(True).alias("is_legal"),
                F.lit(1).alias("batting_team_eventual_win"))
    )
    out = frames.live_training_frame(states, features(spark, sf))
    return out.select("match_id", "seq", "batting_team", "matches_before", "toss_bat_signed", "is_t20i", "is_male")


# --- metrics -----------------------------------------------------------------
_EDGES = "[" + ", ".join(f"CAST({e!r} AS DOUBLE)" for e in metrics.ECE_EDGES) + "]"


def _metrics_sql(group: str | None, weighted: bool = False) -> str:
    """All metrics per group; AUC by rank sums with half credit for ties."""
    g = "0" if group is None else group
    w = "w" if weighted else "1.0"
    out = "" if group is None else f"b.g AS {group}, "
    return f"""
q AS (SELECT *, {g} AS g, least(greatest(p, 1e-9), 1 - 1e-9) AS q, len(list_filter({_EDGES}, lambda e: e <= p)) AS bin FROM src),
base AS (SELECT g, count(*) AS n, count(DISTINCT match_id) AS matches,
  sum({w} * CAST((q >= 0.5) = (y = 1) AS INT)) / sum({w}) AS accuracy,
  sum(-{w} * (y * ln(q) + (1 - y) * ln(1 - q))) / sum({w}) AS log_loss,
  sum({w} * (q - y) * (q - y)) / sum({w}) AS brier_score, sum({w} * y) / sum({w}) AS positive_rate FROM q GROUP BY g),
h AS (SELECT g, q, sum(CASE WHEN y = 1 THEN {w} ELSE 0 END) AS pos, sum(CASE WHEN y = 1 THEN 0 ELSE {w} END) AS neg FROM q GROUP BY g, q),
r AS (SELECT *, coalesce(sum(neg) OVER (PARTITION BY g ORDER BY q ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS less FROM h),
auc AS (SELECT g, sum(pos * (less + neg / 2)) / nullif(sum(pos) * sum(neg), 0) AS roc_auc FROM r GROUP BY g),
bins AS (SELECT g, bin, abs(sum({w} * q) - sum({w} * y)) AS gap, sum({w}) AS w FROM q GROUP BY g, bin),
ece AS (SELECT g, sum(gap) / sum(w) AS ece_10 FROM bins GROUP BY g)
SELECT {out}b.n, b.matches, round(accuracy, 6) AS accuracy, round(log_loss, 6) AS log_loss,
  round(brier_score, 6) AS brier_score, round(positive_rate, 6) AS positive_rate,
  round(roc_auc, 6) AS roc_auc, round(ece_10, 6) AS ece_10
FROM base b JOIN auc a ON a.g = b.g JOIN ece e ON e.g = b.g"""


_METRICS = ("accuracy", "log_loss", "brier_score", "positive_rate", "roc_auc", "ece_10")


def _metric_columns(df, *groups):
    return df.select(*groups, "n", "matches", *_r(*_METRICS))


@query("binary_metrics", f"WITH {V.SCORED}, src AS (SELECT * FROM scored), {_metrics_sql(None)}")
def binary_metrics(spark, sf):
    return _metric_columns(metrics.binary_metrics(V.scored(spark, sf), "y", "p", matches="match_id"))


@query("metrics_by_group", f"WITH {V.SCORED}, src AS (SELECT * FROM scored), {_metrics_sql('lang')} WHERE b.n >= 20")
def metrics_by_group(spark, sf):
    out = metrics.binary_metrics(V.scored(spark, sf), "y", "p", ["lang"], matches="match_id", min_rows=20)
    return _metric_columns(out, "lang")


ORDER_SCORES = """
src AS (
  SELECT l_orderkey AS match_id, CASE WHEN l_returnflag = 'R' THEN 1 ELSE 0 END AS y,
    CAST(l_discount * 10 AS DOUBLE) AS p, l_shipdate, rows / (groups * c) AS w
  FROM lineitem JOIN (SELECT l_orderkey, count(*) AS c FROM lineitem GROUP BY 1) USING (l_orderkey),
    (SELECT count(*) AS rows, count(DISTINCT l_orderkey) AS groups FROM lineitem)
)
"""


def line_scores(spark, sf):
    lines = V.table(spark, sf, "lineitem").select(
        F.col("l_orderkey").alias("match_id"),
        F.when(F.col("l_returnflag") == "R", 1).otherwise(0).alias("y"),
        (F.col("l_discount") * 10).alias("p"),
    )
    return frames.equal_weights(lines)


@query("weighted_live_metrics", f"WITH {ORDER_SCORES}, {_metrics_sql(None, weighted=True)}")
def weighted_live_metrics(spark, sf):
    out = metrics.binary_metrics(line_scores(spark, sf), "y", "p", weight="weight", matches="match_id")
    return _metric_columns(out)


@query(
    "ece",
    f"""WITH {V.SCORED}, b AS (SELECT lang, len(list_filter({_EDGES}, lambda e: e <= p)) AS bin,
  abs(sum(p) - sum(y)) AS gap, count(*) AS n FROM scored GROUP BY 1, 2)
SELECT lang, round(sum(gap) / sum(n), 6) AS ece_10 FROM b GROUP BY lang""",
)
def ece(spark, sf):
    return metrics.expected_calibration_error(V.scored(spark, sf), "y", "p", ["lang"]).select("lang", *_r("ece_10"))


def _auc_sql(value, group, source, digits=6):
    return f"""h AS (SELECT {group} AS g, {value} AS x, sum(CAST(y = 1 AS INT)) AS pos, sum(CAST(y <> 1 AS INT)) AS neg
  FROM {source} GROUP BY 1, 2),
r AS (SELECT *, coalesce(sum(neg) OVER (PARTITION BY g ORDER BY x ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS less FROM h),
auc AS (SELECT g, sum(pos + neg) AS n, sum(pos * (less + neg / 2)) / nullif(sum(pos) * sum(neg), 0) AS roc_auc FROM r GROUP BY g)"""


@query(
    "auc",
    f"""WITH prices AS (SELECT l_extendedprice, CAST(l_linestatus = 'F' AS INT) AS y, l_returnflag FROM lineitem),
{_auc_sql('l_extendedprice', 'l_returnflag', 'prices')}
SELECT g AS l_returnflag, round(roc_auc, 6) AS roc_auc FROM auc""",
)
def auc(spark, sf):
    prices = V.table(spark, sf, "lineitem").select(
        "l_extendedprice", (F.col("l_linestatus") == "F").cast("int").alias("y"), "l_returnflag"
    )
    return metrics.roc_auc(prices, "y", "l_extendedprice", ["l_returnflag"]).select("l_returnflag", *_r("roc_auc"))


@query(
    "orientation_free_auc",
    f"""WITH {V.SCORED}, {_auc_sql('n_chars', 'lang', 'scored')}
SELECT g AS lang, CASE WHEN n >= 10 THEN round(greatest(roc_auc, 1 - roc_auc), 6) END AS auc FROM auc""",
)
def orientation_free_auc(spark, sf):
    return metrics.orientation_free_auc(V.scored(spark, sf), "y", "n_chars", ["lang"]).select("lang", *_r("auc"))


@query(
    "top_groups",
    """SELECT l_suppkey AS g, n FROM (SELECT CAST(l_suppkey AS VARCHAR) AS l_suppkey, count(*) AS n FROM lineitem GROUP BY 1)
ORDER BY n DESC, l_suppkey LIMIT 15""",
)
def top_groups(spark, sf):
    counted = V.table(spark, sf, "lineitem").groupBy(F.col("l_suppkey").cast("string").alias("g")).agg(
        F.count(F.lit(1)).alias("n")
    )
    return metrics.top_groups(counted, 15)


_MODEL_ROWS = """
m AS (SELECT match_id, lang, y, unnest([{'model': 'a', 'p': p}, {'model': 'b', 'p': 0.5}, {'model': 'c', 'p': 1 - p}], recursive := true) FROM scored),
s AS (SELECT lang, model, avg((q - y) * (q - y)) AS brier_score, avg(-(y * ln(q) + (1 - y) * ln(1 - q))) AS log_loss
  FROM (SELECT *, least(greatest(p, 1e-9), 1 - 1e-9) AS q FROM m) GROUP BY lang, model)
"""


def model_metrics(spark, sf):
    scored = V.scored(spark, sf)
    models = F.array(
        *[F.struct(F.lit(n).alias("model"), c.alias("p")) for n, c in
          (("a", F.col("p")), ("b", F.lit(0.5)), ("c", 1 - F.col("p")))]
    )
    long = scored.select("match_id", "lang", "y", F.explode(models).alias("_m")).select(
        "match_id", "lang", "y", "_m.model", "_m.p"
    )
    return metrics.binary_metrics(long, "y", "p", ["lang", "model"])


@query("best_model", f"WITH {V.SCORED}, {_MODEL_ROWS} SELECT lang, arg_min(model, (brier_score, log_loss, model)) AS selected_model FROM s GROUP BY lang")
def best_model(spark, sf):
    return metrics.best_model(model_metrics(spark, sf), ["lang"])


@query(
    "fold_gate",
    f"""WITH {V.SCORED}, {_MODEL_ROWS}, d AS (SELECT lang, sum(CASE model WHEN 'a' THEN brier_score WHEN 'b' THEN -brier_score ELSE 0 END) AS delta FROM s GROUP BY lang)
SELECT count(*) FILTER (WHERE delta < 0) AS improved_folds, round(avg(delta), 6) AS mean_brier_delta,
  round(max(delta), 6) AS worst_brier_delta,
  (count(*) FILTER (WHERE delta < 0) >= 2 AND avg(delta) <= -0.001 AND max(delta) <= 0.003) AS passes_gate FROM d""",
)
def fold_gate(spark, sf):
    m = model_metrics(spark, sf)
    delta = F.sum(F.when(F.col("model") == "a", F.col("brier_score")).when(F.col("model") == "b", -F.col("brier_score")).otherwise(0))
    folds = m.groupBy("lang").agg(delta.alias("brier_delta"))
    return metrics.fold_gate(folds, []).withColumns(
        {c: F.round(c, 6) for c in ("mean_brier_delta", "worst_brier_delta")}
    )


@query(
    "acceptance",
    f"""WITH {V.SCORED}, {_MODEL_ROWS},
x AS (SELECT lang, model, p, y FROM m WHERE model IN ('b', 'c')),
h AS (SELECT lang, model, p, sum(y) AS pos, sum(1 - y) AS neg FROM x GROUP BY 1, 2, 3),
r AS (SELECT *, coalesce(sum(neg) OVER (PARTITION BY lang, model ORDER BY p ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS less FROM h),
a AS (SELECT lang, model, sum(pos * (less + neg / 2)) / nullif(sum(pos) * sum(neg), 0) AS roc_auc FROM r GROUP BY 1, 2),
j AS (SELECT lang, sum(CASE model WHEN 'c' THEN brier_score WHEN 'b' THEN -brier_score ELSE 0 END) AS bd,
  sum(CASE model WHEN 'c' THEN roc_auc ELSE -roc_auc END) AS ad FROM s JOIN a USING (lang, model) GROUP BY lang)
SELECT lang, round(bd, 6) AS brier_delta, round(ad, 6) AS auc_delta, (bd <= 0.003 AND ad >= -0.010) AS accepted FROM j""",
)
def acceptance(spark, sf):
    m = model_metrics(spark, sf).where("model <> 'a'").withColumn(
        "kind", F.when(F.col("model") == "c", "candidate").otherwise("baseline")
    )
    return metrics.acceptance(m, ["lang"]).withColumns(
        {c: F.round(c, 6) for c in ("brier_delta", "auc_delta")}
    )


# --- audits ------------------------------------------------------------------
AUDIT_START = "1997-01-01"
_AUDIT = f"""
lineup AS (
  SELECT match_id, side, count(batting_average) AS xb, avg(batting_average) AS xa,
    count(bowling_economy) AS xw, avg(bowling_economy) AS xe FROM state GROUP BY match_id, side
),
pre AS (
  SELECT r.*, l.xb, l.xa, l.xw, l.xe, (l.match_id IS NOT NULL) AS known
  FROM rated r LEFT JOIN lineup l USING (match_id, side)
  WHERE r.format = 'T20' AND r.date >= DATE '{AUDIT_START}'
)
"""


@query(
    "coverage_by_group",
    f"""WITH {V.CONTESTS}, {V.SPELLS}, {V.LINEUPS}, {H.PLAYER_CUM}, {H.CURRENT_PROBE}, {H.PLAYER_STATE}, {FEATURES}, {_AUDIT}
SELECT competition, count(DISTINCT match_id) AS matches, count(DISTINCT team) AS teams,
  median(matches_before) AS median_matches_before_per_side,
  round(avg(CAST(matches_before < 5 AS INT)), 6) AS pct_side_rows_lt_5_prior_matches,
  round(avg(CAST(matches_before < 10 AS INT)), 6) AS pct_side_rows_lt_10_prior_matches,
  round(avg(CAST(matches_before < 20 AS INT)), 6) AS pct_side_rows_lt_20_prior_matches,
  round(avg(CAST(h2h_matches_before = 0 AS INT)), 6) AS pct_side_rows_no_h2h,
  median(h2h_matches_before) AS median_h2h_matches_before,
  round(avg(CAST(team_matches_at_venue = 0 AS INT)), 6) AS pct_side_rows_no_team_venue_history,
  median(team_matches_at_venue) AS median_team_matches_at_venue,
  CAST(0 AS DOUBLE) AS pct_home_away_present, count(DISTINCT match_id) AS posttoss_matches_available,
  round(avg(CAST(known AS INT)), 6) AS pct_posttoss_side_rows_lineup_known,
  median(xb) AS median_xi_batters_with_history, median(xw) AS median_xi_bowlers_with_history,
  round(avg(CAST(xa IS NULL AS INT)), 6) AS pct_xi_batting_average_missing,
  round(avg(CAST(xe IS NULL AS INT)), 6) AS pct_xi_bowling_economy_missing
FROM pre GROUP BY competition HAVING count(DISTINCT match_id) >= 10""",
)
def coverage_by_group(spark, sf):
    out = audit.competition_coverage(features(spark, sf, lineups=True), AUDIT_START, 10)
    shares = [c for c in out.columns if c.startswith("pct_")]
    return out.withColumns({c: F.round(c, 6) for c in shares})


@query(
    "cold_start",
    f"""WITH {V.CONTESTS}, {FEATURES},
pre AS (SELECT * FROM rated WHERE format = 'T20' AND date >= DATE '{AUDIT_START}'),
names AS (SELECT team, string_agg(competition, ', ' ORDER BY competition) AS competitions FROM (SELECT DISTINCT team, competition FROM pre) GROUP BY team)
SELECT team, competitions, count(DISTINCT match_id) AS matches, median(matches_before) AS median_prior_matches,
  min(matches_before) AS min_prior_matches,
  round(avg(CAST(matches_before < 10 AS INT)), 6) AS pct_rows_lt_10_prior,
  round(avg(CAST(h2h_matches_before = 0 AS INT)), 6) AS pct_rows_no_h2h,
  round(avg(CAST(team_matches_at_venue = 0 AS INT)), 6) AS pct_rows_no_venue_history
FROM pre JOIN names USING (team) GROUP BY team, competitions HAVING count(DISTINCT match_id) >= 5""",
)
def cold_start(spark, sf):
    out = audit.team_cold_start(staged(features(spark, sf)), AUDIT_START, 5)
    shares = [c for c in out.columns if c.startswith("pct_")]
    return out.withColumns({c: F.round(c, 6) for c in shares})


@query(
    "audit_report",
    f"""WITH {V.CONTESTS}, {FEATURES},
pre AS (SELECT * FROM rated WHERE format = 'T20' AND date >= DATE '{AUDIT_START}'),
c AS (SELECT count(DISTINCT match_id) AS n FROM pre GROUP BY competition HAVING count(DISTINCT match_id) >= 10),
t AS (SELECT team, count(DISTINCT match_id) AS n, median(matches_before) AS m FROM pre GROUP BY team HAVING count(DISTINCT match_id) >= 5)
SELECT (SELECT count(*) * 2 FROM rated WHERE format = 'T20') AS rows, (SELECT count(DISTINCT match_id) FROM pre) AS test_matches,
  (SELECT count(*) FROM c) AS competition_rows, (SELECT count(*) FROM t) AS teams_audited,
  CAST(0 AS DOUBLE) AS home_away_non_null_pct, CAST((SELECT sum(n) FROM c) AS BIGINT) AS covered_matches,
  round((SELECT sum(m) FROM t), 6) AS team_medians, {len(DIFFS)}::BIGINT AS signals""",
)
def audit_report(spark, sf):
    """The whole audit with its files; the last columns come from what was written."""
    folder = f"{ensure_checkpoint_dir(spark)}/audit-{uuid.uuid4().hex}"
    summary = audit_plan.audit_features(
        features(spark, sf, lineups=True), folder, start=AUDIT_START, valid=("1999-01-01", "1999-12-31"),
        sources=SOURCES, candidates=("home_away", "season"), min_matches=10,
    )

    def stored(name):
        return spark.read.option("header", True).csv(f"{folder}/{name}")

    covered = stored("competition_coverage").agg(F.sum(F.col("matches").cast("long")).alias("covered_matches"))
    medians = stored("team_cold_start").agg(F.round(F.sum(F.col("median_prior_matches").cast("double")), 6).alias("team_medians"))
    signals = stored("posttoss_feature_signal").agg(F.count(F.lit(1)).alias("signals"))
    counts = summary.select("rows", "test_matches", "competition_rows", "teams_audited", "home_away_non_null_pct")
    return counts.crossJoin(covered).crossJoin(medians).crossJoin(signals)  # one row each


@query(
    "availability",
    """SELECT 'user_id' AS feature, true AS present_in_dataset, 1.0::DOUBLE AS non_null_pct, count(DISTINCT user_id) AS unique_values FROM events
UNION ALL SELECT 'event_type', true, 1.0, count(DISTINCT event_type) FROM events
UNION ALL SELECT 'high', true, round(avg(CAST(value > 50 AS INT)), 6), count(DISTINCT value) FILTER (WHERE value > 50) FROM events
UNION ALL SELECT 'season', false, 0.0, 0""",
)
def availability(spark, sf):
    events = V.table(spark, sf, "events").select(
        "user_id", "event_type", F.when(F.col("value") > 50, F.col("value")).alias("high")
    )
    out = audit.availability(events, ["user_id", "event_type", "high", "season"])
    return out.withColumn("non_null_pct", F.round("non_null_pct", 6))


def _signal_sql() -> str:
    parts = " UNION ALL ".join(
        f"SELECT '{d}' AS feature, {d} AS x, team_a_win AS y, split FROM p" for d in DIFFS
    )
    return f"""WITH {V.CONTESTS}, {FEATURES},
p AS (SELECT *, CASE WHEN date BETWEEN DATE '1999-01-01' AND DATE '1999-12-31' THEN 'valid' WHEN date >= DATE '2000-01-01' THEN 'test' END AS split FROM sides),
long AS ({parts}),
usable AS (SELECT (feature, split) AS k, * FROM long WHERE split IS NOT NULL AND x IS NOT NULL),
{_auc_sql('x', 'k', 'usable')},
best AS (SELECT g, CASE WHEN n >= 10 THEN greatest(roc_auc, 1 - roc_auc) END AS a FROM auc),
miss AS (SELECT feature, split, avg(CAST(x IS NULL AS INT)) AS m FROM long WHERE split IS NOT NULL GROUP BY 1, 2),
w AS (SELECT feature, max(a) FILTER (WHERE split = 'valid') AS v, max(a) FILTER (WHERE split = 'test') AS t,
  max(m) FILTER (WHERE split = 'valid') AS mv, max(m) FILTER (WHERE split = 'test') AS mt
  FROM miss LEFT JOIN best ON g = (feature, split) GROUP BY feature)
SELECT feature, round(v, 6) AS validation_auc_orientation_free, round(t, 6) AS test_auc_orientation_free,
  round(mv, 6) AS validation_missing_pct, round(mt, 6) AS test_missing_pct,
  round(t - v, 6) AS auc_change_test_minus_validation FROM w"""


@query("feature_signal", _signal_sql())
def feature_signal(spark, sf):
    out = audit.feature_signal(staged(pairs(spark, sf)), DIFFS, ("1999-01-01", "1999-12-31"), "2000-01-01")
    return out.withColumns({c: F.round(c, 6) for c in out.columns if c != "feature"})


@query(
    "yearly_coverage",
    f"""WITH {V.CONTESTS}, {FEATURES} SELECT count(*) AS matches,
  round(avg(CAST(win_rate_before_diff IS NOT NULL AS INT)), 6) AS win_rate_before_diff_available_pct
FROM sides WHERE date BETWEEN DATE '1996-01-01' AND DATE '1996-12-31'""",
)
def yearly_coverage(spark, sf):
    out = audit.yearly_coverage(pairs(spark, sf), ["win_rate_before_diff"], "1996-01-01", "1996-12-31")
    return out.withColumn("win_rate_before_diff_available_pct", F.round("win_rate_before_diff_available_pct", 6))


# --- quality -----------------------------------------------------------------
@query(
    "quality_live",
    """
WITH s AS (
  SELECT l_orderkey AS match_id, l_linenumber AS innings, l_quantity - 37 AS wickets, 47 - l_quantity AS hand,
    CASE WHEN l_tax > 0.07 THEN -1 ELSE 5 END AS remaining, l_extendedprice - 1500 AS runs,
    CASE WHEN l_returnflag = 'R' THEN l_discount * 100 END AS target
  FROM lineitem
),
t AS (
  SELECT 'wickets_gt_10' AS "check", count(*) FILTER (WHERE wickets > 10) AS n FROM s
  UNION ALL SELECT 'negative_wickets_in_hand', count(*) FILTER (WHERE hand < 0) FROM s
  UNION ALL SELECT 'negative_balls_remaining', count(*) FILTER (WHERE remaining < 0) FROM s
  UNION ALL SELECT 'negative_runs', count(*) FILTER (WHERE runs < 0) FROM s
  UNION ALL SELECT 'invalid_targets', count(*) FILTER (WHERE target <= 0) FROM s
  UNION ALL SELECT 'first_innings_has_target', count(*) FILTER (WHERE innings = 1 AND target IS NOT NULL) FROM s
)
SELECT 'live' AS "table", "check", n AS count,
  CASE WHEN "check" = 'wickets_gt_10' THEN (SELECT string_agg(id, ',' ORDER BY pl, id) FROM (
    SELECT CAST(match_id AS VARCHAR) AS id, match_id || '|' || innings AS pl FROM s WHERE wickets > 10 ORDER BY pl, id LIMIT 5)) ELSE '' END AS examples
FROM t WHERE n > 0
""",
)
def quality_live(spark, sf):
    c = F.col
    states = V.table(spark, sf, "lineitem").select(
        c("l_orderkey").alias("match_id"), c("l_linenumber").alias("innings_number"),
        (c("l_quantity") - 37).alias("wickets"), (47 - c("l_quantity")).alias("wickets_in_hand"),
        F.when(c("l_tax") > 0.07, -1).otherwise(5).alias("balls_remaining"),
        (c("l_extendedprice") - 1500).alias("runs"),
        F.when(c("l_returnflag") == "R", c("l_discount") * 100).alias("target"),
    )
    return quality.check_live(states).withColumn("examples", F.concat_ws(",", "examples"))


@query(
    "quality_prematch",
    """
WITH f AS (
  SELECT l_orderkey AS match_id, CAST(l_suppkey AS VARCHAR) AS team, CASE WHEN l_tax > 0.04 THEN 'POST_TOSS' ELSE 'PRE_TOSS' END AS mode,
    CASE WHEN l_returnflag = 'N' THEN 'XX' ELSE 'T20' END AS format, CAST(l_discount * 100 AS INT) AS team_win
  FROM lineitem
),
t AS (
  SELECT 'duplicate_prediction_rows' AS "check", sum(n - 1) AS n FROM (SELECT count(*) AS n FROM f GROUP BY match_id, team, mode)
  UNION ALL SELECT 'unknown_formats', count(*) FROM f WHERE format = 'XX'
  UNION ALL SELECT 'invalid_team_win', count(*) FROM f WHERE team_win NOT IN (0, 1)
  UNION ALL SELECT 'inconsistent_winners_' || mode, count(*) FROM (SELECT mode, match_id FROM f GROUP BY 1, 2 HAVING sum(team_win) <> 1) GROUP BY mode
)
SELECT 'prematch' AS "table", "check", CAST(n AS BIGINT) AS count FROM t WHERE n > 0
""",
)
def quality_prematch(spark, sf):
    c = F.col
    rows = V.table(spark, sf, "lineitem").select(
        c("l_orderkey").alias("match_id"), c("l_suppkey").cast("string").alias("team"),
        c("l_shipdate").cast("date").alias("date"),
        F.when(c("l_tax") > 0.04, "POST_TOSS").otherwise("PRE_TOSS").alias("prediction_mode"),
        F.when(c("l_returnflag") == "N", "XX").otherwise("T20").alias("format"),
        F.round(c("l_discount") * 100).cast("int").alias("team_win"),
    )
    return quality.check_prematch(rows).select("table", "check", "count")


# --- resolution --------------------------------------------------------------
FIELDS = ("status", "total", "segment", "shipped")
_SNAPSHOTS = """
snaps AS (
  SELECT o_orderkey AS entity, 'orders' AS source, 'live' AS kind, 1 AS priority,
    CASE WHEN o_orderkey % 4 = 0 THEN ' ' ELSE o_orderstatus END AS status,
    CASE WHEN o_orderkey % 3 > 0 THEN CAST(CAST(floor(o_totalprice) AS BIGINT) AS VARCHAR) END AS total,
    NULL AS segment, NULL AS shipped FROM orders
  UNION ALL
  SELECT l_orderkey, 'lines', 'live', 2, max(l_linestatus), CAST(CAST(sum(l_quantity) AS BIGINT) AS VARCHAR), NULL,
    CAST(CAST(min(l_shipdate) AS DATE) AS VARCHAR) FROM lineitem GROUP BY l_orderkey
  UNION ALL
  SELECT o_orderkey, 'customers', 'search', 3, 'F', NULL, c_mktsegment, NULL FROM orders JOIN customer ON o_custkey = c_custkey
),
fields AS (
  SELECT entity, source, kind, priority, unnest(['status', 'total', 'segment', 'shipped']) AS field,
    unnest([status, total, segment, shipped]) AS value FROM snaps
),
known AS (SELECT * FROM fields WHERE value IS NOT NULL AND trim(value) <> ''),
chosen AS (SELECT entity, field, arg_min(value, priority) AS value, arg_min(source, priority) AS source, min(priority) AS priority
  FROM known GROUP BY entity, field)
"""


def snapshots(spark, sf):
    c = F.col
    none = F.lit(None).cast("string")
    when = F.lit("2024-01-01").cast("timestamp_ntz").alias("ts")
    orders = V.table(spark, sf, "orders")
    lines = V.table(spark, sf, "lineitem").groupBy(c("l_orderkey").alias("entity")).agg(
        F.max("l_linestatus").alias("status"),
        F.sum("l_quantity").cast("long").cast("string").alias("total"),
        F.min("l_shipdate").cast("date").cast("string").alias("shipped"),
    )
    customer = V.table(spark, sf, "customer").select(c("c_custkey").alias("o_custkey"), c("c_mktsegment").alias("segment"))
    first = orders.select(
        c("o_orderkey").alias("entity"), F.lit("orders").alias("source"), F.lit("live").alias("kind"),
        F.lit(1).alias("priority"), when,
        F.when(c("o_orderkey") % 4 == 0, " ").otherwise(c("o_orderstatus")).alias("status"),
        F.when(c("o_orderkey") % 3 > 0, F.floor("o_totalprice").cast("string")).alias("total"),
        none.alias("segment"), none.alias("shipped"),
    )
    second = lines.select(
        "entity", F.lit("lines").alias("source"), F.lit("live").alias("kind"), F.lit(2).alias("priority"),
        when, "status", "total", none.alias("segment"), "shipped",
    )
    third = orders.join(customer, "o_custkey").select(
        c("o_orderkey").alias("entity"), F.lit("customers").alias("source"), F.lit("search").alias("kind"),
        F.lit(3).alias("priority"), when, F.lit("F").alias("status"), none.alias("total"), "segment",
        none.alias("shipped"),
    )
    return first.unionByName(second).unionByName(third)


@query(
    "resolve_fields",
    f"""WITH {_SNAPSHOTS}
SELECT entity, field, value, source, CASE source WHEN 'customers' THEN 'low' ELSE 'high' END AS reliability FROM chosen""",
)
def resolve_fields(spark, sf):
    long = resolve.long_fields(snapshots(spark, sf), FIELDS)
    return resolve.resolve(long).select("entity", "field", "value", "source", "reliability")


@query(
    "resolve_conflicts",
    f"""WITH {_SNAPSHOTS}
SELECT k.entity, k.field, c.value AS chosen_value, c.source AS chosen_source, k.value AS rejected_value, k.source AS rejected_source
FROM known k JOIN chosen c USING (entity, field) WHERE k.value <> c.value""",
)
def resolve_conflicts(spark, sf):
    long = resolve.long_fields(snapshots(spark, sf), FIELDS)
    return resolve.conflicts(long).drop("rejected_reliability", "rejected_ts")


@query(
    "resolve_rebuilt",
    f"""WITH {_SNAPSHOTS}
SELECT entity, max(value) FILTER (WHERE field = 'status') AS status, max(value) FILTER (WHERE field = 'total') AS total,
  max(value) FILTER (WHERE field = 'segment') AS segment, max(value) FILTER (WHERE field = 'shipped') AS shipped,
  arg_min(source, priority) AS primary_source FROM chosen GROUP BY entity""",
)
def resolve_rebuilt(spark, sf):
    long = resolve.long_fields(snapshots(spark, sf), FIELDS)
    return resolve.rebuild(resolve.resolve(long), FIELDS)


@query(
    "sources_tried",
    f"WITH {_SNAPSHOTS} SELECT entity, string_agg(source, ',' ORDER BY priority) AS sources_tried FROM snaps GROUP BY entity",
)
def sources_tried(spark, sf):
    return resolve.sources_tried(snapshots(spark, sf)).withColumn("sources_tried", F.concat_ws(",", "sources_tried"))


_TYPED = """
lines AS (SELECT l_orderkey AS k, [min(l_linestatus), max(l_linestatus)] AS tags, count(*) AS note FROM lineitem GROUP BY l_orderkey),
cells AS (
  SELECT o_orderkey AS entity, 'orders' AS source, 1 AS priority, 'tags' AS field,
    CASE WHEN o_orderkey % 2 = 1 THEN CAST(to_json([o_orderstatus]) AS VARCHAR) END AS value FROM orders
  UNION ALL SELECT o_orderkey, 'orders', 1, 'note', CASE WHEN o_orderkey % 5 = 0 THEN '"[]"'
    WHEN o_orderkey % 3 > 0 THEN CAST(to_json(o_orderpriority) AS VARCHAR) END FROM orders
  UNION ALL SELECT k, 'lines', 2, 'tags', CAST(to_json(tags) AS VARCHAR) FROM lines
  UNION ALL SELECT k, 'lines', 2, 'note', CAST(note AS VARCHAR) FROM lines
),
chosen AS (SELECT entity, field, arg_min(value, priority) AS value, arg_min(source, priority) AS source FROM cells
  WHERE value IS NOT NULL GROUP BY entity, field)
"""


def typed_fields(spark, sf):
    c = F.col
    when = F.lit("2024-01-01").cast("timestamp_ntz").alias("ts")
    one = V.table(spark, sf, "orders").select(
        c("o_orderkey").alias("entity"), F.lit("orders").alias("source"), F.lit("live").alias("kind"),
        F.lit(1).alias("priority"), when,
        F.when(c("o_orderkey") % 2 == 1, F.array("o_orderstatus")).otherwise(F.array().cast("array<string>")).alias("tags"),
        F.when(c("o_orderkey") % 5 == 0, "[]").when(c("o_orderkey") % 3 == 0, " ").otherwise(c("o_orderpriority")).alias("note"),
    )
    two = V.table(spark, sf, "lineitem").groupBy(c("l_orderkey").alias("entity")).agg(
        F.array(F.min("l_linestatus"), F.max("l_linestatus")).alias("tags"), F.count(F.lit(1)).alias("note")
    ).select("entity", F.lit("lines").alias("source"), F.lit("search").alias("kind"), F.lit(2).alias("priority"), when, "tags", "note")
    # One field in two types: text from orders, a number from lines.
    names = ("tags", "note")
    return resolve.long_fields(one, names, typed=True).unionByName(resolve.long_fields(two, names, typed=True))


@query("resolve_typed", f"WITH {_TYPED} SELECT entity, field, value AS json, source FROM chosen")
def resolve_typed(spark, sf):
    chosen = resolve.resolve(typed_fields(spark, sf))
    return chosen.select("entity", "field", F.to_json("value").alias("json"), "source")


@query(
    "resolve_typed_conflicts",
    f"""WITH {_TYPED} SELECT entity, field, c.value AS chosen, k.value AS rejected, k.source AS rejected_source
FROM cells k JOIN chosen c USING (entity, field) WHERE k.value <> c.value""",
)
def resolve_typed_conflicts(spark, sf):
    return resolve.conflicts(typed_fields(spark, sf)).select(
        "entity", "field", F.to_json("chosen_value").alias("chosen"), F.to_json("rejected_value").alias("rejected"), "rejected_source"
    )

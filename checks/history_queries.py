"""Team and participant history over whole tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from checks import views as V
from tallyline.operators import contests as C
from tallyline.operators import participants as P
from tallyline.operators.elo import contest_scores, elo_after, elo_before
from tallyline.plans.features import HISTORY, prematch_features, team_history

QUERIES, SQL = {}, {}


def query(name, sql=None):
    def register(fn):
        QUERIES[name] = fn
        if sql is not None:
            SQL[name] = sql
        return fn

    return register


def _r(*names):
    return [F.round(n, 6).alias(n) for n in names]


FORM_COLUMNS = [
    "match_id", "team", "matches_before", "wins_before",
    *[f"{k}_last_{n}" for n in C.FORM_WINDOWS for k in ("matches", "wins")],
]
FORM_RATES = ["win_rate_before", *[f"win_rate_last_{n}" for n in C.FORM_WINDOWS]]


def _form(spark, sf, max_rows=None, as_of="sequence"):
    log = C.team_rows(C.prepare(V.contests(spark, sf), as_of))
    return C.team_form(log, max_rows).where("asks").select(*FORM_COLUMNS, *_r(*FORM_RATES))


def _form_sql(n: int) -> str:
    return f"""
  least(matches_before, {n}) AS matches_last_{n}, coalesce(w{n}, 0) AS wins_last_{n},
  round(coalesce(w{n}, 0) / nullif(least(matches_before, {n}), 0), 6) AS win_rate_last_{n}"""


# A row's last-n counting rows are those whose rank lies in its last n ranks.
FORM_SQL = f"""
WITH {V.CONTESTS},
ranked AS (
  SELECT *, coalesce(sum(CAST(played AS INT)) OVER w, 0) AS matches_before,
    coalesce(sum(CASE WHEN played THEN won ELSE 0 END) OVER w, 0) AS wins_before
  FROM flagged
  WINDOW w AS (PARTITION BY format, gender, team ORDER BY date, match_id
               ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)
),
wins AS (
  SELECT format, gender, team, matches_before + 1 AS idx,
    sum(won) OVER (PARTITION BY format, gender, team ORDER BY date, match_id) AS cum
  FROM ranked WHERE played
),
form AS (
  SELECT r.match_id, r.team, r.date, r.format, r.gender, r.matches_before, r.wins_before,
    r.wins_before - coalesce(w5.cum, 0) AS w5, r.wins_before - coalesce(w10.cum, 0) AS w10,
    r.wins_before - coalesce(w20.cum, 0) AS w20
  FROM ranked r
  LEFT JOIN wins w5 ON (w5.format, w5.gender, w5.team, w5.idx) = (r.format, r.gender, r.team, r.matches_before - 5)
  LEFT JOIN wins w10 ON (w10.format, w10.gender, w10.team, w10.idx) = (r.format, r.gender, r.team, r.matches_before - 10)
  LEFT JOIN wins w20 ON (w20.format, w20.gender, w20.team, w20.idx) = (r.format, r.gender, r.team, r.matches_before - 20)
)
SELECT match_id, team, matches_before, wins_before,
  round(wins_before / nullif(matches_before, 0), 6) AS win_rate_before,{_form_sql(5)},{_form_sql(10)},{_form_sql(20)}
FROM form
"""

query("team_form", FORM_SQL)(_form)
# The same query with every busy team forced through the split-key path.
query("team_form_split_keys", FORM_SQL)(lambda spark, sf: _form(spark, sf, max_rows=400))


H2H_SQL = f"""
WITH {V.CONTESTS},
decided AS (
  SELECT *, coalesce(sum(CAST(decisive AS INT)) OVER w, 0) AS n,
    coalesce(sum(CASE WHEN decisive THEN won ELSE 0 END) OVER w, 0) AS wins
  FROM flagged
  WINDOW w AS (PARTITION BY format, gender, team, opponent ORDER BY date, match_id
               ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)
),
cum AS (
  SELECT format, gender, team, opponent, n + 1 AS idx, wins + won AS cum FROM decided WHERE decisive
)
SELECT d.match_id, d.team, n AS h2h_matches_before, wins AS h2h_team_wins, n - wins AS h2h_opponent_wins,
  round(wins / nullif(n, 0), 6) AS h2h_team_win_rate, least(n, 5) AS h2h_last_5_matches,
  round((wins - coalesce(c.cum, 0)) / nullif(least(n, 5), 0), 6) AS h2h_last_5_win_rate
FROM decided d LEFT JOIN cum c
  ON (c.format, c.gender, c.team, c.opponent, c.idx) = (d.format, d.gender, d.team, d.opponent, d.n - 5)
"""


@query("head_to_head", H2H_SQL)
def head_to_head(spark, sf):
    log = C.team_rows(C.prepare(V.contests(spark, sf)))
    return C.head_to_head(log).select(
        "match_id", "team", "h2h_matches_before", "h2h_team_wins", "h2h_opponent_wins",
        "h2h_last_5_matches", *_r("h2h_team_win_rate", "h2h_last_5_win_rate"),
    )


VENUE_SQL = f"""
WITH {V.CONTESTS},
at_venue AS (
  SELECT match_id, team, opponent, side,
    coalesce(sum(CAST(decisive AS INT)) OVER w, 0) AS n,
    coalesce(sum(CASE WHEN decisive THEN won ELSE 0 END) OVER w, 0) AS wins
  FROM flagged
  WINDOW w AS (PARTITION BY format, gender, venue, team ORDER BY date, match_id
               ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)
)
SELECT s.match_id, s.team, s.n AS team_matches_at_venue, s.wins AS team_wins_at_venue,
  round(s.wins / nullif(s.n, 0), 6) AS team_win_rate_at_venue,
  o.n AS opponent_matches_at_venue, o.wins AS opponent_wins_at_venue,
  round(o.wins / nullif(o.n, 0), 6) AS opponent_win_rate_at_venue
FROM at_venue s JOIN at_venue o ON s.match_id = o.match_id AND s.side <> o.side
"""


@query("team_at_venue", VENUE_SQL)
def team_at_venue(spark, sf):
    rows = C.team_at_venue(C.team_rows(C.prepare(V.contests(spark, sf))))
    return C.opponent_at_venue(rows).select(
        "match_id", "team", "team_matches_at_venue", "team_wins_at_venue",
        "opponent_matches_at_venue", "opponent_wins_at_venue",
        *_r("team_win_rate_at_venue", "opponent_win_rate_at_venue"),
    )


VENUE_RECORD_SQL = f"""
WITH {V.CONTESTS},
c AS (
  SELECT *, CAST(winner IS NOT NULL AS INT) AS decided,
    coalesce(CAST(winner = batting_first AS INT), 0) AS first_won,
    coalesce(CAST(winner <> batting_first AS INT), 0) AS chase_won
  FROM contests
),
r AS (
  SELECT match_id, coalesce(sum(decided) OVER w, 0) AS n, coalesce(sum(first_won) OVER w, 0) AS f,
    coalesce(sum(chase_won) OVER w, 0) AS ch, coalesce(sum(first_total) OVER w, 0) AS total,
    count(first_total) OVER w AS totals
  FROM c WINDOW w AS (PARTITION BY format, gender, venue ORDER BY date, match_id
                      ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)
)
SELECT match_id, round(f / nullif(n, 0), 6) AS venue_batting_first_win_rate,
  round(ch / nullif(n, 0), 6) AS venue_chasing_win_rate, n AS venue_decided_matches,
  round(total / nullif(totals, 0), 6) AS historical_first_innings_average,
  totals AS historical_first_innings_matches
FROM r
"""


def _venue_record(spark, sf, max_rows=None):
    return C.venue_record(C.prepare(V.contests(spark, sf)), max_rows).select(
        "match_id", "venue_decided_matches", "historical_first_innings_matches",
        *_r("venue_batting_first_win_rate", "venue_chasing_win_rate",
            "historical_first_innings_average"),
    )


query("venue_record", VENUE_RECORD_SQL)(_venue_record)
query("venue_record_split_keys", VENUE_RECORD_SQL)(lambda spark, sf: _venue_record(spark, sf, 300))


# Step k plays the k-th contest of every pool; a pool's ratings travel as one list.
def _elo_sql(tail: str, tie: str = "match_id") -> str:
    return f"""
WITH RECURSIVE {V.CONTESTS},
steps AS MATERIALIZED (
  SELECT match_id, format, gender, h.n_nationkey + 1 AS i, a.n_nationkey + 1 AS j,
    CASE WHEN winner = team1 THEN 1.0 WHEN winner = team2 THEN 0.0 WHEN result_type = 'draw' THEN 0.5 END
      AS score,
    row_number() OVER (PARTITION BY format, gender ORDER BY date, {tie}) AS k
  FROM contests JOIN nation h ON h.n_name = team1 JOIN nation a ON a.n_name = team2
),
fold AS (
  SELECT format, gender, CAST(0 AS BIGINT) AS k, CAST(NULL AS BIGINT) AS match_id,
    CAST(NULL AS DOUBLE) AS elo1, CAST(NULL AS DOUBLE) AS elo2,
    list_transform(range(26), lambda x: CAST(1500 AS DOUBLE)) AS ratings
  FROM (SELECT DISTINCT format, gender FROM steps)
  UNION ALL
  SELECT f.format, f.gender, s.k, s.match_id, f.ratings[s.i], f.ratings[s.j],
    CASE WHEN s.score IS NULL THEN f.ratings ELSE
      list_transform(f.ratings, lambda r, p: CASE
        WHEN p = s.i THEN r + 20 * (s.score - 1 / (1 + pow(10, (f.ratings[s.j] - f.ratings[s.i]) / 400)))
        WHEN p = s.j THEN r - 20 * (s.score - 1 / (1 + pow(10, (f.ratings[s.j] - f.ratings[s.i]) / 400)))
        ELSE r END) END
  FROM fold f JOIN steps s ON s.format = f.format AND s.gender = f.gender AND s.k = f.k + 1
)
{tail}
"""


ELO_SQL = _elo_sql("SELECT match_id, round(elo1, 6) AS elo1, round(elo2, 6) AS elo2 FROM fold WHERE k > 0")


def _elo(spark, sf, max_rows=None):
    scores = contest_scores(C.prepare(V.contests(spark, sf)))
    return elo_before(scores, max_rows=max_rows).select("match_id", *_r("elo1", "elo2"))


query("elo_before", ELO_SQL)(_elo)
query("elo_before_time_slices", ELO_SQL)(lambda spark, sf: _elo(spark, sf, max_rows=700))


@query(
    "elo_after",
    _elo_sql("""
, last AS (
  SELECT format, gender, ratings FROM fold
  QUALIFY row_number() OVER (PARTITION BY format, gender ORDER BY k DESC) = 1
),
seen AS (SELECT DISTINCT format, gender, team FROM flagged WHERE played)
SELECT s.format, s.gender AS sex, s.team, round(l.ratings[n.n_nationkey + 1], 6) AS rating
FROM seen s JOIN last l USING (format, gender) JOIN nation n ON n.n_name = s.team
"""),
)
def ratings_after(spark, sf):
    scores = contest_scores(C.prepare(V.contests(spark, sf)))
    return elo_after(scores).select("format", "sex", "team", *_r("rating"))


# --- state before a date: same-day contests stay hidden ----------------------
DATE_FORM = """
cum AS (
  SELECT format, gender, team, date, sum(1) OVER w AS n, sum(won) OVER w AS wins,
    sum(won) OVER (w ROWS 4 PRECEDING) AS w5, match_id
  FROM flagged WHERE played WINDOW w AS (PARTITION BY format, gender, team ORDER BY date, match_id)
),
daily AS (
  SELECT * FROM cum
  QUALIFY row_number() OVER (PARTITION BY format, gender, team, date ORDER BY match_id DESC) = 1
)
"""


def _date_sql(source: str) -> str:
    return f"""
WITH {V.CONTESTS}, {V.REQUESTS}, {DATE_FORM},
asked AS ({source})
SELECT a.match_id, a.team, coalesce(d.n, 0) AS matches_before, coalesce(d.wins, 0) AS wins_before,
  coalesce(d.w5, 0) AS wins_last_5, round(d.w5 / nullif(least(d.n, 5), 0), 6) AS win_rate_last_5
FROM asked a ASOF LEFT JOIN daily d
  ON a.format = d.format AND a.gender = d.gender AND a.team = d.team AND a.date > d.date
"""


def _date_columns(df):
    return df.select("match_id", "team", "matches_before", "wins_before", "wins_last_5", *_r("win_rate_last_5"))


@query("team_form_before_day", _date_sql("SELECT match_id, format, gender, date, team FROM flagged"))
def team_form_before_day(spark, sf):
    log = C.team_rows(C.prepare(V.contests(spark, sf), as_of="date"))
    return _date_columns(C.team_form(log).where("asks"))


def contests_and_requests(spark, sf):
    return V.contests(spark, sf).unionByName(V.requests(spark, sf), allowMissingColumns=True)


@query(
    "snapshot_for_requests",
    _date_sql("""SELECT match_id, format, gender, date, team1 AS team FROM requests
      UNION ALL SELECT match_id, format, gender, date, team2 FROM requests"""),
)
def snapshot_for_requests(spark, sf):
    log = C.team_rows(C.prepare(contests_and_requests(spark, sf)))
    return _date_columns(C.team_form(log).where("asked"))


# --- participants -----------------------------------------------------------
_ORD = "date_diff('day', DATE '1970-01-01', date) * 1000000000 + match_id"

PLAYER_CUM = f"""
bat AS (
  SELECT c.format, s.player, {_ORD.replace('match_id', 'c.match_id')} AS ord, s.quantity AS runs,
    s.numbers AS balls, CAST(s.returned > 0 AS INT) AS outs
  FROM spells s JOIN contests c USING (match_id)
),
batcum AS (
  SELECT format, player, ord, count(*) OVER w AS bat_innings, sum(runs) OVER w AS bat_runs,
    sum(balls) OVER w AS bat_balls, sum(outs) OVER w AS bat_outs,
    sum(runs) OVER (w ROWS 4 PRECEDING) AS r5, sum(balls) OVER (w ROWS 4 PRECEDING) AS b5
  FROM bat WINDOW w AS (PARTITION BY format, player ORDER BY ord)
),
bowl AS (
  SELECT c.format, s.player, {_ORD.replace('match_id', 'c.match_id')} AS ord, s.quantity AS runs,
    s.n * 6 AS balls, s.finished AS wickets
  FROM spells s JOIN contests c USING (match_id) WHERE s.finished > 0
),
bowlcum AS (
  SELECT format, player, ord, sum(balls) OVER w AS bowl_balls, sum(runs) OVER w AS bowl_runs,
    sum(wickets) OVER w AS bowl_wickets, sum(runs) OVER (w ROWS 4 PRECEDING) AS r5,
    sum(balls) OVER (w ROWS 4 PRECEDING) AS b5, sum(wickets) OVER (w ROWS 4 PRECEDING) AS w5
  FROM bowl WINDOW w AS (PARTITION BY format, player ORDER BY ord)
)
"""

# ``probe`` (match_id, side, role, pos, format, player, ord) has to precede this.
PLAYER_STATE = """
state AS (
  SELECT p.match_id, p.side, p.role, p.pos, p.format, p.player,
    coalesce(b.bat_innings, 0) AS bat_innings, coalesce(b.bat_runs, 0) AS bat_runs,
    b.bat_runs / nullif(b.bat_outs, 0) AS batting_average, b.r5 AS recent_runs,
    100.0 * b.r5 / nullif(b.b5, 0) AS recent_strike_rate,
    coalesce(w.bowl_balls, 0) AS bowl_balls, coalesce(w.bowl_wickets, 0) AS bowl_wickets,
    6.0 * w.bowl_runs / nullif(w.bowl_balls, 0) AS bowling_economy, w.w5 AS recent_wickets,
    6.0 * w.r5 / nullif(w.b5, 0) AS recent_economy
  FROM probe p
  ASOF LEFT JOIN batcum b ON p.format = b.format AND p.player = b.player AND p.ord > b.ord
  ASOF LEFT JOIN bowlcum w ON p.format = w.format AND p.player = w.player AND p.ord > w.ord
)
"""

CURRENT_PROBE = f"""
probe AS (
  SELECT m.match_id, m.side, 0 AS role, m.l_suppkey AS pos, c.format, m.player,
    {_ORD.replace('match_id', 'c.match_id')} AS ord
  FROM members m JOIN contests c USING (match_id)
)
"""


def _current_state(spark, sf, max_rows=None):
    prepared = C.prepare(V.contests_with_lineups(spark, sf))
    rows = C.team_rows(prepared)
    members = P.lineup_members(rows, F.col("xi"))
    return P.player_state(prepared, *V.batting_and_bowling(spark, sf), members, max_rows)


PLAYER_SQL = f"""
WITH {V.CONTESTS}, {V.SPELLS}, {V.LINEUPS}, {PLAYER_CUM}, {CURRENT_PROBE}, {PLAYER_STATE}
SELECT match_id, side, player, bat_innings, round(bat_runs, 6) AS bat_runs,
  round(batting_average, 6) AS batting_average, round(recent_runs, 6) AS recent_runs,
  round(recent_strike_rate, 6) AS recent_strike_rate, bowl_balls, bowl_wickets,
  round(bowling_economy, 6) AS bowling_economy, recent_wickets,
  round(recent_economy, 6) AS recent_economy
FROM state
"""


def _player_columns(state):
    return state.select(
        "match_id", "side", "player", "bat_innings", "bowl_wickets", "recent_wickets",
        F.col("bowl_balls").cast("long").alias("bowl_balls"),
        *_r("bat_runs", "batting_average", "recent_runs", "recent_strike_rate", "bowling_economy",
            "recent_economy"),
    )


query("player_form_asof", PLAYER_SQL)(lambda spark, sf: _player_columns(_current_state(spark, sf)))
query("player_form_split_keys", PLAYER_SQL)(
    lambda spark, sf: _player_columns(_current_state(spark, sf, max_rows=400))
)


LINEUP_SQL = f"""
WITH {V.CONTESTS}, {V.SPELLS}, {V.LINEUPS}, {PLAYER_CUM}, {CURRENT_PROBE}, {PLAYER_STATE}
SELECT match_id, side, count(batting_average) AS xi_batters_with_history,
  round(avg(batting_average), 6) AS xi_mean_batting_average,
  round(avg(recent_runs), 6) AS xi_mean_recent_runs,
  count(bowling_economy) AS xi_bowlers_with_history,
  round(avg(bowling_economy), 6) AS xi_mean_bowling_economy,
  round(avg(recent_wickets), 6) AS xi_mean_recent_wickets
FROM state GROUP BY match_id, side
"""


@query("lineup_snapshot", LINEUP_SQL)
def lineup_snapshot(spark, sf):
    return P.lineup_snapshot(_current_state(spark, sf)).select(
        "match_id", "side", "xi_batters_with_history", "xi_bowlers_with_history",
        *_r("xi_mean_batting_average", "xi_mean_recent_runs", "xi_mean_bowling_economy",
            "xi_mean_recent_wickets"),
    )


PREVIOUS_XI = """
team_xi AS (
  SELECT f.match_id, f.date, f.format, f.gender, f.side, f.team, l.xi
  FROM flagged f LEFT JOIN lineups l USING (match_id, side)
  WHERE f.match_id IN (SELECT match_id FROM lineups)
),
one_back AS (
  SELECT *, last_value(xi IGNORE NULLS) OVER w AS previous_xi, lag(date) OVER o AS last_date
  FROM team_xi
  WINDOW o AS (PARTITION BY format, gender, team ORDER BY date, match_id),
    w AS (PARTITION BY format, gender, team ORDER BY date, match_id
          ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)
),
previous AS (
  SELECT *, last_value(CASE WHEN xi IS NOT NULL THEN {'xi': previous_xi} END IGNORE NULLS) OVER w
      AS two_back, date_diff('day', last_date, date) AS rest_days
  FROM one_back
  WINDOW w AS (PARTITION BY format, gender, team ORDER BY date, match_id
               ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)
)
"""


def _overlap(a: str, b: str) -> str:
    return f"round(len(list_intersect({a}, {b})) / nullif(len({a}), 0), 6)"


@query(
    "previous_lineups",
    f"""
WITH {V.CONTESTS}, {V.LINEUPS}, {PREVIOUS_XI}
SELECT match_id, team, rest_days, CASE WHEN rest_days IS NOT NULL THEN round(ln(1 + least(greatest(rest_days, 0), 120)), 6) END AS log_rest_days,
  CAST(previous_xi IS NOT NULL AS INT) AS previous_xi_known,
  CASE WHEN two_back.xi IS NOT NULL AND previous_xi IS NOT NULL
    THEN {_overlap('previous_xi', 'two_back.xi')} END AS previous_roster_stability,
  CASE WHEN xi IS NOT NULL AND previous_xi IS NOT NULL THEN {_overlap('xi', 'previous_xi')} END
    AS current_previous_xi_overlap
FROM previous
""",
)
def previous_lineups(spark, sf):
    from tallyline.functions.scoring import log_rest_days, overlap_ratio

    rows = P.previous_lineups(C.team_rows(C.prepare(V.contests_with_lineups(spark, sf))))
    one, two = F.col("previous_xi"), F.col("previous_previous_xi")
    return rows.select(
        "match_id", "team", "rest_days",
        F.round(log_rest_days(F.col("rest_days")), 6).alias("log_rest_days"),
        one.isNotNull().cast("int").alias("previous_xi_known"),
        F.round(overlap_ratio(one, two), 6).alias("previous_roster_stability"),
        F.round(overlap_ratio(F.col("xi"), one), 6).alias("current_previous_xi_overlap"),
    )


def _strength_sql(role: int, label: str) -> str:
    def mean(value, where=None):
        inside = f"CASE WHEN {where} THEN {value} END" if where else value
        return f"round(avg(CASE WHEN role = {role} THEN {inside} END), 9)"

    bat, bowl = "rb <= 7 AND bat_innings > 0", "rw <= 5 AND bowl_balls > 0"
    return f"""
  {mean('batting_average')} AS {label}_xi_mean_batting_average,
  {mean('recent_runs')} AS {label}_xi_mean_recent_runs,
  {mean('bowling_economy')} AS {label}_xi_mean_bowling_economy,
  {mean('recent_wickets')} AS {label}_xi_mean_recent_wickets,
  {mean('recent_runs', bat)} AS {label}_xi_core_batting_recent_runs,
  {mean('recent_strike_rate', bat)} AS {label}_xi_core_batting_recent_strike_rate,
  {mean('recent_wickets', bowl)} AS {label}_xi_core_bowling_recent_wickets,
  {mean('recent_economy', bowl)} AS {label}_xi_core_bowling_recent_economy"""


ROSTER_SQL = f"""
WITH {V.CONTESTS}, {V.SPELLS}, {V.LINEUPS}, {PREVIOUS_XI}, {PLAYER_CUM},
probe AS (
  SELECT match_id, side, 0 AS role, format, {_ORD} AS ord, unnest(xi) AS player,
    generate_subscripts(xi, 1) AS pos FROM previous
  UNION ALL
  SELECT match_id, side, 1 AS role, format, {_ORD} AS ord, unnest(previous_xi) AS player,
    generate_subscripts(previous_xi, 1) AS pos FROM previous
), {PLAYER_STATE},
ranked AS (
  SELECT *, row_number() OVER (PARTITION BY match_id, side, role ORDER BY bat_innings DESC, pos) AS rb,
    row_number() OVER (PARTITION BY match_id, side, role ORDER BY bowl_balls DESC, pos) AS rw
  FROM state
),
strength AS (
  SELECT match_id, side, {_strength_sql(1, 'previous')}, {_strength_sql(0, 'current')}
  FROM ranked GROUP BY match_id, side
)
SELECT p.team, s.* EXCLUDE (side) FROM strength s JOIN previous p USING (match_id, side)
WHERE p.format = 'T20'
"""


@query("roster_strength", ROSTER_SQL)
def roster_strength(spark, sf):
    prepared = C.prepare(V.contests_with_lineups(spark, sf))
    side = P.roster_features(
        C.team_rows(prepared), prepared, *V.batting_and_bowling(spark, sf)
    )
    names = [f"{l}_xi_{n}" for l in ("previous", "current") for n in (*P.MEANS, *P.CORES)]
    # A side with neither list known has no strength row in the SQL.
    known = side.where("previous_xi_known = 1 OR current_xi_known = 1")
    return known.select("match_id", "team", *[F.round(n, 9).alias(n) for n in names])


@query(
    "batting_innings",
    f"""
WITH {V.DELIVERIES}, d AS (SELECT *, seq % 11 AS striker, CASE WHEN wicket AND seq % 3 > 0 THEN seq % 11 END AS player_out FROM deliveries)
SELECT match_id, innings, CAST(striker AS VARCHAR) AS player, CAST(sum(runs_total) AS BIGINT) AS runs,
  count(*) FILTER (WHERE NOT is_wide) AS balls, coalesce(bool_or(wicket AND player_out = striker), false) AS out,
  min(seq) AS first_seq
FROM d GROUP BY match_id, innings, striker
""",
)
def batting_innings(spark, sf):
    striker = (F.col("seq") % 11).cast("string")
    d = V.deliveries(spark, sf).select(
        "*", striker.alias("striker"), F.col("runs_total").alias("runs_batter"),
        F.when(F.col("wicket") & (F.col("seq") % 3 > 0), striker).alias("player_out"),
    )
    return P.batting_innings(d)


@query(
    "bowling_spells",
    f"""
WITH {V.DELIVERIES}, d AS (SELECT *, seq % 7 AS bowler,
  CASE seq % 3 WHEN 0 THEN 'run out' WHEN 1 THEN 'Caught' END AS wicket_type FROM deliveries)
SELECT match_id, innings, CAST(bowler AS VARCHAR) AS player, CAST(sum(runs_total) AS BIGINT) AS runs,
  count(*) FILTER (WHERE NOT is_wide AND NOT is_noball) AS balls,
  count(*) FILTER (WHERE wicket AND coalesce(wicket_type, '') <> 'run out') AS wickets, min(seq) AS first_seq
FROM d GROUP BY match_id, innings, bowler
""",
)
def bowling_spells(spark, sf):
    third = F.col("seq") % 3
    d = V.deliveries(spark, sf).select(
        "*", (F.col("seq") % 7).cast("string").alias("bowler"),
        F.when(third == 0, "run out").when(third == 1, "Caught").alias("wicket_type"),
    )
    return P.bowling_spells(d)


PREMATCH_SQL = f"""
WITH {V.CONTESTS}, {V.LINEUPS},
form AS ({FORM_SQL}),
meetings AS ({H2H_SQL}),
at_ground AS ({VENUE_SQL}),
ground AS ({VENUE_RECORD_SQL}),
rated AS ({_elo_sql("SELECT match_id, elo1, elo2 FROM fold WHERE k > 0")}),
snapshot AS ({LINEUP_SQL}),
sides AS (
  SELECT f.match_id, f.date, f.format, f.competition, f.venue, f.gender, f.side, f.team, f.opponent, f.won AS team_win, f.toss_winner,
    CASE WHEN f.side = 1 THEN elo1 ELSE elo2 END AS own, CASE WHEN f.side = 1 THEN elo2 ELSE elo1 END AS other
  FROM flagged f JOIN rated USING (match_id) WHERE f.result_type = 'win'
)
SELECT s.match_id, CAST(s.date AS VARCHAR) AS date, s.format, s.competition, s.venue, s.gender, s.team, s.opponent, s.team_win,
  mode AS prediction_mode, mode = 'POST_TOSS' AND s.toss_winner = s.team AS team_won_toss,
  f.* EXCLUDE (match_id, team), m.* EXCLUDE (match_id, team), v.* EXCLUDE (match_id, team), g.* EXCLUDE (match_id),
  round(own, 6) AS team_elo_before, round(other, 6) AS opponent_elo_before, round(own - other, 6) AS elo_difference,
  CASE WHEN l.xi IS NOT NULL THEN 'LINEUP_KNOWN' ELSE 'LINEUP_UNKNOWN' END AS lineup_status,
  x.* EXCLUDE (match_id, side)
FROM sides s CROSS JOIN (VALUES ('PRE_TOSS'), ('POST_TOSS')) k(mode)
JOIN form f ON (f.match_id, f.team) = (s.match_id, s.team)
JOIN meetings m ON (m.match_id, m.team) = (s.match_id, s.team)
JOIN at_ground v ON (v.match_id, v.team) = (s.match_id, s.team)
JOIN ground g ON g.match_id = s.match_id
LEFT JOIN lineups l ON (l.match_id, l.side) = (s.match_id, s.side)
LEFT JOIN snapshot x ON (x.match_id, x.side) = (s.match_id, s.side)
"""


@query("prematch_features", PREMATCH_SQL)
def prematch_table(spark, sf):
    """The whole feature build, every history column of every side and mode."""
    history = team_history(
        V.contests_with_lineups(spark, sf), *V.batting_and_bowling(spark, sf)
    )
    built = prematch_features(history)
    facts = ["match_id", "format", "competition", "venue", "gender", "team", "opponent", "team_win", "prediction_mode"]
    kinds = dict(built.dtypes)
    return built.select(
        *facts,
        F.col("date").cast("string").alias("date"),
        F.coalesce("team_won_toss", F.lit(False)).alias("team_won_toss"),
        *[F.round(n, 6).alias(n) if kinds[n] == "double" else F.col(n) for n in HISTORY],
    )

"""The feature build: one row per contest, side and mode, plus running states."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyline.functions.outcomes import exclusion_reason, toss_columns
from tallyline.functions.text import MODES
from tallyline.operators import contests as C
from tallyline.operators.elo import contest_scores, elo_before, team_ratings
from tallyline.operators.sizing import key_limit, long_side
from tallyline.operators.participants import lineup_members, lineup_snapshot, player_state

FORM = [
    "matches_before", "wins_before", "win_rate_before",
    *[f"{n}_last_{w}" for w in C.FORM_WINDOWS for n in ("matches", "wins", "win_rate")],
]
MEETINGS = [
    "h2h_matches_before", "h2h_team_wins", "h2h_opponent_wins", "h2h_team_win_rate",
    "h2h_last_5_matches", "h2h_last_5_win_rate",
]
VENUE = [
    "team_matches_at_venue", "team_wins_at_venue", "team_win_rate_at_venue",
    "opponent_matches_at_venue", "opponent_wins_at_venue", "opponent_win_rate_at_venue",
    "venue_batting_first_win_rate", "venue_chasing_win_rate", "venue_decided_matches",
    "historical_first_innings_average", "historical_first_innings_matches",
]
RATING = ["team_elo_before", "opponent_elo_before", "elo_difference"]
LINEUP = [
    "lineup_status", "xi_batters_with_history", "xi_mean_batting_average", "xi_mean_recent_runs",
    "xi_bowlers_with_history", "xi_mean_bowling_economy", "xi_mean_recent_wickets",
]
HISTORY = [*FORM, *MEETINGS, *VENUE, *RATING, *LINEUP]


def team_history(
    contests: DataFrame,
    batting: DataFrame | None = None,
    bowling: DataFrame | None = None,
    *,
    as_of: str = "sequence",
    ratings_in: DataFrame | None = None,
    only_requests: bool = False,
    max_rows: int | None = None,
) -> DataFrame:
    """Team rows with every history column as it stood before the contest.

    Form, meetings and the side's venue record share the team key, so one shuffle
    serves all three; the contest-level venue record and the ratings join on
    ``match_id``, and the opponent's columns come from the pair without another.
    """
    prepared = C.prepare(contests, as_of)
    if only_requests:  # history rows end at the windows and reach no join
        prepared = prepared.withColumn("asks", F.col("asks") & F.col("asked"))
    rows = C.team_rows(prepared)
    limit = key_limit(rows, [*C.POOL, "team"], max_rows)
    rows = C.team_at_venue(C.head_to_head(C.team_form(rows, limit), limit), limit)
    rows = rows.where("asks")
    rows = rows.join(long_side(C.venue_record(prepared, max_rows)), "match_id", "left")
    ratings = elo_before(contest_scores(prepared), ratings_in=ratings_in, max_rows=max_rows)
    rows = team_ratings(rows, ratings)
    rows = C.opponent_at_venue(rows)
    if batting is None or bowling is None:
        return rows
    members = lineup_members(rows.where("xi is not null"), F.col("xi"))
    snapshot = lineup_snapshot(player_state(prepared, batting, bowling, members, max_rows))
    status = F.when(F.col("xi").isNotNull(), "LINEUP_KNOWN").otherwise("LINEUP_UNKNOWN")
    return rows.join(long_side(snapshot), ["match_id", "side"], "left").withColumn("lineup_status", status)


def prematch_features(history: DataFrame, modes: Iterable[str] = MODES) -> DataFrame:
    """Team rows of contests with a binary result, once per mode, with the label."""
    reason = exclusion_reason(
        F.col("date"), F.col("result_type"), F.col("winner"), F.col("team1"), F.col("team2")
    )
    names = set(history.columns)
    features = [c for c in HISTORY if c in names]
    facts = [c for c in ("competition", "season", "venue", "city") if c in names]
    rows = history.where(reason.isNull()).withColumn(
        "prediction_mode", F.explode(F.array(*[F.lit(m) for m in modes]))
    )
    toss = toss_columns(
        F.col("prediction_mode"), F.col("team"), F.col("toss_winner"), F.col("toss_decision")
    )
    return rows.select(
        "match_id", "date", "format", *facts, "gender",
        F.lit(None).cast("string").alias("home_away"),
        "raw_team_name", "team", "raw_opponent_name", "opponent",
        (F.col("team") == F.col("won_by")).cast("int").alias("team_win"),
        *features,
        "prediction_mode",
        *[c.alias(n) for n, c in toss.items()],
    )

"""Rules a scoring request has to meet, as one array of reasons per row."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyline.functions.scoring import overs_reject_reason, overs_text_to_balls
from tallyline.functions.text import (
    FORMATS,
    canonical_competition,
    canonical_team,
    contest_format,
    prediction_mode,
)

# --- Fixed values -----------------------------------------------------------
HUNDRED_REFUSED = (
    "The Hundred is not a T20 format and is not supported by the production prediction router."
)
MODE_UNKNOWN = "Unsupported prediction mode. Allowed: PRE_TOSS, POST_TOSS, LIVE."
SAME_TEAMS = "team1 and team2 must be different"
TOSS_MISSING = "POST_TOSS predictions require toss_winner and toss_decision."
TOSS_WINNER_OTHER = "toss_winner must be one of team1/team2"
TOSS_DECISION_OTHER = "toss_decision must be bat, field, or bowl"
BATTING_MISSING = "LIVE predictions require batting_team."
INNINGS_MISSING = "LIVE predictions require innings_number 1 or 2."
STATE_MISSING = "LIVE predictions require runs, wickets, and legal_balls."
RUNS_NEGATIVE = "runs cannot be negative"
WICKETS_RANGE = "wickets must be between 0 and 10"
BALLS_NEGATIVE = "legal_balls cannot be negative"
TARGET_MISSING = "A positive target is required for innings 2"
TARGET_EARLY = "target must be omitted for innings 1"
BATTING_OTHER = "batting_team must be team1 or team2"
ROUTED_ONLY = "'. Production routing supports T20I and T20 only."
# ----------------------------------------------------------------------------


def request_format(value: Column, competition: Column) -> Column:
    """Format of a request: an exact label, else what the format rules make of it."""
    upper = F.upper(F.trim(F.coalesce(value, F.lit(""))))
    none = F.lit(None).cast("int")
    mapped = contest_format(value, F.lit(None), competition, none, none)
    return F.when(upper.isin(*FORMATS), upper).when(mapped != "OTHER", mapped)


def format_reject_reason(value: Column, competition: Column) -> Column:
    label = request_format(value, competition)
    hundred = F.coalesce(canonical_competition(competition) == "The Hundred", F.lit(False))
    return (
        F.when(hundred | (F.coalesce(label, F.lit("")) == "HUNDRED"), HUNDRED_REFUSED)
        .when(
            label.isNull(),
            F.concat(F.lit("Unsupported format '"), F.coalesce(value, F.lit("")),
                     F.lit(ROUTED_ONLY)),
        )
        .when(
            ~label.isin("T20I", "T20"),
            F.concat(F.lit("Unsupported format "), label,
                     F.lit(". Production routing supports T20I and T20 only. "
                           "Hundred, T10, ODI, and Test are not routed.")),
        )
    )


def lineup_mode(mode: Column, xi1: Column, xi2: Column) -> Column:
    """Which playing lists came with a request; NULL before the toss."""
    first = F.coalesce(F.size(xi1) > 0, F.lit(False))
    second = F.coalesce(F.size(xi2) > 0, F.lit(False))
    label = F.when(first & second, "both_xi_known").when(first | second, "partial_xi")
    return F.when(mode.isin("POST_TOSS", "LIVE"), label.otherwise("xi_unknown"))


def validate(requests: DataFrame) -> DataFrame:
    """Add normalised columns and ``reject_reasons`` (empty when the request is fine).

    Reads ``team1 team2 format mode gender venue competition toss_winner
    toss_decision team1_xi team2_xi batting_team innings runs wickets legal_balls
    overs target``. ``overs`` text, when given, replaces ``legal_balls``.
    """
    mode = prediction_mode("mode")
    staged = requests.select(
        "*",
        mode.alias("prediction_mode"),
        request_format(F.col("format"), F.col("competition")).alias("match_format"),
        canonical_team("team1").alias("team1_name"),
        canonical_team("team2").alias("team2_name"),
        canonical_team("batting_team").alias("batting_name"),
        F.when(F.col("overs").isNotNull(), overs_text_to_balls(F.col("overs")))
        .otherwise(F.col("legal_balls")).alias("balls"),
    )
    c = F.col
    post, live = c("prediction_mode") == "POST_TOSS", c("prediction_mode") == "LIVE"
    decision = F.lower(F.trim(F.coalesce(c("toss_decision"), F.lit(""))))
    toss_given = (F.coalesce(c("toss_winner"), F.lit("")) != "") & (decision != "")
    toss_team = canonical_team("toss_winner")
    no_balls = c("overs").isNull() & c("legal_balls").isNull()

    def rule(condition: Column, text: str) -> Column:
        return F.when(condition, text)

    reasons = [
        rule(c("prediction_mode").isNull(), MODE_UNKNOWN),
        format_reject_reason(c("format"), c("competition")),
        rule(F.lower("team1_name") == F.lower("team2_name"), SAME_TEAMS),
        rule(post & ~toss_given, TOSS_MISSING),
        rule(post & toss_given & (toss_team != c("team1_name")) & (toss_team != c("team2_name")),
             TOSS_WINNER_OTHER),
        rule(post & toss_given & ~decision.isin("bat", "field", "bowl"),
             TOSS_DECISION_OTHER),
        rule(live & c("batting_team").isNull(), BATTING_MISSING),
        rule(live & ~F.coalesce(c("innings").isin(1, 2), F.lit(False)),
             INNINGS_MISSING),
        rule(live & (c("runs").isNull() | c("wickets").isNull() | no_balls),
             STATE_MISSING),
        F.when(live & c("overs").isNotNull(), overs_reject_reason(c("overs"))),
        rule(live & (c("runs") < 0), RUNS_NEGATIVE),
        rule(live & ~c("wickets").between(0, 10), WICKETS_RANGE),
        rule(live & (c("legal_balls") < 0), BALLS_NEGATIVE),
        rule(live & (c("innings") == 2) & (c("target").isNull() | (c("target") <= 0)),
             TARGET_MISSING),
        rule(live & (c("innings") == 1) & c("target").isNotNull(),
             TARGET_EARLY),
        rule(live & c("batting_team").isNotNull() & (c("batting_name") != c("team1_name"))
             & (c("batting_name") != c("team2_name")), BATTING_OTHER),
    ]
    return staged.select("*", F.array_compact(F.array(*reasons)).alias("reject_reasons"))

"""Running state inside a contest, ball by ball."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyline.functions.scoring import (
    ball_limit,
    default_balls_per_over,
    live_metrics,
    supports_live,
)
from tallyline.functions.text import canonical_team
from tallyline.operators.history import running


def running_score(
    deliveries: DataFrame,
    keys: tuple[str, ...] = ("match_id", "innings"),
    order: tuple[str, ...] = ("seq",),
    max_rows: int | None = None,
) -> DataFrame:
    """Runs, wickets and legal balls after each delivery. Penalty runs stay out."""
    legal = ~F.col("is_wide") & ~F.col("is_noball")
    return running(
        deliveries.withColumn("is_legal", legal),
        list(keys),
        list(order),
        totals={
            "runs": F.col("runs_total"),
            "wickets": F.col("wicket").cast("int"),
            "legal_balls_bowled": F.col("is_legal").cast("int"),
        },
        include_current=True,
        max_rows=max_rows,
    )


def with_metrics(
    states: DataFrame, limit: Column, balls_per_over: Column, target: Column | None = None
) -> DataFrame:
    """Add the scoreboard numbers to rows with runs, wickets and legal balls."""
    goal = F.lit(None).cast("int") if target is None else target
    metrics = live_metrics(
        F.col("runs"), F.col("wickets"), F.col("legal_balls_bowled"), goal, limit, balls_per_over
    )
    return states.withColumns(metrics)


def live_states(
    matches: DataFrame, innings: DataFrame, deliveries: DataFrame, max_rows: int | None = None
) -> DataFrame:
    """One row per delivery of a limited-overs match, with its label.

    The innings table supplies target and bowling side; where it has no row the
    bowling side is the team that is not batting.
    """
    scored = running_score(deliveries, max_rows=max_rows)
    facts = matches.where(supports_live(F.col("format"))).select(
        "match_id", "date", "format", "competition", "team1", "team2", "winner",
        "scheduled_overs", "balls_per_over",
    )
    per_innings = innings.select(
        "match_id", F.col("innings_number").alias("innings"),
        F.col("bowling_team").alias("_bowling"), F.col("target").alias("_target"),
        F.col("target_overs").alias("_target_overs"),
    )
    joined = scored.join(facts, "match_id").join(per_innings, ["match_id", "innings"], "left")
    batting = canonical_team("batting_team")
    fallback = F.when(batting == canonical_team("team1"), F.col("team2")).otherwise(F.col("team1"))
    bpo = default_balls_per_over(F.col("format"), F.col("balls_per_over"))
    limit = ball_limit(F.col("format"), F.col("scheduled_overs"), bpo, F.col("_target_overs"))
    out = with_metrics(joined, limit, bpo, F.col("_target"))
    winner = F.when(F.col("winner").isNotNull(), canonical_team("winner"))

    def text(name: str) -> Column:
        return F.when(F.col(name) != "", F.col(name)).alias(name)

    return out.select(
        "match_id", "date", "format", "competition",
        F.col("innings").alias("innings_number"), "seq",
        batting.alias("batting_team"),
        canonical_team(F.coalesce(F.when(F.col("_bowling") != "", F.col("_bowling")), fallback))
        .alias("bowling_team"),
        "runs", "wickets", "legal_balls_bowled", "overs", "balls_remaining", "current_run_rate",
        "target", "runs_required", "required_run_rate", "run_rate_difference", "wickets_in_hand",
        "is_wide", "is_noball", F.col("wicket").alias("is_wicket"), "is_legal",
        F.col("runs_total").alias("runs_this_ball"),
        text("striker"), text("non_striker"), text("bowler"),
        winner.alias("eventual_winner"),
        F.when(winner.isNotNull(), (batting == winner).cast("int")).alias("batting_team_eventual_win"),
    )


def last_delivery(deliveries: DataFrame) -> DataFrame:
    """Players of each match's most recent delivery; empty names become NULL."""
    moment = F.struct("innings", "seq")
    return deliveries.groupBy("match_id").agg(
        F.max_by(F.struct("striker", "non_striker", "bowler"), moment).alias("_p")
    ).select(
        "match_id",
        *[F.when(F.col(f"_p.{n}") != "", F.col(f"_p.{n}")).alias(n)
          for n in ("striker", "non_striker", "bowler")],
    )

"""Data-quality checks: counts and a few examples, never a deleted row."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallyline.functions.text import FORMATS

EXAMPLES = 5
SALTS = 64


def _report(table: str, failures: DataFrame) -> DataFrame:
    """(table, check, count, examples) from rows (check, amount, example, place).

    The first five examples are kept per check and salt before they meet, so no
    task ever holds all failures of a check.
    """
    counts = failures.groupBy("check").agg(F.sum("amount").cast("long").alias("count"))
    salted = failures.where(F.col("example").isNotNull()).withColumn(
        "_salt", F.pmod(F.xxhash64("example", "place"), F.lit(SALTS))
    )
    first = Window.partitionBy("check", "_salt").orderBy("place", "example")
    some = (
        salted.withColumn("_rank", F.row_number().over(first))
        .where(F.col("_rank") <= EXAMPLES)
        .groupBy("check")
        .agg(F.array_sort(F.collect_list(F.struct("place", "example"))).alias("_e"))
        .select("check", F.slice(F.col("_e.example"), 1, EXAMPLES).alias("examples"))
    )
    empty = F.array().cast("array<string>")
    return counts.join(some, "check", "left").select(
        F.lit(table).alias("table"), "check", "count", F.coalesce("examples", empty).alias("examples")
    )


def _rows_failing(df: DataFrame, checks: dict[str, tuple[Column, bool]], place: Column) -> DataFrame:
    """One row per failed check: ``checks`` maps name -> (condition, give examples)."""
    tags = F.array(
        *[
            F.when(
                F.coalesce(condition, F.lit(False)),
                F.struct(F.lit(name).alias("check"), F.lit(shown).alias("shown")),
            )
            for name, (condition, shown) in checks.items()
        ]
    )
    return df.select(
        F.explode(F.array_compact(tags)).alias("_t"), F.col("match_id").cast("string").alias("_id"),
        place.alias("place"),
    ).select(
        F.col("_t.check").alias("check"), F.lit(1).alias("amount"),
        F.when(F.col("_t.shown"), F.col("_id")).alias("example"), "place",
    )


def check_prematch(features: DataFrame) -> DataFrame:
    """Issues of a pre-match feature table; a clean table gives no rows."""
    place = F.concat_ws("|", F.col("date").cast("string"), F.col("match_id").cast("string"),
                        F.col("team"), F.col("prediction_mode"))
    single = _rows_failing(
        features,
        {
            "missing_match_id": (F.col("match_id").isNull(), False),
            "unknown_formats": (~F.coalesce(F.col("format").isin(*FORMATS), F.lit(False)), True),
            "invalid_team_win": (~F.coalesce(F.col("team_win").isin(0, 1), F.lit(False)), False),
        },
        place,
    )
    copies = (
        features.groupBy("match_id", "team", "prediction_mode")
        .agg(F.count(F.lit(1)).alias("n"), F.min(place).alias("place"))
        .where("n > 1")
        .select(F.lit("duplicate_prediction_rows").alias("check"), (F.col("n") - 1).cast("int").alias("amount"),
                F.col("match_id").cast("string").alias("example"), "place")
    )
    winners = (
        features.where(F.col("prediction_mode").isNotNull())
        .groupBy("prediction_mode", "match_id")
        .agg(F.sum("team_win").alias("w"))
        .where("w <> 1")
        .select(F.concat(F.lit("inconsistent_winners_"), "prediction_mode").alias("check"),
                F.lit(1).alias("amount"), F.col("match_id").cast("string").alias("example"),
                F.col("match_id").cast("string").alias("place"))
    )
    return _report("prematch", single.unionByName(copies).unionByName(winners))


def check_live(states: DataFrame) -> DataFrame:
    """Issues of a live-state table; a clean table gives no rows."""
    place = F.concat_ws("|", F.col("match_id").cast("string"), F.col("innings_number").cast("string"))
    return _report(
        "live",
        _rows_failing(
            states,
            {
                "missing_match_id": (F.col("match_id").isNull(), False),
                "wickets_gt_10": (F.col("wickets") > 10, True),
                "negative_wickets_in_hand": (F.col("wickets_in_hand") < 0, False),
                "negative_balls_remaining": (F.col("balls_remaining") < 0, False),
                "negative_runs": (F.col("runs") < 0, False),
                "invalid_targets": (F.col("target") <= 0, False),
                "first_innings_has_target": (
                    (F.col("innings_number") == 1) & F.col("target").isNotNull(), False,
                ),
            },
            place,
        ),
    )

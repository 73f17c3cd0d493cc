"""Audits of a feature table: coverage, cold starts, availability, signal."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyline.operators.metrics import exact_median, orientation_free_auc
from tallyline.operators.sizing import long_side
from tallyline.session import staged

NONE = "(none)"


def _share(condition: Column) -> Column:
    """Share of rows for which a condition holds; an unknown condition does not."""
    return F.avg(F.coalesce(condition, F.lit(False)).cast("int"))


def _medians(df: DataFrame, group: str, names: dict[str, str]) -> DataFrame:
    """Exact medians of several columns at once: ``names`` maps column -> output."""
    long = df.select(
        group,
        F.explode(
            F.array(
                *[
                    F.struct(F.lit(out).alias("m"), F.col(c).cast("double").alias("v"))
                    for c, out in names.items()
                ]
            )
        ).alias("_s"),
    ).select(group, "_s.m", "_s.v")
    tall = exact_median(long, "v", [group, "m"], "median")
    return tall.groupBy(group).agg(
        *[F.max(F.when(F.col("m") == out, F.col("median"))).alias(out) for out in names.values()]
    )


def _distinct_count(df: DataFrame, group: str, value: str, name: str) -> DataFrame:
    return df.select(group, value).distinct().groupBy(group).agg(F.count(value).alias(name))


def _window(features: DataFrame, start: str, format_: str | None) -> DataFrame:
    keep = F.col("date") >= F.lit(start).cast("date")
    if format_ is not None:
        keep = keep & (F.col("format") == format_)
    return features.where(keep)


def competition_coverage(
    features: DataFrame, start: str, min_matches: int, format_: str | None = "T20"
) -> DataFrame:
    """How much history the rows of each competition can draw on.

    Of ``features`` only the rows and columns asked about are stored, for the many passes over them; a table that
    is not stored itself need not be built any further.
    """
    known = [
        "match_id", "team", "prediction_mode", "home_away", "matches_before", "h2h_matches_before", "team_matches_at_venue",
        "lineup_status", "xi_mean_batting_average", "xi_mean_bowling_economy", "xi_batters_with_history", "xi_bowlers_with_history",
    ]
    frame = staged(
        _window(features, start, format_).select(F.coalesce("competition", F.lit(NONE)).alias("competition"), *known)
    )
    pre = frame.where(F.col("prediction_mode") == "PRE_TOSS")
    post = frame.where(F.col("prediction_mode") == "POST_TOSS")
    # After-toss rows follow the competition of their match's before-toss rows.
    membership = pre.select("competition", "match_id").distinct()
    post = post.drop("competition").join(long_side(membership), "match_id")
    group = "competition"

    def below(name: str, n: int) -> Column:
        return _share(F.col(name) < n)

    base = pre.groupBy(group).agg(
        below("matches_before", 5).alias("pct_side_rows_lt_5_prior_matches"),
        below("matches_before", 10).alias("pct_side_rows_lt_10_prior_matches"),
        below("matches_before", 20).alias("pct_side_rows_lt_20_prior_matches"),
        _share(F.col("h2h_matches_before") == 0).alias("pct_side_rows_no_h2h"),
        _share(F.col("team_matches_at_venue") == 0).alias("pct_side_rows_no_team_venue_history"),
        _share(F.col("home_away").isNotNull()).alias("pct_home_away_present"),
    )
    after = post.groupBy(group).agg(
        _share(F.col("lineup_status") == "LINEUP_KNOWN").alias("pct_posttoss_side_rows_lineup_known"),
        _share(F.col("xi_mean_batting_average").isNull()).alias("pct_xi_batting_average_missing"),
        _share(F.col("xi_mean_bowling_economy").isNull()).alias("pct_xi_bowling_economy_missing"),
    )
    sizes = membership.groupBy(group).agg(F.count(F.lit(1)).alias("matches")).where(
        F.col("matches") >= min_matches
    )
    return (
        sizes.join(_distinct_count(pre, group, "team", "teams"), group)
        .join(base, group)
        .join(
            _medians(
                pre, group,
                {
                    "matches_before": "median_matches_before_per_side",
                    "h2h_matches_before": "median_h2h_matches_before",
                    "team_matches_at_venue": "median_team_matches_at_venue",
                },
            ),
            group, "left",
        )
        .join(_distinct_count(post, group, "match_id", "posttoss_matches_available"), group, "left")
        .join(after, group, "left")
        .join(
            _medians(
                post, group,
                {
                    "xi_batters_with_history": "median_xi_batters_with_history",
                    "xi_bowlers_with_history": "median_xi_bowlers_with_history",
                },
            ),
            group, "left",
        )
        .fillna(0, ["posttoss_matches_available"])
    )


def team_cold_start(
    features: DataFrame, start: str, min_matches: int, format_: str | None = "T20"
) -> DataFrame:
    """How much history each team's rows can draw on, and where it plays."""
    frame = _window(features, start, format_).where(F.col("prediction_mode") == "PRE_TOSS")
    sizes = _distinct_count(frame, "team", "match_id", "matches").where(
        F.col("matches") >= min_matches
    )
    played_in = frame.where(F.col("competition").isNotNull()).select("team", "competition").distinct()
    names = played_in.groupBy("team").agg(
        F.concat_ws(", ", F.array_sort(F.collect_list("competition"))).alias("competitions")
    )
    base = frame.groupBy("team").agg(
        F.min("matches_before").alias("min_prior_matches"),
        _share(F.col("matches_before") < 10).alias("pct_rows_lt_10_prior"),
        _share(F.col("h2h_matches_before") == 0).alias("pct_rows_no_h2h"),
        _share(F.col("team_matches_at_venue") == 0).alias("pct_rows_no_venue_history"),
    )
    medians = _medians(frame, "team", {"matches_before": "median_prior_matches"})
    return (
        sizes.join(base, "team")
        .join(medians, "team", "left")
        .join(names, "team", "left")
        .withColumn("competitions", F.coalesce("competitions", F.lit("")))
    )


def availability(df: DataFrame, candidates: Sequence[str]) -> DataFrame:
    """Per candidate column: is it there, how full is it, how many values has it."""
    present = [c for c in candidates if c in df.columns]
    absent = [c for c in candidates if c not in df.columns]
    out = None
    if present:
        pairs = F.array(
            *[F.struct(F.lit(c).alias("feature"), F.col(c).cast("string").alias("v")) for c in present]
        )
        long = df.select(F.explode(pairs).alias("_s")).select("_s.feature", "_s.v")
        # One row per distinct value first: the count of values stays distributed.
        values = long.groupBy("feature", "v").agg(F.count(F.lit(1)).alias("c"))
        out = values.groupBy("feature").agg(
            F.lit(True).alias("present_in_dataset"),
            (F.sum(F.when(F.col("v").isNotNull(), F.col("c")).otherwise(0)) / F.sum("c")).alias("non_null_pct"),
            F.count("v").alias("unique_values"),
        )
    if absent:
        rows = [(c, False, 0.0, 0) for c in absent]
        missing = df.sparkSession.createDataFrame(
            rows, "feature string, present_in_dataset boolean, non_null_pct double, unique_values long"
        )
        out = missing if out is None else out.unionByName(missing)
    return out


def feature_signal(
    paired: DataFrame, features: Sequence[str], valid: tuple[str, str], test_start: str,
    label: str = "team_a_win",
) -> DataFrame:
    """Univariate AUC of each feature on the validation and the test period."""
    day = F.col("date")
    split = F.when(day.between(F.lit(valid[0]).cast("date"), F.lit(valid[1]).cast("date")), "valid").when(
        day >= F.lit(test_start).cast("date"), "test"
    )
    pairs = F.array(
        *[F.struct(F.lit(f).alias("feature"), F.col(f).cast("double").alias("x")) for f in features]
    )
    long = (
        paired.select(label, split.alias("split"), F.explode(pairs).alias("_s"))
        .where(F.col("split").isNotNull())
        .select(label, "split", "_s.feature", "_s.x")
    )
    auc = orientation_free_auc(long, label, "x", ["feature", "split"])
    missing = long.groupBy("feature", "split").agg(
        F.avg((F.col("x").isNull() | F.isnan("x")).cast("int")).alias("missing")
    )
    joined = missing.join(auc, ["feature", "split"], "left")

    def of(name: str, value: str) -> Column:
        return F.max(F.when(F.col("split") == name, F.col(value)))

    return joined.groupBy("feature").agg(
        of("valid", "auc").alias("validation_auc_orientation_free"),
        of("test", "auc").alias("test_auc_orientation_free"),
        of("valid", "missing").alias("validation_missing_pct"),
        of("test", "missing").alias("test_missing_pct"),
    ).withColumn(
        "auc_change_test_minus_validation",
        F.col("test_auc_orientation_free") - F.col("validation_auc_orientation_free"),
    )


def yearly_coverage(df: DataFrame, columns: Sequence[str], start: str, end: str) -> DataFrame:
    """Rows and share of known values per column inside a date range, in one row."""
    inside = df.where(F.col("date").between(F.lit(start).cast("date"), F.lit(end).cast("date")))
    return inside.agg(
        F.count(F.lit(1)).alias("matches"),
        *[F.avg(F.col(c).isNotNull().cast("int")).alias(f"{c}_available_pct") for c in columns],
    )

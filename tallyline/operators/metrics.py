"""Probability metrics as aggregations, per group and optionally weighted.

Nothing here sorts rows: the rows are first folded to distinct scores per group,
then ranked in ranges of about equal size with prefix sums between ranges (`ranks`), so a
single group of any size and any distribution still spreads over many tasks.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyline.operators.ranks import below

# --- Fixed values -----------------------------------------------------------
# Equal-width edges as floating point makes them: 3/10 is not 0.3 here.
ECE_EDGES = (
    0.1, 0.2, 0.30000000000000004, 0.4, 0.5, 0.6000000000000001, 0.7000000000000001, 0.8, 0.9,
)
CLIP = 1e-9
MAX_BRIER_DEGRADATION = 0.003
MAX_AUC_DEGRADATION = 0.010
MIN_FOLDS_IMPROVED = 2
MAX_MEAN_FOLD_DELTA = -0.001
MAX_WORST_FOLD_DELTA = 0.003
# ----------------------------------------------------------------------------


def clipped(p: Column) -> Column:
    return F.least(F.greatest(p, F.lit(CLIP)), F.lit(1.0 - CLIP))


def ece_bin(p: Column) -> Column:
    """Number of edges at or below p."""
    edges = F.array(*[F.lit(e) for e in ECE_EDGES])
    return F.size(F.filter(edges, lambda e: e <= p))


def _weight(weight: str | None) -> Column:
    return F.lit(1.0) if weight is None else F.col(weight).cast("double")


def _with_group(df: DataFrame, groups: Sequence[str]) -> tuple[DataFrame, list[str]]:
    """A window needs a key: give an ungrouped frame one constant column."""
    if groups:
        return df, list(groups)
    return df.withColumn("_all", F.lit(0)), ["_all"]


def roc_auc(
    df: DataFrame, label: str, score: str, groups: Sequence[str] = (), weight: str | None = None
) -> DataFrame:
    """Area under the ROC curve per group; ties count one half, one class gives NULL."""
    df, keys = _with_group(df, groups)
    w = _weight(weight)
    hist = df.groupBy(*keys, score).agg(
        F.sum(F.when(F.col(label) == 1, w).otherwise(0.0)).alias("pos"),
        F.sum(F.when(F.col(label) == 1, 0.0).otherwise(w)).alias("neg"),
    )
    ranked = below(hist, keys, score, ["neg"])
    wins = F.sum(F.col("pos") * (F.col("neg_below") + F.col("neg") / 2))
    return (
        ranked.groupBy(*keys)
        .agg(wins.alias("_w"), F.sum("pos").alias("_p"), F.sum("neg").alias("_n"))
        .select(*keys, F.try_divide("_w", F.col("_p") * F.col("_n")).alias("roc_auc"))
    )


def expected_calibration_error(
    df: DataFrame, label: str, p: str, groups: Sequence[str] = (), weight: str | None = None
) -> DataFrame:
    """Mean gap between confidence and outcome over ten equal bins."""
    df, keys = _with_group(df, groups)
    w = _weight(weight)
    bins = df.groupBy(*keys, ece_bin(F.col(p)).alias("_bin")).agg(
        F.sum(w).alias("_w"), F.sum(w * F.col(label)).alias("_y"), F.sum(w * F.col(p)).alias("_p")
    )
    gap = F.sum(F.abs(F.col("_p") - F.col("_y")))
    return bins.groupBy(*keys).agg(F.try_divide(gap, F.sum("_w")).alias("ece_10"))


def binary_metrics(
    df: DataFrame,
    label: str,
    p: str,
    groups: Sequence[str] = (),
    weight: str | None = None,
    matches: str | None = None,
    min_rows: int = 1,
) -> DataFrame:
    """n, accuracy, AUC, log loss, Brier and ECE per group, in one row each.

    ECE uses the clipped probability as all others do. ``matches`` adds a count of
    distinct matches; groups below ``min_rows`` are left out.
    """
    keys_in = list(groups)
    # Without groups the three parts are single rows, joined on a constant.
    df, keys = _with_group(df, keys_in)
    # A NULL group is a group of its own, named, so that the joins keep it.
    columns = [label] + ([weight] if weight else []) + ([matches] if matches else [])
    group_values = [
        F.coalesce(F.col(k).cast("string"), F.lit("(none)")).alias(k) if k != "_all" else F.col(k)
        for k in keys
    ]
    rows = df.select(*group_values, *columns, clipped(F.col(p)).alias("_q"))
    w, y, q = _weight(weight), F.col(label), F.col("_q")
    right = ((q >= 0.5).cast("int") == y).cast("double")
    loss = -(y * F.log(q) + (1 - y) * F.log(1 - q))

    def mean(value: Column) -> Column:
        return F.try_divide(F.sum(w * value), F.sum(w))

    aggs = [
        F.count(F.lit(1)).alias("n"),
        mean(right).alias("accuracy"),
        mean(loss).alias("log_loss"),
        mean(F.pow(q - y, 2)).alias("brier_score"),
        mean(y).alias("positive_rate"),
    ]
    base = rows.groupBy(*keys).agg(*aggs)
    if matches:
        # Distinct first, so that a hot group is counted from partial results.
        counted = rows.select(*keys, matches).distinct().groupBy(*keys).agg(
            F.count(F.lit(1)).alias("matches")
        )
        base = base.join(counted, keys)
    base = base.where(F.col("n") >= min_rows)
    auc = roc_auc(rows, label, "_q", keys, weight)
    ece = expected_calibration_error(rows, label, "_q", keys, weight)
    out = base.join(auc, keys, "left").join(ece, keys, "left")
    return out.drop("_all")


def top_groups(metrics: DataFrame, n: int, by: str = "n") -> DataFrame:
    """The n largest groups, largest first."""
    keys = [c for c, t in metrics.dtypes if t == "string"]
    return metrics.orderBy(F.col(by).desc(), *keys).limit(n)


def orientation_free_auc(
    df: DataFrame, label: str, feature: str, groups: Sequence[str] = (), min_rows: int = 10
) -> DataFrame:
    """max(AUC, 1 - AUC) over finite values; NULL for few rows or one class."""
    value = F.col(feature).try_cast("double")
    finite = value.isNotNull() & ~F.isnan(value) & (F.abs(value) != float("inf"))
    df, keys = _with_group(df, groups)
    usable = df.where(finite & F.col(label).isNotNull()).select(*keys, label, value.alias("_x"))
    size = usable.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"))
    auc = roc_auc(usable, label, "_x", keys)
    best = F.greatest("roc_auc", 1 - F.col("roc_auc"))
    found = size.join(auc, keys).select(
        *keys, F.when((F.col("n") >= min_rows) & F.col("roc_auc").isNotNull(), best).alias("auc")
    )
    everyone = df.select(*keys).distinct()
    return everyone.join(found, keys, "left").drop("_all")


def exact_median(df: DataFrame, value: str, groups: Sequence[str], name: str) -> DataFrame:
    """Median per group from a histogram of its values; NULL when there are none."""
    x = F.col(value).try_cast("double")
    usable = df.where(x.isNotNull() & ~F.isnan(x)).select(*groups, x.alias("_x"))
    hist = usable.groupBy(*groups, "_x").agg(F.count(F.lit(1)).alias("c"))
    sizes = hist.groupBy(*groups).agg(F.sum("c").alias("_n"))
    ranked = below(hist, groups, "_x", ["c"]).join(sizes, list(groups))
    low, high = F.floor((F.col("_n") - 1) / 2), F.floor(F.col("_n") / 2)

    def at(rank: Column) -> Column:
        return F.max(F.when((F.col("c_below") <= rank) & (rank < F.col("c_below") + F.col("c")), F.col("_x")))

    return ranked.groupBy(*groups).agg(((at(low) + at(high)) / 2).alias(name))


def best_model(metrics: DataFrame, groups: Sequence[str], model: str = "model") -> DataFrame:
    """The model with the lowest Brier score, then log loss, per group."""
    order = F.struct("brier_score", "log_loss", model)
    return metrics.groupBy(*groups).agg(F.min_by(model, order).alias("selected_model"))


def fold_gate(folds: DataFrame, groups: Sequence[str], delta: str = "brier_delta") -> DataFrame:
    """Whether a candidate improves enough folds without hurting any too much."""
    d = F.col(delta)
    return folds.groupBy(*groups).agg(
        F.count_if(d < 0).alias("improved_folds"),
        F.avg(d).alias("mean_brier_delta"),
        F.max(d).alias("worst_brier_delta"),
    ).withColumn(
        "passes_gate",
        (F.col("improved_folds") >= MIN_FOLDS_IMPROVED)
        & (F.col("mean_brier_delta") <= MAX_MEAN_FOLD_DELTA)
        & (F.col("worst_brier_delta") <= MAX_WORST_FOLD_DELTA),
    )


def acceptance(metrics: DataFrame, groups: Sequence[str]) -> DataFrame:
    """Candidate against baseline: deltas and the locked acceptance rule.

    ``metrics`` has ``kind`` ('baseline' / 'candidate'), ``brier_score``, ``roc_auc``.
    """

    def of(kind: str, value: str) -> Column:
        return F.max(F.when(F.col("kind") == kind, F.col(value)))

    deltas = metrics.groupBy(*groups).agg(
        (of("candidate", "brier_score") - of("baseline", "brier_score")).alias("brier_delta"),
        (of("candidate", "roc_auc") - of("baseline", "roc_auc")).alias("auc_delta"),
    )
    return deltas.withColumn(
        "accepted",
        (F.col("brier_delta") <= MAX_BRIER_DEGRADATION) & (F.col("auc_delta") >= -MAX_AUC_DEGRADATION),
    )


def split_ranges(df: DataFrame, split: str = "split", date: str = "date", key: str = "match_id") -> DataFrame:
    """Rows, matches, first and last date of each split."""
    return df.groupBy(split).agg(
        F.count(F.lit(1)).alias("n"), F.count_distinct(key).alias("matches"),
        F.min(date).alias("start"), F.max(date).alias("end"),
    )

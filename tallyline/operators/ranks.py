"""Exact ranks and order statistics of any number of values, in any number of groups.

Distinct values are dealt into ranges by sampled quantiles, as many ranges as their counted rows
ask for; a window ranks the values inside a range, and a second one runs over one row for each
range. Where the values lie does not matter: a range holds about as many distinct values as any other.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tallyline.session import staged

# Distinct values of one range; a smaller table is ranked without ranges.
RANGE_ROWS = 1_000_000


def ranged(hist: DataFrame, groups: Sequence[str], value: str, rows: int) -> DataFrame | None:
    """``hist`` with ``_range``, numbered along (groups, value); ranges hold about ``rows`` rows.

    ``hist`` has one row for each (group, value) and should be stored: it is counted, sampled and read. The
    result is stored too, for all that reads the ranges must see the same ones. None where one range does.
    """
    n = hist.count()
    if n <= rows:
        return None
    dealt = hist.repartitionByRange(-(-n // rows), *groups, value)
    return staged(dealt.withColumn("_range", F.spark_partition_id()))


def below(
    hist: DataFrame, groups: Sequence[str], value: str, weights: Sequence[str], rows: int | None = None
) -> DataFrame:
    """For distinct (group, value) rows: ``<w>_below``, the weight at smaller values of the group.

    A NULL value is smaller than all others, NaN larger; so are they as groups, each a group of its own.
    """
    hist = staged(hist)
    dealt = ranged(hist, groups, value, rows or RANGE_ROWS)
    kept = hist.columns
    part = [] if dealt is None else ["_range"]
    inside = Window.partitionBy(*groups, *part).orderBy(value).rowsBetween(Window.unboundedPreceding, -1)
    local = (hist if dealt is None else dealt).select(
        *kept, *part, *[F.coalesce(F.sum(w).over(inside), F.lit(0)).alias(f"{w}_below") for w in weights]
    )
    if dealt is None:
        return local
    across = Window.partitionBy(*groups).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    totals = dealt.groupBy(*groups, "_range").agg(*[F.sum(w).alias(f"_t_{w}") for w in weights])
    ahead = totals.select(
        *[F.col(g).alias(f"_g_{g}") for g in groups],
        F.col("_range").alias("_of"),
        *[F.coalesce(F.sum(f"_t_{w}").over(across), F.lit(0)).alias(f"_o_{w}") for w in weights],
    )
    same = [F.col(g).eqNullSafe(F.col(f"_g_{g}")) for g in groups]
    on = F.col("_range") == F.col("_of")
    for condition in same:
        on = on & condition
    return local.join(ahead, on).select(
        *kept, *[(F.col(f"{w}_below") + F.col(f"_o_{w}")).alias(f"{w}_below") for w in weights]
    )

"""Connected components over a table of links, by alternating stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyline.session import staged


def _stars(links: DataFrame) -> DataFrame:
    """One large-star and one small-star step; `links` has u > v."""
    both = links.unionByName(links.select(F.col("v").alias("u"), F.col("u").alias("v")))
    low = both.groupBy("u").agg(F.min("v").alias("m")).withColumn("m", F.least("u", "m"))
    large = (
        both.where("v > u")
        .join(low, "u")
        .select(F.col("v").alias("u"), F.col("m").alias("v"))
        .where("u != v")
        .distinct()
    )
    least = large.groupBy("u").agg(F.min("v").alias("m"))
    down = large.join(least, "u")
    small = down.where("v != m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return small.unionByName(least.select("u", F.col("m").alias("v"))).distinct()


def components(links: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(id, component) of every id in `links`: the smallest id that can be reached.

    Each step points every id at the smallest id around it; it ends when all components are
    stars. Minima are combined before they are shuffled, and no id's links meet in one row,
    so a hub may hold any share of them. Links with a null end are left out.
    """
    u, v = F.col(a).cast("long"), F.col(b).cast("long")
    now = staged(
        links.where(u.isNotNull() & v.isNotNull() & (u != v))
        .select(F.greatest(u, v).alias("u"), F.least(u, v).alias("v"))
        .distinct()
    )
    state = None
    while True:
        seen = now.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if seen[0] == 0 or seen == state:
            break
        state, now = seen, staged(_stars(now))
    stars = now.select(F.col("u").alias("id"), F.col("v").alias("component"))
    return stars.unionByName(now.select(F.col("v").alias("id"), F.col("v").alias("component")).distinct())

"""Connected components of an edge table, within keys."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyline.session import pin


def components(edges: DataFrame, keys: Sequence[str], a: str, b: str, name: str = "component") -> DataFrame:
    """(keys, node, name): every node of the edges ``a`` - ``b`` with the smallest node it is connected with.

    Each round hands every node the smallest name around it, then the name that this one has got by now, so
    that names travel ever farther; it ends when no name changes, after about log2 of the longest path. A
    node's neighbours are folded by a partial minimum, so a node of any degree spreads over the map tasks.
    Edges with a NULL end or key are left out.
    """
    keys = list(keys)
    plain = edges.select(*keys, F.col(a).alias("_a"), F.col(b).alias("_b")).dropna()
    both = pin(plain.unionByName(plain.select(*keys, F.col("_b").alias("_a"), F.col("_a").alias("_b"))).distinct())
    label = both.groupBy(*keys, F.col("_a").alias("node")).agg(F.least(F.min("_b"), F.first("_a")).alias(name))
    label = pin(label)
    while True:
        near = (
            both.join(label.withColumnRenamed("node", "_b"), [*keys, "_b"])
            .groupBy(*keys, F.col("_a").alias("node"))
            .agg(F.min(name).alias("_near"))
        )
        step = label.join(near, [*keys, "node"]).select(
            *keys, "node", F.col(name).alias("_old"), F.least(name, "_near").alias("_to")
        )
        jump = label.select(*keys, F.col("node").alias("_to"), F.col(name).alias("_far"))
        moved = pin(step.join(jump, [*keys, "_to"]).select(*keys, "node", "_old", F.least("_to", "_far").alias(name)))
        label = moved.drop("_old")
        if moved.where(F.col("_old") != F.col(name)).isEmpty():
            return label

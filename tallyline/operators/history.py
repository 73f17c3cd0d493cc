"""State before each row: the one history operator everything else is built on.

``running`` gives every row sums, counts, last-n sums and last known values over
the rows of the same key that come earlier. Rows for which ``counts`` is false
(requests, contests without a result) see the history without adding to it.

Each key is one window partition, which is a single shuffle. A key that holds
more rows than a task should sort is cut by time into chunks: each chunk is
windowed on its own and a small carry table (one row per chunk of a hot key)
brings in what happened in the chunks before it. Both ways give the same rows.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DataType

from tallyline.operators.sizing import hot_keys, with_chunk

Spec = Mapping[str, Column]


def running(
    df: DataFrame,
    keys: Sequence[str],
    order: Sequence[str],
    *,
    totals: Spec | None = None,
    recent: Mapping[str, tuple[Column, int]] | None = None,
    latest: Spec | None = None,
    counts: Column | None = None,
    include_current: bool = False,
    max_rows: int | None = None,
    cut: bool = False,
) -> DataFrame:
    """Add history columns to ``df``.

    ``totals``: name -> value summed over all earlier counting rows (0 if none).
    ``recent``: name -> (value, n) summed over the last n counting rows.
    ``latest``: name -> value of the last counting row where it is not NULL.
    ``order`` must be a total order inside a key; keys that are too big are cut along it. ``cut``: that is
    done, ``df`` has the pieces of ``with_chunk`` for the same order and these keys or some of them.
    """
    totals, recent, latest = dict(totals or {}), dict(recent or {}), dict(latest or {})
    values = {
        **{f"_v_{n}": c for n, c in totals.items()},
        **{f"_v_{n}": c for n, (c, _) in recent.items()},
        **{f"_v_{n}": c for n, c in latest.items()},
    }
    names = list(df.columns)
    staged = df.select("*", (F.lit(True) if counts is None else counts).alias("_counts"))
    staged = staged.select(
        "*", *[F.when(F.col("_counts"), c).alias(name) for name, c in values.items()]
    )
    found = None if cut else hot_keys(staged, keys, max_rows)
    every_row_counts = counts is None
    if found is None and not cut:
        out = _windowed(
            staged, list(keys), order, totals, recent, latest, every_row_counts, include_current
        )
        return out.select(*names, *totals, *recent, *latest)

    if not cut:
        staged = with_chunk(staged, keys, order, *found, max_rows)
    carry = _carry(staged, list(keys), order, totals, recent, latest)
    out = _windowed(
        staged, [*keys, "_chunk"], order, totals, recent, latest, every_row_counts, include_current
    )
    # One row per piece: as many as rows / max_rows, so whether to broadcast it is left to its size.
    out = out.join(carry, [*keys, "_chunk"], "left")
    added: list[Column] = []
    for name in totals:
        added.append((F.col(name) + F.coalesce(F.col(f"_c_{name}"), F.lit(0))).alias(name))
    for name, (_, n) in recent.items():
        missing = F.greatest(F.lit(n) - F.col("_seen"), F.lit(0)).cast("int")
        tail = F.col("_tail").getField(f"_v_{name}")
        from_end = F.slice(
            tail, F.greatest(F.size(tail) - missing, F.lit(0)) + 1, F.greatest(missing, F.lit(1))
        )
        # In the sum's own type, so that long and decimal sums are as exact as unsplit ones.
        kind = out.schema[name].dataType
        zero = F.lit(0).cast(kind)
        extra = F.when(F.col("_tail").isNotNull() & (missing > 0), _sum(from_end, kind)).otherwise(zero)
        added.append((F.col(name) + extra).cast(kind).alias(name))
    for name in latest:
        added.append(F.coalesce(F.col(name), F.col(f"_c_{name}")).alias(name))
    return out.select(*names, *added)


def _sum(values: Column, kind: DataType) -> Column:
    zero = F.lit(0).cast(kind)
    return F.aggregate(values, zero, lambda acc, v: (acc + F.coalesce(v.cast(kind), zero)).cast(kind))


def _windowed(df, keys, order, totals, recent, latest, every_row_counts, include_current):
    by_order = Window.partitionBy(*keys).orderBy(*order)
    until = 0 if include_current else -1
    frame = by_order.rowsBetween(Window.unboundedPreceding, until)
    earlier = by_order.rowsBetween(Window.unboundedPreceding, -1)
    added = [
        F.coalesce(F.sum(f"_v_{n}").over(frame), F.lit(0)).alias(n) for n in totals
    ]
    added += [F.last(f"_v_{n}", ignorenulls=True).over(frame).alias(n) for n in latest]
    if recent:
        counted = F.col("_counts").cast("long")
        added.append(F.coalesce(F.sum(counted).over(earlier), F.lit(0)).alias("_pos"))
    out = df.select("*", *added)
    if not recent:
        return out
    if every_row_counts:
        def last_n(n):
            return by_order.rowsBetween(-n + 1 if include_current else -n, until)
    else:
        # Counting row i sits at 2i, a row between i and i+1 at 2i+1: a range
        # over these places holds exactly the last n counting rows.
        out = out.withColumn("_place", 2 * F.col("_pos") + F.when(F.col("_counts"), 2).otherwise(1))
        by_place = Window.partitionBy(*keys).orderBy("_place")

        def last_n(n):
            return by_place.rangeBetween(-2 * n + 1 if include_current else -2 * n, until)

    sums = [
        F.coalesce(F.sum(f"_v_{name}").over(last_n(n)), F.lit(0)).alias(name)
        for name, (_, n) in recent.items()
    ]
    seen = F.col("_pos") + (F.col("_counts").cast("long") if include_current else F.lit(0))
    return out.select("*", *sums, seen.alias("_seen"))


def _carry(staged, keys, order, totals, recent, latest):
    """State at the start of each chunk of each hot key."""
    chunked = staged.where("_hot")
    hot = chunked.where("_counts")
    group = [*keys, "_chunk"]
    moment = F.struct(*order)
    aggs = [F.sum(f"_v_{n}").alias(f"_c_{n}") for n in totals]
    aggs += [
        F.max_by(f"_v_{n}", F.when(F.col(f"_v_{n}").isNotNull(), moment)).alias(f"_c_{n}")
        for n in latest
    ]
    state = hot.groupBy(*group).agg(F.count(F.lit(1)).alias("_n"), *aggs)
    depth = max((n for _, n in recent.values()), default=0)
    if depth:
        newest = Window.partitionBy(*group).orderBy(*[F.col(c).desc() for c in order])
        tail = (
            hot.withColumn("_back", F.row_number().over(newest))
            .where(F.col("_back") <= depth)
            .groupBy(*group)
            .agg(
                F.array_sort(
                    F.collect_list(
                        F.struct((-F.col("_back")).alias("_at"), *[f"_v_{n}" for n in recent])
                    )
                ).alias("_tail")
            )
        )
        state = state.join(tail, group, "left")
    over_chunks = Window.partitionBy(*keys).orderBy("_chunk")
    upto = over_chunks.rowsBetween(Window.unboundedPreceding, 0)
    cumulative = [F.sum(f"_c_{n}").over(upto).alias(f"_c_{n}") for n in totals]
    cumulative += [F.last(f"_c_{n}", True).over(upto).alias(f"_c_{n}") for n in latest]
    if depth:
        joined = F.flatten(F.collect_list("_tail").over(over_chunks.rowsBetween(-depth, 0)))
        cumulative.append(
            F.slice(joined, F.greatest(F.size(joined) - depth, F.lit(0)) + 1, depth).alias("_tail")
        )
    state = state.select(*group, *cumulative)
    # A chunk without counting rows has no state of its own, so start from the
    # full list of chunks and take the last state before each.
    chunks = chunked.select(*group).distinct()
    before = over_chunks.rowsBetween(Window.unboundedPreceding, -1)
    columns = [c for c in state.columns if c not in group]
    return chunks.join(state, group, "left").select(
        *group, *[F.last(c, True).over(before).alias(c) for c in columns]
    )

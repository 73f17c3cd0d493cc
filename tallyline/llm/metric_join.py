"""Near-duplicate vectors by an exact range join in the angle between them.

Pivots part the vectors into cells, one for each label and nearest pivot. A vector also
visits every cell in which the triangle inequality leaves room for a partner: its angle to
that cell's pivot may exceed the angle to its own by twice the range at most. Cells are cut
into blocks and compared one by one. Vectors within half the range of their pivot all link
with each other by the same inequality and are counted without being compared, and equal
vectors are one vector with a multiplicity, so a large group of copies makes no pairs.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyline.llm.common import mapped
from tallyline.llm.components import components
from tallyline.session import staged

# Distinct vectors of the largest label for each pivot, and the bounds of their number.
CELL_VECTORS, FEWEST_PIVOTS, MOST_PIVOTS = 1_024, 4, 1_024
# Vectors from which pivots are picked, for each pivot.
SAMPLE = 8
# Members, and visitors, that one task compares.
BLOCK = 1_024
_EPS = 1e-9


def _units(vectors: DataFrame) -> DataFrame:
    """vec_id, label, key and unit (doubles as bytes; null where a vector links with nothing)."""

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        column, keys, units = batch.column(2), [], []
        flat = column.flatten()
        bad = np.zeros(len(flat) + 1, np.int64)
        bad[1:] = np.cumsum(flat.is_null().to_numpy(zero_copy_only=False))
        values = flat.fill_null(0).cast(pa.float64()).to_numpy()
        sizes = np.array([0 if x is None else x for x in pa.compute.list_value_length(column).to_pylist()], np.int64)
        ends = np.cumsum(sizes)
        for lo, hi, label in zip(ends - sizes, ends, batch.column(1).to_pylist()):
            x = values[lo:hi]
            with np.errstate(all="ignore"):
                top = np.abs(x).max(initial=0.0)
                norm = np.sqrt(((x / top) ** 2).sum()) * top if top else 0.0
            if label is None or bad[hi] > bad[lo] or not norm > 0 or not np.isfinite(norm):
                keys.append(None)
                units.append(None)
            else:
                unit = (x / norm + 0.0).tobytes()
                keys.append(xxhash.xxh3_128_digest(unit))
                units.append(unit)
        return pa.RecordBatch.from_arrays(
            [batch.column(0), batch.column(1), pa.array(keys, pa.binary()), pa.array(units, pa.binary())],
            ["vec_id", "label", "key", "unit"],
        )

    return mapped(vectors, run, "vec_id long, label string, key binary, unit binary")


def _pivots(classes: DataFrame, reach: float) -> dict[int, np.ndarray]:
    """Pivots by dimension, from a bounded sample, no two within `reach` of one another."""
    largest = classes.groupBy("label").count().agg(F.max("count")).first()[0] or 0
    wanted = min(MOST_PIVOTS, max(FEWEST_PIVOTS, -(-largest // CELL_VECTORS)))
    sample = classes.select("unit", "key").orderBy(F.xxhash64("key")).limit(SAMPLE * wanted).collect()
    chosen: dict[int, list[np.ndarray]] = {}
    for raw, _ in sample:
        x = np.frombuffer(raw)
        near = chosen.setdefault(len(x), [])
        if sum(map(len, chosen.values())) < wanted and all(x @ p < math.cos(reach) for p in near):
            near.append(x)
    return {size: np.array(found) for size, found in chosen.items() if found}


def _deal(classes: DataFrame, pivots: dict[int, np.ndarray], reach: float) -> DataFrame:
    """Every class in its cell and in those it must visit: label, size, cell, id, k, unit, home, core."""

    def run(batch: pa.RecordBatch) -> pa.Table | None:
        labels, ids, ks, raws = (batch.column(i) for i in range(4))
        bytes_ = raws.to_pylist()
        sizes = np.array([len(x) // 8 for x in bytes_])
        parts = []
        for size in np.unique(sizes):
            at = np.flatnonzero(sizes == size)
            if size in pivots:
                x = np.frombuffer(b"".join(bytes_[i] for i in at)).reshape(len(at), size)
                angle = np.arccos(np.clip(x @ pivots[size].T, -1, 1))
                own = angle.argmin(axis=1)
                nearest = angle[np.arange(len(at)), own]
                row, cell = np.nonzero(angle <= nearest[:, None] + 2 * reach + _EPS)
                core = nearest <= reach / 2 - _EPS
            else:
                row, cell, own = np.arange(len(at)), np.zeros(len(at), np.int64), np.zeros(len(at), np.int64)
                core = np.zeros(len(at), bool)
            home = cell == own[row]
            take = pa.array(at[row])
            parts.append(
                pa.Table.from_arrays(
                    [labels.take(take), pa.array(np.full(len(row), size, np.int32)), pa.array(cell.astype(np.int32)),
                     ids.take(take), ks.take(take), raws.take(take), pa.array(home), pa.array(home & core[row])],
                    ["label", "size", "cell", "id", "k", "unit", "home", "core"],
                )
            )
        return pa.concat_tables(parts) if parts else None

    return mapped(
        classes.select("label", "id", "k", "unit"),
        run,
        "label string, size int, cell int, id long, k long, unit binary, home boolean, core boolean",
    )


def _compare(groups: DataFrame, threshold: float) -> DataFrame:
    """(id, n, root): links found and a linked id, of members and visitors of each block."""

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        column = batch.column(0)
        flat, ends = column.flatten(), column.offsets.to_numpy() - column.offsets.to_numpy()[0]
        ids, ks = (flat.field(c).to_numpy(zero_copy_only=False) for c in ("id", "k"))
        member, asks, home, core = (
            flat.field(c).to_numpy(zero_copy_only=False).astype(bool) for c in ("member", "asks", "home", "core")
        )
        raw = flat.field("unit").to_pylist()
        out: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        for lo, hi in zip(ends[:-1], ends[1:]):
            m, q = lo + np.flatnonzero(member[lo:hi]), lo + np.flatnonzero(asks[lo:hi])
            if not len(m) or not len(q):
                continue
            x, y = (np.frombuffer(b"".join(raw[i] for i in some)).reshape(len(some), -1) for some in (q, m))
            link = (x @ y.T >= threshold) & (ids[q][:, None] != ids[m][None, :])
            found = link @ ks[m].astype(np.float64)
            # A member in the core does not ask; it learns of the others here.
            told = (link & home[q][:, None] & core[m][None, :]).T @ ks[q].astype(np.float64)
            root_q, root_m = ids[q].copy(), ids[m].copy()
            big = np.iinfo(np.int64).max
            while True:  # smallest id along links, until nothing moves
                next_q = np.minimum(root_q, np.where(link, root_m[None, :], big).min(axis=1))
                next_m = np.minimum(root_m, np.where(link, next_q[:, None], big).min(axis=0))
                if (next_q == root_q).all() and (next_m == root_m).all():
                    break
                root_q, root_m = next_q, next_m
            for some, n, root, seen in ((q, found, root_q, link.any(axis=1)), (m, told, root_m, link.any(axis=0))):
                out.append((ids[some][seen], n[seen].astype(np.int64), root[seen]))
        cat = [np.concatenate([o[k] for o in out]) if out else np.empty(0, np.int64) for k in range(3)]
        return pa.RecordBatch.from_arrays(list(map(pa.array, cat)), ["id", "n", "root"])

    return mapped(groups, run, "id long, n long, root long")


def linked_vectors(
    vectors: DataFrame, *, threshold: float = 0.93, id_col: str = "vec_id", vector_col: str = "embedding",
    label_col: str = "label",
) -> DataFrame:
    """vec_id, n_links, component_id and kept of every row.

    Two vectors of one label, not null, and of one dimension link when their cosine in double
    precision is at least `threshold`. n_links counts the other rows linked with a row,
    component_id is the smallest id reachable, kept says that it is the row's own. A vector
    that is null, zero, or holds a null or non-finite component links with nothing. Equal
    vectors of a label link, repeated rows too, and each counts. A null id has a null
    component and is kept. Ids are integers; other columns are not read.
    """
    reach = math.acos(threshold)
    rows = staged(
        _units(
            vectors.select(
                F.col(id_col).cast("long").alias("vec_id"), F.col(label_col).cast("string").alias("label"),
                F.col(vector_col).cast("array<double>").alias("vector"),
            )
        )
    )
    classes = staged(
        rows.where("key is not null")
        .groupBy("label", "key")
        .agg(F.min("vec_id").alias("id"), F.count("*").alias("k"), F.min("unit").alias("unit"))
        .where("id is not null")
    )
    dealt = staged(_deal(classes, _pivots(classes, reach), reach))
    cell = ["label", "size", "cell"]
    asking = ~F.col("core")
    sizes = dealt.groupBy(*cell).agg(
        F.ceil(F.count_if("home") / BLOCK).alias("blocks"),
        F.ceil(F.count_if(asking) / BLOCK).alias("parts"),
        F.sum(F.when(F.col("core"), F.col("k")).otherwise(0)).alias("core_k"),
        F.min(F.when(F.col("core"), F.col("id"))).alias("core_id"),
    )

    def all_of(n: str):
        return F.when(F.col(n) > 0, F.sequence(F.lit(0).cast("long"), F.col(n) - 1)).otherwise(F.array().cast("array<long>"))

    placed = (
        dealt.join(sizes.select(*cell, "blocks", "parts"), cell)
        .withColumn("block", F.pmod(F.xxhash64("id"), F.greatest("blocks", F.lit(1))))
        .withColumn("part", F.pmod(F.xxhash64("id", F.lit(1)), F.greatest("parts", F.lit(1))))
    )
    fields = ["id", "k", "unit", "home", "core"]
    as_member = placed.where("home").select(
        *cell, "block", F.explode(all_of("parts")).alias("part"), *fields, F.lit(True).alias("member"), F.lit(False).alias("asks")
    )
    as_visitor = placed.where(asking).select(
        *cell, F.explode(all_of("blocks")).alias("block"), "part", *fields, F.lit(False).alias("member"), F.lit(True).alias("asks")
    )
    groups = (
        as_member.unionByName(as_visitor)
        .groupBy(*cell, "block", "part")
        .agg(F.collect_list(F.struct(*fields, "member", "asks")).alias("rows"))
        .select("rows")
    )
    found = staged(_compare(groups, threshold))
    cores = dealt.where("core").join(sizes.select(*cell, "core_k", "core_id"), cell).select(
        "id", (F.col("core_k") - F.col("k")).alias("n"), F.col("core_id").alias("root")
    )
    links = found.unionByName(cores)
    roots = components(links.select(F.col("id").alias("a"), F.col("root").alias("b")))
    counts = links.groupBy("id").agg(F.sum("n").alias("n"))
    # Equal vectors may have one id in several labels; the key of a class is label and vector.
    known = (
        classes.select(F.col("label").alias("l"), F.col("key").alias("c"), "id", "k")
        .join(counts, "id", "left")
        .join(roots, "id", "left")
        .select("l", "c", (F.coalesce("n", F.lit(0)) + F.col("k") - 1).alias("n_links"), F.coalesce("component", "id").alias("root"))
    )
    return (
        rows.select("vec_id", "label", "key")
        .join(known, (F.col("label") == F.col("l")) & (F.col("key") == F.col("c")), "left")
        .select(
            "vec_id", F.coalesce("n_links", F.lit(0)).alias("n_links"), F.coalesce("root", "vec_id").alias("component_id")
        )
        .withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(True)))
    )

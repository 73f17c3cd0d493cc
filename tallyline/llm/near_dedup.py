"""Near duplicates on word shingles by HyperMinHash sketches.

A sketch keeps, for each of 256 buckets of shingle hashes, how many leading zeros the
smallest hash has and the bits that follow them. Bands of registers propose candidates, a
collision-corrected estimate drops the hopeless ones, full shingle sets decide the rest.

Candidates are never all pairs of a bucket. First every member meets one hub of its bucket.
When linked members are one component, only members outside the largest component go on;
they meet the others block by block, part by part. The Jaccard distance, which is a metric, excludes those
whose measured distance to the common hub differs by more than a link allows; for the others
what each set lacks of the hub's and has beside it gives their similarity exactly.
"""

from __future__ import annotations

from functools import lru_cache

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyline.llm.common import LOWER, mapped, mix, remembered, utf8
from tallyline.llm.components import components
from tallyline.session import staged

BUCKETS = 256
MANTISSA = 10
BANDS, ROWS = 24, 4
# Standard deviations by which an estimate may fall short of the threshold.
SLACK = 4.5
# Members of a bucket, and askers, that one group compares, and the bytes of either: long texts make smaller groups.
BLOCK = 512
BLOCK_BYTES = 2 << 20
# Hashed words that a worker keeps before it starts afresh.
CACHE_WORDS = 250_000

_K = mix(np.arange(1, 65, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)) | np.uint64(1)
_ORDER = np.argsort(
    mix(np.arange(BUCKETS * BUCKETS, dtype=np.uint64) + np.uint64(77)).reshape(BUCKETS, BUCKETS), axis=1
)


class _Hashes(dict):
    def __missing__(self, word: bytes) -> int:
        if len(self) > CACHE_WORDS:
            self.clear()
        self[word] = h = xxhash.xxh3_64_intdigest(word)
        return h


def shingles(text: str | None, size: int) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the runs of `size` words, of all words if there are fewer."""
    words = utf8(text).translate(LOWER).split()
    if not words:
        return np.empty(0, np.uint64)
    known = remembered("hashed words", _Hashes)
    h = np.fromiter(map(known.__getitem__, words), np.uint64, len(words))
    if len(h) < size:
        return mix(np.sum(h * _K[: len(h)], keepdims=True) + _K[62 - len(h) :][:1])
    n = len(h) - size + 1
    s = np.zeros(n, np.uint64)
    for k in range(size):
        s += h[k : k + n] * _K[k]
    return np.unique(mix(s))


def registers(hashes: np.ndarray) -> np.ndarray:
    """The sketch of sorted hashes: 256 registers of leading zeros and mantissa; empty buckets borrow."""
    first = np.searchsorted(hashes, np.arange(BUCKETS, dtype=np.uint64) << np.uint64(56))
    held = np.diff(np.append(first, len(hashes))) > 0
    rest = (hashes[np.minimum(first, len(hashes) - 1)] << np.uint64(8)) | np.uint64(1)
    # The shift keeps 53 bits, so that a double holds them exactly.
    zeros = (53 - np.frexp((rest >> np.uint64(11)).astype(np.float64) + 0.5)[1]).clip(0, 53).astype(np.uint64)
    bits = (rest << (zeros + np.uint64(1))) >> np.uint64(64 - MANTISSA)
    out = (zeros << np.uint64(MANTISSA) | bits).astype(np.uint16)
    if not held.all():
        empty = np.flatnonzero(~held)
        seen = held[_ORDER[empty]]
        out[empty] = out[_ORDER[empty, seen.argmax(axis=1)]]
    return out


@lru_cache(4096)
def _collision(per_bucket: int) -> float:
    """Chance that the registers of two unrelated sets of this many hashes a bucket agree."""
    k = np.arange(54)
    p = (1 - 2.0 ** -(k + 1)) ** per_bucket - (1 - 2.0**-k) ** per_bucket
    return float((np.abs(p) ** 2).sum() / 2**MANTISSA)


def estimate(equal: np.ndarray, n: np.ndarray) -> np.ndarray:
    """Jaccard similarity from the share of equal registers, without accidental agreements."""
    chance = np.array([_collision(int(max(1, x // BUCKETS))) for x in np.ravel(n)]).reshape(np.shape(n))
    return (equal - chance) / (1 - chance)


def _floor(threshold: float, n: np.ndarray) -> np.ndarray:
    return threshold - SLACK * np.sqrt(threshold * (1 - threshold) / np.minimum(n, BUCKETS))


def sketches(docs: DataFrame, size: int, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_shingles, set_hash (null for an empty set) and registers of every row."""

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        n, names, regs = [], [], []
        for text in batch.column(1).to_pylist():
            s = shingles(text, size)
            n.append(len(s))
            names.append(xxhash.xxh3_128_digest(s.tobytes()) if len(s) else None)
            regs.append(registers(s).tobytes() if len(s) else None)
        return pa.RecordBatch.from_arrays(
            [batch.column(0), pa.array(n, pa.int64()), pa.array(names, pa.binary()), pa.array(regs, pa.binary())],
            ["doc_id", "n_shingles", "set_hash", "registers"],
        )

    chosen = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    return mapped(chosen, run, "doc_id long, n_shingles long, set_hash binary, registers binary")


def _bands(sets: DataFrame) -> DataFrame:
    """(band, id) for every band of every sketch."""

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        m = batch.num_rows
        regs = np.frombuffer(b"".join(batch.column(1).to_pylist()), np.uint16).reshape(m, BUCKETS)
        keys = np.ascontiguousarray(regs[:, : BANDS * ROWS]).view(np.uint64)
        keys = mix(mix(keys) + np.arange(BANDS, dtype=np.uint64) * _K[0]).view(np.int64)
        ids = np.repeat(batch.column(0).to_numpy(), BANDS)
        return pa.RecordBatch.from_arrays([pa.array(keys.ravel()), pa.array(ids)], ["band", "id"])

    return mapped(sets.select("id", "registers"), run, "band long, id long")


def _hopeful(pairs: DataFrame, sets: DataFrame, threshold: float) -> DataFrame:
    """The pairs (a, b) whose sizes and sketches do not exclude a link."""

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        m = batch.num_rows
        x, y = (
            np.frombuffer(b"".join(batch.column(k).to_pylist()), np.uint16).reshape(m, BUCKETS) for k in (2, 3)
        )
        n = np.maximum(batch.column(4).to_numpy(), batch.column(5).to_numpy())
        ok = estimate((x == y).mean(axis=1), n) >= _floor(threshold, n)
        return batch.select([0, 1]).filter(pa.array(ok))

    one = sets.select(F.col("id").alias("a"), F.col("registers").alias("x"), F.col("n").alias("n_a"))
    two = sets.select(F.col("id").alias("b"), F.col("registers").alias("y"), F.col("n").alias("n_b"))
    near = (
        pairs.join(one, "a")
        .join(two, "b")
        .where(F.least("n_a", "n_b") >= threshold * F.greatest("n_a", "n_b") - 1e-6)
        .select("a", "b", "x", "y", "n_a", "n_b")
    )
    return mapped(near, run, "a long, b long")


def _verify(pairs: DataFrame, full: DataFrame) -> DataFrame:
    """(a, b, common, total) of the full sets of each pair."""

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        common, total = [], []
        for x, y in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist()):
            x, y = np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64)
            both = len(np.intersect1d(x, y, assume_unique=True))
            common.append(both)
            total.append(len(x) + len(y) - both)
        return pa.RecordBatch.from_arrays(
            [batch.column(0), batch.column(1), pa.array(common, pa.int64()), pa.array(total, pa.int64())],
            ["a", "b", "common", "total"],
        )

    one = full.select(F.col("id").alias("a"), F.col("hashes").alias("x"))
    two = full.select(F.col("id").alias("b"), F.col("hashes").alias("y"))
    return mapped(
        pairs.join(one, "a").join(two, "b").select("a", "b", "x", "y"), run, "a long, b long, common long, total long"
    )


def _measure(stars: DataFrame, full: DataFrame) -> DataFrame:
    """(id, hub, common, total, lost, extra): the full sets compared, and how a set differs from its hub's."""

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        common, total, lost, extra = [], [], [], []
        for x, h in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist()):
            x, h = np.frombuffer(x, np.uint64), np.frombuffer(h, np.uint64)
            lost.append(np.setdiff1d(h, x, assume_unique=True))
            extra.append(np.setdiff1d(x, h, assume_unique=True))
            common.append(len(h) - len(lost[-1]))
            total.append(len(h) + len(extra[-1]))
        return pa.RecordBatch.from_arrays(
            [batch.column(0), batch.column(1), pa.array(common, pa.int64()), pa.array(total, pa.int64()),
             pa.array([v.tobytes() for v in lost], pa.binary()), pa.array([v.tobytes() for v in extra], pa.binary())],
            ["id", "hub", "common", "total", "lost", "extra"],
        )

    one = full.select("id", F.col("hashes").alias("x"))
    two = full.select(F.col("id").alias("hub"), F.col("hashes").alias("h"))
    pairs = stars.join(one, "id").join(two, "hub").select("id", "hub", "x", "h")
    return mapped(pairs, run, "id long, hub long, common long, total long, lost binary, extra binary")


class _Differences:
    """How the sets of a batch's rows differ from their hub's; rows without that are unknown."""

    def __init__(self, flat: pa.StructArray, n: np.ndarray) -> None:
        raw = [flat.field(k).to_pylist() for k in ("lost", "extra")]
        self.known = np.array([x is not None for x in raw[0]], bool)
        self.sets = [[np.frombuffer(x or b"", np.uint64) for x in column] for column in raw]
        self.sizes = [np.array([len(x) for x in column], np.int64) for column in self.sets]
        self.hub = n + self.sizes[0] - self.sizes[1]

    def common(self, one: int, others: np.ndarray) -> np.ndarray:
        """Sizes of the intersections of a row's set with those of others of its hub."""
        both = []
        for sets, sizes in zip(self.sets, self.sizes):
            owner = np.repeat(np.arange(len(others)), sizes[others])
            flat = np.concatenate([sets[i] for i in others]) if len(others) else np.empty(0, np.uint64)
            both.append(np.bincount(owner, np.isin(flat, sets[one]), len(others)).astype(np.int64))
        lost, extra = both
        return self.hub[one] - (self.sizes[0][one] + self.sizes[0][others] - lost) + extra


def _dealt(members: DataFrame, facts: DataFrame) -> DataFrame:
    """Rows of mixed buckets by (band, block, part), with the facts: about `BLOCK`, of about `BLOCK_BYTES`, at home there and as many that ask.

    Every member outside its bucket's largest component asks: it goes to all blocks in its own
    part. Every member is at home in its own block, in all parts. So each asker meets each
    other member in one group, and no group grows with its bucket.
    """
    weight = F.lit(2 * BUCKETS) + F.coalesce(F.length("lost"), F.lit(0)) + F.coalesce(F.length("extra"), F.lit(0))
    weighed = members.join(facts.select("id", "hub", weight.alias("bytes")), ["id", "hub"])
    sizes = weighed.groupBy("band", "component").agg(F.count("*").alias("k"), F.sum("bytes").alias("bytes"))
    main = sizes.groupBy("band").agg(
        F.max(F.struct("k", "component", "bytes")).alias("main"), F.count("*").alias("n"), F.sum("k").alias("k"), F.sum("bytes").alias("bytes")
    ).where("n > 1")

    def groups(rows, bytes_):
        return F.greatest(F.ceil(rows / BLOCK), F.ceil(bytes_ / BLOCK_BYTES))

    main = main.select(
        "band", F.col("main.component").alias("main"), groups(F.col("k"), F.col("bytes")).alias("blocks"),
        groups(F.col("k") - F.col("main.k"), F.col("bytes") - F.col("main.bytes")).alias("parts"),
    )
    asks = F.col("component") != F.col("main")
    # Sketches and sets join the members of mixed buckets only.
    placed = members.join(main, "band").join(facts, ["id", "hub"]).select(
        "band", "id", "component", "n", "registers", "far", "lost", "extra", "blocks", "parts", asks.alias("asking"),
        F.pmod(F.xxhash64("id"), "blocks").alias("own_block"), F.pmod(F.xxhash64("id", F.lit(1)), "parts").alias("own_part"),
    )

    def numbers(n: str):
        return F.sequence(F.lit(0).cast("long"), F.col(n) - 1)

    home = F.transform(numbers("parts"), lambda p: F.struct(F.col("own_block").alias("block"), p.alias("part")))
    sent = F.transform(numbers("blocks"), lambda b: F.struct(b.alias("block"), F.col("own_part").alias("part")))
    places = F.when(F.col("asking"), F.array_union(home, sent)).otherwise(home)
    return placed.withColumn("place", F.explode(places)).select(
        "band", "place.block", "place.part", "id", "component", "n", "registers", "far", "lost", "extra",
        (F.col("asking") & (F.col("place.part") == F.col("own_part"))).alias("asks"),
        (F.col("place.block") == F.col("own_block")).alias("home"),
    )


def _outside(members: DataFrame, facts: DataFrame, threshold: float) -> DataFrame:
    """Links between components of a bucket, and pairs that may link: (a, b, sure).

    `members`: band, id, component, hub; `facts`: id, hub, n, registers, far (the distance to
    the hub), lost and extra, null where they were not measured. Of the sure links of a row
    with one component, one is given.
    """

    def run(batch: pa.RecordBatch) -> pa.Table:
        # One group at a time: a batch holds many, and theirs would all be Python objects at once.
        return pa.Table.from_batches([compared(batch.slice(k, 1)) for k in range(batch.num_rows)])

    def compared(batch: pa.RecordBatch) -> pa.RecordBatch:
        column = batch.column(0)
        flat, ends = column.flatten(), column.offsets.to_numpy() - column.offsets.to_numpy()[0]
        ids, comp, n = (flat.field(k).to_numpy(zero_copy_only=False) for k in ("id", "component", "n"))
        asks, home = (flat.field(k).to_numpy(zero_copy_only=False).astype(bool) for k in ("asks", "home"))
        far = flat.field("far").to_numpy(zero_copy_only=False).astype(np.float64)
        regs = np.frombuffer(b"".join(flat.field("registers").to_pylist()), np.uint16).reshape(-1, BUCKETS)
        differ = _Differences(flat, n)
        found: list[tuple[np.ndarray, np.ndarray, bool]] = []
        for lo, hi in zip(ends[:-1], ends[1:]):
            t = lo + np.flatnonzero(home[lo:hi])
            for one in lo + np.flatnonzero(asks[lo:hi]):
                ok = (comp[t] != comp[one]) & ~(np.abs(far[t] - far[one]) > 1 - threshold + 1e-9)
                ok &= np.minimum(n[t], n[one]) >= threshold * np.maximum(n[t], n[one]) - 1e-6
                others = t[ok]
                size = np.maximum(n[others], n[one])
                good = estimate((regs[others] == regs[one]).mean(axis=1), size) >= _floor(threshold, size)
                others = others[good]
                exact = others[differ.known[others]] if differ.known[one] else others[:0]
                if len(exact):
                    both = differ.common(one, exact)
                    linked = exact[both >= threshold * (n[exact] + n[one] - both) - 1e-9]
                    linked = linked[np.unique(comp[linked], return_index=True)[1]]
                    found.append((np.full(len(linked), ids[one]), ids[linked], True))
                open_ = others if not differ.known[one] else others[~differ.known[others]]
                found.append((np.full(len(open_), ids[one]), ids[open_], False))
        a, b = (np.concatenate([f[k] for f in found]) if found else np.empty(0, np.int64) for k in (0, 1))
        sure = np.concatenate([np.full(len(f[0]), f[2]) for f in found]) if found else np.empty(0, bool)
        return pa.RecordBatch.from_arrays(
            [pa.array(np.minimum(a, b)), pa.array(np.maximum(a, b)), pa.array(sure)], ["a", "b", "sure"]
        )

    grouped = _dealt(members, facts).groupBy("band", "block", "part").agg(
        F.collect_list(F.struct("id", "component", "n", "registers", "far", "lost", "extra", "asks", "home")).alias("rows")
    )
    return mapped(grouped.select("rows"), run, "a long, b long, sure boolean").distinct()


def duplicate_classes(
    docs: DataFrame, *, size: int = 5, threshold: float = 0.8, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """doc_id, n_shingles, component_id and kept of every row.

    Two documents link when their sets of distinct `size`-word shingles have a Jaccard
    similarity of at least `threshold`; component_id is the smallest id reachable by links.
    A null or blank text has no words and links with nothing; a text of fewer words than a
    shingle is one shingle. Rows that share an id are one document, which has the links of
    all its texts. A row with a null id gets a null component and is kept. An empty table
    gives an empty result. Ids are integers; other columns are not read.
    """
    sk = staged(sketches(docs, size, id_col, text_col))
    sets = staged(
        sk.where(F.col("set_hash").isNotNull() & F.col("doc_id").isNotNull())
        .groupBy("set_hash")
        .agg(F.min("doc_id").alias("id"), F.min("n_shingles").alias("n"), F.min("registers").alias("registers"))
    )
    # A set of fewer than threshold / (1 - threshold) shingles links with equal sets only.
    fewest = int(np.ceil(threshold / (1 - threshold) - 1e-9))
    bands = _bands(sets.where(F.col("n") >= fewest))
    shared = bands.groupBy("band").agg(F.count("*").alias("k")).where("k > 1").select("band")
    members = staged(bands.join(shared, "band"))
    degree = members.groupBy("id").agg(F.count("*").alias("degree"))
    hubs = staged(
        members.join(degree, "id")
        .groupBy("band")
        .agg((-F.max(F.struct("degree", (-F.col("id")).alias("id")))["id"]).alias("hub"))
    )
    # The hashed sets of all documents that share a band, from their texts.
    texts = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))

    def hashed(batch: pa.RecordBatch) -> pa.RecordBatch:
        found = [shingles(t, size).tobytes() for t in batch.column(1).to_pylist()]
        return pa.RecordBatch.from_arrays([batch.column(0), pa.array(found, pa.binary())], ["id", "hashes"])

    full = staged(
        mapped(texts.join(degree.select("id"), "id", "left_semi"), hashed, "id long, hashes binary")
        .where(F.length("hashes") > 0)
        .dropDuplicates()
    )
    met = members.join(hubs, "band")
    stars = met.where("id != hub").select("id", "hub").distinct()
    hopeful = _hopeful(stars.select(F.col("id").alias("a"), F.col("hub").alias("b")), sets, threshold)
    measured = staged(_measure(hopeful.select(F.col("a").alias("id"), F.col("b").alias("hub")), full))
    enough = F.col("common") >= threshold * F.col("total") - 1e-9
    first = staged(components(measured.where(enough), "id", "hub"))
    # A hub differs from itself in nothing.
    itself = hubs.select(F.col("hub").alias("id"), "hub").distinct().select(
        "id", "hub", F.lit(0.0).alias("far"), F.lit(b"").alias("lost"), F.lit(b"").alias("extra")
    )
    differ = measured.select("id", "hub", (1 - F.col("common") / F.col("total")).alias("far"), "lost", "extra").unionByName(itself)
    facts = (
        met.select("id", "hub").distinct().join(differ, ["id", "hub"], "left").join(sets.select("id", "n", "registers"), "id")
    )
    placed = met.join(first, "id", "left").select("band", "id", F.coalesce("component", "id").alias("component"), "hub")
    outside = staged(_outside(placed, facts, threshold))
    known = measured.select(F.least("id", "hub").alias("a"), F.greatest("id", "hub").alias("b"))
    rest = outside.where(~F.col("sure")).select("a", "b").join(known, ["a", "b"], "left_anti")
    second = _verify(rest, full).where(enough).select("a", "b").unionByName(outside.where("sure").select("a", "b"))
    # Copies with equal sets, and texts that share an id, hang on the smallest id of their set.
    copies = sk.join(sets.select("set_hash", F.col("id").alias("rep")), "set_hash").select("doc_id", "rep").distinct()
    shared_ids = copies.groupBy("doc_id").agg(F.min("rep").alias("a"), F.max("rep").alias("b")).where("a != b")
    spread = copies.join(shared_ids.select("doc_id"), "doc_id", "left_semi").select(
        F.col("doc_id").alias("a"), F.col("rep").alias("b")
    )
    final = staged(components(first.select(F.col("id").alias("a"), F.col("component").alias("b")).unionByName(second).unionByName(spread)))
    return (
        sk.select("doc_id", "n_shingles", "set_hash")
        .join(sets.select("set_hash", F.col("id").alias("rep")), "set_hash", "left")
        .join(final.withColumnRenamed("id", "rep"), "rep", "left")
        .select("doc_id", "n_shingles", F.coalesce("component", "rep", "doc_id").alias("component_id"))
        .withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)))
    )

"""Divergence of sources: how differently the sources of a language use its terms.

Tasks cut whole texts into terms, pack them into machine words by length, sort each length
bucket (radix for packed words, bytes for longer ones) and count runs, so that only one row for
each language, source and term of a batch leaves a task. Sums of these rows give the terms that
a language keeps; smoothed shares of kept terms are compared source by source in blocks of
sources and slices of terms. All arithmetic is in integers.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tallyline.llm.packed import Terms, byte_class, chunks, sorted_order, spelled
from tallyline.session import staged

# Sources that are compared with as many others in one group, and counted rows of a slice of terms.
BLOCK_SOURCES = 128
SLICE_ROWS = 100_000
# Cells of the table of shares that a task fills at once.
CELLS = 1 << 21
LETTERS = byte_class(letters=True, digits=False)
COUNTS = "lang string, source string, term string, n long, docs long"
ONE = 1_000_000_000


def counted_runs(terms: Terms, group: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of one length bucket: where in it each run of a (term, group) lies, its length, its number of texts.

    `group` gives the group of each text, an unsigned 16-bit number: a batch has fewer rows than that.
    """
    if not len(terms.first):
        none = np.zeros(0, np.int64)
        return none, none, none
    of = group[terms.text]
    order = sorted_order(terms, np.argsort(of, kind="stable"))
    fresh = np.ones(len(order), bool)
    fresh[1:] = (terms.first[order[1:]] != terms.first[order[:-1]]) | (of[order[1:]] != of[order[:-1]])
    if terms.second is not None:
        fresh[1:] |= terms.second[order[1:]] != terms.second[order[:-1]]
    runs = np.flatnonzero(fresh)
    text = terms.text[order]
    fresh[1:] |= text[1:] != text[:-1]
    return order[runs], np.diff(runs, append=len(order)), np.add.reduceat(fresh, runs, dtype=np.int64)


def term_counts(docs: DataFrame) -> DataFrame:
    """lang, source, term, n, docs: how often a term occurs there and in how many rows.

    Null lang, source and text are ''. Each group that occurs also has a row with a null term, which
    counts its rows; an empty table gives no rows. Columns besides lang, source and text are not read.
    """

    def count(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            names: dict[tuple[str, str], int] = {}
            pairs = zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True)
            codes = np.array([names.setdefault(pair, len(names)) for pair in pairs], np.uint16)
            rows = np.bincount(codes, minlength=len(names))
            yield rows_of(names, [(np.arange(len(names)), [None] * len(names), rows, rows)])
            for chunk in chunks(batch.column(2), LETTERS):
                group, parts = codes[chunk.low : chunk.high], []
                for bucket in (chunk.one, chunk.two, *chunk.longer):
                    at, n, texts = counted_runs(bucket, group)
                    parts.append((group[bucket.text[at]], spelled(bucket, at), n, texts))
                yield rows_of(names, parts)

    def rows_of(names: dict[tuple[str, str], int], parts: list[tuple]) -> pa.RecordBatch:
        which = pa.array(np.concatenate([p[0] for p in parts]))
        return pa.record_batch(
            {
                "lang": pa.array([x[0] for x in names], pa.string()).take(which),
                "source": pa.array([x[1] for x in names], pa.string()).take(which),
                "term": pa.array([x for p in parts for x in p[1]], pa.binary()).cast(pa.string()),
                "n": pa.array(np.concatenate([p[2] for p in parts]), pa.int64()),
                "docs": pa.array(np.concatenate([p[3] for p in parts]), pa.int64()),
            }
        )

    read = docs.select(*(F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in ("lang", "source", "text")))
    counted = read.mapInArrow(count, COUNTS).groupBy("lang", "source", "term")
    return counted.agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))


def _share(count: str, total: str, kept: str):
    """1 + floor(10^9 * (count + 5) / (total + 5 * kept)), exact for any counts."""
    return F.expr(
        f"1 + (CAST({ONE} AS DECIMAL(10,0)) * CAST({count} + 5 AS DECIMAL(20,0))) div CAST({total} + 5 * {kept} AS DECIMAL(28,0))"
    )


def _block_pairs(group: pa.Table) -> pa.Table:
    """Sums of differences over one slice of terms, of all sources of one block with those of another.

    Rows with a null term tell a source's share of a term that it lacks; a pair within a block
    comes out in both orders, a pair of two blocks as well.
    """
    low, high = group.column("low")[0].as_py(), group.column("high")[0].as_py()
    block = group.column("block").to_numpy()
    source = group.column("source").to_pylist()
    share = group.column("p").to_numpy()
    codes = group.column("term").combine_chunks().dictionary_encode().indices
    plain = np.array(codes.is_null())
    codes = codes.fill_null(-1).to_numpy()
    bare = np.flatnonzero(plain)
    sides = []
    for b in (low, high):
        mine = bare[block[bare] == b]
        sides.append([source[i] for i in mine])
    place = {s: k for k, s in enumerate(sides[0])} | {s: len(sides[0]) + k for k, s in enumerate(sides[1]) if low != high}
    n_left, n_all = len(sides[0]), len(place)
    missing = np.zeros(n_all, np.int64)
    for i in bare:
        missing[place[source[i]]] = share[i]
    full = np.flatnonzero(~plain)
    order = full[np.argsort(codes[full], kind="stable")]
    terms, column, value = codes[order], np.array([place[source[i]] for i in order], np.int64), share[order]
    n_terms = int(terms[-1]) + 1 if len(terms) else 0
    right = slice(0, n_left) if low == high else slice(n_left, n_all)
    sums = np.zeros((n_left, n_left if low == high else n_all - n_left), np.int64)
    step = max(1, CELLS // max(n_all, 1))
    for begin in range(0, n_terms, step):
        a, b = np.searchsorted(terms, [begin, begin + step])
        table = np.repeat(missing[:, None], min(step, n_terms - begin), axis=1)
        table[column[a:b], terms[a:b] - begin] = value[a:b]
        for k in range(n_left):
            sums[k] += np.abs(table[right] - table[k]).sum(axis=1)
    # Terms that neither block has differ as well: all are added in the first slice, those seen are taken off in each.
    unseen = (group.column("v")[0].as_py() if group.column("slice")[0].as_py() == 0 else 0) - n_terms
    sums += unseen * np.abs(missing[right][None, :] - missing[:n_left, None])
    left_names, right_names = sides[0], sides[0] if low == high else sides[1]
    mine, other = np.indices(sums.shape).reshape(2, -1)
    flat = sums.ravel()
    if low == high:
        keep = mine != other
        mine, other, flat = mine[keep], other[keep], flat[keep]
    a, b = pa.array(left_names, pa.string()).take(pa.array(mine)), pa.array(right_names, pa.string()).take(pa.array(other))
    out = pa.table({"source": a, "item": b, "value": pa.array(flat, pa.int64())})
    if low != high:
        out = pa.concat_tables([out, pa.table({"source": b, "item": a, "value": out.column("value")})])
    lang = pa.array([group.column("lang")[0].as_py()] * out.num_rows, pa.string())
    return out.add_column(0, "lang", lang)


def source_divergence(docs: DataFrame, *, least_docs: int = 30, top_terms: int = 50) -> DataFrame:
    """lang, source, part, item, value, rank: distances between sources, and the terms a source overuses.

    Part 'pair' compares a source with each other source of its language over all terms that occur in
    `least_docs` rows of the language; part 'term' has the `top_terms` terms a source has most beyond its
    language. Equal values rank by the UTF-8 bytes of the item. Null lang, source or text is ''. A language
    that keeps no term has pairs of value 0; a lone source has none. Repeated rows count
    each. An empty table gives no rows; other columns are not read.
    """
    counts = staged(term_counts(docs))
    by_term = Window.partitionBy("lang", "term")
    kept = staged(
        counts.where("term IS NOT NULL")
        .withColumns(
            {"all_docs": F.sum("docs").over(by_term), "total": F.sum("n").over(by_term), "least": F.min("source").over(by_term)}
        )
        .where(F.col("all_docs") >= least_docs)
        .select("lang", "source", "term", "n", "total", (F.col("source") == F.col("least")).cast("long").alias("new"))
    )
    langs = kept.groupBy("lang").agg(F.sum("new").alias("v"), F.sum("n").alias("all_n"), F.count("*").alias("rows"))
    sums = kept.groupBy("lang", "source").agg(F.sum("n").alias("group_n"))
    blocks = (F.row_number().over(Window.partitionBy("lang").orderBy("source")) - 1).alias("at")
    groups = (
        counts.where("term IS NULL")
        .join(sums, ["lang", "source"], "left")
        .join(langs, ["lang"], "left")
        .na.fill(0, ["group_n", "v", "all_n", "rows"])
        .select("lang", "source", "group_n", "v", "all_n", "rows", blocks)
        .withColumn("block", F.expr(f"CAST(at div {BLOCK_SOURCES} AS INT)"))
        .withColumn("blocks", F.max("block").over(Window.partitionBy("lang")) + 1)
        .withColumn("slices", F.expr(f"CAST(rows div {SLICE_ROWS} + 1 AS INT)"))
    )
    groups = staged(groups)
    shares = kept.join(groups, ["lang", "source"]).withColumn("p", _share("n", "group_n", "v"))

    over = shares.withColumn("value", F.col("p") - _share("total", "all_n", "v")).where("value > 0")
    ranked = Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")
    over = (
        over.select("lang", "source", F.col("term").alias("item"), "value")
        .withColumn("rank", F.row_number().over(ranked))
        .where(F.col("rank") <= top_terms)
    )

    # A share of a missing term for every slice; 0 where a language keeps no term.
    bare = groups.withColumn("p", F.when(F.col("v") > 0, _share("0", "group_n", "v")).otherwise(F.lit(0).cast("long")))
    dealt = (
        shares.select("lang", "source", "term", "p", "v", "block", "blocks", F.expr("pmod(xxhash64(term), slices)").alias("slice"))
        .unionByName(
            bare.select(
                "lang", "source", F.lit(None).cast("string").alias("term"), "p", "v", "block", "blocks",
                F.explode(F.expr("sequence(0L, slices - 1L)")).alias("slice"),
            )
        )
        .withColumn("other", F.explode(F.expr("sequence(0, blocks - 1)")))
        .select("lang", "slice", F.least("block", "other").alias("low"), F.greatest("block", "other").alias("high"), "block", "source", "term", "p", "v")
    )
    pairs = (
        dealt.groupBy("lang", "slice", "low", "high")
        .applyInArrow(_block_pairs, "lang string, source string, item string, value long")
        .groupBy("lang", "source", "item")
        .agg(F.sum("value").alias("value"))
        .withColumn("rank", F.row_number().over(ranked))
    )
    columns = ["lang", "source", "part", "item", "value", "rank"]
    return pairs.withColumn("part", F.lit("pair")).select(columns).unionByName(over.withColumn("part", F.lit("term")).select(columns))

"""Ranked lexical search by summed accumulators of short lists beside skipping over long ones.

Items are queries, taken in blocks of bounded size; every document is scored against every item.
Tasks keep of each document the terms that items of the block have, with their frequencies, so
that whole texts are read once a block. A task then takes shards of documents, inverts them into
one list of impacts for each term, and answers each item: short lists are added term at a time
into one sorted list of sums, which from then on is one iterator with a known maximum beside the
long lists. Documents are taken a window at a time from the iterators whose maxima can
still lift a document into the best ones; the other lists are only looked into by binary search, for
documents that could still get there.
"""

from __future__ import annotations

import math
from collections.abc import Iterable, Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tallyline.llm.common import mapped, mix, ragged
from tallyline.llm.packed import Terms, byte_class, chunks, radix_order, spelled
from tallyline.session import staged

WORDS = byte_class(letters=True, digits=True)
# (item, term) pairs that are broadcast at once.
BLOCK_PAIRS = 1_000_000
# Postings that a task inverts at once.
SHARD_POSTINGS = 2_000_000
# Documents that are scored at once.
WINDOW = 8_192
# Lists with postings for fewer than one document in this many are short.
SHORT = 32
_SALT = np.uint64(0x9E3779B97F4A7C15)


class Vocabulary:
    """Numbers of the terms of a block, looked up for many packed terms at once."""

    def __init__(self, terms: list[bytes]):
        """`terms` are distinct; their places are their numbers."""
        self.size = len(terms)
        self.long = {t: k for k, t in enumerate(terms) if len(t) > 16}
        self.one = self._sorted([(int.from_bytes(t.ljust(8, b"\0"), "big"), k) for k, t in enumerate(terms) if len(t) <= 8])
        two = [(t.ljust(16, b"\0"), k) for k, t in enumerate(terms) if 8 < len(t) <= 16]
        first = np.array([int.from_bytes(t[:8], "big") for t, _ in two], np.uint64)
        second = np.array([int.from_bytes(t[8:], "big") for t, _ in two], np.uint64)
        numbers = np.array([k for _, k in two], np.int32)
        # Two words are found by one hash without collisions among the terms.
        self.salt = np.uint64(1)
        while len(np.unique(hashes := self._hash(first, second))) < len(two):
            self.salt += np.uint64(2)
        order = np.argsort(hashes)
        self.two = (hashes[order], first[order], second[order], numbers[order])

    @staticmethod
    def _sorted(pairs: list[tuple[int, int]]) -> tuple[np.ndarray, np.ndarray]:
        pairs.sort()
        return np.array([w for w, _ in pairs], np.uint64), np.array([k for _, k in pairs], np.int32)

    def _hash(self, first: np.ndarray, second: np.ndarray) -> np.ndarray:
        return mix(first * _SALT ^ mix(second ^ self.salt))

    def numbers(self, terms: Terms) -> np.ndarray:
        """The number of each term of a bucket, -1 for a term that the block lacks."""
        none = np.full(len(terms.first), -1, np.int32)
        if terms.first.dtype != np.uint64:
            return np.fromiter((self.long.get(t, -1) for t in terms.first.tolist()), np.int32, len(none)) if self.long else none
        keys, first, second, numbers = (self.one[0], None, None, self.one[1]) if terms.second is None else self.two
        if not len(keys) or not len(none):
            return none
        wanted = terms.first if terms.second is None else self._hash(terms.first, terms.second)
        at = np.minimum(np.searchsorted(keys, wanted), len(keys) - 1)
        hit = keys[at] == wanted
        if second is not None:
            hit &= (first[at] == terms.first) & (second[at] == terms.second)
        return np.where(hit, numbers[at], -1)


def _item_terms(items: DataFrame, item_col: str, text_col: str) -> DataFrame:
    """item, term: the distinct terms of each item."""

    def cut(batch: pa.RecordBatch) -> pa.Table:
        item, term = [np.zeros(0, np.int64)], []
        for chunk in chunks(batch.column(1), WORDS):
            for bucket in (chunk.one, chunk.two, *chunk.longer):
                item.append(bucket.text + chunk.low)
                term += spelled(bucket, np.arange(len(bucket.first)))
        return pa.table([batch.column(0).take(pa.array(np.concatenate(item))), pa.array(term, pa.binary())], ["item", "term"])

    read = items.select(F.col(item_col).alias("item"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    return mapped(read, cut, f"item {items.schema[item_col].dataType.simpleString()}, term binary").distinct()


def _block_count(pairs: DataFrame) -> int:
    """Blocks into which items are hashed so that none has more than BLOCK_PAIRS terms, unless one item has."""
    total = pairs.count()
    blocks = max(1, -(-total // BLOCK_PAIRS))
    largest = pairs.groupBy("item").count().agg(F.max("count")).first()[0] or 0
    while blocks > 1:
        held = pairs.groupBy(_block(blocks)).count().agg(F.max("count")).first()[0]
        if held <= max(BLOCK_PAIRS, largest) or blocks > total:
            break
        blocks *= 2
    return blocks


def _block(blocks: int):
    return F.pmod(F.xxhash64("item"), F.lit(blocks))


def _forward(docs: DataFrame, vocabulary, id_col: str, text_col: str) -> DataFrame:
    """doc_id, n, terms, tfs of every document with a term: all its terms counted, those of the block listed."""

    def index(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = vocabulary.value
        for batch in batches:
            for chunk in chunks(batch.column(1), WORDS):
                keys = []
                for bucket in (chunk.one, chunk.two, *chunk.longer):
                    number = known.numbers(bucket)
                    hit = np.flatnonzero(number >= 0)
                    keys.append(bucket.text[hit].astype(np.uint64) << np.uint64(32) | number[hit].astype(np.uint64))
                keys = np.concatenate(keys)
                keys = keys[radix_order(keys)]
                runs = np.flatnonzero(np.append(True, keys[1:] != keys[:-1])) if len(keys) else np.zeros(0, np.int64)
                tf = np.diff(runs, append=len(keys))
                text, term = (keys[runs] >> np.uint64(32)).astype(np.int64), (keys[runs] & np.uint64(0xFFFFFFFF)).astype(np.int32)
                full = np.flatnonzero(chunk.counts)
                bounds = pa.array(np.append(np.searchsorted(text, full), len(text)).astype(np.int32))
                yield pa.record_batch(
                    {
                        "doc_id": batch.column(0).slice(chunk.low, chunk.high - chunk.low).take(pa.array(full)),
                        "n": pa.array(chunk.counts[full], pa.int64()),
                        "terms": pa.ListArray.from_arrays(bounds, pa.array(term, pa.int32())),
                        "tfs": pa.ListArray.from_arrays(bounds, pa.array(tf, pa.int32())),
                    }
                )

    read = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    return read.mapInArrow(index, "doc_id long, n long, terms array<int>, tfs array<int>")


def _document_frequency(forward: DataFrame, size: int) -> np.ndarray:
    """Documents of each term of the block, summed over tasks; as long as the block's terms."""

    def count(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = np.zeros(size, np.int64)
        for batch in batches:
            sums += np.bincount(batch.column(0).flatten().to_numpy(), minlength=size)
        at = np.flatnonzero(sums)
        yield pa.record_batch({"term": pa.array(at, pa.int32()), "df": pa.array(sums[at], pa.int64())})

    out = np.zeros(size, np.int64)
    rows = forward.select("terms").mapInArrow(count, "term int, df long").groupBy("term").agg(F.sum("df").alias("df")).toArrow()
    out[rows.column("term").to_numpy()] = rows.column("df").to_numpy()
    return out


class Lists(NamedTuple):
    """A shard turned over: for term t the documents (places in `ids`) and impacts from bounds[t] to bounds[t + 1]."""

    ids: np.ndarray
    places: np.ndarray
    impacts: np.ndarray
    bounds: np.ndarray
    most: np.ndarray


def inverted(ids: np.ndarray, n: np.ndarray, held: np.ndarray, terms: np.ndarray, tfs: np.ndarray, weights: np.ndarray, docs: int, length: int) -> Lists:
    """Lists of a shard: document k has id ids[k], n[k] terms and the next held[k] of `terms` and `tfs`."""
    place = np.repeat(np.arange(len(ids), dtype=np.int32), held)
    # 100 - 50 + ((50 * n * docs) div length), in 64 bits.
    m = 50 + (50 * n * docs) // max(length, 1)
    tf = tfs.astype(np.int64)
    impact = weights[terms] * ((1_000_000_000 * tf) // (1000 * tf + 20 * m[place]))
    order = radix_order(terms.astype(np.uint64))
    bounds = np.searchsorted(terms[order], np.arange(len(weights) + 1))
    impact = impact[order]
    most = np.zeros(len(weights), np.int64)
    full = np.flatnonzero(np.diff(bounds))
    if len(full):
        most[full] = np.maximum.reduceat(impact, bounds[full])
    return Lists(ids, place[order], impact, bounds, most)


class Best:
    """The k best documents of an item so far: score descending, then id ascending, null ids (the largest) last."""

    def __init__(self, k: int):
        self.k, self.scores, self.ids, self.least = k, np.zeros(0, np.int64), np.zeros(0, np.int64), 1

    def add(self, scores: np.ndarray, ids: np.ndarray) -> None:
        keep = scores >= self.least
        scores, ids = np.append(self.scores, scores[keep]), np.append(self.ids, ids[keep])
        order = np.lexsort((ids, -scores))[: self.k]
        self.scores, self.ids = scores[order], ids[order]
        if len(order) == self.k:
            # An equal score still counts, for its id may be smaller.
            self.least = int(self.scores[-1])


def answer(lists: Lists, terms: np.ndarray, best: Best) -> None:
    """Add the documents of a shard that belong to the best of an item with these terms."""
    sizes = lists.bounds[terms + 1] - lists.bounds[terms]
    short = terms[(sizes > 0) & (sizes * SHORT < len(lists.ids))]
    long = terms[(sizes > 0) & (sizes * SHORT >= len(lists.ids))]
    cuts = [(lists.places[a:b], lists.impacts[a:b]) for a, b in zip(lists.bounds[long], lists.bounds[long + 1], strict=True)]
    tops = lists.most[long].tolist()
    if len(short):
        spans = [slice(a, b) for a, b in zip(lists.bounds[short], lists.bounds[short + 1], strict=True)]
        place = np.concatenate([lists.places[s] for s in spans])
        impact = np.concatenate([lists.impacts[s] for s in spans])
        order = np.argsort(place, kind="stable")
        place, impact = place[order], impact[order]
        runs = np.flatnonzero(np.append(True, place[1:] != place[:-1]))
        sums = np.add.reduceat(impact, runs)
        cuts.append((place[runs], sums))
        tops.append(int(sums.max()))
    if not cuts:
        return
    by_top = np.argsort(tops)
    cuts, bound = [cuts[k] for k in by_top], np.cumsum(np.array(tops, np.int64)[by_top])
    for low in range(0, len(lists.ids), WINDOW):
        # Lists up to here cannot lift a document into the best by themselves.
        idle = int(np.searchsorted(bound, best.least, "left"))
        if idle == len(cuts):
            return
        sums = np.zeros(min(WINDOW, len(lists.ids) - low), np.int64)
        seen = np.zeros(len(sums), bool)
        for place, impact in cuts[idle:]:
            a, b = np.searchsorted(place, [low, low + len(sums)])
            sums[place[a:b] - low] += impact[a:b]
            seen[place[a:b] - low] = True
        rest = int(bound[idle - 1]) if idle else 0
        at = np.flatnonzero(seen & (sums + rest >= best.least))
        total = sums[at]
        for k in range(idle - 1, -1, -1):
            if not len(at):
                break
            place, impact = cuts[k]
            hit = np.minimum(np.searchsorted(place, at + low), len(place) - 1)
            total = total + np.where(place[hit] == at + low, impact[hit], 0)
            keep = total + (int(bound[k - 1]) if k else 0) >= best.least
            at, total = at[keep], total[keep]
        if len(at):
            best.add(total, lists.ids[at + low])


def _ranked(forward: DataFrame, queries, k: int) -> DataFrame:
    """at, doc_id, score: the best documents of each task for every item of a block."""

    def search(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        items, weights, docs, length = queries.value
        best = [Best(k) for _ in items]

        def take(rows: pa.Table) -> None:
            ids = rows.column("doc_id").fill_null(np.iinfo(np.int64).max).to_numpy()
            held = rows.column("terms").combine_chunks()
            sizes = np.diff(held.offsets.to_numpy())
            tfs = rows.column("tfs").combine_chunks().flatten().to_numpy()
            lists = inverted(ids, rows.column("n").to_numpy(), sizes, held.flatten().to_numpy(), tfs, weights, docs, length)
            for terms, found in zip(items, best, strict=True):
                answer(lists, terms, found)

        waiting, postings = [], 0
        for batch in batches:
            waiting.append(batch)
            postings += len(batch.column("terms").flatten())
            if postings >= SHARD_POSTINGS:
                take(pa.Table.from_batches(waiting))
                waiting, postings = [], 0
        if waiting:
            take(pa.Table.from_batches(waiting))
        for at, found in enumerate(best):
            if len(found.ids):
                none = found.ids == np.iinfo(np.int64).max
                yield pa.record_batch(
                    {
                        "at": pa.array(np.full(len(none), at), pa.int32()),
                        "doc_id": pa.array(found.ids, pa.int64(), mask=none),
                        "score": pa.array(found.scores, pa.int64()),
                    }
                )

    return forward.mapInArrow(search, "at int, doc_id long, score long")


def ranked_search(
    docs: DataFrame,
    items: DataFrame,
    *,
    k: int = 50,
    id_col: str = "doc_id",
    text_col: str = "text",
    item_col: str = "item_id",
    item_text_col: str = "text",
) -> DataFrame:
    """<item_col>, rank, doc_id, score: the `k` best documents of every item, of all rows with a score above 0.

    Null and empty texts have no terms: such a document is not counted and never found, such an item finds
    nothing. Rows of one item id (null is one) are one item with all their terms; rows of one
    document id are documents of their own, which equal scores rank in any order. Document ids are integers; a
    null one comes last among equal scores, and so does the largest 64-bit number, which is returned as null. An
    empty table gives no rows. Other columns are not read.
    """
    spark = docs.sparkSession
    pairs = staged(_item_terms(items, item_col, item_text_col))
    blocks, found = _block_count(pairs), None
    item_type = items.schema[item_col].dataType.simpleString()
    for block in range(blocks):
        rows = pairs.where(_block(blocks) == block).toArrow()
        if not rows.num_rows:
            continue
        encoded = rows.column("term").combine_chunks().dictionary_encode()
        known = Vocabulary(encoded.dictionary.to_pylist())
        named = rows.column("item").to_pylist()
        places = {name: at for at, name in enumerate(dict.fromkeys(named))}
        item_of, term_of = np.array([places[x] for x in named], np.int64), encoded.indices.to_numpy().astype(np.int64)
        order = np.argsort(item_of, kind="stable")
        cuts = np.searchsorted(item_of[order], np.arange(1, len(places)))
        forward = staged(_forward(docs, spark.sparkContext.broadcast(known), id_col, text_col))
        docs_all, length = forward.agg(F.count("*"), F.coalesce(F.sum("n"), F.lit(0))).first()
        df = _document_frequency(forward, known.size)
        weights = np.array([math.floor(1000 * math.log((2 * docs_all + 2) / (2 * int(x) + 1))) for x in df], np.int64)
        queries = spark.sparkContext.broadcast((np.split(term_of[order], cuts), weights, docs_all, length))
        names = spark.createDataFrame(list(enumerate(places)), f"at int, item {item_type}")
        part = _ranked(forward, queries, k).join(names, "at").select("item", "doc_id", "score")
        found = part if found is None else found.unionByName(part)
    if found is None:
        found = spark.createDataFrame([], f"item {item_type}, doc_id long, score long")
    order = Window.partitionBy("item").orderBy(F.desc("score"), F.asc_nulls_last("doc_id"))
    return (
        found.withColumn("rank", F.row_number().over(order))
        .where(F.col("rank") <= k)
        .select(F.col("item").alias(item_col), "rank", "doc_id", "score")
    )

"""Benchmark passages in training documents, found by suffix arrays.

Each slice of an Arrow batch of documents is a shard. Its words become ids of the benchmark's
vocabulary (0: not in it), and its suffix array holds, in the order of all the words up to the
next 0, the positions from which a whole window of known words runs on. Every suffix of a
benchmark item is looked up by binary search: the positions that share its window are one range
of the array, and within the range the search goes on over the words that follow, which gives
the item's longest verbatim match in the shard and its place. Positions that start no window of
known words cannot match and need no place in the array.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyline.llm.common import ALNUM_WORDS, mapped, ragged, utf8

WINDOW = 13
# Benchmark characters that are broadcast at once; a larger benchmark is searched in several passes.
# A suffix costs some 70 bytes of a worker and each of its words has two characters or more.
BLOCK_CHARS = 8_000_000


def words_of(text: str | None) -> list[bytes]:
    """Runs of letters and digits, with A-Z lower-cased; every character beyond ASCII is a letter."""
    return utf8(text).translate(ALNUM_WORDS).split()


class Tests:
    """A block of benchmark items, ready to be searched for."""

    def __init__(self, items: list[tuple[str | None, str | None]], window: int) -> None:
        self.window, self.vocabulary = window, {}
        numbered = self.vocabulary.setdefault
        self.items, words = [], []
        for name, text in items:
            ids = [numbered(w, len(self.vocabulary) + 1) for w in words_of(text)]
            if ids:
                self.items.append(name)
                words.append(np.array([*ids, 0], np.int32))
        # All items one behind the other, each with a 0 at its end.
        self.flat = np.concatenate(words) if words else np.zeros(0, np.int32)
        sizes = np.array([len(w) - 1 for w in words], np.int64)
        begin = np.concatenate(([0], np.cumsum(sizes + 1)))[:-1].astype(np.int64)
        # A look-up for each suffix of at least a window, or for the whole of a shorter item.
        takes = np.maximum(sizes - window, 0) + 1
        item = np.repeat(np.arange(len(sizes)), takes)
        place = np.arange(len(item)) - np.repeat(np.cumsum(takes) - takes, takes)
        length = np.minimum(sizes, window)[item]
        rows = np.zeros((len(item), window), ">u4")
        for k in range(window):
            inside = length > k
            rows[inside, k] = self.flat[begin[item[inside]] + place[inside] + k]
        keys, owner = np.unique(np.frombuffer(rows.tobytes(), f"S{4 * window}"), return_inverse=True)
        order = np.argsort(owner, kind="stable")
        # Suffixes in the order of their windows: those of window w are at edges[w] to edges[w + 1].
        self.item, self.place, self.end = item[order], place[order], sizes[item[order]]
        self.at = begin[self.item] + self.place
        self.edges = np.searchsorted(owner[order], np.arange(len(keys) + 1))
        heads = np.frombuffer(keys.tobytes(), ">u4").reshape(-1, window)
        self.lengths = (heads > 0).sum(axis=1)
        self.low = keys
        # A shorter window is a range of keys: all words may follow.
        self.short = np.flatnonzero(self.lengths < window)
        high = heads[self.short].copy()
        high[high == 0] = 0xFFFFFFFF
        self.high = np.frombuffer(high.tobytes(), f"S{4 * window}")
        self.heads = {
            int(k): np.unique(heads[self.lengths == k, 0]) for k in set(self.lengths[self.short].tolist())
        }


def suffix_array(ids: np.ndarray, tests: Tests) -> np.ndarray:
    """Positions that can start a window, in the order of all the words up to the next 0.

    Sorted by two words, then by twice as many in each round; only positions that are still tied
    are sorted again. Equal suffixes stay in the order of their places. `ids` ends with a 0.
    """
    n, window = len(ids), tests.window
    here = np.arange(n)
    gaps = np.flatnonzero(ids == 0)
    run = gaps[np.searchsorted(gaps, here)] - here
    may = run >= window
    for k, heads in tests.heads.items():
        may |= (run >= k) & np.isin(ids, heads)
    # The words behind a start, up to the next 0, decide ties and are ranked with it.
    last = np.maximum.accumulate(np.where(may, here, -1))
    gap = np.maximum.accumulate(np.where(ids == 0, here, -1))
    ranked = np.flatnonzero((ids > 0) & (last > gap))
    if not len(ranked):
        return ranked
    keys = ids[ranked].astype(np.int64) << 32 | ids[ranked + 1]
    order = np.argsort(keys, kind="stable")
    keys, order = keys[order], ranked[order]
    first = np.concatenate(([True], keys[1:] != keys[:-1]))
    rank = np.zeros(n, np.int64)
    slots = np.arange(len(order))
    rank[order] = np.maximum.accumulate(np.where(first, slots, 0)) + 1
    k = 2
    tied = slots
    while True:
        # A slot is tied unless it and the next one both begin a group.
        alone = first[tied] & np.append(first, True)[tied + 1]
        tied = tied[~alone]
        places = order[tied]
        if not len(tied) or not (run[places] > k).any():
            break
        follow = np.where(run[places] > k, rank[np.minimum(places + k, n - 1)], 0)
        keys = rank[places] << 32 | follow
        again = np.argsort(keys, kind="stable")
        keys = keys[again]
        order[tied] = places[again]
        first[tied[1:]] |= keys[1:] != keys[:-1]
        heads = np.maximum.accumulate(np.where(first[tied], tied, 0))
        rank[order[tied]] = heads + 1
        k *= 2
    return order[may[order]]


def window_keys(ids: np.ndarray, places: np.ndarray, window: int) -> np.ndarray:
    """The words at each place, up to the next 0 or the window's end, as one key; sorted like suffixes."""
    rows = np.zeros((len(places), window), ">u4")
    going = np.arange(len(places))
    for k in range(window):
        going = going[ids[places[going] + k] > 0]
        rows[going, k] = ids[places[going] + k]
    return np.frombuffer(rows.tobytes(), f"S{4 * window}")


def _common(a: np.ndarray, p: int, b: np.ndarray, j: int, size: int) -> int:
    """How many of `size` words at b[j] stand at a[p], too; `a` ends with a 0, `b` has none there."""
    done, step = 0, 32
    while done < size:
        part = b[j + done : j + min(size, done + step)]
        other = a[p + done : p + done + len(part)]
        differ = np.flatnonzero(part[: len(other)] != other)
        if len(differ):
            return done + int(differ[0])
        done, step = done + len(part), 2 * step
    return size


def longest(ids: np.ndarray, array: np.ndarray, tests: Tests, found: np.ndarray, left: np.ndarray, right: np.ndarray) -> dict[int, tuple[int, int, int]]:
    """Of each item: length, place in the item and position in the shard of its longest match.

    `found` are the windows that occur, `left` and `right` their ranges in the array. A suffix
    cannot match further than the windows found from it on without a gap, so an item's
    suffixes are searched from the most promising one until none can be longer than the best.
    """
    spans = [np.arange(tests.edges[w], tests.edges[w + 1]) for w in found]
    suffix = np.concatenate(spans)
    window = np.repeat(found, [len(x) for x in spans])
    order = np.lexsort((tests.place[suffix], tests.item[suffix]))
    suffix, window = suffix[order], window[order]
    item, place = tests.item[suffix], tests.place[suffix]
    last = np.append((item[1:] != item[:-1]) | (place[1:] != place[:-1] + 1), True)
    ends = np.flatnonzero(last)
    most = ends[np.searchsorted(ends, np.arange(len(suffix)))] - np.arange(len(suffix)) + tests.lengths[window]
    best: dict[int, tuple[int, int, int]] = {}
    for k in np.lexsort((place, -most, item)):
        i, s, w = int(item[k]), int(suffix[k]), int(window[k])
        length = best[i][0] if i in best else 0
        if most[k] <= length:
            continue
        size, lo, hi = int(tests.end[s] - tests.place[s]), int(left[w]), int(right[w])
        while lo < hi:
            mid = (lo + hi) // 2
            p = int(array[mid])
            same = _common(ids, p, tests.flat, int(tests.at[s]), size)
            if same > length:
                length, best[i] = same, (same, int(place[k]), p)
            if same == size:
                break
            if ids[p + same] < tests.flat[tests.at[s] + same]:
                lo = mid + 1
            else:
                hi = mid
    return best


def search(texts: list[str | None], tests: Tests) -> list[tuple[int, np.ndarray, set[int], list[tuple[int, int, int, int]]]]:
    """For each text: words, hit flags, items with a window in it, and matches (item, length, place in the item, start).

    A match is the longest of its item in the whole shard and stands with the text that holds it.
    """
    known = tests.vocabulary.get
    split = [words_of(t) for t in texts]
    sizes = np.array([len(w) for w in split], np.int64)
    # A 0 behind each document keeps matches inside it.
    begin = np.concatenate(([0], np.cumsum(sizes + 1)))
    ids = np.zeros(int(begin[-1]), np.int32)
    for words, lo in zip(split, begin):
        ids[lo : lo + len(words)] = np.fromiter((known(w, 0) for w in words), np.int32, len(words))
    hit = np.zeros(len(ids) + 1, np.int32)
    items: list[set[int]] = [set() for _ in texts]
    matches: list[list[tuple[int, int, int, int]]] = [[] for _ in texts]
    if len(tests.low) and len(ids):
        array = suffix_array(ids, tests)
        keys = window_keys(ids, array, tests.window)
        left = np.searchsorted(keys, tests.low, "left")
        right = np.searchsorted(keys, tests.low, "right")
        right[tests.short] = np.searchsorted(keys, tests.high, "right")
        found = np.flatnonzero(right > left)
        for w in found:
            places, k = array[left[w] : right[w]], int(tests.lengths[w])
            np.add.at(hit, places, 1)
            np.add.at(hit, places + k, -1)
            owners = np.unique(tests.item[tests.edges[w] : tests.edges[w + 1]]).tolist()
            for d in np.unique(np.searchsorted(begin, places, "right") - 1):
                items[d].update(owners)
        if len(found):
            for i, (length, place, p) in longest(ids, array, tests, found, left, right).items():
                d = int(np.searchsorted(begin, p, "right")) - 1
                matches[d].append((i, length, place, p - int(begin[d])))
    flags = np.cumsum(hit)[:-1] > 0
    return [
        (int(size), flags[begin[d] : begin[d] + size], items[d], matches[d]) for d, size in enumerate(sizes)
    ]


def _searched(
    docs: DataFrame, carried: list[str], text: str, benchmark: DataFrame, window: int, share: int, unnamed: bool
) -> DataFrame:
    """The carried columns as __0, __1 ... and the verdict on `text` of every row."""
    spark = docs.sparkSession
    tests = benchmark.select(F.col("item_id").cast("string").alias("item_id"), "text")
    tests = tests.where("text is not null" if unnamed else "text is not null and item_id is not null")
    size = tests.agg(F.coalesce(F.sum(F.length("text")), F.lit(0))).first()[0]
    blocks = max(1, -(-size // BLOCK_CHARS))
    none = F.array().cast("array<int>")
    rows = docs.select(
        *[F.col(f"`{c}`").alias(f"__{k}") for k, c in enumerate(carried)],
        F.col(text).alias("text"),
        F.lit(0).cast("long").alias("n_words"),
        none.alias("starts"),
        none.alias("sizes"),
        F.array().cast("array<string>").alias("items"),
        F.array().cast(f"array<{_MATCH}>").alias("matches"),
    )
    head = ", ".join(f"`__{k}` {rows.schema[k].dataType.simpleString()}" for k in range(len(carried)))
    for b in range(blocks):
        part = tests.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks)) == b)
        some = sorted((tuple(r) for r in part.collect()), key=lambda r: (r[0] is None, r[0] or "", r[1]))
        shared = spark.sparkContext.broadcast(Tests(some, window))
        rows = mapped(rows, _finder(shared, len(carried)), f"{head}, text string, {_FOUND}")
    return mapped(rows, _judge(share, len(carried)), f"{head}, {_JUDGED}")


def contamination(
    docs: DataFrame, benchmark: DataFrame, *, window: int = WINDOW, share: int = 20, unnamed: bool = False,
    id_col: str = "doc_id", text_col: str = "text",
) -> DataFrame:
    """doc_id, n_words, n_hit, n_items, items_sha256, contaminated, starts, sizes, items and matches of every row.

    A window is `window` consecutive words of an item (item_id, text), or a shorter item's
    words as a whole. A document word inside any occurrence of a window is hit; a document is
    contaminated when it has hits and at least one word in `share` is hit. `starts` and
    `sizes` give the hit stretches in words (windows that touch, also of several items), `items`
    the items found. `matches` holds, of each item, one longest verbatim match in the shard that
    the row was searched in, with the row it stands in; `longest_matches` joins the shards. Null and
    wordless texts and items match nothing; an empty benchmark leaves all documents clean. An
    item without an id is left out, or with `unnamed` hits and counts like any other, though not in the
    hash of ids. Repeated rows are judged each for itself, other columns are not read.
    """
    return _searched(docs, [id_col], text_col, benchmark, window, share, unnamed).withColumnRenamed("__0", "doc_id")


def longest_matches(
    docs: DataFrame, benchmark: DataFrame, *, window: int = WINDOW, unnamed: bool = False,
    id_col: str = "doc_id", text_col: str = "text",
) -> DataFrame:
    """item_id, length, item_start, doc_id and start of the longest verbatim match of every item that occurs.

    Lengths and places are in words. Only matches of a whole window or more count, and whole items that
    are shorter. Of equally long matches one is given. Items and documents without words, and items that
    occur nowhere, have no row; items of one id are taken together, with `unnamed` those of none, too.
    """
    found = contamination(docs, benchmark, window=window, unnamed=unnamed, id_col=id_col, text_col=text_col)
    each = found.select("doc_id", F.explode("matches").alias("m"))
    rank = F.struct("m.length", -F.col("m.item_start"), -F.col("m.start"))
    best = F.max_by(F.struct("m.length", "m.item_start", "doc_id", "m.start"), rank)
    return each.groupBy(F.col("m.item_id").alias("item_id")).agg(best.alias("b")).select("item_id", "b.*")


def remove_contaminated(
    docs: DataFrame, benchmark: DataFrame, *, window: int = WINDOW, share: int = 20, unnamed: bool = False,
    text_col: str = "text",
) -> DataFrame:
    """The rows of `docs` that `contamination` finds clean, with all their columns."""
    found = _searched(docs, docs.columns, text_col, benchmark, window, share, unnamed).where("not contaminated")
    return found.select(*[F.col(f"__{k}").alias(c) for k, c in enumerate(docs.columns)])


_MATCH = "struct<item_id: string, length: int, item_start: int, start: int>"
_FOUND = f"n_words long, starts array<int>, sizes array<int>, items array<string>, matches array<{_MATCH}>"
_JUDGED = (
    "n_words long, n_hit long, n_items long, items_sha256 string, contaminated boolean, "
    f"starts array<int>, sizes array<int>, items array<string>, matches array<{_MATCH}>"
)
_MATCHES = pa.list_(
    pa.struct([("item_id", pa.string()), ("length", pa.int32()), ("item_start", pa.int32()), ("start", pa.int32())])
)


def _finder(shared, carried: int) -> Callable[[pa.RecordBatch], pa.Table | None]:
    """Adds the findings of a block of the benchmark to those of earlier blocks."""

    def run(batch: pa.RecordBatch) -> pa.Table | None:
        tables, names = [], np.array(shared.value.items, dtype=object)
        for k in range(0, batch.num_rows, 1024):
            some = batch.slice(k, 1024)
            before = [some.column(carried + c).to_pylist() for c in (2, 3, 4, 5)]
            n, starts, sizes, items, matches = [], [], [], [], []
            texts = some.column(carried).to_pylist()
            for (words, own, found, longer), s, z, i, m in zip(search(texts, shared.value), *before):
                edges = np.flatnonzero(np.diff(np.concatenate(([0], own.astype(np.int8), [0]))))
                n.append(words)
                starts.append(np.concatenate((np.array(s, np.int64), edges[::2])))
                sizes.append(np.concatenate((np.array(z, np.int64), edges[1::2] - edges[::2])))
                items.append([*i, *names[sorted(found)]] if found else i)
                new = [dict(item_id=names[x], length=k, item_start=j, start=p) for x, k, j, p in longer]
                matches.append([*m, *new])
            columns = [pa.array(n, pa.int64()), ragged(starts, pa.int32()), ragged(sizes, pa.int32())]
            tables.append(
                pa.Table.from_arrays(
                    [
                        *some.columns[: carried + 1], *columns,
                        pa.array(items, pa.list_(pa.string())), pa.array(matches, _MATCHES),
                    ],
                    [*some.schema.names[: carried + 1], "n_words", "starts", "sizes", "items", "matches"],
                )
            )
        return pa.concat_tables(tables) if tables else None

    return run


def _judge(share: int, carried: int) -> Callable[[pa.RecordBatch], pa.RecordBatch]:
    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        hits, counts, names, bad, starts, sizes = [], [], [], [], [], []
        for n, s, k, items in zip(*(batch.column(carried + i).to_pylist() for i in range(1, 5))):
            own: list[list[int]] = []
            for lo, size in sorted(zip(s, k)):
                if own and lo <= own[-1][0] + own[-1][1]:
                    own[-1][1] = max(own[-1][1], lo + size - own[-1][0])
                else:
                    own.append([lo, size])
            hit = sum(x[1] for x in own)
            hits.append(hit)
            counts.append(len(items))
            ids = sorted(x for x in items if x is not None)
            names.append(hashlib.sha256(",".join(ids).encode()).hexdigest())
            bad.append(hit > 0 and share * hit >= n)
            starts.append(np.array([x[0] for x in own], np.int32))
            sizes.append(np.array([x[1] for x in own], np.int32))
        fields = [
            *[(f"__{i}", batch.column(i)) for i in range(carried)],
            ("n_words", batch.column(carried + 1)), ("n_hit", pa.array(hits, pa.int64())),
            ("n_items", pa.array(counts, pa.int64())), ("items_sha256", pa.array(names, pa.string())),
            ("contaminated", pa.array(bad, pa.bool_())), ("starts", ragged(starts, pa.int32())),
            ("sizes", ragged(sizes, pa.int32())), ("items", batch.column(carried + 4)),
            ("matches", batch.column(carried + 5)),
        ]
        return pa.RecordBatch.from_arrays([x for _, x in fields], [x for x, _ in fields])

    return run

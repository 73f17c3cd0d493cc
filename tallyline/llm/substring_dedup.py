"""Repeated passages: runs of consecutive sentences that stand elsewhere are removed but once.

A run starts at every sentence and takes the fewest sentences, two at least, that hold
`min_words` words. Runs are joined by their hash over all documents. A sentence is removed
when a run that covers it is not the first of its kind, in the order of doc_id and place.
Sentences of over `LONG` words are parted by winnowing: behind the word pairs of the smallest
hash in every window of `WINDOW` words, so no part is longer and the ends depend on nearby
words only. Every passage of over 50 words that stands twice holds a whole run.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyline.llm.common import LOWER, mapped, mix, ragged, utf8
from tallyline.session import staged

MIN_WORDS = 20
MIN_SENTENCES = 2
# A sentence of more words is parted, with an end in every `WINDOW` words.
LONG = 16
WINDOW = 7

_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
_STOP = np.zeros(256, bool)
_STOP[[33, 46, 63]] = True
_CLOSE = np.zeros(256, bool)
_CLOSE[[34, 39, 41, 93]] = True


_LOWER = np.frombuffer(LOWER, np.uint8)
_POWERS = mix(np.arange(1, 65, dtype=np.uint64)) | np.uint64(1)


def _picked(a: np.ndarray, space: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """Words whose pair with the next word has the smallest hash of some window; of equal ones all."""
    ahead = np.zeros(len(a), np.int64)
    ahead[starts] = starts
    place = (np.arange(len(a)) - np.maximum.accumulate(ahead)) & 63
    values = np.where(space, np.uint64(0), (_LOWER[a].astype(np.uint64) + np.uint64(1)) * _POWERS[place])
    words = mix(np.add.reduceat(values, starts))
    pairs = mix(words * np.uint64(3) + np.append(words[1:], np.uint64(0)))
    out = np.zeros(len(pairs), bool)
    windows = np.lib.stride_tricks.sliding_window_view(pairs, min(WINDOW, len(pairs)))
    least = windows.min(axis=1)
    for k in range(windows.shape[1]):
        out[k : k + len(least)] |= windows[:, k] == least
    return out


def sentences(raw: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Byte offsets and first words of the sentences; both end with the total."""
    a = np.frombuffer(raw, np.uint8)
    space = _SPACE[a]
    edge = np.diff(np.concatenate(([True], space, [True])).astype(np.int8))
    starts, ends = np.flatnonzero(edge == -1), np.flatnonzero(edge == 1) - 1
    n = len(starts)
    if not n:
        return np.array([0, len(a)]), np.array([0, 0])
    last, before = a[ends], np.where(ends > starts, a[np.maximum(ends - 1, 0)], 0)
    stop = _STOP[last] | (_CLOSE[last] & _STOP[before])
    third = np.where(ends > starts + 1, a[np.maximum(ends - 2, 0)], 0)
    stop |= (third == 0xE3) & (before == 0x80) & (last == 0x82)
    stop |= (third == 0xEF) & (before == 0xBC) & ((last == 0x81) | (last == 0x9F))
    lines = np.cumsum(a == 10)
    stop[:-1] |= lines[starts[1:]] > lines[ends[:-1]]
    which = np.concatenate(([0], np.cumsum(stop)[:-1]))
    long = np.bincount(which)[which] > LONG
    if long.any():
        stop |= long & _picked(a, space, starts)
    first = np.concatenate(([0], np.flatnonzero(stop[:-1]) + 1))
    at = starts[first]
    at[0] = 0
    return np.append(at, len(a)), np.append(first, n)


def runs(first: np.ndarray, min_words: int, min_sentences: int) -> tuple[np.ndarray, np.ndarray]:
    """For each sentence that starts a run, its number and the sentence behind the run."""
    k = len(first) - 1
    end = np.maximum(np.searchsorted(first, first[:-1] + min_words), np.arange(k) + min_sentences)
    start = np.flatnonzero(end <= k)
    return start, end[start]


def _spans(docs: DataFrame, min_words: int, min_sentences: int) -> DataFrame:
    """(doc_id, version, hashes): a hash for each run of a document, in order."""

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        found = []
        for text in batch.column(2).to_pylist():
            raw = utf8(text)
            _, first = sentences(raw)
            start, end = runs(first, min_words, min_sentences)
            if not len(start):
                found.append(np.empty(0, np.int64))
                continue
            words = raw.translate(LOWER).split()
            at = np.concatenate(([0], np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1)))
            plain = memoryview(b" ".join(words))
            bounds = zip(at[first[start]].tolist(), (at[first[end]] - 1).tolist())
            hashes = np.fromiter((xxhash.xxh3_64_intdigest(plain[x:y]) for x, y in bounds), np.uint64, len(start))
            found.append(hashes.view(np.int64))
        return pa.RecordBatch.from_arrays(
            [batch.column(0), batch.column(1), ragged(found, pa.int64())], ["doc_id", "version", "hashes"]
        )

    kind = docs.schema["doc_id"].dataType.simpleString()
    return mapped(docs, run, f"doc_id {kind}, version long, hashes array<long>")


def repeated_runs(
    docs: DataFrame, min_words: int = MIN_WORDS, min_sentences: int = MIN_SENTENCES,
    id_col: str = "doc_id", text_col: str = "text",
) -> DataFrame:
    """(doc_id, version, starts): which of a document's runs are not the first of their kind.

    `version` is a hash of the text, so rows that share an id but not the text stay apart.
    """
    keyed = docs.select(
        F.col(id_col).alias("doc_id"), F.xxhash64(text_col).alias("version"), F.col(text_col).alias("text")
    )
    # Hashed once: one reader finds the first place of each hash, the other its later ones.
    spans = staged(_spans(keyed, min_words, min_sentences))
    placed = spans.select("doc_id", "version", F.posexplode("hashes").alias("start", "hash"))
    # Copies of a row are one occurrence; counting them twice only means a look at their runs. A hash of
    # any number of runs leaves each task as one row.
    counts = placed.groupBy("hash").agg(F.count("*").alias("k"))
    # Both right sides are stored: joined with a table of its own, not with the aggregate that dealt it, the
    # runs of a hot hash may be split over tasks.
    repeated = staged(counts.where("k > 1").select("hash"))
    again = staged(placed.join(repeated, "hash"))
    place = F.struct("doc_id", "version", "start")
    firsts = staged(again.groupBy("hash").agg(F.min(place).alias("first")))
    later = again.join(firsts, "hash").where(~place.eqNullSafe(F.col("first")))
    return later.groupBy("doc_id", "version").agg(F.collect_set("start").alias("starts"))


def remove_repeats(
    docs: DataFrame, min_words: int = MIN_WORDS, min_sentences: int = MIN_SENTENCES,
    id_col: str = "doc_id", text_col: str = "text",
) -> DataFrame:
    """`docs` with later copies of repeated runs cut from the text, and n_sentences, n_removed.

    All rows and all other columns stay as they are; columns named n_sentences or n_removed
    are replaced. A null text stays null with counts of 0, a text without a repeat is not
    touched, a text that is one repeat becomes empty. Of two equal passages in one document
    the earlier stays. Rows equal in id and text are one occurrence and stay equal. A null id
    comes before all others.
    """
    own_id, own_version, own_starts, version, cut_ = (_free(n, docs.columns) for n in ("id", "version", "starts", "v", "cut"))
    starts = repeated_runs(docs, min_words, min_sentences, id_col, text_col).select(
        F.col("doc_id").alias(own_id), F.col("version").alias(own_version), F.col("starts").alias(own_starts)
    )

    @F.pandas_udf("text string, n_sentences int, n_removed int")
    def cut(texts: pd.Series, starts: pd.Series) -> pd.DataFrame:
        rows = []
        for text, some in zip(texts, starts):
            raw = utf8(text)
            at, first = sentences(raw)
            count = len(first) - 1 if first[-1] else 0
            if text is None or some is None or not len(some):
                rows.append((text, count, 0))
                continue
            start, end = runs(first, min_words, min_sentences)
            some = np.asarray(some)
            cover = np.zeros(len(first), np.int64)
            np.add.at(cover, start[some], 1)
            np.add.at(cover, end[some], -1)
            gone = np.cumsum(cover)[:-1] > 0
            left = b"".join(raw[at[i] : at[i + 1]] for i in np.flatnonzero(~gone))
            rows.append((left.decode().strip(), count, int(gone.sum())))
        return pd.DataFrame(rows, columns=["text", "n_sentences", "n_removed"])

    joined = docs.withColumn(version, F.xxhash64(text_col)).join(
        starts, F.col(id_col).eqNullSafe(F.col(own_id)) & (F.col(version) == F.col(own_version)), "left"
    )
    done = joined.withColumn(cut_, cut(text_col, own_starts))
    kept = [c for c in docs.columns if c not in ("n_sentences", "n_removed")]
    return done.select(
        *[F.col(f"{cut_}.text").alias(c) if c == text_col else F.col(f"`{c}`") for c in kept],
        f"{cut_}.n_sentences",
        f"{cut_}.n_removed",
    )


def _free(name: str, taken: list[str]) -> str:
    """A column name that is not taken, in any case of letters."""
    name, used = f"__{name}", {c.lower() for c in taken}
    while name in used:
        name = f"_{name}"
    return name

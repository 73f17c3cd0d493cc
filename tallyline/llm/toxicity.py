"""Toxicity by two Kneser-Ney models that share their backoff.

The models give the bytes of a word one by one. At full order each class has its own counts;
below it both back off to one model of continuation counts over both classes, so a rare
expression is as likely in either. A word's evidence is the difference of its log
likelihoods, a text's is that difference by words: over the whole text and in its strongest
stretch. A logistic fit on training rows that the models have not seen turns it to a score.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyline.llm.common import ALNUM_WORDS, mapped, ragged, row_ids, utf8
from tallyline.llm.labelled import fit_logistic, fold, predict_logistic, training_labels, with_labels
from tallyline.session import staged

ORDER = 6
DISCOUNT = 0.75
# Words of a stretch.
STRETCH = 16
# Fold of training rows that fits the logistic score, and how many rows it uses at most.
SCORE_FOLD, SCORE_ROWS = 4, 50_000
# N-grams up to which a model is sent to the executors, 24 bytes each; a larger one stays a table that words are joined with.
MODEL_ENTRIES = 4_000_000
# Texts whose words are listed at once when they are joined with their evidence.
LISTED_TEXTS = 64
# Scored words that a worker keeps before it starts afresh.
CACHE_WORDS = 250_000

_drop = np.array([0, 0, *[(1 << 8 * k) - 1 for k in range(1, 9)]], np.uint64)


def _words(text: str | None) -> list[bytes]:
    return utf8(text).translate(ALNUM_WORDS).split()


def ngrams(words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Packed n-grams of the words' bytes and ends, with a blank ahead, and the word of each."""
    raw = np.frombuffer(b" " + b" ".join(words) + b" ", np.uint8).astype(np.uint64)
    blank = np.flatnonzero(raw == 32)
    # Every n-gram ends at a byte behind the first blank and reaches back to its word's blank at most.
    at = np.arange(1, len(raw))
    opened = np.searchsorted(blank, at, "left") - 1
    reach = at - blank[opened]
    keys = np.zeros(len(at), np.uint64)
    for k in range(ORDER):
        inside = reach >= k
        keys[inside] |= raw[at[inside] - k] << np.uint64(8 * k)
    return keys, opened


def _length(keys: np.ndarray) -> np.ndarray:
    return np.searchsorted(np.array([1 << 8 * k for k in range(8)], np.uint64), keys, "right")


def shorter(keys: np.ndarray) -> np.ndarray:
    """N-grams without their first byte."""
    return keys & _drop[_length(keys)]


def count_ngrams(rows: DataFrame) -> DataFrame:
    """Occurrences of every n-gram in `rows` (text, label, apart), by label: key, ordinary, toxic.

    Those in rows set apart are counted in ordinary_apart and toxic_apart.
    """
    names = ("ordinary", "toxic", "ordinary_apart", "toxic_apart")

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            seen = [Counter() for _ in names]
            for text, group in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                seen[group].update(_words(text))
            parts = []
            for group, counter in enumerate(seen):
                if counter:
                    keys, word = ngrams(list(counter))
                    times = np.fromiter(counter.values(), np.int64, len(counter))[word]
                    parts.append((keys, np.full(len(keys), group), times))
            if parts:
                keys, back = np.unique(np.concatenate([p[0] for p in parts]), return_inverse=True)
                group, times = (np.concatenate([p[k] for p in parts]) for k in (1, 2))
                counts = [np.bincount(back, times * (group == g), len(keys)).astype(np.int64) for g in range(len(names))]
                yield pa.RecordBatch.from_arrays([pa.array(keys.view(np.int64)), *map(pa.array, counts)], ["key", *names])

    group = F.col("label") + F.when(F.col("apart"), 2).otherwise(0)
    found = rows.select("text", group.alias("group")).mapInArrow(run, "key long, " + ", ".join(f"{n} long" for n in names))
    return found.groupBy("key").agg(*[F.sum(n).alias(n) for n in names])


def _rest(total: np.ndarray, kinds: np.ndarray) -> np.ndarray:
    """What a class leaves to the shared model behind a history."""
    return np.where(total > 0, DISCOUNT * kinds / np.maximum(total, 1), 1.0)


def _own(n: np.ndarray, total: np.ndarray) -> np.ndarray:
    """A class's own share of an n-gram seen `n` times."""
    return np.where(total > 0, np.maximum(n - DISCOUNT, 0) / np.maximum(total, 1), 0.0)


class Models:
    """Log likelihood ratios of n-grams, from the counts of both classes."""

    def __init__(self, keys: np.ndarray, ordinary: np.ndarray, toxic: np.ndarray) -> None:
        order = np.argsort(keys)
        self.keys, counts = keys[order], (ordinary[order], toxic[order])
        shared = self._shared()
        heads, start = np.unique(self.keys >> np.uint64(8), return_index=True)
        spread = np.repeat(np.arange(len(heads)), np.diff(np.append(start, len(keys))))
        self.heads, logs, left = heads, [], []
        for n in counts:
            total = np.add.reduceat(n, start) if len(start) else n
            kinds = np.add.reduceat((n > 0).astype(np.int64), start) if len(start) else n
            rest = _rest(total, kinds)
            logs.append(np.log(_own(n, total[spread]) + rest[spread] * shared))
            left.append(np.log(rest))
        self.ratio = (logs[1] - logs[0]).astype(np.float32)
        # For an n-gram never seen the shared model cancels out.
        self.unseen = (left[1] - left[0]).astype(np.float32)
        # Evidence of words that a worker has scored; it goes with the model and is not sent.
        self.scored: dict[bytes, float] = {}

    def __getstate__(self) -> dict:
        return self.__dict__ | {"scored": {}}

    def _shared(self) -> np.ndarray:
        """Of each n-gram, the shared model's likelihood of its last byte behind the shorter history."""
        sets, longer = {}, self.keys
        size = _length(self.keys)
        for k in range(ORDER, 1, -1):
            longer = np.union1d(sets[k][0], self.keys[size == k]) if k in sets else self.keys[size == k]
            sets[k - 1] = np.unique(shorter(longer), return_counts=True)
        below: tuple[np.ndarray, np.ndarray] | None = None
        levels = {}
        for k in range(1, ORDER):
            grams, n = sets[k]
            heads, start = np.unique(grams >> np.uint64(8), return_index=True)
            width = np.diff(np.append(start, len(grams)))
            total = np.repeat(np.add.reduceat(n, start), width) if len(start) else n
            kinds = np.repeat(width, width)
            base = 1 / 256 if below is None else below[1][np.searchsorted(below[0], shorter(grams))]
            p = (np.maximum(n - DISCOUNT, 0) + DISCOUNT * kinds * base) / np.maximum(total, 1)
            below = levels[k] = (grams, p)
        out = np.full(len(self.keys), 1 / 256)
        for k in range(2, ORDER + 1):
            mine = size == k
            grams, p = levels[k - 1]
            out[mine] = p[np.searchsorted(grams, shorter(self.keys[mine]))]
        return out

    def evidence(self, words: list[bytes]) -> np.ndarray:
        """Log likelihood of each word as toxic, less that as ordinary."""
        keys, word = ngrams(words)
        total = np.zeros(len(keys), np.float64)
        for known, values, wanted in ((self.heads, self.unseen, keys >> np.uint64(8)), (self.keys, self.ratio, keys)):
            if len(known):
                at = np.minimum(np.searchsorted(known, wanted), len(known) - 1)
                same = known[at] == wanted
                total[same] = values[at[same]]
        return np.bincount(word, total, minlength=len(words))


def _summary(e: np.ndarray) -> tuple[float, ...]:
    sums = np.concatenate(([0.0], np.cumsum(e)))
    size = min(len(e), STRETCH)
    return e.mean(), (sums[size:] - sums[:-size]).max() / size, np.sort(e)[-3:].mean(), np.log1p(len(e))


def signals(texts: list[str | None], models: Models) -> np.ndarray:
    """Of each text: evidence by word, in the strongest stretch, of the strongest words, and its length."""
    known = models.scored
    split = [_words(t) for t in texts]
    fresh = list({w for words in split for w in words if w not in known})
    for k in range(0, len(fresh), 65_536):
        part = fresh[k : k + 65_536]
        known.update(zip(part, models.evidence(part).tolist()))
    out = np.zeros((len(texts), 4))
    for i, words in enumerate(split):
        if words:
            out[i] = _summary(np.fromiter(map(known.__getitem__, words), np.float64, len(words)))
    if len(known) > CACHE_WORDS:
        known.clear()
    return out


def _size(key: Column) -> Column:
    out = F.lit(ORDER)
    for k in range(ORDER - 1, 0, -1):
        out = F.when(key < 1 << 8 * k, k).otherwise(out)
    return out


def _short(key: Column, size: int) -> Column:
    return key.bitwiseAND(F.lit((1 << 8 * (size - 1)) - 1))


def _shared_table(keys: DataFrame) -> DataFrame:
    """(short, shared): the shared model's likelihoods, as in `Models`, of all n-grams below full order."""
    sets: dict[int, DataFrame] = {}
    for k in range(ORDER, 1, -1):
        # N-grams below full order begin with a blank, those got by dropping a byte do not; so none is twice in the union.
        longer = keys.where(_size(F.col("key")) == k)
        longer = longer.unionByName(sets[k].select("key")) if k in sets else longer
        sets[k - 1] = staged(longer.groupBy(_short(F.col("key"), k).alias("key")).agg(F.count("*").alias("n")))
    levels: list[DataFrame] = []
    for k in range(1, ORDER):
        grams = sets[k].withColumn("head", F.shiftright("key", 8))
        heads = grams.groupBy("head").agg(F.sum("n").alias("total"), F.count("*").alias("kinds"))
        grams = grams.join(heads, "head")
        if levels:
            grams = grams.withColumn("short", _short(F.col("key"), k)).join(levels[-1], "short")
        else:
            grams = grams.withColumn("shared", F.lit(1 / 256))
        p = (F.greatest(F.col("n") - DISCOUNT, F.lit(0.0)) + F.lit(DISCOUNT) * F.col("kinds") * F.col("shared")) / F.col("total")
        levels.append(staged(grams.select(F.col("key").alias("short"), p.alias("shared"))))
    out = levels[0]
    for more in levels[1:]:
        out = out.unionByName(more)
    return out


def _model_tables(counts: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(key, ratio) and (head, unseen): the values of `Models` from counts (key, ordinary, toxic) of any number."""

    def ratios(batch: pa.RecordBatch) -> pa.RecordBatch:
        n, total, kinds = ([batch.column(k + c).to_numpy() for c in (0, 1)] for k in (1, 3, 5))
        shared = batch.column(7).to_numpy()
        logs = [np.log(_own(n[c], total[c]) + _rest(total[c], kinds[c]) * shared) for c in (0, 1)]
        return pa.RecordBatch.from_arrays([batch.column(0), pa.array((logs[1] - logs[0]).astype(np.float32))], ["key", "ratio"])

    def unseens(batch: pa.RecordBatch) -> pa.RecordBatch:
        total, kinds = ([batch.column(k + c).to_numpy() for c in (0, 1)] for k in (1, 3))
        left = [np.log(_rest(total[c], kinds[c])) for c in (0, 1)]
        return pa.RecordBatch.from_arrays([batch.column(0), pa.array((left[1] - left[0]).astype(np.float32))], ["head", "unseen"])

    names = ("ordinary", "toxic")
    short = F.col("key")
    for k in range(2, ORDER + 1):
        short = F.when(_size(F.col("key")) == k, _short(F.col("key"), k)).otherwise(short)
    rows = counts.select("key", *names, F.shiftright("key", 8).alias("head"), short.alias("short"))
    of_head = [f"{n}_{what}" for what in ("total", "kinds") for n in names]
    heads = staged(
        rows.groupBy("head").agg(
            *[F.sum(n).alias(f"{n}_total") for n in names], *[F.sum((F.col(n) > 0).cast("long")).alias(f"{n}_kinds") for n in names]
        )
    )
    full = rows.join(heads, "head").join(_shared_table(counts.select("key")), "short")
    return (
        staged(mapped(full.select("key", *names, *of_head, "shared"), ratios, "key long, ratio float")),
        staged(mapped(heads.select("head", *of_head), unseens, "head long, unseen float")),
    )


def _word_evidence(words: DataFrame, tables: tuple[DataFrame, DataFrame]) -> DataFrame:
    """(word, e): what `Models.evidence` gives for each of the distinct `words`."""

    def grams(batch: pa.RecordBatch) -> pa.RecordBatch:
        keys, word = ngrams(batch.column(0).to_pylist())
        return pa.RecordBatch.from_arrays(
            [batch.column(0).take(pa.array(word)), pa.array(np.arange(len(keys))), pa.array(keys.view(np.int64))],
            ["word", "at", "key"],
        )

    ratio, unseen = tables
    rows = mapped(words, grams, "word binary, at long, key long").withColumn("head", F.shiftright("key", 8))
    value = F.coalesce("ratio", "unseen", F.lit(0.0).cast("float")).cast("double")
    found = rows.join(ratio, "key", "left").join(unseen, "head", "left").select("word", F.struct("at", value.alias("value")).alias("x"))
    # Added up in the order of the word, so that the sum is that of one worker.
    return found.groupBy("word").agg(
        F.aggregate(F.sort_array(F.collect_list("x")), F.lit(0.0), lambda total, x: total + x["value"]).alias("e")
    )


def _far_signals(rows: DataFrame, tables: tuple[DataFrame, DataFrame]) -> DataFrame:
    """`signals` of rows (text, carried) by joins with a model of any size: a, b, c, d, carried."""

    def listed(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        numbers = row_ids()
        for whole in batches:
            for k in range(0, whole.num_rows, LISTED_TEXTS):
                batch = whole.slice(k, LISTED_TEXTS)
                at, ids, words, places = [], [], [], []
                for i, text in enumerate(batch.column(0).to_pylist()):
                    where: dict[bytes | None, list[int]] = {}
                    for place, word in enumerate(_words(text)):
                        where.setdefault(word, []).append(place)
                    where = where or {None: []}
                    at += [i] * len(where)
                    ids += [next(numbers)] * len(where)
                    words += where
                    places += [np.array(x, np.int32) for x in where.values()]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(ids, pa.int64()), batch.column(1).take(pa.array(at, pa.int64())), pa.array(words, pa.binary()),
                     ragged(places, pa.int32())],
                    ["row", "carried", "word", "places"],
                )

    def summed(batch: pa.RecordBatch) -> pa.RecordBatch:
        out = np.zeros((batch.num_rows, 4))
        for i, parts in enumerate(batch.column(1)):
            flat = parts.values
            e, places = flat.field("e").to_numpy(), flat.field("places")
            spread = np.empty(len(places.flatten()))
            spread[places.flatten().to_numpy()] = np.repeat(e, places.value_lengths().to_numpy())
            out[i] = _summary(spread)
        return pa.RecordBatch.from_arrays([*map(pa.array, out.T), batch.column(0)], ["a", "b", "c", "d", "carried"])

    kind = rows.schema["carried"].dataType.simpleString()
    split = staged(rows.select("text", "carried").mapInArrow(listed, f"row long, carried {kind}, word binary, places array<int>"))
    some = split.where("word is not null")
    evidence = _word_evidence(some.select("word").distinct(), tables)
    of_row = some.join(evidence, "word").groupBy("row").agg(
        F.first("carried").alias("carried"), F.collect_list(F.struct("places", "e")).alias("parts")
    )
    schema = f"a double, b double, c double, d double, carried {kind}"
    none = split.where("word is null").select(*[F.lit(0.0).alias(n) for n in "abcd"], "carried")
    return mapped(of_row.select("carried", "parts"), summed, schema).unionByName(none)


def _near_signals(rows: DataFrame, models: Models) -> DataFrame:
    """`signals` of rows (text, carried) by a model that the executors hold: a, b, c, d, carried."""
    held = rows.sparkSession.sparkContext.broadcast(models)

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        x = signals(batch.column(0).to_pylist(), held.value)
        return pa.RecordBatch.from_arrays([*map(pa.array, x.T), batch.column(1)], ["a", "b", "c", "d", "carried"])

    kind = rows.schema["carried"].dataType.simpleString()
    return mapped(rows.select("text", "carried"), run, f"a double, b double, c double, d double, carried {kind}")


def toxicity(
    docs: DataFrame, labels: DataFrame, *, threshold: float = 0.5, id_col: str = "doc_id", text_col: str = "text",
    label_col: str = "toxic",
) -> DataFrame:
    """doc_id, held_out, score and predicted of every row.

    `labels` (doc_id, `label_col` 0 or 1) is used where crc32(doc_id) mod 5 is not 0; the
    n-grams of all such rows are counted. The score is fitted on one fold, with models that
    know the others; then the models take in that fold too. Null, empty
    and wordless texts have no evidence and get the score that this has. Rows that repeat are
    scored each for itself; a null id is not held out. Without labels of both kinds every
    score is near the label that there is, or 0. Other columns are not read.
    """
    plain = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    known = training_labels(labels, "doc_id", label_col)
    rows = with_labels(plain, known).withColumn("apart", F.col("fold") == SCORE_FOLD)
    counts = staged(count_ngrams(rows))
    near = counts.count() <= MODEL_ENTRIES
    evaluated = _near_signals if near else _far_signals
    early, final = _collected(counts) if near else _tabled(counts)
    some = known.where(F.col("fold") == SCORE_FOLD).orderBy(F.xxhash64("label_id")).limit(SCORE_ROWS)
    rows = with_labels(plain, some).select("text", F.col("label").alias("carried"))
    # In one order, however the rows arrive: a sum of doubles depends on it.
    seen = evaluated(rows, early).toPandas().sort_values(["a", "b", "c", "d", "carried"])
    fit = fit_logistic(seen[["a", "b", "c", "d"]].to_numpy(float), seen["carried"].to_numpy(float))

    def score(batch: pa.RecordBatch) -> pa.RecordBatch:
        x = np.column_stack([batch.column(k).to_numpy() for k in range(4)])
        return pa.RecordBatch.from_arrays([batch.column(4), pa.array(predict_logistic(x, fit))], ["doc_id", "score"])

    kind = plain.schema["doc_id"].dataType.simpleString()
    scored = mapped(evaluated(plain.withColumnRenamed("doc_id", "carried"), final), score, f"doc_id {kind}, score double")
    return scored.select(
        "doc_id",
        F.coalesce(fold("doc_id") == 0, F.lit(False)).alias("held_out"),
        "score",
        (F.col("score") >= threshold).cast("int").alias("predicted"),
    )


def _collected(counts: DataFrame) -> tuple[Models, Models]:
    """Models without and with the rows set apart."""
    kept = counts.toPandas()
    keys = kept["key"].to_numpy(np.int64).view(np.uint64)
    first = [kept[n].to_numpy(np.int64) for n in ("ordinary", "toxic")]
    both = [n + kept[f"{c}_apart"].to_numpy(np.int64) for n, c in zip(first, ("ordinary", "toxic"))]
    seen = first[0] + first[1] > 0
    return Models(keys[seen], *(n[seen] for n in first)), Models(keys, *both)


def _tabled(counts: DataFrame) -> tuple[tuple[DataFrame, DataFrame], ...]:
    """The same models as tables."""
    both = [(F.col(n) + F.col(f"{n}_apart")).alias(n) for n in ("ordinary", "toxic")]
    first = counts.select("key", "ordinary", "toxic").where("ordinary + toxic > 0")
    return _model_tables(first), _model_tables(counts.select("key", *both))

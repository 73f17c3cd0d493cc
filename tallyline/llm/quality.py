"""Quality scores by positive-unlabelled learning with a non-negative risk.

Trusted positives are documents labelled good; the unlabelled are documents without a
label, good and bad ones. The share of good ones among them, the class prior, is estimated
as the share of good labels in the training folds. The linear model over binned text
statistics minimises  prior * R+(positives) + max(0, R-(unlabelled) - prior * R-(positives)).
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyline.llm.common import forget, mapped, utf8
from tallyline.llm.labelled import fold, training_labels

# Rows of each kind that the fit uses at most, picked by a hash of their id.
FIT_ROWS = 20_000
BINS = 16
STEPS, BATCH, RATE, RIDGE = 1_500, 4_096, 0.05, 1e-5
# A batch's negative risk may be this far below zero by chance.
TOLERANCE = 0.02

_KIND = np.zeros(256, np.uint8)  # 1 upper, 2 lower or beyond ASCII, 3 digit, 4 space, 5 line end, 6.. marks
_KIND[65:91], _KIND[97:123], _KIND[128:], _KIND[48:58] = 1, 2, 2, 3
_KIND[[9, 11, 12, 13, 32]], _KIND[10] = 4, 5
_MARKS = b"!?.,;:'\"-|()[]{}<>/\\&%$#*@_+=~^`"
for _i, _c in enumerate(_MARKS):
    _KIND[_c] = 6 + _i
_KINDS = 6 + len(_MARKS)
_SPACE = (_KIND == 4) | (_KIND == 5)
N_FEATURES = _KINDS + 12


def statistics(text: str | None) -> np.ndarray:
    """Statistics of a whole text: shares of character kinds, word shapes, repetition."""
    raw = utf8(text)
    out = np.zeros(N_FEATURES)
    a = np.frombuffer(raw, np.uint8)
    if not len(a):
        return out
    kinds = _KIND[a]
    shares = np.bincount(kinds, minlength=_KINDS)[:_KINDS] / len(a)
    words, lines = raw.split(), raw.split(b"\n")
    n = max(1, len(words))
    space = _SPACE[a]
    ends = np.flatnonzero(~space & np.append(space[1:], True))
    starts = np.flatnonzero(~space & np.concatenate(([True], space[:-1])))
    sizes = ends - starts + 1
    last, first = kinds[ends], kinds[starts]
    counts = np.unique(np.fromiter(map(hash, words), np.int64, len(words)), return_counts=True)[1] if words else np.ones(1)
    again = sum(map(bytes.__eq__, words[1:], words)) / n
    shapes = (
        np.log1p(len(words)),
        sizes.mean() if len(sizes) else 0,
        sizes.std() if len(sizes) else 0,
        (last > 5).mean() if len(last) else 0,
        (first > 5).mean() if len(first) else 0,
        (first == 1).mean() if len(first) else 0,
        again,
        counts.max() / n,
        len(counts) / n,
        1 - len(set(lines)) / len(lines),
        n / len(lines),
        (sizes == 1).mean() if len(sizes) else 0,
    )
    out[:_KINDS], out[_KINDS:] = shares, shapes
    return out


def _binned(x: np.ndarray, edges: list[np.ndarray]) -> np.ndarray:
    """Column numbers in the one-hot table of bins, one for each statistic."""
    return np.stack([np.searchsorted(e, x[:, j], "right") + j * (BINS + 1) for j, e in enumerate(edges)], axis=1)


def fit_pu(positive: np.ndarray, unlabelled: np.ndarray, prior: float, seed: int = 7) -> tuple[list[np.ndarray], np.ndarray]:
    """Bin edges and weights (the last is the bias) that minimise the non-negative risk by Adam steps."""
    both = np.concatenate([positive, unlabelled])
    levels = np.arange(1, BINS) / BINS
    edges = [np.unique(np.concatenate((np.quantile(both[:, j], levels), [0.0]))) for j in range(both.shape[1])]
    p, u = _binned(positive, edges), _binned(unlabelled, edges)
    w = np.zeros(both.shape[1] * (BINS + 1) + 1)
    m, v, rng = np.zeros_like(w), np.zeros_like(w), np.random.default_rng(seed)

    def push(rows: np.ndarray, slope: np.ndarray) -> np.ndarray:
        g = np.bincount(rows.ravel(), np.repeat(slope, rows.shape[1]), len(w))
        g[-1] = slope.sum()
        return g / max(1, len(rows))

    sigmoid = lambda z: 1 / (1 + np.exp(-np.clip(z, -30, 30)))
    for t in range(1, STEPS + 1):
        some_p, some_u = p[rng.integers(0, len(p), BATCH)], u[rng.integers(0, len(u), BATCH)]
        zp, zu = (w[x].sum(axis=1) + w[-1] for x in (some_p, some_u))
        # Logistic loss: R+ at z is log(1 + e^-z), R- is log(1 + e^z).
        minus = np.logaddexp(0, zu).mean() - prior * np.logaddexp(0, zp).mean()
        plus_slope = push(some_p, -prior * (1 - sigmoid(zp)))
        minus_slope = push(some_u, sigmoid(zu)) - push(some_p, prior * sigmoid(zp))
        # Below zero the negative risk fits noise: step back from it alone.
        g = (plus_slope + minus_slope if minus >= -TOLERANCE else -minus_slope) + RIDGE * w
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        rate = RATE * (1 - t / (STEPS + 1))
        w = w - rate * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-8)
    # Logits are moved so that the prior's share of the unlabelled rows is above one half, and doubled.
    w *= 2
    w[-1] -= np.quantile(w[u].sum(axis=1) + w[-1], 1 - prior)
    return edges, w


def quality_scorer(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality"):
    """A column function from a text to its score, learned as `quality` says."""
    plain = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    known = training_labels(labels, "doc_id", label_col)
    prior, some = known.agg(F.avg("label"), F.count("*")).first()
    prior = 0.5 if not some else float(prior)
    pick = F.xxhash64("id", F.lit(3))
    ids = docs.select(F.col(id_col).cast("long").alias("id")).where("id is not null").distinct()
    trusted = known.where("label = 1").select(F.col("label_id").alias("id"), F.lit(1).alias("kind"))
    any_label = labels.select(F.col("doc_id").cast("long").alias("id")).where("id is not null").distinct()
    web = ids.join(any_label, "id", "left_anti").select("id", F.lit(0).alias("kind"))
    # Two samples of FIT_ROWS ids at most, so this table is small enough to send everywhere.
    trusted = trusted.join(ids, "id", "left_semi").orderBy(pick).limit(FIT_ROWS)
    chosen = trusted.unionByName(web.orderBy(pick).limit(FIT_ROWS))

    def gather(batch: pa.RecordBatch) -> pa.RecordBatch:
        forget()
        x = [statistics(t) for t in batch.column(0).to_pylist()]
        return pa.RecordBatch.from_arrays([pa.array(x, pa.list_(pa.float64())), batch.column(1)], ["x", "kind"])

    rows = plain.join(F.broadcast(chosen), F.col("doc_id").cast("long") == F.col("id")).select("text", "kind")
    seen = mapped(rows, gather, "x array<double>, kind int").toPandas()
    kind, model = seen["kind"].to_numpy(), None
    if (kind == 1).any() and (kind == 0).any():
        x = np.array(seen["x"].tolist())
        order = np.lexsort(x.T)  # the fit does not depend on how the rows arrive
        x, kind = x[order], kind[order]
        model = fit_pu(x[kind == 1], x[kind == 0], prior)

    @F.pandas_udf("double")
    def score(texts: pd.Series) -> pd.Series:
        forget()
        x = np.array([statistics(t) for t in texts]).reshape(len(texts), N_FEATURES)
        if model is None:
            return pd.Series(np.full(len(texts), prior))
        edges, w = model
        return pd.Series(1 / (1 + np.exp(-np.clip(w[_binned(x, edges)].sum(axis=1) + w[-1], -30, 30))))

    return score


def quality(
    docs: DataFrame, labels: DataFrame, *, threshold: float = 0.3, id_col: str = "doc_id", text_col: str = "text",
    label_col: str = "quality",
) -> DataFrame:
    """doc_id, held_out, score and predicted of every row.

    Learns from `labels` (doc_id, `label_col` 0 or 1) where crc32(doc_id) mod 5 is not 0, and
    from documents without a label; each kind gives `FIT_ROWS` ids at most. Null and empty
    texts are scored by their statistics, which are zeros. Rows that repeat are scored each
    for itself; a null id is not held out. Without positives or unlabelled rows every score is
    the class prior, without labels 0.5. Other columns are not read.
    """
    score = quality_scorer(docs, labels, id_col, text_col, label_col)
    scored = docs.select(F.col(id_col).alias("doc_id"), score(F.col(text_col)).alias("score"))
    return scored.select(
        "doc_id",
        F.coalesce(fold("doc_id") == 0, F.lit(False)).alias("held_out"),
        "score",
        (F.col("score") >= threshold).cast("int").alias("predicted"),
    )


def keep_good(docs: DataFrame, labels: DataFrame, *, threshold: float = 0.3, text_col: str = "text", **columns: str) -> DataFrame:
    """The rows of `docs` whose score is `threshold` or more, with all their columns."""
    score = quality_scorer(docs, labels, text_col=text_col, **columns)
    return docs.where(score(F.col(text_col)) >= threshold)

"""Labelled rows: the held-out fold, joins with texts, and a small logistic fit."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Rows of (id, label) that are broadcast; a larger table is joined by a shuffle.
BROADCAST_ROWS = 4_000_000


def fold(id_col: str | Column) -> Column:
    """crc32 of the id as text, modulo 5; 0 is held out. Null for a null id."""
    column = F.col(id_col) if isinstance(id_col, str) else id_col
    return F.crc32(column.cast("string").cast("binary")) % 5


def training_labels(labels: DataFrame, id_col: str, label_col: str) -> DataFrame:
    """(label_id, label, fold) of the rows to learn from; an id with several labels has the largest."""
    return (
        labels.select(F.col(id_col).cast("long").alias("label_id"), F.col(label_col).cast("int").alias("label"))
        .where("label_id is not null and label in (0, 1)")
        .withColumn("fold", fold("label_id"))
        .where("fold != 0")
        .groupBy("label_id", "fold")
        .agg(F.max("label").alias("label"))
    )


def with_labels(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """(text, label, fold) of the labelled rows of `docs` (doc_id, text)."""
    small = labels.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS
    side = F.broadcast(labels) if small else labels
    return docs.join(side, docs["doc_id"].cast("long") == F.col("label_id")).select("text", "label", "fold")


def fit_logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1e-2, steps: int = 60) -> tuple[np.ndarray, ...]:
    """Centre, scale and weights (the last is the bias) of a ridge logistic fit by Newton steps."""
    centre, scale = (x.mean(0), x.std(0) + 1e-9) if len(x) else (np.zeros(x.shape[1]), np.ones(x.shape[1]))
    z = np.hstack([(x - centre) / scale, np.ones((len(x), 1))])
    w = np.zeros(z.shape[1])
    if len(set(y.tolist())) < 2:
        w[-1] = 6.0 if len(y) and y[0] else -6.0
        return centre, scale, w
    penalty = np.full(len(w), ridge)
    penalty[-1] = 1e-9
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(z @ w, -30, 30)))
        step = np.linalg.solve((z * (p * (1 - p))[:, None]).T @ z + np.diag(penalty), z.T @ (y - p) - penalty * w)
        w += step
        if np.abs(step).max() < 1e-8:
            break
    return centre, scale, w


def predict_logistic(x: np.ndarray, model: tuple[np.ndarray, ...]) -> np.ndarray:
    centre, scale, w = model
    return 1 / (1 + np.exp(-np.clip((x - centre) / scale @ w[:-1] + w[-1], -30, 30)))

"""Boosted trees against a plain fold that splits leaves one by one."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tallyline.plans import boosting as B


def _rows(n=700, seed=4):
    rng = random.Random(seed)
    out = []
    for i in range(n):
        a, b, c = rng.gauss(0, 1), round(rng.expovariate(0.2)), rng.choice([0.0, 1.0, 2.5])
        p = 1 / (1 + np.exp(-(1.2 * a * (c > 1) - 0.1 * b + 0.5)))
        out.append((i, a, b, c if i % 17 else None, int(rng.random() < p), 0.5 + (i % 3)))
    return out


NAMES = "id int, a double, b int, c double, y int, w double"


def _plain_cuts(x):
    values, counts = np.unique(x, return_counts=True)
    if len(values) > B.BINS:
        before = np.cumsum(counts) - counts
        bins = B.BINS * before // counts.sum()
        last = np.flatnonzero(np.append(bins[1:] != bins[:-1], False))
    else:
        last = np.arange(len(values) - 1)
    return (values[last] + values[last + 1]) / 2


def _plain(x, y, w, rounds, leaves, min_leaf, held=None):
    """Best leaf first, one split at a time, on the rows themselves."""
    cuts = [_plain_cuts(x[:, f]) for f in range(x.shape[1])]
    share = (w * y).sum() / w.sum()
    base = np.log(share / (1 - share))
    score, train, losses, trees = np.full(len(y), base), np.ones(len(y), bool) if held is None else ~held, [], 0

    def best(rows):
        found = (0.0, -1, 0.0)
        for f in range(x.shape[1]):
            for cut in cuts[f]:
                low = x[rows, f] <= cut
                sides = [rows[low], rows[~low]]
                if min(map(len, sides)) < min_leaf or min(h[s].sum() for s in sides) < B.MIN_HESSIAN:
                    continue
                gain = sum(g[s].sum() ** 2 / (h[s].sum() + B.L2) for s in sides) - g[rows].sum() ** 2 / (h[rows].sum() + B.L2)
                if gain > found[0] + 1e-9:
                    found = (gain, f, cut)
        return found

    while trees < rounds:
        if held is not None:
            losses.append((w[held] * np.logaddexp(0, -np.where(y[held] == 1, 1, -1) * score[held])).sum() / w[held].sum())
            if B._stalled(losses):
                break
        p = 1 / (1 + np.exp(-score))
        g, h = w * (p - y), w * p * (1 - p)
        parts = [(np.flatnonzero(train), np.arange(len(y)))]
        gains = [best(parts[0][0])]
        while len(parts) < leaves:
            k = int(np.argmax([gain for gain, *_ in gains]))
            gain, f, cut = gains[k]
            if gain <= 0:
                break
            (rows, every), _ = parts.pop(k), gains.pop(k)
            for side in (lambda r: x[r, f] <= cut, lambda r: x[r, f] > cut):
                parts.append((rows[side(rows)], every[side(every)]))
                gains.append(best(parts[-1][0]))
        for rows, every in parts:
            score[every] -= B.LEARNING_RATE * g[rows].sum() / (h[rows].sum() + B.L2)
        trees += 1
        if len(parts) == 1:
            break
    return score, trees


def _matrix(rows, names):
    place = {"a": 1, "b": 2, "c": 3}
    return np.array([[float(r[place[n]] or 0) for n in names] for r in rows])


def _columns(rows):
    return np.array([r[4] for r in rows], float), np.array([r[5] for r in rows])


@pytest.mark.parametrize("leaves, min_leaf, near", [(2, 20, True), (7, 25, False), (15, 5, True)])
def test_trees_equal_a_plain_fold(spark, leaves, min_leaf, near, monkeypatch):
    if not near:
        monkeypatch.setattr(B, "SMALL_BYTES", 0)
    rows = _rows()
    (model,) = B.fit_many(spark.createDataFrame(rows, NAMES), [B.Fit(("a", "b", "c"), rounds=6, leaves=leaves, min_leaf=min_leaf)], "y", "w")
    x, (y, w) = _matrix(rows, "abc"), _columns(rows)
    score, trees = _plain(x, y, w, 6, leaves, min_leaf)
    assert len(model.roots) == trees == 6
    assert model.raw(x) == pytest.approx(score, abs=1e-9)
    assert np.bincount(np.searchsorted(model.roots, np.arange(len(model.feature)), "right"))[1:].max() <= 2 * leaves - 1


@pytest.mark.parametrize("small", [0, 1 << 30])
def test_models_side_by_side_equal_models_alone(spark, monkeypatch, small):
    monkeypatch.setattr(B, "SMALL_BYTES", small)
    monkeypatch.setattr(B, "BLOCK_ROWS", 130)
    monkeypatch.setattr(B, "CHECKPOINT_ROUNDS", 2)
    rows = _rows()
    df = spark.createDataFrame(rows, NAMES)
    fits = [
        B.Fit(("a", "b"), F.col("a") < 0.5, "low", 4, 5, 10),
        B.Fit(("c", "a"), F.col("a") < 0.5, "low", 7, 3, 10),
        B.Fit(("b", "c"), F.lit(True), "all", 5, 4, 30),
    ]
    models = B.fit_many(df, fits, "y", "w")
    for fit, model, names in zip(fits, models, ("ab", "ca", "bc")):
        some = [r for r in rows if r[1] < 0.5] if fit.period == "low" else rows
        score, _ = _plain(_matrix(some, names), *_columns(some), fit.rounds, fit.leaves, fit.min_leaf)
        assert len(model.roots) == fit.rounds
        assert model.raw(_matrix(some, names)) == pytest.approx(score, abs=1e-9)


def test_stops_when_held_out_rows_gain_nothing(spark, monkeypatch):
    monkeypatch.setattr(B, "EARLY_STOP_ROWS", 100)
    # Trees grow on the driver here: a task would not see the changed rate.
    monkeypatch.setattr(B, "SMALL_BYTES", 0)
    monkeypatch.setattr(B, "LEARNING_RATE", 0.8)
    rows = _rows()
    df = spark.createDataFrame(rows, NAMES)
    (model,) = B.fit_many(df, [B.Fit(("a", "b", "c"), rounds=200, leaves=8, min_leaf=5)], "y", "w")
    clean = df.na.fill(0.0, ["c"]).select("id", (F.pmod(F.xxhash64(*[F.col(c).cast("double") for c in "abc"], "y"), F.lit(B.HELD_OUT)) == 0).alias("held"))
    held = np.array([r.held for r in clean.orderBy("id").collect()])
    x, (y, w) = _matrix(rows, "abc"), _columns(rows)
    score, trees = _plain(x, y, w, 200, 8, 5, held)
    assert len(model.roots) == trees < 60
    assert model.raw(x) == pytest.approx(score, abs=1e-8)


def test_saved_models_score_alike(spark, tmp_path):
    rows = _rows(200)
    df = spark.createDataFrame(rows, NAMES)
    (model,) = B.fit_many(df, [B.Fit(("a", "c"), rounds=3, leaves=4, min_leaf=10)], "y")
    model.save(spark, str(tmp_path / "m"))
    loaded = B.Trees.load(spark, str(tmp_path / "m"))
    x = _matrix(rows, "ac")
    assert (loaded.raw(x) == model.raw(x)).all() and loaded.features == ("a", "c")
    p = [r.p for r in df.na.fill(0.0).select("id", loaded.probability([F.col("a"), F.col("c")]).alias("p")).orderBy("id").collect()]
    assert p == pytest.approx(1 / (1 + np.exp(-model.raw(x))))


def test_edges(spark):
    flat = spark.createDataFrame([(1.0, 1), (1.0, 0), (float("nan"), 1)], "x double, y int")
    (model,) = B.fit_many(flat, [B.Fit(("x",), min_leaf=1)], "y")
    # NaN counts as 0, so the two sides are (1, 0) and (1).
    assert model.raw(np.array([[1.0]])) == pytest.approx(0, abs=0.1) and model.raw(np.array([[0.0]])) > 1
    (sure,) = B.fit_many(flat.where("y = 1"), [B.Fit(("x",), rounds=3, min_leaf=1)], "y")
    assert sure.raw(np.array([[1.0]]))[0] > 10
    with pytest.raises(ValueError):
        B.fit_many(flat.where("y > 5"), [B.Fit(("x",))], "y")

"""Results that several passes read are computed once."""

import datetime as dt

import numpy as np
from pyspark.sql import functions as F

from tallyline.operators import frames
from tallyline.plans import boosting as B
from tallyline.plans import train as T


def _plan(df) -> str:
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_checked_pairs_are_built_once(spark):
    rows = spark.createDataFrame(
        [(1, "A", 1, "PRE_TOSS", 3.0), (1, "B", 0, "PRE_TOSS", 1.0)], "match_id long, team string, team_win int, prediction_mode string, x double"
    )
    out = frames.checked_pairs(frames.pair_rows(rows, sources=["x"], carry=[]))
    assert "Aggregate" not in _plan(out)
    assert [tuple(r) for r in out.collect()] == [(1, "A", "B", 1, 2.0)]


def test_weights_are_joined_once_for_all_fits(spark, monkeypatch):
    day = dt.date(2020, 1, 1)
    rows = [(k // 2, day + dt.timedelta(days=k // 4), float(k % 5), k % 2) for k in range(40)]
    frame = spark.createDataFrame(rows, "match_id long, date date, x double, y int")
    seen = []

    def fitted(train, cases, label, weight, mirror):
        seen.append((_plan(train), train.agg(F.sum(weight), F.count(weight)).first()))
        return [None for _ in cases]

    monkeypatch.setattr(T, "fitted", fitted)
    T.train_domain(
        frame, mode="LIVE", domain="LIVE", features=["x"], label="y", train_end="2020-01-04", valid_end="2020-01-07", candidates=(),
        weighted=True, mirror=False, elo_feature="x",
    )
    assert [plan.count("Join") for plan, _ in seen] == [0, 0]
    assert [(round(total, 9), n) for _, (total, n) in seen] == [(16.0, 16), (28.0, 28)]


def test_leaves_counted_together_equal_leaves_counted_one_by_one():
    rng = np.random.default_rng(3)
    n = 500
    bins = rng.integers(0, 256, (1, 2, n)).astype(np.uint8)
    block = {"bins": bins, "masks": rng.random((1, n)) < 0.8, "y": rng.random(n) < 0.5, "w": rng.random(n), "held": np.zeros(n, bool), "score": rng.normal(size=(1, n))}
    tree = B._Tree()
    left, right = tree.split(0, 0, 100)
    low, high = tree.split(right, 1, 60)
    (sums,) = B._counted({0: (tree, [high, left])}, [0], [[0, 1]], [False], False)([block, block])
    on, at = block["masks"][0], tree.leaf_of(bins[0])
    p = 1 / (1 + np.exp(-block["score"][0]))
    for leaf in (high, left):
        mine = on & (at == leaf)
        for f in range(2):
            for k, v in enumerate((block["w"] * (p - block["y"]), block["w"] * p * (1 - p), np.ones(n))):
                assert np.allclose(sums[0, leaf][k, f], 2 * np.bincount(bins[0, f, mine], v[mine], 256))
    assert (0, low) not in sums

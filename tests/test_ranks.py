"""Ranks against a plain sort, and ranges of distributions that no fixed grid cuts evenly."""

import random
import statistics

import pytest
from pyspark.sql import functions as F

from tallyline.operators import metrics, ranks


def _plain(rows):
    out = {}
    for group, value, w in rows:
        smaller = sum(x for g, v, x in rows if g == group and (v is None or (value is not None and v < value)) and v != value)
        out[group, value] = smaller
    return out


@pytest.mark.parametrize("rows", [None, 1, 7, 40])
def test_weights_below_each_value(spark, rows):
    rng = random.Random(5)
    data = [(g, v, rng.randrange(5)) for g in ("a", "b", None) for v in rng.sample(range(-50, 50), 40)] + [("a", None, 3), ("one", 1, 2)]
    df = spark.createDataFrame(data, "g string, v int, w long")
    got = {(r.g, r.v): r.w_below for r in ranks.below(df, ["g"], "v", ["w"], rows).collect()}
    assert got == _plain(data)


@pytest.mark.parametrize(
    "value",
    [
        "CASE id WHEN 0 THEN 0D WHEN 1 THEN 1D ELSE 0.4999D + id * 1e-9D END",
        "CASE id WHEN 0 THEN 0D ELSE 1000 + id / 200001D END",
        "exp(id / 1000D)",
    ],
)
def test_no_range_outgrows_the_others(spark, value):
    """Half of all values in a sliver of the span, a far outlier, a heavy tail: the largest range is below twice the mean."""
    hist = spark.range(200_001).select(F.lit(0).alias("g"), F.expr(value).alias("v"), F.lit(1).alias("w")).distinct()
    n = hist.count()
    sizes = [r["count"] for r in ranks.ranged(hist, ["g"], "v", 10_000).groupBy("_range").count().collect()]
    assert sum(sizes) == n and len(sizes) == -(-n // 10_000) and max(sizes) < 2 * n / len(sizes)


@pytest.mark.parametrize("rows", [3, 1_000_000])
def test_medians_and_auc_over_ranges(spark, rows, monkeypatch):
    monkeypatch.setattr(ranks, "RANGE_ROWS", rows)
    rng = random.Random(8)
    data = [(g, round(rng.expovariate(1) ** 4, 2), rng.randrange(2)) for g in "xy" for _ in range(60)]
    df = spark.createDataFrame(data, "g string, v double, y int")
    got = {r.g: r.m for r in metrics.exact_median(df, "v", ["g"], "m").collect()}
    assert got == {g: statistics.median(v for h, v, _ in data if h == g) for g in "xy"}
    for r in metrics.roc_auc(df, "y", "v", ["g"]).collect():
        pos = [v for g, v, y in data if g == r.g and y]
        neg = [v for g, v, y in data if g == r.g and not y]
        wins = sum((p > q) + 0.5 * (p == q) for p in pos for q in neg)
        assert r.roc_auc == pytest.approx(wins / len(pos) / len(neg))

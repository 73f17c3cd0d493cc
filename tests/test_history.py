"""The history operator against a plain fold, with and without split keys."""

import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from tallyline.operators.history import running


def _rows(seed, n=300):
    rng = random.Random(seed)
    rows = []
    for i in range(n):
        key = "hot" if rng.random() < 0.5 else rng.choice("abcd")
        day = dt.date(2024, 1, 1) + dt.timedelta(days=rng.randrange(40))
        name = rng.choice([None, "x", "y", "z"])
        rows.append((key, day, i, rng.random() < 0.7, rng.randrange(10), name))
    return rows


def _fold(rows, include_current):
    expected = {}
    books = {}
    for key, day, i, counts, v, name in sorted(rows, key=lambda r: (r[0], r[1], r[2])):
        book = books.setdefault(key, [])
        if include_current and counts:
            book.append((v, name))
        known = [n for _, n in book if n is not None]
        expected[i] = (
            sum(x for x, _ in book),
            len(book),
            sum(x for x, _ in book[-3:]),
            sum(x for x, _ in book[-7:]),
            known[-1] if known else None,
        )
        if not include_current and counts:
            book.append((v, name))
    return expected


@pytest.mark.parametrize("max_rows", [None, 11, 60])
@pytest.mark.parametrize("include_current", [False, True])
@pytest.mark.parametrize("probes", [False, True])
def test_running_equals_fold(spark, max_rows, include_current, probes):
    rows = _rows(7)
    if not probes:
        rows = [(k, d, i, True, v, n) for k, d, i, _, v, n in rows]
    df = spark.createDataFrame(rows, "k string, day date, id int, counts boolean, v int, name string")
    out = running(
        df,
        ["k"],
        ["day", "id"],
        totals={"total": F.col("v"), "n": F.lit(1)},
        recent={"last3": (F.col("v"), 3), "last7": (F.col("v"), 7)},
        latest={"name_before": F.col("name")},
        counts=F.col("counts") if probes else None,
        include_current=include_current,
        max_rows=max_rows,
    )
    got = {r["id"]: (r["total"], r["n"], r["last3"], r["last7"], r["name_before"]) for r in out.collect()}
    assert got == _fold(rows, include_current)


def test_many_small_pieces_stay_in_few_ranges(spark):
    """A low limit and many keys above it: short pieces in order, without a task, a cut point or a broadcast row for each."""
    from tallyline.operators.sizing import hot_keys, with_chunk

    df = spark.range(6000).select((F.col("id") % 100).alias("k"), F.col("id").alias("at"))
    found = hot_keys(df, ["k"], 8)
    assert found[0].count() == 100 and found[1] == 6000
    cut = with_chunk(df, ["k"], ["at"], *found, 8)
    assert len(cut.inputFiles()) <= 2 and cut.count() == 6000
    pieces = cut.groupBy("k", "_chunk").agg(F.count(F.lit(1)).alias("n"), F.min("at").alias("a"), F.max("at").alias("b")).collect()
    assert max(p["n"] for p in pieces) <= 8 and len(pieces) >= 1500
    by_key = {}
    for p in sorted(pieces, key=lambda p: (p["k"], p["_chunk"])):
        assert by_key.get(p["k"], -1) < p["a"]
        by_key[p["k"]] = p["b"]
    out = running(df, ["k"], ["at"], totals={"n": F.lit(1)}, recent={"last": (F.lit(1), 20)}, max_rows=8)
    assert "strategy=broadcast" not in out._jdf.queryExecution().logical().toString()
    wrong = out.where((F.col("n") != F.floor(F.col("at") / 100)) | (F.col("last") != F.least(F.col("n"), F.lit(20))))
    assert out.count() == 6000 and wrong.count() == 0

import datetime as dt
import random

import pytest

from tallyline.operators.elo import elo_after, elo_before

SCHEMA = "format string, sex string, date date, kind int, match_id string, asks boolean, side1 string, side2 string, score double"


def _contests(n=400, seed=3):
    rng = random.Random(seed)
    rows = []
    for i in range(n):
        pool = "T20" if rng.random() < 0.7 else "ODI"
        a, b = rng.sample("ABCDE", 2)
        day = dt.date(2024, 1, 1) + dt.timedelta(days=i // 2)
        score = rng.choice([1.0, 1.0, 0.0, 0.5, None])
        rows.append((pool, "m", day, 1, f"{i:04d}", True, a, b, score))
    return rows


def _sequential(rows, seed=None):
    ratings = dict(seed or {})
    out = {}
    for pool, sex, _, _, mid, _, a, b, score in sorted(rows, key=lambda r: (r[2], r[3], r[4])):
        ra, rb = ratings.get((pool, a), 1500.0), ratings.get((pool, b), 1500.0)
        out[mid] = (ra, rb)
        if score is not None:
            expected = 1 / (1 + 10 ** ((rb - ra) / 400))
            ratings[pool, a] = ra + 20 * (score - expected)
            ratings[pool, b] = rb + 20 * ((1 - score) - (1 - expected))
    return out, ratings


@pytest.mark.parametrize("max_rows", [None, 40, 150])
def test_fold_equals_sequential(spark, max_rows):
    rows = _contests()
    df = spark.createDataFrame(rows, SCHEMA)
    expected, final = _sequential(rows)
    got = {r.match_id: (r.elo1, r.elo2) for r in elo_before(df, max_rows=max_rows).collect()}
    assert got.keys() == expected.keys()
    for mid, pair in expected.items():
        assert got[mid] == pytest.approx(pair, abs=1e-6)
    after = {(r.format, r.team): r.rating for r in elo_after(df, max_rows=max_rows).collect()}
    assert after == pytest.approx(final, abs=1e-6)


@pytest.mark.parametrize("max_rows", [None, 30])
def test_continues_from_earlier_ratings(spark, max_rows):
    rows = _contests()
    early, late = rows[:200], rows[200:]
    first = elo_after(spark.createDataFrame(early, SCHEMA))
    rest = elo_before(spark.createDataFrame(late, SCHEMA), ratings_in=first, max_rows=max_rows)
    expected, _ = _sequential(rows)
    for r in rest.collect():
        assert (r.elo1, r.elo2) == pytest.approx(expected[r.match_id], abs=1e-6)


def test_fixture_values(spark):
    rows = [
        ("T20I", "", dt.date(2024, 6, 1), 1, "m1", True, "India", "Australia", 1.0),
        ("T20I", "", dt.date(2024, 6, 8), 1, "m2", True, "Australia", "India", 1.0),
    ]
    got = {r.match_id: r for r in elo_before(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert got["m1"].elo1 == got["m1"].elo2 == 1500.0
    assert got["m2"].elo2 == 1510.0 and got["m2"].elo1 == 1490.0


def _two_leagues(n=300):
    """One pool, two leagues whose teams never meet; a lone team that only asks against itself is none."""
    rng = random.Random(11)
    rows = []
    for i in range(n):
        a, b = rng.sample(rng.choice(["ABCD", "WXYZ"]), 2)
        rows.append(("T20", "m", dt.date(2024, 1, 1) + dt.timedelta(days=i // 3), 1, f"{i:04d}", True, a, b, rng.choice([1.0, 0.0, 0.5, None])))
    return rows


def test_leagues_that_never_meet_are_walked_apart(spark):
    from tallyline.operators import elo

    rows = _two_leagues()
    df = spark.createDataFrame(rows, SCHEMA)
    # Each league is within the limit, both together are not: two walks, no slices.
    limit = max(sum(r[6] in side for r in rows) for side in ("ABCD", "WXYZ"))
    walks, _ = elo._staged(df, None, limit, elo.K_FACTOR, elo.INITIAL, 0.0)
    assert {(r._league, r._chunk) for r in walks.select("_league", "_chunk").distinct().collect()} == {("A", 0), ("W", 0)}
    whole = {r.match_id: (r.elo1, r.elo2) for r in elo_before(df).collect()}
    apart = {r.match_id: (r.elo1, r.elo2) for r in elo_before(df, max_rows=limit).collect()}
    assert apart == whole
    # A smaller limit cuts inside the leagues alone.
    walks, _ = elo._staged(df, None, 60, elo.K_FACTOR, elo.INITIAL, 0.0)
    found = {(r._league, r._chunk) for r in walks.select("_league", "_chunk").distinct().collect()}
    assert {x for x, _ in found} == {"A", "W"} and len(found) >= 5
    assert {r.match_id: (r.elo1, r.elo2) for r in elo_before(df, max_rows=60).collect()} == whole


def test_ratings_of_leagues_continue(spark):
    rows = _two_leagues()
    first = elo_after(spark.createDataFrame(rows[:150], SCHEMA))
    extra = spark.createDataFrame([("T20", "m", "Q", 1700.0)], "format string, sex string, team string, rating double")
    late = spark.createDataFrame(rows[150:], SCHEMA)
    whole = {(r.team): r.rating for r in elo_after(late, ratings_in=first.unionByName(extra)).collect()}
    assert {(r.team): r.rating for r in elo_after(late, ratings_in=first.unionByName(extra), max_rows=100).collect()} == whole
    assert whole["Q"] == 1700.0


def test_components_of_a_long_path(spark):
    from tallyline.operators.graph import components

    edges = [("k", f"{i:03d}", f"{i + 1:03d}") for i in range(60)] + [("k", "x", "y"), ("l", "005", "x"), ("k", None, "z")]
    df = spark.createDataFrame(edges, "p string, a string, b string")
    got = {(r.p, r.node): r.component for r in components(df, ["p"], "a", "b").collect()}
    assert got == {**{("k", f"{i:03d}"): "000" for i in range(61)}, ("k", "x"): "x", ("k", "y"): "x", ("l", "005"): "005", ("l", "x"): "005"}


def test_slices_are_few_however_many_rows(spark, monkeypatch):
    from tallyline.operators import elo

    monkeypatch.setattr(elo, "MAX_SLICES", 5)
    df = spark.createDataFrame(_contests(), SCHEMA)
    walks, _ = elo._staged(df, None, 20, elo.K_FACTOR, elo.INITIAL, 0.0)
    # A slice in which one pool ends and the next begins counts for both.
    assert 3 <= walks.select(*elo.WALK, "_chunk").distinct().count() <= 6
    whole = {r.match_id: (r.elo1, r.elo2) for r in elo_before(df).collect()}
    assert {r.match_id: (r.elo1, r.elo2) for r in elo_before(df, max_rows=20).collect()} == whole


def test_a_round_of_slices_is_stored_once(spark, monkeypatch):
    """What the driver plans and keeps for a round: one stored table of ratings, from the walks themselves."""
    from tallyline.operators import elo

    pins, rounds, pin, run = [], [], elo.pin, elo._run
    monkeypatch.setattr(elo, "MAX_SLICES", 5)
    monkeypatch.setattr(elo, "pin", lambda df: pins.append(1) or pin(df))
    monkeypatch.setattr(elo, "_run", lambda *a: rounds.append(1) or run(*a))
    df = spark.createDataFrame(_contests(), SCHEMA)
    elo._staged(df, None, 20, elo.K_FACTOR, elo.INITIAL, 0.0)
    # The big pools, the grid of slices and teams, and its first state are stored, too.
    assert len(rounds) >= 3 and len(pins) == 3 + len(rounds)

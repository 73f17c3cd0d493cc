"""Tables as long as the input are merged: none is broadcast, however few bytes its stored file has."""

import datetime as dt

from tallyline.operators.participants import lineup_members, player_state
from tallyline.operators import contests as C
from tallyline.plans.features import team_history
from tallyline.session import staged

CONTESTS = (
    "match_id long, date date, format string, gender string, competition string, venue string, team1 string, team2 string, "
    "winner string, result_type string, batting_first string, first_total double, "
    "team1_players array<string>, team2_players array<string>"
)
SPELLS = "match_id long, innings int, player string, runs double, balls double, out boolean, wickets long, first_seq long"


def _tables(spark, n=40):
    rows, spells = [], []
    for i in range(n):
        a, b = "ABCD"[i % 4], "ABCD"[(i + 1 + i // 4 % 3) % 4]
        sides = [f"{a}{k}" for k in range(3)], [f"{b}{k}" for k in range(3)]
        rows.append((i, dt.date(2024, 1, 1) + dt.timedelta(days=i), "T20", "male", "x", "oval", a, b, a if i % 3 else b, "win", a, 100.0 + i, *sides))
        spells += [(i, 1, p, 10.0 + i, 12.0, i % 2 == 0, 1, k) for k, p in enumerate(sides[0] + sides[1])]
    return staged(spark.createDataFrame(rows, CONTESTS)), staged(spark.createDataFrame(spells, SPELLS))


def _joins(df):
    return [x.strip() for x in df._jdf.queryExecution().sparkPlan().toString().splitlines() if "Join" in x]


def test_history_broadcasts_no_contests(spark):
    contests, spells = _tables(spark)
    history = team_history(contests, spells, spells)
    joins = _joins(history)
    assert len(joins) >= 4 and all("SortMergeJoin" in x for x in joins)
    rows = {(r.match_id, r.side): r for r in history.collect()}
    assert len(rows) == 80
    assert rows[0, 1].team_elo_before == 1500.0 and rows[0, 1].xi_batters_with_history == 0
    assert rows[1, 1].venue_decided_matches == 1 and rows[39, 1].venue_decided_matches == 39
    assert rows[39, 2].xi_bowlers_with_history == 3


def test_counting_members_broadcasts_no_contests(spark):
    """The list of members keeps the joins of the history, but only the ids of its sides."""
    contests, spells = _tables(spark)
    rows = team_history(contests)
    members = lineup_members(rows, rows["xi"])
    assert all("SortMergeJoin" in x for x in _joins(members))
    state = player_state(C.prepare(contests), spells, spells, members)
    assert all("SortMergeJoin" in x for x in _joins(state))
    assert state.count() == 240


def test_contests_of_orders_broadcast_no_customers(spark, tmp_path):
    from checks import views as V

    rows = {
        "region": [(0, "x")], "nation": [(0, "A", 0), (1, "B", 0)],
        "customer": [(k, "c", k % 2, 1.0, "BUILDING") for k in range(4)], "supplier": [(k, "s", k % 2, 1.0) for k in range(4)],
        "orders": [(k, k % 4, "F", 30000.0, dt.datetime(1997, 1, 1 + k), "1-URGENT") for k in range(8)],
        "lineitem": [(k, 1, (k + 1) % 4, 1, 5.0, 1.0, 0.0, 0.0, "N", "O", dt.datetime(1997, 1, 1 + k)) for k in range(8)],
    }
    for name, data in rows.items():
        spark.createDataFrame(data, V.SCHEMAS[name]).write.parquet(f"{tmp_path}/{name}.parquet")
    found = V.contests(spark, str(tmp_path))
    assert not [x for x in _joins(found) if "c_custkey" in x and "Broadcast" in x]
    assert found.count() == 8

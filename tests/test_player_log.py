import datetime as dt

from pyspark.sql import functions as F

from tallyline.operators import contests as C
from tallyline.operators import participants as P


def _state(spark, max_rows=None):
    day = dt.date(2020, 1, 1)
    contests = spark.createDataFrame(
        [(i, day + dt.timedelta(days=i // 2), "T20", "male", "A", "B", "A", "win", ["p", "q"], ["p", "r"]) for i in range(40)],
        "match_id long, date date, format string, gender string, team1 string, team2 string, winner string, "
        "result_type string, team1_players array<string>, team2_players array<string>",
    ).withColumn("venue", F.lit("G"))
    rows = [(i, i % 2, "p" if i % 3 else "q", i % 7, 6 + i % 5, i % 4 == 0, i) for i in range(40)]
    batting = spark.createDataFrame(rows, "match_id long, innings int, player string, runs int, balls int, out boolean, first_seq long")
    bowling = batting.where("match_id % 5 > 1").withColumn("wickets", F.col("runs") % 3).drop("out")
    prepared = C.prepare(contests)
    members = P.lineup_members(C.team_rows(prepared), F.col("xi"))
    return P.player_state(prepared, batting, bowling, members, max_rows)


def test_players_of_some_cut_keys_read_the_same_records(spark):
    # p and q have over 60 rows and are cut, r has 40 and is not.
    whole, cut = _state(spark), _state(spark, max_rows=60)
    assert whole.count() == 160
    assert whole.exceptAll(cut).isEmpty() and cut.exceptAll(whole).isEmpty()
    last = whole.where("match_id = 39 and player = 'q'").first()
    runs = [i % 7 for i in range(0, 39, 3)]
    assert (last.bat_innings, last.bat_runs, last.recent_runs) == (13, sum(runs), sum(runs[-5:]))


def test_the_log_is_dealt_once_by_player(spark):
    plan = _state(spark)._jdf.queryExecution().executedPlan().toString()
    dealt = [line for line in plan.splitlines() if "Exchange hashpartitioning(format" in line]
    assert len(dealt) == 1

import datetime as dt
import json

import pytest
from pyspark.sql import functions as F

from tallyline.streaming import live as S

BALL = "match_id string, innings int, seq long, ts timestamp, batting_team string, runs_total long, wicket boolean, is_wide boolean, is_noball boolean"


def _ball(seq, runs=1, match="m", wicket=False, wide=False):
    return (match, 1, seq, dt.datetime(2024, 1, 1, 10, 0, seq % 60), "A", runs, wicket, wide, False)


def _write(spark, folder, name, rows):
    spark.createDataFrame(rows, BALL).coalesce(1).write.mode("append").parquet(f"{folder}")


def _drain(df, sink, checkpoint):
    S.run_available(df.writeStream.format("parquet").option("path", sink).outputMode("append"), checkpoint)


def test_running_score_with_late_rows(spark, tmp_path):
    source, sink, ckpt = (str(tmp_path / n) for n in ("in", "out", "ckpt"))
    _write(spark, source, "a", [_ball(3, 4), _ball(1, 1), _ball(2, 0, wicket=True), _ball(1, 9, match="n")])
    stream = lambda: S.running_score(spark.readStream.schema(BALL).parquet(source))
    _drain(stream(), sink, ckpt)
    _write(spark, source, "b", [_ball(2, 6), _ball(4, 1, wide=True), _ball(5, 2)])
    _drain(stream(), sink, ckpt)
    rows = spark.read.parquet(sink).where("match_id = 'm'").orderBy("seq", "late").collect()
    assert [(r.seq, r.runs, r.wickets, r.legal_balls_bowled, r.late) for r in rows] == [
        (1, 1, 0, 1, False), (2, 1, 1, 2, False), (2, 8, 1, 4, True), (3, 5, 1, 3, False), (4, 6, 1, 3, False),
        (5, 8, 1, 4, False),
    ]


def test_feed_stream_drops_repeats(spark, tmp_path):
    folder = tmp_path / "feed"
    folder.mkdir()
    rec = {
        "id": "1", "name": "A vs B", "matchType": "t20", "status": "live", "date": "2026-01-01", "teams": ["A", "B"],
        "matchStarted": True, "matchEnded": False, "score": [{"r": 10, "w": 0, "o": 2, "inning": "A Inning 1"}],
    }
    (folder / "1.json").write_text(json.dumps({"status": "success", "data": [rec, rec]}))
    (folder / "2.json").write_text(json.dumps({"status": "success", "data": [rec, {**rec, "status": "A won by 3 runs"}]}))
    sink = str(tmp_path / "out")
    _drain(S.feed_updates(spark, str(folder)), sink, str(tmp_path / "ckpt"))
    rows = spark.read.parquet(sink).collect()
    assert sorted((r.status, r.predictable) for r in rows) == [("A won by 3 runs", False), ("live", True)]


def test_ratings_follow_the_stream(spark, tmp_path):
    schema = "match_id string, date date, format string, gender string, venue string, team1 string, team2 string, winner string, result_type string"
    source, root = str(tmp_path / "contests"), str(tmp_path / "ratings")
    days = [("m1", "2024-06-01", "India"), ("m2", "2024-06-08", "Australia"), ("m3", "2024-06-09", "India")]
    rows = [(m, dt.date.fromisoformat(d), "T20I", None, None, "India", "Australia", w, "win") for m, d, w in days]
    for part in (rows[:2], rows[2:]):
        spark.createDataFrame(part, schema).coalesce(1).write.mode("append").parquet(source)
        S.run_available(S.update_ratings(spark.readStream.schema(schema).parquet(source), root), str(tmp_path / "ck"))
    from tallyline.operators import contests as C
    from tallyline.operators.elo import contest_scores, elo_after

    whole = {r.team: r.rating for r in elo_after(contest_scores(C.prepare(spark.createDataFrame(rows, schema)))).collect()}
    last = {r.team: r.rating for r in spark.read.parquet(f"{root}/version=1").collect()}
    assert last == pytest.approx(whole)


def test_late_contests_are_replayed(spark, tmp_path):
    schema = "match_id string, date date, format string, gender string, venue string, team1 string, team2 string, winner string, result_type string"
    source, root = str(tmp_path / "contests"), str(tmp_path / "ratings")
    sides = [("India", "Australia"), ("England", "India"), ("Australia", "England")]

    def row(n, day):
        one, two = sides[n % 3]
        return (f"m{n:02}", dt.date(2024, 6, day), "T20I", None, None, one, two, (one, two)[n % 2], "win")

    # Two batches in order, a late one, one in order, a late one of a day that another batch has, and an undated contest.
    batches = [
        [row(1, 5), row(2, 6)], [row(3, 9), row(4, 9)], [row(5, 7), row(6, 2)], [row(7, 12)], [row(8, 9), row(9, 14)],
        [("x", None, *row(10, 1)[2:])],
    ]
    from tallyline.operators import contests as C
    from tallyline.operators.elo import contest_scores, elo_after

    for k in range(len(batches)):
        spark.createDataFrame(batches[k], schema).coalesce(1).write.mode("append").parquet(source)
        S.run_available(S.update_ratings(spark.readStream.schema(schema).parquet(source), root), str(tmp_path / "ck"))
        rows = [r for b in batches[: k + 1] for r in b]
        whole = {r.team: r.rating for r in elo_after(contest_scores(C.prepare(spark.createDataFrame(rows, schema)))).collect()}
        assert {r.team: r.rating for r in spark.read.parquet(f"{root}/version={k}").collect()} == whole
    # What each batch starts from: the newest version before its days that no late contest has touched.
    assert [S._last_sound(spark, root, k) for k in range(1, 6)] == [
        (0, dt.date(2024, 6, 6)), None, (2, dt.date(2024, 6, 9)), None, (4, dt.date(2024, 6, 14)),
    ]

import json
import os

from tallyline.streaming import live as S
from tallyline.streaming import pages as P


def record(match, status="live", runs=10, teams=("A", "B")):
    return {
        "id": match, "name": "A vs B", "matchType": "t20", "status": status, "date": "2026-01-01", "teams": list(teams),
        "matchStarted": True, "matchEnded": False, "score": [{"r": runs, "w": 0, "o": 2, "inning": "A Inning 1"}],
    }


def test_newest_record_over_three_micro_batches(spark, tmp_path):
    folder, sink, ckpt = (str(tmp_path / n) for n in ("feed", "out", "ckpt"))
    os.mkdir(folder)

    def page(name, at, records, status="success"):
        with open(f"{folder}/{name}.json", "w") as out:
            json.dump({"status": status, "data": records}, out)
        os.utime(f"{folder}/{name}.json", (1_700_000_000 + at, 1_700_000_000 + at))

    def run():
        rows = P.newest_records(spark, folder)
        S.run_available(rows.writeStream.format("parquet").option("path", sink).outputMode("append"), ckpt)
        stored = spark.read.schema(rows.schema).parquet(sink)
        return stored, {r.match_id: (r.status, r.scores[0].runs) for r in P.current(stored).collect()}

    page("one", 10, [record("1"), record("1", runs=12), record("2", "rain"), record(" "), None])
    page("two", 20, [record("2", runs=30)])
    stored, now = run()
    assert now == {"1": ("live", 12), "2": ("live", 30)} and stored.count() == 2
    # A repeat, a record with one team, and a failed page change nothing.
    page("three", 30, [record("1", runs=12), record("2", runs=99, teams=("A",)), record("3", runs=1)])
    page("four", 40, [record("1", runs=77)], status="failure")
    stored, now = run()
    assert now == {"1": ("live", 12), "2": ("live", 30), "3": ("live", 1)} and stored.count() == 3
    # An older page that comes late loses, a newer one wins.
    page("five", 5, [record("1", runs=2)])
    page("six", 60, [record("2", "A won by 3 runs", 31)])
    stored, now = run()
    assert now == {"1": ("live", 12), "2": ("A won by 3 runs", 31), "3": ("live", 1)} and stored.count() == 4

import datetime as dt
import random

from tallyline.streaming import live as S
from tallyline.streaming import ordered as O

BALL = "match_id string, innings int, seq long, ts timestamp, batting_team string, runs_total long, wicket boolean, is_wide boolean, is_noball boolean"
START = dt.datetime(2024, 1, 1, 10)
DAY = 24 * 3600


def ball(seq, second, match="m", runs=1, wicket=False, wide=False):
    return (match, 1, seq, START + dt.timedelta(seconds=second), "A", runs, wicket, wide, False)


def drain(spark, tmp_path, batches, **how):
    """Each batch of rows as a micro-batch of its own, in one run after the other."""
    source, sink, ckpt = (str(tmp_path / n) for n in ("in", "out", "ckpt"))
    for rows in batches:
        spark.createDataFrame(rows, BALL).coalesce(1).write.mode("append").parquet(source)
        scores = O.ordered_score(spark.readStream.schema(BALL).parquet(source), **how)
        S.run_available(scores.writeStream.format("parquet").option("path", sink).outputMode("append"), ckpt)
    return spark.read.parquet(sink).collect()


def folded(rows):
    out, state = {}, {}
    for match, _, seq, _, _, runs, wicket, wide, _ in sorted(rows, key=lambda r: (r[0], r[2])):
        r, w, b = state.get(match, (0, 0, 0))
        state[match] = out[match, seq] = (r + runs, w + int(wicket), b + int(not wide))
    return out


def test_shuffled_batches_give_the_batch_result(spark, tmp_path):
    rng = random.Random(4)
    rows = [
        ball(k, 40 * k, m, rng.randrange(7), rng.random() < 0.1, rng.random() < 0.1) for m in ("m", "n") for k in range(1, 121)
    ]
    # Out of order by less than the delay: 300 seconds of noise against 10 minutes.
    arrival = sorted(rows, key=lambda r: r[3] + dt.timedelta(seconds=rng.random() * 300))
    batches = [arrival[k : k + 60] for k in range(0, len(arrival), 60)] + [[ball(1, DAY, "other")]]
    assert batches[0] != sorted(batches[0], key=lambda r: (r[3], r[0]))
    got = drain(spark, tmp_path, batches)
    assert not any(r.late or r.restarted for r in got)
    assert len(got) == len(rows)
    assert {(r.match_id, r.seq): (r.runs, r.wickets, r.legal_balls_bowled) for r in got} == folded(rows)
    assert all(r.ts == START + dt.timedelta(seconds=40 * r.seq) for r in got)


def test_late_repeated_and_restarted(spark, tmp_path):
    batches = [
        [ball(3, 30, runs=4), ball(1, 10), ball(1, 10, runs=9)],
        [ball(1, 5000, "other")],
        [ball(2, 20, runs=6), ball(4, 40, runs=2)],
        [ball(1, 3 * DAY, "other", runs=0)],
        [ball(5, 3 * DAY + 60, runs=3)],
        [ball(9, 4 * DAY, "another")],
    ]
    got = [r for r in drain(spark, tmp_path, batches, idle_ms=DAY * 1000) if r.match_id == "m"]
    assert sorted((r.seq, r.runs, r.late, r.restarted) for r in got) == [
        (1, 0, True, False), (1, 1, False, False), (2, 5, True, False), (3, 5, False, False), (4, 7, False, False),
        (5, 3, False, True),
    ]

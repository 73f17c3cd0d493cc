"""Running scores of deliveries that come out of order.

A delivery is held in its innings until the watermark has passed it and is then counted in
``seq`` order, so a stream whose disorder stays within the delay ends with the numbers of the batch
operator. What comes behind a delivery already counted is reported and changes nothing.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from typing import Any

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from tallyline.streaming.live import IDLE_MS

ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
# Innings share the state of a bucket, since a call of the state costs more than the deliveries of an innings.
BUCKETS = 256
HELD = "seq: bigint, at: bigint, batting_team: string, runs: bigint, wicket: boolean, legal: boolean"
INNINGS = (
    "match_id: string, innings: int, runs: bigint, wickets: bigint, balls: bigint, last_seq: bigint, restarted: boolean, "
    f"due: bigint, held: array<struct<{HELD}>>"
)
STATE = f"timer long, innings array<struct<{INNINGS}>>"
OUTPUT = (
    "match_id string, innings int, seq long, at long, batting_team string, runs long, wickets long, "
    "legal_balls_bowled long, late boolean, restarted boolean"
)
NAMES = [c.split()[0] for c in OUTPUT.split(", ")]
# Rows of a frame of output, about.
OUTPUT_ROWS = 10_000


class Innings(StatefulProcessor):
    """State of a bucket of (match, innings): of each, deliveries not yet counted, and the score of those that are.

    Each innings has a moment when it is due: at its earliest held delivery, or without one at the end of its
    rest. After a rest of ``idle_ms`` the score is forgotten and a mark left; deliveries that follow
    start again at nothing and say so. The mark goes after another such rest. One timer stands for the
    bucket: at the earliest of these moments.
    """

    def __init__(self, idle_ms: int) -> None:
        self.idle_ms = idle_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.stored = handle.getValueState("bucket", STATE)

    def handleInputRows(self, key: Any, rows: Iterator[pd.DataFrame], timerValues: Any) -> Iterator[pd.DataFrame]:
        now = timerValues.getCurrentWatermarkInMs()
        timer, books = self._books()
        arrived: dict[tuple, list[tuple]] = {}
        for frame in rows:
            columns = ["match_id", "innings", "seq", "at", "batting_team", "runs", "wicket", "legal"]
            for row in frame[columns].itertuples(index=False, name=None):
                arrived.setdefault(row[:2], []).append(row[2:])
        out: list[tuple] = []
        for one, balls in arrived.items():
            score, _, held = books.get(one, ((0, 0, 0, -1, False), 0, ()))
            waiting = {r[0]: r for r in held}
            for row in balls:
                if row[0] <= score[3] or row[0] in waiting:
                    out.append((*one, *row[:3], *score[:3], True, score[4]))
                else:
                    waiting[row[0]] = row
            books[one] = self._advanced(one, score, waiting.values(), now, out)
            if len(out) >= OUTPUT_ROWS:
                yield pd.DataFrame(out, columns=NAMES)
                out = []
        yield from self._expired(books, now, out)
        self._store(timer, books)

    def handleExpiredTimer(self, key: Any, timerValues: Any, expiredTimerInfo: Any) -> Iterator[pd.DataFrame]:
        _, books = self._books()
        yield from self._expired(books, timerValues.getCurrentWatermarkInMs(), [])
        # The timer that came is taken away by the caller.
        self._store(None, books)

    def close(self) -> None:
        pass

    def _books(self) -> tuple[int | None, dict[tuple, tuple]]:
        """The timer that is set, and of each innings its score, when it is due and what it holds."""
        if not self.stored.exists():
            return None, {}
        timer, rows = self.stored.get()
        return timer, {tuple(r[:2]): (tuple(r[2:7]), r[7], [tuple(h) for h in r[8]]) for r in rows}

    def _store(self, timer: int | None, books: dict[tuple, tuple]) -> None:
        due = min((book[1] for book in books.values()), default=None)
        if timer is not None and timer != due:
            self.handle.deleteTimer(timer)
        if due is None:
            self.stored.clear()
            return
        if timer != due:
            self.handle.registerTimer(due)
        self.stored.update((due, [(*one, *score, at, held) for one, (score, at, held) in books.items()]))

    def _expired(self, books: dict[tuple, tuple], now: int, out: list[tuple]) -> Iterator[pd.DataFrame]:
        """Advance the innings that are due; those that got deliveries at this watermark are not."""
        for one in [one for one, (_, due, _) in books.items() if due < now]:
            score, _, held = books[one]
            if held:
                books[one] = self._advanced(one, score, held, now, out)
            elif score[3] >= 0:
                books[one] = ((0, 0, 0, -1, True), now + self.idle_ms, [])
            else:
                del books[one]
            if len(out) >= OUTPUT_ROWS:
                yield pd.DataFrame(out, columns=NAMES)
                out = []
        if out:
            yield pd.DataFrame(out, columns=NAMES)

    def _advanced(self, one: tuple, score: tuple, waiting: Iterable[tuple], now: int, out: list[tuple]) -> tuple:
        """Count what the watermark has passed, and all that stands before it in the innings."""
        runs, wickets, balls, last, restarted = score
        waiting = sorted(waiting, key=lambda r: r[0])
        end = max((r[0] for r in waiting if r[1] // 1000 < now), default=None)
        keep, newest = [], 0
        for seq, at, team, scored, wicket, legal in waiting:
            if end is None or seq > end:
                keep.append((seq, at, team, scored, wicket, legal))
                continue
            runs, wickets, balls, last = runs + int(scored), wickets + int(wicket), balls + int(legal), seq
            newest = max(newest, at // 1000)
            out.append((*one, seq, at, team, runs, wickets, balls, False, restarted))
        due = max(min(r[1] for r in keep) // 1000, now) + 1 if keep else max(newest, now) + self.idle_ms
        return (runs, wickets, balls, last, restarted), due, keep


def ordered_score(
    deliveries: DataFrame, delay: str = "10 minutes", idle_ms: int = IDLE_MS, buckets: int = BUCKETS
) -> DataFrame:
    """Score after each delivery of a stream that may come in any order within ``delay``.

    ``late`` marks what was left out: deliveries behind one already counted, and repeated ones; their score is
    that of the moment they came. A late one still counts where nothing behind it has been counted yet.
    ``restarted`` marks an innings that rested longer than ``idle_ms`` and lost its score. Deliveries within
    ``delay`` of the newest one of the stream are still held. Rows without match, innings, seq or ts are left
    out; missing runs and marks count as none. The state store is RocksDB, which timers and lists need: the
    session's setting is changed for streams started afterwards. ``buckets``: the state of the innings is kept in so
    many parts, the same as long as the stream lives; a part should fit a task's memory.
    """
    deliveries.sparkSession.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKSDB)

    def mark(name: str):
        return F.coalesce(F.col(name), F.lit(False))

    watched = deliveries.select("*", F.col("ts").cast("timestamp").alias("_seen")).withWatermark("_seen", delay)
    # The moment goes on as a number: a row that carried the watched column would be dropped when it is late.
    narrow = watched.select(
        F.col("match_id").cast("string").alias("match_id"), F.col("innings").cast("int").alias("innings"),
        F.col("seq").cast("long").alias("seq"), F.unix_micros("_seen").alias("at"), "batting_team",
        F.coalesce(F.col("runs_total").cast("long"), F.lit(0)).alias("runs"), mark("wicket").alias("wicket"),
        (~mark("is_wide") & ~mark("is_noball")).alias("legal"),
    ).where("match_id is not null and innings is not null and seq is not null and at is not null")
    dealt = narrow.withColumn("bucket", F.pmod(F.xxhash64("match_id", "innings"), F.lit(buckets)))
    scored = dealt.groupBy("bucket").transformWithStateInPandas(
        Innings(idle_ms), outputStructType=OUTPUT, outputMode="append", timeMode="EventTime"
    )
    return scored.withColumn("at", F.timestamp_micros("at")).withColumnRenamed("at", "ts")

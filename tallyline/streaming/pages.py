"""The newest record of each match from a stream of feed pages.

The file source hands every page to exactly one micro-batch. What has to last between micro-batches is, for
each match, which record was the newest and what it said; the records themselves only pass through.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import Any

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from tallyline.sources import feed as L
from tallyline.streaming.live import IDLE_MS
from tallyline.streaming.ordered import BUCKETS, ROCKSDB

# Matches share the state of a bucket, since a call of the state costs more than the records of a match.
NEWEST = "match_id: string, seen: bigint, page: string, place: int, digest: bigint"
STATE = f"timer long, matches array<struct<{NEWEST}>>"
OUTPUT = "match_id string, seen long, page string, place int, record string"
NAMES = [c.split()[0] for c in OUTPUT.split(", ")]


class Newest(StatefulProcessor):
    """State of a bucket of matches: place and digest of the newest record of each; forgotten when pages are ``idle_ms`` ahead."""

    def __init__(self, idle_ms: int) -> None:
        self.idle_ms = idle_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.stored = handle.getValueState("bucket", STATE)

    def handleInputRows(self, key: Any, rows: Iterator[pd.DataFrame], timerValues: Any) -> Iterator[pd.DataFrame]:
        best: dict[str, tuple] = {}
        for frame in rows:
            columns = ["match_id", "seen", "page", "place", "digest", "record"]
            for match, *row in frame[columns].itertuples(index=False, name=None):
                if match not in best or tuple(row[:3]) > best[match][:3]:
                    best[match] = tuple(row)
        timer, known = self._known()
        out = []
        for match, row in best.items():
            held = known.get(match)
            if held is not None and row[:3] <= held[:3]:
                continue
            known[match] = row[:4]
            if held is None or row[3] != held[3]:
                out.append((match, *row[:3], row[4]))
        self._store(timer, known, timerValues)
        if out:
            yield pd.DataFrame(out, columns=NAMES)

    def handleExpiredTimer(self, key: Any, timerValues: Any, expiredTimerInfo: Any) -> Iterator[pd.DataFrame]:
        # The timer that came is taken away by the caller.
        self._store(None, self._known()[1], timerValues)
        return iter(())

    def close(self) -> None:
        pass

    def _known(self) -> tuple[int | None, dict[str, tuple]]:
        """The timer that is set, and the newest record of each match."""
        if not self.stored.exists():
            return None, {}
        timer, rows = self.stored.get()
        return timer, {r[0]: tuple(r[1:]) for r in rows}

    def _store(self, timer: int | None, known: dict[str, tuple], values: Any) -> None:
        """Keep the matches that are not yet due; one timer stands for the bucket, at the earliest of them."""
        oldest = values.getCurrentWatermarkInMs() - self.idle_ms
        kept = [(match, *row) for match, row in known.items() if row[0] // 1000 >= oldest]
        due = min((row[1] for row in kept), default=None)
        due = None if due is None else due // 1000 + self.idle_ms
        if timer is not None and timer != due:
            self.handle.deleteTimer(timer)
        if due is None:
            self.stored.clear()
            return
        if timer != due:
            self.handle.registerTimer(due)
        self.stored.update((due, kept))


def newest_records(
    spark: SparkSession, folder: str, *, strict: bool = False, idle_ms: int = IDLE_MS, buckets: int = BUCKETS,
    utf8: bool = True,
) -> DataFrame:
    """Normalised records of a stream of pages: of each match the newest one of a micro-batch, where it says something new.

    Pages are ordered by when their file was written, then by path; records by their place in the page. A record
    of an older page that comes later changes nothing, nor does one that repeats what is known. Records without an
    id or without two teams are left out before, so they hide no good one. The sink's newest row of a match, which
    ``current`` picks, is its state. The state store is RocksDB, set as in ``ordered_score``, and
    ``buckets`` are as there. ``utf8``: false where pages are not in UTF-8, which is slower.
    """
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKSDB)
    pages = L.stream_pages(spark, folder, utf8)
    kind = pages.schema["data"].dataType.elementType
    written = pages.select("*", F.col("_metadata.file_modification_time").alias("_seen"), F.col("_metadata.file_path").alias("page"))
    # Pages are watched for the timers only; the moment goes on as a number, so that no late page is dropped unseen.
    found = written.withWatermark("_seen", "0 seconds").where(F.col("status") == "success").select(
        F.unix_micros("_seen").alias("seen"), "page",
        F.posexplode("data").alias("place", "raw"),
    )
    raw = F.col("raw")
    usable = (F.size(raw["teams"]) == 2) & (F.trim(F.coalesce(raw["id"], F.lit(""))) != "")
    narrow = found.where(usable).select(
        F.trim(raw["id"]).alias("match_id"), "seen", "page", "place", F.xxhash64(F.to_json("raw")).alias("digest"),
        F.to_json("raw").alias("record"),
    )
    dealt = narrow.withColumn("bucket", F.pmod(F.xxhash64("match_id"), F.lit(buckets)))
    newest = dealt.groupBy("bucket").transformWithStateInPandas(
        Newest(idle_ms), outputStructType=OUTPUT, outputMode="append", timeMode="EventTime"
    )
    parsed = newest.select(
        F.timestamp_micros("seen").alias("seen_at"), "page", "place", F.from_json("record", kind).alias("raw")
    )
    return L.normalize(parsed, strict, keep=("seen_at", "page", "place"))


def current(records: DataFrame) -> DataFrame:
    """The newest of the stored records of each match."""
    order = Window.partitionBy("match_id").orderBy(*[F.desc(c) for c in ("seen_at", "page", "place")])
    return records.withColumn("_nth", F.row_number().over(order)).where("_nth = 1").drop("_nth")

"""Streams: running scores, feed records, win probability, ratings.

A running score needs memory between micro-batches, which window functions do not
have on a stream, so it is a keyed state of three counters. Everything else is the
batch code on a streaming frame.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import Any

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import DataStreamWriter
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from tallyline.operators import contests as C
from tallyline.operators.elo import contest_scores, elo_after
from tallyline.operators.live import with_metrics
from tallyline.plans.models import Bundle, probability
from tallyline.sources import feed as L
from tallyline.sources.tables import exists

# Default of how long an innings may rest before its counters are forgotten: longer than any match.
IDLE_MS = 14 * 24 * 3600 * 1000
# First and last day of the contests of a micro-batch.
BOUNDS = "batch long, oldest date, newest date"
STATE = "runs long, wickets long, legal_balls long, last_seq long"
# Types of the columns of a micro-batch in which nothing is missing.
WHOLE = {"seq": "int64", "runs_total": "int64", "wicket": "bool", "is_wide": "bool", "is_noball": "bool"}
OUTPUT = (
    "match_id string, innings int, seq long, ts timestamp, batting_team string, runs long, wickets long, "
    "legal_balls_bowled long, late boolean"
)


def _advanced(key: tuple, rows: pd.DataFrame, score: tuple, state: GroupState, idle_ms: int) -> pd.DataFrame:
    """``_advance`` for sorted rows without missing values, on arrays: an innings has few rows, and there are many."""
    runs, wickets, balls, last = score
    seq, at = rows["seq"].to_numpy(), rows["ts"].to_numpy()
    fresh = seq > last
    fresh[1:] &= seq[1:] != seq[:-1]
    # On-time deliveries first, then the late ones with the score they leave.
    order = np.argsort(~fresh, kind="stable")
    n = int(fresh.sum())
    taken, left = order[:n], len(order) - n
    legal = ~(rows["is_wide"].to_numpy() | rows["is_noball"].to_numpy())
    added = [rows["runs_total"].to_numpy(), rows["wicket"].to_numpy(), legal]
    sums = [start + np.cumsum(v[taken], dtype="int64") for start, v in zip((runs, wickets, balls), added)]
    if n:
        runs, wickets, balls, last = (*(int(s[-1]) for s in sums), int(seq[taken[-1]]))
    state.update((runs, wickets, balls, last))
    newest = int(rows["ts"].max().timestamp() * 1000)
    state.setTimeoutTimestamp(max(newest, state.getCurrentWatermarkMs()) + idle_ms)
    runs_, wickets_, balls_ = (
        np.concatenate([s, np.full(left, end, dtype="int64")]) for s, end in zip(sums, (runs, wickets, balls))
    )
    return pd.DataFrame(
        {
            "match_id": key[0], "innings": key[1], "seq": seq[order], "ts": at[order],
            "batting_team": rows["batting_team"].to_numpy()[order], "runs": runs_, "wickets": wickets_,
            "legal_balls_bowled": balls_, "late": ~fresh[order],
        }
    )


def _advance(
    key: tuple, batches: Iterator[pd.DataFrame], state: GroupState, idle_ms: int = IDLE_MS
) -> Iterator[pd.DataFrame]:
    """Add one micro-batch of a (match, innings) to its counters.

    Deliveries are taken in ``seq`` order inside the micro-batch. One that comes
    with a seq already passed is reported as late and changes nothing. A micro-batch
    is as large as the source's rate limit (``maxFilesPerTrigger``) lets it be.
    """
    if state.hasTimedOut:
        state.remove()
        return
    runs, wickets, balls, last = state.get if state.exists else (0, 0, 0, -1)
    frames = list(batches)
    rows = (frames[0] if len(frames) == 1 else pd.concat(frames, ignore_index=True)).sort_values("seq", kind="stable")
    if all(rows.dtypes[n] == kind for n, kind in WHOLE.items()) and rows["ts"].notna().all():
        yield _advanced(key, rows, (runs, wickets, balls, last), state, idle_ms)
        return
    fresh = (rows["seq"] > last) & ~rows["seq"].duplicated()
    on_time = rows[fresh]
    legal = ~on_time["is_wide"] & ~on_time["is_noball"]
    out = on_time[["seq", "ts", "batting_team"]].assign(
        runs=runs + on_time["runs_total"].cumsum(),
        wickets=wickets + on_time["wicket"].astype("int64").cumsum(),
        legal_balls_bowled=balls + legal.astype("int64").cumsum(),
        late=False,
    )
    if len(out):
        end = out.iloc[-1]
        runs, wickets, balls, last = (int(end[c]) for c in ("runs", "wickets", "legal_balls_bowled", "seq"))
    late = rows[~fresh][["seq", "ts", "batting_team"]].assign(
        runs=runs, wickets=wickets, legal_balls_bowled=balls, late=True
    )
    state.update((runs, wickets, balls, last))
    newest = int(rows["ts"].max().timestamp() * 1000)
    state.setTimeoutTimestamp(max(newest, state.getCurrentWatermarkMs()) + idle_ms)
    result = pd.concat([out, late], ignore_index=True)
    result.insert(0, "match_id", key[0])
    result.insert(1, "innings", key[1])
    yield result


def running_score(deliveries: DataFrame, delay: str = "10 minutes", idle_ms: int = IDLE_MS) -> DataFrame:
    """Score after each delivery of a stream; ``late`` marks deliveries left out.

    The watermark only decides when a finished innings is forgotten: ``idle_ms`` after its
    last delivery. Choose it longer than the longest break, since an innings that goes on
    after it starts again at nothing.
    """

    def advance(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        yield from _advance(key, batches, state, idle_ms)

    narrow = deliveries.select(
        F.col("match_id").cast("string").alias("match_id"), F.col("innings").cast("int").alias("innings"),
        F.col("seq").cast("long").alias("seq"), F.col("ts").cast("timestamp").alias("ts"), "batting_team",
        F.col("runs_total").cast("long").alias("runs_total"), "wicket", "is_wide", "is_noball",
    )
    return (
        narrow.withWatermark("ts", delay)
        .groupBy("match_id", "innings")
        .applyInPandasWithState(advance, OUTPUT, STATE, "append", GroupStateTimeout.EventTimeTimeout)
    )


def on_time(scores: DataFrame) -> DataFrame:
    return scores.where(~F.col("late"))


def late(scores: DataFrame) -> DataFrame:
    return scores.where("late")


def feed_updates(spark: SparkSession, folder: str, delay: str = "10 minutes", strict: bool = False) -> DataFrame:
    """Normalised feed records, each distinct state of a match once per watermark."""
    pages = L.stream_pages(spark, folder)
    stamped = pages.where(F.col("status") == "success").select(
        F.explode("data").alias("raw"), F.col("_metadata.file_modification_time").alias("seen_at")
    )
    rows = L.normalize(stamped, strict, keep=("seen_at",))
    rows = rows.withColumn("score", L.score_text())
    return rows.withWatermark("seen_at", delay).dropDuplicatesWithinWatermark(["match_id", "status", "score"])


def win_probability(
    scores: DataFrame, context: DataFrame, bundle: Bundle, limit: Column, balls_per_over: Column
) -> DataFrame:
    """Stream of in-play probabilities: score stream joined to static team context.

    ``context`` has one row per (match_id, batting_team) with the context features
    and, for a chase, ``goal``.
    """
    chase = F.col("goal") if "goal" in context.columns else F.lit(None).cast("int")
    joined = on_time(scores).where(F.col("innings") == bundle.innings_number).join(
        context, ["match_id", "batting_team"]
    )
    frame = with_metrics(joined, limit, balls_per_over, chase)
    scored = probability(bundle, frame, "batting_probability", symmetric=False)
    return scored.select(
        "match_id", "innings", "seq", "batting_team", "runs", "wickets", "legal_balls_bowled",
        "batting_probability",
    )


def _last_sound(spark: SparkSession, root: str, batch_id: int) -> tuple[int, Any] | None:
    """The newest version that no later batch has made stale, and the last day it covers.

    A version is sound while every contest that came after it is of a later day.
    """
    bounds = spark.read.schema(BOUNDS).parquet(f"{root}/bounds").where(F.col("batch") <= batch_id)
    upwards = Window.orderBy("batch")
    known = bounds.select(
        "batch",
        F.max("newest").over(upwards.rowsBetween(Window.unboundedPreceding, Window.currentRow)).alias("through"),
        F.min("oldest").over(upwards.rowsBetween(1, Window.unboundedFollowing)).alias("next"),
    )
    sound = known.where(F.col("batch") < batch_id).where("through is null or next is null or through < next")
    # Days and numbers of micro-batches only: a row each.
    for row in sound.orderBy(F.desc("batch")).toLocalIterator():
        if exists(spark, f"{root}/version={row.batch}/_SUCCESS"):
            return row.batch, row.through
    return None


def update_ratings(contests: DataFrame, root: str) -> DataStreamWriter:
    """Keep team ratings current as finished contests arrive, late ones too.

    Each micro-batch is stored under its batch id and leaves a version of the ratings of all contests so far.
    It starts from the newest version that ends before its first day, and that no other late batch has made
    stale, and walks all stored contests of later days once more; with none such, all of them. So a version
    holds the ratings of one walk in date order, however late a contest came, and contests that come in order
    cost their own days only. A repeated batch writes the same files from the same start. Undated contests
    count nowhere; a contest is expected once.
    """
    kinds = contests.schema

    def fold(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        batch.write.mode("overwrite").parquet(f"{root}/contests/micro_batch={batch_id}")
        stored = spark.read.schema(kinds).option("basePath", f"{root}/contests")
        days = stored.parquet(f"{root}/contests/micro_batch={batch_id}").agg(
            F.min("date").cast("date").alias("oldest"), F.max("date").cast("date").alias("newest")
        )
        days.select(F.lit(batch_id).cast("long").alias("batch"), "oldest", "newest").coalesce(1).write.mode(
            "overwrite"
        ).parquet(f"{root}/bounds/part={batch_id}")
        start = _last_sound(spark, root, batch_id)
        rows = stored.parquet(f"{root}/contests").where(F.col("micro_batch") <= batch_id).drop("micro_batch")
        before = None
        if start is not None:
            before = spark.read.parquet(f"{root}/version={start[0]}")
            if start[1] is not None:
                rows = rows.where(F.col("date").cast("date") > F.lit(start[1]))
        scores = contest_scores(C.prepare(rows))
        elo_after(scores, ratings_in=before).write.mode("overwrite").parquet(f"{root}/version={batch_id}")

    return contests.writeStream.foreachBatch(fold)


def run_available(writer: DataStreamWriter, checkpoint: str, **options: Any) -> None:
    """Process what is there and stop."""
    for name, value in options.items():
        writer = writer.option(name, value)
    query = writer.option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()

"""Stored tables: the parsed corpus keyed by its fingerprint, and result sinks."""

from __future__ import annotations

import hashlib
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyline.sources import documents as D

SILVER = ("matches", "innings", "deliveries", "quarantine")


def exists(spark: SparkSession, path: str) -> bool:
    jvm = spark.sparkContext._jvm
    target = jvm.org.apache.hadoop.fs.Path(path)
    return target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(target)


def fingerprint_key(spark: SparkSession, raw: str) -> str:
    row = D.fingerprint(spark, raw).first()
    text = "|".join(str(row[c]) for c in ("path", "files", "newest", "bytes"))
    return hashlib.sha256(text.encode()).hexdigest()[:24]


def silver(spark: SparkSession, raw: str, cache: str) -> dict[str, DataFrame]:
    """Parsed tables of a corpus; parsed once per fingerprint, read from then on."""
    root = f"{cache}/{fingerprint_key(spark, raw)}"
    if not exists(spark, f"{root}/_complete"):
        parsed_path = f"{root}/parsed"
        D.parse_documents(D.read_documents(spark, raw)).write.mode("overwrite").parquet(parsed_path)
        parsed = spark.read.parquet(parsed_path)
        for name in SILVER:
            getattr(D, name)(parsed).write.mode("overwrite").parquet(f"{root}/{name}")
        spark.range(1).write.mode("overwrite").parquet(f"{root}/_complete")
    return {name: spark.read.parquet(f"{root}/{name}") for name in SILVER}


def published(spark: SparkSession, root: str, key: str, build: Callable[[], DataFrame]) -> DataFrame:
    """The table ``key`` below ``root``; built where it is not there yet.

    A new table is written beside its place and renamed into it when it is whole, so a reader sees all of it or
    nothing, and a run that dies leaves only a draft. Of two runs that build at once, the first one's table stays.
    """
    target = f"{root}/{key}"
    if not exists(spark, target):
        draft = f"{root}/_draft-{uuid.uuid4().hex}"
        build().write.parquet(draft)
        path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path
        files = path(draft).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
        # Renaming onto a folder that is there would move the draft into it.
        if files.exists(path(target)) or not files.rename(path(draft), path(target)):
            files.delete(path(draft), True)
    return spark.read.parquet(target)


def load_matches(
    spark: SparkSession, raw: str, cache: str, formats: tuple[str, ...] = ("T20I", "T20")
) -> tuple[dict[str, DataFrame], DataFrame]:
    """Silver tables limited to some formats, and the number of rejected files."""
    tables = silver(spark, raw, cache)
    kept = tables["matches"].where(F.col("format").isin(*formats))
    ids = kept.select("match_id")
    out = {
        "matches": kept,
        "innings": tables["innings"].join(ids, "match_id", "left_semi"),
        "deliveries": tables["deliveries"].join(ids, "match_id", "left_semi"),
    }
    return out, tables["quarantine"].agg(F.count(F.lit(1)).alias("parse_errors"))


def with_first_innings(matches: DataFrame, innings: DataFrame) -> DataFrame:
    """Add who batted first and for how many runs, from the first listed innings."""
    first = innings.groupBy("match_id").agg(
        F.min_by(F.struct("batting_team", "runs"), "innings_number").alias("_f")
    )
    return matches.join(first, "match_id", "left").select(
        *matches.columns,
        F.col("_f.batting_team").alias("batting_first"),
        F.col("_f.runs").cast("double").alias("first_total"),
    )


def write_features(features: DataFrame, path: str) -> None:
    """Feature table by format, each file in date order."""
    (
        features.repartition("format", F.year("date").alias("_y"))
        .sortWithinPartitions("format", "date", "match_id", "team", "prediction_mode")
        .write.mode("overwrite").partitionBy("format").parquet(path)
    )


def write_live(states: DataFrame, path: str) -> None:
    (
        states.repartition("format", "match_id")
        .sortWithinPartitions("format", "date", "match_id", "innings_number", "seq")
        .write.mode("overwrite").partitionBy("format").parquet(path)
    )


def write_csv(df: DataFrame, path: str) -> None:
    """A small result table as CSV with a header; arrays are joined with '|'."""
    flat = [
        F.concat_ws("|", F.col(n)).alias(n) if t.startswith("array") else F.col(n) for n, t in df.dtypes
    ]
    df.select(*flat).coalesce(1).write.mode("overwrite").option("header", True).csv(path)


def write_report(df: DataFrame, path: str) -> None:
    """A one-row report as JSON."""
    df.coalesce(1).write.mode("overwrite").json(path)


METRIC_COLUMNS = ("run", "mode", "domain", "split", "model", "metric", "value")


def write_metrics(metrics: DataFrame, path: str) -> None:
    """Metrics in long form, appended to one table."""
    metrics.select(*METRIC_COLUMNS).write.mode("append").parquet(path)


def long_metrics(metrics: DataFrame, names: tuple[str, ...], **facts: str) -> DataFrame:
    """Turn one-row-per-model metrics into (run, mode, domain, split, model, metric, value)."""
    cells = F.array(
        *[F.struct(F.lit(n).alias("metric"), F.col(n).cast("double").alias("value")) for n in names]
    )
    known = [F.lit(v).alias(k) for k, v in facts.items()]
    left = [c for c in METRIC_COLUMNS if c in metrics.columns and c not in facts]
    return metrics.select(*known, *left, F.explode(cells).alias("_c")).select(
        *facts, *left, "_c.metric", "_c.value"
    )

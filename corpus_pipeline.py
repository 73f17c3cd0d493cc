"""From documents to packed training sequences: five stages, each written before the next reads it.

Quality classifier, near-duplicate removal, removal of repeated passages, benchmark
decontamination, packing. All stages but the last return the columns of `documents`.
"""

from __future__ import annotations

import uuid

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyline.llm import decontaminate, near_dedup, packing, quality, substring_dedup
from tallyline.llm.common import read
from tallyline.session import ensure_checkpoint_dir

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def keep_good(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier predicts to be good."""
    return quality.keep_good(docs.select(*COLUMNS), read(spark, sf_dir, "labels"))


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of near duplicates, on five-word shingles. Rows of one id are one document."""
    kept = near_dedup.duplicate_classes(docs, size=5, threshold=0.8).where("kept")
    ids = kept.select(F.col("doc_id").alias("id")).distinct()
    return docs.select(*COLUMNS).join(ids, F.col("doc_id").eqNullSafe(F.col("id")), "left_semi")


def cut_repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, without later copies of repeated passages; n_chars follows the text."""
    return (
        substring_dedup.remove_repeats(docs.select(*COLUMNS))
        .withColumn("n_chars", F.length("text").cast("long"))
        .select(*COLUMNS)
    )


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark passages to speak of."""
    return decontaminate.remove_contaminated(docs.select(*COLUMNS), read(spark, sf_dir, "benchmark"), unnamed=True)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every piece with its sequence and place, as query op4 returns them."""
    packed = packing.packed_pieces(docs, str(public_tokenizers.path("word_bpe_49k.json")))
    return packed.select("doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset")


STAGES = [
    ("quality", keep_good),
    ("near_dedup", drop_near_duplicates),
    ("substring_dedup", cut_repeated_passages),
    ("decontamination", drop_contaminated),
    ("packing", pack_sequences),
]

# A trained classifier and a tokenizer are not SQL; the stages are tested against plain versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last stage's rows for the documents of `sf_dir`."""
    docs, folder = read(spark, sf_dir, "documents"), f"{ensure_checkpoint_dir(spark)}/pipeline-{uuid.uuid4().hex}"
    for number, (name, stage) in enumerate(STAGES):
        path = f"{folder}/{number}-{name}"
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs

"""Token ids in ORC files: run-length coded lists, row indexes, Bloom filters on the id.

The table is dealt into ranges of the document id, each range is encoded in id order and
written as one file. A file is read stripe by stripe in parallel; a look-up of ids skips
files and row groups by their statistics and Bloom filters.
"""

from __future__ import annotations

import uuid
import zlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tallyline.llm.common import give_back, mapped, partitions
from tallyline.llm.tokens import encoder
from tallyline.session import ensure_checkpoint_dir

STRIPE_BYTES = 16 << 20
# Bytes of text of one file; smaller tables are dealt into as many files as there are shuffle partitions.
FILE_BYTES = 128 << 20
# Documents for each entry of a row index and its Bloom filter.
INDEX_ROWS = 1_000
BLOOM_FALSE_POSITIVES = 0.01


def write_tokens(
    docs: DataFrame, path: str, tokenizer: str, *, end_id: int = 0, id_col: str = "doc_id", text_col: str = "text"
) -> None:
    """Write (doc_id, part, before, n_tokens, ids) of `docs` to ORC files under `path`.

    `part` is the number of the file in id order, `before` counts the ids ahead of a
    document in its file. A null text is empty and so holds the end id alone. Rows with a
    null id come first; rows that share an id keep all copies, in the order of a hash of their text.
    An empty table makes a folder without rows. Other columns are not read.
    """

    def encode(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder, part, before = encoder(tokenizer), TaskContext.get().partitionId(), 0
        for batch in batches:
            for some in coder.encoded(batch.column(1)):
                sizes = np.diff(some.bounds) + 1
                starts = before + np.cumsum(sizes) - sizes
                before += int(sizes.sum())
                ids = pa.array(np.insert(some.ids, some.bounds[1:], end_id).astype(np.int32), pa.int32())
                lists = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(sizes)]), pa.int32()), ids)
                rows = batch.column(0).slice(some.low, some.high - some.low)
                columns = [rows, pa.array(np.full(len(sizes), part, np.int32)), pa.array(starts), pa.array(sizes), lists]
                yield pa.RecordBatch.from_arrays(columns, ["doc_id", "part", "before", "n_tokens", "ids"])
        give_back()

    spark = docs.sparkSession
    kind = docs.select(F.col(id_col).alias("doc_id")).schema[0].dataType.simpleString()
    read = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    size = read.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    # Rows of one id part by their text.
    ordered = (
        read.repartitionByRange(max(partitions(spark), -(-size // FILE_BYTES)), "doc_id", F.xxhash64("text"))
        .sortWithinPartitions("doc_id", F.xxhash64("text"), "text")
    )
    (
        ordered.mapInArrow(encode, f"doc_id {kind}, part int, before long, n_tokens long, ids array<int>")
        .write.option("orc.compress", "ZSTD")
        .option("orc.stripe.size", STRIPE_BYTES)
        .option("orc.row.index.stride", INDEX_ROWS)
        .option("orc.bloom.filter.columns", "doc_id")
        .option("orc.bloom.filter.fpp", BLOOM_FALSE_POSITIVES)
        .orc(path)
    )


def read_tokens(spark: SparkSession, path: str, id_type: str = "bigint") -> DataFrame:
    """Documents of a token folder: doc_id, start (ids of all documents before it), n_tokens, ids."""
    stored = spark.read.schema(f"doc_id {id_type}, part int, before bigint, n_tokens bigint, ids array<int>").orc(path)
    sizes = stored.groupBy("part").agg(F.sum("n_tokens").alias("size"))
    # One row for each file, so one task and a broadcast are enough.
    ahead = sizes.select(
        "part", (F.sum("size").over(Window.orderBy("part")) - F.col("size")).alias("ahead")
    )
    return stored.join(F.broadcast(ahead), "part").select(
        "doc_id", (F.col("ahead") + F.col("before")).alias("start"), "n_tokens", "ids"
    )


def find(spark: SparkSession, path: str, ids: list[int]) -> DataFrame:
    """The stored rows of a few ids; statistics and Bloom filters prune files, stripes and row groups."""
    return spark.read.orc(path).where(F.col("doc_id").isin(ids)).select("doc_id", "n_tokens", "ids")


def scratch(spark: SparkSession, name: str) -> str:
    return f"{ensure_checkpoint_dir(spark)}/{name}-{uuid.uuid4().hex}"


def digest(tokens: DataFrame) -> DataFrame:
    """doc_id, start, n_tokens and the crc of the ids, as unsigned 32-bit little-endian numbers."""

    def crc(batch: pa.RecordBatch) -> pa.RecordBatch:
        column = batch.column(3)
        flat, ends = column.flatten().to_numpy().astype("<u4"), np.cumsum(np.diff(column.offsets.to_numpy()))
        sums = [zlib.crc32(x.tobytes()) for x in np.split(flat, ends[:-1])] if len(ends) else []
        sizes = np.diff(column.offsets.to_numpy()).astype(np.int64)
        return pa.RecordBatch.from_arrays(
            [batch.column(0), batch.column(1), pa.array(sizes), pa.array(sums, pa.int64())],
            ["doc_id", "start", "n_tokens", "ids_crc32"],
        )

    kind = tokens.schema["doc_id"].dataType.simpleString()
    return mapped(tokens, crc, f"doc_id {kind}, start long, n_tokens long, ids_crc32 long")

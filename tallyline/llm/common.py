"""Helpers that several text operators share."""

from __future__ import annotations

import ctypes
import sys
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession

LOWER = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))
# Bytes outside 0-9, A-Z, a-z and UTF-8 sequences separate words.
ALNUM_WORDS = bytes(
    c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else 32 for c in range(256)
)


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def utf8(text: str | None) -> bytes:
    """UTF-8 of a text; a lone surrogate, which no reader of strict UTF-8 makes, becomes '?'."""
    return (text or "").encode("utf-8", "replace")


# Rows, and bytes of their columns, that `mapped` hands to a function at once; their Python objects bound a worker's memory.
SLICE_ROWS = 1_000
SLICE_BYTES = 6 << 20


def slices(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    """Parts of a batch within both bounds; a single row may be larger."""
    if batch.num_rows > SLICE_ROWS or (batch.num_rows > 1 and batch.nbytes > SLICE_BYTES):
        half = batch.num_rows // 2
        yield from slices(batch.slice(0, half))
        yield from slices(batch.slice(half))
    elif batch.num_rows:
        yield batch


def mapped(df: DataFrame, fn: Callable[[pa.RecordBatch], pa.Table | pa.RecordBatch | None], schema: str) -> DataFrame:
    """`fn` over every Arrow batch of `df`, in slices."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch):
                out = fn(part)
                if out is not None:
                    yield from out.to_batches() if isinstance(out, pa.Table) else [out]
        give_back()

    return df.mapInArrow(run, schema)


_memories: dict[str, object] = {}


def remembered(name: str, make: Callable[[], object]) -> object:
    """What a worker keeps from task to task under `name`; one thing at a time, for workers outlive their stage."""
    if name not in _memories:
        _memories.clear()
        _memories[name] = make()
    return _memories[name]


def give_back() -> None:
    """Return what a finished task needed: workers live on for other tasks."""
    pa.default_memory_pool().release_unused()
    if sys.platform == "linux":
        ctypes.CDLL(None).malloc_trim(0)


def forget() -> None:
    """Drop what an earlier stage left in this worker, for a step that remembers nothing itself."""
    if _memories:
        _memories.clear()
        give_back()


def row_ids() -> Iterator[int]:
    """Numbers that no other task hands out. They hold once the rows are written."""
    base = TaskContext.get().partitionId() << 36
    while True:
        yield base
        base += 1


def ragged(parts: list[np.ndarray], kind: pa.DataType) -> pa.Array:
    """A list array from one numpy array for each row."""
    offsets = np.zeros(len(parts) + 1, np.int32)
    np.cumsum([len(p) for p in parts], out=offsets[1:])
    flat = np.concatenate(parts) if parts else np.array([], kind.to_pandas_dtype())
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(flat.astype(kind.to_pandas_dtype(), copy=False)))


def mix(h: np.ndarray) -> np.ndarray:
    """Finaliser of a 64-bit hash, on a copy."""
    h = h ^ (h >> np.uint64(33))
    h = h * np.uint64(0xFF51AFD7ED558CCD)
    h ^= h >> np.uint64(33)
    h = h * np.uint64(0xC4CEB9FE1A85EC53)
    h ^= h >> np.uint64(33)
    return h

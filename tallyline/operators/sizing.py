"""Which keys are too big for one task, and where to cut them.

Decisions follow counted rows alone: a per-key window needs to know that no key
outgrows a task, whatever the bytes that hold it.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyline.session import pin, staged

# Rows of one key that one task may sort; beyond it the key is split by time.
MAX_ROWS_PER_KEY = 4_000_000
# Rows that are sorted together when big keys are cut; pieces may be smaller.
RANGE_ROWS = 100_000
# In place of a row limit: the key is known to fit, do not look again.
UNSPLIT = -1


def long_side(df: DataFrame) -> DataFrame:
    """The side of a join on ``match_id`` or another key of the input: merged, never broadcast.

    Spark goes by the bytes of stored files, which say little of the rows in them: two columns of a few
    million contests count as less than 10 MB there and take hundreds of MB on the driver.
    """
    return df.hint("merge")


def hot_keys(df: DataFrame, keys: Sequence[str], max_rows: int | None = None) -> tuple[DataFrame, int] | None:
    """The keys that hold more than ``max_rows`` rows, pinned, and the rows of the whole table.

    Returns None when no key is that big. A key with a null in it is not split. There may be about
    rows / max_rows such keys, so the table is left to be joined, never hinted for a broadcast.
    """
    if max_rows == UNSPLIT:
        return None
    counts = pin(df.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n")))
    big = counts.where(F.col("_n") > (max_rows or MAX_ROWS_PER_KEY)).dropna(subset=list(keys)).drop("_n")
    if big.isEmpty():
        return None
    return big, counts.agg(F.sum("_n")).first()[0]


def key_limit(df: DataFrame, keys: Sequence[str], max_rows: int | None = None) -> int | None:
    """Count a key once for several windows on it or on longer keys.

    A longer key holds no more rows than the key it extends, so when none of
    ``keys`` is too big, ``UNSPLIT`` is right for all of them.
    """
    if max_rows == UNSPLIT:
        return UNSPLIT
    largest = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n")).agg(F.max("_n")).first()[0]
    return UNSPLIT if largest is None or largest <= (max_rows or MAX_ROWS_PER_KEY) else max_rows


def with_chunk(
    df: DataFrame, keys: Sequence[str], order: Sequence[str], hot: DataFrame, rows: int,
    max_rows: int | None = None, most: int | None = None,
) -> DataFrame:
    """Add ``_hot`` and ``_chunk``: the piece of its big key that a row falls into, 0 for the other keys.

    The table is dealt into ranges of (key, order) and sorted there; every half ``max_rows`` rows of a
    range make a piece, so no piece of a key is bigger, pieces ascend with ``order``, and neither the
    number of ranges nor the work for a row depends on how many pieces there are. A small ``max_rows``
    puts many pieces into one range. ``most`` limits the pieces instead: they get as long as that asks
    for. ``rows`` is the number of rows of ``df``. The result is stored: all readers see the same pieces.
    """
    piece = max((max_rows or MAX_ROWS_PER_KEY) // 2, 1)
    if most is not None:
        piece = max(piece, -(-rows // most))
    marked = df.join(hot.select(*keys, F.lit(True).alias("_big")), list(keys), "left")
    dealt = marked.select(*df.columns, F.coalesce("_big", F.lit(False)).alias("_hot")).repartitionByRange(
        -(-rows // max(piece, RANGE_ROWS)), *keys, *order
    )
    # Rows are numbered one by one in each partition, from partition number x 2^33 on.
    placed = dealt.sortWithinPartitions(*keys, *order).withColumn("_at", F.monotonically_increasing_id())
    part, at = F.shiftright("_at", 33), F.col("_at").bitwiseAND(F.lit((1 << 33) - 1))
    chunk = part * F.lit(1 << 33) + F.floor(at / piece)
    return staged(
        placed.withColumn("_chunk", F.when(F.col("_hot"), chunk).otherwise(F.lit(0).cast("long"))).drop("_at")
    )

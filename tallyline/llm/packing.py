"""Best-fit packing of token pieces into sequences, improved by swaps between underfull bins.

Pieces are dealt into groups of bounded size; a task packs one group by best-fit decreasing
and then exchanges pieces between bins. What is left in bins that are not full is dealt
anew into fewer groups until one group holds it or nothing more is saved.
"""

from __future__ import annotations

import zlib
from bisect import bisect_left, insort
from collections import Counter, defaultdict

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyline.llm.common import give_back, row_ids
from tallyline.llm.tokens import Ids, encoder
from tallyline.session import staged

# Pieces that one task packs.
GROUP_PIECES = 16_384
# Rounds over what is left in bins that are not full.
ROUNDS = 4


def pieces_of(
    docs: DataFrame,
    tokenizer: str,
    capacity: int,
    *,
    end_id: int = 1,
    id_col: str = "doc_id",
    text_col: str = "text",
) -> DataFrame:
    """Pieces of at most `capacity` ids: piece_id, doc_id, piece, start, length, ids_crc32, ids.

    `ids` are little-endian unsigned 32-bit numbers. A null text is empty and holds the end
    id alone; rows that share an id are packed each for itself. Other columns are not read.
    """

    def cut(part: Ids, doc: pa.Array) -> pa.Table:
        flat = np.insert(part.ids, part.bounds[1:], end_id).astype("<u4", copy=False)
        size = np.diff(part.bounds) + 1
        held = -(-size // capacity)
        which = np.repeat(np.arange(len(size)), held)
        piece = np.arange(len(which)) - np.repeat(np.cumsum(held) - held, held)
        start = piece * capacity
        length = np.minimum(capacity, size[which] - start)
        bounds = np.concatenate([[0], 4 * np.cumsum(length)])
        raw = memoryview(flat.tobytes())
        return pa.table(
            {
                "doc_id": doc.slice(part.low, part.high - part.low).take(pa.array(which)),
                "piece": pa.array(piece, pa.int32()),
                "start": pa.array(start, pa.int64()),
                "length": pa.array(length, pa.int64()),
                "ids_crc32": pa.array([zlib.crc32(raw[x:y]) for x, y in zip(bounds[:-1], bounds[1:])], pa.int64()),
                "ids": pa.Array.from_buffers(pa.binary(), len(which), [None, pa.py_buffer(bounds.astype(np.int32)), pa.py_buffer(raw)]),
            }
        )

    kind = docs.select(F.col(id_col).alias("doc_id")).schema[0].dataType.simpleString()
    fields = f"doc_id {kind}, piece int, start long, length long, ids_crc32 long, ids binary"

    def numbered(batches):
        numbers, coder = row_ids(), encoder(tokenizer, drops_space=True)
        for batch in batches:
            for part in coder.encoded(batch.column(1)):
                out = cut(part, batch.column(0))
                own = pa.array([next(numbers) for _ in range(out.num_rows)], pa.int64())
                yield from out.append_column("piece_id", own).to_batches()
        give_back()

    chosen = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    return staged(chosen.mapInArrow(numbered, f"{fields}, piece_id long"))


def best_fit(lengths: list[int], capacity: int) -> list[list[int]]:
    """Bins of positions by best-fit decreasing."""
    bins: list[list[int]] = []
    by_room: dict[int, list[int]] = defaultdict(list)
    rooms: list[int] = []
    for i in sorted(range(len(lengths)), key=lambda i: (-lengths[i], i)):
        size = lengths[i]
        at = bisect_left(rooms, size)
        if at < len(rooms):
            room = rooms[at]
            b = by_room[room].pop()
            if not by_room[room]:
                rooms.pop(at)
        else:
            room, b = capacity, len(bins)
            bins.append([])
        bins[b].append(i)
        left = room - size
        if left:
            if not by_room[left]:
                insort(rooms, left)
            by_room[left].append(b)
    return bins


def exchange(bins: list[list[int]], lengths: list[int], capacity: int) -> list[list[int]]:
    """Empty bins by moving one piece, or swapping one or two pieces for one, into fuller bins.

    Every step takes ids from the emptiest bin that still gives and adds them to a bin that is
    at least as full, so the sum of squared fills grows. It ends when the number of bins meets
    its lower bound, or no step is left. Full bins are out of the search, and a giver without
    a step is only tried again with bins that have changed.
    """
    total = sum(lengths[i] for b in bins for i in b)
    least = -(-total // capacity)
    bins = [list(b) for b in bins]
    fill = [sum(lengths[i] for i in b) for b in bins]
    count = sum(map(bool, bins))
    # Bins with room by fill, those that may give by fill, and those without a step.
    underfull = sorted((fill[k], k) for k, b in enumerate(bins) if b and fill[k] < capacity)
    givers, stuck = list(underfull), set()
    while count > least and givers:
        giver = givers[0][1]
        takers = underfull[bisect_left(underfull, (fill[giver], -1)) :]
        step = _step(bins, lengths, fill, [k for _, k in reversed(takers) if k != giver], giver, capacity)
        if step is None:
            stuck.add(giver)
            del givers[0]
            continue
        taker, out, back = step
        for k in (giver, taker):
            for table in (underfull, givers):
                at = bisect_left(table, (fill[k], k))
                if at < len(table) and table[at] == (fill[k], k):
                    del table[at]
        for i in out:
            bins[giver].remove(i)
            bins[taker].append(i)
        for i in back:
            bins[taker].remove(i)
            bins[giver].append(i)
        moved = sum(lengths[i] for i in out) - sum(lengths[i] for i in back)
        fill[giver] -= moved
        fill[taker] += moved
        stuck -= {giver, taker}
        count -= not bins[giver]
        changed = [k for k in (giver, taker) if bins[k] and fill[k] < capacity]
        for k in changed:
            insort(underfull, (fill[k], k))
            insort(givers, (fill[k], k))
        for k in list(stuck):
            near = sorted((c for c in changed if fill[c] >= fill[k]), key=lambda c: (fill[c], c), reverse=True)
            if near and _step(bins, lengths, fill, near, k, capacity):
                stuck.discard(k)
                insort(givers, (fill[k], k))
    return [b for b in bins if b]


def _step(bins, lengths, fill, takers, giver, capacity):
    """(taker, pieces out of the giver, pieces back) that adds most to the squared fill, or None.

    `takers` have room and at least the giver's fill, the fullest first.
    """
    own = Counter(lengths[i] for i in bins[giver])
    at = {lengths[i]: i for i in bins[giver]}
    sizes = sorted(own)
    pairs: dict[int, tuple[int, int]] = {}
    for x, a in enumerate(sizes):
        for b in sizes[x:]:
            if a != b or own[a] > 1:
                pairs.setdefault(a + b, (a, b))
    sums = sorted(pairs)
    best = None
    for taker in takers:
        room = capacity - fill[taker]
        k = bisect_left(sizes, room + 1)
        if k:
            return taker, [at[sizes[k - 1]]], []
        for i in sorted(bins[taker], key=lambda i: lengths[i]):
            size = lengths[i]
            k = bisect_left(sizes, size + room + 1)
            if k and sizes[k - 1] > size and (best is None or sizes[k - 1] - size > best[0]):
                best = sizes[k - 1] - size, taker, [at[sizes[k - 1]]], [i]
            k = bisect_left(sums, size + room + 1)
            if k and sums[k - 1] > size and (best is None or sums[k - 1] - size > best[0]):
                a, b = pairs[sums[k - 1]]
                two = [i for i in bins[giver] if lengths[i] == a][:2] if a == b else [at[a], at[b]]
                best = sums[k - 1] - size, taker, two, [i]
        if best and best[0] == room:
            break
    return best[1:] if best else None


def pack(pieces: DataFrame, capacity: int) -> DataFrame:
    """piece_id, sequence_id and offset of every row of `pieces` (piece_id, length).

    Pieces as long as a sequence stand alone. Equal lengths are taken in the order of their
    piece_id, so the result does not depend on how the rows arrive.
    """

    def group(final: bool):
        def run(pdf: pd.DataFrame) -> pd.DataFrame:
            pdf = pdf.sort_values("piece_id")
            lengths = pdf["length"].tolist()
            bins = exchange(best_fit(lengths, capacity), lengths, capacity)
            ids, base = pdf["piece_id"].to_numpy(), (int(pdf["round"].iloc[0]) << 56) + (int(pdf["bucket"].iloc[0]) << 28)
            rows = []
            for n, b in enumerate(bins):
                room, at = capacity - sum(lengths[i] for i in b), 0
                for i in b:
                    rows.append((ids[i], lengths[i], (1 << 62) + base + n, at, final or room == 0))
                    at += lengths[i]
            return pd.DataFrame(rows, columns=["piece_id", "length", "sequence_id", "offset", "done"])

        return run

    keys = pieces.select("piece_id", "length")
    alone = keys.where(F.col("length") >= capacity).select(
        "piece_id", F.col("piece_id").alias("sequence_id"), F.lit(0).cast("long").alias("offset")
    )
    rest, result = keys.where(F.col("length") < capacity), [alone]
    for r in range(ROUNDS):
        groups = -(-rest.count() // GROUP_PIECES)
        if groups == 0:
            break
        final = groups == 1 or r == ROUNDS - 1
        packed = staged(
            rest.withColumn("bucket", F.pmod(F.xxhash64("piece_id", F.lit(r)), F.lit(groups)))
            .withColumn("round", F.lit(r))
            .groupBy("bucket", "round")
            .applyInPandas(group(final), "piece_id long, length long, sequence_id long, offset long, done boolean")
        )
        result.append(packed.where("done").select("piece_id", "sequence_id", "offset"))
        if final:
            break
        rest = packed.where(~F.col("done")).select("piece_id", "length")
    out = result[0]
    for more in result[1:]:
        out = out.unionByName(more)
    return out


def packed_pieces(docs: DataFrame, tokenizer: str, capacity: int = 4096, **columns: str) -> DataFrame:
    """Every piece of `docs` with its ids, sequence and place: the rows of `pieces_of` and `pack`."""
    pieces = pieces_of(docs, tokenizer, capacity, **columns)
    return pieces.join(pack(pieces, capacity), "piece_id")


def sequences(packed: DataFrame) -> DataFrame:
    """One row for each sequence: sequence_id, n_tokens, ids (the pieces' ids in order)."""
    parts = F.sort_array(F.collect_list(F.struct("offset", "ids")))
    joined = F.aggregate(parts, F.lit(b"").cast("binary"), lambda a, x: F.concat(a, x["ids"]))
    return packed.groupBy("sequence_id").agg(F.sum("length").alias("n_tokens"), joined.alias("ids"))

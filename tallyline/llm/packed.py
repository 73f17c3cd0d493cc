"""Terms of many texts at once, packed into machine words by their length.

A term of up to 8 bytes is one unsigned 64-bit word, one of up to 16 bytes is two, both big-endian
and padded with zeros, so that the order of the words is the order of the bytes. Longer terms stay
bytes, in one bucket for each length.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa

# Bytes of text that are packed at once; a longer text is packed alone.
CHUNK_BYTES = 8 << 20

_FOLD = np.arange(256, dtype=np.uint8)
_FOLD[65:91] += 32
# The first n of eight bytes.
_FIRST = np.array([(1 << 64) - (1 << 64 - 8 * n) for n in range(9)], np.uint64)
_EIGHT = np.uint64(8)


def byte_class(letters: bool = True, digits: bool = False) -> np.ndarray:
    """Bytes that terms consist of: those of other than ASCII characters, ASCII letters, ASCII digits."""
    allowed = np.arange(256) >= 128
    if letters:
        allowed[65:91] = allowed[97:123] = True
    if digits:
        allowed[48:58] = True
    return allowed


class Terms(NamedTuple):
    """Terms of one length bucket in text order: their packed words (or bytes) and the text of each."""

    first: np.ndarray
    second: np.ndarray | None
    text: np.ndarray


class Chunk(NamedTuple):
    """Texts `low` to `high` of a column: terms of one word, of two words, of each greater length; terms by text."""

    low: int
    high: int
    one: Terms
    two: Terms
    longer: list[Terms]
    counts: np.ndarray


def _buffers(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    if texts.null_count:
        texts = texts.fill_null("")
    wide = pa.types.is_large_string(texts.type) or pa.types.is_large_binary(texts.type)
    offsets = np.frombuffer(texts.buffers()[1], np.int64 if wide else np.int32)
    offsets = offsets[texts.offset : texts.offset + len(texts) + 1].astype(np.int64)
    data = texts.buffers()[2]
    return np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8), offsets


def chunks(texts: pa.Array, allowed: np.ndarray) -> Iterator[Chunk]:
    """The lower-cased (A-Z only) terms of a string column, in pieces of bounded size. A null is an empty text."""
    if not len(texts):
        return
    data, offsets = _buffers(texts)
    low = 0
    while low < len(texts):
        high = max(low + 1, int(np.searchsorted(offsets, offsets[low] + CHUNK_BYTES, "right")) - 1)
        yield _packed(data[offsets[low] : offsets[high]], offsets[low : high + 1] - offsets[low], low, high, allowed)
        low = high


def _packed(data: np.ndarray, offsets: np.ndarray, low: int, high: int, allowed: np.ndarray) -> Chunk:
    inside = allowed[data]
    edge = inside.copy()
    if len(data):
        edge[1:] = inside[1:] & ~inside[:-1]
        begins = offsets[:-1][offsets[:-1] < offsets[1:]]
        edge[begins] = inside[begins]
        starts = np.flatnonzero(edge)
        edge = inside
        edge[:-1] &= ~inside[1:] if len(begins) < 2 else _breaks(inside, begins)
        ends = np.flatnonzero(edge) + 1
    else:
        starts = ends = np.zeros(0, np.int64)
    size = ends - starts
    counts = np.diff(np.searchsorted(starts, offsets))
    text = np.repeat(np.arange(high - low, dtype=np.int32), counts)
    padded = np.zeros(len(data) + 16, np.uint8)
    np.take(_FOLD, data, out=padded[: len(data)])
    eight = np.ndarray((len(data) + 9,), ">u8", padded.data, 0, (1,))

    def words(at: np.ndarray, n: np.ndarray) -> np.ndarray:
        return eight[at].astype(np.uint64) & _FIRST[n]

    pick = np.flatnonzero(size <= 8)
    one = Terms(words(starts[pick], size[pick]), None, text[pick])
    pick = np.flatnonzero((size > 8) & (size <= 16))
    at = starts[pick]
    two = Terms(words(at, np.full(len(at), 8)), words(at + 8, size[pick] - 8), text[pick])
    pick, longer = np.flatnonzero(size > 16), []
    for n in np.unique(size[pick]):
        at = pick[size[pick] == n]
        if n <= 256:
            rows = np.ascontiguousarray(padded[starts[at][:, None] + np.arange(n)]).view(f"S{n}").ravel()
        else:
            rows = np.array([padded[s : s + n].tobytes() for s in starts[at]], object)
        longer.append(Terms(rows, None, text[at]))
    return Chunk(low, high, one, two, longer, counts)


def _breaks(inside: np.ndarray, begins: np.ndarray) -> np.ndarray:
    """Whether a term may not go on behind each byte but the last."""
    stop = ~inside[1:]
    stop[begins[begins > 0] - 1] = True
    return stop


def radix_order(keys: np.ndarray, order: np.ndarray | None = None) -> np.ndarray:
    """Stable order of 64-bit keys, by 16 bits a pass; `order` is an order to refine."""
    for shift in range(0, 64, 16):
        digit = ((keys >> np.uint64(shift)) & np.uint64(0xFFFF)).astype(np.uint16)
        if len(digit) and digit.min() != digit.max():
            # numpy sorts 16-bit integers stably by radix.
            order = np.argsort(digit, kind="stable") if order is None else order[np.argsort(digit[order], kind="stable")]
    return np.arange(len(keys)) if order is None else order


def sorted_order(terms: Terms, order: np.ndarray | None = None) -> np.ndarray:
    """Stable order of the terms of a bucket: by radix where they are packed, by bytes where they are not."""
    if terms.first.dtype == np.uint64:
        if terms.second is not None:
            order = radix_order(terms.second, order)
        return radix_order(terms.first, order)
    if order is None:
        order = np.arange(len(terms.first))
    return order[np.argsort(terms.first[order], kind="stable")]


def spelled(terms: Terms, at: np.ndarray) -> list[bytes]:
    """The bytes of the terms at some places."""
    if terms.first.dtype != np.uint64:
        return terms.first[at].tolist()
    if terms.second is None:
        return terms.first[at].astype(">u8").view("S8").tolist()
    both = np.empty((len(at), 2), ">u8")
    both[:, 0], both[:, 1] = terms.first[at], terms.second[at]
    return both.view("S16").ravel().tolist()

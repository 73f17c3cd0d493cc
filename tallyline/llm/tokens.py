"""Token ids of whole texts by a public tokenizer file."""

from __future__ import annotations

import os
import re
from collections.abc import Iterator, Sequence
from typing import NamedTuple

import numpy as np
import pyarrow as pa

from tallyline.llm.common import mix, remembered

# A text with any of these is encoded in one piece: runs of white space, white space other
# than blanks and line ends, and the byte that pads packed pieces.
_IRREGULAR = ("  ", "\n\n", " \n", "\n ", "\x00", "\t", "\r", "\x0b", "\x0c", "\x1c", "\x1d", "\x1e", "\x1f",
              "\x85", "\xa0", " ", *map(chr, range(0x2000, 0x200B)), " ", " ", " ", " ", "　")
# Pieces that a worker remembers, in some 60 bytes each; beyond that, those used since the last time are kept.
MEMORY = 1_500_000
# Pieces beyond 24 bytes that it remembers.
LONG_MEMORY = 20_000
# Bytes of text whose pieces are told apart at once; a longer text is taken alone.
CHUNK_BYTES = 6 << 20
# Bytes of a piece that are packed in words; longer pieces are taken one by one.
PACKED = 24
_FIRST = np.array([(1 << 64) - (1 << 64 - 8 * n) for n in range(9)], np.uint64)
_ALNUM = np.array([48 <= b < 58 or 65 <= b < 91 or 97 <= b < 123 for b in range(256)])
_MARK = np.array([32 < b < 127 for b in range(256)]) & ~_ALNUM
# Second bytes of two-byte letters that 0xC3 begins.
_LATIN = np.array([0x80 <= b < 0xC0 and b not in (0x97, 0xB7) for b in range(256)])
# Words that the model may be asked for without its pre-tokenizer: runs of plain Latin letters.
_PLAIN = re.compile(r"[A-Za-zÀ-ÖØ-öø-ÿ]+")

def _byte_letters() -> list[str]:
    """The character that byte-level vocabularies write for each byte: printable ones stand for themselves."""
    shown, rest = [*range(33, 127), *range(161, 173), *range(174, 256)], 256
    out = [chr(b) for b in range(256)]
    for b in range(256):
        if b not in shown:
            out[b], rest = chr(rest), rest + 1
    return out


_LETTERS = _byte_letters()


class Ids(NamedTuple):
    """Ids of texts `low` to `high`: those of text low + k lie from bounds[k] to bounds[k + 1]."""

    low: int
    high: int
    ids: np.ndarray
    bounds: np.ndarray


class Memory:
    """Ids of packed pieces, found by sorted 64-bit mixes of their three words."""

    def __init__(self) -> None:
        self.mixed = np.zeros(0, np.uint64)
        self.words = np.zeros((3, 0), np.uint64)
        self.begin, self.held, self.used = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, bool)
        self.pool = np.zeros(0, np.uint32)

    def find(self, mixed: np.ndarray, words: np.ndarray) -> np.ndarray:
        """The place of each piece, -1 where it is not known."""
        if not len(self.mixed):
            return np.full(len(mixed), -1)
        at = np.minimum(np.searchsorted(self.mixed, mixed), len(self.mixed) - 1)
        hit = (self.mixed[at] == mixed) & (self.words[:, at] == words).all(axis=0)
        self.used[at[hit]] = True
        return np.where(hit, at, -1)

    def add(self, mixed: np.ndarray, words: np.ndarray, begin: np.ndarray, held: np.ndarray) -> None:
        """Take in new pieces, sorted by mix, whose ids are in the pool; of pieces with one mix only the first."""
        new = np.ones(len(mixed), bool)
        new[1:] = mixed[1:] != mixed[:-1]
        if len(self.mixed):
            at = np.searchsorted(self.mixed, mixed)
            new &= self.mixed[np.minimum(at, len(self.mixed) - 1)] != mixed
        at = np.searchsorted(self.mixed, mixed[new])
        self.mixed = np.insert(self.mixed, at, mixed[new])
        self.words = np.insert(self.words, at, words[:, new], axis=1)
        self.begin, self.held = np.insert(self.begin, at, begin[new]), np.insert(self.held, at, held[new])
        self.used = np.insert(self.used, at, True)
        if len(self.mixed) > MEMORY:
            keep = self.used if self.used.sum() < MEMORY * 3 // 4 else np.zeros(len(self.used), bool)
            self.mixed, self.words, self.held = self.mixed[keep], self.words[:, keep], self.held[keep]
            self.pool, bounds = gathered(self.pool, self.begin[keep], self.held)
            self.begin, self.used = bounds[:-1], np.zeros(len(self.held), bool)


def gathered(pool: np.ndarray, begin: np.ndarray, held: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The stretches of `pool` that begin at `begin` and hold `held` values, one after another, and their bounds."""
    ends = np.concatenate([[0], np.cumsum(held)])
    at = np.repeat(begin - ends[:-1], held)
    at += np.arange(ends[-1])
    return pool[at], ends


def _spelled(words: np.ndarray) -> list[bytes]:
    wide = np.empty((words.shape[1], 3), ">u8")
    wide[:] = words.T
    return wide.view("S24").ravel().tolist()


class Encoder:
    """Encodes texts piece by piece, with a bounded memory of pieces seen before.

    A pre-tokenizer of the byte-level kind starts a new word at a blank or line end that
    stands between two visible characters, so such pieces are encoded alone with the same
    ids. A pre-tokenizer that drops white space (`drops_space`) allows a cut at every one.
    Both kinds also part a letter or digit from the punctuation behind it.

    The pieces of many texts are cut and told apart in packed words; only distinct ones are looked up.
    """

    def __init__(self, path: str, drops_space: bool) -> None:
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = True
        self.model = self.tokenizer.model
        self.drops_space = drops_space
        self.memory = Memory()
        self.long: dict[bytes, np.ndarray] = {}

    def _regular(self, text: str) -> bool:
        if self.drops_space:
            # The one letter that grows when it is lower-cased moves the tokenizer's cuts.
            return "İ" not in text and "\x00" not in text
        return text[-1:] not in (" ", "\n") and text[:1] != "\n" and not any(c in text for c in _IRREGULAR)

    def _learn(self, keys: list[bytes]) -> list[np.ndarray]:
        """The ids of pieces."""
        out: list = [None] * len(keys)
        others = []
        for k, key in enumerate(keys):
            text = key.decode()
            word = text[1:] if text[:1] == " " else text
            if _PLAIN.fullmatch(word):
                raw = word.lower().encode() if self.drops_space else key
                out[k] = [t.id for t in self.model.tokenize("".join([_LETTERS[b] for b in raw]))]
            else:
                others.append((k, text))
        for k in range(0, len(others), 4096):
            part = others[k : k + 4096]
            coded = self.tokenizer.encode_batch_fast([t for _, t in part], add_special_tokens=False)
            for (place, _), x in zip(part, coded):
                out[place] = x.ids
        return out

    def _cuts(self, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        """Where the pieces of regular texts begin, the texts' own beginnings included."""
        space, line = data == 32, data == 10
        cut = space | line
        # Behind a line end, and between a letter or digit and punctuation.
        cut[1:] |= line[:-1] | space[:-1] if self.drops_space else line[:-1]
        ends = _ALNUM[data]
        ends[1:] |= _LATIN[data[1:]] & (data[:-1] == 0xC3)
        cut[1:] |= ends[:-1] & _MARK[data[1:]]
        cut[offsets[:-1][offsets[:-1] < offsets[1:]]] = True
        return np.flatnonzero(cut)

    def _chunk(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of regular texts, one after another, and their bounds."""
        starts = self._cuts(data, offsets)
        sizes = np.diff(starts, append=len(data))
        # A long piece is told apart by its bytes and packed as an empty one.
        short = np.where(sizes > PACKED, 0, sizes)
        padded = np.zeros(len(data) + PACKED, np.uint8)
        padded[: len(data)] = data
        eight = np.ndarray((len(data) + PACKED - 7,), ">u8", padded.data, 0, (1,))
        first = eight[starts].astype(np.uint64) & _FIRST[np.minimum(short, 8)]
        second = eight[starts + 8].astype(np.uint64) & _FIRST[np.clip(short - 8, 0, 8)]
        third = eight[starts + 16].astype(np.uint64) & _FIRST[np.clip(short - 16, 0, 8)]
        mixed = mix(first ^ mix(second ^ mix(third ^ np.uint64(0x9E3779B97F4A7C15))))
        # Equal pieces come together; should two different ones mix alike, a piece may only be looked up twice.
        order = np.argsort(mixed)
        words = np.stack([first[order], second[order], third[order]])
        fresh = np.ones(len(order), bool)
        fresh[1:] = (words[:, 1:] != words[:, :-1]).any(axis=0)
        which = np.empty(len(order), np.int64)
        which[order] = np.cumsum(fresh) - 1
        mixed, words = mixed[order[fresh]], words[:, fresh]
        memory = self.memory
        at = memory.find(mixed, words)
        begin, held = memory.begin[np.maximum(at, 0)] if len(memory.begin) else np.zeros(len(at), np.int64), np.zeros(len(at), np.int64)
        if len(memory.held):
            held[at >= 0] = memory.held[at[at >= 0]]
        new = np.flatnonzero(at < 0)
        if len(new):
            begin[new], held[new] = self._put(self._learn(_spelled(words[:, new])))
        pool = memory.pool
        long = np.flatnonzero(sizes > PACKED).tolist()
        if long:
            raw, found = data.tobytes(), {}
            for k in long:
                which[k] = found.setdefault(raw[starts[k] : starts[k] + sizes[k]], len(begin) + len(found))
            unknown = [key for key in found if key not in self.long]
            self.long.update(zip(unknown, (np.array(x, np.uint32) for x in self._learn(unknown))))
            ids = [self.long[key] for key in found]
            n = np.array([len(x) for x in ids], np.int64)
            begin, held = np.append(begin, len(pool) + np.cumsum(n) - n), np.append(held, n)
            pool = np.concatenate([pool, *ids])
            if len(self.long) > LONG_MEMORY:
                self.long.clear()
        ids, ends = gathered(pool, begin[which], held[which])
        if len(new):
            memory.add(mixed[new], words[:, new], begin[new], held[new])
        return ids, ends[np.searchsorted(starts, offsets)]

    def _put(self, coded: list[list[int]]) -> tuple[np.ndarray, np.ndarray]:
        """Where the ids of new pieces begin in the pool, and how many they are."""
        held = np.fromiter(map(len, coded), np.int64, len(coded))
        flat = np.fromiter((i for x in coded for i in x), np.uint32, int(held.sum()))
        begin = len(self.memory.pool) + np.cumsum(held) - held
        self.memory.pool = np.concatenate([self.memory.pool, flat])
        return begin, held

    def encoded(self, texts: pa.Array) -> Iterator[Ids]:
        """Ids of a string column, in parts of bounded size; null counts as empty."""
        low = 0
        strings = texts.to_pylist()
        while low < len(strings):
            high, size = low, 0
            while high < len(strings) and (high == low or size + 4 * len(strings[high] or "") <= 4 * CHUNK_BYTES):
                size += 4 * len(strings[high] or "")
                high += 1
            some = [t or "" for t in strings[low:high]]
            regular = np.array([self._regular(t) for t in some], bool)
            raw = [t.replace("\n", " ").encode() if self.drops_space else t.encode() for t, r in zip(some, regular) if r]
            offsets = np.concatenate([[0], np.cumsum([len(x) for x in raw], dtype=np.int64)]).astype(np.int64)
            ids, bounds = self._chunk(np.frombuffer(b"".join(raw), np.uint8), offsets)
            if not regular.all():
                whole = [t for t, r in zip(some, regular) if not r]
                other = [np.array(x.ids, np.uint32) for x in self.tokenizer.encode_batch_fast(whole, add_special_tokens=False)]
                plain, rest = iter(np.split(ids, bounds[1:-1])), iter(other)
                rows = [next(plain) if r else next(rest) for r in regular]
                ids = np.concatenate(rows)
                bounds = np.concatenate([[0], np.cumsum([len(x) for x in rows])])
            yield Ids(low, high, ids, bounds)
            low = high

    def encode(self, texts: Sequence[str | None]) -> list[np.ndarray]:
        """Ids of each text as uint32; null counts as empty."""
        return [x for part in self.encoded(pa.array(texts, pa.string())) for x in np.split(part.ids, part.bounds[1:-1])]


def encoder(path: str, drops_space: bool = False) -> Encoder:
    """The encoder of this worker for a file."""
    os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
    return remembered(f"encoder {path} {drops_space}", lambda: Encoder(path, drops_space))

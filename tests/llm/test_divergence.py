"""Source divergence against a plain count, on odd rows and over several blocks and slices."""

import random
import re
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest

from tallyline.llm import divergence, packed

TERM = re.compile(rb"[A-Za-z\x80-\xff]+")
SCHEMA = "doc_id long, lang string, source string, text string, n long, term string, docs long, value long, rank int"


def terms_of(text):
    return [bytes(b + 32 if 65 <= b <= 90 else b for b in m) for m in TERM.findall((text or "").encode())]


def plain(rows, least, top):
    count, docs, groups = Counter(), Counter(), set()
    for lang, source, text in rows:
        lang, source = lang or "", source or ""
        groups.add((lang, source))
        words = terms_of(text)
        count.update((lang, source, w) for w in words)
        docs.update((lang, w) for w in set(words))
    out = set()
    for lang in {g[0] for g in groups}:
        kept = sorted(w for (of, w), n in docs.items() if of == lang and n >= least)
        sources, v = sorted(s for of, s in groups if of == lang), len(kept)
        n = {s: sum(count[lang, s, w] for w in kept) for s in sources}
        p = {(s, w): 1 + 10**9 * (count[lang, s, w] + 5) // (n[s] + 5 * v) for s in sources for w in kept}
        q = {w: 1 + 10**9 * (sum(count[lang, s, w] for s in sources) + 5) // (sum(n.values()) + 5 * v) for w in kept}
        for s in sources:
            pairs = [(-sum(abs(p[s, w] - p[o, w]) for w in kept), o.encode()) for o in sources if o != s]
            over = [(q[w] - p[s, w], w) for w in kept if count[lang, s, w] and p[s, w] > q[w]]
            for part, items in (("pair", sorted(pairs)), ("term", sorted(over)[:top])):
                out |= {(lang, s, part, item.decode(), -value, k) for k, (value, item) in enumerate(items, 1)}
    return out


def compared(spark, rows, **options):
    table = spark.createDataFrame([(k, *r, 1, "x", 2, 3, 4) for k, r in enumerate(rows)], SCHEMA).repartition(3)
    result = divergence.source_divergence(table, **options).collect()
    return {(r.lang, r.source, r.part, r["item"], r.value, r.rank) for r in result}, len(result)


def made(n, sources, seed):
    rnd = random.Random(seed)
    words = ["a", "B", "eightlet", "ninelette", "sixteenletterswo", "seventeenletterss", "ÉÉ", "東京", "x" * 300, "x" * 300 + "y", "é" * 4, "Zz"]
    words += [f"{a}{b}" for a in "klmnop" for b in "abcdefgh"]
    return [
        (rnd.choice(["en", "de", None, ""]), rnd.choice(sources), rnd.choice(" ,9\n").join(rnd.choices(words, k=rnd.randrange(30))))
        for _ in range(n)
    ]


def test_against_plain_counts(spark):
    rows = made(150, ["s1", "s2", "é", None, ""], 1)
    rows += [("fr", "only", "a b"), ("it", "one", None), ("it", "two", ""), ("it", None, "123 !"), ("en", "s1", "the " * 20_000)]
    rows += [("en", "s9", "tie tie"), ("en", "s8", "tie tie")] * 3
    got, n = compared(spark, rows, least_docs=3, top_terms=7)
    assert got == plain(rows, 3, 7) and n == len(got)


def test_blocks_and_slices(spark, monkeypatch):
    monkeypatch.setattr(divergence, "BLOCK_SOURCES", 3)
    monkeypatch.setattr(divergence, "SLICE_ROWS", 40)
    rows = made(200, [f"s{k}" for k in range(8)], 2)
    got, _ = compared(spark, rows, least_docs=2, top_terms=5)
    assert got == plain(rows, 2, 5)


def test_pairs_of_blocks_in_narrow_tables(monkeypatch):
    monkeypatch.setattr(divergence, "CELLS", 4)
    rows = [("x", 0, 0, 1, b, s, t, p, 4) for b, s, t, p in [(0, "a", None, 1), (1, "b", None, 2), (0, "a", "w", 9), (1, "b", "v", 5), (0, "a", "v", 7)]]
    names = ["lang", "slice", "low", "high", "block", "source", "term", "p", "v"]
    out = divergence._block_pairs(pa.table({n: [r[k] for r in rows] for k, n in enumerate(names)})).to_pylist()
    assert [(r["source"], r["item"], r["value"]) for r in out] == [("a", "b", 11), ("b", "a", 11)]


def test_empty_table(spark):
    assert divergence.source_divergence(spark.createDataFrame([], SCHEMA)).count() == 0


@pytest.mark.parametrize("chunk", [1, 40, 1 << 20])
def test_packed_terms_are_the_terms(monkeypatch, chunk):
    monkeypatch.setattr(packed, "CHUNK_BYTES", chunk)
    texts = ["", "Ab cd", None, "eightlet ninelette", "é" * 8 + "1" + "é" * 9, "q" * 400, "", "last", "9", "x"] + [t for *_, t in made(40, ["s"], 5)]
    got = defaultdict(list)
    for c in packed.chunks(pa.array(texts, pa.string()).slice(1), packed.byte_class()):
        for bucket in (c.one, c.two, *c.longer):
            order = packed.sorted_order(bucket)
            words = packed.spelled(bucket, order)
            assert words == sorted(words)
            for w, k in zip(packed.spelled(bucket, np.arange(len(order))), bucket.text):
                got[c.low + k].append(w)
        for k, n in enumerate(c.counts):
            assert len(got[c.low + k]) == n
    for k, text in enumerate(texts[1:]):
        assert sorted(got[k]) == sorted(terms_of(text))


def test_radix_order_is_stable():
    keys = np.random.default_rng(0).integers(0, 1 << 63, 5_000, dtype=np.uint64)
    keys[::3] = keys[0]
    assert (packed.radix_order(keys) == np.argsort(keys, kind="stable")).all()

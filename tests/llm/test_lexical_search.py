"""Ranked search against scoring every document in plain Python."""

import math
import random
import re
from collections import Counter

import numpy as np
import pytest

from tallyline.llm import lexical_search

TERM = re.compile(rb"[0-9A-Za-z\x80-\xff]+")
DOCS, ITEMS = "doc_id int, text string, score long, rank int, item_id long", "item_id string, text string, doc_id long"


def terms_of(text):
    return [bytes(b + 32 if 65 <= b <= 90 else b for b in m) for m in TERM.findall((text or "").encode())]


def plain(docs, items, k):
    held = [(i, Counter(terms_of(t))) for i, t in docs]
    held = [(i, c) for i, c in held if c]
    n_docs, length = len(held), sum(sum(c.values()) for _, c in held)
    df = Counter(w for _, c in held for w in c)
    wanted = {}
    for i, t in items:
        wanted.setdefault(i, set()).update(terms_of(t))
    out = set()
    for item, terms in wanted.items():
        scores = []
        for doc, c in held:
            m = 50 + (50 * sum(c.values()) * n_docs) // length
            s = sum(
                math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[w] + 1))) * ((10**9 * c[w]) // (1000 * c[w] + 20 * m))
                for w in terms
                if c[w]
            )
            if s > 0:
                scores.append((-s, doc is None, doc or 0))
        out |= {(item, r, None if null else doc, -s) for r, (s, null, doc) in enumerate(sorted(scores)[:k], 1)}
    return out


def found(spark, docs, items, parts=3, **options):
    left = spark.createDataFrame([(*d, 1, 2, 3) for d in docs], DOCS).repartition(parts)
    right = spark.createDataFrame([(*i, 4) for i in items], ITEMS)
    rows = lexical_search.ranked_search(left, right, **options).collect()
    assert len({(r.item_id, r.rank) for r in rows}) == len(rows)
    return {tuple(r) for r in rows}


def made(n, seed):
    rnd = random.Random(seed)
    rare = [f"word{k}" for k in range(200)] + ["longerthansixteenbytes", "éçéçéç", "x" * 500, "exactlysixteenby"]
    common = ["the", "of", "and", "in", "Zu"]
    docs = [(i, " ".join(rnd.choices(common, k=rnd.randrange(20)) + rnd.choices(rare, k=rnd.randrange(8)))) for i in range(n)]
    items = [(f"i{i}", "-".join(rnd.sample(common, 3) + rnd.sample(rare, 4))) for i in range(25)]
    return docs, items


def test_against_plain_scores(spark):
    docs, items = made(300, 1)
    docs += [(1000, None), (1001, ""), (1002, "!?"), (None, "word1 word2 the"), (1003, "the of " * 40_000), (7, "word3 THE"), (8, "Word3 the")]
    docs += [(2000 + k, "same word5 the") for k in range(9)]
    items += [("i1", "word7"), (None, "word5 the"), ("none", None), ("odd", "nowhere"), ("e", ""), ("common", "the of and in zu")]
    assert found(spark, docs, items, k=6) == plain(docs, items, 6)


@pytest.mark.parametrize("window, short, shard", [(1, 2, 10), (7, 1, 60), (64, 10**9, 10**9)])
def test_windows_and_shards_do_not_change_the_result(spark, window, short, shard, monkeypatch):
    docs, items = made(200, 2)
    expected = plain(docs, items, 4)
    # Workers see patched values only through the functions that use them, so the search runs here.
    ids, held, places = np.array([i for i, _ in docs]), [Counter(terms_of(t)) for _, t in docs], {}
    for _, text in items:
        for w in terms_of(text):
            places.setdefault(w, len(places))
    full = [k for k, c in enumerate(held) if c]
    docs_all, length = len(full), sum(sum(c.values()) for c in held)
    df = Counter(w for c in held for w in c)
    weights = np.array([math.floor(1000 * math.log((2 * docs_all + 2) / (2 * df[w] + 1))) for w in places], np.int64)
    monkeypatch.setattr(lexical_search, "WINDOW", window)
    monkeypatch.setattr(lexical_search, "SHORT", short)
    best, step = [lexical_search.Best(4) for _ in items], max(1, shard // 10)
    for low in range(0, len(full), step):
        some = full[low : low + step]
        cells = [[(places[w], n) for w, n in held[k].items() if w in places] for k in some]
        flat = [x for c in cells for x in c]
        lists = lexical_search.inverted(
            ids[some], np.array([sum(held[k].values()) for k in some]), np.array([len(c) for c in cells]),
            np.array([t for t, _ in flat], np.int32), np.array([n for _, n in flat], np.int32), weights, docs_all, length,
        )
        for (_, text), b in zip(items, best):
            lexical_search.answer(lists, np.array(sorted({places[w] for w in terms_of(text)})), b)
    got = {(i, r, int(d), int(s)) for (i, _), b in zip(items, best) for r, (d, s) in enumerate(zip(b.ids, b.scores), 1)}
    assert got == expected


def test_blocks_of_items(spark, monkeypatch):
    monkeypatch.setattr(lexical_search, "BLOCK_PAIRS", 60)
    docs, items = made(120, 3)
    assert found(spark, docs, items, k=5) == plain(docs, items, 5)


def test_empty_tables(spark):
    assert found(spark, [], [("a", "b")]) == set() == found(spark, [(1, "b")], [])


def test_vocabulary_finds_its_terms():
    from tallyline.llm.packed import byte_class, chunks
    import pyarrow as pa

    terms = [b"a", b"eightlet", b"ninelette", b"sixteenletterswo", b"seventeenletterss", "é".encode()]
    known = lexical_search.Vocabulary(terms)
    text = "a b eightlet eightleT ninelette sixteenletterswo sixteenletterswa seventeenletterss seventeenletterst é"
    (chunk,) = chunks(pa.array([text]), byte_class(True, True))
    got = sorted(n for b in (chunk.one, chunk.two, *chunk.longer) for n in known.numbers(b).tolist())
    assert got == [-1, -1, -1, 0, 1, 1, 2, 3, 4, 5]

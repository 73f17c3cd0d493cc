"""Suffix arrays, hits and longest matches against plain searches."""

import hashlib
import random
import re

import numpy as np

from tallyline.llm import decontaminate

WORD = re.compile("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def plain_words(text):
    return WORD.findall((text or "").translate(LOWER))


def plain_judge(text, items, window, share):
    words, hit, found = plain_words(text), set(), []
    for name, item in items:
        own = plain_words(item)
        k = min(window, len(own))
        wins = {tuple(own[j : j + k]) for j in range(len(own) - k + 1)} if own else set()
        at = [p for p in range(len(words) - k + 1) if tuple(words[p : p + k]) in wins]
        hit.update(q for p in at for q in range(p, p + k))
        if at:
            found.append(name)
    digest = hashlib.sha256(",".join(sorted(x for x in found if x is not None)).encode()).hexdigest()
    return len(words), len(hit), len(found), digest, bool(hit) and share * len(hit) >= len(words)


def plain_longest(docs, item, window):
    own, best = plain_words(item), 0
    for _, text in docs:
        words = plain_words(text)
        for j in range(len(own)):
            for p in range(len(words)):
                k = 0
                while j + k < len(own) and p + k < len(words) and own[j + k] == words[p + k]:
                    k += 1
                best = max(best, k)
    return best if best >= min(window, len(own)) and own else None


def random_tables(seed, letters):
    rng = random.Random(seed)

    def text(n):
        return " ".join(rng.choice(letters) for _ in range(n))

    items = [(f"i{k}", text(rng.choice([1, 2, 3, 5, 9, 20]))) for k in range(12)]
    items += [(None, "N u l l items count"), ("none", None), ("empty", " .,- "), ("loop", "a a a a a a a a a a")]
    docs = [(d, text(rng.choice([0, 1, 4, 30, 60]))) for d in range(40)]
    docs += [(50, None), (51, "x n U l l ITEMS count"), (52, "a " * 50), (52, "a " * 50), (None, items[5][1] or "")]
    docs += [(60 + k, f"begin {x} x {y} end") for k, ((_, x), (_, y)) in enumerate(zip(items[:6], items[6:12]))]
    return docs, items


def test_suffix_array_orders_whole_suffixes():
    rng = np.random.default_rng(5)
    for top in (2, 3, 40):
        tests = decontaminate.Tests([("i", " ".join(f"w{k}" for k in range(40)))], 3)
        ids = np.concatenate((rng.integers(0, top, 400), np.ones(90), [0], np.ones(90), [0])).astype(np.int32)

        def suffix(p):
            out = []
            while ids[p]:
                out.append(int(ids[p]))
                p += 1
            return out

        wanted = sorted((p for p in range(len(ids)) if len(suffix(p)) >= 3), key=lambda p: (suffix(p), p))
        assert decontaminate.suffix_array(ids, tests).tolist() == wanted


def test_against_plain_search(spark, monkeypatch):
    for seed, letters, chars in ((1, "abc", 10_000_000), (2, "abcdefgh", 10_000_000), (3, "ab", 40)):
        monkeypatch.setattr(decontaminate, "BLOCK_CHARS", chars)
        docs, items = random_tables(seed, letters)
        left = spark.createDataFrame(docs, "doc_id long, text string").repartition(3)
        right = spark.createDataFrame(items, "item_id string, text string")
        got = decontaminate.contamination(left, right, window=4, share=3, unnamed=True).collect()
        wanted = [(d, *plain_judge(t, items, 4, 3)) for d, t in docs]
        columns = ("doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated")
        assert sorted(map(str, (tuple(r[c] for c in columns) for r in got))) == sorted(map(str, wanted))

        texts: dict = {}
        for d, t in docs:
            texts.setdefault(d, []).append(plain_words(t))
        rows = {r.item_id: r for r in decontaminate.longest_matches(left, right, window=4, unnamed=True).collect()}
        lengths = {name: plain_longest(docs, item, 4) for name, item in items}
        assert {k: r.length for k, r in rows.items()} == {k: v for k, v in lengths.items() if v}
        words = {name: plain_words(item) for name, item in items}
        for name, r in rows.items():
            part = words[name][r.item_start : r.item_start + r.length]
            assert len(part) == r.length
            assert any(t[r.start : r.start + r.length] == part for t in texts[r.doc_id])


def test_empty_tables(spark):
    docs = spark.createDataFrame([(1, "a b c d")], "doc_id long, text string")
    items = spark.createDataFrame([("i", "a b")], "item_id string, text string")
    assert decontaminate.longest_matches(docs.limit(0), items).count() == 0
    assert decontaminate.longest_matches(docs, items.limit(0)).count() == 0
    assert [tuple(r) for r in decontaminate.longest_matches(docs, items).collect()] == [("i", 2, 0, 1, 0)]


def test_long_copied_item_is_searched_once(monkeypatch):
    text = " ".join(f"w{k % 977} v{k}" for k in range(20_000))
    tests = decontaminate.Tests([("long", text)], 13)
    calls, common = [], decontaminate._common
    monkeypatch.setattr(decontaminate, "_common", lambda *a: calls.append(1) or common(*a))
    (n, hit, items, matches), _ = decontaminate.search([f"before {text} after", "other words"], tests)
    assert (n, int(hit.sum()), items, matches) == (40_002, 40_000, {0}, [(0, 40_000, 0, 1)])
    assert len(calls) < 20

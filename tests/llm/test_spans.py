"""Repeated spans against plain runs of sentences."""

import random
from collections import defaultdict

from tallyline.llm import substring_dedup as S
from tallyline.llm.common import LOWER, utf8


def plain(rows, min_words, min_sentences):
    """The text of every row by the stated rule: sentences covered by a run that stood before go."""
    places = defaultdict(set)
    parts = {}
    for doc, text in rows:
        raw = utf8(text)
        at, first = S.sentences(raw)
        words = raw.translate(LOWER).split()
        found = []
        for i in range(len(first) - 1):
            j = i + min_sentences
            while j < len(first) and first[j] - first[i] < min_words:
                j += 1
            if j < len(first):
                found.append((i, j, b" ".join(words[first[i] : first[j]])))
        parts[doc, text] = (raw, at, found)
        for i, _, run in found:
            places[run].add(((doc is not None, doc), S_version(text), i, text))
    out = []
    for doc, text in rows:
        raw, at, found = parts[doc, text]
        gone = set()
        for i, j, run in found:
            if min(places[run], key=lambda p: p[:3])[:3] != ((doc is not None, doc), S_version(text), i):
                gone |= set(range(i, j))
        left = raw if not gone else b"".join(raw[at[k] : at[k + 1]] for k in range(len(at) - 1) if k not in gone).strip()
        out.append((doc, None if text is None else left.decode()))
    return out


def test_runs_against_plain_python(spark):
    from pyspark.sql import functions as F

    global S_version
    rnd = random.Random(3)
    pool = [" ".join(rnd.choices(["red", "Blue", "green", "x1", "é"], k=rnd.randrange(1, 9))) + rnd.choice([". ", "! ", "\n", "?) "]) for _ in range(14)]
    pool += [" ".join(rnd.choices("abcdefgh", k=60)) + ". "]
    rows = [(i, "".join(rnd.choices(pool, k=rnd.randrange(12)))) for i in range(40)]
    rows += [(40, None), (41, ""), (None, rows[3][1]), (5, rows[9][1]), (5, rows[5][1])]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    versions = {r.text: r.v for r in df.select("text", F.xxhash64("text").alias("v")).collect()}
    S_version = versions.__getitem__
    got = [(r.doc_id, r.text) for r in S.remove_repeats(df, 8, 2).collect()]
    assert sorted(got, key=str) == sorted(plain(rows, 8, 2), key=str)
    assert sum(t != u for (_, t), (_, u) in zip(rows, plain(rows, 8, 2))) > 10

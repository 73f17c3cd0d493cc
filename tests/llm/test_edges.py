"""Every operator and stage on nulls, empty and long texts, ties, repeated rows, empty tables, clashing columns."""

import public_tokenizers
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from tallyline.llm import (
    decontaminate, html_text, licenses, metric_join, near_dedup, packing, quality, substring_dedup, token_orc, toxicity,
)

LONG = " ".join(f"word{i % 977}x" for i in range(60_000)) + " apache license"
TEXTS = [
    (1, None), (2, ""), (3, " \n\t "), (4, "One."), (5, LONG), (6, LONG), (6, LONG), (7, "a b c d e f g h"),
    (8, "a b c d e f g h"), (None, "no id here at all"), (9, "éß \U0001f642 İstanbul."), (9, "another text"),
]
DOCS = "doc_id long, text string, lang string, source string, n_chars long, n_words long, version long, score double, kept boolean, hash string"
LABELS = "doc_id long, quality int, toxic int, text string"


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(i, t, "en", "s", len(t or ""), 5, 6, 0.5, True, "h") for i, t in TEXTS]
    return spark.createDataFrame(rows, DOCS).coalesce(3)


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], DOCS)


@pytest.fixture(scope="module")
def labels(spark):
    return spark.createDataFrame([(4, 1, 0, "x"), (7, 0, 1, "x"), (5, 1, 0, None), (None, 1, 1, "x"), (6, None, None, "x")], LABELS)


@pytest.fixture(scope="module")
def benchmark(spark):
    rows = [("i1", "a b c d e f g h"), ("i2", None), ("i3", "?!"), (None, "another text")]
    return spark.createDataFrame(rows, "item_id string, text string").withColumn("doc_id", F.lit(1))


def path(name):
    return str(public_tokenizers.path(name))


def test_token_files(spark, docs, none, tmp_path):
    for n, table in enumerate((docs, none)):
        folder = f"{tmp_path}/{n}"
        token_orc.write_tokens(table, folder, path("byte_bpe_50k.json"))
        rows = token_orc.digest(token_orc.read_tokens(spark, folder)).orderBy("start").collect()
        assert len(rows) == table.count()
        at = 0
        for row in rows:
            assert row.start == at
            at += row.n_tokens
    ids = [r.doc_id for r in token_orc.read_tokens(spark, f"{tmp_path}/0").orderBy("start").collect()]
    assert ids == [None, 1, 2, 3, 4, 5, 6, 6, 7, 8, 9, 9]
    assert {r.n_tokens for r in token_orc.find(spark, f"{tmp_path}/0", [1, 2]).collect()} == {1}


def test_packing(docs, none):
    packed = packing.packed_pieces(docs, path("word_bpe_49k.json"), 64)
    rows = packed.orderBy("sequence_id", "offset").collect()
    fill = {}
    for row in rows:
        assert row.offset == fill.get(row.sequence_id, 0)
        fill[row.sequence_id] = row.offset + row.length
        assert len(row.ids) == 4 * row.length
    assert max(fill.values()) <= 64
    assert len({(r.doc_id, r.start) for r in rows if r.doc_id in (1, 2)}) == 2
    whole = {r.sequence_id: (r.n_tokens, len(r.ids)) for r in packing.sequences(packed).collect()}
    assert whole == {k: (v, 4 * v) for k, v in fill.items()}
    assert packing.packed_pieces(none, path("word_bpe_49k.json")).count() == 0


def test_near_duplicates(docs, none):
    rows = near_dedup.duplicate_classes(docs, size=4).collect()
    assert len(rows) == len(TEXTS)
    got = {r.doc_id: (r.component_id, r.kept) for r in rows}
    assert got == {
        1: (1, True), 2: (2, True), 3: (3, True), 4: (4, True), 5: (5, True), 6: (5, False), 7: (7, True), 8: (7, False),
        None: (None, True), 9: (9, True),
    }
    assert {r.n_shingles for r in rows if r.doc_id in (1, 2, 3)} == {0}
    assert near_dedup.duplicate_classes(none).count() == 0


def test_repeats(docs, none):
    out = substring_dedup.remove_repeats(docs, min_words=4)
    assert out.columns == [*docs.columns, "n_sentences", "n_removed"]
    rows = {(r.doc_id, r.text): r for r in out.collect()}
    assert rows[1, None].n_sentences == 0 and rows[2, ""].n_removed == 0
    assert (7, "a b c d e f g h") in rows and (8, "a b c d e f g h") in rows  # one sentence is no run
    assert out.where("doc_id = 6").select("text").distinct().count() == 1
    assert out.where("doc_id = 6 and n_removed > 0").count() == 2
    assert substring_dedup.remove_repeats(none).count() == 0


def test_contamination(docs, none, benchmark, spark):
    rows = {(r.doc_id, r.n_words): r for r in decontaminate.contamination(docs, benchmark).collect()}
    assert rows[7, 8].contaminated and rows[8, 8].items == ["i1"] and rows[7, 8].sizes == [8]
    assert not rows[1, 0].contaminated and rows[1, 0].n_words == 0
    assert len(rows) == 11  # two equal rows of one id
    clean = decontaminate.remove_contaminated(docs, benchmark)
    assert clean.columns == docs.columns and clean.count() == len(TEXTS) - 2
    assert decontaminate.contamination(none, benchmark).count() == 0
    assert decontaminate.contamination(docs, benchmark.limit(0)).where("contaminated").count() == 0


def test_contamination_in_several_passes(docs, benchmark, monkeypatch):
    once = sorted(map(str, decontaminate.contamination(docs, benchmark).collect()))
    monkeypatch.setattr(decontaminate, "BLOCK_CHARS", 3)
    assert sorted(map(str, decontaminate.contamination(docs, benchmark).collect())) == once


def test_licenses(docs, none):
    rows = licenses.scan_licenses(docs).collect()
    assert len(rows) == len(TEXTS)
    got = {r.doc_id: r for r in rows}
    assert (got[5].n_base, got[5].first_word, got[5].last_word, got[5].labels) == (1, 60_000, 60_000, "apache")
    assert (got[1].n_words, got[1].n_base, got[1].first_word, got[1].labels, got[1].score) == (0, 0, None, "", 0.0)
    assert licenses.scan_licenses(none).count() == 0


@pytest.mark.parametrize("score", [quality.quality, toxicity.toxicity])
def test_scores(docs, none, labels, score):
    for given in (labels, labels.limit(0)):
        rows = score(docs, given).collect()
        assert len(rows) == len(TEXTS)
        assert all(0 <= r.score <= 1 and r.predicted in (0, 1) for r in rows)
    assert score(none, labels).count() == 0


def test_vectors(spark):
    kind = "vec_id long, embedding array<float>, label int, key string, unit string, id long, k long"
    nan = float("nan")
    vectors = [
        (1, [1.0, 0.0], 0), (2, [2.0, 0.0], 0), (3, [1.0, 0.1], 0), (3, [1.0, 0.1], 0), (4, [1.0, 0.0], 1), (5, None, 0),
        (6, [0.0, 0.0], 0), (7, [1.0, nan], 0), (8, [1.0, None], 0), (9, [1.0, 0.0], None), (10, [], 0), (11, [1.0, 0.0, 0.0], 0),
        (None, [1.0, 0.0], 2), (12, [float("inf"), 0.0], 0),
    ]
    table = spark.createDataFrame([(*v, "x", "x", 1, 1) for v in vectors], kind)
    rows = metric_join.linked_vectors(table).collect()
    assert len(rows) == len(vectors)
    got = {r.vec_id: (r.n_links, r.component_id, r.kept) for r in rows}
    assert {got[i] for i in (1,)} == {(3, 1, True)} and got[2] == got[3] == (3, 1, False)
    assert all(got[i] == (0, i, True) for i in (4, 5, 6, 7, 8, 9, 10, 11, 12)) and got[None][1:] == (None, True)
    assert metric_join.linked_vectors(table.limit(0)).count() == 0


def test_pages(spark):
    pages = [(1, "u", None), (2, None, ""), (3, "u", "<p>broken &amp <b>off"), (3, "u", "<"), (4, "u", "<p>" + "long words. " * 40_000)]
    table = spark.createDataFrame(pages, "page_id long, url string, html string").withColumn("text", F.lit("clash"))
    rows = html_text.extract(table).collect()
    assert len(rows) == 5 and {r.n_chars for r in rows if r.page_id < 3} == {0}
    assert all(r.n_chars == len(r.text) for r in rows)
    assert html_text.extract(table.limit(0)).count() == 0


def test_pipeline_stages(spark, docs, none, labels, benchmark, tmp_path):
    labels.write.parquet(f"{tmp_path}/labels.parquet")
    benchmark.write.parquet(f"{tmp_path}/benchmark.parquet")
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    for _, stage in corpus_pipeline.STAGES[:-1]:
        assert stage(spark, docs, str(tmp_path)).columns == corpus_pipeline.COLUMNS
        assert stage(spark, none, str(tmp_path)).count() == 0
    name, last = corpus_pipeline.STAGES[-1]
    assert name == "packing" and last(spark, none, str(tmp_path)).count() == 0
    assert corpus_pipeline.run(spark, str(tmp_path)).agg(F.max("length")).first()[0] <= 4096


def test_span_columns_may_clash(spark):
    text = "One two three four five six seven. Eight nine ten eleven twelve. A b c d e f g h i j k l."
    rows = [(1, text, 1, 2, 3, 4, 5), (2, text, 1, 2, 3, 4, 5)]
    table = spark.createDataFrame(rows, "doc_id long, text string, __id int, __VERSION int, __starts int, __v int, __cut int")
    out = {r.doc_id: r for r in substring_dedup.remove_repeats(table).collect()}
    assert out[1].text == text and out[2].text == "" and out[2]["__id"] == 1 and out[2]["__cut"] == 5


def test_scoring_drops_what_earlier_stages_left_in_the_worker(spark):
    import pandas as pd

    from tallyline.llm import common
    from tallyline.llm.quality import quality_scorer

    docs = spark.createDataFrame([(k, f"some words {k}") for k in range(10)], "doc_id long, text string")
    labels = spark.createDataFrame([], "doc_id long, quality int")
    score = quality_scorer(docs, labels)
    common.remembered("encoder of another stage", lambda: [0] * 1000)
    assert len(score.func(pd.Series(["a text", ""]))) == 2
    assert not common._memories

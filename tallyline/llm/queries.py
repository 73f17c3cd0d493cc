"""The registered query of each operator, with its production parameters, over whole tables."""

from __future__ import annotations

import corpus_pipeline
import public_tokenizers
from pyspark.sql import functions as F

from tallyline.llm import decontaminate, divergence, html_text, lexical_search, licenses, metric_join, near_dedup, packing, personal, quality, substring_dedup, token_orc, toxicity
from tallyline.llm.common import read

QUERIES, SQL = {}, {}


def query(name, sql=None):
    def register(fn):
        QUERIES[name] = fn
        if sql is not None:
            SQL[name] = sql
        return fn

    return register


UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

# Links (a, b) with a > b are followed to the smallest id.
ROOTS = """
reach(id, other) AS (
    SELECT a, b FROM (SELECT a, b FROM links UNION SELECT b, a FROM links)
    UNION
    SELECT r.id, l.b FROM reach r JOIN (SELECT a, b FROM links UNION SELECT b, a FROM links) l ON r.other = l.a
),
roots AS (SELECT id, least(id, min(other)) AS root FROM reach GROUP BY id)
"""

LINKED_VECTORS = f"""
WITH RECURSIVE vectors AS (
    SELECT vec_id, label, embedding::DOUBLE[] AS v FROM embeddings
    WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(embedding) = len([x FOR x IN embedding IF isfinite(x)])
      AND list_sum([x * x FOR x IN embedding::DOUBLE[]]) > 0
),
links AS (
    SELECT x.vec_id AS a, y.vec_id AS b FROM vectors x JOIN vectors y
      ON x.label = y.label AND len(x.v) = len(y.v) AND x.vec_id > y.vec_id
    WHERE list_cosine_similarity(x.v, y.v) >= 0.93
),
{ROOTS},
counts AS (SELECT id, count(*) AS n FROM (SELECT a AS id FROM links UNION ALL SELECT b FROM links) GROUP BY id)
SELECT vec_id, coalesce(n, 0) AS n_links, coalesce(root, vec_id) AS component_id, coalesce(root, vec_id) = vec_id AS kept
FROM embeddings LEFT JOIN counts ON counts.id = vec_id LEFT JOIN roots ON roots.id = vec_id
"""

ALNUM = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"

CONTAMINATION = f"""
WITH items AS (
    SELECT CAST(item_id AS VARCHAR) AS item, regexp_extract_all(translate(text, '{UPPER}', '{LOWER}'), '{ALNUM}') AS w
    FROM benchmark WHERE text IS NOT NULL
),
wins AS (
    SELECT DISTINCT item, least(len(w), 13) AS k, array_to_string(w[j : j + least(len(w), 13) - 1], ' ') AS s
    FROM items, unnest(range(1, greatest(len(w) - 12, 1) + 1)) t(j) WHERE len(w) > 0
),
docs AS (
    SELECT doc_id, coalesce(regexp_extract_all(translate(text, '{UPPER}', '{LOWER}'), '{ALNUM}'), []) AS w FROM documents
),
places AS (
    SELECT doc_id, p, k, array_to_string(w[p : p + k - 1], ' ') AS s
    FROM docs, (SELECT DISTINCT k FROM wins) ks, unnest(range(1, len(w) - k + 2)) t(p)
),
found AS (SELECT DISTINCT doc_id, p, k, item FROM places JOIN wins USING (k, s)),
hits AS (SELECT doc_id, count(DISTINCT q) AS n_hit FROM found, unnest(range(p, p + k)) u(q) GROUP BY doc_id),
named AS (
    SELECT doc_id, count(*) AS n_items, sha256(string_agg(item, ',' ORDER BY item)) AS items
    FROM (SELECT DISTINCT doc_id, item FROM found) GROUP BY doc_id
)
SELECT doc_id, len(w) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
       coalesce(items, sha256('')) AS items_sha256, coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated
FROM docs LEFT JOIN hits USING (doc_id) LEFT JOIN named USING (doc_id)
"""

NEAR_DUPLICATES = f"""
WITH RECURSIVE words AS (
    SELECT doc_id, coalesce(regexp_extract_all(translate(text, '{UPPER}', '{LOWER}'), '[^\x20\x09-\x0D]+'), []) AS w FROM documents
),
sets AS (
    SELECT doc_id, list_sort(list_distinct(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 4 THEN [array_to_string(w, ' ')]
        ELSE [array_to_string(w[p : p + 3], ' ') FOR p IN range(1, len(w) - 2)] END)) AS s
    FROM words
),
reps AS (SELECT s, min(doc_id) AS rep, len(s) AS n FROM sets WHERE len(s) > 0 GROUP BY s),
shingles AS (SELECT rep, n, unnest(s) AS x FROM reps),
links AS (
    SELECT l.rep AS a, r.rep AS b FROM shingles l JOIN shingles r ON l.x = r.x AND l.rep > r.rep
    WHERE 100 * least(l.n, r.n) >= 80 * greatest(l.n, r.n)
    GROUP BY l.rep, r.rep, l.n, r.n HAVING 100 * count(*) >= 80 * (l.n + r.n - count(*))
),
{ROOTS}
SELECT doc_id, len(sets.s) AS n_shingles, coalesce(root, rep, doc_id) AS component_id, coalesce(root, rep, doc_id) = doc_id AS kept
FROM sets LEFT JOIN reps USING (s) LEFT JOIN roots ON roots.id = rep
"""

DIVERGENCE = f"""
WITH d AS (
    SELECT coalesce(lang, '') AS lang, coalesce(source, '') AS source,
           regexp_extract_all(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '[^\x00-\x40\x5B-\x60\x7B-\x7F]+') AS w
    FROM documents
),
kept AS (
    SELECT lang, term FROM (SELECT lang, unnest(list_distinct(w)) AS term FROM d) GROUP BY lang, term HAVING count(*) >= 30
),
counts AS (SELECT lang, source, term, count(*) AS n FROM (SELECT lang, source, unnest(w) AS term FROM d) GROUP BY ALL),
cells AS (
    SELECT g.lang, g.source, k.term, coalesce(c.n, 0) AS n
    FROM (SELECT DISTINCT lang, source FROM d) g JOIN kept k ON k.lang = g.lang
    LEFT JOIN counts c ON c.lang = g.lang AND c.source = g.source AND c.term = k.term
),
shares AS (
    SELECT *, 1 + (1000000000::HUGEINT * (n + 5)) // (sum(n) OVER g + 5 * count(*) OVER g) AS p,
           1 + (1000000000::HUGEINT * (sum(n) OVER t + 5)) // (sum(n) OVER l + 5 * count(DISTINCT term) OVER l) AS q
    FROM cells WINDOW g AS (PARTITION BY lang, source), t AS (PARTITION BY lang, term), l AS (PARTITION BY lang)
),
pairs AS (
    SELECT a.lang, a.source, b.source AS item, coalesce(v.value, 0) AS value
    FROM (SELECT DISTINCT lang, source FROM d) a JOIN (SELECT DISTINCT lang, source FROM d) b ON a.lang = b.lang AND a.source <> b.source
    LEFT JOIN (
        SELECT x.lang, x.source, y.source AS item, sum(abs(x.p - y.p)) AS value
        FROM shares x JOIN shares y ON x.lang = y.lang AND x.term = y.term GROUP BY ALL
    ) v ON v.lang = a.lang AND v.source = a.source AND v.item = b.source
),
parts AS (
    SELECT lang, source, 'pair' AS part, item, value FROM pairs
    UNION ALL SELECT lang, source, 'term', term, p - q FROM shares WHERE n > 0 AND p > q
)
SELECT lang, source, part, item, value::BIGINT AS value,
       row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item)::INT AS rank
FROM parts QUALIFY part = 'pair' OR rank <= 50
"""

WORD = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"

SEARCH = f"""
WITH d AS (
    SELECT doc_id, regexp_extract_all(translate(text, '{UPPER}', '{LOWER}'), '{WORD}') AS w FROM documents WHERE text IS NOT NULL
),
i AS (
    SELECT DISTINCT item_id, unnest(regexp_extract_all(translate(text, '{UPPER}', '{LOWER}'), '{WORD}')) AS term
    FROM benchmark WHERE text IS NOT NULL
),
s AS (SELECT count(*) AS docs, sum(len(w))::BIGINT AS length FROM d WHERE len(w) > 0),
tf AS (
    SELECT doc_id, n, term, count(*) AS tf FROM (SELECT doc_id, len(w) AS n, unnest(w) AS term FROM d)
    WHERE term IN (SELECT term FROM i) GROUP BY ALL
),
df AS (SELECT term, floor(1000 * ln((2 * any_value(docs) + 2) / (2 * count(*) + 1)))::BIGINT AS weight FROM tf, s GROUP BY term),
scores AS (
    SELECT item_id, doc_id, sum(weight * ((1000000000 * tf) // (1000 * tf + 20 * (50 + (50 * n * docs) // length))))::BIGINT AS score
    FROM i JOIN df USING (term) JOIN tf USING (term), s GROUP BY item_id, doc_id
)
SELECT item_id, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id)::INT AS rank, doc_id, score
FROM scores WHERE score > 0 QUALIFY rank <= 50
"""


@query("op1_token_orc")
def op1(spark, sf):
    """Ids of every document, written as ORC and read back."""
    path = token_orc.scratch(spark, "tokens")
    token_orc.write_tokens(read(spark, sf, "documents"), path, str(public_tokenizers.path("byte_bpe_50k.json")))
    return token_orc.digest(token_orc.read_tokens(spark, path))


@query("op4_best_fit_packing")
def op4(spark, sf):
    """Every document's pieces with their sequence and place."""
    packed = packing.packed_pieces(read(spark, sf, "documents"), str(public_tokenizers.path("word_bpe_49k.json")))
    return packed.select("doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset")


@query("op7_hyperminhash_dedup", NEAR_DUPLICATES)
def op7(spark, sf):
    """Classes of documents that share four fifths of their 4-word shingles."""
    return near_dedup.duplicate_classes(read(spark, sf, "documents"), size=4, threshold=0.8)


@query("op2_sentence_spans")
def op2(spark, sf):
    """Every document without the sentences that later copies of a repeated run cover."""
    done = substring_dedup.remove_repeats(read(spark, sf, "documents"))
    return done.select("doc_id", "text", F.length("text").alias("n_chars"), "n_sentences", "n_removed")


@query("op6_suffix_array_decontamination", CONTAMINATION)
def op6(spark, sf):
    """Benchmark words found in every document, and whether they spoil it."""
    found = decontaminate.contamination(read(spark, sf, "documents"), read(spark, sf, "benchmark"), unnamed=True)
    return found.select("doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated")


@query("op10_kneser_ney_toxicity")
def op10(spark, sf):
    """A toxicity score for every document."""
    return toxicity.toxicity(read(spark, sf, "documents"), read(spark, sf, "labels"))


@query("op8_pu_quality")
def op8(spark, sf):
    """A quality score for every document."""
    return quality.quality(read(spark, sf, "documents"), read(spark, sf, "labels"))


@query("op9_license_scan")
def op9(spark, sf):
    """License phrases and labels of every document."""
    return licenses.scan_licenses(read(spark, sf, "documents")).drop("detections")


@query("op3_pivot_range_join", LINKED_VECTORS)
def op3(spark, sf):
    """Links and components of vectors with a cosine of 0.93 or more."""
    return metric_join.linked_vectors(read(spark, sf, "embeddings"), threshold=0.93)


@query("op5_min_cut_text")
def op5(spark, sf):
    """The main text of every page."""
    return html_text.extract(read(spark, sf, "pages"))


@query("op11_source_divergence", DIVERGENCE)
def op11(spark, sf):
    """Distances between the sources of each language, and the terms each uses beyond its language."""
    return divergence.source_divergence(read(spark, sf, "documents"))


@query("op12_bootstrapped_pii")
def op12(spark, sf):
    """Personal identifiers of every document, by shape and by learned contexts."""
    return personal.personal_data(read(spark, sf, "documents"))


@query("op13_lexical_search", SEARCH)
def op13(spark, sf):
    """The 50 best documents of every benchmark item."""
    return lexical_search.ranked_search(read(spark, sf, "documents"), read(spark, sf, "benchmark"))


QUERIES["pipeline"] = corpus_pipeline.run

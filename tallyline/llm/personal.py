"""Personal identifiers, found by fixed shapes and then by contexts learned from what the shapes found.

One pass over whole texts gives each document's identifiers of fixed shape (the seeds), its other
identifier-like spans (candidates, with the kinds they could be) and the words around both. Patterns are the
words around a span; patterns and instances (normalised spans) are the two sides of a graph. In
each round Spark scores every pattern by how much of what it surrounds is of one kind, and every
candidate by the good patterns that surround it; candidates that score high count as instances in the
next round. Scores are integers, so that no result depends on the order of a sum.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyline.llm.common import mapped, row_ids
from tallyline.session import staged

KINDS = ("email", "ip", "card", "phone")
EMAIL, IP, CARD, PHONE = range(4)
# Scores in millionths.
UNIT = 1_000_000

_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
# Possessive parts and a look behind keep the time linear in the text and match as the plain forms do.
_DOMAIN = re.compile(r"@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++")
_IP = re.compile(r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++")
_CARD = re.compile(r"[0-9](?:[ -]?[0-9])++")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
_DIGIT = re.compile("[0-9]")
_NOT_DIGITS = re.compile("[^0-9]+")

# Candidates: digits in groups, and addresses with the signs spelled out.
_CHAIN = re.compile(r"(?<![^\W_])[0-9]++(?:(?:[ ./-]|\) ?| ?\()[0-9]++)*+")
_AT = re.compile(r"(?: ?[\[({] ?(?:at|@) ?[\])}] ?| at | @ ?|@ )", re.IGNORECASE)
_SPELLED = re.compile(
    r"[A-Za-z0-9-]++(?:(?:\.| ?[\[({] ?(?:dot|\.) ?[\])}] ?| dot )[A-Za-z0-9-]++)++", re.IGNORECASE
)
_SIGN = re.compile(r" ?[\[({] ?(?:dot|\.) ?[\])}] ?| dot ", re.IGNORECASE)
_LEFT = re.compile(r"[^\W\d_]+|[:=#]")
_RIGHT = re.compile(r"[^\W\d_]+")
# Code points looked at on each side of a span.
REACH = 64


def _luhn(digits: str) -> bool:
    twice = sum((2 * d) // 10 + (2 * d) % 10 for d in map(int, digits[-2::-2]))
    return (twice + sum(map(int, digits[::-2]))) % 10 == 0


def _small(part: str) -> bool:
    part = part.lstrip("0")
    return len(part) < 3 or (len(part) == 3 and part <= "255")


def seeds(text: str) -> list[tuple[int, int, int]]:
    """Spans of fixed shape as (start, kind, end), sorted; each kind leftmost and without overlaps."""
    found = []
    if "@" in text:
        last = 0
        for m in _DOMAIN.finditer(text):
            start = m.start()
            while start > last and text[start - 1] in _LOCAL:
                start -= 1
            if start < m.start():
                last = m.end()
                found.append((start, EMAIL, last))
    if _DIGIT.search(text):
        for m in _IP.finditer(text):
            if all(map(_small, m.group().split("."))):
                found.append((m.start(), IP, m.end()))
        for m in _CARD.finditer(text):
            if m.end() - m.start() >= 14:
                digits = _NOT_DIGITS.sub("", m.group())
                if 14 <= len(digits) <= 19 and _luhn(digits):
                    found.append((m.start(), CARD, m.end()))
        if "+" in text:
            for m in _PHONE.finditer(text):
                if 10 <= len(_NOT_DIGITS.sub("", m.group())) <= 15:
                    found.append((m.start(), PHONE, m.end()))
    found.sort()
    return found


def normal(kind: int, text: str) -> str:
    """One spelling for all forms of an identifier."""
    if kind == EMAIL:
        return text.lower()
    return ".".join(p.lstrip("0") or "0" for p in text.split(".")) if kind == IP else _NOT_DIGITS.sub("", text)


def candidates(text: str, taken: list[tuple[int, int, int]]) -> list[tuple[int, int, str, int]]:
    """Other identifier-like spans, none of which meets another or one of `taken`: start, end, normal form, bits of the kinds it could be."""
    found = []
    for m in _AT.finditer(text):
        right = _SPELLED.match(text, m.end())
        start, floor = m.start(), found[-1][1] if found else 0
        while start > floor and text[start - 1] in _LOCAL:
            start -= 1
        if right and start < m.start():
            found.append((start, right.end(), f"{text[start : m.start()]}@{_SIGN.sub('.', right.group())}".lower(), 1 << EMAIL))
    for m in _CHAIN.finditer(text):
        digits, end = m.group(), m.end()
        if end < len(text) and text[end].isalnum():
            # The last group goes on with letters.
            digits = digits.rstrip("0123456789").rstrip(" ./-()")
            end = m.start() + len(digits)
            if not digits:
                continue
        parts = _NOT_DIGITS.split(digits)
        size, bits = sum(map(len, parts)), 0
        quad = len(parts) == 4 and all(map(_small, parts))
        bits |= quad << IP | (13 <= size <= 19) << CARD | (7 <= size <= 15) << PHONE
        found.append((m.start(), end, ".".join(p.lstrip("0") or "0" for p in parts) if quad else "".join(parts), bits))
    found.sort()
    busy = sorted((s, e) for s, _, e in taken)
    out, k, reached = [], 0, 0
    for start, end, norm, bits in found:
        while k < len(busy) and busy[k][0] < end:
            reached = max(reached, busy[k][1])
            k += 1
        if start >= reached:
            out.append((start, end, norm, bits))
            reached = end
    return out


def patterns(text: str, start: int, end: int) -> list[str]:
    """The two words before a span, one on each side, and the two behind it."""
    left = [w.lower() for w in _LEFT.findall(text[max(0, start - REACH) : start])[-2:]]
    right = [w.lower() for w in _RIGHT.findall(text[end : end + REACH])[:2]]
    out = []
    if len(left) == 2:
        out.append(f"{left[0]} {left[1]} *")
    if left and right:
        out.append(f"{left[-1]} * {right[0]}")
    if len(right) == 2:
        out.append(f"* {right[0]} {right[1]}")
    return out


SPAN = "struct<start:int,kind:int,end:int>"
MENTION = "struct<start:int,end:int,kind:int,kinds:int,instance:string,patterns:array<string>>"


def _found(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """row, doc_id, base (sorted spans), mentions (seeds with their kind, candidates with kind -1)."""

    numbers: list[Iterator[int]] = []

    def find(batch: pa.RecordBatch) -> pa.RecordBatch:
        base, mentions = [], []
        for text in batch.column(1).to_pylist():
            text = text or ""
            spans = seeds(text)
            rows = [
                {"start": s, "end": e, "kind": k, "kinds": 1 << k, "instance": normal(k, text[s:e]), "patterns": patterns(text, s, e)}
                for s, k, e in spans
            ]
            if "@" in text or _DIGIT.search(text) or _AT.search(text):
                for s, e, norm, bits in candidates(text, spans):
                    rows.append({"start": s, "end": e, "kind": -1, "kinds": bits, "instance": norm, "patterns": patterns(text, s, e)})
            base.append([{"start": s, "kind": k, "end": e} for s, k, e in spans])
            mentions.append(rows)
        span = pa.struct([("start", pa.int32()), ("kind", pa.int32()), ("end", pa.int32())])
        mention = pa.struct(
            [("start", pa.int32()), ("end", pa.int32()), ("kind", pa.int32()), ("kinds", pa.int32())]
            + [("instance", pa.string()), ("patterns", pa.list_(pa.string()))]
        )
        if not numbers:
            numbers.append(row_ids())
        rows_ = pa.array([next(numbers[0]) for _ in base], pa.int64())
        return pa.record_batch(
            [rows_, batch.column(0), pa.array(base, pa.list_(span)), pa.array(mentions, pa.list_(mention))],
            ["row", "doc_id", "base", "mentions"],
        )

    kind = docs.schema[id_col].dataType.simpleString()
    read = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    return mapped(read, find, f"row long, doc_id {kind}, base array<{SPAN}>, mentions array<{MENTION}>")


def learned(mentions: DataFrame, *, min_seeds: int, min_precision: float, min_score: float, rounds: int) -> tuple[DataFrame, DataFrame]:
    """Scores of (instance, kind), seeds included, and the good patterns of the last round with their kind.

    A pattern is good for a kind when it surrounds `min_seeds` or more different instances of that kind (by the sum
    of their scores) and these are `min_precision` or more of all different instances it surrounds. A
    candidate's score is 1 - the product of (1 - c) over its good patterns, c being positive / (all + 1).
    """
    edges = staged(mentions.select(F.explode("patterns").alias("pattern"), "instance").distinct())
    totals = staged(edges.groupBy("pattern").agg(F.count("*").alias("total")))
    known = mentions.where("kind >= 0").select("instance", "kind").distinct()
    scores = staged(known.withColumn("score", F.lit(UNIT).cast("long")))
    could = mentions.where("kind < 0").select("instance", "kinds").distinct()
    could = could.withColumn("kind", F.explode(F.array(*(F.lit(k) for k in range(len(KINDS))))))
    could = staged(could.where("shiftright(kinds, kind) % 2 = 1").select("instance", "kind").distinct())
    spark, good = mentions.sparkSession, None
    # log(1 - c) in millionths, rounded down, sums exactly in any order.
    cost = F.floor(-F.log1p(-F.col("positive") / (F.lit(UNIT) * (F.col("total") + 1))) * UNIT)
    for _ in range(rounds):
        positive = edges.join(scores, "instance").groupBy("pattern", "kind").agg(F.sum("score").alias("positive"))
        good = staged(
            positive.where(F.col("positive") >= min_seeds * UNIT)
            .join(totals, "pattern")
            .where(F.col("positive") >= F.lit(min_precision) * UNIT * F.col("total"))
            .select("pattern", "kind", cost.alias("cost"))
        )
        evidence = edges.join(good, "pattern").groupBy("instance", "kind").agg(F.sum("cost").alias("cost"))
        more = (
            evidence.join(could, ["instance", "kind"], "left_semi")
            .join(scores, ["instance", "kind"], "left_anti")
            .withColumn("score", F.floor((1 - F.exp(-F.col("cost") / UNIT)) * UNIT))
            .where(F.col("score") >= F.lit(min_score) * UNIT)
            .select("instance", "kind", "score")
        )
        more = staged(more)
        if more.isEmpty():
            break
        scores = staged(scores.unionByName(more))
    return scores, good if good is not None else spark.createDataFrame([], "pattern string, kind int, cost long")


def _joined(spans: str):
    names = "array(" + ", ".join(f"'{k}'" for k in KINDS) + ")"
    return f"array_join(transform({spans}, s -> concat({names}[s.kind], ':', s.start, ':', s.end)), ',')"


def personal_data(
    docs: DataFrame,
    *,
    min_seeds: int = 3,
    min_precision: float = 0.8,
    min_score: float = 0.8,
    rounds: int = 5,
    id_col: str = "doc_id",
    text_col: str = "text",
) -> DataFrame:
    """<id_col>, n_email, n_ip, n_card, n_phone, base_sha256, spans, n_learned: personal identifiers of every row.

    The counts and the hash are of spans of fixed shape; `spans` has these and the learned ones, as
    kind:start:end in code points, by start and kind. Learned spans meet no other span; the kind of the best score
    wins, among equal ones the first. A seed's identifier in another form is a learned span. Bootstrapping ends when a round finds nothing new, after `rounds` at the latest: longer
    chains of inference drift away from the seeds. Null and empty texts have no spans. Repeated rows get
    a result each, but their identifiers count once as instances. An empty table gives no rows; other columns are not read.
    """
    found = staged(_found(docs, id_col, text_col))
    mentions = found.where("size(mentions) > 0").select("row", F.explode("mentions").alias("m")).select("row", "m.*")
    scores, _ = learned(mentions, min_seeds=min_seeds, min_precision=min_precision, min_score=min_score, rounds=rounds)
    scores = scores.withColumnRenamed("kind", "as_kind")
    added = (
        mentions.where("kind < 0 AND kinds > 0")
        .join(scores, "instance")
        .where("shiftright(kinds, as_kind) % 2 = 1")
        .groupBy("row", "start", "end")
        .agg(F.max(F.struct("score", (-F.col("as_kind")).alias("turn"))).alias("best"))
        .select("row", F.struct("start", (-F.col("best.turn")).alias("kind"), "end").alias("span"))
        .groupBy("row")
        .agg(F.collect_list("span").alias("added"))
    )
    none = f"CAST(array() AS array<{SPAN}>)"
    out = found.select("row", "doc_id", "base").join(added, "row", "left")
    counts = {f"n_{k}": F.expr(f"CAST(size(filter(base, s -> s.kind = {n})) AS LONG)") for n, k in enumerate(KINDS)}
    return out.withColumns(
        counts
        | {
            "base_sha256": F.sha2(F.expr(_joined("base")), 256),
            "spans": F.expr(_joined(f"array_sort(concat(base, coalesce(added, {none})))")),
            "n_learned": F.expr(f"CAST(size(coalesce(added, {none})) AS LONG)"),
        }
    ).select(F.col("doc_id").alias(id_col), *counts, "base_sha256", "spans", "n_learned")

"""License detection by ordered signature rules, with DataFrame functions only.

A text that holds none of a few key strings is settled by these. For the others the words
are joined by single blanks, every rule whose keyword stands in them is matched, and of
detections that lie within another of the same or a better tier only the outer one counts;
between equal ones the earlier rule does.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Phrases whose places are counted, and their labels.
BASE = (
    ("gnu general public license", "gpl"),
    ("apache license", "apache"),
    ("cc by", "cc-by"),
    ("mit license", "mit"),
)

# Families: label, SPDX words, keyword of the name, pattern of the name over lower-case words.
FAMILIES = (
    ("apache-2.0", "apache 2 0", "apache", r"apache(?: software)? licen[sc]e(?: version)? 2(?: 0)?"),
    ("apache-1.1", "apache 1 1", "apache", r"apache(?: software)? licen[sc]e(?: version)? 1 1"),
    ("mit", "mit", "mit", r"(?:mit|expat) licen[sc]e"),
    ("mit-0", "mit 0", "mit", r"mit no attribution(?: licen[sc]e)?"),
    ("gpl-1.0", "gpl 1 0", "general public", r"gnu general public licen[sc]e version 1"),
    ("gpl-2.0", "gpl 2 0", "general public", r"gnu general public licen[sc]e version 2"),
    ("gpl-3.0", "gpl 3 0", "general public", r"gnu general public licen[sc]e version 3"),
    ("gpl", "gpl", "gpl", r"gnu gpl(?: ?v ?[123])?"),
    ("lgpl-2.0", "lgpl 2 0", "general public", r"gnu (?:lesser|library) general public licen[sc]e version 2"),
    ("lgpl-2.1", "lgpl 2 1", "general public", r"gnu (?:lesser|library) general public licen[sc]e version 2 1"),
    ("lgpl-3.0", "lgpl 3 0", "general public", r"gnu (?:lesser|library) general public licen[sc]e version 3"),
    ("agpl-3.0", "agpl 3 0", "affero", r"gnu affero general public licen[sc]e(?: version 3)?"),
    ("gfdl-1.3", "gfdl 1 3", "free documentation", r"gnu free documentation licen[sc]e(?: version 1 [123])?"),
    ("bsd-2-clause", "bsd 2 clause", "bsd", r"(?:simplified|freebsd|2 clause|two clause) bsd licen[sc]e"),
    ("bsd-3-clause", "bsd 3 clause", "bsd", r"(?:new|revised|modified|3 clause|three clause) bsd licen[sc]e"),
    ("bsd-4-clause", "bsd 4 clause", "bsd", r"(?:original|4 clause|four clause) bsd licen[sc]e"),
    ("bsd", "0bsd", "bsd", r"bsd(?: style)? licen[sc]e"),
    ("mpl-1.1", "mpl 1 1", "mozilla", r"mozilla public licen[sc]e(?: version)? 1 1"),
    ("mpl-2.0", "mpl 2 0", "mozilla", r"mozilla public licen[sc]e(?: version)? 2(?: 0)?"),
    ("epl-1.0", "epl 1 0", "eclipse", r"eclipse public licen[sc]e(?: version)? 1(?: 0)?"),
    ("epl-2.0", "epl 2 0", "eclipse", r"eclipse public licen[sc]e(?: version)? 2(?: 0)?"),
    ("cddl-1.0", "cddl 1 0", "common development", r"common development and distribution licen[sc]e"),
    ("eupl-1.2", "eupl 1 2", "european union", r"european union public licen[sc]e"),
    ("artistic-2.0", "artistic 2 0", "artistic", r"artistic licen[sc]e(?: version)?(?: [12](?: 0)?)?"),
    ("zlib", "zlib", "zlib", r"zlib(?: libpng)? licen[sc]e"),
    ("isc", "isc", "isc", r"isc licen[sc]e"),
    ("unlicense", "unlicense", "unlicen", r"unlicen[sc]e"),
    ("wtfpl", "wtfpl", "wtfpl", r"wtfpl(?: version 2)?"),
    ("bsl-1.0", "bsl 1 0", "boost", r"boost software licen[sc]e(?: version 1(?: 0)?)?"),
    ("python-2.0", "python 2 0", "python", r"python software foundation licen[sc]e"),
    ("postgresql", "postgresql", "postgresql", r"postgresql licen[sc]e"),
    ("openssl", "openssl", "openssl", r"openssl licen[sc]e"),
    ("ofl-1.1", "ofl 1 1", "open font", r"(?:sil )?open font licen[sc]e(?: version)?(?: 1 1)?"),
    ("odbl-1.0", "odbl 1 0", "open database", r"open database licen[sc]e"),
    ("pddl-1.0", "pddl 1 0", "public domain dedication", r"public domain dedication and licen[sc]e"),
    ("ms-pl", "ms pl", "microsoft", r"microsoft public licen[sc]e"),
    ("ms-rl", "ms rl", "microsoft", r"microsoft reciprocal licen[sc]e"),
    ("cc0-1.0", "cc0 1 0", "cc0", r"cc0(?: 1 0)?(?: universal)?"),
    ("cc-by-sa", "cc by sa 4 0", "cc by sa", r"cc by sa(?: [1234] 0)?"),
    ("cc-by-nc", "cc by nc 4 0", "cc by nc", r"cc by nc(?: [1234] 0)?"),
    ("cc-by-nd", "cc by nd 4 0", "cc by nd", r"cc by nd(?: [1234] 0)?"),
    ("cc-by-nc-sa", "cc by nc sa 4 0", "cc by nc sa", r"cc by nc sa(?: [1234] 0)?"),
    ("cc-by-nc-nd", "cc by nc nd 4 0", "cc by nc nd", r"cc by nc nd(?: [1234] 0)?"),
    ("cc-by", "cc by 4 0", "creative commons", r"creative commons attribution(?: [1234] 0)?(?: international)?"),
    ("cc-by-sa", "cc by sa 3 0", "creative commons", r"creative commons attribution share ?alike(?: [1234] 0)?"),
)

# Verbs of a grant; each family has a rule with each.
GRANTS = ("licensed under", "distributed under", "released under", "available under", "covered by", "subject to")

# Notices that name no license: tier, label, keyword, pattern.
NOTICES = (
    (1, "mit", "hereby granted", r"permission is hereby granted free of charge to any person obtaining a copy"),
    (1, "isc", "permission to use", r"permission to use copy modify and or distribute this software for any purpose"),
    (1, "bsd", "redistribution", r"redistribution and use in source and binary forms with or without modification"),
    (1, "gpl", "free software", r"this (?:program|library|file) is free software you can redistribute it"),
    (1, "apache", "compliance with", r"you may not use this file except in compliance with the licen[sc]e"),
    (1, "unlicense", "public domain", r"free and unencumbered software released into the public domain"),
    (2, "public-domain", "public domain", r"(?:dedicated to|placed in|in|into) the public domain"),
    (3, "copyleft", "share alike", r"share alike"),
    (4, "rights-reserved", "reserved", r"(?:all|some) rights reserved"),
    (4, "copyright", "copyright", r"copyright(?: c)? \d{4}"),
    (4, "license-mention", "licen", r"licen[sc]ed? (?:under|agreement|terms)"),
)

# Surest tier first: the confidence in a text whose best detection is of it.
CONFIDENCE = {1: 1.0, 2: 0.95, 3: 0.85, 4: 0.3}

# A text without any of these has no detection. 'cc' must also stand as a word.
PREFILTER = ("licen", "gpl", "spdx", "copyright", "domain", "reserved", "hereby", "permission", "redistribut",
             "free software", "commons", "alike", "cc0", "wtfpl", "no attribution")

_SEPARATORS = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
_WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def rules() -> list[tuple[int, int, str, str, str]]:
    """(tier, order, label, keyword, pattern) of every rule, from the tables above."""
    out = [(tier, label, key, pattern) for tier, label, key, pattern in NOTICES]
    for label, spdx, key, name in FAMILIES:
        out += [(1, label, verb, rf"{verb}(?: the)?(?: terms of)?(?: the)? {name}") for verb in GRANTS]
        out.append((2, label, "spdx", rf"spdx licen[sc]e identifier {spdx}(?: only| or later)?"))
        out.append((3, label, key, name))
    return [(tier, n, label, key, rf"(?<= ){pattern}(?= )") for n, (tier, label, key, pattern) in enumerate(out)]


def _spaces(text: Column) -> Column:
    return F.length(text) - F.length(F.replace(text, F.lit(" "), F.lit("")))


def _places(words: Column, phrase: str) -> Column:
    """Starts of a phrase's words, counted from 0."""
    parts = phrase.split()

    def here(i: Column) -> Column:
        found = words[i] == parts[0]
        for k, part in enumerate(parts[1:], 1):
            found = found & (words[i + k] == part)
        return found

    last = F.size(words) - len(parts)
    return F.when(last >= 0, F.filter(F.sequence(F.lit(0), last), here)).otherwise(F.array().cast("array<int>"))


def _matches(norm: Column, rule: Column) -> Column:
    """Detections of one rule in words joined by blanks: start, minus end, tier, order, label."""
    found = F.regexp_extract_all(norm, rule["pattern"], F.lit(0))
    gaps = F.split(norm, rule["pattern"], -1)
    kind = "array<struct<start:int,back:int,tier:int,order:int,label:string>>"

    def add(state: Column, i: Column) -> Column:
        start = state["at"] + _spaces(gaps[i])
        end = start + _spaces(found[i]) + 1
        one = F.struct(
            start.alias("start"), (-end).alias("back"), rule["tier"].alias("tier"), rule["order"].alias("order"),
            rule["label"].alias("label"),
        )
        return F.struct((end - 1).alias("at"), F.concat(state["out"], F.array(one)).alias("out"))

    first = F.struct(F.lit(-1).alias("at"), F.array().cast(kind).alias("out"))
    numbers = F.when(F.size(found) > 0, F.sequence(F.lit(0), F.size(found) - 1)).otherwise(F.array().cast("array<int>"))
    return F.aggregate(numbers, first, add, lambda s: s["out"])


def _settled(detections: Column) -> Column:
    """Labels and best tier of the detections that none of the same or a better tier contains."""
    tiers = sorted(CONFIDENCE)
    first = F.struct(
        *[F.lit(-1).alias(f"m{t}") for t in tiers], F.lit(9).alias("best"), F.array().cast("array<string>").alias("labels")
    )

    def add(state: Column, x: Column) -> Column:
        end, reach = -x["back"], F.lit(-1)
        for t in tiers:
            reach = F.greatest(reach, F.when(x["tier"] >= t, state[f"m{t}"]).otherwise(-1))
        kept = reach < end
        return F.struct(
            *[F.when(kept & (x["tier"] == t), F.greatest(state[f"m{t}"], end)).otherwise(state[f"m{t}"]).alias(f"m{t}") for t in tiers],
            F.when(kept, F.least(state["best"], x["tier"])).otherwise(state["best"]).alias("best"),
            F.when(kept, F.array_union(state["labels"], F.array(x["label"]))).otherwise(state["labels"]).alias("labels"),
        )

    return F.aggregate(detections, first, add)


def scan_licenses(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score, detections of every row.

    Words are runs of letters and digits, A-Z lower-cased, all characters beyond ASCII being
    letters. `n_base` counts the places of the base phrases, first_word and last_word are
    their smallest and largest start or null. `labels` joins base labels and those of the
    rules; score is the confidence of the best detection, 0.9 at least with a base phrase,
    0 without any. `detections` lists all matches before containment is settled, in order of
    start. A null text is empty. Rows that repeat are scanned each for itself, other columns
    are not read.
    """
    text = F.coalesce(F.col("text"), F.lit(""))
    low = F.lower(text)
    gate = F.lit(False)
    for key in PREFILTER:
        gate = gate | F.contains(low, F.lit(key))
    lone_cc = F.contains(low, F.lit("cc")) & low.rlike(r"(?<![0-9a-z]|[^\x00-\x7F])cc(?![0-9a-z]|[^\x00-\x7F])")
    norm = F.concat(F.lit(" "), F.trim(F.regexp_replace(low, _SEPARATORS, " ")), F.lit(" "))
    table = F.array(
        *[
            F.struct(
                F.lit(tier).alias("tier"), F.lit(n).alias("order"), F.lit(label).alias("label"),
                F.lit(key).alias("keyword"), F.lit(pattern).alias("pattern"),
            )
            for tier, n, label, key, pattern in rules()
        ]
    )
    step = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")).select(
        "doc_id", F.regexp_count(low, F.lit(_WORD)).cast("long").alias("n_words"), F.when(gate | lone_cc, norm).alias("norm")
    )
    base = [(_places(F.col("words"), phrase), label) for phrase, label in BASE]
    step = step.withColumn("words", F.split(F.trim("norm"), " "))
    step = step.select(
        "doc_id", "n_words", "norm",
        *[F.coalesce(places, F.array().cast("array<int>")).alias(f"p{k}") for k, (places, _) in enumerate(base)],
    )
    gated = F.filter(table, lambda r: F.contains(F.col("norm"), r["keyword"]))
    found = F.array_sort(F.flatten(F.transform(gated, lambda r: _matches(F.col("norm"), r))))
    none = F.array().cast("array<struct<start:int,back:int,tier:int,order:int,label:string>>")
    step = step.withColumn("found", F.when(F.col("norm").isNull(), none).otherwise(found))
    step = step.withColumn("settled", _settled(F.col("found")))
    starts = F.concat(*[F.col(f"p{k}") for k in range(len(base))])
    own = F.array_compact(F.array(*[F.when(F.size(f"p{k}") > 0, F.lit(label)) for k, (_, label) in enumerate(base)]))
    best = F.lit(0.0)
    for tier, sure in CONFIDENCE.items():
        best = F.when(F.col("settled.best") == tier, sure).otherwise(best)
    return step.select(
        "doc_id",
        "n_words",
        F.size(starts).cast("long").alias("n_base"),
        F.array_min(starts).cast("long").alias("first_word"),
        F.array_max(starts).cast("long").alias("last_word"),
        F.array_join(F.array_sort(own), ",").alias("base_labels"),
        F.array_join(F.array_sort(F.array_union(own, F.col("settled.labels"))), ",").alias("labels"),
        F.when(F.size(starts) > 0, F.greatest(best, F.lit(0.9))).otherwise(best).alias("score"),
        F.transform(
            "found",
            lambda x: F.struct(x["start"].alias("start"), (-x["back"]).alias("end"), x["tier"].alias("tier"), x["label"].alias("label")),
        ).alias("detections"),
    )

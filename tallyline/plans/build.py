"""From a folder of match documents to feature tables and a build report."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyline.functions.outcomes import exclusion_reason
from tallyline.functions.scoring import supports_live
from tallyline.functions.text import LIMITED_OVERS, MODES, passes_filters
from tallyline.operators import contests as C
from tallyline.operators.contests import dedupe_contests
from tallyline.operators.live import live_states
from tallyline.operators.participants import batting_innings, bowling_spells, roster_features
from tallyline.operators.quality import check_live, check_prematch
from tallyline.plans.features import prematch_features, team_history
from tallyline.session import staged
from tallyline.sources import documents as D
from tallyline.sources import tables as T

# --- Fixed values -----------------------------------------------------------
NO_DATE = "missing_or_invalid_date"
LIVE_PLANNED = ("TEST", "FIRST_CLASS", "OTHER")
# ----------------------------------------------------------------------------


def build_feature_datasets(
    spark: SparkSession,
    documents: str | DataFrame,
    output: str,
    *,
    formats: Iterable[str] | None = None,
    competitions: Iterable[str] | None = None,
    limit: int | None = None,
    modes: Iterable[str] = MODES,
    include_live: bool = True,
    dedupe: bool = True,
) -> DataFrame:
    """Write prematch features, live states and a report; return the report row.

    Filters and ``limit`` apply before any history is built, so matches left out
    never count for anyone. Without ``include_live`` the live table is not touched.
    """
    docs = D.read_documents(spark, documents) if isinstance(documents, str) else documents
    parsed = staged(D.parse_documents(docs))
    # An undated file is skipped before anything else is looked at.
    dated = parsed.where(F.col("date").isNotNull())
    if limit is not None:
        first = dated.orderBy("date", "match_id", "path").limit(limit).select("path")
        dated = dated.join(first, "path", "left_semi")
    every = D.matches(dated)
    # Filtered first: a copy that passes must not be lost to one that does not.
    keep = passes_filters(F.col("format"), F.col("competition"), formats, competitions)
    passing = every.where(keep)
    chosen = staged(dedupe_contests(passing) if dedupe else passing)
    kept_docs = dated.join(chosen.select("path"), "path", "left_semi")
    innings, balls = D.innings(kept_docs), staged(D.deliveries(kept_docs))
    contests = T.with_first_innings(chosen, innings)
    history = team_history(contests, batting_innings(balls), bowling_spells(balls))
    features = prematch_features(history, modes)
    T.write_features(features, f"{output}/prematch_features")
    prematch = spark.read.schema(features.schema).parquet(f"{output}/prematch_features")
    live = None
    if include_live:
        states = live_states(chosen, innings, balls)
        T.write_live(states, f"{output}/live_states")
        live = spark.read.schema(states.schema).parquet(f"{output}/live_states")
    report = staged(build_report(parsed, dated, every, passing, chosen, prematch, live))
    T.write_report(report, f"{output}/build_report")
    return report


def roster_sides(
    spark: SparkSession, raw: str, cache: str, *, cutoff: str | None = None, formats: tuple[str, ...] | None = ("T20",)
) -> DataFrame:
    """The roster side table of a corpus, stored under the fingerprint of its files and what was asked.

    Once it is there, another call lists the files of the corpus but reads none of them; a changed corpus has another
    fingerprint and gets a table of its own. Parsed tables are shared with all other readers of the corpus.
    """
    asked = f"roster-{'all' if formats is None else '-'.join(sorted(formats))}-{cutoff or 'open'}"
    key = f"{T.fingerprint_key(spark, raw)}-{asked}"

    def build() -> DataFrame:
        tables = T.silver(spark, raw, cache)
        chosen = dedupe_contests(tables["matches"].where(F.col("date").isNotNull()))
        balls = tables["deliveries"].join(chosen.select("match_id"), "match_id", "left_semi")
        prepared = C.prepare(T.with_first_innings(chosen, tables["innings"]))
        return roster_features(
            C.team_rows(prepared), prepared, batting_innings(balls), bowling_spells(balls), cutoff=cutoff, formats=formats
        )

    return T.published(spark, f"{cache}/rosters", key, build)


def counters(chosen: DataFrame) -> DataFrame:
    """Counts by format, by competition and by exclusion reason in one pass."""
    reason = exclusion_reason(
        F.col("date"), F.col("result_type"), F.col("winner"), F.col("team1"), F.col("team2")
    )
    rows = chosen.select("format", "competition", reason.alias("excluded"))
    sets = rows.groupingSets([["format"], ["competition"], ["excluded"]], "format", "competition", "excluded")
    out = sets.agg(F.grouping_id().alias("g"), F.count(F.lit(1)).alias("n"))
    kind = F.when(F.col("g") == 3, "format").when(F.col("g") == 5, "competition").otherwise("excluded")
    return out.select(
        kind.alias("kind"), F.coalesce("format", "competition", "excluded").alias("name"), "n"
    ).where(F.col("name").isNotNull())


def _map_of(df: DataFrame, name: str) -> DataFrame:
    """A (name, n) table as one map cell; its size is that of a fixed label set."""
    return df.agg(
        F.map_from_entries(F.array_sort(F.collect_list(F.struct("name", "n")))).alias(name)
    )


def build_report(parsed, dated, every, passing, chosen, prematch, live) -> DataFrame:
    def count(df: DataFrame, name: str) -> DataFrame:
        return df.agg(F.count(F.lit(1)).alias(name))

    seen = counters(chosen)
    planned = chosen.where(~supports_live(F.col("format")))
    issues = check_prematch(prematch)
    if live is not None:
        issues = issues.unionByName(check_live(live))
    parts = [
        count(parsed, "matches_discovered"),
        count(parsed.where("date is null"), "_undated"),
        count(D.quarantine(dated), "_rejected"),
        count(every, "matches_parsed"),
        count(passing, "_passing"),
        count(chosen, "_chosen"),
        count(planned if live is not None else planned.limit(0), "_planned"),
        count(prematch, "prematch_rows"),
        count(live, "live_state_rows") if live is not None else count(planned.limit(0), "live_state_rows"),
        *[_map_of(seen.where(F.col("kind") == k), n) for k, n in
          (("format", "formats"), ("competition", "competitions"), ("excluded", "excluded_results"))],
        issues.agg(F.collect_list(F.struct("table", "check", "count", "examples")).alias("validation_issues")),
    ]
    row = parts[0]
    for part in parts[1:]:  # one row each
        row = row.crossJoin(F.broadcast(part))
    skipped = F.map_filter(
        F.create_map(
            F.lit(NO_DATE), F.col("_undated"),
            F.lit("parse_error"), F.col("_rejected"),
            F.lit("duplicate_match_id"), F.col("_passing") - F.col("_chosen"),
            F.lit("filtered"), F.col("matches_parsed") - F.col("_passing"),
            F.lit("live_format_planned"), F.col("_planned"),
        ),
        lambda _, n: n > 0,
    )
    return row.select(
        "matches_discovered", "matches_parsed",
        (F.col("matches_discovered") - F.col("_chosen")).alias("matches_skipped"),
        "prematch_rows", "live_state_rows", "formats", "competitions", "excluded_results",
        skipped.alias("skipped"),
        F.array(*[F.lit(f) for f in sorted(LIMITED_OVERS)]).alias("live_formats_supported"),
        F.array(*[F.lit(f) for f in LIVE_PLANNED]).alias("live_formats_planned"),
        "validation_issues",
        F.lit(live is not None).alias("live_generation_enabled"),
        F.current_timestamp().alias("generated_at"),
    )

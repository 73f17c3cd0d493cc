"""The audit of a feature table: five tables and a summary from one read of it."""

from __future__ import annotations

import uuid
from collections.abc import Sequence

from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

from tallyline.operators import audit as A
from tallyline.operators.frames import pair_rows
from tallyline.session import ensure_checkpoint_dir
from tallyline.sources.tables import write_csv, write_report

# --- Fixed values -----------------------------------------------------------
TABLES = (
    "competition_coverage", "team_cold_start", "prematch_feature_signal", "posttoss_feature_signal",
    "unused_feature_availability",
)
NOTES = (
    "Orientation-free AUC near 0.50 means weak standalone discrimination.",
    "Large validation-to-test AUC drops indicate feature instability or season shift.",
    "Coverage metrics are side-row percentages, not match percentages.",
)
# ----------------------------------------------------------------------------


def audit_features(
    features: DataFrame,
    output: str,
    *,
    start: str,
    valid: tuple[str, str],
    sources: Sequence[str],
    candidates: Sequence[str] = (),
    min_matches: int = 20,
    min_team_matches: int = 5,
    format_: str = "T20",
) -> DataFrame:
    """Write the audit of one format below ``output`` and return its one-row summary.

    Five folders of CSV, named as in ``TABLES``, and ``summary`` as JSON. ``features`` is read once: while its rows of the
    format are stored, what the summary counts of them is observed; all tables are made from the stored rows, and
    their sizes are observed while they are written. ``start`` begins the test period, ``valid`` is the validation
    period, ``sources`` are the side columns whose differences are rated, ``candidates`` columns that no model uses. A
    format without rows gives empty tables.
    """
    test = (F.col("prediction_mode") == "PRE_TOSS") & (F.col("date") >= F.lit(start).cast("date"))
    home = F.col("home_away").isNotNull() if "home_away" in features.columns else F.lit(False)
    seen = Observation()
    path = f"{ensure_checkpoint_dir(features.sparkSession)}/audit-{uuid.uuid4().hex}"
    chosen = features.where(F.col("format") == format_).observe(
        seen, F.count(F.lit(1)).alias("rows"), F.count_if(test).alias("test_rows"), F.count_if(test & home).alias("home_rows")
    )
    chosen.write.parquet(path)
    rows = features.sparkSession.read.schema(features.schema).parquet(path)
    diffs = [f"{s}_diff" for s in sources]
    pre_rows = rows.where(F.col("prediction_mode") == "PRE_TOSS")
    tables = {
        "competition_coverage": A.competition_coverage(rows, start, min_matches, None),
        "team_cold_start": A.team_cold_start(rows, start, min_team_matches, None),
        "prematch_feature_signal": A.feature_signal(pair_rows(rows, "PRE_TOSS", sources), diffs, valid, start),
        "posttoss_feature_signal": A.feature_signal(pair_rows(rows, "POST_TOSS", sources), diffs, valid, start),
        "unused_feature_availability": A.availability(pre_rows, candidates) if candidates else None,
    }
    sizes = {}
    for name, table in tables.items():
        if table is not None:
            sizes[name] = Observation()
            write_csv(table.observe(sizes[name], F.count(F.lit(1)).alias("n")), f"{output}/{name}")
    share = seen.get["home_rows"] / seen.get["test_rows"] if seen.get["test_rows"] and "home_away" in features.columns else None
    summary = rows.where(test).select("match_id").distinct().agg(F.count(F.lit(1)).alias("test_matches")).select(
        F.lit(format_).alias("format"),
        F.lit(start).alias("test_start"),
        F.lit(seen.get["rows"]).alias("rows"),
        "test_matches",
        F.lit(sizes["competition_coverage"].get["n"]).cast("long").alias("competition_rows"),
        F.lit(sizes["team_cold_start"].get["n"]).cast("long").alias("teams_audited"),
        F.lit(share).cast("double").alias("home_away_non_null_pct"),
        F.array(*[F.lit(n) for n in NOTES]).alias("notes"),
    )
    write_report(summary, f"{output}/summary")
    return features.sparkSession.read.schema(summary.schema).json(f"{output}/summary")

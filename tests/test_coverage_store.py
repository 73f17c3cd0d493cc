"""What the coverage of competitions keeps on disk."""

import datetime as dt
import time

from pyspark.sql import functions as F

from tallyline.operators import audit
from tallyline.session import DROP_SHUFFLES, staged

COLUMNS = (
    "match_id long, date date, format string, competition string, team string, prediction_mode string, home_away string, "
    "matches_before long, h2h_matches_before long, team_matches_at_venue long, lineup_status string, "
    "xi_mean_batting_average double, xi_mean_bowling_economy double, xi_batters_with_history long, "
    "xi_bowlers_with_history long, long_text string"
)


def test_only_rows_and_columns_asked_about_are_stored(spark, monkeypatch):
    rows = []
    for i in range(12):
        for team in "AB":
            for mode in ("PRE_TOSS", "POST_TOSS"):
                rows.append((i, dt.date(2024, 1, 1 + i), "T20" if i % 2 else "ODI", "x" if i % 3 else None, team, mode, None,
                             i, i, 0, "LINEUP_KNOWN" if i > 5 else "LINEUP_UNKNOWN", 1.0 * i, None, i, 0, "y" * 50))
    stored = []
    monkeypatch.setattr(audit, "staged", lambda df: stored.append(df) or staged(df))
    out = {r.competition: r for r in audit.competition_coverage(spark.createDataFrame(rows, COLUMNS), "2024-01-04", 1).collect()}
    assert len(stored) == 1 and "long_text" not in stored[0].columns and stored[0].count() == 5 * 4
    assert {k: (r.matches, r.teams, r.posttoss_matches_available) for k, r in out.items()} == {"x": (3, 2, 3), "(none)": (2, 2, 2)}
    assert out["x"].median_matches_before_per_side == 7.0 and out["(none)"].median_matches_before_per_side == 6.0
    assert out["x"].pct_side_rows_lt_10_prior_matches == 2 / 3 and out["x"].pct_posttoss_side_rows_lineup_known == 2 / 3
    assert out["x"].pct_xi_bowling_economy_missing == 1.0 and out["(none)"].median_xi_batters_with_history == 6.0


def _shuffles(spark):
    files = spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllFiles()
    return {x.rsplit("/", 1)[1] for x in files.mkString("\n").split("\n") if "/shuffle_" in x}


def test_a_stored_table_leaves_no_shuffle_files(spark):
    before, conf = _shuffles(spark), spark.conf.get(DROP_SHUFFLES, None)
    table = staged(spark.range(1000).groupBy((F.col("id") % 7).alias("k")).agg(F.count(F.lit(1)).alias("n")))
    for _ in range(50):
        if not (left := _shuffles(spark) - before):
            break
        time.sleep(0.1)
    assert not left and spark.conf.get(DROP_SHUFFLES, None) == conf
    assert {r.k: r.n for r in table.collect()} == {k: 143 if k < 6 else 142 for k in range(7)}

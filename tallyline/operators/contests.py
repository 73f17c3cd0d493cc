"""Contests, their two team rows, and team history (form, meetings, venue).

A contest table has ``match_id date format gender venue team1 team2 winner
result_type`` and, where known, ``batting_first first_total team1_players
team2_players``. Rows with ``is_request`` set are asked about, not played: they
read the history before their date and add nothing to it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallyline.functions.outcomes import is_draw
from tallyline.functions.scoring import rate
from tallyline.functions.text import canonical_team
from tallyline.operators.history import running

FORM_WINDOWS = (5, 10, 20)
RECENT_MEETINGS = 5
POOL = ["format", "sex"]
ORDER = ["date", "kind", "match_id"]


def dedupe_contests(contests: DataFrame, path: str = "path") -> DataFrame:
    """Keep the first copy (smallest path) of each match id."""
    first = contests.groupBy("match_id").agg(F.min(path).alias(path))
    return contests.join(first, ["match_id", path], "left_semi")


def prepare(contests: DataFrame, as_of: str = "sequence") -> DataFrame:
    """Normalise names and results, drop undated rows, set the history order.

    ``as_of='sequence'``: a contest sees earlier ids of its own day.
    ``as_of='date'``: it sees only earlier days. Each contest then becomes two
    rows, one that asks (kind 0) and one that counts (kind 1).
    """
    names = set(contests.columns)

    def optional(name: str, kind: str) -> Column:
        return F.col(name) if name in names else F.lit(None).cast(kind)

    asked = F.coalesce(optional("is_request", "boolean"), F.lit(False))
    staged = contests.where(F.col("date").isNotNull()).select(
        *contests.columns,
        *[
            optional(n, k).alias(n)
            for n, k in (("batting_first", "string"), ("first_total", "double"))
            if n not in names
        ],
        F.coalesce("gender", F.lit("")).alias("sex"),
        canonical_team("team1").alias("side1"),
        canonical_team("team2").alias("side2"),
        canonical_team("winner").alias("won_by"),
        F.when(F.col("venue") != "", F.trim("venue")).alias("place"),
        asked.alias("asked"),
    )
    decisive = (F.col("won_by") == F.col("side1")) | (F.col("won_by") == F.col("side2"))
    staged = staged.select(
        "*",
        (decisive & ~F.col("asked")).alias("decisive"),
        ((decisive | is_draw(F.col("result_type"))) & ~F.col("asked")).alias("played"),
        canonical_team("batting_first").alias("first_side"),
    )
    if as_of == "sequence":
        return staged.withColumn("kind", F.when(F.col("asked"), 0).otherwise(1)).withColumn(
            "asks", F.lit(True)
        )
    if as_of != "date":
        raise ValueError("as_of must be 'sequence' or 'date'")
    kinds = F.when(F.col("asked"), F.array(F.lit(0))).otherwise(F.array(F.lit(0), F.lit(1)))
    staged = staged.withColumn("kind", F.explode(kinds)).withColumn("asks", F.col("kind") == 0)
    return staged.withColumns(
        {n: F.col(n) & (F.col("kind") == 1) for n in ("decisive", "played")}
    )


def team_rows(prepared: DataFrame) -> DataFrame:
    """Two rows per contest, one from each side's point of view, in one scan."""
    names = set(prepared.columns)
    lists = [
        F.col(n) if n in names else F.lit(None).cast("array<string>")
        for n in ("team1_players", "team2_players")
    ]

    def side(number, team, opponent, raw_team, raw_opponent, xi):
        return F.struct(
            F.lit(number).alias("side"),
            F.col(team).alias("team"),
            F.col(opponent).alias("opponent"),
            F.col(raw_team).alias("raw_team_name"),
            F.col(raw_opponent).alias("raw_opponent_name"),
            F.when(F.size(xi) > 0, xi).alias("xi"),
        )

    both = F.array(
        side(1, "side1", "side2", "team1", "team2", lists[0]),
        side(2, "side2", "side1", "team2", "team1", lists[1]),
    )
    drop = [n for n in ("team1_players", "team2_players") if n in names]
    rows = prepared.withColumn("_side", F.explode(both)).drop(*drop)
    rows = rows.select("*", "_side.*").drop("_side")
    return rows.withColumn("won", (F.col("team") == F.col("won_by")).cast("int"))


def team_form(log: DataFrame, max_rows: int | None = None) -> DataFrame:
    """Matches, wins and rates before the contest, overall and over the last 5/10/20."""
    out = running(
        log,
        [*POOL, "team"],
        ORDER,
        totals={"matches_before": F.lit(1), "wins_before": F.col("won")},
        recent={f"wins_last_{n}": (F.col("won"), n) for n in FORM_WINDOWS},
        counts=F.col("played"),
        max_rows=max_rows,
    )
    derived = {"win_rate_before": rate(F.col("wins_before"), F.col("matches_before"))}
    for n in FORM_WINDOWS:
        held = F.least(F.col("matches_before"), F.lit(n))
        derived[f"matches_last_{n}"] = held
        derived[f"win_rate_last_{n}"] = rate(F.col(f"wins_last_{n}"), held)
    return out.withColumns(derived)


def head_to_head(log: DataFrame, max_rows: int | None = None) -> DataFrame:
    """Earlier decisive meetings of the two sides."""
    out = running(
        log,
        [*POOL, "team", "opponent"],
        ORDER,
        totals={"h2h_matches_before": F.lit(1), "h2h_team_wins": F.col("won")},
        recent={"_recent_wins": (F.col("won"), RECENT_MEETINGS)},
        counts=F.col("decisive"),
        max_rows=max_rows,
    )
    met = F.col("h2h_matches_before")
    recent = F.least(met, F.lit(RECENT_MEETINGS))
    return out.withColumns(
        {
            "h2h_opponent_wins": met - F.col("h2h_team_wins"),
            "h2h_team_win_rate": rate(F.col("h2h_team_wins"), met),
            "h2h_last_5_matches": recent,
            "h2h_last_5_win_rate": rate(F.col("_recent_wins"), recent),
        }
    ).drop("_recent_wins")


def _has_winner() -> Column:
    return F.col("played") & (F.col("won_by") != "")


def team_at_venue(log: DataFrame, max_rows: int | None = None) -> DataFrame:
    """The side's earlier results at the venue; zeros where the venue is unknown."""
    keyed = log.withColumn("_place", F.coalesce("place", F.lit("")))
    out = running(
        keyed,
        [*POOL, "team", "_place"],
        ORDER,
        totals={"team_matches_at_venue": F.lit(1), "team_wins_at_venue": F.col("won")},
        counts=_has_winner() & F.col("place").isNotNull(),
        max_rows=max_rows,
    )
    return out.withColumn(
        "team_win_rate_at_venue",
        rate(F.col("team_wins_at_venue"), F.col("team_matches_at_venue")),
    ).drop("_place")


def opponent_at_venue(rows: DataFrame) -> DataFrame:
    """The other side's venue columns; a contest has exactly two rows here."""
    pair = Window.partitionBy("match_id")

    def other(name: str) -> Column:
        return F.sum(name).over(pair) - F.col(name)

    out = rows.select(
        "*",
        other("team_matches_at_venue").alias("opponent_matches_at_venue"),
        other("team_wins_at_venue").alias("opponent_wins_at_venue"),
    )
    return out.withColumn(
        "opponent_win_rate_at_venue",
        rate(F.col("opponent_wins_at_venue"), F.col("opponent_matches_at_venue")),
    )


def venue_record(prepared: DataFrame, max_rows: int | None = None) -> DataFrame:
    """Per contest: how batting first fared at the venue and its mean first total."""
    decided = _has_winner() & F.col("place").isNotNull()
    known_first = decided & (F.col("first_side") != "")
    first_won = F.col("first_side") == F.col("won_by")
    counted = (F.col("kind") == 1) & ~F.col("asked") & F.col("place").isNotNull()
    total = F.when(counted, F.col("first_total"))
    narrow = prepared.select(
        *POOL,
        *ORDER,
        "asks",
        F.coalesce("place", F.lit("")).alias("_place"),
        decided.cast("int").alias("_decided"),
        (known_first & first_won).cast("int").alias("_first_won"),
        (known_first & ~first_won).cast("int").alias("_chase_won"),
        total.alias("_total"),
        total.isNotNull().cast("int").alias("_has_total"),
    )
    out = running(
        narrow,
        [*POOL, "_place"],
        ORDER,
        totals={
            "venue_decided_matches": F.col("_decided"),
            "_first": F.col("_first_won"),
            "_chase": F.col("_chase_won"),
            "_sum": F.col("_total"),
            "historical_first_innings_matches": F.col("_has_total"),
        },
        max_rows=max_rows,
    )
    decided_before = F.col("venue_decided_matches")
    return out.where("asks").select(
        "match_id",
        rate(F.col("_first"), decided_before).alias("venue_batting_first_win_rate"),
        rate(F.col("_chase"), decided_before).alias("venue_chasing_win_rate"),
        "venue_decided_matches",
        rate(F.col("_sum"), F.col("historical_first_innings_matches")).alias(
            "historical_first_innings_average"
        ),
        "historical_first_innings_matches",
    )

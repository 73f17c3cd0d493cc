"""Participant form and lineup strength before each contest.

Batting innings and bowling spells are events, members of a lineup are probes.
Both go into one log keyed by (format, player); a probe reads the state before
it, so a member who neither bats nor bowls in the contest is served as well.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallyline.functions.outcomes import credited_to_bowler
from tallyline.functions.scoring import log_rest_days, overlap_ratio, rate
from tallyline.operators.contests import ORDER, POOL
from tallyline.operators.history import running
from tallyline.operators.sizing import MAX_ROWS_PER_KEY, UNSPLIT, hot_keys, key_limit, long_side, with_chunk
from tallyline.session import staged

RECENT = 5
# Rows of the log of events and probes that a task takes, about.
TASK_ROWS = 500_000
BATTING_CORE, BOWLING_CORE = 7, 5
KEY = ["format", "player"]
MOMENT = ["date", "day_part", "match_id", "is_event", "part", "innings", "first_seq"]

MEANS = ("mean_batting_average", "mean_recent_runs", "mean_bowling_economy", "mean_recent_wickets")
CORES = (
    "core_batting_recent_runs",
    "core_batting_recent_strike_rate",
    "core_bowling_recent_wickets",
    "core_bowling_recent_economy",
)


def batting_innings(deliveries: DataFrame) -> DataFrame:
    """Runs, balls faced (wides excluded) and dismissal per contest, innings and striker."""
    out = F.col("wicket") & (F.col("player_out") == F.col("striker"))
    return (
        deliveries.where(F.col("striker") != "")
        .groupBy("match_id", "innings", F.col("striker").alias("player"))
        .agg(
            F.sum("runs_batter").alias("runs"),
            F.count_if(~F.col("is_wide")).alias("balls"),
            F.coalesce(F.bool_or(out), F.lit(False)).alias("out"),
            F.min("seq").alias("first_seq"),
        )
    )


def bowling_spells(deliveries: DataFrame) -> DataFrame:
    """Balls, runs conceded and credited wickets per contest, innings and bowler."""
    legal = ~F.col("is_wide") & ~F.col("is_noball")
    return (
        deliveries.where(F.col("bowler") != "")
        .groupBy("match_id", "innings", F.col("bowler").alias("player"))
        .agg(
            F.count_if(legal).alias("balls"),
            F.sum("runs_total").alias("runs"),
            F.count_if(credited_to_bowler(F.col("wicket"), F.col("wicket_type"))).alias("wickets"),
            F.min("seq").alias("first_seq"),
        )
    )


def _events(contests: DataFrame, batting: DataFrame, bowling: DataFrame) -> DataFrame:
    def common(part: int):
        return [
            "match_id",
            F.lit(part).alias("part"),
            F.col("innings").cast("int").alias("innings"),
            F.col("first_seq").cast("long").alias("first_seq"),
            "player",
            F.col("runs").cast("double").alias("runs"),
            F.col("balls").cast("double").alias("balls"),
        ]

    bat = batting.select(*common(0), F.col("out").cast("int").alias("outs"), F.lit(0).alias("wickets"))
    bowl = bowling.select(*common(1), F.lit(0).alias("outs"), F.col("wickets").cast("int").alias("wickets"))
    when = contests.where(~F.col("asked") & (F.col("kind") == 1)).select("match_id", "format", "date")
    return bat.unionByName(bowl).join(long_side(when), "match_id").select(
        *KEY, "date", F.lit(1).alias("day_part"), "match_id", F.lit(1).alias("is_event"),
        "part", "innings", "first_seq", "runs", "balls", "outs", "wickets",
    )


def _player_rows(batting: DataFrame, bowling: DataFrame, members: DataFrame) -> tuple[int, int]:
    """Rows of the whole log and of its busiest player, who has no fewer than any key: a key is a player's rows of one format.

    Counted before the events meet their contests. Where match ids repeat, a key may hold more rows than
    were counted here; its window is as right, only longer.
    """
    rows = batting.select("player").unionByName(bowling.select("player")).unionByName(members.select("player"))
    counts = rows.groupBy("player").agg(F.count(F.lit(1)).alias("_n"))
    found = counts.agg(F.sum("_n").alias("all"), F.max("_n").alias("most")).first()
    return found["all"] or 0, found["most"] or 0


def _latest_records(log: DataFrame, within: dict) -> DataFrame:
    """Events and probes with the newest record of each kind before them (structs ``bat`` and ``bowl``).

    The log is dealt by player, or cut; that serves both windows, since both keys extend its key.
    """
    log = log.withColumn("_kind", F.when(F.col("is_event") == 1, F.col("part")).otherwise(2))
    # The record after each event, per kind, over plain row frames ...
    values = {n: F.col(n) for n in ("runs", "balls", "outs", "wickets")}
    recorded = running(
        log, [*KEY, "_kind"], MOMENT,
        totals={"n": F.lit(1), **{f"all_{n}": c for n, c in values.items()}},
        recent={f"last_{n}": (values[n], RECENT) for n in ("runs", "balls", "wickets")},
        include_current=True, **within,
    )
    record = F.struct("n", *[f"all_{n}" for n in values], "last_runs", "last_balls", "last_wickets")
    pieces = ("_hot", "_chunk") if within.get("cut") else ()
    recorded = recorded.select(
        *dict.fromkeys([*KEY, *MOMENT]), "side", "role", "pos", *pieces,
        F.when(F.col("_kind") == 0, record).alias("_bat"), F.when(F.col("_kind") == 1, record).alias("_bowl"),
    )
    if pieces:  # read by the carry and by the window
        recorded = staged(recorded)
    # ... and then the newest record of each kind before every row.
    out = running(recorded, KEY, MOMENT, latest={"bat": F.col("_bat"), "bowl": F.col("_bowl")}, **within)
    return out.drop(*pieces)


def player_state(
    prepared: DataFrame,
    batting: DataFrame,
    bowling: DataFrame,
    members: DataFrame,
    max_rows: int | None = None,
) -> DataFrame:
    """Form of every listed member just before its contest.

    ``members``: ``match_id format date asked side role pos player``. Returns the
    same rows with the player's batting and bowling record; requests see only
    earlier days, contests also see earlier ids of their day.
    """
    events = _events(prepared, batting, bowling)
    probes = members.select(
        *KEY, "date", F.when(F.col("asked"), 0).otherwise(1).alias("day_part"), "match_id",
        F.lit(0).alias("is_event"), "side", "role", "pos",
    )
    # Probes of several lists of one contest share a moment; their own columns make the
    # order total without changing what they see.
    log = events.unionByName(probes, allowMissingColumns=True).withColumns(
        {
            "part": F.coalesce("part", F.col("side")),
            "innings": F.coalesce("innings", F.col("role")),
            "first_seq": F.coalesce("first_seq", F.col("pos").cast("long")),
        }
    )
    total, most = _player_rows(batting, bowling, members)
    fits = max_rows == UNSPLIT or most <= (max_rows or MAX_ROWS_PER_KEY)
    found = None if fits else hot_keys(log, KEY, max_rows)
    # A task sorts its rows twice; so many tasks that this takes the same memory however long the log is.
    tasks = max(-(-total // TASK_ROWS), log.sparkSession.sparkContext.defaultParallelism)
    if found is None:
        log = _latest_records(log.repartition(tasks, *KEY), {"max_rows": UNSPLIT})
    else:
        hot, rows = found
        # Only what is too long is cut; a key with a null in it is not.
        cut = with_chunk(log.join(hot, KEY, "left_semi"), KEY, MOMENT, hot, rows, max_rows)
        whole = log.join(hot, KEY, "left_anti").repartition(tasks, *KEY)
        log = _latest_records(whole, {"max_rows": UNSPLIT}).unionByName(_latest_records(cut, {"cut": True}))

    def zero(value: Column) -> Column:
        return F.coalesce(value, F.lit(0))

    bat, bowl = F.col("bat"), F.col("bowl")
    return log.where(F.col("is_event") == 0).select(
        "match_id", "side", "role", "pos", *KEY,
        zero(bat["n"]).alias("bat_innings"), zero(bat["all_runs"]).alias("bat_runs"),
        zero(bat["all_balls"]).alias("bat_balls"),
        rate(bat["all_runs"], bat["all_outs"]).alias("batting_average"),
        (rate(bat["all_runs"], bat["all_balls"]) * 100).alias("strike_rate"),
        bat["last_runs"].alias("recent_runs"),
        (rate(bat["last_runs"], bat["last_balls"]) * 100).alias("recent_strike_rate"),
        zero(bowl["all_balls"]).alias("bowl_balls"), zero(bowl["all_runs"]).alias("bowl_runs"),
        zero(bowl["all_wickets"]).alias("bowl_wickets"),
        rate(bowl["all_runs"], bowl["all_balls"] / 6).alias("bowling_economy"),
        bowl["last_wickets"].alias("recent_wickets"),
        rate(bowl["last_runs"], bowl["last_balls"] / 6).alias("recent_economy"),
    )


def lineup_members(rows: DataFrame, xi: Column, role: int = 0) -> DataFrame:
    """One probe row per listed player of a team row."""
    return rows.select(
        "match_id", "format", "date", "asked", "side", F.lit(role).alias("role"),
        F.posexplode(xi).alias("pos", "player"),
    )


def lineup_snapshot(state: DataFrame) -> DataFrame:
    """Means over a lineup's members, one row per contest side with a known lineup."""
    return state.groupBy("match_id", "side").agg(
        F.count("batting_average").alias("xi_batters_with_history"),
        F.avg("batting_average").alias("xi_mean_batting_average"),
        F.avg("recent_runs").alias("xi_mean_recent_runs"),
        F.count("bowling_economy").alias("xi_bowlers_with_history"),
        F.avg("bowling_economy").alias("xi_mean_bowling_economy"),
        F.avg("recent_wickets").alias("xi_mean_recent_wickets"),
    )


def lineup_strength(state: DataFrame) -> DataFrame:
    """Means over the list and over its core, one row per contest side and role."""
    group = Window.partitionBy("match_id", "side", "role")
    by_batting = group.orderBy(F.col("bat_innings").desc(), "pos")
    by_bowling = group.orderBy(F.col("bowl_balls").desc(), "pos")
    ranked = state.select(
        "*",
        ((F.row_number().over(by_batting) <= BATTING_CORE) & (F.col("bat_innings") > 0)).alias("_bat"),
        ((F.row_number().over(by_bowling) <= BOWLING_CORE) & (F.col("bowl_balls") > 0)).alias("_bowl"),
    )

    def mean_of(flag: str, value: str) -> Column:
        return F.avg(F.when(F.col(flag), F.col(value)))

    return ranked.groupBy("match_id", "side", "role").agg(
        F.avg("batting_average").alias("mean_batting_average"),
        F.avg("recent_runs").alias("mean_recent_runs"),
        F.avg("bowling_economy").alias("mean_bowling_economy"),
        F.avg("recent_wickets").alias("mean_recent_wickets"),
        mean_of("_bat", "recent_runs").alias("core_batting_recent_runs"),
        mean_of("_bat", "recent_strike_rate").alias("core_batting_recent_strike_rate"),
        mean_of("_bowl", "recent_wickets").alias("core_bowling_recent_wickets"),
        mean_of("_bowl", "recent_economy").alias("core_bowling_recent_economy"),
    )


def previous_lineups(rows: DataFrame, max_rows: int | None = None) -> DataFrame:
    """The last two known lineups and the days since the last contest of each team row."""
    key = [*POOL, "team"]
    event = (F.col("kind") == 1) & ~F.col("asked")
    max_rows = key_limit(rows, key, max_rows)
    out = running(
        rows, key, ORDER,
        latest={"previous_xi": F.col("xi"), "_last_date": F.col("date")},
        counts=event, max_rows=max_rows,
    )
    known = F.when(F.col("xi").isNotNull(), F.struct(F.col("previous_xi").alias("xi")))
    out = running(out, key, ORDER, latest={"_two_back": known}, counts=event, max_rows=max_rows)
    return out.withColumns(
        {
            "previous_previous_xi": F.col("_two_back.xi"),
            "rest_days": F.datediff("date", "_last_date"),
        }
    ).drop("_two_back", "_last_date")


CURRENT, PREVIOUS = 0, 1


def roster_features(
    rows: DataFrame,
    prepared: DataFrame,
    batting: DataFrame,
    bowling: DataFrame,
    *,
    cutoff: str | None = None,
    formats: tuple[str, ...] | None = ("T20",),
    max_rows: int | None = None,
) -> DataFrame:
    """Roster side table: current and previous lineup strength, stability, rest.

    The previous lineup is rated at the time of *this* contest, so its members
    are probed again here. Filters apply before any history is built.
    """
    keep = F.lit(True)
    if formats is not None:
        keep = keep & F.col("format").isin(*formats)
    if cutoff is not None:
        keep = keep & (F.col("date") <= F.lit(cutoff).cast("date"))
    rows, prepared = rows.where(keep), prepared.where(keep)
    rows = previous_lineups(rows, max_rows)
    lists = F.array(
        F.struct(F.lit(CURRENT).alias("role"), F.col("xi").alias("list")),
        F.struct(F.lit(PREVIOUS).alias("role"), F.col("previous_xi").alias("list")),
    )
    members = (
        rows.where("asks")
        .select("match_id", "format", "date", "asked", "side", F.explode(lists).alias("_l"))
        .select(
            "match_id", "format", "date", "asked", "side", F.col("_l.role").alias("role"),
            F.posexplode("_l.list").alias("pos", "player"),
        )
    )
    strength = lineup_strength(
        player_state(prepared, batting, bowling, members, max_rows)
    )
    names = (*MEANS, *CORES)
    by_side = strength.groupBy("match_id", "side").agg(
        *[
            F.max(F.when(F.col("role") == role, F.col(n))).alias(f"{label}_xi_{n}")
            for role, label in ((PREVIOUS, "previous"), (CURRENT, "current"))
            for n in names
        ]
    )
    return rows.where("asks").join(by_side, ["match_id", "side"], "left").select(
        "match_id", "date", "format", "side", "team",
        F.col("previous_xi").isNotNull().cast("int").alias("previous_xi_known"),
        F.col("xi").isNotNull().cast("int").alias("current_xi_known"),
        overlap_ratio(F.col("previous_xi"), F.col("previous_previous_xi")).alias("previous_roster_stability"),
        overlap_ratio(F.col("xi"), F.col("previous_xi")).alias("current_previous_xi_overlap"),
        "rest_days",
        log_rest_days(F.col("rest_days")).alias("log_rest_days"),
        *[f"previous_xi_{n}" for n in names],
        *[f"current_xi_{n}" for n in names],
    )

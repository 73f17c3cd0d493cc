"""Ratings before each contest: the one history that is a true recurrence.

Every update moves two teams at once, so no window can express it. Each pool is
a fold over time-ordered rows that keeps one rating per team and streams through
Arrow batches: memory grows with teams, never with contests.

A pool with more contests than one task should walk is first taken apart into the
connected components of who played whom: no rating ever crosses from one to another, so
each is a fold of its own, with the very numbers of one walk. Only a component that is still
too big is cut by time into slices
that run side by side. A slice needs the ratings at its start; those are guessed,
all slices run, and each slice's end becomes the next slice's start; slices whose
start moved run again, until none does. There are at most ``MAX_SLICES`` of them. Slice k is exact after k rounds at the
latest, so this ends with the sequential answer.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallyline.operators.graph import components
from tallyline.operators.sizing import MAX_ROWS_PER_KEY, UNSPLIT, hot_keys, long_side, with_chunk
from tallyline.session import pin, staged

# --- Fixed values -----------------------------------------------------------
INITIAL = 1500.0
K_FACTOR = 20.0
# ----------------------------------------------------------------------------

POOL = ["format", "sex"]
# What one walk covers: a pool, or one component of a pool that is too big for a task.
WALK = [*POOL, "_league"]
ORDER = ["date", "kind", "match_id"]
SEED, CONTEST = 0, 1
# Slices in all, however many rows there are: every slice that starts from moved ratings is one more
# walk, and a longer slice forgets its start before it ends, so few long ones settle in few rounds.
MAX_SLICES = 128
# Slices run again until no rating at their start moves by more: at 0 they end with
# the very numbers of one walk over all contests.
TOLERANCE = 0.0


def contest_scores(prepared: DataFrame) -> DataFrame:
    """Narrow rating input: 1 / 0 for a decisive result, 0.5 for a draw, else NULL."""
    side1 = F.col("won_by") == F.col("side1")
    score = F.when(F.col("decisive"), F.when(side1, 1.0).otherwise(0.0)).when(F.col("played"), 0.5)
    return prepared.select(
        *POOL, "date", "kind", "match_id", "asks", "side1", "side2", score.alias("score")
    )


def _fold(emit_contests: bool, k: float, initial: float):
    """Walk (pool, slice)-sorted rows, keeping one rating per team."""

    def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ratings: dict[str, float] = {}
        seeded: dict[str, float] = {}
        current = None

        def closing(key):
            teams = sorted(ratings)
            return pa.RecordBatch.from_pydict(
                {
                    "format": pa.array([key[0]] * len(teams), pa.string()),
                    "sex": pa.array([key[1]] * len(teams), pa.string()),
                    "_league": pa.array([key[2]] * len(teams), pa.string()),
                    "_chunk": pa.array([key[3]] * len(teams), pa.int64()),
                    "team": pa.array(teams, pa.string()),
                    "rating": pa.array([ratings[t] for t in teams], pa.float64()),
                    "_start": pa.array([seeded.get(t) for t in teams], pa.float64()),
                }
            )

        for batch in batches:
            get = {n: batch.column(i).to_pylist() for i, n in enumerate(batch.schema.names)}
            before1, before2, keep = [], [], []
            for i, key in enumerate(zip(get["format"], get["sex"], get["_league"], get["_chunk"])):
                if key != current:
                    if current is not None and not emit_contests and ratings:
                        yield closing(current)
                    current, ratings, seeded = key, {}, {}
                team1, team2 = get["side1"][i], get["side2"][i]
                if get["_row"][i] == SEED:
                    ratings[team1] = seeded[team1] = get["score"][i]
                    continue
                r1, r2 = ratings.get(team1, initial), ratings.get(team2, initial)
                if emit_contests and get["asks"][i]:
                    keep.append(i)
                    before1.append(r1)
                    before2.append(r2)
                score = get["score"][i]
                if score is not None:
                    gain = k * (score - 1.0 / (1.0 + 10.0 ** ((r2 - r1) / 400.0)))
                    ratings[team1], ratings[team2] = r1 + gain, r2 - gain
            if emit_contests:
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column(batch.schema.get_field_index("match_id")).take(
                            pa.array(keep, pa.int64())
                        ),
                        pa.array(before1, pa.float64()),
                        pa.array(before2, pa.float64()),
                    ],
                    names=["match_id", "elo1", "elo2"],
                )
        if not emit_contests and current is not None and ratings:
            yield closing(current)

    return walk


_STATE = "format string, sex string, _league string, _chunk long, team string, rating double, _start double"


def _as_seed(state: DataFrame, like: DataFrame) -> DataFrame:
    """Rating rows in the shape of contest rows; they sort first in their slice."""
    values = {
        **{n: F.col(n) for n in (*WALK, "_chunk")},
        "_row": F.lit(SEED),
        "side1": F.col("team"),
        "score": F.col("rating"),
    }
    return state.select(
        *[
            (values[f.name] if f.name in values else F.lit(None)).cast(f.dataType).alias(f.name)
            for f in like.schema
        ]
    )


def _run(
    rows: DataFrame, seeds: DataFrame | None, emit_contests: bool, k: float, initial: float
) -> DataFrame:
    seeded = rows if seeds is None else rows.unionByName(_as_seed(seeds, rows))
    key = [*WALK, "_chunk"]
    ordered = seeded.repartition(*key).sortWithinPartitions(
        *key, "_row", *ORDER
    )
    kind = dict(rows.dtypes)["match_id"]
    out = f"match_id {kind}, elo1 double, elo2 double" if emit_contests else _STATE
    return ordered.mapInArrow(_fold(emit_contests, k, initial), out)


def _settle(rows, seeds, k, initial, tolerance) -> DataFrame:
    """Ratings at the start of every slice of every split walk."""
    slices = rows.where("_hot").select(*WALK, "_chunk").distinct()
    teams = (
        rows.where("_hot")
        .select(*WALK, F.explode(F.array("side1", "side2")).alias("team"))
        .distinct()
    )
    grid = pin(slices.join(teams, WALK))
    first = grid.withColumn("rating", F.lit(initial))
    if seeds is not None:
        known = seeds.select(*WALK, "team", F.col("rating").alias("_given"))
        first = first.join(known, [*WALK, "team"], "left").select(
            *WALK, "_chunk", "team", F.coalesce("_given", "rating").alias("rating")
        )
    hot = rows.where("_hot")
    by_team = Window.partitionBy(*WALK, "team").orderBy("_chunk")
    by_slice = Window.partitionBy(*WALK, "_chunk")
    state = pin(first.withColumn("_end", F.lit(None).cast("double")).withColumn("_again", F.lit(True)))
    while True:
        # Slices whose starts have not moved would only repeat their walk; a pool's first
        # slice to run is exact afterwards, so this ends after as many rounds as slices.
        starts = state.where("_again")
        again = F.broadcast(starts.select(*WALK, "_chunk").distinct())
        ran = _run(hot.join(again, [*WALK, "_chunk"], "left_semi"), starts, False, k, initial)
        # A walk gives back its starts beside its ends, so they need not be joined. Every slice is
        # seeded with every team, so each end row has a next start.
        ended = ran.select(*WALK, "_chunk", "team", F.col("_start").alias("rating"), F.col("rating").alias("_end"))
        known = state.where("not _again").select(*ended.columns).unionByName(ended)
        following = F.coalesce(F.lag("_end").over(by_team), F.col("rating"))
        moved = F.abs(F.col("_next") - F.col("rating")) > tolerance
        state = pin(
            known.withColumn("_next", following).select(
                *WALK, "_chunk", "team", F.col("_next").alias("rating"), "_end",
                F.coalesce(F.max(moved).over(by_slice), F.lit(False)).alias("_again"),
            )
        )
        if state.where("_again").isEmpty():
            break
    return state.select(*WALK, "_chunk", "team", "rating")


def _big_pools(scores: DataFrame, max_rows: int | None) -> DataFrame | None:
    """The pools that hold more rows than a task should walk; None without such a pool."""
    if max_rows == UNSPLIT:
        return None
    sizes = scores.groupBy(*POOL).agg(F.count(F.lit(1)).alias("_n"))
    big = pin(sizes.where(F.col("_n") > (max_rows or MAX_ROWS_PER_KEY)).drop("_n"))
    return None if big.isEmpty() else big


def _leagues(scores: DataFrame, big: DataFrame) -> DataFrame:
    """(pool, team, _league) of the big pools."""
    # One row for each pair that met, however often; a big pool is a key of few rows here.
    met = scores.join(F.broadcast(big), POOL, "left_semi").select(*POOL, "side1", "side2").distinct()
    return components(met, POOL, "side1", "side2", "_league").withColumnRenamed("node", "team")


def _in_leagues(rows: DataFrame, leagues: DataFrame | None, team: str) -> DataFrame:
    if leagues is None:
        return rows.withColumn("_league", F.lit(""))
    named = leagues.withColumnRenamed("team", "_member")
    on = F.col(team) == F.col("_member")
    for k in POOL:
        on = on & (rows[k] == named[k])
    found = rows.join(named, on, "left").select(*[rows[c] for c in rows.columns], "_league")
    return found.withColumn("_league", F.coalesce("_league", F.lit("")))


def _staged(scores, ratings_in, max_rows, k, initial, tolerance):
    leagues = seeds = None
    big = _big_pools(scores, max_rows)
    if big is not None:
        scores = staged(scores)  # read for the leagues, to count the walks and to cut them
        leagues = _leagues(scores, big)
    if ratings_in is not None:
        seeds = _in_leagues(ratings_in.select(*POOL, "team", "rating"), leagues, "team")
    scores = _in_leagues(scores, leagues, "side1")
    first = F.lit(0).cast("long")
    found = None
    if leagues is not None:
        found = hot_keys(scores, WALK, max_rows)
    if found is None:
        rows = scores.select("*", first.alias("_chunk"), F.lit(CONTEST).alias("_row"))
        return rows, None if seeds is None else seeds.withColumn("_chunk", first)
    rows = with_chunk(scores, WALK, ORDER, *found, max_rows, most=MAX_SLICES).withColumn("_row", F.lit(CONTEST))
    starts = _settle(rows, seeds, k, initial, tolerance)
    rows = rows.drop("_hot")
    if seeds is not None:
        cold = seeds.join(found[0], WALK, "left_anti")
        starts = starts.unionByName(cold.withColumn("_chunk", first))
    return rows, starts


def elo_before(
    scores: DataFrame,
    *,
    ratings_in: DataFrame | None = None,
    max_rows: int | None = None,
    k: float = K_FACTOR,
    initial: float = INITIAL,
    tolerance: float = TOLERANCE,
) -> DataFrame:
    """(match_id, elo1, elo2) before each contest that asks.

    ``ratings_in`` (format, sex, team, rating) continues from an earlier run.
    """
    rows, seeds = _staged(scores, ratings_in, max_rows, k, initial, tolerance)
    return _run(rows, seeds, True, k, initial)


def elo_after(
    scores: DataFrame,
    *,
    ratings_in: DataFrame | None = None,
    max_rows: int | None = None,
    k: float = K_FACTOR,
    initial: float = INITIAL,
    tolerance: float = TOLERANCE,
) -> DataFrame:
    """(format, sex, team, rating) after the last contest: the next run's input."""
    rows, seeds = _staged(scores, ratings_in, max_rows, k, initial, tolerance)
    ends = _run(rows, seeds, False, k, initial)
    # A team is in one walk of its pool.
    out = ends.groupBy(*POOL, "team").agg(F.max_by("rating", "_chunk").alias("rating"))
    return out


def elo_columns(side: Column) -> dict[str, Column]:
    """Rating columns of a team row from the contest's two ratings."""
    own = F.when(side == 1, F.col("elo1")).otherwise(F.col("elo2"))
    other = F.when(side == 1, F.col("elo2")).otherwise(F.col("elo1"))
    return {
        "team_elo_before": own,
        "opponent_elo_before": other,
        "elo_difference": own - other,
    }


def team_ratings(log: DataFrame, ratings: DataFrame, keys: Sequence[str] = ("match_id",)) -> DataFrame:
    return log.join(long_side(ratings), list(keys), "left").withColumns(elo_columns(F.col("side"))).drop(
        "elo1", "elo2"
    )

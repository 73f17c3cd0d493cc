"""Model frames: pairing, mirroring, splitting, weighting, and checked joins."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyline.functions.outcomes import signed_toss
from tallyline.session import staged

# --- Fixed values: feature lists, whose order is a contract -----------------
SIGNED_SOURCES = (
    "matches_before",
    "win_rate_before",
    "wins_last_5",
    "win_rate_last_5",
    "wins_last_10",
    "win_rate_last_10",
    "wins_last_20",
    "win_rate_last_20",
    "h2h_team_wins",
    "h2h_team_win_rate",
    "h2h_last_5_win_rate",
    "team_matches_at_venue",
    "team_win_rate_at_venue",
    "team_elo_before",
)
XI_SOURCES = (
    "xi_batters_with_history",
    "xi_mean_batting_average",
    "xi_mean_recent_runs",
    "xi_bowlers_with_history",
    "xi_mean_bowling_economy",
    "xi_mean_recent_wickets",
)
CONTEXT_FEATURES = (
    "matches_before",
    "win_rate_before",
    "win_rate_last_5",
    "win_rate_last_10",
    "win_rate_last_20",
    "h2h_team_win_rate",
    "team_win_rate_at_venue",
    "elo_difference",
    *XI_SOURCES,
    "toss_bat_signed",
    "toss_field_signed",
    "is_t20i",
    "is_male",
)
SCOREBOARD_FEATURES = (
    "runs",
    "wickets",
    "legal_balls_bowled",
    "balls_remaining",
    "current_run_rate",
    "wickets_in_hand",
)
CHASE_EXTRA = ("target", "runs_required", "required_run_rate", "run_rate_difference")
# ----------------------------------------------------------------------------
PRE_TOSS_FEATURES = tuple(f"{n}_diff" for n in SIGNED_SOURCES)
POST_TOSS_FEATURES = (
    *PRE_TOSS_FEATURES,
    *[f"{n}_diff" for n in XI_SOURCES],
    "toss_bat_advantage",
    "toss_field_advantage",
)
FIRST_INNINGS_FEATURES = (*SCOREBOARD_FEATURES, *CONTEXT_FEATURES)
CHASE_FEATURES = (*SCOREBOARD_FEATURES, *CHASE_EXTRA, *CONTEXT_FEATURES)


def require_columns(df: DataFrame, names: Sequence[str], what: str = "required") -> None:
    missing = sorted(set(names) - set(df.columns))
    if missing:
        raise ValueError(f"Missing {what} columns: {missing}")


def _number(name: str) -> Column:
    value = F.col(name).cast("double")
    return F.when(~F.isnan(value), value)


def pair_rows(
    features: DataFrame,
    mode: str = "PRE_TOSS",
    sources: Sequence[str] | None = None,
    carry: Sequence[str] = ("date", "format", "competition", "gender"),
) -> DataFrame:
    """One A/B row per match from its two team rows; A has the smaller name.

    A single aggregation by match: no self-join. ``problem`` says what is wrong
    with a match, NULL when it is sound; ``checked_pairs`` turns it into an error.
    """
    after_toss = mode == "POST_TOSS"
    if sources is None:
        sources = (*SIGNED_SOURCES, *XI_SOURCES) if after_toss else SIGNED_SOURCES
    toss = ["toss_decision", "team_won_toss"] if after_toss else []
    require_columns(
        features, ["match_id", "team", "team_win", "prediction_mode", *carry, *toss, *sources]
    )
    row = F.struct(*carry, "team", "team_win", *toss, *[_number(n).alias(n) for n in sources])
    pairs = (
        features.where(F.col("prediction_mode") == mode)
        .groupBy("match_id")
        .agg(
            F.min_by(row, "team").alias("a"),
            F.max_by(row, "team").alias("b"),
            F.count(F.lit(1)).alias("n"),
            F.sum("team_win").alias("winners"),
        )
    )
    problem = F.when(
        F.col("n") != 2,
        F.concat(F.lit("has "), F.col("n").cast("string"), F.lit(f" {mode} rows; expected exactly 2")),
    ).when(F.coalesce(F.col("winners"), F.lit(0)) != 1, "does not contain exactly one winner")
    extra: list[Column] = []
    if after_toss:
        a_won = F.coalesce(F.col("a.team_won_toss"), F.lit(False))
        b_won = F.coalesce(F.col("b.team_won_toss"), F.lit(False))
        problem = problem.when(a_won == b_won, "has inconsistent toss ownership")
        bat, field = signed_toss(F.when(a_won, 1.0).otherwise(-1.0), F.col("a.toss_decision"))
        extra = [bat.alias("toss_bat_advantage"), field.alias("toss_field_advantage")]
    return pairs.select(
        "match_id",
        *[F.col(f"a.{c}").alias(c) for c in carry],
        F.col("a.team").alias("team_a"),
        F.col("b.team").alias("team_b"),
        F.col("a.team_win").alias("team_a_win"),
        *extra,
        *[(F.col(f"a.{n}") - F.col(f"b.{n}")).alias(f"{n}_diff") for n in sources],
        problem.alias("problem"),
    )


def checked_pairs(pairs: DataFrame) -> DataFrame:
    """Raise on the first unsound match, else return the pairs without ``problem``.

    The pairs are stored, so that the history behind them is built once for the check and its readers.
    """
    pairs = staged(pairs)
    bad = pairs.where(F.col("problem").isNotNull()).select("match_id", "problem").first()
    if bad is not None:
        raise ValueError(f"Match {bad['match_id']} {bad['problem']}")
    return pairs.drop("problem")


def mirrored(df: DataFrame, features: Sequence[str], label: str) -> DataFrame:
    """Each row twice: as it is, and with sides swapped (negated features, 1 - label)."""
    kept = [c for c in df.columns if c not in features and c != label]
    sign = F.col("sign")
    return df.withColumn("sign", F.explode(F.array(F.lit(1), F.lit(-1)))).select(
        *kept,
        F.when(sign == 1, F.col(label)).otherwise(1 - F.col(label)).cast("int").alias(label),
        "sign",
        *[(F.col(f) * sign).alias(f) for f in features],
    )


def temporal_split(
    df: DataFrame,
    train_end: str,
    valid_end: str | None = None,
    key: str = "match_id",
    date: str = "date",
) -> DataFrame:
    """Add ``split``; all rows of a match follow the match's earliest date."""
    require_columns(df, [key, date])
    spark = df.sparkSession
    bounds = spark.range(1).select(
        F.try_to_date(F.lit(train_end)).alias("t"), F.try_to_date(F.lit(valid_end)).alias("v")
    ).first()
    if bounds["t"] is None:
        raise ValueError("train_end must be a valid date")
    if valid_end is not None and (bounds["v"] is None or bounds["v"] < bounds["t"]):
        raise ValueError("valid_end must be on or after train_end")
    train, valid = F.lit(bounds["t"]), F.lit(bounds["v"])
    # Aggregate, then join: a match with very many rows never becomes one window.
    first = df.where(F.col(date).isNotNull()).groupBy(key).agg(
        F.min(F.col(date).cast("date")).alias("_first")
    )
    where = F.when(F.col("_first") <= train, "train")
    if valid_end is not None:
        where = where.when(F.col("_first") <= valid, "valid")
    first = first.select(key, where.otherwise("test").alias("split"))
    return df.join(first, key)


def slice_by_date(df: DataFrame, start: str | None = None, end: str | None = None) -> DataFrame:
    """Rows whose own date lies in a closed range."""
    keep = F.lit(True)
    if start is not None:
        keep = keep & (F.col("date") >= F.lit(start).cast("date"))
    if end is not None:
        keep = keep & (F.col("date") <= F.lit(end).cast("date"))
    return df.where(keep)


def equal_weights(df: DataFrame, key: str = "match_id", name: str = "weight") -> DataFrame:
    """1/n per row of a match, scaled to mean 1: N / (M * n)."""
    sizes = df.groupBy(key).agg(F.count(F.lit(1)).alias("_n"))
    totals = sizes.agg(F.sum("_n").alias("_rows"), F.count(F.lit(1)).alias("_groups"))
    weights = sizes.join(F.broadcast(totals)).select(  # one row by construction
        key, (F.col("_rows") / (F.col("_groups") * F.col("_n"))).alias(name)
    )
    return df.join(weights, key)


def join_many_to_one(left: DataFrame, right: DataFrame, on: Sequence[str], how: str = "inner") -> DataFrame:
    """Join that refuses a right side with repeated keys."""
    repeated = right.groupBy(*on).agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n") > 1)
    bad = repeated.select(*on).first()
    if bad is not None:
        raise ValueError(f"right side is not unique on {list(on)}: {tuple(bad)}")
    return left.join(right, list(on), how)


def post_toss_context(features: DataFrame) -> DataFrame:
    """Team context after the toss; an unknown toss counts as lost, as in training."""
    won = F.coalesce(F.col("team_won_toss"), F.lit(False))
    bat, field = signed_toss(F.when(won, 1.0).otherwise(-1.0), F.col("toss_decision"))
    names = [c for c in CONTEXT_FEATURES if c in features.columns]
    return features.where(F.col("prediction_mode") == "POST_TOSS").select(
        "match_id", F.col("team").alias("batting_team"), "gender", *names,
        bat.alias("toss_bat_signed"), field.alias("toss_field_signed"),
    )


def live_training_frame(states: DataFrame, features: DataFrame) -> DataFrame:
    """Legal-ball states of innings 1 and 2 with a label, joined to team context."""
    usable = states.where(
        F.col("is_legal")
        & F.col("innings_number").isin(1, 2)
        & F.col("batting_team_eventual_win").isNotNull()
    )
    joined = join_many_to_one(usable, post_toss_context(features), ["match_id", "batting_team"])
    return joined.withColumns(
        {
            "is_t20i": (F.col("format") == "T20I").cast("double"),
            "is_male": (F.lower(F.coalesce("gender", F.lit(""))) == "male").cast("double"),
        }
    )


def append_differences(
    paired: DataFrame, side: DataFrame, columns: Sequence[str] | None = None
) -> DataFrame:
    """Left-join each team's side columns and append A minus B as ``<name>_diff``."""
    if columns is None:
        numeric = ("int", "bigint", "double", "float")
        columns = [n for n, t in side.dtypes if t in numeric and n not in ("match_id", "side")]
    sides = side.select("match_id", "team", *[_number(n).alias(n) for n in columns])
    a = sides.select("match_id", F.col("team").alias("team_a"), F.struct(*columns).alias("_a"))
    b = sides.select("match_id", F.col("team").alias("team_b"), F.struct(*columns).alias("_b"))
    out = paired.join(a, ["match_id", "team_a"], "left").join(b, ["match_id", "team_b"], "left")
    return out.select(
        *paired.columns, *[(F.col(f"_a.{n}") - F.col(f"_b.{n}")).alias(f"{n}_diff") for n in columns]
    )


def common_ids(left: DataFrame, right: DataFrame, key: str = "match_id") -> DataFrame:
    return left.select(key).intersect(right.select(key))


def target_conflicts(
    left: DataFrame, right: DataFrame, label: str = "team_a_win", key: str = "match_id"
) -> DataFrame:
    """Common matches whose targets differ; a comparison needs this to be empty."""
    l = left.select(key, F.col(label).alias("left_target"))
    r = right.select(key, F.col(label).alias("right_target"))
    return l.join(r, key).where(~F.col("left_target").eqNullSafe(F.col("right_target")))

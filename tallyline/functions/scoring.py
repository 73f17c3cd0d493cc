"""Ball arithmetic, rates and the numbers on a scoreboard.

Overs are a notation: 17.4 means 17 overs and 4 balls. Everything is kept as a
count of legal balls and only turned into the notation for output.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tallyline.functions.text import LIMITED_OVERS, UNLIMITED_OVERS, lookup

# --- Fixed values -----------------------------------------------------------
WICKETS_AVAILABLE = 10
DEFAULT_LIMITS = {"T20": "120", "T20I": "120", "T10": "60", "ODI": "300", "LIST_A": "300"}
TARGET_REACHED = "target reached"
ALL_OUT = "all out before target"
SCORES_TIED = "regulation scores tied; super-over outcome not modeled"
BALLS_SPENT = "balls exhausted before target"
# ----------------------------------------------------------------------------


def rate(numerator: Column, denominator: Column) -> Column:
    """Quotient as a double; NULL for a NULL side or a zero denominator."""
    return F.try_divide(numerator.cast("double"), denominator.cast("double"))


def per_over(balls_per_over: Column) -> Column:
    return F.when(balls_per_over > 0, balls_per_over).otherwise(6)


def is_legal(wides: Column, noballs: Column) -> Column:
    return (F.coalesce(wides, F.lit(0)) == 0) & (F.coalesce(noballs, F.lit(0)) == 0)


def over_parts(balls: Column, balls_per_over: Column) -> tuple[Column, Column]:
    bpo, n = per_over(balls_per_over), F.greatest(balls, F.lit(0))
    return F.floor(n / bpo), n % bpo


def overs_notation(balls: Column, balls_per_over: Column) -> Column:
    overs, rest = over_parts(balls, balls_per_over)
    return (overs + rest / F.lit(10.0)).cast("double")


def notation_to_balls(overs: Column, balls_per_over: Column) -> Column:
    """Lenient reading of 17.4: the first decimal is the ball count."""
    value = overs.cast("double")
    whole = value.cast("int")
    return (whole * per_over(balls_per_over) + F.bround((value - whole) * 10)).cast("int")


def _over_text_parts(text: Column) -> tuple[Column, Column]:
    tidy = F.trim(text)
    dot = F.instr(tidy, ".")
    whole = F.when(dot > 0, F.substring_index(tidy, ".", 1)).otherwise(tidy)
    ball = F.when(dot > 0, F.substr(tidy, dot + 1)).otherwise("0")
    return whole.try_cast("int"), ball.try_cast("int")


def overs_reject_reason(text: Column, balls_per_over: int = 6) -> Column:
    """Why a text is not overs notation; NULL when it is."""
    whole, ball = _over_text_parts(text)
    return (
        F.when(text.isNull() | (F.trim(text) == ""), "overs cannot be empty")
        .when(whole.isNull() | ball.isNull(), "overs must use cricket notation such as 15.3")
        .when((whole < 0) | (ball < 0), "overs cannot be negative")
        .when(
            ball >= balls_per_over,
            F.concat(
                F.lit("Invalid cricket over notation '"),
                text,
                F.lit(f"': ball component must be 0-{balls_per_over - 1}"),
            ),
        )
    )


def overs_text_to_balls(text: Column, balls_per_over: int = 6) -> Column:
    """Strict reading of overs notation; NULL where a reject reason exists."""
    whole, ball = _over_text_parts(text)
    valid = (whole >= 0) & (ball >= 0) & (ball < balls_per_over)
    return F.when(valid, whole * balls_per_over + ball)


def supports_live(format_: Column) -> Column:
    return format_.isin(*LIMITED_OVERS)


def default_balls_per_over(format_: Column, balls_per_over: Column) -> Column:
    """Recorded balls per over; 5 for the hundred-ball format and 6 otherwise if unset."""
    fallback = F.when(format_ == "HUNDRED", 5).otherwise(6)
    return F.coalesce(F.when(balls_per_over != 0, balls_per_over), fallback)


def ball_limit(
    format_: Column, scheduled_overs: Column, balls_per_over: Column, target_overs: Column
) -> Column:
    """Legal balls an innings may last, NULL when it is unlimited."""
    bpo = default_balls_per_over(format_, balls_per_over)
    planned = F.when(scheduled_overs != 0, scheduled_overs * bpo)
    return (
        F.when(format_.isin(*UNLIMITED_OVERS, "OTHER"), F.lit(None))
        .when(target_overs.isNotNull(), notation_to_balls(target_overs, bpo))
        .when((format_ == "HUNDRED") & (planned == 50), 50)
        .when(format_ == "HUNDRED", 100)
        .when(planned.isNotNull(), planned)
        .otherwise(lookup(DEFAULT_LIMITS, format_).cast("int"))
        .cast("int")
    )


def live_metrics(
    runs: Column,
    wickets: Column,
    balls: Column,
    target: Column,
    limit: Column,
    balls_per_over: Column,
) -> dict[str, Column]:
    """Scoreboard numbers that use nothing later than the current ball."""
    bpo = per_over(balls_per_over).cast("double")
    remaining = F.when(limit.isNotNull(), F.greatest(limit - balls, F.lit(0)))
    current = F.when(balls != 0, rate(runs, balls / bpo))
    needed = target - runs
    required = F.when(remaining > 0, rate(needed, remaining / bpo))
    return {
        "overs": overs_notation(balls, balls_per_over),
        "balls_remaining": remaining,
        "current_run_rate": current,
        "target": target,
        "runs_required": needed,
        "required_run_rate": required,
        "run_rate_difference": current - required,
        "wickets_in_hand": WICKETS_AVAILABLE - wickets,
    }


def terminal_chase(
    innings: Column, target: Column, runs: Column, wickets: Column, remaining: Column
) -> tuple[Column, Column]:
    """Probability and reason when a chase is already decided, else NULLs."""
    chase = (innings == 2) & target.isNotNull()
    reached = chase & (runs >= target)
    out = chase & (wickets >= WICKETS_AVAILABLE)
    spent = chase & (remaining == 0)
    level = spent & (runs == target - 1)
    p = F.when(reached, 1.0).when(out, 0.0).when(level, 0.5).when(spent, 0.0)
    why = (
        F.when(reached, TARGET_REACHED)
        .when(out, ALL_OUT)
        .when(level, SCORES_TIED)
        .when(spent, BALLS_SPENT)
    )
    return p, why


def elo_probability(difference: Column) -> Column:
    return 1.0 / (1.0 + F.pow(F.lit(10.0), -difference / 400.0))


def finite_or_zero(value: Column) -> Column:
    """Model input convention: text, NULL, NaN and infinities become 0."""
    number = value.try_cast("double")
    bad = F.isnan(number) | (F.abs(number) == float("inf"))
    return F.coalesce(F.when(~bad, number), F.lit(0.0))


def overlap_ratio(first: Column, second: Column) -> Column:
    """Share of the first list found in the second; NULL when either is empty."""
    known = (F.size(first) > 0) & (F.size(second) > 0)
    return F.when(
        known, F.size(F.array_intersect(first, second)) / F.size(F.array_distinct(first))
    )


def log_rest_days(days: Column) -> Column:
    return F.when(days.isNotNull(), F.log1p(F.least(F.greatest(days, F.lit(0)), F.lit(120))))

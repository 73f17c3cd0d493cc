"""Confidence labels: the lowest of three ceilings, with the reasons for each."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tallyline.functions.outcomes import winner_side

# --- Fixed values -----------------------------------------------------------
LABELS = ("LOW", "MEDIUM", "HIGH")
LIMITED_PRE = "franchise PRE_TOSS model has limited discriminatory power"
LIMITED_POST = "franchise POST_TOSS model has limited discriminatory power"
CLOSE = "prediction is close"
PREVIOUS_XI_MISSING = (
    "historical previous-XI information is missing or incomplete; "
    "roster features were zero-imputed"
)
CURRENT_XI_IGNORED = (
    "current playing XI was ignored because PRE_TOSS cannot use the current lineup"
)
NO_VENUE = "No venue supplied; venue-specific features are unavailable."
XI_NOT_SUPPLIED = (
    "Both playing XIs were not supplied; XI-strength features may be partially or fully unavailable."
)
EDGE_NONE = "probability is close to 50%"
EDGE_SLIGHT = "probability edge is only slight"
EDGE_MODERATE = "probability edge is moderate"
EDGE_STRONG = "probability edge is strong"
NEARLY_DECIDED = "terminal live state is nearly decided"
STILL_EARLY = "first innings is still early"
USES_STATE = "live model can use current match state"
T20I_STRONGER = "T20I models have stronger historical discrimination"
DOMAIN_UNKNOWN = "unsupported domain defaults to low confidence"
SAMPLE_SPARSE = "historical sample is sparse"
SAMPLE_MODEST = "historical sample is modest"
SAMPLE_USABLE = "both teams have usable historical depth"
PREVIOUS_XI_GAP = "previous-XI history is missing or incomplete"
CURRENT_XI_GAP = "current playing XI is incomplete"
VENUE_GAP = "venue is unknown"
FILES_GAP = "some historical files failed to parse"
# ----------------------------------------------------------------------------

LOW, MEDIUM, HIGH = 0, 1, 2


def _is(flag: Column, value: bool) -> Column:
    return F.coalesce(flag == value, F.lit(False))


def _first_rule(rules: list[tuple[Column | None, int, str]]) -> tuple[Column, Column]:
    """(rank, reason) of the first rule that holds; the last has no condition."""
    rank = reason = None
    for condition, level, text in rules:
        if condition is None:
            return rank.otherwise(level), reason.otherwise(text)
        rank = F.when(condition, level) if rank is None else rank.when(condition, level)
        reason = F.when(condition, text) if reason is None else reason.when(condition, text)
    raise ValueError("the last rule must be unconditional")


def assess(
    *,
    probability: Column,
    format_: Column,
    mode: Column,
    history1: Column,
    history2: Column,
    venue_known: Column,
    previous_xi_complete: Column,
    lineup_complete: Column,
    parse_errors: Column,
    terminal: Column,
    innings: Column,
    balls: Column,
) -> tuple[Column, Column]:
    """(label, reasons array) of a probability and the evidence behind it."""
    p = winner_side(probability)
    upper = F.upper(mode)
    live = upper == "LIVE"
    t20 = format_ == "T20"
    pre = t20 & (upper == "PRE_TOSS")
    separation = _first_rule(
        [
            (p < 0.55, LOW, EDGE_NONE),
            (p < 0.62, MEDIUM, EDGE_SLIGHT),
            (p < 0.72, MEDIUM, EDGE_MODERATE),
            (None, HIGH, EDGE_STRONG),
        ]
    )
    early = (innings == 1) & (F.coalesce(balls, F.lit(0)) < 12)
    domain = _first_rule(
        [
            (live & _is(terminal, True) & (p >= 0.95), HIGH, NEARLY_DECIDED),
            (live & early, MEDIUM, STILL_EARLY),
            (live, HIGH, USES_STATE),
            (format_ == "T20I", HIGH, T20I_STRONGER),
            (pre & (p < 0.62), LOW, LIMITED_PRE),
            (pre, MEDIUM, LIMITED_PRE),
            (t20, MEDIUM, LIMITED_POST),
            (None, LOW, DOMAIN_UNKNOWN),
        ]
    )
    sample = F.least(history1, history2)
    depth = _first_rule(
        [
            (sample < 5, LOW, SAMPLE_SPARSE),
            (sample < 15, MEDIUM, SAMPLE_MODEST),
            (None, HIGH, SAMPLE_USABLE),
        ]
    )
    after_toss = upper.isin("POST_TOSS", "LIVE")
    gaps = [
        (_is(previous_xi_complete, False), LOW, PREVIOUS_XI_GAP),
        (_is(lineup_complete, False) & after_toss, MEDIUM, CURRENT_XI_GAP),
        (~venue_known & ~live, MEDIUM, VENUE_GAP),
        (F.coalesce(parse_errors, F.lit(0)) != 0, MEDIUM, FILES_GAP),
    ]
    ceilings = [F.when(c, level).otherwise(HIGH) for c, level, _ in gaps]
    rank = F.least(separation[0], domain[0], depth[0], *ceilings)
    label = F.when(rank == LOW, LABELS[LOW]).when(rank == MEDIUM, LABELS[MEDIUM]).otherwise(LABELS[HIGH])
    reasons = F.array_compact(
        F.array(separation[1], domain[1], depth[1], *[F.when(c, text) for c, _, text in gaps])
    )
    return label, reasons


def warnings(
    *,
    probability: Column,
    format_: Column,
    mode: Column,
    team1: Column,
    team2: Column,
    history1: Column,
    history2: Column,
    venue: Column,
    previous_xi_complete: Column,
    ignored_current_xi: Column,
    lineup_mode: Column,
    parse_errors: Column,
    extra: Column | None = None,
) -> Column:
    """Warnings that apply to a scored request, in order and without repeats."""
    upper = F.upper(mode)
    t20 = format_ == "T20"

    def few(team: Column, n: Column) -> Column:
        return F.when(
            n < 5,
            F.concat(
                team, F.lit(" has only "), n.cast("string"), F.lit(" prior "), format_,
                F.lit(" matches in the loaded corpus."),
            ),
        )

    partial = lineup_mode.isin("partial_xi", "xi_unknown") & upper.isin("POST_TOSS", "LIVE")
    items = [
        F.when(winner_side(probability) < 0.55, CLOSE),
        F.when(t20 & (upper == "PRE_TOSS"), LIMITED_PRE).when(t20 & (upper == "POST_TOSS"), LIMITED_POST),
        F.when(_is(previous_xi_complete, False), PREVIOUS_XI_MISSING),
        F.when(_is(ignored_current_xi, True), CURRENT_XI_IGNORED),
        few(team1, history1),
        few(team2, history2),
        F.when(venue.isNull() & (upper != "LIVE"), NO_VENUE),
        F.when(
            F.coalesce(parse_errors, F.lit(0)) != 0,
            F.concat(
                parse_errors.cast("string"),
                F.lit(" historical files could not be parsed and were skipped."),
            ),
        ),
        F.when(partial, XI_NOT_SUPPLIED),
    ]
    listed = F.array_compact(F.array(*items))
    if extra is not None:
        listed = F.concat(listed, F.coalesce(extra, F.array().cast("array<string>")))
    return F.array_distinct(listed)

"""Results, labels, toss columns and the wording attached to a probability."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tallyline.functions.text import blank_to_null, canonical_team

# --- Fixed values -----------------------------------------------------------
NOT_A_WICKET = ("retired hurt",)
NOT_BOWLER_WICKETS = (
    "run out",
    "obstructing the field",
    "retired hurt",
    "retired out",
    "timed out",
    "absent hurt",
    "absent",
    "handled the ball",
)
EDGE_LABELS = ((0.55, "very close"), (0.62, "slight"), (0.72, "moderate"))
# ----------------------------------------------------------------------------


def result_of(outcome: Column) -> tuple[Column, Column]:
    """(winner, result type) of an outcome struct; the first rule that applies wins."""
    winner = blank_to_null(outcome["winner"])
    text = F.when(outcome["result"] != "", outcome["result"])
    eliminator = F.when(outcome["eliminator"] != "", outcome["eliminator"])
    bowl_out = F.when(outcome["bowl_out"] != "", outcome["bowl_out"])
    won = F.when(winner.isNotNull(), winner).when(text.isNull(), F.coalesce(eliminator, bowl_out))
    kind = (
        F.when(winner.isNotNull(), "win")
        .when(text.isNotNull(), text)
        .when(eliminator.isNotNull(), "eliminator")
        .when(outcome["bowl_out"].isNotNull(), "bowl_out")
    )
    return won, kind


def other_team(batting: Column, team1: Column, team2: Column) -> Column:
    return F.when(batting == team1, team2).when(batting == team2, team1).otherwise(team2)


def has_binary_result(result_type: Column, winner: Column, team1: Column, team2: Column) -> Column:
    won = (result_type == "win") & (winner != "") & ((winner == team1) | (winner == team2))
    return F.coalesce(won, F.lit(False))


def exclusion_reason(
    date: Column, result_type: Column, winner: Column, team1: Column, team2: Column
) -> Column:
    """Why a contest gives no training row; NULL when it does. Names are compared raw."""
    kind = F.coalesce(F.when(result_type != "", result_type), F.lit("unknown_result"))
    return (
        F.when(date.isNull(), "missing_date")
        .when(has_binary_result(result_type, winner, team1, team2), F.lit(None))
        .when(kind != "win", kind)
        .otherwise("winner_not_in_teams")
    )


def is_draw(result_type: Column) -> Column:
    return F.lower(F.coalesce(result_type, F.lit(""))).isin("draw", "tie")


def toss_columns(
    mode: Column, team: Column, toss_winner: Column, toss_decision: Column
) -> dict[str, Column]:
    """Toss facts of a team row, hidden before the toss."""
    after = mode == "POST_TOSS"
    known = F.when(toss_winner != "", toss_winner)
    return {
        "toss_winner": F.when(after, toss_winner),
        "toss_decision": F.when(after, toss_decision),
        "team_won_toss": F.when(after & known.isNotNull(), canonical_team(known) == canonical_team(team)),
    }


def signed_toss(sign: Column, decision: Column) -> tuple[Column, Column]:
    """(bat, field) columns: the sign where that decision was taken, else 0."""
    tidy = F.lower(F.trim(F.coalesce(decision, F.lit(""))))
    bat = F.when(tidy == "bat", sign).otherwise(0.0)
    field = F.when(tidy.isin("field", "bowl"), sign).otherwise(0.0)
    return bat, field


def signed_toss_for(team: Column, toss_winner: Column, decision: Column) -> tuple[Column, Column]:
    """Signed toss of a request: neutral unless both winner and decision are known."""
    known = F.coalesce((toss_winner != "") & (decision != ""), F.lit(False))
    sign = F.when(~known, 0.0).when(canonical_team(toss_winner) == team, 1.0).otherwise(-1.0)
    return signed_toss(sign, decision)


def credited_to_bowler(wicket: Column, kind: Column) -> Column:
    return wicket & ~F.lower(F.coalesce(kind, F.lit(""))).isin(*NOT_BOWLER_WICKETS)


def winner_side(probability: Column) -> Column:
    return F.greatest(probability, 1.0 - probability)


def edge_label(probability: Column) -> Column:
    p = winner_side(probability)
    label = None
    for bound, name in EDGE_LABELS:
        label = F.when(p < bound, name) if label is None else label.when(p < bound, name)
    return label.otherwise("strong")


def favourite(team1: Column, team2: Column, p1: Column) -> Column:
    """The likelier side; an even call goes to the first."""
    return F.when(p1 >= 1.0 - p1, team1).otherwise(team2)


def toss_normal(decision: Column) -> Column:
    tidy = F.lower(F.trim(decision))
    return F.when(tidy == "bowl", "field").otherwise(F.when(tidy != "", tidy))

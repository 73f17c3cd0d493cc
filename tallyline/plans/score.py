"""Batch scoring: a table of requests against one pass over the history.

Requests enter the history windows as rows that only ask, so a whole table of
them, each at its own date, costs the same single pass.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyline.functions import confidence
from tallyline.functions.labels import LIVE_LABELS, PAIRED_LABELS
from tallyline.functions.outcomes import edge_label, favourite, signed_toss_for, toss_normal
from tallyline.functions.requests import lineup_mode, validate
from tallyline.functions.scoring import live_metrics, terminal_chase
from tallyline.functions.text import canonical_competition
from tallyline.operators import contests as C
from tallyline.operators import participants as P
from tallyline.operators.frames import CONTEXT_FEATURES, SIGNED_SOURCES, XI_SOURCES
from tallyline.operators.history import running
from tallyline.plans import models as M
from tallyline.plans.features import team_history
from tallyline.session import staged

# --- Fixed values -----------------------------------------------------------
SERVED_FORMATS = ("T20I", "T20")
FULL_INNINGS, BALLS_PER_OVER = 120, 6
LIVE_NO_VENUE = "No venue supplied; venue-specific history is unavailable."
LIVE_NO_TOSS = "Toss context was not supplied; toss features are neutral."
LIVE_NO_XI = "Both playing XIs were not supplied; XI-strength features may be unavailable."
TERMINAL_USED = "Terminal live state used instead of the in-play model."
# ----------------------------------------------------------------------------
PREFIX = "request:"
CORE = [f"previous_xi_{n}" for n in P.CORES]
CONTEXT = [n for n in CONTEXT_FEATURES if not n.startswith(("toss_", "is_"))]
SIDE_COLUMNS = list(dict.fromkeys([*SIGNED_SOURCES, *XI_SOURCES, *CONTEXT, *CORE, "previous_xi_known"]))


def as_contests(valid: DataFrame) -> DataFrame:
    """Requests as contests that only ask; before the toss no lineup is known."""
    after = F.col("prediction_mode") != "PRE_TOSS"
    return valid.select(
        F.concat(F.lit(PREFIX), F.col("request_id").cast("string")).alias("match_id"),
        "date", F.col("match_format").alias("format"), "gender", "venue",
        canonical_competition("competition").alias("competition"), "team1", "team2",
        F.lit(None).cast("string").alias("winner"), F.lit(None).cast("string").alias("result_type"),
        F.when(after, F.col("toss_winner")).alias("toss_winner"),
        F.when(after, toss_normal(F.col("toss_decision"))).alias("toss_decision"),
        F.when(after, F.col("team1_xi")).alias("team1_players"),
        F.when(after, F.col("team2_xi")).alias("team2_players"),
        F.lit(True).alias("is_request"),
    )


def matches_applied(contests: DataFrame, asked: DataFrame) -> DataFrame:
    """Contests before each asked date, from daily counts: one row per day at most."""
    days = contests.groupBy("date").agg(F.count(F.lit(1)).alias("n")).where("date is not null")
    events = days.select(F.lit(0).alias("_k"), "date", F.lit(1).alias("kind"), "n")
    probes = asked.select("date").distinct().select(
        F.lit(0).alias("_k"), "date", F.lit(0).alias("kind"), F.lit(0).cast("long").alias("n")
    )
    out = running(events.unionByName(probes), ["_k"], ["date", "kind"], totals={"matches_applied": F.col("n")})
    return out.where("kind = 0").select("date", "matches_applied")


def request_frame(
    valid: DataFrame,
    contests: DataFrame,
    batting: DataFrame,
    bowling: DataFrame,
    max_rows: int | None = None,
) -> DataFrame:
    """Valid requests with both sides' history (structs ``a`` and ``b``) and lineups."""
    known = contests.where(F.col("format").isin(*SERVED_FORMATS)).withColumn(
        "match_id", F.col("match_id").cast("string")
    )
    batting = batting.withColumn("match_id", F.col("match_id").cast("string"))
    bowling = bowling.withColumn("match_id", F.col("match_id").cast("string"))
    everything = known.unionByName(as_contests(valid), allowMissingColumns=True)
    rows = team_history(everything, batting, bowling, only_requests=True, max_rows=max_rows)
    prepared = C.prepare(everything).withColumn("asks", F.col("asks") & F.col("asked"))
    roster = P.roster_features(C.team_rows(prepared), prepared, batting, bowling, max_rows=max_rows)
    rows = rows.join(roster.select("match_id", "side", "previous_xi_known", *CORE), ["match_id", "side"], "left")
    row = F.struct(*[F.col(n).cast("double").alias(n) for n in SIDE_COLUMNS])
    sides = rows.groupBy("match_id").agg(F.min_by(row, "side").alias("a"), F.max_by(row, "side").alias("b"))
    sides = sides.select(F.substring("match_id", len(PREFIX) + 1, 1 << 20).alias("_id"), "a", "b")
    joined = valid.withColumn("_id", F.col("request_id").cast("string")).join(sides, "_id").drop("_id")
    return joined.join(matches_applied(known, valid), "date", "left")


def model_inputs(frame: DataFrame) -> DataFrame:
    """Every feature any model may ask for, by mode."""
    live = F.col("prediction_mode") == "LIVE"
    bats_first = F.col("batting_name") == F.col("team1_name")

    def batting_side(name: str) -> Column:
        return F.when(bats_first, F.col(f"a.{name}")).otherwise(F.col(f"b.{name}"))

    diffs = {f"{n}_diff": F.col(f"a.{n}") - F.col(f"b.{n}") for n in (*SIGNED_SOURCES, *XI_SOURCES, *CORE)}
    bat, field = signed_toss_for(F.col("team1_name"), F.col("toss_winner"), F.col("toss_decision"))
    live_bat, live_field = signed_toss_for(F.col("batting_name"), F.col("toss_winner"), F.col("toss_decision"))
    metrics = live_metrics(
        F.col("runs"), F.col("wickets"), F.col("balls"), F.col("target"), F.lit(FULL_INNINGS), F.lit(BALLS_PER_OVER)
    )
    metrics.pop("target"), metrics.pop("overs")
    return frame.withColumns(
        {
            **diffs,
            "toss_bat_advantage": bat,
            "toss_field_advantage": field,
            **{n: F.when(live, batting_side(n)) for n in CONTEXT},
            "toss_bat_signed": live_bat,
            "toss_field_signed": live_field,
            "is_t20i": (F.col("match_format") == "T20I").cast("double"),
            "is_male": (F.lower(F.trim(F.coalesce("gender", F.lit("")))) == "male").cast("double"),
            "legal_balls_bowled": F.col("balls"),
            **metrics,
        }
    )


def _apply(bundle: M.Bundle, frame: DataFrame, keys: dict) -> DataFrame:
    live = bundle.prediction_mode == M.LIVE_MODE
    rows = frame
    for name, value in keys.items():
        rows = rows.where(F.col(name) == F.lit(value))
    scored = M.probability(bundle, rows, "_p", symmetric=not live)
    if live:
        bowling = F.when(F.col("batting_name") == F.col("team1_name"), F.col("team2_name")).otherwise(F.col("team1_name"))
        why = M.drivers(bundle, LIVE_LABELS, F.col("batting_name"), bowling, top=6, observed_only=True)
    else:
        why = M.drivers(bundle, PAIRED_LABELS, F.col("team1_name"), F.col("team2_name"))
    return scored.select("*", why.alias("drivers"), F.lit(bundle.model_name).alias("model_name"))


def serving(spark: SparkSession, bundles: Sequence[M.Bundle]) -> dict[tuple, M.Bundle]:
    """Route key -> the bundle that may serve it, the last of several; others serve nothing."""
    table = spark.createDataFrame(
        [(*row, b.model is not None, n) for n, (b, row) in enumerate(zip(bundles, M.registry_values(bundles)))],
        f"{M.REGISTRY}, fitted boolean, number int",
    )
    fits = M.route_fit(table).where(F.size("problems") == 0)
    # Eight routes at most for each model.
    rows = fits.select("match_format", "route_mode", "route_innings", "number").orderBy("number").collect()
    return {(r.match_format, r.route_mode, r.route_innings): bundles[r.number] for r in rows}


def score_requests(
    requests: DataFrame,
    contests: DataFrame,
    batting: DataFrame,
    bowling: DataFrame,
    bundles: Sequence[M.Bundle],
    *,
    parse_errors: int = 0,
    max_rows: int | None = None,
) -> tuple[DataFrame, DataFrame]:
    """(predictions, rejected). Rejected rows keep every reason that applies.

    Features are stored once, then each model scores only the rows routed to it.
    """
    served = serving(requests.sparkSession, bundles)
    checked = M.with_route(validate(requests))
    can_serve = F.lit(False)
    for format_, mode, innings in served:
        match = (F.col("match_format") == format_) & (F.col("prediction_mode") == mode)
        if innings is not None:
            match = match & (F.col("innings") == innings)
        can_serve = can_serve | F.coalesce(match, F.lit(False))
    no_route = F.when(
        (F.size("reject_reasons") == 0) & ~can_serve,
        F.concat(F.lit("No production model for format="), "match_format", F.lit(" mode="), "prediction_mode"),
    )
    checked = checked.withColumn(
        "reject_reasons", F.concat("reject_reasons", F.array_compact(F.array(no_route)))
    )
    rejected = checked.where(F.size("reject_reasons") > 0).select(*requests.columns, "reject_reasons")
    valid = checked.where(F.size("reject_reasons") == 0)
    frame = staged(model_inputs(request_frame(valid, contests, batting, bowling, max_rows)))
    parts = None
    for (format_, mode, innings), bundle in served.items():
        keys = {"match_format": format_, "prediction_mode": mode}
        if innings is not None:
            keys["innings"] = innings
        part = _apply(bundle, frame, keys)
        parts = part if parts is None else parts.unionByName(part)
    if parts is None:
        raise ValueError("no bundle can serve any route")
    return _assembled(parts, parse_errors), rejected


def _assembled(scored: DataFrame, parse_errors: int) -> DataFrame:
    """Probabilities in team1/team2 terms with confidence, warnings and evidence."""
    live = F.col("prediction_mode") == "LIVE"
    ended, reason = terminal_chase(
        F.col("innings"), F.col("target"), F.col("runs"), F.col("wickets"), F.col("balls_remaining")
    )
    scored = scored.withColumns({"_end": F.when(live, ended), "_why": F.when(live, reason)})
    p = F.coalesce("_end", "_p")
    bats_first = F.col("batting_name") == F.col("team1_name")
    p1 = F.when(live & ~bats_first, 1.0 - p).otherwise(p)
    t20 = (F.col("match_format") == "T20") & ~live
    known1, known2 = F.col("a.previous_xi_known") == 1, F.col("b.previous_xi_known") == 1
    lineup = lineup_mode(F.col("prediction_mode"), F.col("team1_xi"), F.col("team2_xi"))
    listed = (F.coalesce(F.size("team1_xi"), F.lit(0)) > 0) | (F.coalesce(F.size("team2_xi"), F.lit(0)) > 0)
    scored = scored.withColumns(
        {
            "_p1": p1,
            "_h1": F.coalesce(F.col("a.matches_before"), F.lit(0)).cast("long"),
            "_h2": F.coalesce(F.col("b.matches_before"), F.lit(0)).cast("long"),
            "_known1": F.when(t20, F.coalesce(known1, F.lit(False))),
            "_known2": F.when(t20, F.coalesce(known2, F.lit(False))),
            "lineup_mode": lineup,
            "_terminal": F.col("_end").isNotNull(),
            "_ignored": (F.col("prediction_mode") == "PRE_TOSS") & listed,
        }
    )
    c = F.col
    complete = c("_known1") & c("_known2")
    errors = F.lit(parse_errors)
    label, reasons = confidence.assess(
        probability=c("_p1"), format_=c("match_format"), mode=c("prediction_mode"), history1=c("_h1"),
        history2=c("_h2"), venue_known=c("venue").isNotNull(), previous_xi_complete=complete,
        lineup_complete=c("lineup_mode") == "both_xi_known", parse_errors=errors, terminal=c("_terminal"),
        innings=F.when(live, c("innings")), balls=F.when(live, c("balls")),
    )
    has_toss = (F.coalesce(c("toss_winner"), F.lit("")) != "") & (F.coalesce(c("toss_decision"), F.lit("")) != "")
    extra = F.when(
        live,
        F.array_compact(
            F.array(
                F.when(c("venue").isNull(), LIVE_NO_VENUE),
                F.when(~has_toss, LIVE_NO_TOSS),
                F.when(c("lineup_mode") != "both_xi_known", LIVE_NO_XI),
                F.when(c("_terminal"), F.concat(F.lit("Terminal chase state: "), "_why", F.lit("."))),
                F.when(c("_terminal"), TERMINAL_USED),
            )
        ),
    )
    warned = confidence.warnings(
        probability=c("_p1"), format_=c("match_format"), mode=c("prediction_mode"), team1=c("team1_name"),
        team2=c("team2_name"), history1=c("_h1"), history2=c("_h2"), venue=c("venue"),
        previous_xi_complete=complete, ignored_current_xi=c("_ignored"), lineup_mode=c("lineup_mode"),
        parse_errors=errors, extra=extra,
    )
    return scored.select(
        "request_id", c("team1_name").alias("team1"), c("team2_name").alias("team2"),
        c("_p1").alias("team1_probability"), (1.0 - c("_p1")).alias("team2_probability"),
        favourite(c("team1_name"), c("team2_name"), c("_p1")).alias("predicted_team"),
        edge_label(c("_p1")).alias("edge"), label.alias("confidence"), reasons.alias("confidence_reasons"),
        "prediction_mode", "match_format", "model_name", "model_family", "model_kind",
        warned.alias("warnings"),
        F.when(c("_terminal"), F.slice("drivers", 1, 0)).otherwise(c("drivers")).alias("drivers"),
        c("matches_applied"), c("_h1").alias("team1_history_matches"), c("_h2").alias("team2_history_matches"),
        F.least("_h1", "_h2").alias("min_team_matches_before"), errors.alias("parse_errors"),
        canonical_competition("competition").alias("competition"), "venue", "lineup_mode",
        c("_known1").alias("previous_xi_team1_known"), c("_known2").alias("previous_xi_team2_known"),
        F.when(live, c("innings")).alias("innings_number"), F.when(live, c("_terminal")).alias("terminal"),
    )

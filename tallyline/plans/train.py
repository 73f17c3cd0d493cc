"""Training: select on validation, refit, test once, compare, accept."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyline.operators import metrics as X
from tallyline.operators.frames import common_ids, equal_weights, slice_by_date, target_conflicts
from tallyline.operators.participants import CORES, MEANS
from tallyline.plans.boosting import fit_many
from tallyline.plans.models import (
    ELO,
    LIVE_CANDIDATES,
    LIVE_MODE,
    PAIRED_CANDIDATES,
    ROSTER_FAMILY,
    TREES,
    Bundle,
    Candidate,
    fit,
    probability,
    training_rows,
    tree_fit,
)
from tallyline.session import staged
from tallyline.sources.tables import long_metrics, write_metrics

# --- Fixed values -----------------------------------------------------------
TRAIN_END, VALID_END = "2023-12-31", "2024-12-31"
FOLDS = (
    ("2022", "2021-12-31", "2022-12-31"),
    ("2023", "2022-12-31", "2023-12-31"),
    ("2024", "2023-12-31", "2024-12-31"),
)
PREVIOUS_MEAN_DIFFS = tuple(f"previous_xi_{n}_diff" for n in MEANS)
PREVIOUS_CORE_DIFFS = tuple(f"previous_xi_{n}_diff" for n in CORES)
CURRENT_CORE_DIFFS = tuple(f"current_xi_{n}_diff" for n in CORES)
PRE_GROUPS = {
    "previous_xi_mean_strength": PREVIOUS_MEAN_DIFFS,
    "previous_xi_core_strength": PREVIOUS_CORE_DIFFS,
    "previous_roster_stability": ("previous_roster_stability_diff",),
    "rest_days": ("log_rest_days_diff",),
}
POST_GROUPS = {
    **PRE_GROUPS,
    "current_xi_core_strength": CURRENT_CORE_DIFFS,
    "current_xi_continuity": ("current_previous_xi_overlap_diff",),
}
# ----------------------------------------------------------------------------
NONE = "(none)"
NAMES = ("accuracy", "roc_auc", "log_loss", "brier_score", "ece_10")


def _between(frame: DataFrame, after: str | None, until: str | None) -> DataFrame:
    out = frame if until is None else slice_by_date(frame, end=until)
    return out if after is None else out.where(F.col("date") > F.lit(after).cast("date"))


def evaluate(
    bundle: Bundle, frame: DataFrame, label: str, symmetric: bool, weight: str | None = None
) -> DataFrame:
    """One row of metrics of one model on one frame."""
    return evaluated([({"model": bundle.model_name}, bundle, frame)], label, symmetric, weight).select(
        "model", "n", "matches", *NAMES
    )


def evaluated(
    cases: Sequence[tuple[Mapping[str, str], Bundle, DataFrame]], label: str, symmetric: bool, weight: str | None = None
) -> DataFrame:
    """A row of metrics for each case (names, model, frame): all are scored into one stored table, then measured at once."""
    names = list(cases[0][0])
    kept = list(dict.fromkeys([label, "match_id", *([weight] if weight else [])]))
    parts = None
    for values, bundle, frame in cases:
        part = probability(bundle, frame, "_p", symmetric).select(
            *[F.lit(values[n]).alias(n) for n in names], *kept, "_p"
        )
        parts = part if parts is None else parts.unionByName(part)
    out = X.binary_metrics(staged(parts), label, "_p", names, weight=weight, matches="match_id")
    return out.select(*names, "n", "matches", *NAMES)


def fitted(
    frame: DataFrame, cases: Sequence[tuple[Candidate, Sequence[str], Column, str]], label: str, weight: str | None, mirror: bool
) -> list:
    """A model for each (candidate, features, rows, period): boosted trees side by side, the others one by one."""
    features = list(dict.fromkeys(f for _, names, *_ in cases for f in names))
    trees = [k for k, (c, *_) in enumerate(cases) if c.name == TREES]
    out: dict = {}
    if trees:
        rows = training_rows(frame, features, label, mirror)
        fits = [tree_fit(*cases[k]) for k in trees]
        out = dict(zip(trees, fit_many(rows, fits, label, weight)))
    for k, (candidate, names, rows, _) in enumerate(cases):
        if k not in out:
            out[k] = fit(candidate, frame.where(rows), names, label, weight, mirror)
    return [out[k] for k in range(len(cases))]


def _candidate_metrics(
    candidates, train, test, features, mode, domain, label, weight, mirror, baselines=()
) -> tuple[dict[str, Bundle], DataFrame]:
    models = fitted(train, [(c, features, F.lit(True), "") for c in candidates], label, weight, mirror)
    bundles = {c.name: Bundle(c.name, tuple(features), mode, domain, m) for c, m in zip(candidates, models)}
    cases = [({"model": b.model_name}, b, test) for b in [*bundles.values(), *baselines]]
    return bundles, evaluated(cases, label, mirror, weight)


def selected(metrics: DataFrame) -> str:
    """Name of the best model: lowest Brier score, then log loss."""
    return X.best_model(metrics.withColumn("_g", F.lit(0)), ["_g"]).first()["selected_model"]


def train_domain(
    frame: DataFrame,
    *,
    mode: str,
    domain: str,
    features: Sequence[str],
    label: str = "team_a_win",
    train_end: str = TRAIN_END,
    valid_end: str = VALID_END,
    candidates: Sequence[Candidate] = PAIRED_CANDIDATES,
    weighted: bool = False,
    mirror: bool = True,
    elo_feature: str | None = None,
    innings_number: int | None = None,
    family: str | None = None,
) -> tuple[Bundle, DataFrame]:
    """Select a model on the validation period, refit on all before the test, test.

    Returns the selected bundle and metrics of every model with ``split`` and
    ``selected``. The frame is stored once, since every fit reads it many times.
    ``elo_feature`` adds the rating baseline, which can win the selection.
    """
    keep = list(dict.fromkeys(["match_id", "date", label, *features, *([elo_feature] if elo_feature else [])]))
    frame = staged(frame.select(*keep))
    weight = "weight" if weighted else None

    def part(after, until):
        rows = _between(frame, after, until)
        # Weights take a count and a join by match; stored, that happens once for all passes of all fits.
        return staged(equal_weights(rows)) if weighted else rows

    train, valid = part(None, train_end), part(train_end, valid_end)
    development, test = part(None, valid_end), part(valid_end, None)
    for name, rows in (("train", train), ("valid", valid), ("test", test)):
        if rows.isEmpty():
            raise RuntimeError(f"{mode}/{domain}: temporal split produced an empty partition ({name})")
    baselines = [Bundle(ELO, (elo_feature,), mode, domain)] if elo_feature else []
    args = (features, mode, domain, label, weight, mirror, baselines)
    _, validation = _candidate_metrics(candidates, train, valid, *args)
    validation = staged(validation)
    best = selected(validation)
    final, tested = _candidate_metrics(candidates, development, test, *args)
    chosen = final[best] if best in final else baselines[0]
    facts = {
        **chosen.__dict__, "innings_number": innings_number, "feature_family": family,
        "trained_through": valid_end,
    }
    metrics = validation.withColumn("split", F.lit("validation")).unionByName(
        staged(tested).withColumn("split", F.lit("test"))
    )
    return Bundle(**facts), metrics.select(
        F.lit(mode).alias("mode"), F.lit(domain).alias("domain"), *metrics.columns,
        (F.col("model") == best).alias("selected"),
    )


def train_router(
    paired: DataFrame, *, mode: str, features: Sequence[str], domains: Sequence[str] = ("T20I", "T20"),
    metrics_to: str | None = None, run: str = "", **options,
) -> tuple[dict[str, Bundle], DataFrame]:
    """One independent model per format; ``metrics_to`` appends their metrics in long form to a table, as ``run``."""
    bundles, rows = {}, None
    for domain in domains:
        only = paired.where(F.col("format") == domain)
        bundles[domain], m = train_domain(only, mode=mode, domain=domain, features=features, **options)
        rows = m if rows is None else rows.unionByName(m)
    if metrics_to is not None:
        write_metrics(long_metrics(rows, NAMES, run=run), metrics_to)
    return bundles, rows


def train_live(frame: DataFrame, *, innings_number: int, features: Sequence[str], **options):
    """In-play model of one innings; every match weighs the same."""
    only = frame.where(F.col("innings_number") == innings_number)
    options = {"candidates": LIVE_CANDIDATES, **options}
    return train_domain(
        only, mode=LIVE_MODE, domain="LIVE", features=features, label="batting_team_eventual_win",
        weighted=True, mirror=False, elo_feature="elo_difference", innings_number=innings_number, **options,
    )


def feature_group_folds(
    frame: DataFrame,
    base: Sequence[str],
    groups: Mapping[str, Sequence[str]],
    folds: Sequence[tuple[str, str, str]] = FOLDS,
    candidates: Sequence[Candidate] = PAIRED_CANDIDATES,
) -> tuple[DataFrame, DataFrame]:
    """Rolling folds with and without each feature group, and the gate per group.

    All trees of all folds and groups grow side by side over one stored table, and all models are measured at once.
    """
    extra = [f for group in groups.values() for f in group]
    frame = staged(frame.select(*dict.fromkeys(["match_id", "date", "team_a_win", *base, *extra])))
    plain = "(plain)"
    sets = {plain: tuple(base), **{g: (*base, *names) for g, names in groups.items()}}
    named, cases = [], []
    for fold, train_end, _ in folds:
        for group, features in sets.items():
            for c in candidates:
                named.append((fold, group, c, features))
                cases.append((c, features, F.col("date") <= F.lit(train_end).cast("date"), fold))
    models = fitted(frame, cases, "team_a_win", None, True)
    valid = {fold: _between(frame, train_end, valid_end) for fold, train_end, valid_end in folds}
    scored = evaluated(
        [
            ({"fold": fold, "feature_group": group, "model": c.name}, Bundle(c.name, features, "", "", model), valid[fold])
            for (fold, group, c, features), model in zip(named, models)
        ],
        "team_a_win", True,
    )
    order = F.struct("brier_score", "log_loss", "model")
    best = staged(scored.groupBy("fold", "feature_group").agg(F.min_by(F.struct("model", "brier_score"), order).alias("best")))
    before = best.where(F.col("feature_group") == plain).select("fold", F.col("best").alias("plain"))
    table = best.where(F.col("feature_group") != plain).join(before, "fold").select(
        "feature_group", "fold",
        F.col("plain.model").alias("baseline_model"), F.col("best.model").alias("candidate_model"),
        F.col("plain.brier_score").alias("baseline_brier"), F.col("best.brier_score").alias("candidate_brier"),
        (F.col("best.brier_score") - F.col("plain.brier_score")).alias("brier_delta"),
    )
    return table, X.fold_gate(table, ["feature_group"])


def finalize_candidate(
    frame: DataFrame,
    *,
    mode: str,
    base: Sequence[str],
    extra: Sequence[str] = PREVIOUS_CORE_DIFFS,
    train_end: str = TRAIN_END,
    valid_end: str = VALID_END,
    candidates: Sequence[Candidate] = PAIRED_CANDIDATES,
    domain: str = "T20",
) -> tuple[Bundle | None, DataFrame]:
    """Baseline against candidate on the locked test; a bundle only if accepted."""
    options = {"train_end": train_end, "valid_end": valid_end, "candidates": candidates}
    _, plain = train_domain(frame, mode=mode, domain=domain, features=base, **options)
    bundle, richer = train_domain(
        frame, mode=mode, domain=domain, features=(*base, *extra), family=ROSTER_FAMILY, **options
    )
    both = plain.withColumn("kind", F.lit("baseline")).unionByName(
        richer.withColumn("kind", F.lit("candidate"))
    )
    final = staged(both.where((F.col("split") == "test") & F.col("selected")))
    decision = staged(X.acceptance(final, ["mode", "domain"]))
    accepted = decision.first()["accepted"]
    report = final.join(F.broadcast(decision), ["mode", "domain"])  # one decision
    return (bundle if accepted else None), report


def compare(
    old: DataFrame,
    new: DataFrame,
    old_bundle: Bundle,
    new_bundle: Bundle,
    start: str,
    dimensions: Sequence[str] = ("format", "gender", "competition"),
    min_matches: int = 20,
    label: str = "team_a_win",
) -> DataFrame:
    """Two models on the matches both feature tables have, overall and per group.

    All groupings come from one pass: each scored match is listed once per
    dimension, under the group the new table gives it.
    """
    old, new = slice_by_date(old, start=start), slice_by_date(new, start=start)
    wrong = target_conflicts(old, new, label).first()
    if wrong is not None:
        raise ValueError(f"targets of match {wrong['match_id']} disagree")
    ids = common_ids(old, new)
    left = probability(old_bundle, old.join(ids, "match_id", "left_semi"), "_old")
    right = probability(new_bundle, new.join(ids, "match_id", "left_semi"), "_new")
    groups = F.array(
        F.struct(F.lit("all").alias("dimension"), F.lit("all").alias("group")),
        *[
            F.struct(F.lit(d).alias("dimension"), F.coalesce(F.col(d).cast("string"), F.lit("(none)")).alias("group"))
            for d in dimensions
        ],
    )
    both = right.select("match_id", label, "_new", groups.alias("_g")).join(left.select("match_id", "_old"), "match_id")
    models = F.array(
        F.struct(F.lit("old").alias("model"), F.col("_old").alias("p")),
        F.struct(F.lit("new").alias("model"), F.col("_new").alias("p")),
    )
    long = both.select(label, F.explode("_g").alias("g"), models.alias("m")).select(
        label, "g.*", F.explode("m").alias("m")
    ).select(label, "dimension", "group", "m.model", "m.p")
    m = X.binary_metrics(long, label, "p", ["dimension", "group", "model"])

    def of(model: str, name: str):
        return F.max(F.when(F.col("model") == model, F.col(name)))

    wide = m.groupBy("dimension", "group").agg(
        F.max("n").alias("matches"),
        *[of(k, n).alias(f"{k}_{n}") for n in NAMES for k in ("old", "new")],
    )
    wide = wide.where((F.col("dimension") == "all") | (F.col("matches") >= min_matches))
    return wide.withColumns({f"{n}_delta": F.col(f"new_{n}") - F.col(f"old_{n}") for n in NAMES})


def global_vs_routed(
    frame: DataFrame,
    whole: Bundle,
    router: Mapping[str, Bundle],
    start: str,
    competition_min: int = 20,
    label: str = "team_a_win",
) -> DataFrame:
    """One model for all formats against one model for each: overall, by format and by competition.

    A row for each ``dimension`` ('all', 'format', 'competition') and ``group`` with ``matches``, every metric of both
    models and ``brier_delta_routed_minus_global``; competitions with fewer than ``competition_min`` matches are left
    out, a NULL competition is '(none)'. Matches before ``start`` are not looked at; a format without a model is an error.

    All models score the same row side by side, so the frame is read once and never joined with itself; scored rows
    are folded to (format, competition, probability) counts before they are listed under their three groups.
    """
    frame = slice_by_date(frame, start=start)
    stray = frame.where(~F.coalesce(F.col("format").isin(*router), F.lit(False))).select("format").first()
    if stray is not None:
        raise ValueError(f"no model for format {stray['format']!r}; models exist for {list(router)}")
    scored = probability(whole, frame, "_global")
    for k, bundle in enumerate(router.values()):
        scored = probability(bundle, scored, f"_routed_{k}")
    own = F.coalesce(*[F.when(F.col("format") == f, F.col(f"_routed_{k}")) for k, f in enumerate(router)])
    models = F.array(
        F.struct(F.lit("global").alias("model"), F.col("_global").alias("p")),
        F.struct(F.lit("routed").alias("model"), own.alias("p")),
    )
    named = F.coalesce(F.col("competition"), F.lit(NONE)).alias("competition")
    folded = (
        scored.select("format", named, label, F.explode(models).alias("_m"))
        .groupBy("format", "competition", label, F.col("_m.model").alias("model"), F.col("_m.p").alias("p"))
        .agg(F.count(F.lit(1)).cast("double").alias("weight"))
    )
    groups = F.array(
        F.struct(F.lit("all").alias("dimension"), F.lit("all").alias("group")),
        *[F.struct(F.lit(d).alias("dimension"), F.col(d).alias("group")) for d in ("format", "competition")],
    )
    long = staged(folded.select(label, "model", "p", "weight", F.explode(groups).alias("_g")).select(label, "model", "p", "weight", "_g.*"))
    keys = ["dimension", "group", "model"]
    m = X.binary_metrics(long, label, "p", keys, weight="weight").drop("n")
    sizes = long.groupBy(*keys).agg(F.sum("weight").cast("long").alias("matches"))
    m = m.join(sizes, keys)

    def of(model: str, name: str) -> Column:
        return F.max(F.when(F.col("model") == model, F.col(name)))

    wide = m.groupBy("dimension", "group").agg(
        F.max("matches").alias("matches"), *[of(k, n).alias(f"{k}_{n}") for n in NAMES for k in ("global", "routed")]
    )
    delta = F.col("routed_brier_score") - F.col("global_brier_score")
    return wide.where((F.col("dimension") != "competition") | (F.col("matches") >= competition_min)).withColumn(
        "brier_delta_routed_minus_global", delta
    )

"""Estimators, bundles, scoring and explanations: MLlib's logistic model, boosted trees of `boosting`."""

from __future__ import annotations

import uuid
from collections.abc import Mapping, Sequence
from dataclasses import dataclass, field

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import LogisticRegression, LogisticRegressionModel
from pyspark.ml.feature import StandardScaler, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyline.functions.scoring import elo_probability, finite_or_zero
from tallyline.operators.frames import mirrored
from tallyline.plans.boosting import Fit, Trees, fit_many
from tallyline.session import ensure_checkpoint_dir

# --- Fixed values -----------------------------------------------------------
LOGISTIC, TREES, ELO = "logistic_regression", "gradient_boosting", "elo_baseline"
ELO_FEATURE = "team_elo_before_diff"
LIVE_MODE = "LIVE_AFTER_LEGAL_BALL"
ROSTER_FAMILY = "previous_xi_core_strength"
L2_STRENGTH = 1.0
NEGLIGIBLE = 1e-12
# ----------------------------------------------------------------------------


@dataclass(frozen=True)
class Candidate:
    """How to fit one kind of model."""

    name: str
    intercept: bool = False
    rounds: int = 300
    leaves: int = 15
    min_leaf: int = 30
    depth: int | None = None


PAIRED_CANDIDATES = (Candidate(LOGISTIC), Candidate(TREES, rounds=300, leaves=15, min_leaf=30))
LIVE_CANDIDATES = (
    Candidate(LOGISTIC, intercept=True),
    Candidate(TREES, rounds=250, leaves=31, min_leaf=50),
)


@dataclass(frozen=True)
class Bundle:
    """A fitted model with what it was fitted for."""

    model_name: str
    features: tuple[str, ...]
    prediction_mode: str
    domain: str
    model: PipelineModel | Trees | None = None
    innings_number: int | None = None
    feature_family: str | None = None
    trained_through: str | None = None
    path: str | None = None
    extra: Mapping[str, str] = field(default_factory=dict)


def aligned(df: DataFrame, features: Sequence[str]) -> DataFrame:
    """All trained features as columns; those the frame lacks are NULL."""
    present = set(df.columns)
    missing = {f: F.lit(None).cast("double") for f in features if f not in present}
    return df.withColumns(missing) if missing else df


def sanitized(df: DataFrame, features: Sequence[str]) -> DataFrame:
    return df.withColumns({f: finite_or_zero(F.col(f)) for f in features})


def _stages(candidate: Candidate, features, label, weight, total: float, rows: int) -> list:
    assemble = VectorAssembler(inputCols=list(features), outputCol="raw_features")
    scale = StandardScaler(inputCol="raw_features", outputCol="scaled", withMean=True, withStd=True)
    # The penalty is stated per total weight, and the scaler divides by n - 1
    # where the stated objective divides by n.
    penalty = 1.0 / (L2_STRENGTH * total) * (rows - 1) / rows
    logistic = LogisticRegression(
        featuresCol="scaled", labelCol=label, regParam=penalty, elasticNetParam=0.0,
        standardization=False, fitIntercept=candidate.intercept, maxIter=200, tol=1e-9,
    )
    return [assemble, scale, logistic.setWeightCol(weight) if weight else logistic]


def tree_fit(candidate: Candidate, features: Sequence[str], rows: Column | None = None, period: str = "") -> Fit:
    """What `boosting` is to fit for a candidate."""
    return Fit(
        tuple(features), F.lit(True) if rows is None else rows, period, candidate.rounds, candidate.leaves,
        candidate.min_leaf, candidate.depth,
    )


def training_rows(frame: DataFrame, features: Sequence[str], label: str, mirror: bool) -> DataFrame:
    """Usable inputs of a frame, each row from both sides where sides are exchangeable; other columns stay."""
    rows = sanitized(frame, features)
    return mirrored(rows, features, label) if mirror else rows


def fit(
    candidate: Candidate,
    frame: DataFrame,
    features: Sequence[str],
    label: str = "team_a_win",
    weight: str | None = None,
    mirror: bool = True,
) -> PipelineModel | Trees:
    """Fit one candidate; paired frames are mirrored so that sides are exchangeable."""
    keep = [label, *features] + ([weight] if weight else [])
    rows = training_rows(frame.select(*keep), features, label, mirror)
    if candidate.name == TREES:
        return fit_many(rows, [tree_fit(candidate, features)], label, weight)[0]
    rows = rows.withColumn(label, F.col(label).cast("double"))
    size = rows.agg(
        F.count(F.lit(1)).alias("n"), F.sum(F.col(weight) if weight else F.lit(1.0)).alias("w")
    ).first()
    if not size["n"]:
        raise ValueError("cannot fit a model on an empty frame")
    model = Pipeline(stages=_stages(candidate, features, label, weight, size["w"], size["n"])).fit(rows)
    return without_summary(model, frame.sparkSession)


def without_summary(model: PipelineModel, spark: SparkSession) -> PipelineModel:
    """The same pipeline as if it had been loaded: its last stage stored and read back.

    A logistic model that was just fitted carries a training summary and with it the session. Scoring ships the
    model to the tasks, and a session in which a query was tagged or observed cannot be shipped.
    """
    *before, logistic = model.stages
    path = f"{ensure_checkpoint_dir(spark)}/model-{uuid.uuid4().hex}"
    logistic.write().save(path)
    return PipelineModel([*before, LogisticRegressionModel.load(path)])


def _forward(model: PipelineModel | Trees, df: DataFrame, features: Sequence[str], sign: int, name: str) -> DataFrame:
    kept = df.columns
    if isinstance(model, Trees):
        return df.withColumn(name, model.probability([finite_or_zero(F.col(f)) * sign for f in features]))
    inputs = df.select(*kept, F.struct(*features).alias("_kept_features"))
    values = {f: finite_or_zero(F.col(f"_kept_features.{f}")) * sign for f in features}
    scored = model.transform(inputs.withColumns(values))
    p = vector_to_array("probability")[1].alias(name)
    restored = [F.col(f"_kept_features.{c}").alias(c) if c in features else F.col(c) for c in kept]
    return scored.select(*restored, p)


def probability(bundle: Bundle, df: DataFrame, name: str = "p", symmetric: bool = True) -> DataFrame:
    """Add the model's probability; symmetric ones average both points of view.

    Both views are projections of the same row, so scoring never shuffles.
    """
    if bundle.model_name == ELO:
        return df.withColumn(name, elo_probability(F.coalesce(F.col(bundle.features[0]), F.lit(0.0))))
    before = list(df.columns)
    df = aligned(df, bundle.features)
    out = _forward(bundle.model, df, bundle.features, 1, "_forward")
    if not symmetric:
        return out.withColumnRenamed("_forward", name).select(*before, name)
    out = _forward(bundle.model, out, bundle.features, -1, "_reverse")
    p = 0.5 * (F.col("_forward") + (1.0 - F.col("_reverse")))
    return out.select(*before, F.least(F.greatest(p, F.lit(0.0)), F.lit(1.0)).alias(name))


def drivers(
    bundle: Bundle,
    labels: Mapping[str, str],
    first: Column,
    second: Column,
    top: int = 5,
    observed_only: bool = False,
) -> Column:
    """The features that move a logistic score most, largest effect first.

    An array of (feature, label, raw_value, contribution, supports); empty for
    other models. ``observed_only`` leaves out features the row does not have.
    """
    kind = "array<struct<feature:string,label:string,raw_value:double,contribution:double,supports:string>>"
    if bundle.model_name != LOGISTIC or bundle.model is None:
        return F.array().cast(kind)
    _, scaler, logistic = bundle.model.stages
    items = []
    for i, name in enumerate(bundle.features):
        deviation = float(scaler.std[i])
        weight = float(logistic.coefficients[i]) / deviation if deviation else 0.0
        effect = (finite_or_zero(F.col(name)) - float(scaler.mean[i])) * weight
        raw = F.col(name).cast("double")
        raw = F.when(~F.isnan(raw), raw)
        shown = F.abs(effect) >= NEGLIGIBLE
        if observed_only:
            shown = shown & raw.isNotNull()
        item = F.struct(
            (-F.abs(effect)).alias("rank"),
            F.lit(i).alias("at"),
            F.lit(name).alias("feature"),
            F.lit(labels.get(name, name)).alias("label"),
            raw.alias("raw_value"),
            effect.alias("contribution"),
            F.when(effect > 0, first).otherwise(second).alias("supports"),
        )
        items.append(F.when(shown, item))
    ranked = F.slice(F.array_sort(F.array_compact(F.array(*items))), 1, max(top, 1))
    names = ("feature", "label", "raw_value", "contribution", "supports")
    out = F.transform(ranked, lambda d: F.struct(*[d[n].alias(n) for n in names]))
    return out if top > 0 else F.array().cast(kind)


REGISTRY = (
    "prediction_mode string, domain string, model_name string, features array<string>, "
    "innings_number int, feature_family string, trained_through string, path string"
)


def registry_values(bundles: Sequence[Bundle]) -> list[tuple]:
    return [
        (b.prediction_mode, b.domain, b.model_name, list(b.features), b.innings_number,
         b.feature_family, b.trained_through, b.path)
        for b in bundles
    ]


def registry_rows(spark: SparkSession, bundles: Sequence[Bundle]) -> DataFrame:
    return spark.createDataFrame(registry_values(bundles), REGISTRY)


def save(spark: SparkSession, bundles: Sequence[Bundle], root: str) -> DataFrame:
    """Write each model and one registry table naming them all."""
    stored = []
    for b in bundles:
        innings = "" if b.innings_number is None else f"/innings_{b.innings_number}"
        path = f"{root}/{b.prediction_mode}/{b.domain}{innings}"
        if isinstance(b.model, Trees):
            b.model.save(spark, path)
        elif b.model is not None:
            b.model.write().overwrite().save(path)
        stored.append(Bundle(**{**b.__dict__, "path": path}))
    registry = registry_rows(spark, stored)
    registry.coalesce(1).write.mode("overwrite").parquet(f"{root}/registry")
    return spark.read.schema(REGISTRY).parquet(f"{root}/registry")


def load(spark: SparkSession, root: str) -> list[Bundle]:
    """Bundles of a registry; its size is the number of models."""
    registry = spark.read.schema(REGISTRY).parquet(f"{root}/registry")
    bundles = []
    for row in registry.collect():
        model = None
        if row["model_name"] == TREES:
            model = Trees.load(spark, row["path"])
        elif row["model_name"] != ELO:
            model = PipelineModel.load(row["path"])
        facts = row.asDict()
        facts["features"] = tuple(facts["features"])
        bundles.append(Bundle(model=model, **facts))
    return bundles


# --- routing -----------------------------------------------------------------
# Which model a request of a format and mode goes to.
ROUTES = (
    ("T20I", "PRE_TOSS", None, "international T20I", "PRE_TOSS", "T20I", None, None),
    ("T20I", "POST_TOSS", None, "international T20I", "POST_TOSS", "T20I", None, None),
    ("T20", "PRE_TOSS", None, "roster-aware T20", "PRE_TOSS", "T20", ROSTER_FAMILY, None),
    ("T20", "POST_TOSS", None, "roster-aware T20", "POST_TOSS", "T20", ROSTER_FAMILY, None),
    ("T20I", "LIVE", 1, "live first innings", LIVE_MODE, "LIVE", None, "first_innings"),
    ("T20", "LIVE", 1, "live first innings", LIVE_MODE, "LIVE", None, "first_innings"),
    ("T20I", "LIVE", 2, "live chase", LIVE_MODE, "LIVE", None, "chase"),
    ("T20", "LIVE", 2, "live chase", LIVE_MODE, "LIVE", None, "chase"),
)
ROUTE_SCHEMA = (
    "match_format string, prediction_mode string, route_innings int, model_family string, "
    "expected_mode string, expected_domain string, expected_family string, model_kind string"
)


def routes(spark: SparkSession) -> DataFrame:
    # Literals on a one-row range, so that the plan knows how small this is.
    names = [c.split()[0] for c in ROUTE_SCHEMA.split(", ")]
    rows = F.array(*[F.struct(*[F.lit(v).alias(n) for n, v in zip(names, r)]) for r in ROUTES])
    return spark.range(1).select(F.explode(rows).alias("_r")).select(
        *[F.col(f"_r.{c.split()[0]}").cast(c.split()[1]).alias(c.split()[0]) for c in ROUTE_SCHEMA.split(", ")]
    )


def with_route(requests: DataFrame) -> DataFrame:
    """Add the route columns; a request without a route keeps NULLs there."""
    table = F.broadcast(routes(requests.sparkSession))  # eight rows
    asked = F.when(F.col("prediction_mode") == "LIVE", F.coalesce("innings", F.lit(-1))).otherwise(0)
    return (
        requests.withColumn("_i", asked)
        .join(
            table.withColumn("_i", F.coalesce("route_innings", F.lit(0))),
            ["match_format", "prediction_mode", "_i"], "left",
        )
        .drop("_i", "route_innings")
    )


def route_fit(registry: DataFrame) -> DataFrame:
    """Every stored model beside each route of its mode, with what speaks against the pair.

    ``registry`` has the registry columns and ``fitted``. ``problems`` is an array of
    codes, empty where the model may serve the route; a model whose mode no route asks
    for is not in the result. A live model is bound to its innings, any other to its
    domain and to the feature family of the route; a T20I route takes all families but
    the roster one, a model without a domain serves any.
    """
    live = F.col("expected_domain") == "LIVE"
    other_family = F.when(
        F.col("expected_family").isNotNull(), ~F.col("feature_family").eqNullSafe(F.col("expected_family"))
    ).otherwise((F.col("feature_family") == ROSTER_FAMILY) & (F.col("expected_domain") == "T20I"))
    against = {
        "no_features": F.size("features") == 0,
        "not_fitted": (F.col("model_name") != ELO) & ~F.col("fitted"),
        "other_innings": live & ~F.col("innings_number").eqNullSafe(F.col("route_innings")),
        "other_domain": ~live & (F.col("domain") != "") & (F.col("domain") != F.col("expected_domain")),
        "other_family": ~live & other_family,
    }
    asked = routes(registry.sparkSession).withColumnRenamed("prediction_mode", "route_mode")
    pairs = registry.join(F.broadcast(asked), F.col("prediction_mode") == F.col("expected_mode"))
    return pairs.withColumn(
        "problems", F.array_compact(F.array(*[F.when(rule, F.lit(code)) for code, rule in against.items()]))
    )


def routed_probability(bundles: Mapping[str, Bundle], df: DataFrame, name: str = "p") -> DataFrame:
    """Score rows by the model of their format; a format without one is an error."""
    kinds = list(bundles)
    stray = df.where(~F.coalesce(F.col("format").isin(*kinds), F.lit(False))).select("format").first()
    if stray is not None:
        raise ValueError(f"no model for format {stray['format']!r}; models exist for {kinds}")
    parts = [probability(b, df.where(F.col("format") == f), name) for f, b in bundles.items()]
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out

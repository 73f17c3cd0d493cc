"""Field resolution across ordered sources, with conflicts kept beside the choice.

Snapshots become a long table ``entity field value source kind priority ts``.
The first non-empty value by priority is chosen; later values that differ are
reported, never merged. Values are text, or with ``typed`` VARIANT, where each source may give
a field in a type of its own and gets it back in that type.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

# --- Fixed values -----------------------------------------------------------
RELIABILITY = {"live": "high", "search": "low"}
# ----------------------------------------------------------------------------
RANK = ("priority", "source", "ts")


def canonical_text(value: Column, kind: T.DataType) -> Column:
    """Any value as text that compares equal exactly when the values are equal."""
    if isinstance(kind, (T.ArrayType, T.MapType, T.StructType)):
        return F.to_json(value)
    return value.cast("string")


def _filled(value: Column, kind: T.DataType) -> Column:
    """The value, or NULL for an empty list or map; text is never taken for a list."""
    return F.when(F.size(value) > 0, value) if isinstance(kind, (T.ArrayType, T.MapType)) else value


def as_variant(value: Column, kind: T.DataType) -> Column:
    """Any value as VARIANT, which keeps its type."""
    if isinstance(kind, T.VariantType):
        return value
    if isinstance(kind, (T.ArrayType, T.MapType, T.StructType)):
        return F.to_variant_object(value)
    return value.cast("variant")


def long_fields(snapshots: DataFrame, fields: Sequence[str], typed: bool = False) -> DataFrame:
    """Unpivot wide snapshots to one row per field; with ``typed`` the values are VARIANT."""
    kinds = {f.name: f.dataType for f in snapshots.schema}
    shape = as_variant if typed else canonical_text
    cells = F.array(
        *[
            F.struct(F.lit(f).alias("field"), shape(_filled(F.col(f), kinds[f]), kinds[f]).alias("value"))
            for f in fields
        ]
    )
    return snapshots.select(
        "entity", "source", "kind", "priority", "ts", F.explode(cells).alias("_c")
    ).select("entity", "_c.field", "_c.value", "source", "kind", "priority", "ts")


def _typed(fields: DataFrame) -> bool:
    return isinstance(fields.schema["value"].dataType, T.VariantType)


def _comparable(fields: DataFrame, value: str) -> Column:
    """A value that can be compared: a VARIANT by its JSON, in which keys are sorted and text is quoted."""
    return F.to_json(value) if _typed(fields) else F.col(value)


def known(fields: DataFrame) -> DataFrame:
    """Rows with a value: NULL and blank text are missing, among VARIANT values also null and empty lists and objects.

    The text ``[]`` is a value; empty lists and maps of a column are taken out by ``long_fields``.
    """
    if not _typed(fields):
        return fields.where(F.col("value").isNotNull() & (F.trim("value") != ""))
    json = F.to_json("value")
    blank = json.startswith('"') & (F.trim(F.try_variant_get("value", "$", "string")) == "")
    return fields.where(F.col("value").isNotNull() & ~json.isin("null", "[]", "{}") & ~blank)


def reliability(kind: Column) -> Column:
    return F.when(kind == "live", RELIABILITY["live"]).when(
        kind == "search", RELIABILITY["search"]
    ).otherwise("unknown")


def resolve(fields: DataFrame) -> DataFrame:
    """The chosen value of every (entity, field) with its provenance."""
    order = F.struct(*RANK)
    return (
        known(fields)
        .groupBy("entity", "field")
        .agg(F.min_by(F.struct("value", "source", "kind", "ts", "priority"), order).alias("c"))
        .select(
            "entity", "field", F.col("c.value").alias("value"), F.col("c.source").alias("source"),
            F.col("c.ts").alias("ts"), reliability(F.col("c.kind")).alias("reliability"),
            F.col("c.priority").alias("priority"),
        )
    )


def conflicts(fields: DataFrame) -> DataFrame:
    """Later values that differ from the chosen one."""
    chosen = resolve(fields).select(
        "entity", "field", F.col("value").alias("chosen_value"), F.col("source").alias("chosen_source"),
        F.col("priority").alias("_p"),
    )
    later = known(fields).join(chosen, ["entity", "field"])
    return later.where(_comparable(fields, "value") != _comparable(fields, "chosen_value")).select(
        "entity", "field", "chosen_value", "chosen_source",
        F.col("value").alias("rejected_value"), F.col("source").alias("rejected_source"),
        reliability(F.col("kind")).alias("rejected_reliability"), F.col("ts").alias("rejected_ts"),
    )


def rebuild(resolved: DataFrame, fields: Sequence[str]) -> DataFrame:
    """One wide row per entity from its chosen values, at most one per field, plus its primary source."""
    return resolved.groupBy("entity").agg(
        *[F.any_value(F.when(F.col("field") == f, F.col("value")), ignoreNulls=True).alias(f) for f in fields],
        F.min_by("source", F.struct(*RANK)).alias("primary_source"),
    )


def sources_tried(snapshots: DataFrame) -> DataFrame:
    """Sources asked per entity in order; the number of sources is small by nature."""
    asked = snapshots.select("entity", "priority", "source").distinct()
    return asked.groupBy("entity").agg(
        F.array_sort(F.collect_list(F.struct("priority", "source"))).alias("_s")
    ).select("entity", F.col("_s.source").alias("sources_tried"))

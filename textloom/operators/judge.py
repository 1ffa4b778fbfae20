"""Scores in a judge's JSON answers: extraction, coercion, clamping, failure policies."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from textloom.functions.text import first_object, outer_object, unfenced

DIMS = ("spatial_orientation", "social_interaction", "action_events", "ambience", "descriptiveness", "objectivity", "accuracy", "clarity")
CONTEXT_DIMS = ("spatial_orientation", "social_interaction", "action_events", "ambience")
#: The three navigation composites in use.
NAVIGATION_DIMS = {"a": ("descriptiveness", "objectivity", "accuracy", "clarity"), "b": ("spatial_orientation", "descriptiveness", "accuracy", "clarity"), "c": ("spatial_detail", "hazard_id", "accuracy", "clarity")}


def parsed(raw: Column, nested: bool = False) -> Column:
    """The JSON object in an answer as a map of texts, null if there is none."""
    inner = outer_object(unfenced(raw)) if nested else first_object(unfenced(raw))
    return F.from_json(inner, "map<string,string>")


def as_int(value: Column) -> Column:
    """int(): truncated numbers and numbers in quotes, null for anything else."""
    return value.try_cast("double").try_cast("int")


def clamped(value: Column, low: int = 1, high: int = 10) -> Column:
    return F.greatest(F.lit(low), F.least(F.lit(high), value))


def is_number(raw: str, field: str) -> Column:
    """Whether the field of a JSON object is a number by its type, not a text that can be read as one."""
    kind = F.schema_of_variant(F.try_variant_get(F.try_parse_json(F.col(raw)), f"$.{field}", "variant"))
    return F.coalesce(kind.rlike("^(BIGINT|DECIMAL|DOUBLE|FLOAT)"), F.lit(False))


def scores(df: DataFrame, raw: str, dims: tuple[str, ...] = DIMS, on_error: str = "zero", low: int = 1, high: int = 10, nested: bool = False) -> DataFrame:
    """df with an INT column per dim and `failed`. A row fails if it has no object or a dim is missing or no number.

    on_error: zero fills its dims with 0, skip drops it, count keeps nulls. nested objects reach to the last brace.
    """
    out = df.withColumn("_m", parsed(F.col(raw), nested))
    found = {d: as_int(F.try_element_at("_m", F.lit(d))) for d in dims}
    bad = F.lit(False)
    for value in found.values():
        bad = bad | value.isNull()
    out = out.withColumn("failed", bad)
    fill = {"zero": F.lit(0), "skip": F.lit(None).cast("int"), "count": F.lit(None).cast("int")}[on_error]
    out = out.withColumns({d: F.when(F.col("failed"), fill).otherwise(clamped(value, low, high)) for d, value in found.items()}).drop("_m")
    return out.where("not failed") if on_error == "skip" else out


def without_failures(df: DataFrame, dims: tuple[str, ...] = DIMS) -> DataFrame:
    """Rows with at least one score above zero."""
    return df.where(F.exists(F.array(*dims), lambda x: x > 0))

"""Aggregates and report tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def means(df: DataFrame, metrics: list[str], *group: str, missing_as_zero: bool = False) -> DataFrame:
    """The mean of each metric; nulls are left out, or count 0."""
    return df.groupBy(*group).agg(F.count(F.lit(1)).alias("n"), *[F.avg(F.coalesce(m, F.lit(0)) if missing_as_zero else F.col(m)).alias(m) for m in metrics])


def composite(dims: list[str]) -> Column:
    """The mean of the dims of one row; null if one is null."""
    total = F.lit(0.0)
    for d in dims:
        total = total + F.col(d)
    return total / F.lit(float(len(dims)))


def long_form(df: DataFrame, keys: list[str], metrics: list[str]) -> DataFrame:
    return df.unpivot(keys, metrics, "metric", "value")


def pivot_with_delta(long: DataFrame, condition: str, conditions: list[str]) -> DataFrame:
    """metric, a column for each condition, and delta, the last minus the first."""
    wide = long.groupBy("metric").pivot(condition, conditions).agg(F.first("value", ignorenulls=True))
    return wide.withColumn("delta", F.col(f"`{conditions[-1]}`") - F.col(f"`{conditions[0]}`"))


def mark_best(long: DataFrame) -> DataFrame:
    """long with `best`: whether the value is the metric's greatest; ties are all marked."""
    return long.withColumn("best", F.coalesce(F.col("value") == F.max("value").over(Window.partitionBy("metric")), F.lit(False)))


def in_range(means_long: DataFrame, bounds: DataFrame) -> DataFrame:
    """bounds(metric, low, high) with `status`: OK, OUT OF RANGE or MISSING."""
    return bounds.join(means_long, "metric", "left").withColumn("status", F.when(F.col("value").isNull(), "MISSING").when(F.col("value").between(F.col("low"), F.col("high")), "OK").otherwise("OUT OF RANGE"))


def most_common(df: DataFrame, items: str, pos: str, k: int = 10) -> DataFrame:
    """(item, n): the k most frequent elements of an array column, ties by the row that had them first."""
    return df.select(F.col(pos).alias("_pos"), F.posexplode(items).alias("_at", "item")).groupBy("item").agg(F.count(F.lit(1)).alias("n"), F.min(F.struct("_pos", "_at")).alias("_first")).orderBy(F.desc("n"), "_first").limit(k).select("item", "n")


def at_least(df: DataFrame, score: str, thresholds: tuple[int, ...] = (90, 80, 70, 60, 50)) -> DataFrame:
    """Rows with a score of each threshold at least, the smallest and the greatest score."""
    return df.agg(*[F.count_if(F.col(score) >= t).alias(f"ge_{t}") for t in thresholds], F.min(score).alias("least"), F.max(score).alias("most"))


def latency(df: DataFrame, ms: str, *group: str) -> DataFrame:
    """Mean, 95th percentile by linear interpolation, and rate per second."""
    return df.groupBy(*group).agg(F.count(ms).alias("n"), F.avg(ms).alias("mean_ms"), F.percentile(ms, F.lit(0.95)).alias("p95_ms"), F.try_divide(F.lit(1000.0), F.avg(ms)).alias("fps"))


def latest(df: DataFrame, group: str, order: str, value: str) -> DataFrame:
    """(group, value): the last value that isn't null."""
    return df.where(F.col(value).isNotNull()).groupBy(group).agg(F.max(F.struct(order, value)).alias("_m")).select(group, F.col("_m")[value].alias(value))

"""Analytics over ordered rows: differences, keyframes, moving averages, plateaus."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from textloom.functions.vectors import cosine, mean_abs_difference


def lag_difference(df: DataFrame, group: str, order: str, vector: str, kind: str = "abs") -> DataFrame:
    """df with `diff` to the row before: mean absolute difference, or cosine distance; null for the first."""
    before = F.lag(vector).over(Window.partitionBy(group).orderBy(order))
    return df.withColumn("diff", mean_abs_difference(vector, before) if kind == "abs" else F.when(before.isNotNull(), 1 - cosine(vector, before)))


def keyframes(df: DataFrame, group: str, order: str, n: int = 4, diff: str = "diff") -> DataFrame:
    """The first row and the n - 1 greatest differences of each group (ties: the earlier), with `rank`; all if n or fewer."""
    whole, by = Window.partitionBy(group), Window.partitionBy(group).orderBy(F.desc_nulls_last(diff), order)
    first = F.row_number().over(Window.partitionBy(group).orderBy(order)) == 1
    kept = df.withColumns({"_n": F.count(F.lit(1)).over(whole), "_first": first}).withColumn("_d", F.row_number().over(Window.partitionBy(group, "_first").orderBy(F.desc_nulls_last(diff), order)))
    kept = kept.where((F.col("_n") <= n) | F.col("_first") | (F.col("_d") <= n - 1))
    return kept.drop("_n", "_first", "_d").withColumn("rank", F.row_number().over(Window.partitionBy(group).orderBy(order)) - 1)


def subsampled(df: DataFrame, group: str, order: str, most: int = 64) -> DataFrame:
    """Every k-th row of each group, k = max(1, rows // most)."""
    step = F.greatest(F.lit(1), F.floor(F.count(F.lit(1)).over(Window.partitionBy(group)) / most))
    at = F.row_number().over(Window.partitionBy(group).orderBy(order)) - 1
    return df.withColumns({"_step": step, "_at": at}).where(F.pmod("_at", "_step") == 0).drop("_step", "_at")


def moving_average(df: DataFrame, group: str, order: str, value: str, width: int = 50) -> DataFrame:
    """df with `smooth`: the mean of `width` values around each that isn't null, the series being mirrored at its ends.

    The width shrinks to half of a short series. Mirrored rows are joined to the window, so that edges are means of
    `width` values too; null values keep a null.
    """
    held = df.where(F.col(value).isNotNull())
    order_w = Window.partitionBy(group).orderBy(order)
    placed = held.withColumns({"_i": F.row_number().over(order_w) - 1, "_n": F.count(F.lit(1)).over(Window.partitionBy(group))})
    placed = placed.withColumn("_w", F.least(F.lit(width), F.greatest(F.floor(F.col("_n") / 2), F.lit(1))).cast("int"))
    low, high = F.floor(F.col("_w") / 2).cast("int"), F.floor((F.col("_w") - 1) / 2).cast("int")
    near = placed.select(group, "_n", "_w", "_i", F.col(value).alias("_v"))
    mirrored = near.withColumn("_i", F.explode(F.array(F.col("_i"), -1 - F.col("_i"), 2 * F.col("_n") - 1 - F.col("_i")))).where((F.col("_i") >= -low) & (F.col("_i") <= F.col("_n") - 1 + high))
    running = mirrored.withColumn("_sum", F.sum("_v").over(Window.partitionBy(group).orderBy("_i").rowsBetween(Window.unboundedPreceding, 0)))
    ends = running.select(group, F.col("_i").alias("_e"), F.col("_sum").alias("_hi"))
    starts = running.select(group, (F.col("_i") + 1).alias("_s"), F.col("_sum").alias("_lo"))
    out = placed.withColumns({"_e": F.col("_i") + high, "_s": F.col("_i") - low}).join(ends, [group, "_e"]).join(starts, [group, "_s"], "left")
    smooth = out.select(group, order, ((F.col("_hi") - F.coalesce("_lo", F.lit(0.0))) / F.col("_w")).alias("smooth"))
    return df.join(smooth, [group, order], "left")


def best_so_far(df: DataFrame, group: str, order: str, value: str) -> DataFrame:
    """df with `best`, the least value up to each row, and `is_best`, whether the row set it."""
    before = F.min(value).over(Window.partitionBy(group).orderBy(order).rowsBetween(Window.unboundedPreceding, -1))
    return df.withColumn("is_best", F.coalesce(F.col(value) < before, F.col(value).isNotNull() & before.isNull())).withColumn("best", F.min(value).over(Window.partitionBy(group).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)))


def first_below(df: DataFrame, group: str, order: str, value: str, limit: float) -> DataFrame:
    """(group, stop): the first order with a value under the limit; 0.0 doesn't count."""
    return df.groupBy(group).agg(F.min(F.when((F.col(value) < limit) & (F.col(value) != 0), F.col(order))).alias("stop"))


def plateau(df: DataFrame, group: str, order: str, value: str, gain: float = 1.0, patience: int = 3) -> DataFrame:
    """(group, best, streak, stop): a fold over each group's ordered values; stop is where `patience` values in a row
    didn't exceed the best one by more than `gain`, null if that never comes.

    A group is one series and is folded in one row; series of many values should be pre-aggregated by step.
    """
    series = df.where(F.col(value).isNotNull()).groupBy(group).agg(F.array_sort(F.collect_list(F.struct(F.col(order).alias("o"), F.col(value).cast("double").alias("v")))).alias("s"), F.first(F.col(order)).alias("_any"))
    start = F.struct(F.lit(float("-inf")).alias("best"), F.lit(0).alias("streak"), F.when(F.lit(False), F.col("_any")).alias("stop"))

    def step(state: Column, x: Column) -> Column:
        worse, done = x["v"] <= state["best"] + gain, state["stop"].isNotNull()
        streak = F.when(done, state["streak"]).when(worse, state["streak"] + 1).otherwise(0)
        best = F.when(done | worse, state["best"]).otherwise(x["v"])
        return F.struct(best.alias("best"), streak.alias("streak"), F.when(done, state["stop"]).when(streak >= patience, x["o"]).alias("stop"))

    return series.select(group, F.aggregate("s", start, step).alias("r")).select(group, "r.best", "r.streak", "r.stop")


def as_of(df: DataFrame, group: str, order: str, value: str, when: Column) -> DataFrame:
    """df with `as_of`: the value of the last earlier row of the group for which `when` holds."""
    w = Window.partitionBy(group).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    return df.withColumn("as_of", F.last(F.when(when, F.col(value)), ignorenulls=True).over(w))

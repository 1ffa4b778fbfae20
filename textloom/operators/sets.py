"""Joins on ids, deduplication, splits, samples and top-k, all with a stated order."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def anti(df: DataFrame, used: DataFrame, key: str) -> DataFrame:
    """Rows whose key isn't used; a null key is never used (unlike NOT IN)."""
    return df.join(used.select(key).distinct(), key, "left_anti")


def semi(df: DataFrame, kept: DataFrame, key: str) -> DataFrame:
    return df.join(kept.select(key), key, "left_semi")


def lookup(df: DataFrame, table: DataFrame, key: str, value: str, default) -> DataFrame:
    """df with the table's value, the default where the key is missing; the table has one row per key."""
    return df.join(table.select(key, value), key, "left").withColumn(value, F.coalesce(value, F.lit(default)))


def in_order_of(df: DataFrame, ids: DataFrame, key: str, pos: str) -> DataFrame:
    """The rows of df named by ids(pos, key), in that order."""
    return ids.join(df, key).orderBy(pos)


def side_by_side(df: DataFrame, key: str, condition: str, value: str, conditions: list[str]) -> DataFrame:
    """One row per key with the value of each condition; the smallest of several."""
    return df.groupBy(key).pivot(condition, conditions).agg(F.min(value))


def first_of(df: DataFrame, key: str, *order: Column | str) -> DataFrame:
    """One row per key, the first in the order; null keys are one key. Order by desc for the last."""
    return df.withColumn("_n", F.row_number().over(Window.partitionBy(key).orderBy(*order))).where("_n = 1").drop("_n")


def shuffled(ident: str, seed: int) -> Column:
    """A reproducible random order: sort by it, ties by id."""
    return F.md5(F.concat(F.col(ident).cast("string"), F.lit(f":{seed}")))


def quota_sample(df: DataFrame, stratum: str, ident: str, quota: Column | int, seed: int) -> DataFrame:
    """At most quota rows of each stratum, at random; the quota may be an expression of the stratum's columns."""
    rank = F.row_number().over(Window.partitionBy(stratum).orderBy(shuffled(ident, seed), ident))
    return df.withColumn("_n", rank).where(F.col("_n") <= quota).drop("_n")


def ranked(df: DataFrame, ident: str, *order: Column) -> tuple[DataFrame, int]:
    """df with `pos`, the place (from 0) of each row in the whole table's order, and the number of rows.

    Positions come from ranges sorted apart and the sizes of the ranges before them, so no task gets the whole table.
    """
    from textloom.session import cut_lineage

    sorted_ = cut_lineage(df.repartitionByRange(*order, F.col(ident)).withColumn("_part", F.spark_partition_id()))
    sizes = sorted_.groupBy("_part").agg(F.count(F.lit(1)).alias("_size"))
    before = sizes.withColumn("_before", F.coalesce(F.sum("_size").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))  # a row per range
    placed = sorted_.join(F.broadcast(before), "_part")
    pos = F.col("_before") + F.row_number().over(Window.partitionBy("_part").orderBy(*order, ident)) - 1
    total = before.agg(F.sum("_size")).first()[0] or 0
    return placed.withColumn("pos", pos).drop("_part", "_size", "_before"), total


def split_by_share(df: DataFrame, ident: str, share: float, seed: int | None = None) -> DataFrame:
    """df with `split`: train for the first int(share * n) rows, val for the rest; shuffled if a seed is given, else by id."""
    placed, n = ranked(df, ident, *([shuffled(ident, seed)] if seed is not None else []))
    return placed.withColumn("split", F.when(F.col("pos") < int(share * n), "train").otherwise("val")).drop("pos")


def tail_size(n: int) -> int:
    """Rows of the tail split: max(500, n // 6), leaving at least 100."""
    return max(0, min(max(500, n // 6), n - 100))


def top(df: DataFrame, k: int, *order: Column | str) -> DataFrame:
    return df.orderBy(*order).limit(k)


def upsert(old: DataFrame, new: DataFrame, key: str) -> DataFrame:
    """old without the keys of new, and new."""
    return anti(old, new, key).unionByName(new, allowMissingColumns=True)

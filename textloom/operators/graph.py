"""Connected components and pairs within groups."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from textloom.session import cut_lineage


def _sum_of(df: DataFrame) -> tuple:
    row = df.agg(F.count(F.lit(1)).alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("h")).first()
    return row["n"], row["h"]


def connected_components(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """(node, component) of each node of edges(u, v), the component being its smallest node.

    Rounds of large-star and small-star: in each a node's neighbours are tied to its smallest one, so the
    rounds grow with the logarithm of the largest component, not with its diameter. Each round is written to
    the shared folder. Self loops and null ends are dropped; no edges give no rows.
    """
    both = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    now = cut_lineage(both.where(F.col("u") > F.col("v")).distinct())
    before = _sum_of(now)
    if not before[0]:
        return now.select(F.col("u").alias("node"), F.col("v").alias("component"))
    for _ in range(max_rounds):
        sym = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = sym.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = sym.join(least, "u").where(F.col("v") > F.col("u")).select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u > v").unionByName(low.select("u", F.col("m").alias("v")))
        now = cut_lineage(small.distinct())
        after = _sum_of(now)
        if after == before:
            break
        before = after
    else:
        raise RuntimeError(f"components did not settle in {max_rounds} rounds")
    roots = now.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
    return now.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(roots)


def pairs_within(members: DataFrame, group: str, ident: str, a: str, b: str, block: int = 5_000) -> DataFrame:
    """All pairs (a < b) of the distinct idents that share a group.

    A group above `block` members is salted: its left side is split into blocks and its right side repeated
    for each, so no task gets a hot group whole. Groups of one member give no row; null groups or idents drop out.
    """
    rows = members.select(group, ident).dropna().distinct()
    sizes = rows.groupBy(group).agg(F.count(F.lit(1)).alias("size")).where("size > 1")
    sized = rows.join(sizes, group).withColumn("parts", F.ceil(F.col("size") / block).cast("int"))
    left = sized.select(group, F.col(ident).alias(a), F.pmod(F.xxhash64(ident), F.col("parts")).cast("int").alias("part"))
    right = sized.select(group, F.col(ident).alias(b), F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"))
    return left.join(right, [group, "part"]).where(F.col(a) < F.col(b)).select(a, b)

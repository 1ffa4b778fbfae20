"""Vectors as arrays of numbers."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BinaryType, DoubleType, FloatType

from textloom.functions.text import col


def dot(a: Column | str, b: Column | str) -> Column:
    """Dot product in doubles; vectors of unequal lengths give null."""
    return F.aggregate(F.zip_with(col(a), col(b), lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def cosine(a: Column | str, b: Column | str) -> Column:
    return F.try_divide(dot(a, b), F.sqrt(dot(a, a) * dot(b, b)))


def mean_abs_difference(a: Column | str, b: Column | str) -> Column:
    return F.try_divide(F.aggregate(F.zip_with(col(a), col(b), lambda x, y: F.abs(x.cast("double") - y.cast("double"))), F.lit(0.0), lambda s, x: s + x), F.size(col(a)))


@F.pandas_udf(BinaryType())
def to_blob(vectors: pd.Series) -> pd.Series:
    """Little-endian 32-bit floats of each vector."""
    return vectors.map(lambda v: None if v is None else np.asarray(v, "<f4").tobytes())


@F.pandas_udf(ArrayType(FloatType()))
def from_blob(blobs: pd.Series) -> pd.Series:
    return blobs.map(lambda b: None if b is None else np.frombuffer(b, "<f4"))


@F.pandas_udf(DoubleType())
def _rounded(x: pd.Series, digits: pd.Series) -> pd.Series:
    return pd.Series([None if pd.isna(v) else round(float(v), int(d)) for v, d in zip(x, digits, strict=True)], dtype="float64")


def py_round(c: Column | str, digits: int) -> Column:
    """Python's round: half to even on the exact binary value, which the built-in rounding of shortest decimals isn't."""
    return _rounded(col(c).cast("double"), F.lit(digits))


#: Rows of a library that are broadcast at a time.
LIBRARY_ROWS = 10_000


def top_k(queries: DataFrame, library: DataFrame, query_id: str, library_id: str, k: int, vector: str = "embedding") -> DataFrame:
    """(query_id, library_id, score, rank): the k library vectors nearest to each query; ties by library id.

    Exact: each query meets every row of the library, which is a stated set. It is broadcast in blocks of at most
    LIBRARY_ROWS rows; each block's best k go on, so what is ranked at the end is k rows a query and block.
    """
    blocks = max(1, -(-library.count() // LIBRARY_ROWS))
    q, e = queries.select(F.col(query_id), F.col(vector).alias("_q")), library.select(F.col(library_id), F.col(vector).alias("_e"))
    rank = F.row_number().over(Window.partitionBy(query_id).orderBy(F.desc("score"), library_id))
    found = None
    for block in range(blocks):
        part = e.where(F.pmod(F.xxhash64(library_id), F.lit(blocks)) == block) if blocks > 1 else e
        best = q.join(F.broadcast(part)).select(query_id, library_id, dot("_q", "_e").alias("score")).withColumn("rank", rank).where(F.col("rank") <= k)
        found = best if found is None else found.drop("rank").unionByName(best.drop("rank"))
    return found if blocks == 1 else found.withColumn("rank", rank).where(F.col("rank") <= k)

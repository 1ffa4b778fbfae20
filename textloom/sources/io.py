"""Readers and writers of the formats in which records come and go."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def json_array(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Files that hold one JSON array of objects each."""
    return spark.read.schema(schema).option("multiLine", True).json(path)


def json_map(spark: SparkSession, path: str, value: str, key: str = "video_id") -> DataFrame:
    """(key, value): files that hold one object of id to value each; value is a DDL type."""
    whole = spark.read.text(path, wholetext=True)
    return whole.select(F.explode(F.from_json("value", f"map<string,{value}>")).alias(key, "value"))


def json_splits(spark: SparkSession, path: str, row: str, splits: tuple[str, ...] = ("train", "val")) -> DataFrame:
    """{train: [...], val: [...]} as rows with `split`; row is the DDL of a struct's fields."""
    fields = ", ".join(f"{s} array<struct<{row}>>" for s in splits)
    whole = spark.read.text(path, wholetext=True).select(F.from_json("value", fields).alias("v"))
    parts = F.array(*[F.struct(F.lit(s).alias("split"), F.col(f"v.{s}").alias("rows")) for s in splits])
    return whole.select(F.explode(parts).alias("p")).select("p.split", F.explode("p.rows").alias("r")).select("split", "r.*")


def json_member(spark: SparkSession, path: str, member: str, row: str) -> DataFrame:
    """The rows of one member of an object, as {"data": [...]}."""
    whole = spark.read.text(path, wholetext=True).select(F.from_json("value", f"{member} array<struct<{row}>>").alias("v"))
    return whole.select(F.explode(F.col(f"v.{member}")).alias("r")).select("r.*")


def jsonl(spark: SparkSession, path: str, schema: str) -> DataFrame:
    return spark.read.schema(schema).json(path)


def csv(spark: SparkSession, path: str, schema: str) -> DataFrame:
    return spark.read.schema(schema).csv(path, header=True)


def parquet(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)


def id_list(spark: SparkSession, path: str) -> DataFrame:
    """(pos, id): the lines of one file, in order; blank ones left out. The file is one row, so the order is the file's."""
    whole = spark.read.text(path, wholetext=True)
    lines = whole.select(F.posexplode(F.split("value", r"\r?\n")).alias("pos", "id"))
    return lines.select("pos", F.trim("id").alias("id")).where("id <> ''")


def score_map(spark: SparkSession, path: str) -> DataFrame:
    """(video_id, score) from either form: a list of {video_id, score}, or an object of id to number or {score}."""
    raw = spark.read.text(path, wholetext=True).select(F.col("value").alias("t"))
    listed = raw.select(F.explode(F.from_json("t", "array<struct<video_id string, score double>>")).alias("r")).select("r.video_id", "r.score")
    mapped = raw.where("ltrim(t) like '{%'").select(F.explode(F.from_json("t", "map<string,string>")).alias("video_id", "v"))
    number = F.coalesce(F.col("v").try_cast("double"), F.get_json_object("v", "$.score").try_cast("double"))
    return listed.where("video_id is not null").unionByName(mapped.select("video_id", number.alias("score")))


def files(spark: SparkSession, path: str, pattern: str = "*", recursive: bool = True, marker: str = "_kf", endings: tuple[str, ...] = ()) -> DataFrame:
    """(key, paths): files by the part of their name before the marker, paths sorted; contents aren't read. With endings,
    only files with one of these, in any case."""
    listed = spark.read.format("binaryFile").option("pathGlobFilter", pattern).option("recursiveFileLookup", recursive).load(path).select("path")
    if endings:
        listed = listed.where(F.lower("path").rlike("(" + "|".join(e.lower().replace(".", r"\.") for e in endings) + ")$"))
    name = F.element_at(F.split("path", "/"), -1)
    return listed.groupBy(F.split_part(name, F.lit(marker), F.lit(1)).alias("key")).agg(F.array_sort(F.collect_list("path")).alias("paths"))


def existing(df: DataFrame, paths: str, listed: DataFrame, path: str = "path") -> DataFrame:
    """df with its array of paths cut down to those that listed(path) holds, in order, `all_exist` and `any_exists`."""
    rows = df.withColumn("_row", F.monotonically_increasing_id())
    one = rows.select("_row", F.posexplode(paths).alias("_at", "_path")).join(listed.select(F.col(path).alias("_path")).distinct(), "_path", "left_semi")
    held = one.groupBy("_row").agg(F.transform(F.array_sort(F.collect_list(F.struct("_at", "_path"))), lambda x: x["_path"]).alias("_held"))
    out = rows.join(held, "_row", "left").withColumn("_held", F.coalesce("_held", F.array().cast("array<string>")))
    return out.withColumns({"all_exist": F.size("_held") == F.coalesce(F.size(paths), F.lit(0)), "any_exists": F.size("_held") > 0}).withColumn(paths, F.col("_held")).drop("_row", "_held")


def first_existing(df: DataFrame, places: list[Column], listed: DataFrame, path: str = "path") -> DataFrame:
    """df with `found`: the first of its places that listed(path) holds, null if none does."""
    rows = df.withColumn("_row", F.monotonically_increasing_id()).withColumn("_places", F.array(*places))
    one = rows.select("_row", F.posexplode("_places").alias("_at", "_path")).join(listed.select(F.col(path).alias("_path")).distinct(), "_path", "left_semi")
    first = one.groupBy("_row").agg(F.min(F.struct("_at", "_path"))["_path"].alias("found"))
    return rows.join(first, "_row", "left").drop("_row", "_places")


def _bracketed(df: DataFrame, path: str, begin: str, end: str) -> None:
    """Each file one JSON text: the rows of df(value) between brackets, written line by line."""

    def lines(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield pa.RecordBatch.from_pydict({"value": [begin]})
        first = True
        for batch in batches:
            rows = batch.column(0).to_pylist()
            if rows:
                yield pa.RecordBatch.from_pydict({"value": [r if first and i == 0 else "," + r for i, r in enumerate(rows)]})
                first = False
        yield pa.RecordBatch.from_pydict({"value": [end]})

    df.mapInArrow(lines, "value string").write.mode("overwrite").text(path)


def write_json_array(df: DataFrame, path: str) -> None:
    """Overwrites the path with files of one JSON array of objects each; null fields are left out."""
    _bracketed(df.select(F.to_json(F.struct("*")).alias("value")), path, "[", "]")


def write_json_map(df: DataFrame, path: str, key: str, value: Column) -> None:
    """Overwrites the path with files of one JSON object of key to value each; value is a column of JSON texts."""
    name = F.to_json(F.array(F.col(key).cast("string")))
    _bracketed(df.where(F.col(key).isNotNull()).select(F.concat(F.regexp_replace(name, r"^\[|\]$", ""), F.lit(": "), F.coalesce(value, F.lit("null"))).alias("value")), path, "{", "}")


def replace_table(df: DataFrame, path: str) -> int:
    """Overwrites the table at the path and gives its rows, counted in what was written; an error if some are missing."""
    want = df.count()
    df.write.mode("overwrite").parquet(path)
    got = df.sparkSession.read.parquet(path).count()
    if got != want:
        raise RuntimeError(f"{got} rows written of {want}")
    return got


def write_routed(df: DataFrame, path: str, flags: str = "flags") -> None:
    """One pass: clean rows and flagged ones into partitions is_clean=true and is_clean=false."""
    df.withColumn("is_clean", F.size(flags) == 0).write.mode("overwrite").partitionBy("is_clean").parquet(path)


def write_splits(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").partitionBy("split").parquet(path)


def append_jsonl(df: DataFrame, path: str) -> None:
    df.write.mode("append").json(path)

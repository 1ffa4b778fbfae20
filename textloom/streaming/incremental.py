"""Resumable processing and event-time windows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def remaining(todo: DataFrame, done: DataFrame, key: str) -> DataFrame:
    """The rows of todo whose key isn't done."""
    return todo.join(done.select(key).distinct(), key, "left_anti")


def table_exists(spark: SparkSession, path: str) -> bool:
    """Whether a written table with rows stands at the path. A folder without data files is none; a table that can't be
    read is an error, so that a resumed run never takes it for absent."""
    hadoop = spark._jvm.org.apache.hadoop.fs.Path(path)
    fs = hadoop.getFileSystem(spark._jsc.hadoopConfiguration())
    if not fs.exists(hadoop) or not any(not s.getPath().getName().startswith(("_", ".")) for s in fs.listStatus(hadoop)):
        return False
    return not spark.read.parquet(path).isEmpty()


def resume(todo: DataFrame, sink: str, key: str, process: Callable[[DataFrame], DataFrame], limit: int | None = None, pos: str | None = None) -> DataFrame:
    """Processes what the sink lacks and appends it; gives the whole sink. A limit by position holds before the
    anti-join, so a resumed run doesn't reach further than the first. Parquet's commit makes an append whole or void."""
    spark = todo.sparkSession
    rows = todo.where(F.col(pos) < limit) if limit is not None and pos else todo
    if table_exists(spark, sink):
        rows = remaining(rows, spark.read.parquet(sink), key)
    process(rows).write.mode("append").parquet(sink)
    return spark.read.parquet(sink)


def resumable_stream(source: DataFrame, sink: str, checkpoint: str, key: str, process: Callable[[DataFrame], DataFrame]):
    """A stream that writes each key once: every micro-batch is deduplicated and anti-joined with the sink."""

    def batch(rows: DataFrame, _id: int) -> None:
        resume(rows.dropDuplicates([key]), sink, key, process)

    return source.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def memoised(spark: SparkSession, path: str, make: Callable[[], DataFrame]) -> DataFrame:
    """The table at the path, made and written only if it isn't there."""
    if not table_exists(spark, path):
        make().write.mode("overwrite").parquet(path)
    return spark.read.parquet(path)


def in_blocks(todo: DataFrame, sink: str, key: str, process: Callable[[DataFrame], DataFrame], pos: str, rows: int, every: int) -> DataFrame:
    """resume() by blocks of `every` positions of `rows` in all: after each block what is done stands in the sink."""
    for upto in range(every, rows + every, every):
        resume(todo, sink, key, process, upto, pos)
    return todo.sparkSession.read.parquet(sink)


def tumbling(events: DataFrame, ts: str, width: str, *group: str, value: str, late: str | None = None) -> DataFrame:
    """Count and sum per window and group; with `late`, rows later than that behind the stream are dropped."""
    rows = events.withWatermark(ts, late) if late else events
    return rows.groupBy(F.window(ts, width).alias("w"), *group).agg(F.count(F.lit(1)).alias("n"), F.sum(value).alias("total")).select(F.col("w.start").alias("window_start"), *group, "n", "total")


def sliding(events: DataFrame, ts: str, width: str, slide: str, *group: str, late: str | None = None) -> DataFrame:
    """Count per overlapping window and group; with `late`, rows later than that behind the stream are dropped."""
    rows = events.withWatermark(ts, late) if late else events
    return rows.groupBy(F.window(ts, width, slide).alias("w"), *group).agg(F.count(F.lit(1)).alias("n")).select(F.col("w.start").alias("window_start"), *group, "n")


def sessions(events: DataFrame, ts: str, gap: str, *group: str) -> DataFrame:
    return events.groupBy(F.session_window(ts, gap).alias("w"), *group).agg(F.count(F.lit(1)).alias("n")).select(F.col("w.start").alias("session_start"), F.col("w.end").alias("session_end"), *group, "n")

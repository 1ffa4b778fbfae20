"""Settings that the operators read from the session."""

from __future__ import annotations

import atexit
import contextlib
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

#: Where a session without a checkpoint folder on one machine (tests, a laptop) keeps its steps.
_LOCAL: dict[str, str] = {}
#: Folders of steps that clear_steps deletes.
_WRITTEN: set[str] = set()


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors share: spark.checkpoint.dir, else the folder of setCheckpointDir.

    A session that runs on one machine may have neither and gets a temporary folder; on a cluster that is an error.
    """
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if named:
        return named.rstrip("/")
    if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
    if "dir" not in _LOCAL:
        _LOCAL["dir"] = "file://" + tempfile.mkdtemp(prefix="textloom-")
    return _LOCAL["dir"]


def step_path(spark: SparkSession, kind: str = "steps") -> str:
    """A new path in the shared folder, in a folder of this application that clear_steps deletes."""
    folder = f"{shared_dir(spark)}/textloom-{spark.sparkContext.applicationId}"
    if not _WRITTEN:
        atexit.register(clear_steps, spark)
    _WRITTEN.add(folder)
    return f"{folder}/{kind}-{uuid.uuid4().hex}"


def clear_steps(spark: SparkSession) -> None:
    """Deletes what this application wrote to the shared folder; also done when Python exits. Frames whose steps stand
    there can't be read afterwards."""
    jvm = spark.sparkContext._jvm
    for folder in list(_WRITTEN):
        with contextlib.suppress(Exception):  # the JVM may be gone
            path = jvm.org.apache.hadoop.fs.Path(folder)
            path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)
        _WRITTEN.discard(folder)


def cut_lineage(df: DataFrame) -> DataFrame:
    """The rows of df, written once as a table in the shared folder, so that later steps don't compute them again.

    Unlike a checkpoint's, the sizes of such a table are known to the planner, which else may take it for small enough to
    be broadcast.
    """
    path = step_path(df.sparkSession)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def spread(df: DataFrame) -> DataFrame:
    """df with a partition for each core at least, for work that costs far more than moving the rows.

    Only where the input has fewer splits than cores, as a small file has, are its rows moved; a large input stays as it
    is read.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df if df.rdd.getNumPartitions() >= cores else df.repartition(cores)


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions", "200"))


def ship_package(spark: SparkSession) -> None:
    """Sends this package to the executors of the session, once, so that their Python workers can import it."""
    import shutil
    from pathlib import Path

    sc = spark.sparkContext
    if getattr(sc, "_textloom_shipped", False):
        return
    root = Path(__file__).resolve().parent
    archive = shutil.make_archive(str(Path(tempfile.mkdtemp(prefix="textloom-code-")) / "textloom_code"), "zip", root.parent, root.name)
    sc.addPyFile(archive)
    sc._textloom_shipped = True

"""Intermediate tables in the folder that all executors share."""

from __future__ import annotations

import atexit
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_written: list[str] = []


def shared_dir(spark: SparkSession) -> str:
    """The cluster's spark.checkpoint.dir; a temporary folder only where none is set, as in tests."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        current = spark.sparkContext._jsc.sc().getCheckpointDir()
        found = current.get() if current.isDefined() else None
    if not found and not spark.sparkContext.master.split("[")[0] == "local":
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
    if not found:
        found = "file://" + tempfile.mkdtemp(prefix="lakesearch-")
        spark.sparkContext.setCheckpointDir(found)
        _written.append(found)
    return found.rstrip("/")


def scratch(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder, removed when the session's process ends."""
    path = f"{shared_dir(spark)}/lakesearch-{name}-{uuid.uuid4().hex}"
    _written.append(path)
    return path


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Write `df` once as Parquet in the shared folder and read it back.

    Cuts the lineage without depending on any executor's disk.
    """
    spark = df.sparkSession
    path = scratch(spark, name)
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def bucketed(df: DataFrame, name: str, column: str) -> DataFrame:
    """Write `df` once, spread and sorted by `column` into as many buckets as a shuffle has partitions, and read it back.

    Joins and groupings by that column then move no row of it.
    """
    spark = df.sparkSession
    path = scratch(spark, name)
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    table = f"{name}_{uuid.uuid4().hex}"
    df.repartition(n, column).write.bucketBy(n, column).sortBy(column).option("path", path).option("compression", "zstd").saveAsTable(table)
    return spark.table(table)


def remove(spark: SparkSession, path: str) -> None:
    """Delete a written path on whatever file system it lives on."""
    jvm = spark.sparkContext._jvm
    target = jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)


@atexit.register
def _clean() -> None:
    spark = SparkSession.getActiveSession()
    for path in _written:
        try:
            remove(spark, path)
        except Exception:  # noqa: BLE001 - the session may be gone
            return

"""Scratch tables in the folder that all executors share; they go when the driver ends."""

from __future__ import annotations

import atexit
import contextlib
import os
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_KEPT: set[str] = set()


def shared_dir(spark: SparkSession) -> str:
    """``spark.checkpoint.dir``, or a temporary folder for a local session that has none; on a cluster that is an error."""
    base = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        base = os.path.join(tempfile.gettempdir(), "mergeloom-checkpoints")
    return base.rstrip("/")


def _delete(spark: SparkSession, path: str):
    target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    files = target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    return lambda: files.delete(target, True)


def scratch_path(spark: SparkSession, name: str) -> str:
    """A new path in this application's folder, which is deleted when the driver's Python ends."""
    home = f"{shared_dir(spark)}/mergeloom/{spark.sparkContext.applicationId}"
    if home not in _KEPT:
        _KEPT.add(home)
        delete = _delete(spark, home)

        def clean() -> None:
            with contextlib.suppress(Exception):  # the JVM may be gone before
                delete()

        atexit.register(clean)
    return f"{home}/{name}-{uuid.uuid4().hex}"


def drop_path(spark: SparkSession, path: str) -> None:
    _delete(spark, path)()


def materialize(df: DataFrame, name: str, partition_by: str | None = None) -> DataFrame:
    """Write df to the shared folder and read it back; this cuts its lineage."""
    path = scratch_path(df.sparkSession, name)
    writer = df.write.option("compression", "zstd")
    (writer.partitionBy(partition_by) if partition_by else writer).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)

"""Intermediate tables in the folder that driver and executors share."""

from __future__ import annotations

import atexit
import contextlib
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

#: Folders that this process made and hasn't deleted, each with the session's JVM.
_left: dict[str, object] = {}


def scratch(spark: SparkSession, label: str) -> str:
    """A new folder for tables of one session, where driver and executors both reach it: in spark.checkpoint.dir, or on one
    machine alone in a temporary folder."""
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        base = tempfile.mkdtemp(prefix="docspring-")
        atexit.register(shutil.rmtree, base, ignore_errors=True)
        spark.sparkContext.setCheckpointDir(base)
    path = f"{base.rstrip('/')}/docspring/{label}-{uuid.uuid4().hex}"
    _left[path] = spark._jvm
    return path


def filesystem(spark: SparkSession, path: str):
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p, p.getFileSystem(spark._jsc.hadoopConfiguration())


def delete_path(jvm, path: str) -> None:
    p = jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(jvm.org.apache.hadoop.conf.Configuration()).delete(p, True)


def deleted(spark: SparkSession, path: str) -> None:
    p, fs = filesystem(spark, path)
    fs.delete(p, True)
    _left.pop(path, None)


@atexit.register
def _deleted_at_exit() -> None:
    """What results were still reading goes when the process ends, while its JVM still answers."""
    for path, jvm in list(_left.items()):
        with contextlib.suppress(Exception):
            delete_path(jvm, path)


class Staging:
    """Tables of one job, written once and read back: that cuts lineage and outlives executors. drop() deletes them all."""

    def __init__(self, spark: SparkSession, label: str):
        self.spark, self.path = spark, scratch(spark, label)

    def stored(self, df: DataFrame, name: str) -> DataFrame:
        path = f"{self.path}/{name}-{uuid.uuid4().hex[:12]}"
        df.write.parquet(path)
        return self.spark.read.schema(df.schema).parquet(path)

    def drop(self) -> None:
        deleted(self.spark, self.path)

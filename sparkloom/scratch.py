"""Intermediate tables in the folder that all executors share: they cut lineage and survive lost executors."""

from __future__ import annotations

import atexit
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_made: dict[str, SparkSession] = {}


def folder(spark: SparkSession) -> str:
    """The cluster's shared folder (spark.checkpoint.dir); where it is unset, as in tests, a temporary one is set."""
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not base:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        base = "file://" + tempfile.mkdtemp(prefix="sparkloom-")
        spark.sparkContext.setCheckpointDir(base)
    return base.rstrip("/")


def path(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder, deleted when the process ends."""
    where = f"{folder(spark)}/sparkloom/{name}-{uuid.uuid4().hex}"
    if not _made:
        atexit.register(lambda: release(*_made))
    _made[where] = spark
    return where


def written(df: DataFrame, name: str) -> DataFrame:
    """The table written in the shared folder and read back."""
    where = path(df.sparkSession, name)
    df.write.parquet(where)
    out = df.sparkSession.read.schema(df.schema).parquet(where)
    out._scratch_path = where
    return out


def drop(*tables: DataFrame) -> None:
    """Delete tables that written() made and that nothing will read again."""
    release(*(t._scratch_path for t in tables))


def release(*paths: str) -> None:
    for where in paths:
        spark = _made.pop(where, None)
        try:
            files = files_of(spark, where)
            files.delete(hadoop_path(spark, where), True)
        except Exception:  # the session may have ended already
            return


def hadoop_path(spark: SparkSession, *parts: str):
    return spark.sparkContext._jvm.org.apache.hadoop.fs.Path("/".join(parts))


def files_of(spark: SparkSession, where: str):
    """The file system that a path lies in."""
    return hadoop_path(spark, where).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())

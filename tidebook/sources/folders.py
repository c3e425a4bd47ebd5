"""Names in a folder, and removal, in whatever file system Spark reads it from."""

from __future__ import annotations

from pyspark.sql import SparkSession


def _file_system(spark: SparkSession, path: str):
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark._jsc.hadoopConfiguration()), at


def names(spark: SparkSession, path: str) -> list[str]:
    """Names of what is in a folder, in order; none if it is not there."""
    system, at = _file_system(spark, path)
    return sorted(f.getPath().getName() for f in system.listStatus(at)) if system.exists(at) else []


def remove(spark: SparkSession, path: str) -> None:
    """Remove a folder and all in it, if it is there."""
    system, at = _file_system(spark, path)
    system.delete(at, True)

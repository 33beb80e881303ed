"""Folders of the shared storage, by the file system that Spark itself uses for their address."""

from __future__ import annotations

from pyspark.sql import SparkSession


def _path(spark: SparkSession, folder: str):
    jvm, sc = spark.sparkContext._jvm, spark.sparkContext
    path = jvm.org.apache.hadoop.fs.Path(folder)
    return path.getFileSystem(sc._jsc.hadoopConfiguration()), path


def remove(spark: SparkSession, folder: str) -> bool:
    """Remove a folder and all in it; False if there is none."""
    files, path = _path(spark, folder)
    return files.delete(path, True)


def exists(spark: SparkSession, folder: str) -> bool:
    files, path = _path(spark, folder)
    return files.exists(path)


def names(spark: SparkSession, folder: str) -> list[str]:
    """Names of what a folder holds; nothing if there is none."""
    files, path = _path(spark, folder)
    return sorted(s.getPath().getName() for s in files.listStatus(path)) if files.exists(path) else []

"""Names below a folder of any store that Spark reads, by Spark's own file systems."""

from __future__ import annotations

from pyspark.sql import SparkSession


def path(spark: SparkSession, *parts: str):
    return spark._jvm.org.apache.hadoop.fs.Path("/".join(parts))


def files(spark: SparkSession, folder: str):
    return path(spark, folder).getFileSystem(spark._jsc.hadoopConfiguration())


def names(spark: SparkSession, *parts: str) -> list[str]:
    """Sorted names below a folder; none if it does not exist."""
    at = path(spark, *parts)
    system = at.getFileSystem(spark._jsc.hadoopConfiguration())
    return sorted(s.getPath().getName() for s in system.listStatus(at)) if system.exists(at) else []


def delete(spark: SparkSession, *parts: str) -> None:
    at = path(spark, *parts)
    at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)

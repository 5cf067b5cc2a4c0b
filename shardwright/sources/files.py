"""Files in any store that Spark can reach (local, HDFS, object stores), through Hadoop's file systems."""

from __future__ import annotations

from pyspark.sql import SparkSession


def _at(spark: SparkSession, path: str):
    jvm = spark.sparkContext._jvm
    where = jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), where


def exists(spark: SparkSession, path: str) -> bool:
    files, where = _at(spark, path)
    return files.exists(where)


def matching(spark: SparkSession, pattern: str) -> list[str]:
    """Paths that a glob pattern matches, in name order; none if its folder is missing."""
    files, where = _at(spark, pattern)
    return sorted(f.getPath().toString() for f in files.globStatus(where) or [])


def make_folder(spark: SparkSession, path: str) -> None:
    files, where = _at(spark, path)
    files.mkdirs(where)


def rename(spark: SparkSession, source: str, target: str) -> None:
    """Move a file over any older one."""
    files, where = _at(spark, source)
    _, to = _at(spark, target)
    files.delete(to, False)
    if not files.rename(where, to):
        raise OSError(f"could not rename {source} to {target}")


def delete_on_exit(spark: SparkSession, path: str) -> None:
    """Remove a scratch folder when the driver's JVM ends."""
    files, where = _at(spark, path)
    files.deleteOnExit(where)

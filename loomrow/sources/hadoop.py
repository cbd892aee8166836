"""The few file-system questions Spark's own readers and writers do not answer."""

from __future__ import annotations

from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F


def _locate(spark: SparkSession, path: str):
    jvm = spark.sparkContext._jvm
    target = jvm.org.apache.hadoop.fs.Path(path)
    return target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), target


def exists(spark: SparkSession, path: str) -> bool:
    system, target = _locate(spark, path)
    matches = system.globStatus(target)
    return matches is not None and len(matches) > 0


def is_file(spark: SparkSession, path: str) -> bool:
    system, target = _locate(spark, path)
    return system.exists(target) and system.getFileStatus(target).isFile()


def holds_files(spark: SparkSession, path: str) -> bool:
    """The folder exists and is not empty."""
    system, target = _locate(spark, path)
    return system.exists(target) and len(system.listStatus(target)) > 0


def qualified(spark: SparkSession, path: str) -> str:
    """The whole name of a folder, with one slash after the scheme."""
    system, target = _locate(spark, path)
    name = system.makeQualified(target).toString()
    scheme, _, rest = name.partition(":")
    return f"{scheme}:/{rest.strip('/')}"


def input_path() -> Column:
    """The file a row is read from, as it is named: Spark gives it with blanks and the like encoded."""
    # in paths a plus sign stands for itself
    return F.url_decode(F.replace(F.col("_metadata.file_path"), F.lit("+"), F.lit("%2B")))

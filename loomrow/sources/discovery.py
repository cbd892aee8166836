"""Finding data files and datasets without opening any file."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .hadoop import exists, is_file

# fixed values: what a whole-dataset job reads, and what a sample may also come from
DATA_EXTENSIONS = (".parquet", ".jsonl.gz", ".jsonl", ".json")
SAMPLE_EXTENSIONS = (".json", ".jsonl", ".csv", ".tsv", ".gz", ".parquet")

_LISTING = "path string, modificationTime timestamp, length bigint"


def ends_with_any(path: Column, extensions: tuple[str, ...]) -> Column:
    pattern = "(" + "|".join(ext.replace(".", r"\.") for ext in extensions) + ")$"
    return path.rlike(pattern)


def list_files(spark: SparkSession, path: str, below: bool = True) -> DataFrame:
    """Every file below ``path`` as ``path, length, modificationTime``.

    File contents are never read: the listing source skips the content column when it is
    not asked for. A path that does not exist lists nothing.
    """
    if not exists(spark, path):
        return spark.createDataFrame([], "path string, length bigint, modificationTime timestamp")
    reader = spark.read.format("binaryFile")
    if below and not is_file(spark, path):
        reader = reader.option("recursiveFileLookup", "true")
    return reader.load(path).select("path", "length", "modificationTime")


def discover_files(
    spark: SparkSession, path: str, extensions: tuple[str, ...] = DATA_EXTENSIONS, *, below: bool = True
) -> DataFrame:
    """Supported data files at or below ``path``."""
    return list_files(spark, path, below).where(ends_with_any(F.col("path"), extensions))


def dataset_parts(files: DataFrame, base: str) -> DataFrame:
    """Add ``version, dataset, subpath``: the first three folders of each path below ``base``."""
    clean = F.regexp_replace("path", r"^[a-zA-Z0-9+.-]+:/*", "/")
    root = "/" + base.split(":", 1)[-1].strip("/") + "/"
    inner = F.split(clean.substr(F.length(F.lit(root)) + 1, F.length(clean)), "/")
    placed = files.where(clean.startswith(root) & (F.size(inner) > 3))
    return placed.select(
        "*",
        F.get(inner, 0).alias("version"),
        F.get(inner, 1).alias("dataset"),
        F.get(inner, 2).alias("subpath"),
    )


def discover_datasets(
    spark: SparkSession,
    base: str,
    *,
    version: str = "",
    dataset: str = "",
    subpath: str = "",
) -> DataFrame:
    """Datasets ``version/dataset/subpath`` below ``base`` with file count and bytes.

    Each level can be searched by a part of its name, whatever the case.
    """
    found = dataset_parts(list_files(spark, base), base)
    for column, text in (("version", version), ("dataset", dataset), ("subpath", subpath)):
        if text:
            found = found.where(F.lower(column).contains(text.lower()))
    return found.groupBy("version", "dataset", "subpath").agg(
        F.count("*").alias("files"), F.sum("length").alias("bytes")
    )

"""SQL on datasets, result handling, statistics and previews."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import json_text
from ..sources.discovery import list_files

DEFAULT_ROWS = 100
MAX_ROWS = 10_000
PREVIEW_ROWS = 5


def run_sql(spark: SparkSession, sql: str, views: dict[str, DataFrame] | None = None) -> DataFrame:
    """Run free SQL; ``views`` names the DataFrames it may refer to."""
    for name, df in (views or {}).items():
        df.createOrReplaceTempView(name)
    return spark.sql(sql)


def limited(result: DataFrame, n: int = DEFAULT_ROWS) -> DataFrame:
    """The rows to show: at most ``n`` (1..10000) of the result."""
    if not 1 <= n <= MAX_ROWS:
        raise ValueError(f"the number of rows to show must be between 1 and {MAX_ROWS}")
    return result.limit(n)


def result_metrics(result: DataFrame, shown: int = DEFAULT_ROWS) -> DataFrame:
    """One row: rows and columns of the whole result, and rows shown of it."""
    total = F.count("*")
    return result.agg(
        total.alias("total_rows"),
        F.lit(len(result.columns)).alias("total_columns"),
        F.least(total, F.lit(shown)).alias("shown_rows"),
    )


def stringify(df: DataFrame) -> DataFrame:
    """Every column as text for display, nested ones as JSON; nulls stay null."""
    return df.select(*[json_text(df, name).cast("string").alias(name) for name in df.columns])


def json_fallback(df: DataFrame) -> DataFrame:
    """Nested columns as JSON text, all others as they are."""
    return df.select(*[json_text(df, name).alias(name) for name in df.columns])


def dataset_stats(spark: SparkSession, path: str) -> DataFrame:
    """One row: rows of the parquet files at ``path`` and their size in bytes and MB."""
    rows = spark.read.parquet(path).agg(F.count("*").alias("total_rows"))
    size = list_files(spark, path).where(F.col("path").endswith(".parquet")).agg(
        F.coalesce(F.sum("length"), F.lit(0)).alias("total_bytes")
    )
    return rows.select(
        "total_rows",
        size.scalar().alias("total_bytes"),
    ).withColumn("total_mb", F.round(F.col("total_bytes") / (1024 * 1024), 2))


def preview(df: DataFrame, n: int = PREVIEW_ROWS, order_by: Sequence[str] = ()) -> DataFrame:
    """First rows of a dataset, by key if ``order_by`` is given."""
    return (df.orderBy(*order_by) if order_by else df).limit(n)


def describe(df: DataFrame) -> DataFrame:
    """One row ``column_name, column_type, position`` per column."""
    names = [(f.name, f.dataType.simpleString(), n) for n, f in enumerate(df.schema.fields)]
    return df.sparkSession.createDataFrame(names, "column_name string, column_type string, position int")


__all__ = [
    "dataset_stats", "describe", "json_fallback", "limited", "preview", "result_metrics",
    "run_sql", "stringify",
]

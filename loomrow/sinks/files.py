"""Writing mapped data, query results, exports, samples and the run log."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import json_text
from ..sources.hadoop import holds_files

#: largest size of one file of saved results
MAX_FILE_BYTES = 120 * 1024 * 1024


def write_mapped(df: DataFrame, path: str, *, mode: str = "errorifexists") -> None:
    """Mapped rows as parquet, nested types kept, one file per task: no shuffle."""
    df.write.mode(mode).parquet(path)


def write_checked(checked: DataFrame, path: str, *, mode: str = "errorifexists") -> None:
    """Checked rows in one pass, valid and rejected ones in folders of their own (``_valid=...``)."""
    checked.write.mode(mode).partitionBy("_valid").parquet(path)


class FolderNotEmpty(FileExistsError):
    """Results are never written into a folder that already holds something."""


def save_results(
    df: DataFrame, output_path: str, folder: str, *, max_file_bytes: int = MAX_FILE_BYTES
) -> str:
    """Save a whole query result as a new subpath of a dataset; returns the path.

    Files come out near ``max_file_bytes`` at most: the rows are rebalanced at run time by
    their real size, which joins small partitions and splits large or skewed ones.
    """
    spark = df.sparkSession
    target = f"{output_path.rstrip('/')}/{folder}"
    if holds_files(spark, target):
        raise FolderNotEmpty(f"folder {folder!r} already exists and is not empty")
    setting = "spark.sql.adaptive.advisoryPartitionSizeInBytes"
    before = spark.conf.get(setting, None)
    spark.conf.set(setting, str(max_file_bytes))
    try:
        df.hint("rebalance").write.mode("append").parquet(target)
    finally:
        spark.conf.unset(setting) if before is None else spark.conf.set(setting, before)
    return target


def export_csv(df: DataFrame, path: str, n: int | None = None) -> None:
    """The (first ``n``) rows as CSV with a header line; nested values as JSON text."""
    shown = df if n is None else df.limit(n)
    shown.select(*[json_text(shown, name).alias(name) for name in shown.columns]).write.option(
        "header", "true"
    ).option("quote", '"').option("escape", '"').option("ignoreLeadingWhiteSpace", "false").option(
        "ignoreTrailingWhiteSpace", "false"
    ).csv(path)


def extract_sample(
    df: DataFrame, path: str, *, order_by: Sequence[str], n: int = 1, file_format: str = "json"
) -> None:
    """The first ``n`` rows by key as JSON Lines or parquet."""
    if file_format not in ("json", "parquet"):
        raise ValueError("file_format must be 'json' or 'parquet'")
    df.orderBy(*order_by).limit(n).write.format(file_format).save(path)


def append_run_log(
    spark: SparkSession, path: str, *, run_id: str, dataset: str, kind: str, rows: int, valid: bool
) -> None:
    """One JSON line per finished run."""
    entry = spark.range(1).select(
        F.lit(run_id).alias("run_id"),
        F.lit(dataset).alias("dataset"),
        F.lit(kind).alias("kind"),
        F.lit(rows).cast("long").alias("rows"),
        F.lit(valid).alias("valid"),
        F.current_timestamp().alias("written_at"),
    )
    entry.write.mode("append").json(path)


def read_run_log(spark: SparkSession, path: str) -> DataFrame:
    schema = "run_id string, dataset string, kind string, rows bigint, valid boolean, written_at timestamp"
    return spark.read.schema(schema).json(path)

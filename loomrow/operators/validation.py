"""Checking rows against a JSON Schema, and reporting what is wrong."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..plans.validator import Nulls, compile_validation
from .mapping import ERRORS, VALID


def validate_rows(df: DataFrame, schema: dict, *, nulls: Nulls | str = "missing") -> DataFrame:
    """Add ``_errors`` and ``_valid``. No shuffle.

    ``nulls`` says whether a null field counts as a missing key (``"missing"``) or as a null
    value (``"present"``, as rows read from parquet have every key).
    """
    checked = df.withColumn(ERRORS, compile_validation(df.schema, schema, nulls))
    return checked.withColumn(VALID, F.size(ERRORS) == 0)


def validate_source(df: DataFrame, source_schema: dict, *, nulls: Nulls | str = "missing") -> DataFrame:
    """Check source rows against the schema inferred or edited for them."""
    return validate_rows(df, source_schema, nulls=nulls)


def error_rows(checked: DataFrame, keep: Sequence[str] = ()) -> DataFrame:
    """One row ``path, keyword, message`` per error, with the ``keep`` columns in front.

    Unfolded with the outer variant: the optimiser turns a plain ``explode`` into a filter
    that would check every row a second time.
    """
    unfolded = checked.select(*keep, F.explode_outer(ERRORS).alias("_error"))
    return unfolded.where(F.col("_error").isNotNull()).select(*keep, "_error.*")


#: array positions within an error's path
_POSITION = r"(^|\.)\d+(?=\.|$)"


def field_path(path: Column) -> Column:
    """The path of a field without array positions: ``messages.2.role`` becomes ``messages[].role``."""
    return F.regexp_replace(F.regexp_replace(path, _POSITION, "$1[]"), r"\.\[\]", "[]")


def validation_report(checked: DataFrame, positions: bool = True) -> DataFrame:
    """Errors of a checked dataset by path and keyword: ``n`` and an ``example``, the smallest message.

    With ``positions=False`` elements of an array share one path (``messages[].role``; so do keys of an object that are
    numbers), and the report is no longer than the schema, however long arrays are. Errors are counted by message first,
    within the tasks: what moves is one record per task and kind of error, and only these few messages are compared.
    """
    path = F.col("path") if positions else field_path(F.col("path"))
    counted = error_rows(checked).groupBy(path.alias("path"), "keyword", "message").agg(F.count("*").alias("n"))
    return counted.groupBy("path", "keyword").agg(F.sum("n").alias("n"), F.min("message").alias("example"))


def dataset_eligible(
    df: DataFrame,
    target_schema: dict | None,
    *,
    first_rows: int | None = None,
    nulls: Nulls | str = "present",
) -> DataFrame:
    """One row ``eligible, checked_rows``: may the dataset be queried?

    Needs a target schema and rows that all satisfy it; ``first_rows`` restricts the check
    to that many rows. A dataset without rows is not eligible.
    """
    if not target_schema:
        return df.sparkSession.range(1).select(
            F.lit(False).alias("eligible"), F.lit(0).cast("long").alias("checked_rows")
        )
    rows = df if first_rows is None else df.limit(first_rows)
    checked = validate_rows(rows, target_schema, nulls=nulls)
    return checked.agg(
        F.coalesce(F.bool_and(VALID), F.lit(False)).alias("eligible"),
        F.count("*").alias("checked_rows"),
    )

"""Compare conformance queries with their SQL: ``python -m conformance.check [folder] [name ...]``."""

from __future__ import annotations

import math
import sys
import tempfile
import time
from pathlib import Path

import duckdb
from pyspark.sql import DataFrame, SparkSession

from . import ORACLES, QUERIES
from .registry import Query

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels "
    "conversations"
).split()


def plain(value):
    if isinstance(value, float):
        return "nan" if math.isnan(value) else repr(value)
    return str(value)


def rows_of(columns: list[str], rows) -> list[tuple]:
    order = sorted(range(len(columns)), key=columns.__getitem__)
    return sorted(tuple(plain(row[i]) for i in order) for row in rows)


def duck(folder: str):
    connection = duckdb.connect()
    for name in TABLES:
        if Path(folder, f"{name}.parquet").exists():
            connection.execute(f"CREATE VIEW {name} AS SELECT * FROM '{folder}/{name}.parquet'")
    return connection


def compare(spark: SparkSession, folder: str, function: Query, sql: str | None, connection) -> str:
    """Empty if both agree, else what differs."""
    df: DataFrame = function(spark, folder)
    got = rows_of(df.columns, df.collect())
    if sql is None:
        return "" if df.columns else "no columns"
    answer = connection.execute(sql)
    columns = [c[0] for c in answer.description]
    if sorted(columns) != sorted(df.columns):
        return f"columns {sorted(df.columns)} instead of {sorted(columns)}"
    types = dict(zip(columns, (str(c[1]) for c in answer.description)))
    wanted = rows_of(columns, answer.fetchall())
    if got != wanted:
        extra = [r for r in got if r not in wanted][:2] if len(got) < 5000 else "?"
        lost = [r for r in wanted if r not in got][:2] if len(got) < 5000 else "?"
        return f"{len(got)} rows instead of {len(wanted)}; only here {extra}; only in SQL {lost}"
    kinds = {"int": "INTEGER", "bigint": "BIGINT", "string": "VARCHAR", "double": "DOUBLE", "boolean": "BOOLEAN"}
    for field in df.schema:
        kind = kinds.get(field.dataType.simpleString())
        if kind and kind != types[field.name] and not (kind == "BIGINT" and types[field.name] == "INTEGER"):
            if types[field.name] not in ("STRING", "NUMBER", kind):
                return f"type of {field.name}: {kind} here, {types[field.name]} in SQL"
    return ""


def main(arguments: list[str]) -> int:
    from loomrow.session import get_session

    folder = arguments[0] if arguments else "/root/testdata/sf0.01"
    names = arguments[1:] or list(QUERIES)
    spark = get_session("conformance", "local[8]", **{
        "spark.ui.enabled": "false", "spark.sql.shuffle.partitions": "8", "spark.driver.memory": "8g",
        "spark.checkpoint.dir": tempfile.mkdtemp(prefix="loomrow-"),
    })
    spark.sparkContext.setLogLevel("ERROR")
    connection = duck(folder)
    failed = 0
    for name in names:
        start = time.time()
        try:
            problem = compare(spark, folder, QUERIES[name], ORACLES.get(name), connection)
        except Exception as failure:  # noqa: BLE001 - report and go on
            problem = f"{type(failure).__name__}: {str(failure)[:600]}"
        failed += bool(problem)
        kind = "sql " if name in ORACLES else "rows"
        print(f"{'FAIL' if problem else 'ok  '} {kind} {name:28s} {time.time() - start:6.2f}s {problem}", flush=True)
    print(f"{len(names) - failed} of {len(names)} agree")
    return 1 if failed else 0


if __name__ == "__main__":
    sys.exit(main(sys.argv[1:]))

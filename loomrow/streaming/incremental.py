"""Mapping files as they arrive.

A mapping is one stateless projection, so the batch plan runs unchanged on a stream: each
input file is mapped exactly once, across restarts, without listing old files again.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

from ..operators.mapping import ERRORS, LINE, OUTCOME, REFUSED, RUN, with_outcomes
from ..plans.paths import MappingError
from ..sources.hadoop import input_path
from ..sources.readers import FILE_NAME, parse_json_lines


def stream_source(
    spark: SparkSession, path: str, schema: T.StructType, *, file_format: str = "parquet"
) -> DataFrame:
    """New files below ``path``; ``file_format`` is ``parquet`` or ``json`` (lines).

    Lines that are not one JSON object carry their text in ``_bad_line``, and names of fields that do not fit the schema
    stand in ``_bad_fields``, as in a batch scan.
    """
    if file_format not in ("parquet", "json"):
        raise ValueError("file_format must be 'parquet' or 'json'")
    reader = spark.readStream.option("recursiveFileLookup", "true")
    name = input_path()
    if file_format == "parquet":
        return reader.schema(schema).parquet(path).withColumn(FILE_NAME, name)
    lines = reader.format("text").load(path).withColumn(FILE_NAME, name)
    return parse_json_lines(lines, schema, bad_fields=True)


def map_new_files(
    source: DataFrame,
    output_path: str,
    checkpoint: str,
    mapping: list[dict],
    target_schema: dict | None = None,
    *,
    by_outcome: bool = False,
    run_id: str = "",
    **options,
) -> StreamingQuery:
    """Start mapping everything that is new and stop when it is done.

    With ``by_outcome`` nothing is dropped: mapped rows, rows with errors and refused lines are written to folders of their own
    (``_outcome=...``) by the same exactly-once sink, as a batch job does. Without it refused lines are left out.
    """
    if not mapping:
        raise MappingError("the mapping is empty")
    found = with_outcomes(source, mapping, target_schema, run_id=run_id, **options)
    if not by_outcome:
        found = found.where(F.col(OUTCOME) != REFUSED).drop(OUTCOME, LINE, ERRORS, RUN)
    writer = found.writeStream.partitionBy(OUTCOME) if by_outcome else found.writeStream
    return (
        writer.format("parquet")
        .option("path", output_path)
        .option("checkpointLocation", checkpoint)
        .outputMode("append")
        .trigger(availableNow=True)
        .start()
    )

"""Registry of conformance queries, and what several of them share."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

Query = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    """Register a query, and the SQL that gives the same rows."""

    def register(function: Query) -> Query:
        QUERIES[name] = function
        if sql is not None:
            ORACLES[name] = sql
        return function

    return register


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def entry(source: str | None, target: str, transformation: object = "src") -> dict:
    """One mapping entry."""
    return {"src_field": source, "target_field": target, "transformation": transformation}


def constant(target: str, value: object) -> dict:
    return entry("N/A", target, value)


def day(column: str):
    return F.col(column).cast("date").cast("string")


def chat_rows(spark: SparkSession, folder: str) -> DataFrame:
    """Nested chat samples: each text of the conversations cut into one turn per line.

    Built inside each row, so no conversation is ever gathered in one place.
    """

    def turn(line, i):
        speaker = F.get(F.array(F.lit("human"), F.lit("gpt"), F.lit("system")), (F.col("turn").cast("int") + i) % 3)
        think = F.when(i % 2 == 1, F.concat(F.lit("t"), i.cast("string")))
        return F.struct(speaker.alias("from"), line.alias("value"), think.alias("think"))

    lines = F.split("text", "\n")
    return table(spark, folder, "conversations").select(
        "conv_id", "turn", "role", F.transform(lines, turn).alias("conversations")
    )


#: the turns of chat_rows, one per row
TURNS = """
    SELECT conv_id, turn, role, i, value, n,
           CASE (turn + i) % 3 WHEN 0 THEN 'human' WHEN 1 THEN 'gpt' ELSE 'system' END AS speaker,
           CASE WHEN i % 2 = 1 THEN 't' || i END AS think
    FROM (SELECT conv_id, turn, role, len(string_split(text, chr(10))) AS n,
                 unnest(string_split(text, chr(10))) AS value,
                 generate_subscripts(string_split(text, chr(10)), 1) - 1 AS i
          FROM conversations)
"""

# Arrays that were just computed are unfolded with posexplode_outer: for a plain posexplode
# the optimiser adds a filter on the array, which computes it a second time.

CHAT_MAPPING = [
    constant("template", "fc_chat_st"),
    constant("system", None),
    constant("context", None),
    entry("conversations[].from", "messages[].role", {"human": "USER", "gpt": "ASSISTANT"}),
    entry("conversations[].value", "messages[].content"),
    entry("conversations[].think", "messages[].think"),
    constant("messages[].functioncall", None),
    constant("_lang", None),
    constant("_dataset_name", "open_chat"),
    constant("_subpath", "data"),
]

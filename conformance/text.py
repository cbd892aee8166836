"""Text and sample normalisation."""

from __future__ import annotations

from pyspark.sql import functions as F

from loomrow.functions.text import dataset_key as key_of
from loomrow.functions.text import extract_tags as tags_of
from loomrow.functions.text import text_without_tags
from loomrow.functions.text import truncate_text as shortened
from loomrow.operators.normalize import lift_tags, normalize
from loomrow.operators.query import json_fallback as as_json

from .registry import query, table

# what strip() and shortening do, spelled in SQL; {x} is the text
STRIPPED = r"regexp_replace({x}, '^\s+|\s+$', '', 'g')"
SHORT = f"CASE WHEN length({STRIPPED}) > 120 THEN substring({STRIPPED}, 1, 120) || '...' ELSE {STRIPPED} END"


def short(x: str) -> str:
    return SHORT.replace("{x}", x)


@query(
    "extract_tags",
    f"""SELECT conv_id, turn, {short("text")} AS think, {short("'a ' || text")} AS rest, CAST(1 AS BIGINT) AS tags
        FROM conversations""",
)
def extract_tags(spark, folder):
    tagged = F.concat(F.lit("a <think> "), "text", F.lit("\n</think>"), "text")
    rows = table(spark, folder, "conversations").select("conv_id", "turn", tagged.alias("s"))
    found = rows.select("conv_id", "turn", "s", tags_of(F.col("s")).alias("tags"))
    return found.select(
        "conv_id", "turn", F.try_element_at("tags", F.lit("think")).alias("think"),
        text_without_tags(F.col("s")).alias("rest"), F.size("tags").cast("bigint").alias("tags"),
    )


@query("extract_tags_html")
def extract_tags_html(spark, folder):
    tags = tags_of(F.col("html"), None)
    return table(spark, folder, "pages").select("page_id", F.explode(tags).alias("tag", "content"))


@query("truncate_text", f"SELECT doc_id, {short('text')} AS text FROM documents")
def truncate_text(spark, folder):
    return table(spark, folder, "documents").select("doc_id", shortened(F.col("text")).alias("text"))


@query(
    "normalize_sample",
    f"""SELECT conv_id, turn, CASE WHEN role = 'user' THEN {short("text")} END AS note,
               CASE WHEN role = 'user' THEN NULL WHEN role = 'system' THEN 'x' ELSE {short("text")} END AS value,
               CASE WHEN role <> 'user' THEN 'hidden' END AS think, role AS speaker, role AS first_role,
               {short("text")} AS first_line
        FROM conversations""",
)
def normalize_sample(spark, folder):
    think = F.lit("<think> hidden </think>")
    note = F.when(F.col("role") == "user", F.col("text")).otherwise(F.concat(think, "text"))
    rows = table(spark, folder, "conversations").select(
        "conv_id", "turn", note.alias("note"),
        F.struct(F.col("role").alias("speaker"), F.when(F.col("role") == "system", "<think>hidden</think>x")
                 .otherwise(F.lit("plain")).alias("detail")).alias("meta"),
        F.array(F.struct("role", F.struct("text").alias("inner"))).alias("turns"),
    )
    flat = normalize(rows, tags=["think"])
    return flat.select(
        "conv_id", "turn", "note", "value", "think", "speaker", F.col("turns")[0]["role"].alias("first_role"),
        F.col("turns")[0]["text"].alias("first_line"),
    )


@query(
    "lift_tags",
    f"""SELECT '{{' || CASE WHEN role = 'assistant' THEN '"assistant":"v",' ELSE '' END
               || '"b":"x<think>t</think>y","conv_id":' || conv_id || ',"list":["p",{{"k":"q","value":"r"}},{{"k":"last"}}],"role":"' || role || '"'
               || CASE WHEN role = 'system' THEN ',"system":"v"' ELSE '' END || ',"turn":' || turn
               || CASE WHEN role = 'user' THEN ',"user":"v"' ELSE '' END || ',"value":"rest"}}' AS sample
        FROM conversations""",
)
def lift_all_tags(spark, folder):
    """Tags of names that differ by row, outer pairs first, in objects and in arrays."""
    text = F.concat(F.lit("<b>x<think>t</think>y</b>rest<"), "role", F.lit("> v </"), "role", F.lit(">"))
    items = F.array(F.lit("p"), F.lit("<k>q</k>r"), F.lit("<k>first</k><k>last</k>"))
    rows = table(spark, folder, "conversations").select("conv_id", "turn", "role", F.struct(text.alias("note")).alias("inner"), items.alias("list"))
    return lift_tags(rows).select(F.to_json("sample").alias("sample"))


@query(
    "json_fallback",
    """SELECT o_orderkey, '{"c":' || o_custkey || ',"s":"' || o_orderstatus || '"}' AS customer,
              '["' || o_orderstatus || '","' || o_orderpriority || '"]' AS tags FROM orders""",
)
def json_fallback(spark, folder):
    customer = F.struct(F.col("o_custkey").alias("c"), F.col("o_orderstatus").alias("s")).alias("customer")
    rows = table(spark, folder, "orders").select(
        "o_orderkey", customer, F.array("o_orderstatus", "o_orderpriority").alias("tags")
    )
    return as_json(rows)


@query(
    "dataset_key",
    """SELECT event_id, 'v1__' || event_type || '__u' || user_id || '__' || strftime(ts, '%Y%m%d%H%M') AS key
       FROM events""",
)
def dataset_key(spark, folder):
    user = F.concat(F.lit("u"), F.col("user_id").cast("string"))
    key = key_of(F.lit("v1"), F.col("event_type"), user, stamp=F.col("ts"))
    return table(spark, folder, "events").select("event_id", key.alias("key"))



"""Validation against JSON Schemas, and schema inference."""

from __future__ import annotations

import json

from pyspark.sql import functions as F

from loomrow.operators.inference import field_presence, inspect_json, json_field_types
from loomrow.operators.mapping import map_and_validate as mapped_and_checked
from loomrow.operators.validation import dataset_eligible as eligible
from loomrow.operators.validation import error_rows
from loomrow.operators.validation import validate_rows as checked_rows
from loomrow.operators.validation import validate_source as checked_source
from loomrow.operators.validation import validation_report as report
from loomrow.resources import chat_schema

from .mapping import props
from .registry import CHAT_MAPPING, TURNS, chat_rows, query, table

TURN_SCHEMA = {
    "type": "object",
    "properties": {
        "role": {"type": "string", "enum": ["user", "assistant"]},
        "conversations": {
            "type": "array",
            "maxItems": 8,
            "items": {
                "type": "object",
                "properties": {
                    "from": {"type": "string", "enum": ["human", "gpt"]},
                    "value": {"type": "string", "minLength": 20, "pattern": "[a-z]"},
                    "think": {"type": "string"},
                },
                "required": ["from", "value", "think"],
            },
        },
    },
    "required": ["role", "conversations"],
}

TURN_ERRORS = f"""
    SELECT conv_id, turn, 'role' AS path, 'enum' AS keyword FROM conversations
    WHERE role NOT IN ('user', 'assistant')
    UNION ALL
    SELECT conv_id, turn, 'conversations', 'maxItems' FROM conversations
    WHERE len(string_split(text, chr(10))) > 8
    UNION ALL
    SELECT conv_id, turn, 'conversations.' || i || '.from', 'enum' FROM ({TURNS}) WHERE speaker = 'system'
    UNION ALL
    SELECT conv_id, turn, 'conversations.' || i || '.value', 'minLength' FROM ({TURNS}) WHERE length(value) < 20
    UNION ALL
    SELECT conv_id, turn, 'conversations.' || i || '.value', 'pattern' FROM ({TURNS})
    WHERE NOT regexp_matches(value, '[a-z]')
    UNION ALL
    SELECT conv_id, turn, 'conversations.' || i, 'required' FROM ({TURNS}) WHERE think IS NULL
"""


def checked_turns(spark, folder):
    return checked_rows(chat_rows(spark, folder), TURN_SCHEMA)


@query("validate_rows", TURN_ERRORS)
def validate_rows(spark, folder):
    return error_rows(checked_turns(spark, folder), ["conv_id", "turn"]).drop("message")


@query(
    "validation_report",
    f"SELECT path, keyword, CAST(count(*) AS BIGINT) AS n FROM ({TURN_ERRORS}) GROUP BY path, keyword",
)
def validation_report(spark, folder):
    return report(checked_turns(spark, folder)).select("path", "keyword", "n")


@query(
    "validation_summary",
    f"""SELECT regexp_replace(path, '^conversations[.][0-9]+', 'conversations[]') AS path, keyword, CAST(count(*) AS BIGINT) AS n,
               any_value(CASE WHEN path = 'role' THEN 'is not one of [''user'', ''assistant'']'
                              WHEN keyword = 'enum' THEN 'is not one of [''human'', ''gpt'']'
                              WHEN keyword = 'maxItems' THEN 'has more items than 8'
                              WHEN keyword = 'minLength' THEN 'is shorter than 20'
                              WHEN keyword = 'pattern' THEN 'does not match [a-z]'
                              ELSE '''think'' is a required property' END) AS example
        FROM ({TURN_ERRORS}) GROUP BY 1, 2""",
)
def validation_summary(spark, folder):
    return report(checked_turns(spark, folder), positions=False)


@query(
    "map_and_validate",
    """SELECT conv_id, turn, role <> 'system' AS valid, CASE WHEN role = 'system' THEN 'messages.0' END AS path,
              CASE WHEN role = 'system' THEN 'required' END AS keyword
       FROM conversations""",
)
def map_and_validate(spark, folder):
    turns = F.when(F.col("role") != "system", F.col("conversations")).alias("conversations")
    source = chat_rows(spark, folder).select("conv_id", "turn", turns)
    checked = mapped_and_checked(source, CHAT_MAPPING, chat_schema(), keep=["conv_id", "turn"])
    first = F.get("_errors", 0)
    return checked.select(
        "conv_id", "turn", F.col("_valid").alias("valid"), first["path"].alias("path"), first["keyword"].alias("keyword")
    )


@query("dataset_eligible", "SELECT false AS eligible, CAST(count(*) AS BIGINT) AS checked_rows FROM orders")
def dataset_eligible(spark, folder):
    schema = props(o_orderstatus={"enum": ["F", "O"]}, o_orderkey={"type": "integer", "minimum": 0})
    return eligible(table(spark, folder, "orders"), schema)


@query("dataset_eligible_all", "SELECT true AS eligible, CAST(count(*) AS BIGINT) AS checked_rows FROM orders")
def dataset_eligible_all(spark, folder):
    """The same where every row satisfies the schema."""
    schema = props(o_orderstatus={"enum": ["F", "O", "P"]}, o_orderkey={"type": "integer", "minimum": 0})
    return eligible(table(spark, folder, "orders"), schema)


@query(
    "validate_source",
    """SELECT o_orderkey, 'o_orderstatus' AS path, 'enum' AS keyword FROM orders WHERE o_orderstatus NOT IN ('F', 'O')
       UNION ALL SELECT o_orderkey, 'o_totalprice', 'maximum' FROM orders WHERE o_totalprice > 400000
       UNION ALL SELECT o_orderkey, 'o_totalprice', 'type' FROM orders WHERE o_totalprice <> floor(o_totalprice)
       UNION ALL SELECT o_orderkey, '', 'required' FROM orders
       UNION ALL SELECT o_orderkey, 'o_custkey', 'anyOf' FROM orders WHERE o_custkey BETWEEN 100 AND 500""",
)
def validate_source(spark, folder):
    schema = props(
        o_orderstatus={"type": "string", "enum": ["F", "O"]},
        o_totalprice={"type": "integer", "maximum": 400000},
        o_custkey={"anyOf": [{"maximum": 99}, {"minimum": 501}]},
    )
    schema["required"] = ["o_orderstatus", "clerk"]
    found = checked_source(table(spark, folder, "orders"), schema)
    return error_rows(found, ["o_orderkey"]).drop("message")


#: a tree without a bound: a node has a name, children that are nodes, and next another node or null
TREE_SCHEMA = {
    "type": "object",
    "properties": {"tree": {"$ref": "#/definitions/node"}},
    "definitions": {
        "node": {
            "type": "object",
            "required": ["name"],
            "properties": {
                "name": {"type": "string", "enum": ["F", "O", "x"]},
                "children": {"type": "array", "items": {"$ref": "#/definitions/node"}},
                "next": {"anyOf": [{"type": "null"}, {"$ref": "#/definitions/node"}]},
            },
        }
    },
}

#: orders as trees: the deeper the larger the key modulo 9, a leaf beside each level, a chain of two nodes at the end
TREES = """
    SELECT o_orderkey, o_orderkey % 9 AS depth, o_orderstatus, o_orderpriority LIKE '1%' AS urgent, o_custkey % 3 = 0 AS unnamed
    FROM orders
"""


@query(
    "validate_recursive",
    f"""WITH t AS ({TREES}), l AS (SELECT *, unnest(range(depth)) AS i FROM t)
        SELECT o_orderkey, 'tree.' || repeat('children.1.', depth::INT) || 'name' AS path, 'enum' AS keyword
        FROM t WHERE o_orderstatus = 'P'
        UNION ALL SELECT o_orderkey, 'tree.' || repeat('children.1.', i::INT) || 'children.0.name', 'type' FROM l WHERE urgent
        UNION ALL SELECT o_orderkey, 'tree.' || repeat('children.1.', i::INT) || 'children.0.name', 'enum' FROM l WHERE urgent
        UNION ALL SELECT o_orderkey, 'tree.' || repeat('children.1.', depth::INT) || 'next', 'anyOf' FROM t WHERE unnamed""",
)
def validate_recursive(spark, folder):
    """Every order as a tree of up to ten levels, checked in one pass without a shuffle."""
    depth = (F.col("o_orderkey") % 9).cast("int")
    side = F.when(F.col("o_orderpriority").startswith("1"), '{"name":1}').otherwise('{"name":"x"}')
    last = F.when(F.col("o_custkey") % 3 == 0, '{"next":null}').otherwise('{"name":"x"}')
    leaf = F.concat(F.lit('{"name":"'), "o_orderstatus", F.lit('","next":{"name":"x","next":'), last, F.lit("}}"))
    text = F.concat(
        F.repeat(F.concat(F.lit('{"name":"x","children":['), side, F.lit(",")), depth), leaf, F.repeat(F.lit("]}"), depth)
    )
    trees = table(spark, folder, "orders").select("o_orderkey", F.parse_json(text).alias("tree"))
    return error_rows(checked_rows(trees, TREE_SCHEMA), ["o_orderkey"]).drop("message")


#: every keyword that looks at keys, or depends on another: on typed columns, and on an object whose keys differ by row
KEYED_SCHEMA = props(
    o_orderkey={"if": {"multipleOf": 2}, "then": {"maximum": 2000}, "else": {"minimum": 100}},
    parts={"items": [{"enum": ["F", "O"]}, {"minLength": 6}], "additionalItems": {"maxLength": 4}, "contains": {"pattern": "^[12]"}},
    short={"items": [{}], "additionalItems": False},
    doc={
        "patternProperties": {"^n_": {"type": "integer"}},
        "properties": {"status": {"const": "F"}},
        "additionalProperties": {"minLength": 8},
        "propertyNames": {"maxLength": 8},
        "dependencies": {"n_cust": ["n_order"], "status": {"required": ["priority"]}},
    },
    pair={"patternProperties": {"^a": {"maximum": 500}}, "additionalProperties": {"const": "F"}, "dependencies": {"a": ["z"]}},
)


@query(
    "validate_keyed",
    """WITH o AS (SELECT *, (o_orderkey % 7)::VARCHAR AS digit FROM orders)
       SELECT o_orderkey, 'o_orderkey' AS path, 'maximum' AS keyword FROM o WHERE o_orderkey % 2 = 0 AND o_orderkey > 2000
       UNION ALL SELECT o_orderkey, 'o_orderkey', 'minimum' FROM o WHERE o_orderkey % 2 = 1 AND o_orderkey < 100
       UNION ALL SELECT o_orderkey, 'parts.0', 'enum' FROM o WHERE o_orderstatus = 'P'
       UNION ALL SELECT o_orderkey, 'parts.1', 'minLength' FROM o WHERE length(o_orderpriority) < 6
       UNION ALL SELECT o_orderkey, 'parts.2', 'maxLength' FROM o WHERE length('c ' || o_custkey) > 4
       UNION ALL SELECT o_orderkey, 'parts', 'contains' FROM o
       WHERE NOT (regexp_matches(o_orderpriority, '^[12]') OR regexp_matches(o_orderstatus, '^[12]'))
       UNION ALL SELECT o_orderkey, 'short', 'additionalItems' FROM o WHERE o_orderkey % 7 > 1
       UNION ALL SELECT o_orderkey, 'doc.n_' || digit, 'type' FROM o WHERE o_orderkey % 7 >= 4
       UNION ALL SELECT o_orderkey, 'doc.status', 'const' FROM o WHERE o_orderstatus <> 'F' AND o_orderkey % 3 = 0
       UNION ALL SELECT o_orderkey, 'doc', 'required' FROM o WHERE o_orderkey % 3 = 0 AND o_orderkey % 5 <> 0
       UNION ALL SELECT o_orderkey, 'doc.priority', 'minLength' FROM o WHERE length(o_orderpriority) < 8 AND o_orderkey % 5 = 0
       UNION ALL SELECT o_orderkey, 'doc', 'maxLength' FROM o WHERE o_orderkey % 11 = 0
       UNION ALL SELECT o_orderkey, 'doc.too_long_a_key', 'minLength' FROM o WHERE o_orderkey % 11 = 0
       UNION ALL SELECT o_orderkey, 'doc', 'dependencies' FROM o WHERE o_orderkey % 2 = 0
       UNION ALL SELECT o_orderkey, 'pair.a', 'maximum' FROM o WHERE o_custkey > 500
       UNION ALL SELECT o_orderkey, 'pair.b', 'const' FROM o WHERE o_orderstatus <> 'F'
       UNION ALL SELECT o_orderkey, 'pair', 'dependencies' FROM o""",
)
def validate_keyed(spark, folder):
    key = F.col("o_orderkey")

    def member(condition, name, value):
        return F.when(condition, F.concat(F.lit('"'), name, F.lit('":'), value))

    def text(value):
        return F.concat(F.lit('"'), value, F.lit('"'))

    digit = (key % 7).cast("string")
    members = F.array_compact(F.array(
        member(F.lit(True), F.concat(F.lit("n_"), digit), F.when(key % 7 >= 4, '"x"').otherwise(digit)),
        member(key % 2 == 0, F.lit("n_cust"), F.lit("1")),
        member(key % 3 == 0, F.lit("status"), text(F.col("o_orderstatus"))),
        member(key % 5 == 0, F.lit("priority"), text(F.col("o_orderpriority"))),
        member(key % 11 == 0, F.lit("too_long_a_key"), F.lit('"s"')),
    ))
    rows = table(spark, folder, "orders").select(
        "o_orderkey",
        F.array("o_orderstatus", "o_orderpriority", F.concat(F.lit("c "), F.col("o_custkey").cast("string"))).alias("parts"),
        F.slice(F.array(F.lit(1), F.lit(2), F.lit(3)), 1, F.least(key % 7, F.lit(3)).cast("int")).alias("short"),
        F.parse_json(F.concat(F.lit("{"), F.array_join(members, ","), F.lit("}"))).alias("doc"),
        F.struct(F.col("o_custkey").alias("a"), F.col("o_orderstatus").alias("b")).alias("pair"),
    )
    return error_rows(checked_rows(rows, KEYED_SCHEMA), ["o_orderkey"]).drop("message")


def seen(path: str, kind: str, column: str, source: str) -> str:
    return f"""SELECT '{path}' AS path, '{kind}' AS type, coalesce(bool_or({column} IS NULL), false) AS null_seen,
                      coalesce(bool_or({column} IS NOT NULL), false) AS value_seen FROM {source}"""


@query(
    "infer_schema_typed",
    " UNION ALL ".join(
        [
            seen("$.conv_id", "integer", "conv_id", "conversations"),
            seen("$.turn", "integer", "turn", "conversations"),
            seen("$.role", "string", "nullif(role, 'system')", "conversations"),
            seen("$.conversations", "array", "text", "conversations"),
            seen("$.conversations[]", "object", "i", f"({TURNS})"),
            seen("$.conversations[].from", "string", "speaker", f"({TURNS})"),
            seen("$.conversations[].value", "string", "value", f"({TURNS})"),
            seen("$.conversations[].think", "string", "think", f"({TURNS})"),
        ]
    ),
)
def infer_schema_typed(spark, folder):
    rows = chat_rows(spark, folder).withColumn("role", F.nullif("role", F.lit("system")))
    return field_presence(rows)


def event_json(spark, folder):
    """Events as JSON text with keys that come and go and values of changing types."""
    doc = F.struct(
        "event_id", "event_type",
        F.when(F.col("event_type") == "click", F.struct("user_id", "value")).alias("click"),
        F.array(F.struct(F.col("user_id").alias("id"))).alias("users"),
    )
    text = F.to_json(doc)
    as_text = F.regexp_replace(text, r'"event_id":(\d+)', '"event_id":"$1"')
    return table(spark, folder, "events").select(
        F.when(F.col("event_type") == "error", as_text).otherwise(text).alias("doc")
    )


@query(
    "infer_schema_json",
    """WITH e AS (SELECT event_type, value, user_id FROM events)
       SELECT '$' AS path, 'object' AS type, CAST(count(*) AS BIGINT) AS n FROM e
       UNION ALL SELECT '$.event_id', 'string', count(*) FROM e WHERE event_type = 'error' HAVING count(*) > 0
       UNION ALL SELECT '$.event_id', 'integer', count(*) FROM e WHERE event_type <> 'error' HAVING count(*) > 0
       UNION ALL SELECT '$.event_type', 'string', count(*) FROM e
       UNION ALL SELECT '$.click', 'object', count(*) FROM e WHERE event_type = 'click'
       UNION ALL SELECT '$.click.user_id', 'integer', count(*) FROM e WHERE event_type = 'click'
       UNION ALL SELECT '$.click.value', 'number', count(*) FROM e WHERE event_type = 'click'
       UNION ALL SELECT '$.users', 'array', count(*) FROM e
       UNION ALL SELECT '$.users[]', 'object', count(*) FROM e
       UNION ALL SELECT '$.users[].id', 'integer', count(*) FROM e""",
)
def infer_schema_json(spark, folder):
    return json_field_types(event_json(spark, folder), "doc").select("path", "type", "n")


@query(
    "infer_schema_document",
    """WITH k AS (SELECT bool_or(event_type = 'error') AS texts, bool_or(event_type <> 'error') AS numbers,
                         bool_or(event_type = 'click') AS clicks, count(*) AS n FROM events)
       SELECT '{"$schema": "http://json-schema.org/schema#", "properties": {'
              || CASE WHEN clicks THEN '"click": {"properties": {"user_id": {"type": "integer"}, "value": {"type": "number"}}, '
                                       || '"required": ["user_id", "value"], "type": "object"}, ' ELSE '' END
              || '"event_id": {"type": ' || CASE WHEN texts AND numbers THEN '["integer", "string"]'
                                                 WHEN texts THEN '"string"' ELSE '"integer"' END || '}, '
              || '"event_type": {"type": "string"}, "users": {"items": {"properties": {"id": {"type": "integer"}}, '
              || '"required": ["id"], "type": "object"}, "type": "array"}}, '
              || '"required": ["event_id", "event_type", "users"], "type": "object"}' AS document,
              CAST(n AS BIGINT) AS n_values, CAST((SELECT count(*) FROM events WHERE event_id % 10 = 0) AS BIGINT) AS skipped
       FROM k""",
)
def infer_schema_document(spark, folder):
    """The whole document, of texts of which some are cut short or repeat a key."""
    good = event_json(spark, folder)
    broken = table(spark, folder, "events").where("event_id % 10 = 0").select(
        F.when(F.col("event_id") % 20 == 0, F.concat(F.lit('{"event_id":'), "event_id")).otherwise('{"a":1,"a":2}').alias("doc")
    )
    found = inspect_json(good.unionByName(broken), "doc")
    document = json.dumps(found.schema, sort_keys=True)
    return spark.createDataFrame([(document, found.values, found.skipped)], "document string, n_values long, skipped long")

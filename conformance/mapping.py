"""The declarative mapper."""

from __future__ import annotations

from pyspark.sql import functions as F

from loomrow.functions.registry import TransformRegistry
from loomrow.operators.mapping import apply_mapping, conform, map_dataset, preview_mapping
from loomrow.resources import chat_schema
from loomrow.session import work_folder
from loomrow.sources.readers import read_json_variant

from .registry import CHAT_MAPPING, TURNS, chat_rows, constant, entry, query, table


def props(**properties) -> dict:
    return {"type": "object", "properties": properties}


TEXT = {"type": ["string", "null"]}


@query(
    "map_conversations",
    f"""SELECT conv_id, turn, CAST(i AS BIGINT) AS pos, 'fc_chat_st' AS template,
               CASE speaker WHEN 'gpt' THEN 'ASSISTANT' ELSE 'USER' END AS role,
               value AS content, think, 'open_chat' AS _dataset_name, CAST(NULL AS VARCHAR) AS _lang
        FROM ({TURNS})""",
)
def map_conversations(spark, folder):
    mapped = apply_mapping(chat_rows(spark, folder), CHAT_MAPPING, chat_schema(), keep=["conv_id", "turn"])
    return mapped.select(
        "conv_id", "turn", "template", "_dataset_name", "_lang", F.posexplode_outer("messages").alias("pos", "m")
    ).select(
        "conv_id", "turn", F.col("pos").cast("bigint").alias("pos"), "template",
        "m.role", "m.content", "m.think", "_dataset_name", "_lang",
    )


@query(
    "map_json_lines",
    f"""SELECT conv_id, turn, CAST(i AS BIGINT) AS pos, value AS content, think,
               CASE speaker WHEN 'gpt' THEN 'ASSISTANT' ELSE 'USER' END AS role
        FROM ({TURNS})""",
)
def map_json_lines(spark, folder):
    """JSON Lines mapped as semi-structured values: no schema, no pass to find one."""
    target = work_folder(spark, "chat-lines")
    chat_rows(spark, folder).write.json(target)
    schema = chat_schema()
    schema["properties"].update(conv_id={"type": "integer"}, turn={"type": "integer"})
    mapping = [*CHAT_MAPPING, entry("conv_id", "conv_id"), entry("turn", "turn")]
    mapped = apply_mapping(read_json_variant(spark, target), mapping, schema, root="value")
    flat = mapped.select("conv_id", "turn", F.posexplode_outer("messages").alias("pos", "m"))
    return flat.select(
        "conv_id", "turn", F.col("pos").cast("bigint").alias("pos"), "m.role", "m.content", "m.think"
    )


PROMPT_MAPPING = [
    constant("template", "chat"),
    entry("prompt", "messages[0].content"),
    constant("messages[0].role", "USER"),
    entry("response", "messages[1].content"),
    constant("messages[1].role", "ASSISTANT"),
    entry("language", "_lang"),
    constant("_filename", "documents"),
]


def prompts(spark, folder):
    return table(spark, folder, "documents").select(
        "doc_id", F.col("text").alias("prompt"), F.col("source").alias("response"), F.col("lang").alias("language")
    )


@query(
    "map_prompt_response",
    """SELECT doc_id, 'chat' AS template, lang AS _lang, 'documents' AS _filename,
              CAST(NULL AS VARCHAR) AS system, CAST(2 AS BIGINT) AS n,
              'USER' AS role0, text AS content0, 'ASSISTANT' AS role1, source AS content1
       FROM documents""",
)
def map_prompt_response(spark, folder):
    mapped = apply_mapping(prompts(spark, folder), PROMPT_MAPPING, chat_schema(), keep=["doc_id"])
    m = F.col("messages")
    return mapped.select(
        "doc_id", "template", "_lang", "_filename", "system", F.size(m).cast("bigint").alias("n"),
        m[0]["role"].alias("role0"), m[0]["content"].alias("content0"),
        m[1]["role"].alias("role1"), m[1]["content"].alias("content1"),
    )


def nested_orders(spark, folder):
    o = table(spark, folder, "orders")
    tags = F.array("o_orderpriority", "o_orderstatus").alias("tags")
    return o.select(
        "o_orderkey", F.struct(F.col("o_custkey").alias("id"), tags).alias("customer"), "o_orderstatus"
    )


@query(
    "map_path_projection",
    """SELECT o_orderkey, o_custkey AS id, o_orderstatus AS second_tag, CAST(NULL AS VARCHAR) AS tenth_tag,
              CAST(NULL AS VARCHAR) AS no_key, CAST(NULL AS VARCHAR) AS not_an_object,
              CAST(NULL AS VARCHAR) AS every_tag
       FROM orders""",
)
def map_path_projection(spark, folder):
    mapping = [
        entry("customer.id", "id"),
        entry("customer.tags[1]", "second_tag"),
        entry("customer.tags[9]", "tenth_tag"),
        entry("customer.none", "no_key"),
        entry("o_orderstatus.x", "not_an_object"),
        entry("customer.tags[]", "every_tag"),
    ]
    schema = props(no_key=TEXT, not_an_object=TEXT, every_tag=TEXT)
    return apply_mapping(nested_orders(spark, folder), mapping, schema, keep=["o_orderkey"])


@query(
    "map_constants",
    """SELECT o_orderkey, 'en' AS _lang, CAST(7 AS BIGINT) AS n, CAST(7 AS BIGINT) AS from_text, 1.5 :: DOUBLE AS x,
              true AS flag, '12' AS as_text, CAST(NULL AS VARCHAR) AS nothing, 'null' AS word, 'b' AS second
       FROM orders""",
)
def map_constants(spark, folder):
    mapping = [
        constant("_lang", "en"),
        constant("n", 7),
        constant("from_text", "7"),
        entry("", "x", 1.5),
        entry(None, "flag", "YES"),
        constant("as_text", 12),
        constant("nothing", None),
        constant("word", "null"),
        constant("list", ["a", "b"]),
    ]
    schema = props(
        _lang=TEXT, n={"type": "integer"}, from_text={"type": "integer"}, x={"type": "number"},
        flag={"type": "boolean"}, as_text=TEXT, nothing=TEXT, word=TEXT,
        list={"type": "array", "items": {"type": "string"}},
    )
    mapped = apply_mapping(table(spark, folder, "orders"), mapping, schema, keep=["o_orderkey"])
    return mapped.withColumn("second", F.col("list")[1]).drop("list")


@query(
    "map_enum",
    """SELECT o_orderkey, CASE o_orderstatus WHEN 'F' THEN 'FINISHED' WHEN 'O' THEN 'OPEN' END AS status,
              CASE o_orderstatus WHEN 'F' THEN 1 WHEN 'P' THEN 2 END :: BIGINT AS code,
              CAST(NULL AS VARCHAR) AS by_number, 'k' || CAST(o_custkey % 1000 AS VARCHAR) AS large
       FROM orders""",
)
def map_enum(spark, folder):
    large = {str(n): f"k{n}" for n in range(1000)}
    mapping = [
        entry("o_orderstatus", "status", {"F": "FINISHED", "O": "OPEN"}),
        entry("o_orderstatus", "code", {"F": 1, "P": "2"}),
        entry("o_custkey", "by_number", {"1": "one"}),
        entry("customer_text", "large", large),
    ]
    schema = props(status=TEXT, code={"type": "integer"}, by_number=TEXT, large=TEXT)
    orders = table(spark, folder, "orders").withColumn(
        "customer_text", (F.col("o_custkey") % 1000).cast("string")
    )
    return apply_mapping(orders, mapping, schema, keep=["o_orderkey"])


@query(
    "map_static_array",
    """SELECT o_orderkey, CAST(3 AS BIGINT) AS n, o_orderpriority AS first_x, true AS gap, o_orderstatus AS third_x,
              'c' AS third_y, CAST(NULL AS VARCHAR) AS first_y
       FROM orders""",
)
def map_static_array(spark, folder):
    mapping = [
        entry("o_orderstatus", "m[2].x"), constant("m[2].y", "c"), entry("o_orderpriority", "m[0].x"),
    ]
    mapped = apply_mapping(table(spark, folder, "orders"), mapping, None, keep=["o_orderkey"])
    m = F.col("m")
    return mapped.select(
        "o_orderkey", F.size(m).cast("bigint").alias("n"), m[0]["x"].alias("first_x"), m[1].isNull().alias("gap"),
        m[2]["x"].alias("third_x"), m[2]["y"].alias("third_y"), m[0]["y"].alias("first_y"),
    )


@query(
    "map_dynamic_array",
    f"""SELECT conv_id, turn, CAST(i AS BIGINT) AS pos, value AS text,
               CASE i WHEN 0 THEN 'first' WHEN 1 THEN 'second' END AS mark, 'data' AS origin
        FROM ({TURNS})
        UNION ALL
        SELECT conv_id, turn, CAST(1 AS BIGINT), NULL, 'second', 'data'
        FROM conversations WHERE len(string_split(text, chr(10))) = 1""",
)
def map_dynamic_array(spark, folder):
    mapping = [
        constant("items[0].mark", "first"),
        constant("items[1].mark", "second"),
        constant("items[1].text", None),
        entry("conversations[].value", "items[].text"),
        constant("origin", "data"),
    ]
    mapped = apply_mapping(chat_rows(spark, folder), mapping, None, keep=["conv_id", "turn"])
    flat = mapped.select("conv_id", "turn", "origin", F.posexplode_outer("items").alias("pos", "item"))
    return flat.select(
        "conv_id", "turn", F.col("pos").cast("bigint").alias("pos"), "item.text", "item.mark", "origin"
    )


@query(
    "map_zip_arrays",
    """SELECT conv_id, turn, CAST(generate_subscripts(list_resize(a, greatest(len(a), len(b))), 1) - 1 AS BIGINT) AS pos,
              unnest(list_resize(a, greatest(len(a), len(b)))) AS line,
              unnest(list_resize(b, greatest(len(a), len(b)))) AS sentence
       FROM (SELECT conv_id, turn, string_split(text, chr(10)) AS a, string_split(text, '. ') AS b
             FROM conversations)""",
)
def map_zip_arrays(spark, folder):
    def named(parts, key):
        return F.transform(parts, lambda x: F.struct(x.alias(key)))

    source = table(spark, folder, "conversations").select(
        "conv_id", "turn",
        named(F.split("text", "\n"), "x").alias("a"), named(F.split("text", r"\. "), "y").alias("b"),
    )
    mapping = [entry("a[].x", "m[].line"), entry("b[].y", "m[].sentence")]
    mapped = apply_mapping(source, mapping, None, keep=["conv_id", "turn"])
    flat = mapped.select("conv_id", "turn", F.posexplode_outer("m").alias("pos", "m"))
    return flat.select("conv_id", "turn", F.col("pos").cast("bigint").alias("pos"), "m.line", "m.sentence")


def words(spark, folder):
    lines = F.transform(
        F.split("text", "\n"),
        lambda line: F.struct(F.transform(F.split(line, " "), lambda w: F.struct(w.alias("word"))).alias("words")),
    )
    return table(spark, folder, "conversations").select("conv_id", "turn", lines.alias("lines"))


@query(
    "map_nested_diagonal",
    f"""SELECT conv_id, turn, CAST(i AS BIGINT) AS pos, string_split(value, ' ')[i + 1] AS word
        FROM ({TURNS})""",
)
def map_nested_diagonal(spark, folder):
    mapping = [entry("lines[].words[].word", "m[].word")]
    mapped = apply_mapping(words(spark, folder), mapping, None, keep=["conv_id", "turn"])
    flat = mapped.select("conv_id", "turn", F.posexplode_outer("m").alias("pos", "m"))
    return flat.select("conv_id", "turn", F.col("pos").cast("bigint").alias("pos"), "m.word")


@query(
    "map_nested_full",
    f"""SELECT conv_id, turn, CAST(i AS BIGINT) AS line, unnest(string_split(value, ' ')) AS word,
               CAST(generate_subscripts(string_split(value, ' '), 1) - 1 AS BIGINT) AS pos
        FROM ({TURNS})""",
)
def map_nested_full(spark, folder):
    mapping = [entry("lines[].words[].word", "m[].parts[].word")]
    mapped = apply_mapping(words(spark, folder), mapping, None, keep=["conv_id", "turn"], nested="full")
    lines = mapped.select("conv_id", "turn", F.posexplode_outer("m").alias("line", "m"))
    flat = lines.select("conv_id", "turn", "line", F.posexplode_outer("m.parts").alias("pos", "p"))
    return flat.select(
        "conv_id", "turn", F.col("line").cast("bigint").alias("line"), F.col("pos").cast("bigint").alias("pos"), "p.word"
    )


@query(
    "map_scalar_array",
    """SELECT o_orderkey, CAST(pos AS BIGINT) AS pos, CASE pos WHEN 0 THEN o_orderkey END AS label,
              CASE pos WHEN 0 THEN NULL ELSE 'labels.' || pos END AS failed
       FROM orders, (VALUES (0), (1), (2)) v(pos)""",
)
def map_scalar_array(spark, folder):
    tags = F.array(F.col("o_orderkey").cast("string"), "o_orderpriority", "o_orderstatus").alias("tags")
    schema = props(labels={"type": "array", "items": {"type": "integer"}})
    source = table(spark, folder, "orders").select("o_orderkey", tags)
    mapped = apply_mapping(source, [entry("tags[]", "labels[]")], schema, keep=["o_orderkey"], errors=True)
    flat = mapped.select("o_orderkey", "_errors", F.posexplode_outer("labels").alias("pos", "label"))
    path = F.concat(F.lit("labels."), F.col("pos").cast("string"))
    failed = F.exists("_errors", lambda e: e["path"] == path)
    return flat.select("o_orderkey", F.col("pos").cast("bigint").alias("pos"), "label", F.when(failed, path).alias("failed"))


@query(
    "map_cast",
    """SELECT l_orderkey, l_linenumber, CAST(trunc(l_extendedprice) AS BIGINT) AS price_whole,
              CAST(l_extendedprice AS VARCHAR) AS price_text, CAST(l_orderkey AS VARCHAR) AS key_text,
              l_linenumber :: DOUBLE AS line_number, l_discount <> 0 AS discounted,
              CASE WHEN l_returnflag = 'R' THEN 'True' ELSE 'False' END AS returned_text,
              CASE WHEN l_returnflag = 'R' THEN 1 ELSE 0 END :: BIGINT AS returned_whole,
              CAST(NULL AS BIGINT) AS flag_whole, CAST(NULL AS DOUBLE) AS flag_number,
              false AS flag_boolean, CAST(l_extendedprice * 1000000 AS VARCHAR) AS large_text,
              CAST(2 AS BIGINT) AS failures
       FROM lineitem""",
)
def map_cast(spark, folder):
    source = table(spark, folder, "lineitem").select(
        "l_orderkey", "l_linenumber", "l_extendedprice", "l_discount", "l_returnflag",
        (F.col("l_returnflag") == "R").alias("returned"), (F.col("l_extendedprice") * 1000000).alias("large"),
    )
    mapping = [
        entry("l_extendedprice", "price_whole"), entry("l_extendedprice", "price_text"),
        entry("l_orderkey", "key_text"), entry("l_linenumber", "line_number"), entry("l_discount", "discounted"),
        entry("returned", "returned_text"), entry("returned", "returned_whole"),
        entry("l_returnflag", "flag_whole"), entry("l_returnflag", "flag_number"),
        entry("l_returnflag", "flag_boolean"), entry("large", "large_text"),
    ]
    whole, number, boolean = {"type": "integer"}, {"type": "number"}, {"type": "boolean"}
    schema = props(
        price_whole=whole, price_text=TEXT, key_text=TEXT, line_number=number, discounted=boolean,
        returned_text=TEXT, returned_whole=whole, flag_whole=whole, flag_number=number, flag_boolean=boolean,
        large_text=TEXT,
    )
    mapped = apply_mapping(source, mapping, schema, keep=["l_orderkey", "l_linenumber"], errors=True)
    return mapped.withColumn("failures", F.size("_errors").cast("bigint")).drop("_errors")


@query(
    "map_defaults",
    """SELECT o_orderkey, coalesce(CASE o_orderstatus WHEN 'F' THEN 'DONE' END, 'OPEN') AS status,
              coalesce(nullif(o_orderpriority, '1-URGENT'), 'none') AS priority, 'v1' AS release,
              CAST(NULL AS VARCHAR) AS remark, o_custkey AS owner_id, 'x' AS owner_kind,
              o_orderstatus AS tag_name, CAST(3 AS BIGINT) AS tag_weight
       FROM orders""",
)
def map_defaults(spark, folder):
    source = table(spark, folder, "orders").select(
        "o_orderkey", "o_orderstatus", F.nullif("o_orderpriority", F.lit("1-URGENT")).alias("priority"),
        F.struct(F.col("o_custkey").alias("id")).alias("owner"),
        F.array(F.struct(F.col("o_orderstatus").alias("name"))).alias("tags"),
    )
    mapping = [
        entry("o_orderstatus", "status", {"F": "DONE"}), entry("priority", "priority"),
        entry("owner", "owner"), entry("tags", "tags"),
    ]
    owner = props(id={"type": "integer"}, kind={"type": "string", "enum": ["x", "y"]})
    tag = props(name=TEXT, weight={"type": "integer", "default": 3})
    schema = props(
        status={"type": "string", "enum": ["OPEN", "DONE"]}, priority={"type": "string", "default": "none"},
        release={"type": "string", "default": "v1"}, remark=TEXT, owner=owner,
        tags={"type": "array", "items": tag},
    )
    mapped = apply_mapping(source, mapping, schema, keep=["o_orderkey"])
    return mapped.select(
        "o_orderkey", "status", "priority", "release", "remark", F.col("owner.id").alias("owner_id"),
        F.col("owner.kind").alias("owner_kind"), F.col("tags")[0]["name"].alias("tag_name"),
        F.col("tags")[0]["weight"].alias("tag_weight"),
    )


@query(
    "map_dummy_mode",
    """SELECT o_orderkey, o_orderstatus AS status, '' AS name, CAST(0 AS BIGINT) AS n, 0 :: DOUBLE AS x, false AS flag,
              CAST(2 AS BIGINT) AS items
       FROM orders""",
)
def map_dummy_mode(spark, folder):
    schema = props(
        status=TEXT, name={"type": "string"}, n={"type": "integer"}, x={"type": "number"},
        flag={"type": "boolean"}, list={"type": "array", "minItems": 2, "items": {"type": "string"}},
    )
    schema["required"] = ["name", "n", "x", "flag", "list"]
    mapping = [entry("o_orderstatus", "status")]
    mapped = apply_mapping(table(spark, folder, "orders"), mapping, schema, keep=["o_orderkey"], dummy=True)
    return mapped.withColumn("items", F.size("list").cast("bigint")).drop("list")


@query(
    "map_registered_transform",
    """SELECT o_orderkey, lower(o_orderpriority) AS lowered, o_orderstatus AS copied, 'USER' AS fixed,
              o_orderpriority AS described
       FROM orders""",
)
def map_registered_transform(spark, folder):
    registry = TransformRegistry()
    registry.register("lower_case", F.lower)
    mapping = [
        entry("o_orderpriority", "lowered", "lower_case"), entry("o_orderstatus", "copied", "src"),
        entry("o_orderstatus", "fixed", "USER"), entry("o_orderpriority", "described", "just a copy"),
    ]
    return apply_mapping(
        table(spark, folder, "orders"), mapping, None, keep=["o_orderkey"], registry=registry, dispatch=True
    )


@query(
    "conform_to_schema",
    """SELECT CAST(o_orderkey AS VARCHAR) AS o_orderkey, CAST(trunc(o_totalprice) AS BIGINT) AS o_totalprice,
              o_orderstatus, 'eur' AS currency, CAST(NULL AS DOUBLE) AS discount
       FROM orders""",
)
def conform_to_schema(spark, folder):
    schema = props(
        o_orderkey={"type": "string"}, o_totalprice={"type": "integer"}, o_orderstatus=TEXT,
        currency={"type": "string", "enum": ["eur", "usd"]}, discount={"type": ["number", "null"]},
    )
    return conform(table(spark, folder, "orders"), schema)


@query("map_dataset_stats", "SELECT CAST(count(*) AS BIGINT) AS rows FROM conversations")
def map_dataset_stats_query(spark, folder):
    source, target = work_folder(spark, "chat"), work_folder(spark, "chat-mapped")
    rows = chat_rows(spark, folder)
    rows.write.parquet(source)
    run = map_dataset(spark, source, target, CHAT_MAPPING, chat_schema(), source_schema=rows.schema)
    return run.per_file.agg(F.sum("rows").alias("rows"))


#: an event as a line of text: good, with a key in two spellings, with a value that is no number, or not one object
ODD_LINES = """
    SELECT event_id, event_type, event_id % 7 AS kind,
           CASE event_id % 7
               WHEN 0 THEN '{"id":' || event_id || '} junk'
               WHEN 1 THEN '[{"id":' || event_id || '}]'
               WHEN 2 THEN '{"id":' || event_id || ',"id":0}'
               WHEN 3 THEN '{"id":"e' || event_id || '","Type":"' || event_type || '"}'
               WHEN 4 THEN '{"id":' || event_id || ',"type":"lower","Type":"' || event_type || '"}'
               WHEN 5 THEN '{"id":' || event_id || '},{"id":1}'
               ELSE '{"id":' || event_id || '}' END AS line
    FROM events
"""


def name_as_lines(spark, folder):
    """Files of the text writer end as files of JSON Lines do."""
    pattern = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{folder}/part-*")
    files = pattern.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    for found in files.globStatus(pattern):
        files.rename(found.getPath(), found.getPath().suffix(".jsonl"))


@query(
    "map_odd_lines",
    f"""SELECT CASE WHEN kind IN (0, 1, 2, 5) THEN 'refused' WHEN kind = 3 THEN 'flawed' ELSE 'mapped' END AS outcome,
               CASE WHEN kind IN (4, 6) THEN event_id END AS key, CASE WHEN kind IN (3, 4) THEN event_type END AS upper_type,
               CASE WHEN kind = 4 THEN 'lower' END AS lower_type,
               CASE WHEN kind IN (0, 1, 2, 5) THEN line END AS line, CASE WHEN kind = 3 THEN 'key' END AS flaw
        FROM ({ODD_LINES})""",
)
def map_odd_lines(spark, folder):
    """A whole job over lines of which most are odd: all of them come out, in one pass; keys differ by case alone."""
    source, target = work_folder(spark, "odd-lines"), work_folder(spark, "odd-mapped")
    key, kind = F.col("event_id").cast("string"), F.col("event_id") % 7

    def around(*parts):
        return F.concat(*[F.lit(part) if isinstance(part, str) else part for part in parts])

    named = F.col("event_type")
    line = (
        F.when(kind == 0, around('{"id":', key, "} junk")).when(kind == 1, around('[{"id":', key, "}]"))
        .when(kind == 2, around('{"id":', key, ',"id":0}')).when(kind == 3, around('{"id":"e', key, '","Type":"', named, '"}'))
        .when(kind == 4, around('{"id":', key, ',"type":"lower","Type":"', named, '"}'))
        .when(kind == 5, around('{"id":', key, '},{"id":1}')).otherwise(around('{"id":', key, "}"))
    )
    table(spark, folder, "events").select(line.alias("value")).write.text(source)
    name_as_lines(spark, source)
    schema = props(key={"type": "integer"}, upper_type=TEXT, lower_type=TEXT)
    mapping = [entry("id", "key"), entry("Type", "upper_type"), entry("type", "lower_type")]
    map_dataset(spark, source, target, mapping, schema, by_outcome=True)
    flaw = F.get("_errors", 0)["path"]
    return spark.read.parquet(target).select(
        F.col("_outcome").alias("outcome"), "key", "upper_type", "lower_type", F.col("_line").alias("line"), flaw.alias("flaw")
    )


@query(
    "map_preview",
    """SELECT doc_id, source AS before, source AS after, 'chat' AS template FROM documents ORDER BY doc_id LIMIT 5""",
)
def map_preview(spark, folder):
    shown = preview_mapping(prompts(spark, folder), PROMPT_MAPPING, chat_schema(), 5, order_by=["doc_id"])
    return shown.select(
        F.col("source.doc_id").alias("doc_id"), F.col("source.response").alias("before"),
        F.col("target.messages")[1]["content"].alias("after"), F.col("target.template").alias("template"),
    )

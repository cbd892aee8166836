"""Scans, discovery and sinks. Files are derived from the test tables in the session's work folder."""

from __future__ import annotations

from pyspark.sql import functions as F

from loomrow.operators.catalog import list_target_schemas as target_schemas
from loomrow.operators.catalog import read_documents
from loomrow.operators.mapping import apply_mapping
from loomrow.operators.query import run_sql
from loomrow.session import work_folder
from loomrow.sinks import files as sinks
from loomrow.sources import discovery, readers

from .registry import CHAT_MAPPING, TURNS, chat_rows, day, query, table
from .text import short

ORDER_COLUMNS = "o_orderkey bigint, o_orderpriority string, o_totalprice double"
ORDERS = "SELECT o_orderkey, o_orderpriority, o_totalprice FROM orders"
TALK = "SELECT conv_id, turn, role, text FROM conversations"
TALK_COLUMNS = "conv_id bigint, turn bigint, role string, text string"


def orders(spark, folder):
    return table(spark, folder, "orders").select("o_orderkey", "o_orderpriority", "o_totalprice")


@query(
    "scan_parquet",
    "SELECT o_orderkey, o_totalprice, CAST(CAST(o_orderdate AS DATE) AS VARCHAR) AS day FROM orders WHERE o_orderstatus = 'F'",
)
def scan_parquet(spark, folder):
    rows = readers.read_parquet(spark, f"{folder}/orders.parquet").where(F.col("o_orderstatus") == "F")
    return rows.select("o_orderkey", "o_totalprice", day("o_orderdate").alias("day"))


@query(
    "scan_glob",
    "SELECT o_orderkey, o_totalprice, o_orderstatus FROM orders WHERE o_orderstatus IN ('F', 'O')",
)
def scan_glob(spark, folder):
    """Some of the folders below one, by a pattern."""
    target = work_folder(spark, "globbed")
    table(spark, folder, "orders").select("o_orderkey", "o_totalprice", F.col("o_orderstatus").alias("s"), "o_orderstatus").write.partitionBy("s").parquet(target)
    return readers.read_parquet(spark, f"{target}/s=[FO]*/*.parquet")


@query("scan_jsonl", TALK)
def scan_jsonl(spark, folder):
    target = work_folder(spark, "jsonl")
    table(spark, folder, "conversations").write.json(target)
    return readers.quarantine(readers.read_json_lines(spark, target, schema=TALK_COLUMNS))[0]


@query("scan_jsonl_gz", TALK)
def scan_jsonl_gz(spark, folder):
    target = work_folder(spark, "jsonl-gz")
    table(spark, folder, "conversations").write.option("compression", "gzip").json(target)
    return readers.quarantine(readers.read_json_lines(spark, target, schema=TALK_COLUMNS))[0]


@query("scan_csv", TALK)
def scan_csv(spark, folder):
    target = work_folder(spark, "csv")
    sinks.export_csv(table(spark, folder, "conversations"), target)
    return readers.read_csv(spark, target, schema=TALK_COLUMNS, multi_line=True)


@query("scan_tsv", ORDERS)
def scan_tsv(spark, folder):
    target = work_folder(spark, "tsv")
    orders(spark, folder).write.option("header", "true").option("sep", "\t").csv(target)
    return readers.read_tsv(spark, target, schema=ORDER_COLUMNS)


@query(
    "discover_files",
    """SELECT DISTINCT 'a' AS folder, 'parquet' AS kind FROM orders
       UNION ALL SELECT DISTINCT 'b/c' AS folder, 'json' AS kind FROM orders""",
)
def discover_files(spark, folder):
    target = work_folder(spark, "mixed")
    orders(spark, folder).write.parquet(f"{target}/a")
    orders(spark, folder).write.json(f"{target}/b/c")
    orders(spark, folder).write.csv(f"{target}/d")
    # the files' own names and number are the writers' choice: what is compared is where which kind was found
    name = "/mixed-[^/]+/(.+)/[^/]+[.]([a-z]+)$"
    parts = [F.regexp_extract("path", name, i).alias(n) for i, n in ((1, "folder"), (2, "kind"))]
    return discovery.discover_files(spark, target).select(*parts).distinct()


@query(
    "discover_datasets",
    """SELECT DISTINCT 'v1' AS version, 'l_lang=' || lang AS dataset, 's_source=' || source AS subpath
       FROM documents WHERE lang LIKE '%e%' AND source LIKE '%rc1%'""",
)
def discover_datasets(spark, folder):
    base = work_folder(spark, "datasets")
    docs = table(spark, folder, "documents").select(
        "doc_id", F.col("lang").alias("l_lang"), F.col("source").alias("s_source")
    )
    docs.write.partitionBy("l_lang", "s_source").parquet(f"{base}/v1")
    found = discovery.discover_datasets(spark, base, version="V", dataset="E", subpath="RC1")
    return found.select("version", "dataset", "subpath")


@query("sample_rows", f"SELECT doc_id, lang, {short('text')} AS text FROM documents ORDER BY doc_id LIMIT 20")
def sample_rows(spark, folder):
    target = work_folder(spark, "samples")
    table(spark, folder, "documents").select("doc_id", "lang", "text").orderBy("doc_id").write.json(target)
    return readers.sample_rows(spark, target, 20).select("doc_id", "lang", "text")


@query(
    "quarantine_bad_rows",
    """SELECT CASE WHEN event_type <> 'error' THEN event_id END AS event_id,
              CASE WHEN event_type <> 'error' THEN event_type END AS event_type,
              CASE WHEN event_type = 'error' THEN '{"event_id":' || event_id || ',"event_ty' END AS bad_line
       FROM events""",
)
def quarantine_bad_rows(spark, folder):
    target = work_folder(spark, "broken")
    text = F.to_json(F.struct("event_id", "event_type"))
    cut = F.regexp_replace(text, r'(,"event_ty).*', "$1")
    broken = F.when(F.col("event_type") == "error", cut).otherwise(text)
    table(spark, folder, "events").select(broken.alias("value")).write.text(target)
    schema = "event_id bigint, event_type string"
    good, bad = readers.quarantine(readers.read_json_lines(spark, target, schema=schema, pattern="*.txt"))
    return good.withColumn("bad_line", F.lit(None).cast("string")).unionByName(
        bad.select(F.col(readers.BAD_LINE).alias("bad_line")), allowMissingColumns=True
    )


@query(
    "catalog_scan",
    """SELECT 'v1' AS version, lang AS dataset, source AS subpath, '202501010000' AS ts,
              'base/v1/' || lang || '/' || source AS doc_id, CAST(count(*) AS VARCHAR) AS records, '[]' AS mapping
       FROM documents GROUP BY lang, source""",
)
def catalog_scan(spark, folder):
    target = work_folder(spark, "documents")
    groups = table(spark, folder, "documents").groupBy("lang", "source").agg(F.count("*").alias("n"))
    documents = groups.select(
        F.concat_ws("__", F.lit("v1"), "lang", "source", F.lit("202501010000")).alias("name"),
        F.concat_ws("/", F.lit("base/v1"), "lang", "source").alias("doc_id"),
        F.create_map(F.lit("_records"), F.col("n").cast("string")).alias("metadata"),
        F.array().cast("array<string>").alias("mapping"),
    )
    documents.write.partitionBy("name").json(target)
    found = read_documents(spark, target)
    return found.select(
        "version", "dataset", "subpath", "ts", "doc_id", F.col("metadata")["_records"].alias("records"), "mapping"
    )


@query(
    "list_target_schemas",
    "SELECT lang, CAST(max(n_chars) AS BIGINT) AS longest FROM documents GROUP BY lang",
)
def list_target_schemas(spark, folder):
    target = work_folder(spark, "schemas")
    limits = table(spark, folder, "documents").groupBy("lang").agg(F.max("n_chars").alias("n"))
    properties = F.struct(
        F.struct(F.col("lang").alias("const")).alias("lang"),
        F.struct(F.lit("integer").alias("type"), F.col("n").alias("maximum")).alias("n_chars"),
    )
    documents = limits.select(F.lit("object").alias("type"), properties.alias("properties"))
    documents.write.option("maxRecordsPerFile", 1).json(target)
    found = target_schemas(spark, target)
    return found.select(
        F.get_json_object("schema", "$.properties.lang.const").alias("lang"),
        F.get_json_object("schema", "$.properties.n_chars.maximum").cast("bigint").alias("longest"),
    )


@query(
    "write_mapped",
    f"""SELECT conv_id, turn, CAST(i AS BIGINT) AS pos, value AS content,
               CASE speaker WHEN 'gpt' THEN 'ASSISTANT' ELSE 'USER' END AS role FROM ({TURNS})""",
)
def write_mapped(spark, folder):
    target = work_folder(spark, "mapped")
    sinks.write_mapped(apply_mapping(chat_rows(spark, folder), CHAT_MAPPING, None, keep=["conv_id", "turn"]), target)
    stored = spark.read.parquet(target).select("conv_id", "turn", F.posexplode_outer("messages").alias("pos", "m"))
    role = F.coalesce("m.role", F.lit("USER")).alias("role")
    return stored.select("conv_id", "turn", F.col("pos").cast("bigint").alias("pos"), "m.content", role)


@query(
    "save_results",
    "SELECT o_custkey, CAST(count(*) AS BIGINT) AS n, max(o_totalprice) AS largest FROM orders GROUP BY o_custkey",
)
def save_results(spark, folder):
    result = run_sql(
        spark,
        "SELECT o_custkey, count(*) AS n, max(o_totalprice) AS largest FROM orders GROUP BY o_custkey",
        {"orders": table(spark, folder, "orders")},
    )
    return spark.read.parquet(sinks.save_results(result, work_folder(spark, "results"), "by_customer"))


@query(
    "export_csv",
    """SELECT o_orderkey, '{"p":"' || o_orderpriority || '"}' AS detail, o_totalprice
       FROM orders ORDER BY o_orderkey LIMIT 1000""",
)
def export_csv(spark, folder):
    target = work_folder(spark, "export")
    rows = table(spark, folder, "orders").orderBy("o_orderkey").select(
        "o_orderkey", F.struct(F.col("o_orderpriority").alias("p")).alias("detail"), "o_totalprice"
    )
    sinks.export_csv(rows, target, 1000)
    return readers.read_csv(spark, target, schema="o_orderkey bigint, detail string, o_totalprice double")


@query("extract_sample", f"{TALK} ORDER BY conv_id, turn LIMIT 10")
def extract_sample(spark, folder):
    target = work_folder(spark, "sample")
    sinks.extract_sample(table(spark, folder, "conversations"), target, order_by=["conv_id", "turn"], n=10)
    return spark.read.schema(TALK_COLUMNS).json(target)


@query("run_log", "SELECT 'conversations' AS dataset, 'mapping' AS kind, CAST(count(*) AS BIGINT) AS rows, true AS valid FROM conversations")
def run_log(spark, folder):
    target = work_folder(spark, "log")
    rows = table(spark, folder, "conversations").count()
    sinks.append_run_log(spark, target, run_id="r1", dataset="conversations", kind="mapping", rows=rows, valid=True)
    return sinks.read_run_log(spark, target).select("dataset", "kind", "rows", "valid")



"""The metadata catalog, on documents derived from the orders: one dataset per customer."""

from __future__ import annotations

from pyspark.sql import functions as F

from loomrow.operators import catalog

from .registry import query, table

DOCS = """SELECT 'v1' AS version, 'd' || o_custkey AS dataset, 'data' AS subpath,
                 strftime(o_orderdate, '%Y%m%d') || lpad(CAST(o_orderkey AS VARCHAR), 12, '0') AS ts,
                 CAST(o_orderkey AS VARCHAR) AS doc_id, o_orderstatus AS status, o_orderpriority AS priority,
                 '{"k":' || o_orderkey || '}' AS src_schema
          FROM orders"""
NUMBERED = f"SELECT *, row_number() OVER (PARTITION BY dataset ORDER BY ts DESC) AS rn FROM ({DOCS})"
FLAT = "version, dataset, subpath, ts, doc_id, status, priority, src_schema"


def documents(spark, folder):
    o = table(spark, folder, "orders")
    key = F.col("o_orderkey").cast("string")
    return o.select(
        F.lit("v1").alias("version"),
        F.concat(F.lit("d"), F.col("o_custkey").cast("string")).alias("dataset"),
        F.lit("data").alias("subpath"),
        F.concat(F.date_format("o_orderdate", "yyyyMMdd"), F.lpad(key, 12, "0")).alias("ts"),
        key.alias("doc_id"),
        F.create_map(F.lit("_status"), "o_orderstatus", F.lit("_priority"), "o_orderpriority").alias("metadata"),
        F.to_json(F.struct(F.col("o_orderkey").alias("k"))).alias("src_schema"),
        F.lit("chat.json").alias("dst_schema_id"),
        F.lit("[]").alias("mapping"),
    )


def flat(docs):
    return docs.select(
        *catalog.KEY, "ts", "doc_id", F.col("metadata")["_status"].alias("status"),
        F.col("metadata")["_priority"].alias("priority"), "src_schema",
    )


@query("catalog_latest", f"SELECT {FLAT} FROM ({NUMBERED}) WHERE rn = 1")
def catalog_latest(spark, folder):
    return flat(catalog.latest(documents(spark, folder)))


@query("catalog_obsolete", f"SELECT {FLAT} FROM ({NUMBERED}) WHERE rn > 1")
def catalog_obsolete(spark, folder):
    return flat(catalog.obsolete(documents(spark, folder)))


def master(spark, folder):
    """Old master rows: orders not finished; new ones: everything of large value, re-labelled."""
    o = table(spark, folder, "orders")

    def rows(part, label):
        return part.select(F.col("o_orderkey").cast("string").alias("doc_id"), label.alias("metadata"))

    old = rows(o.where(F.col("o_orderstatus") != "F"), F.col("o_orderstatus"))
    new = rows(o.where(F.col("o_totalprice") > 250000), F.col("o_orderpriority"))
    return old, new


MASTER = """old AS (SELECT CAST(o_orderkey AS VARCHAR) AS doc_id, o_orderstatus AS metadata FROM orders WHERE o_orderstatus <> 'F'),
            new AS (SELECT CAST(o_orderkey AS VARCHAR) AS doc_id, o_orderpriority AS metadata FROM orders WHERE o_totalprice > 250000)"""


@query(
    "catalog_upsert",
    f"WITH {MASTER} SELECT * FROM old WHERE doc_id NOT IN (SELECT doc_id FROM new) UNION ALL SELECT * FROM new",
)
def catalog_upsert(spark, folder):
    return catalog.upsert(*master(spark, folder))


@query(
    "catalog_upsert_null",
    f"""WITH {MASTER}, holed AS (SELECT nullif(doc_id, (SELECT min(doc_id) FROM new)) AS doc_id, metadata FROM new)
        SELECT * FROM old WHERE doc_id NOT IN (SELECT doc_id FROM holed) UNION ALL SELECT * FROM holed""",
)
def catalog_upsert_null(spark, folder):
    old, new = master(spark, folder)
    smallest = new.agg(F.min("doc_id")).scalar()
    return catalog.upsert(old, new.withColumn("doc_id", F.nullif("doc_id", smallest)), null_aware=True)


@query(
    "catalog_append_version",
    f"""SELECT {FLAT} FROM ({DOCS})
        UNION ALL SELECT version, dataset, subpath, '203001020304', doc_id, status, priority, src_schema
        FROM ({NUMBERED}) WHERE rn = 1""",
)
def catalog_append_version(spark, folder):
    docs = documents(spark, folder)
    now = F.lit("2030-01-02 03:04:05").cast("timestamp")
    return flat(catalog.append_version(docs, catalog.latest(docs), now))


@query(
    "catalog_restore",
    f"""WITH n AS ({NUMBERED}), old AS (SELECT * FROM n WHERE rn = 2)
        SELECT c.version, c.dataset, c.subpath, c.ts, coalesce(old.doc_id, c.doc_id) AS doc_id,
               coalesce(old.status, c.status) AS status, coalesce(old.priority, c.priority) AS priority,
               coalesce(old.src_schema, c.src_schema) AS src_schema
        FROM n c LEFT JOIN old ON c.dataset = old.dataset WHERE c.rn = 1""",
)
def catalog_restore(spark, folder):
    docs = documents(spark, folder)
    chosen = catalog.latest(catalog.obsolete(docs)).select(*catalog.KEY, "ts")
    return flat(catalog.restore(docs, chosen))


@query(
    "metadata_set",
    "SELECT CAST(o_orderkey AS VARCHAR) AS doc_id, 'it' AS status, o_orderpriority AS priority, 'mit' AS license FROM orders",
)
def metadata_set(spark, folder):
    changed = catalog.metadata_set(F.col("metadata"), "_status", F.lit("it"))
    changed = catalog.metadata_set(changed, "_license", F.lit("mit"))
    m = F.col("metadata")
    return documents(spark, folder).select("doc_id", changed.alias("metadata")).select(
        "doc_id", m["_status"].alias("status"), m["_priority"].alias("priority"), m["_license"].alias("license")
    )


@query(
    "metadata_remove",
    "SELECT CAST(o_orderkey AS VARCHAR) AS doc_id, CAST(1 AS BIGINT) AS n, o_orderpriority AS priority FROM orders",
)
def metadata_remove(spark, folder):
    left = catalog.metadata_remove(F.col("metadata"), "_status")
    return documents(spark, folder).select("doc_id", left.alias("metadata")).select(
        "doc_id", F.size("metadata").cast("bigint").alias("n"), F.col("metadata")["_priority"].alias("priority")
    )


@query(
    "catalog_set_section",
    f"""SELECT dataset, ts, CASE WHEN dataset LIKE 'd1%' THEN '{{"new":1}}' ELSE src_schema END AS src_schema
        FROM ({NUMBERED}) WHERE rn = 1""",
)
def catalog_set_section(spark, folder):
    current = catalog.latest(documents(spark, folder))
    changed = catalog.set_section(current, "src_schema", '{"new":1}', F.col("dataset").startswith("d1"))
    return changed.select("dataset", "ts", "src_schema")


@query(
    "metadata_fields",
    """SELECT '_' || lower(o_orderstatus) AS field FROM orders UNION SELECT '_priority' UNION SELECT '_status'
       UNION SELECT unnest(['_size', '_records', '_link', '_dataset_description', '_source_type', '_created_at',
                            '_license', '_content_size', '_dataset_name', '_subpath', '_id_hash', '_lang',
                            '_file_name', '_tags'])""",
)
def metadata_fields(spark, folder):
    wanted = table(spark, folder, "orders").select(F.lower("o_orderstatus").alias("field")).distinct()
    registry, _ = catalog.add_fields(catalog.default_registry(spark), wanted)
    return catalog.all_fields(registry, documents(spark, folder))


@query(
    "catalog_fill_keys",
    f"""SELECT doc_id, CASE WHEN status = 'F' THEN '{{}}' ELSE src_schema END AS src_schema,
               CASE WHEN status = 'F' THEN '' ELSE 'chat.json' END AS dst_schema_id, '[]' AS mapping,
               CAST(CASE WHEN status = 'F' THEN 0 ELSE 2 END AS BIGINT) AS fields
        FROM ({DOCS})""",
)
def catalog_fill_keys(spark, folder):
    docs = documents(spark, folder)
    finished = F.col("metadata")["_status"] == "F"
    holed = docs.select(
        "doc_id",
        *[F.when(~finished, F.col(c)).alias(c) for c in ("metadata", "src_schema", "dst_schema_id", "mapping")],
    )
    filled = catalog.fill_keys(holed)
    return filled.withColumn("fields", F.size("metadata").cast("bigint")).drop("metadata")


@query(
    "map_from_catalog",
    """SELECT o_orderkey, o_orderstatus AS status, 'orders' AS _dataset_name FROM orders""",
)
def map_from_catalog(spark, folder):
    mapping = F.to_json(
        F.array(
            F.struct(F.lit("o_orderstatus").alias("src_field"), F.lit("status").alias("target_field"),
                     F.lit("src").alias("transformation")),
            F.struct(F.lit("N/A").alias("src_field"), F.lit("_dataset_name").alias("target_field"),
                     F.lit("orders").alias("transformation")),
        )
    )
    docs = documents(spark, folder)
    docs = catalog.append_version(docs, catalog.latest(docs).withColumn("mapping", mapping),
                                  F.lit("2030-01-02").cast("timestamp"))
    first = docs.agg(F.min("dataset")).first()[0]
    name = {"version": "v1", "dataset": first, "subpath": "data"}
    return catalog.map_from_catalog(table(spark, folder, "orders"), docs, name, None, keep=["o_orderkey"])


@query(
    "catalog_init_missing",
    """SELECT DISTINCT 'v1' AS version, 'd' || c_custkey AS dataset, 'data' AS subpath, '203001020304' AS ts,
              '/base/v1/d' || c_custkey || '/data' AS doc_id, '{}' AS src_schema, '' AS dst_schema_id, '[]' AS mapping
       FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_orderpriority = '1-URGENT')""",
)
def catalog_init_missing(spark, folder):
    key = F.concat(F.lit("d"), F.col("c_custkey").cast("string")).alias("dataset")
    datasets = table(spark, folder, "customer").select(
        F.lit("v1").alias("version"), key, F.lit("data").alias("subpath")
    )
    now = F.lit("2030-01-02 03:04:05").cast("timestamp")
    known = documents(spark, folder).where(F.col("metadata")["_priority"] == "1-URGENT")
    return catalog.init_missing(datasets, known, "/base/", now).drop("metadata")



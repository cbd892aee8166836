"""Free SQL over datasets, and what is done with its results."""

from __future__ import annotations

from pyspark.sql import functions as F

from loomrow.operators import query as ops
from loomrow.operators.mapping import apply_mapping
from loomrow.resources import chat_schema

from .registry import CHAT_MAPPING, TURNS, chat_rows, query, table


def sql_query(name: str, sql: str, *tables: str) -> None:
    """Register one SQL text that both engines run as it is."""

    @query(name, sql)
    def run(spark, folder):
        return ops.run_sql(spark, sql, {t: table(spark, folder, t) for t in tables})


DAY = "CAST(CAST(o_orderdate AS DATE) AS STRING)"

sql_query(
    "sql_inner_join",
    """SELECT o_orderpriority, count(*) AS n, CAST(sum(CAST(l_quantity AS DECIMAL(18, 2))) AS DOUBLE) AS quantity
       FROM orders JOIN lineitem ON o_orderkey = l_orderkey WHERE l_discount > 0.05 GROUP BY o_orderpriority""",
    "orders", "lineitem",
)
sql_query(
    "sql_left_join",
    """SELECT c_custkey, c_mktsegment, o.n AS n
       FROM customer LEFT JOIN (SELECT o_custkey, count(*) AS n FROM orders GROUP BY o_custkey) o
       ON c_custkey = o.o_custkey""",
    "customer", "orders",
)
sql_query(
    "sql_semi_join",
    """SELECT o_orderkey, o_totalprice FROM orders
       WHERE o_orderkey IN (SELECT DISTINCT l_orderkey FROM lineitem WHERE l_quantity > 45)""",
    "orders", "lineitem",
)
sql_query(
    "sql_anti_join",
    """SELECT d.doc_id, d.lang FROM documents d
       WHERE NOT EXISTS (SELECT 1 FROM (SELECT DISTINCT doc_id FROM labels) l WHERE l.doc_id = d.doc_id)""",
    "documents", "labels",
)
sql_query(
    "sql_range_join",
    """SELECT o_orderstatus, count(*) AS n FROM orders JOIN lineitem
       ON l_orderkey = o_orderkey AND l_shipdate BETWEEN o_orderdate AND o_orderdate + INTERVAL 30 DAY
       GROUP BY o_orderstatus""",
    "orders", "lineitem",
)
sql_query(
    "sql_group_agg",
    """SELECT l_returnflag, l_linestatus, count(*) AS n, min(l_shipdate) AS first_day, max(l_quantity) AS largest,
              CAST(sum(CAST(l_extendedprice AS DECIMAL(18, 2))) AS DOUBLE) AS price
       FROM lineitem GROUP BY l_returnflag, l_linestatus HAVING count(*) > 10""",
    "lineitem",
)
sql_query(
    "sql_count_distinct",
    """SELECT l_returnflag, count(DISTINCT l_partkey) AS parts, count(DISTINCT l_suppkey) AS suppliers
       FROM lineitem GROUP BY l_returnflag""",
    "lineitem",
)
sql_query(
    "sql_rollup",
    """SELECT l_returnflag, l_linestatus, count(*) AS n FROM lineitem GROUP BY ROLLUP (l_returnflag, l_linestatus)""",
    "lineitem",
)
# a top-k per key: each task keeps three rows per key before anything is moved
sql_query(
    "sql_rank",
    """SELECT o_custkey, o_orderkey, o_totalprice, place FROM (
         SELECT o_custkey, o_orderkey, o_totalprice, CAST(row_number() OVER (
           PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) AS BIGINT) AS place FROM orders) t
       WHERE place <= 3""",
    "orders",
)
# daily totals first: a window then holds at most one row per day, whatever the key's size
sql_query(
    "sql_running_sum",
    f"""SELECT o_orderstatus, day, CAST(sum(total) OVER (PARTITION BY o_orderstatus ORDER BY day) AS DOUBLE) AS running
        FROM (SELECT o_orderstatus, {DAY} AS day, sum(CAST(o_totalprice AS DECIMAL(18, 2))) AS total
              FROM orders GROUP BY o_orderstatus, {DAY}) t""",
    "orders",
)
sql_query(
    "sql_topk",
    "SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 25",
    "orders",
)
# DISTINCT on each side: duplicates of a key are removed inside the tasks, before the shuffle
sql_query("sql_union", "SELECT c_custkey AS k FROM customer UNION SELECT o_custkey FROM orders", "customer", "orders")
sql_query(
    "sql_intersect",
    "SELECT DISTINCT c_custkey AS k FROM customer INTERSECT SELECT DISTINCT o_custkey FROM orders",
    "customer", "orders",
)
sql_query(
    "sql_except",
    "SELECT DISTINCT c_custkey AS k FROM customer EXCEPT SELECT DISTINCT o_custkey FROM orders WHERE o_orderpriority = '1-URGENT'",
    "customer", "orders",
)


@query(
    "sql_explode_messages",
    f"""SELECT CASE speaker WHEN 'gpt' THEN 'ASSISTANT' ELSE 'USER' END AS role, CAST(count(*) AS BIGINT) AS n,
               CAST(sum(length(value)) AS BIGINT) AS characters
        FROM ({TURNS}) GROUP BY 1""",
)
def sql_explode_messages(spark, folder):
    dataset = apply_mapping(chat_rows(spark, folder), CHAT_MAPPING, chat_schema())
    return ops.run_sql(
        spark,
        """SELECT m.role, count(*) AS n, sum(length(m.content)) AS characters
           FROM dataset LATERAL VIEW OUTER explode(messages) t AS m GROUP BY m.role""",
        {"dataset": dataset},
    )


@query("sql_limited", "SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_orderkey LIMIT 100")
def sql_limited(spark, folder):
    result = ops.run_sql(
        spark, "SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_orderkey",
        {"orders": table(spark, folder, "orders")},
    )
    return ops.limited(result)


@query(
    "result_metrics",
    """SELECT CAST(count(*) AS BIGINT) AS total_rows, CAST(2 AS BIGINT) AS total_columns,
              CAST(least(count(*), 100) AS BIGINT) AS shown_rows FROM orders WHERE o_orderstatus = 'O'""",
)
def result_metrics(spark, folder):
    result = ops.run_sql(
        spark, "SELECT o_orderkey, o_totalprice FROM orders WHERE o_orderstatus = 'O'",
        {"orders": table(spark, folder, "orders")},
    )
    metrics = ops.result_metrics(result)
    return metrics.select(*[F.col(c).cast("bigint").alias(c) for c in metrics.columns])


@query(
    "stringify",
    """SELECT CAST(o_orderkey AS VARCHAR) AS o_orderkey, '{"s":"' || o_orderstatus || '"}' AS detail,
              nullif(o_orderpriority, '5-LOW') AS priority FROM orders""",
)
def stringify(spark, folder):
    rows = table(spark, folder, "orders").select(
        "o_orderkey", F.struct(F.col("o_orderstatus").alias("s")).alias("detail"),
        F.nullif("o_orderpriority", F.lit("5-LOW")).alias("priority"),
    )
    return ops.stringify(rows)


@query("dataset_stats", "SELECT CAST(count(*) AS BIGINT) AS total_rows, true AS has_bytes FROM documents")
def dataset_stats(spark, folder):
    stats = ops.dataset_stats(spark, f"{folder}/documents.parquet")
    return stats.select("total_rows", (F.col("total_bytes") > 0).alias("has_bytes"))


@query("preview", "SELECT doc_id, lang, n_chars FROM documents ORDER BY doc_id LIMIT 5")
def preview(spark, folder):
    return ops.preview(table(spark, folder, "documents").select("doc_id", "lang", "n_chars"), order_by=["doc_id"])

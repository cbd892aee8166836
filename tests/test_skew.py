"""Operators that group or join, on data where one key holds a third of all rows."""

from pyspark.sql import functions as F

from loomrow.operators import catalog
from loomrow.operators.inference import json_field_types
from loomrow.operators.validation import validate_rows, validation_report

ROWS = 30_000


def documents(spark):
    hot = F.when(F.col("id") % 3 == 0, F.lit("hot")).otherwise(F.concat(F.lit("d"), (F.col("id") % 500).cast("string")))
    return spark.range(0, ROWS, 1, 8).select(
        F.lit("v1").alias("version"), hot.alias("dataset"), F.lit("data").alias("subpath"),
        F.lpad(F.col("id").cast("string"), 12, "0").alias("ts"), F.col("id").cast("string").alias("doc_id"),
        F.create_map(F.lit("_k"), F.col("id").cast("string")).alias("metadata"),
        F.lit("{}").alias("src_schema"), F.lit("").alias("dst_schema_id"), F.lit("[]").alias("mapping"),
    )


def newest_by_hand():
    found = {}
    for n in range(ROWS):
        found["hot" if n % 3 == 0 else f"d{n % 500}"] = str(n)
    return found


def test_versions(spark):
    docs = documents(spark)
    expected = newest_by_hand()
    assert {r["dataset"]: r["doc_id"] for r in catalog.latest(docs).collect()} == expected
    older = {r["doc_id"] for r in catalog.obsolete(docs).select("doc_id").collect()}
    assert older == {str(n) for n in range(ROWS)} - set(expected.values())


def test_latest_is_reduced_before_the_shuffle(spark):
    plan = catalog.latest(documents(spark))._jdf.queryExecution().executedPlan().toString()
    assert plan.index("partial_max_by") > plan.index("Exchange")  # printed top down: below the exchange
    assert "Window" not in plan


def test_obsolete_is_joined_on_name_and_stamp(spark):
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        plan = catalog.obsolete(documents(spark))._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    join = next(line for line in plan.splitlines() if "SortMergeJoin" in line)
    assert "ts#" in join and "dataset#" in join


def test_upsert_with_one_key_in_many_new_rows(spark):
    old = spark.range(0, 1000).select(F.col("id").cast("string").alias("doc_id"), F.lit("old").alias("x"))
    new = spark.range(0, 900, 1, 8).select(
        F.when(F.col("id") % 3 == 0, "7").otherwise(F.col("id").cast("string")).alias("doc_id"),
        F.lit("new").alias("x"), F.col("id").alias("n"),
    )
    keys = {"7"} | {str(n) for n in range(900) if n % 3}
    result = catalog.upsert(old, new, newest_by="n")
    assert result.count() == 1000 + len(keys - {str(n) for n in range(1000)})
    assert result.where("x = 'new'").count() == len(keys)


def test_reports_and_inference_count_everything(spark):
    df = spark.range(0, ROWS, 1, 8).select(F.when(F.col("id") % 3 == 0, "bad").otherwise("good").alias("s"))
    schema = {"type": "object", "properties": {"s": {"enum": ["good"]}}}
    assert [tuple(r)[:3] for r in validation_report(validate_rows(df, schema)).collect()] == [("s", "enum", ROWS // 3)]
    counted = json_field_types(df.select(F.to_json(F.struct("s")).alias("t")), "t")
    plan = counted._jdf.queryExecution().executedPlan().toString()
    assert "partial_count" in plan and plan.count("Exchange") == 1
    assert {(r["path"], r["n"]) for r in counted.collect()} == {("$", ROWS), ("$.s", ROWS)}

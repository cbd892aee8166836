"""Every query against its SQL, and the shape of the plans."""

import re

import pytest

from conformance import ORACLES, QUERIES
from conformance.check import compare, duck

#: queries whose result SQL cannot give
ROWS_ONLY = {"extract_tags_html"}


@pytest.fixture(scope="module")
def connection(data):
    return duck(data)


def test_every_query_has_sql_but_these():
    assert set(QUERIES) - set(ORACLES) == ROWS_ONLY
    assert set(ORACLES) <= set(QUERIES)


@pytest.mark.parametrize("name", list(QUERIES))
def test_query(spark, data, connection, name):
    assert compare(spark, data, QUERIES[name], ORACLES.get(name), connection) == ""


def plan(spark, data, name):
    return QUERIES[name](spark, data)._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("name", list(QUERIES))
def test_no_python_and_no_cross_join(spark, data, name):
    text = plan(spark, data, name)
    for node in ("Python", "Pandas", "CartesianProduct", "BroadcastNestedLoopJoin"):
        assert node not in text


ROW_LOCAL = [
    "map_conversations", "map_prompt_response", "map_cast", "map_defaults", "map_and_validate", "validate_rows",
    "extract_tags", "normalize_sample", "truncate_text", "conform_to_schema", "map_nested_full",
]


@pytest.mark.parametrize("name", ROW_LOCAL)
def test_row_by_row_operators_do_not_shuffle(spark, data, name):
    assert "Exchange" not in plan(spark, data, name)


@pytest.mark.parametrize(
    ("name", "columns"),
    [
        ("map_enum", {"o_orderkey", "o_custkey", "o_orderstatus"}),
        ("map_prompt_response", {"doc_id", "text", "lang", "source"}),
        ("map_conversations", {"conv_id", "turn", "text"}),
        ("scan_parquet", {"o_orderkey", "o_totalprice", "o_orderdate", "o_orderstatus"}),
    ],
)
def test_scans_read_only_what_is_needed(spark, data, name, columns):
    read = re.findall(r"ReadSchema: struct<([^>]*)>", plan(spark, data, name))
    assert len(read) == 1 and {part.split(":")[0] for part in read[0].split(",")} == columns


def test_filters_reach_the_scan(spark, data):
    assert "EqualTo(o_orderstatus,F)" in plan(spark, data, "scan_parquet")


def test_filters_reach_the_scan_through_a_mapping(spark, data):
    from conformance.registry import entry
    from loomrow import apply_mapping

    mapped = apply_mapping(spark.read.parquet(f"{data}/documents.parquet"), [entry("lang", "_lang")], None)
    text = mapped.where("_lang = 'en'")._jdf.queryExecution().executedPlan().toString()
    assert "EqualTo(lang,en)" in text


def test_constant_mappings_read_no_columns(spark, data):
    from conformance.registry import constant
    from loomrow import apply_mapping

    mapped = apply_mapping(spark.read.parquet(f"{data}/documents.parquet"), [constant("x", "c")], None)
    assert "ReadSchema: struct<>" in mapped._jdf.queryExecution().executedPlan().toString()

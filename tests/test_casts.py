import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from loomrow.functions.casts import cast_to_schema, coerced, float_text
from loomrow.plans.paths import MappingError
from loomrow.plans.typed import Typed


def cast(spark, sql, schema):
    df = spark.sql(f"SELECT {sql} AS v")
    value, failed = cast_to_schema(Typed(F.col("v"), df.schema["v"].dataType), schema)
    bad = F.lit(False) if failed is None else F.coalesce(failed, F.lit(False))
    return tuple(df.select(value.col.alias("v"), bad.alias("bad")).first())


@pytest.mark.parametrize(
    ("sql", "kind", "value", "failed"),
    [
        ("'12'", "integer", 12, False),
        ("'-5'", "integer", None, True),
        ("'1.0'", "integer", None, True),
        ("CAST(3.9 AS DOUBLE)", "integer", 3, False),
        ("CAST(-3.9 AS DOUBLE)", "integer", -3, False),
        ("CAST('Infinity' AS DOUBLE)", "integer", None, True),
        ("CAST('NaN' AS DOUBLE)", "integer", None, True),
        ("true", "integer", 1, False),
        ("7", "integer", 7, False),
        ("'1.5'", "number", 1.5, False),
        ("' 1_000.5 '", "number", 1000.5, False),
        ("'1.5d'", "number", None, True),
        ("'abc'", "number", None, True),
        ("7", "number", 7.0, False),
        ("'YES'", "boolean", True, False),
        ("'on'", "boolean", True, False),
        ("'no'", "boolean", False, False),
        ("0", "boolean", False, False),
        ("2", "boolean", True, False),
        ("array()", "boolean", False, False),
        ("array(1)", "boolean", True, False),
        ("true", "string", "True", False),
        ("CAST(1.0 AS DOUBLE)", "string", "1.0", False),
        ("7", "string", "7", False),
        ("array(1, 2)", "string", "[1,2]", True),
        ("timestamp '2024-01-02 03:04:05'", "string", "2024-01-02 03:04:05", False),
        ("timestamp '2024-01-02 03:04:05.12'", "string", "2024-01-02 03:04:05.120000", False),
        ("date '2024-01-02'", "integer", None, True),
        ("CAST(NULL AS STRING)", "integer", None, False),
    ],
)
def test_cast_table(spark, sql, kind, value, failed):
    assert cast(spark, sql, {"type": kind}) == (value, failed)


def test_type_lists_use_the_first_type(spark):
    assert cast(spark, "'12'", {"type": ["integer", "null"]}) == (12, False)
    assert cast(spark, "12", {"type": ["null", "string"]}) == ("12", False)


def test_several_types_keep_what_does_not_convert(spark):
    df = spark.sql("SELECT * FROM VALUES ('12'), ('x') AS t(v)")
    value, failed = cast_to_schema(Typed(F.col("v"), T.StringType()), {"type": ["integer", "string"]})
    assert failed is None
    assert [r[0] for r in df.select(F.to_json(value.col)).collect()] == ["12", '"x"']


@pytest.mark.parametrize(
    ("json", "kind", "value"),
    [
        ("12", "string", "12"), ("true", "string", "True"), ("1e20", "string", "1e+20"), ('"12"', "integer", 12),
        ("3.7", "integer", 3), ('"x"', "integer", None), ('"1.5"', "number", 1.5), ('"yes"', "boolean", True),
        ("0", "boolean", False), ("[]", "boolean", False), ("[1]", "boolean", True), ("null", "string", None),
    ],
)
def test_variant_values(spark, json, kind, value):
    assert cast(spark, f"parse_json('{json}')", {"type": kind})[0] == value


@pytest.mark.parametrize(
    "number",
    [0.0, 1.0, -2.5, 0.001, 0.0001234, 0.00001234, 1e7, 12345678.9, 1e15, 1.5e15, 1e16, 1.25e20, -3e-7, 1e22,
     123456789012345.6, 99999999.5],
)
def test_float_text_equals_python(spark, number):
    df = spark.createDataFrame([(number,)], "x double")
    assert df.select(float_text(F.col("x"))).first()[0] == repr(number)


def test_float_text_of_special_values(spark):
    df = spark.createDataFrame([(float("nan"),), (float("inf"),), (float("-inf"),), (None,)], "x double")
    assert [r[0] for r in df.select(float_text(F.col("x"))).collect()] == ["nan", "inf", "-inf", None]


def test_plain_values_are_coerced_as_columns_are(spark):
    values = {"a": "5", "b": "-5", "c": 2.9, "d": "x", "e": True, "f": 2**70, "g": 7}
    assert coerced(values, {"type": "integer"}) == {
        "a": (5, False), "b": (None, True), "c": (2, False), "d": (None, True), "e": (1, False), "f": (None, True), "g": (7, False),
    }
    assert coerced({"a": "Yes", "b": 0}, {"type": "boolean"}) == {"a": (True, False), "b": (False, False)}
    assert coerced({"a": True, "b": 1.5}, {"type": "string"}) == {"a": ("True", False), "b": ("1.5", False)}
    with pytest.raises(MappingError):
        coerced({"a": ["x"]}, {"type": "string"})

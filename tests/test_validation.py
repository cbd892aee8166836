import pytest
from pyspark.sql import functions as F

from loomrow.operators.validation import dataset_eligible, validate_rows, validate_source, validation_report


def props(**properties):
    return {"type": "object", "properties": properties}


def found(df, schema, **options):
    checked = validate_rows(df, schema, **options)
    return [sorted((e["path"], e["keyword"]) for e in row["_errors"]) for row in checked.collect()]


SOURCE = {
    **props(question={"type": "string"}, mode={"type": ["string", "null"], "enum": ["Mixed", "Grounded"]}),
    "required": ["question"],
}


@pytest.fixture
def answers(spark):
    data = [("q", None), (None, "Other"), ("q", "Mixed")]
    return spark.createDataFrame(data, "question string, mode string")


def test_nulls_as_missing_keys(answers):
    assert found(answers, SOURCE) == [[], [("", "required"), ("mode", "enum")], []]


def test_nulls_as_values(answers):
    assert found(answers, SOURCE, nulls="present") == [
        [("mode", "enum")], [("mode", "enum"), ("question", "type")], []
    ]


def test_source_check_and_report(answers, rows):
    report = validation_report(validate_source(answers, SOURCE))
    assert rows(report.select("path", "keyword", "n"), "keyword") == [
        {"path": "mode", "keyword": "enum", "n": 1}, {"path": "", "keyword": "required", "n": 1}
    ]


def test_unknown_null_policy(answers):
    with pytest.raises(ValueError):
        validate_rows(answers, SOURCE, nulls="maybe")


@pytest.mark.parametrize(
    ("sql", "schema", "keywords"),
    [
        ("5", {"type": "string"}, ["type"]),
        ("5", {"type": "number"}, []),
        ("CAST(5.0 AS DOUBLE)", {"type": "integer"}, []),
        ("CAST(5.5 AS DOUBLE)", {"type": "integer"}, ["type"]),
        ("true", {"type": "integer"}, ["type"]),
        ("'x'", {"type": ["integer", "string"]}, []),
        ("timestamp '2024-01-01 00:00:00'", {"type": "string"}, ["type"]),
        ("'b'", {"enum": ["a", 1]}, ["enum"]),
        ("1", {"enum": ["a", 1]}, []),
        ("'a'", {"const": "b"}, ["const"]),
        ("5", {"minimum": 6, "maximum": 4}, ["maximum", "minimum"]),
        ("5", {"exclusiveMinimum": 5, "exclusiveMaximum": 5}, ["exclusiveMaximum", "exclusiveMinimum"]),
        ("'héé'", {"minLength": 4, "maxLength": 2}, ["maxLength", "minLength"]),
        ("'abc'", {"pattern": "b"}, []),
        ("'abc'", {"pattern": "^b"}, ["pattern"]),
        ("array(1, 2)", {"minItems": 3}, ["minItems"]),
        ("array(1, 2)", {"type": "array", "maxItems": 1, "items": {"maximum": 1}}, ["maxItems", "maximum"]),
        ("5", {"minLength": 9, "pattern": "x"}, []),
        ("5", {"anyOf": [{"type": "string"}, {"minimum": 9}]}, ["anyOf"]),
        ("5", {"oneOf": [{"minimum": 1}, {"maximum": 9}]}, ["oneOf"]),
        ("5", {"allOf": [{"minimum": 1}, {"maximum": 4}]}, ["allOf"]),
        ("5", {"not": {"minimum": 1}}, ["not"]),
        ("5", {}, []),
        ("named_struct('a', 1, 'b', 2)", {**props(a={}), "additionalProperties": False}, ["additionalProperties"]),
        ("named_struct('a', 1, 'b', 2)", {**props(a={}), "additionalProperties": {"type": "string"}}, ["type"]),
        ("map('a', 1)", {**props(a={"minimum": 5}), "required": ["b"]}, ["minimum", "required"]),
    ],
)
def test_keywords(spark, sql, schema, keywords):
    df = spark.sql(f"SELECT {sql} AS v")
    errors = validate_rows(df, props(v=schema)).first()["_errors"]
    assert sorted(e["keyword"] for e in errors) == sorted(keywords)


def test_paths_carry_positions(spark):
    df = spark.sql("SELECT array(named_struct('r', 'a'), named_struct('r', 'z'), named_struct('r', NULL), NULL) AS m")
    item = {**props(r={"type": "string", "enum": ["a"]}), "required": ["r"]}
    schema = props(m={"type": "array", "items": item})
    assert found(df, schema) == [[("m.1.r", "enum"), ("m.2", "required"), ("m.3", "type")]]


def test_semi_structured_values_tell_missing_from_null(spark):
    texts = ['{"a":1,"b":[{"c":"x"},{"c":null},{}]}', '{"a":1.5}', '{"a":null,"z":1}', "{}"]
    df = spark.createDataFrame([(n, t) for n, t in enumerate(texts)], "n int, t string")
    df = df.orderBy("n").select(F.parse_json("t").alias("v"))
    item = {**props(c={"type": "string"}), "required": ["c"]}
    schema = {**props(a={"type": "integer"}, b={"type": "array", "items": item}),
              "required": ["a"], "additionalProperties": False}
    assert found(df, props(v=schema)) == [
        [("v.b.1.c", "type"), ("v.b.2", "required")], [("v.a", "type")],
        [("v", "additionalProperties"), ("v.a", "type")], [("v", "required")],
    ]


def test_eligibility(spark, answers, rows):
    good = {"properties": {"question": {"type": ["string", "null"]}}}
    assert rows(dataset_eligible(answers, good)) == [{"eligible": True, "checked_rows": 3}]
    assert rows(dataset_eligible(answers, SOURCE)) == [{"eligible": False, "checked_rows": 3}]
    assert rows(dataset_eligible(answers, good, first_rows=1)) == [{"eligible": True, "checked_rows": 1}]
    assert rows(dataset_eligible(answers, None)) == [{"eligible": False, "checked_rows": 0}]
    assert rows(dataset_eligible(answers.limit(0), good)) == [{"eligible": False, "checked_rows": 0}]


def test_more_keywords_and_refused_ones(spark):
    df = spark.createDataFrame([([1, 1], 3, [1, 2]), ([1, 2], 4, [2, 1])], "a array<int>, n int, e array<int>")
    schema = {"type": "object", "properties": {
        "a": {"type": "array", "uniqueItems": True}, "n": {"type": "integer", "multipleOf": 2}, "e": {"enum": [[1, 2]]}}}
    errors = [sorted(e["keyword"] for e in r["_errors"]) for r in validate_rows(df, schema).orderBy("n").collect()]
    assert errors == [["multipleOf", "uniqueItems"], ["enum"]]
    for refused in ({"$ref": "#/x"}, {"$ref": "other.json"}, {"prefixItems": [{}]}, {"unevaluatedItems": False}, {"dependentRequired": {}}):
        with pytest.raises(ValueError):
            validate_rows(df, {"type": "object", "properties": {"a": refused}})

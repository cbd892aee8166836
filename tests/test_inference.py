import pytest

from loomrow.operators import inference
from loomrow.operators.inference import DIALECT, infer_schema, infer_schema_json


def test_typed_rows(spark):
    df = spark.createDataFrame([("p", "r")], "prompt string, response string")
    assert infer_schema(df) == {
        "$schema": DIALECT, "type": "object",
        "properties": {"prompt": {"type": "string"}, "response": {"type": "string"}},
        "required": ["prompt", "response"],
    }


def test_typed_nulls_arrays_and_objects(spark):
    df = spark.createDataFrame(
        [(1, [(True, [1.5])], None, []), (None, [(None, None)], None, [])],
        "a int, l array<struct<x:boolean,y:array<double>>>, n string, e array<int>",
    )
    item = {
        "type": "object",
        "properties": {
            "x": {"type": ["boolean", "null"]},
            "y": {"anyOf": [{"type": "null"}, {"type": "array", "items": {"type": "number"}}]},
        },
        "required": ["x", "y"],
    }
    assert infer_schema(df)["properties"] == {
        "a": {"type": ["integer", "null"]}, "l": {"type": "array", "items": item},
        "n": {"type": "null"}, "e": {"type": "array"},
    }


def test_typed_options(spark):
    df = spark.createDataFrame([("<t>1</t>x", ("y",)), (None, None)], "s string, o struct<k:string>")
    assert set(infer_schema(df.limit(1), normalize=True)["properties"]) == {"s", "k", "_tags"}
    assert infer_schema(df.orderBy("s"), limit=1)["properties"]["s"] == {"type": "null"}


TEXTS = [
    '{"a":1,"b":[{"c":"x"},{"c":null,"d.e":1}],"e":{}}',
    '{"a":1.5,"b":[],"e":{"f":[[1],["x"]]}}',
    '{"a":"z","b":null,"e":{"f":12345678901234567890}}',
    "not json",
]
EXPECTED = {
    "a": {"type": ["number", "string"]},
    "b": {"anyOf": [{"type": "null"}, {"type": "array", "items": {
        "type": "object",
        "properties": {"c": {"type": ["null", "string"]}, "d.e": {"type": "integer"}},
        "required": ["c"],
    }}]},
    "e": {"type": "object", "properties": {"f": {"anyOf": [
        {"type": "integer"},
        {"type": "array", "items": {"type": "array", "items": {"type": ["integer", "string"]}}},
    ]}}},
}


@pytest.mark.parametrize("depth", [0, 1, 8])
def test_json_texts_of_any_depth(spark, depth):
    df = spark.createDataFrame([(t,) for t in TEXTS], "t string")
    schema = infer_schema_json(df, "t", max_depth=max(depth, 1))
    assert schema["properties"] == EXPECTED
    assert schema["required"] == ["a", "b", "e"]


def test_keys_with_special_characters(spark):
    key = r"a.b[0]\c"
    df = spark.sql("SELECT to_json(map('%s', 1)) AS t" % key.replace("\\", "\\\\"))
    assert infer_schema_json(df, "t")["properties"] == {key: {"type": "integer"}}


def test_values_used_as_keys_are_refused(spark, monkeypatch):
    monkeypatch.setattr(inference, "MAX_FIELDS", 5)
    df = spark.range(10).selectExpr("to_json(map(concat('k', id), 1)) AS t")
    with pytest.raises(inference.TooManyFields):
        infer_schema_json(df, "t")


def test_depth_costs_no_time_and_skipped_texts_are_counted(spark):
    deep = "1"
    for _ in range(50):
        deep = '{"k":[' + deep + "]}"
    texts = [deep, "not json", '{"k":1,"k":2}', None, "", "[1]x"]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    found = inference.inspect_json(df, "t")
    assert (found.values, found.skipped) == (2, 3)  # a value and the array before the x
    node = found.schema["anyOf"][1]
    for _ in range(50):
        node = node["properties"]["k"]["items"]
    assert node == {"type": "integer"}
    with pytest.warns(UserWarning, match="3 texts"):
        infer_schema_json(df, "t", max_depth=2)


def test_plan_is_as_large_for_any_depth(spark):
    df = spark.createDataFrame([("{}",)], "t string")
    sizes = {len(inference.json_field_types(df, "t", d)._jdf.queryExecution().optimizedPlan().toString()) for d in (4, 40)}
    assert max(sizes) - min(sizes) < 100

"""Draft 7 in full: conditional and keyed subschemas, references, and recursive schemas on semi-structured values.

Random schemas and documents are judged by a plain evaluator written here from the specification.
"""

import json
import random
import re

import pytest
from pyspark.sql import functions as F

from loomrow.operators.validation import error_rows, validate_rows
from loomrow.plans.references import References
from loomrow.plans.validator import SHALLOW


def errors_of(spark, schema, documents):
    """Sorted (path, keyword) of each document, a VARIANT in the field ``v``."""
    df = spark.createDataFrame(list(enumerate(map(json.dumps, documents))), "n int, t string").select("n", F.parse_json("t").alias("v"))
    definitions = {k: v for k, v in schema.items() if k == "definitions"} if isinstance(schema, dict) else {}
    whole = {"type": "object", "properties": {"v": schema}, **definitions}
    checked = validate_rows(df, whole).select("n", "_errors").orderBy("n")
    return [sorted((e["path"].removeprefix("v").removeprefix("."), e["keyword"]) for e in r["_errors"]) for r in checked.collect()]


TYPED = "SELECT named_struct('a', 1, 'b', CAST(NULL AS INT), 'xa', 'q') AS v"


@pytest.mark.parametrize(
    ("schema", "document", "found"),
    [
        ({"if": {"type": "integer"}, "then": {"minimum": 3}, "else": {"minLength": 2}}, 1, [("", "minimum")]),
        ({"if": {"type": "integer"}, "then": {"minimum": 3}, "else": {"minLength": 2}}, "x", [("", "minLength")]),
        ({"if": {"type": "integer"}, "else": False}, 1, []),
        ({"if": True, "then": False}, 1, [("", "not")]),
        ({"contains": {"minimum": 5}}, [1, 7], []),
        ({"contains": {"minimum": 5}}, [1, 2], [("", "contains")]),
        ({"contains": {}}, [], [("", "contains")]),
        ({"contains": {"minimum": 5}}, {"a": 1}, []),
        ({"items": [{"type": "string"}, {"minimum": 3}]}, [1, 2, "x"], [("0", "type"), ("1", "minimum")]),
        ({"items": [{"type": "string"}], "additionalItems": False}, ["a", 1], [("", "additionalItems")]),
        ({"items": [{"type": "string"}], "additionalItems": {"type": "integer"}}, ["a", 1, "b"], [("2", "type")]),
        ({"additionalItems": False}, [1, 2], []),
        ({"items": False}, [1], [("0", "not")]),
        ({"items": False}, [], []),
        ({"dependencies": {"a": ["b", "c"]}}, {"a": 1, "b": 2}, [("", "dependencies")]),
        ({"dependencies": {"a": ["b"]}}, {"c": 1}, []),
        ({"dependencies": {"a": {"required": ["z"]}}}, {"a": None}, [("", "required")]),
        ({"dependencies": {"a": False}}, {"a": 1}, [("", "not")]),
        ({"patternProperties": {"^x": {"type": "string"}, "a$": {"minLength": 2}}}, {"xa": "q", "xb": 1, "c": 2}, [("xa", "minLength"), ("xb", "type")]),
        ({"patternProperties": {"^x": {}}, "properties": {"a": {}}, "additionalProperties": False}, {"a": 1, "x1": 2}, []),
        ({"patternProperties": {"^x": {}}, "additionalProperties": False}, {"a": 1}, [("", "additionalProperties")]),
        ({"patternProperties": {"^x": {}}, "additionalProperties": {"type": "string"}}, {"a": 1, "x": 2, "b": "s"}, [("a", "type")]),
        ({"propertyNames": {"maxLength": 2, "pattern": "^a"}}, {"abc": 1, "b": 2, "a": 3}, [("", "maxLength"), ("", "pattern")]),
        ({"propertyNames": False}, {"a": 1}, [("", "not")]),
        ({"propertyNames": False}, {}, []),
        ({"properties": {"a": {"$ref": "#/definitions/n"}}, "definitions": {"n": {"type": "integer"}}}, {"a": "x"}, [("a", "type")]),
        ({"$ref": "#/definitions/n", "type": "string", "definitions": {"n": {"minimum": 2}}}, 1, [("", "minimum")]),
        ({"properties": {"a": {"$ref": "#n"}}, "definitions": {"x": {"$id": "#n", "const": 1}}}, {"a": 2}, [("a", "const")]),
        ({"$ref": "#/definitions/a~1b%25", "definitions": {"a/b%": {"enum": [1]}}}, 2, [("", "enum")]),
        ({"dependentSchema": 1, "unknown": {}}, 1, []),
    ],
)
def test_keywords(spark, schema, document, found):
    assert errors_of(spark, schema, [document]) == [found]


def test_struct_and_map_columns(spark):
    """The same keywords on typed columns; names of struct fields are judged when the plan is made."""
    def found(sql, schema, **options):
        checked = validate_rows(spark.sql(sql), {"type": "object", "properties": {"v": schema}}, **options)
        return sorted((e["path"], e["keyword"]) for e in checked.first()["_errors"])

    assert found(TYPED, {"patternProperties": {"^x": {"minLength": 2}}}) == [("v.xa", "minLength")]
    assert found(TYPED, {"propertyNames": {"maxLength": 1}}) == [("v", "maxLength")]
    assert found(TYPED, {"propertyNames": {"pattern": "^[ax]"}}) == []
    assert found(TYPED, {"propertyNames": {"pattern": "^[ax]"}}, nulls="present") == [("v", "pattern")]
    assert found(TYPED, {"dependencies": {"a": ["b", "xa"], "b": ["zz"]}}) == [("v", "dependencies")]
    assert found(TYPED, {"dependencies": {"a": {"properties": {"xa": {"const": "r"}}}}}) == [("v.xa", "const")]
    assert found(TYPED, {"additionalProperties": False, "patternProperties": {"a": {}}}) == []
    assert found("SELECT map('a', 1, 'bb', 5) AS v", {"patternProperties": {"^b": {"maximum": 3}}, "propertyNames": {"maxLength": 1}}) == [
        ("v", "maxLength"), ("v.bb", "maximum")
    ]
    assert found("SELECT map('a', 1, 'bb', 5) AS v", {"properties": {"a": {}}, "additionalProperties": {"minimum": 9}}) == [("v.bb", "minimum")]
    assert found("SELECT array(1, 5) AS v", {"items": [{"maximum": 0}], "additionalItems": {"maximum": 4}, "contains": {"const": 5}}) == [
        ("v.0", "maximum"), ("v.1", "maximum")
    ]
    assert found("SELECT CAST(NULL AS ARRAY<INT>) AS v", {"items": [{}], "additionalItems": False, "contains": {}}) == []


TREE = {
    "$ref": "#/definitions/node",
    "definitions": {
        "node": {
            "type": "object", "required": ["name"],
            "properties": {"name": {"type": "string"}, "children": {"type": "array", "items": {"$ref": "#/definitions/node"}}},
        }
    },
}


def test_recursive_schema(spark):
    good = {"name": "r", "children": [{"name": "a", "children": []}, {"name": "b"}]}
    bad = {"name": "r", "children": [{"name": "a", "children": [{"name": 1}, {"children": [[]]}]}, {}]}
    assert errors_of(spark, TREE, [good, bad, None, 3]) == [
        [],
        [("children.0.children.0.name", "type"), ("children.0.children.1", "required"), ("children.0.children.1.children.0", "type"), ("children.1", "required")],
        [("", "type")], [("", "type")],
    ]


def test_depth_has_no_bound_but_the_parser_s(spark):
    deep = {"name": 1}
    for _ in range(300):
        deep = {"name": "x", "children": [deep]}
    assert errors_of(spark, TREE, [deep]) == [[("children.0." * 300 + "name", "type")]]


def test_plan_grows_with_the_schema_not_with_its_expansion(spark):
    """Forty definitions, each named twice by the one before: written out they would be 2 to the 40th."""
    definitions = {f"d{i}": {"properties": {k: {"$ref": f"#/definitions/d{i + 1}"} for k in "ab"}} for i in range(40)}
    definitions["d40"] = {"type": "integer"}
    schema = {"$ref": "#/definitions/d0", "definitions": definitions}
    assert errors_of(spark, schema, [{"a": {"b": {}}}, {"a": 1}]) == [[], []]


def test_references_that_go_nowhere_or_round(spark):
    df = spark.sql("SELECT parse_json('1') AS v")
    for schema in (
        {"definitions": {"a": {"$ref": "#/definitions/b"}, "b": {"$ref": "#/definitions/a"}}, "properties": {"v": {"$ref": "#/definitions/a"}}},
        {"definitions": {"a": {"allOf": [{"$ref": "#/definitions/a"}]}}, "properties": {"v": {"$ref": "#/definitions/a"}}},
        {"properties": {"v": {"$ref": "#/definitions/a"}}}, {"properties": {"v": {"$ref": "http://x/y.json"}}},
    ):
        with pytest.raises(ValueError):
            validate_rows(df, schema)


def test_ids_are_bases():
    inner = {"$id": "http://x/inner.json", "definitions": {"a": {"$id": "#a", "type": "integer"}}, "properties": {"p": {"$ref": "#/definitions/a"}}}
    document = {"$id": "http://x/root.json", "definitions": {"i": inner}, "properties": {"q": {"$ref": "inner.json#a"}, "r": {"$ref": "inner.json"}}}
    references = References(document)
    assert references.resolve(document["properties"]["q"]) is inner["definitions"]["a"]
    assert references.resolve(document["properties"]["r"]) is inner
    assert references.resolve(inner["properties"]["p"]) is inner["definitions"]["a"]


# -- random schemas against a plain evaluator ------------------------------------------


def is_type(value, name):
    number = isinstance(value, (int, float)) and not isinstance(value, bool)
    return {
        "null": value is None, "boolean": isinstance(value, bool), "string": isinstance(value, str), "array": isinstance(value, list),
        "object": isinstance(value, dict), "number": number, "integer": number and value == int(value),
    }[name]


def valid(value, schema, root):
    if isinstance(schema, bool):
        return schema
    if "$ref" in schema:
        return valid(value, root["definitions"][schema["$ref"].split("/")[-1]], root)
    ok = "type" not in schema or is_type(value, schema["type"])
    ok = ok and ("const" not in schema or value == schema["const"] and type(value) is type(schema["const"]))
    if isinstance(value, int) and not isinstance(value, bool):
        ok = ok and value >= schema.get("minimum", value)
    results = {k: [valid(value, s, root) for s in schema[k]] for k in ("allOf", "anyOf", "oneOf") if k in schema}
    ok = ok and all(results.get("allOf", [True])) and any(results.get("anyOf", [True])) and results.get("oneOf", [True]).count(True) == 1
    ok = ok and not ("not" in schema and valid(value, schema["not"], root))
    if "if" in schema:
        ok = ok and valid(value, schema.get("then" if valid(value, schema["if"], root) else "else", True), root)
    if isinstance(value, list):
        rule = schema.get("items", True)
        pairs = zip(value, rule) if isinstance(rule, list) else ((v, rule) for v in value)
        ok = ok and all([valid(v, r, root) for v, r in pairs])
        if isinstance(rule, list):
            ok = ok and all(valid(v, schema.get("additionalItems", True), root) for v in value[len(rule):])
        ok = ok and ("contains" not in schema or any([valid(v, schema["contains"], root) for v in value]))
    if isinstance(value, dict):
        ok = ok and all(k in value for k in schema.get("required", []))
        for k, v in value.items():
            subs = [schema["properties"][k]] if k in schema.get("properties", {}) else []
            subs += [s for p, s in schema.get("patternProperties", {}).items() if re.search(p, k)]
            ok = ok and all([valid(v, s, root) for s in subs or [schema.get("additionalProperties", True)]])
            ok = ok and valid(k, schema.get("propertyNames", True), root)
        for k, rule in schema.get("dependencies", {}).items():
            if k in value:
                ok = ok and (all(o in value for o in rule) if isinstance(rule, list) else valid(value, rule, root))
    return ok


def some_value(r, depth):
    kind = r.randrange(8 if depth else 5)
    if kind >= 5:
        if r.random() < 0.5:
            return [some_value(r, depth - 1) for _ in range(r.randrange(3))]
        return {k: some_value(r, depth - 1) for k in r.sample(["a", "b", "xa"], r.randrange(4))}
    return [None, True, 1, 5, "s"][kind]


def some_schema(r, depth, same=False):
    """A random schema; references only where the value has been stepped into, unless ``same``."""
    if r.random() < 0.3 or not depth:
        leaf = [True, {"type": r.choice(["string", "integer", "array", "object", "null"])}, {"minimum": 3}, {"const": 1}, {"required": ["a"]}]
        return r.choice(leaf + ([] if same else [{"$ref": f"#/definitions/{r.choice('pq')}"}] * 4))
    out = {}
    for _ in range(r.randint(1, 2)):
        keyword = r.choice(["properties", "items", "tuple", "contains", "anyOf", "oneOf", "allOf", "not", "if", "additionalProperties", "patternProperties", "dependencies"])
        inner = lambda: some_schema(r, depth - 1)
        here = lambda: some_schema(r, depth - 1, same)
        if keyword == "properties":
            out[keyword] = {k: inner() for k in r.sample("ab", r.randint(1, 2))}
        elif keyword == "tuple":
            out |= {"items": [inner()], "additionalItems": inner()}
        elif keyword in ("anyOf", "oneOf", "allOf"):
            out[keyword] = [here(), here()]
        elif keyword == "if":
            out |= {"if": here(), "then": here(), "else": here()}
        elif keyword == "patternProperties":
            out[keyword] = {"^x": inner()}
        elif keyword == "dependencies":
            out[keyword] = {"a": r.choice([["b"], here()])}
        else:
            out[keyword] = here() if keyword == "not" else inner()
    return out


@pytest.mark.parametrize("seed", range(10))
def test_random_recursive_schemas(spark, seed):
    r = random.Random(seed)
    root = {"definitions": {name: some_schema(r, 3, same=True) for name in "pq"}}
    schema = {**root, "anyOf": [{"$ref": "#/definitions/p"}, {"items": some_schema(r, 2)}]}
    values = [some_value(r, 4) for _ in range(60)]
    got = errors_of(spark, schema, values)
    assert [not e for e in got] == [valid(v, schema, root) for v in values], json.dumps(schema)


@pytest.mark.parametrize("depth", [1, SHALLOW - 1, SHALLOW, SHALLOW + 1, 3 * SHALLOW])
def test_levels_beyond_the_shallow_ones(spark, depth):
    """All levels are checked, and the depth of a value is not worked out bracket by bracket for those that are shallow."""
    text = '{"next":' * depth + '{"name":1}' + "}" * depth
    rows = spark.createDataFrame([(text,)], "text string").select(F.parse_json("text").alias("doc"))
    node = {"properties": {"name": {"type": "string"}, "next": {"$ref": "#/definitions/node"}}}
    schema = {"properties": {"doc": {"$ref": "#/definitions/node"}}, "definitions": {"node": node}}
    found = error_rows(validate_rows(rows, schema))
    assert [(r.path, r.keyword) for r in found.collect()] == [("doc." + "next." * depth + "name", "type")]
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert "split" not in plan and "regexp_replace" not in plan

import json

import pytest
from pyspark.sql import functions as F

from loomrow.functions.text import (
    dataset_key, extract_tags, key_parts, text_without_tags, truncate_text, without_extension,
)
from loomrow.operators.normalize import lift_tags, normalize, tag_names


def one(spark, text, build):
    return spark.createDataFrame([(text,)], "s string").select(build(F.col("s"))).first()[0]


@pytest.mark.parametrize(
    ("text", "rest", "tags"),
    [
        ("a<think> x\ny </think>b<t>q</t>", "ab", {"think": "x\ny", "t": "q"}),
        (None, None, {}),
        ("no tags < here", "no tags < here", {}),
        ("<t>1</t> z <t>2</t>", "z", {"t": "2"}),
        ("<a><b>in</b></a>", "", {"a": "<b>in</b>"}),
        ("<a>open <b>x</b>", "<a>open", {"b": "x"}),
        ("<co: 1></co> <a href='x'>y</a>", "<co: 1></co> <a href='x'>y</a>", {}),
        ("<t></t>x", "x", {"t": ""}),
        ("   x \x1f\n", "x", {}),
    ],
)
def test_tags(spark, text, rest, tags):
    assert one(spark, text, extract_tags) == tags
    assert one(spark, text, text_without_tags) == rest


def test_only_named_tags(spark):
    assert one(spark, "<a>1</a><b>2</b>", lambda c: extract_tags(c, tags=["b"])) == {"b": "2"}
    assert one(spark, "<a>1</a><b>2</b>", lambda c: text_without_tags(c, tags=["b"])) == "<a>1</a>"


@pytest.mark.parametrize(("n", "result"), [(120, "é" * 120), (121, "é" * 120 + "...")])
def test_truncation(spark, n, result):
    assert one(spark, " " + "é" * n + " ", truncate_text) == result
    assert one(spark, "<t>" + "é" * n + "</t>", extract_tags) == {"t": result}


def test_truncation_settles(spark):
    once = one(spark, "x" * 500, truncate_text)
    assert one(spark, one(spark, once, truncate_text), truncate_text) == one(spark, once, truncate_text)


def test_long_texts_are_searched_whole(spark):
    text = "x" * 200_000 + "<t>" + "y" * 200_000 + "</t>" + "<b>" * 50
    assert one(spark, text, lambda c: F.length(extract_tags(c, None)["t"])) == 200_000


def test_lifted_tags(spark, rows):
    df = spark.createDataFrame(
        [("<t>q</t>rest", (1,), [(" s ",)], ["<t>u</t>v"]), ("plain", None, None, None)],
        "k string, o struct<z:int>, l array<struct<w:string>>, m array<string>",
    )
    first, second = rows(normalize(df, tags=["t"]))
    assert first == {
        "k": None, "t": "q", "value": "rest", "z": 1, "l": [{"w": "s", "t": None, "value": None}],
        "m": [{"value": "v", "t": "u"}],
    }
    assert second == {"k": "plain", "t": None, "value": None, "z": None, "l": None, "m": None}


def test_later_fields_win_when_flattened(spark, rows):
    df = spark.createDataFrame([("<t>1</t>", ("x", "<t>2</t>"), 5)], "a string, o struct<b:string,c:string>, b int")
    assert rows(normalize(df, tags=["t"])) == [{"a": None, "t": "2", "value": None, "b": 5, "c": None}]


def test_tags_as_a_map(spark, rows):
    df = spark.createDataFrame([("<t>1</t>x", ("<u>2</u>", [1]))], "a string, o struct<b:string,n:array<int>>")
    assert rows(normalize(df)) == [{"a": "x", "b": "", "n": [1], "_tags": {"t": "1", "u": "2"}}]


def test_tag_names(spark, rows):
    df = spark.createDataFrame([("<t>1</t><t>2</t>", "<u>3</u>"), (None, None)], "a string, b string")
    assert rows(tag_names(df, ["a", "b"]), "tag") == [{"tag": "t", "n": 2}, {"tag": "u", "n": 1}]


def test_names(spark):
    df = spark.sql("SELECT 'v1' AS a, 'd__x' AS b, timestamp '2025-02-01 10:05:59' AS t")
    key = df.select(dataset_key(F.col("a"), F.col("b"), F.lit("s"), stamp=F.col("t")).alias("k"))
    assert key.first()[0] == "v1__d__x__s__202502011005"
    assert tuple(spark.sql("SELECT 'v1__d__s__202502011005.json' AS k").select(*key_parts(F.col("k"))).first()) == (
        "v1", "d", "s", "202502011005",
    )
    assert one(spark, "x.jsonl.gz", without_extension) == "x.jsonl"
    assert one(spark, "a/.hidden", without_extension) == "a/.hidden"


def test_outer_pairs_come_first(spark, rows):
    df = spark.createDataFrame([("<b>x<think>t</think>y</b>",), ("<b>1</b><think>2</think>3<c>4</c>",)], "s string")
    assert rows(normalize(df, tags=["think"])) == [
        {"s": "<b>x<think>t</think>y</b>", "think": None, "value": None}, {"s": None, "think": "2", "value": "<b>1</b>3<c>4</c>"}
    ]
    lifted = [json.loads(r[0]) for r in lift_tags(df).select(F.to_json("sample")).collect()]
    assert lifted == [{"b": "x<think>t</think>y"}, {"b": "1", "think": "2", "c": "4", "value": "3"}]


def test_lifted_objects(spark):
    df = spark.createDataFrame(
        [(1, "<t>q</t>rest", (1, "<t>later</t>"), [("<a>1</a>",), None], ["u", "<v>2</v>w", None], {"m": "<x>1</x>"}), (2, None, None, None, [], None)],
        "k int, s string, o struct<z:int,y:string>, l array<struct<w:string>>, e array<string>, p map<string,string>",
    )
    first, second = [json.loads(r[0]) for r in lift_tags(df, keep=["k"]).orderBy("k").select(F.to_json("sample")).collect()]
    assert first == {
        "k": 1, "t": "later", "value": "rest", "z": 1, "l": [{"a": "1"}, None], "e": ["u", {"v": "2", "value": "w"}, None], "p": {"m": "<x>1</x>"},
    }
    assert second == {"k": 2, "s": None, "o": None, "l": None, "e": [], "p": None}
    long = spark.createDataFrame([("<t>" + "x" * 130 + "</t>" + "y" * 125,)], "s string")
    assert json.loads(lift_tags(long).select(F.to_json("sample")).first()[0]) == {"t": "x" * 120 + "...", "value": "y" * 120 + "..."}

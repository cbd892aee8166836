"""The mapper, rule by rule. Expected rows are worked out by hand."""

import pytest
from pyspark.sql import functions as F

from conformance.registry import constant, entry
from loomrow import MappingError, TransformRegistry, apply_mapping, map_and_validate
from loomrow.operators.mapping import conform, preview_mapping, split_valid
from loomrow.resources import chat_schema

CHAT = chat_schema()
INTEGER = {"type": "integer"}


def props(**properties):
    return {"type": "object", "properties": properties}


@pytest.fixture
def mapped(rows):
    def run(df, mapping, schema=None, **options):
        return rows(apply_mapping(df, mapping, schema, **options))

    return run


def message(role=None, content=None, **more):
    return {"role": role, "content": content, "functioncall": None, "think": None, "context": None, **more}


def chat_row(**fields):
    return {
        "template": "fc_chat_st", "system": None, "context": None, "_lang": None, "_dataset_name": None,
        "_filename": None, "_subpath": None, "_id_hash": None, **fields,
    }


# -- whole rows ---------------------------------------------------------------------------


def test_prompt_and_response(spark, mapped):
    df = spark.createDataFrame([("p", "r")], "prompt string, response string")
    mapping = [
        constant("template", "fc_chat_st"), constant("system", None), entry("prompt", "messages[0].content"),
        constant("messages[0].role", "USER"), entry("response", "messages[1].content"),
        constant("messages[1].role", "ASSISTANT"), constant("messages[0].functioncall", None),
        constant("_filename", "file"), constant("_subpath", "data"),
    ]
    assert mapped(df, mapping, CHAT) == [
        chat_row(messages=[message("USER", "p"), message("ASSISTANT", "r")], _filename="file", _subpath="data")
    ]
    assert map_and_validate(df, mapping, CHAT).first()["_valid"]


TURNS = "id int, conversations array<struct<from:string,value:string,think:string>>"
TURN_MAPPING = [
    entry("conversations[].from", "messages[].role", {"human": "USER", "gpt": "ASSISTANT"}),
    entry("conversations[].value", "messages[].content"),
    entry("conversations[].think", "messages[].think"),
    constant("messages[].functioncall", None),
    constant("_dataset_name", "open"),
]


def test_conversation(spark, mapped):
    turns = [("human", "Q", None), ("gpt", "A", "T"), ("system", "S", None)]
    df = spark.createDataFrame([(1, turns)], TURNS)
    expected = [message("USER", "Q"), message("ASSISTANT", "A", think="T"), message("USER", "S")]
    assert mapped(df, TURN_MAPPING, CHAT) == [chat_row(messages=expected, _dataset_name="open")]


def test_conversation_without_turns_is_one_empty_message(spark, rows):
    df = spark.createDataFrame([(1, None), (2, [])], TURNS)
    checked = rows(map_and_validate(df, TURN_MAPPING, CHAT, keep=["id"]), "id")
    for row in checked:
        assert row["messages"] == [message()]
        assert [(e["path"], e["keyword"]) for e in row["_errors"]] == [("messages.0", "required")]
        assert not row["_valid"]


def test_descriptions_are_plain_copies(spark, mapped):
    df = spark.createDataFrame([("s", "q", "a", "d")], "system_prompt string, question string, answer string, x string")
    mapping = [
        entry("system_prompt", "system", "Copy the prompt."), entry("question", "messages[0].content", "Copy it."),
        constant("messages[0].role", "USER"), entry("answer", "messages[1].content", "Copy it."),
        constant("messages[1].role", "ASSISTANT"), constant("_lang", "en"),
    ]
    assert mapped(df, mapping, CHAT) == [
        chat_row(system="s", messages=[message("USER", "q"), message("ASSISTANT", "a")], _lang="en")
    ]


def test_words_are_constants_and_unknown_targets_are_kept(spark, rows):
    schema = {**CHAT, "properties": {**CHAT["properties"], "template": {"type": "string", "enum": ["fc_chat_st"]}}}
    schema["additionalProperties"] = "false"  # a non-empty text allows extra fields
    df = spark.createDataFrame([("p",)], "prompt string")
    mapping = [
        constant("template", "chat_template"), constant("system", "N/A"), constant("context", "null"),
        entry("prompt", "messages[0].content", "text"), constant("messages[0].role", "USER"),
        constant("function_call", "null"), constant("_file_name", "f"),
    ]
    row = rows(map_and_validate(df, mapping, schema))[0]
    assert row["template"] == "chat_template" and row["system"] == "N/A" and row["context"] == "null"
    assert row["function_call"] == "null" and row["_file_name"] == "f" and row["_filename"] is None
    assert [(e["path"], e["keyword"]) for e in row["_errors"]] == [("template", "enum")]

    closed = {**schema, "additionalProperties": False}
    errors = map_and_validate(df, mapping, closed).first()["_errors"]
    assert {(e["path"], e["keyword"]) for e in errors} == {("template", "enum"), ("", "additionalProperties")}


# -- reading paths ------------------------------------------------------------------------


def test_missing_places_read_as_null(spark, mapped):
    df = spark.createDataFrame([([("x",)], "text")], "a array<struct<b:string>>, s string")
    mapping = [
        entry("a[0].b", "found"), entry("a[5].b", "beyond"), entry("s.b", "not_object"), entry("s[0]", "not_array"),
        entry("a[].b", "each"), entry("none", "none"),
    ]
    assert mapped(df, mapping) == [
        {"found": "x", "beyond": None, "not_object": None, "not_array": None, "each": None, "none": None}
    ]


def test_names_with_dots_and_shadowed_names(spark, mapped):
    df = spark.createDataFrame([("x", "y")], "`a b` string, b string")
    assert mapped(df, [entry("a b", "b"), entry("b", "a b")]) == [{"b": "x", "a b": "y"}]


def test_variant_source(spark, mapped):
    df = spark.sql("""SELECT parse_json('{"a":{"b":[{"c":"x"},{"c":5}]},"k":"human"}') AS v""")
    mapping = [entry("v.a.b[0].c", "p"), entry("v.a.b[1].c", "n"), entry("v.k", "r", {"human": "USER"})]
    schema = props(p={"type": "string"}, n=INTEGER, r={"type": "string"})
    assert mapped(df, mapping, schema) == [{"p": "x", "n": 5, "r": "USER"}]


def test_semi_structured_rows_map_without_a_schema(spark, rows):
    texts = [
        '{"id":1,"conversations":[{"from":"human","value":"Q"},{"from":"gpt","value":"A","think":"T"},{"from":"x"}]}',
        '{"id":"7","conversations":[]}', '{"id":null,"conversations":"text","tags":["a",1]}', '[1]',
    ]
    df = spark.createDataFrame([(n, t) for n, t in enumerate(texts)], "n int, t string")
    df = df.select("n", F.parse_json("t").alias("doc"))
    schema = {**CHAT, "properties": {**CHAT["properties"], "id": INTEGER, "tags": {"type": "array", "items": {"type": "string"}}}}
    mapping = [*TURN_MAPPING, entry("id", "id"), entry("tags", "tags"), entry("conversations[1].value", "system")]
    found = rows(apply_mapping(df, mapping, schema, keep=["n"], root="doc"), "n")
    assert [r["id"] for r in found] == [1, 7, None, None]
    assert found[0]["messages"] == [message("USER", "Q"), message("ASSISTANT", "A", think="T"), message("USER", None)]
    assert found[0]["system"] == "A"
    assert [r["messages"] for r in found[1:]] == [[message()]] * 3
    assert found[2]["tags"] == ["a", "1"]
    errors = rows(apply_mapping(df, [entry("conversations[].value", "m[]")],
                                props(m={"type": "array", "items": INTEGER}), root="doc", errors=True))
    assert [e["path"] for e in errors[0]["_errors"]] == ["m.0", "m.1"]


# -- constants and dictionaries -----------------------------------------------------------


def test_no_source_spellings(spark, mapped):
    df = spark.range(1)
    mapping = [entry("N/A", "a", "1"), entry("", "b", 2), entry(None, "c", True), entry("N/A", "d", {"x": "y"})]
    assert mapped(df, mapping) == [{"a": "1", "b": 2, "c": True, "d": None}]


def test_dictionary_misses_and_other_types(spark, mapped):
    df = spark.createDataFrame([("a", 1), ("z", 1), (None, 1)], "s string, n int")
    mapping = [entry("s", "x", {"a": "A", "b": None}), entry("n", "y", {"1": "one"})]
    assert mapped(df, mapping) == [{"x": "A", "y": None}, {"x": None, "y": None}, {"x": None, "y": None}]


def test_large_dictionary_inside_an_array(spark, mapped):
    pairs = {f"key {n} é": f"value {n}" for n in range(500)}
    df = spark.createDataFrame([([("key 7 é",), ("key 499 é",), ("none",)],)], "a array<struct<k:string>>")
    assert mapped(df, [entry("a[].k", "m[].v", pairs)]) == [
        {"m": [{"v": "value 7"}, {"v": "value 499"}, {"v": None}]}
    ]


def test_later_writers_win(spark, mapped):
    df = spark.createDataFrame([("s",)], "s string")
    assert mapped(df, [entry("s", "x"), constant("x", "c")]) == [{"x": "c"}]


# -- arrays -------------------------------------------------------------------------------


def test_gaps_in_static_arrays_are_null(spark, mapped):
    assert mapped(spark.range(1), [constant("m[2].x", "v")]) == [{"m": [None, None, {"x": "v"}]}]


def test_arrays_of_different_length_are_aligned(spark, mapped):
    df = spark.createDataFrame([([("x",), ("y",)], [(1,), (2,), (3,)])], "a array<struct<x:string>>, b array<struct<y:int>>")
    assert mapped(df, [entry("a[].x", "m[].p"), entry("b[].y", "m[].q")]) == [
        {"m": [{"p": "x", "q": 1}, {"p": "y", "q": 2}, {"p": None, "q": 3}]}
    ]


def test_dynamic_elements_replace_static_ones_even_with_null(spark, mapped):
    df = spark.createDataFrame([([(None,)],), ([],), (None,)], "a array<struct<v:string>>")
    mapping = [constant("m[0].x", "s"), entry("a[].v", "m[].x")]
    assert mapped(df, mapping) == [{"m": [{"x": None}]}, {"m": [{"x": "s"}]}, {"m": [{"x": "s"}]}]


def test_static_slots_beyond_a_short_source_stay(spark, mapped):
    df = spark.createDataFrame([(["a", None],), (["a", "b", "c", "d"],)], "s array<string>")
    mapping = [constant(f"m[{n}]", f"S{n}") for n in range(3)] + [entry("s[]", "m[]")]
    assert mapped(df, mapping) == [{"m": ["a", None, "S2"]}, {"m": ["a", "b", "c", "d"]}]


DEEP = "a array<struct<b:array<struct<c:string>>>>"
DEEP_ROW = ([([("00",), ("01",)],), ([("10",), ("11",)],), (None,)],)


def test_nested_levels_share_their_position_by_default(spark, mapped):
    df = spark.createDataFrame([DEEP_ROW], DEEP)
    assert mapped(df, [entry("a[].b[].c", "m[].v")]) == [{"m": [{"v": "00"}, {"v": "11"}, {"v": None}]}]
    assert mapped(df, [entry("a[].b[].c", "m[].n[].v")]) == [
        {"m": [{"n": [{"v": "00"}]}, {"n": [None, {"v": "11"}]}, {"n": [None, None, {"v": None}]}]}
    ]


def test_nested_levels_in_full(spark, mapped):
    df = spark.createDataFrame([DEEP_ROW], DEEP)
    full = [{"n": [{"v": "00"}, {"v": "01"}]}, {"n": [{"v": "10"}, {"v": "11"}]}, {"n": None}]
    assert mapped(df, [entry("a[].b[].c", "m[].n[].v")], nested="full") == [{"m": full}]
    both = [entry("a[].b[].c", "m[].n[].v"), entry("a[].b[].c", "m[].n[].w")]
    assert mapped(df, both, nested="full")[0]["m"][0]["n"][1] == {"v": "01", "w": "01"}
    flat = [{"v": ["00", "01"]}, {"v": ["10", "11"]}, {"v": None}]
    assert mapped(df, [entry("a[].b[].c", "m[].v")], nested="full") == [{"m": flat}]


def test_whole_elements_are_cast_and_failures_reported(spark, rows):
    df = spark.createDataFrame([(["1", "x", None],)], "tags array<string>")
    schema = props(labels={"type": "array", "items": INTEGER})
    row = rows(apply_mapping(df, [entry("tags[]", "labels[]")], schema, errors=True))[0]
    assert row["labels"] == [1, None, None]
    assert [(e["path"], e["keyword"]) for e in row["_errors"]] == [("labels.1", "cast")]


def test_copied_elements_can_be_overlaid(spark, mapped):
    df = spark.createDataFrame([([("human", "Q")],)], "a array<struct<from:string,content:string>>")
    mapping = [entry("a[]", "m[]"), entry("a[].from", "m[].role", {"human": "USER"})]
    assert mapped(df, mapping) == [{"m": [{"from": "human", "content": "Q", "role": "USER"}]}]


def test_arrays_below_static_places(spark, mapped):
    df = spark.createDataFrame([(["a", "b"],), ([],)], "s array<string>")
    assert mapped(df, [entry("s[]", "m[0].parts[].t"), constant("k", 1)]) == [
        {"m": [{"parts": [{"t": "a"}, {"t": "b"}]}], "k": 1}, {"m": None, "k": 1}
    ]


def test_dynamic_target_needs_a_source_array(spark, mapped):
    df = spark.createDataFrame([("x", 5)], "s string, n int")
    schema = props(m={"type": ["array", "null"], "items": props(x={"type": "string"})})
    assert mapped(df, [constant("m[].x", "c"), entry("s", "m[].x")], schema) == [{"m": None}]
    assert mapped(df, [entry("n[].a", "m[].x")], schema) == [{"m": None}]


def test_nothing_is_cast_below_a_nullable_array(spark, mapped):
    df = spark.createDataFrame([([("1",)],)], "a array<struct<v:string>>")
    items = props(v=INTEGER)
    assert mapped(df, [entry("a[].v", "m[].v")], props(m={"type": "array", "items": items})) == [{"m": [{"v": 1}]}]
    nullable = props(m={"type": ["array", "null"], "items": items})
    assert mapped(df, [entry("a[].v", "m[].v")], nullable) == [{"m": [{"v": "1"}]}]


# -- defaults -----------------------------------------------------------------------------


def test_null_values_take_default_enum_or_null(spark, mapped):
    df = spark.createDataFrame([("a",), (None,)], "s string")
    schema = props(
        d={"type": "string", "default": "D"}, e={"type": "string", "enum": ["E", "F"]},
        n={"type": ["string", "null"]}, w={"type": "string", "default": "null"},
    )
    mapping = [entry("s", name) for name in "denw"]
    assert mapped(df, mapping, schema) == [
        {"d": "a", "e": "a", "n": "a", "w": "a"}, {"d": "D", "e": "E", "n": None, "w": None}
    ]


def test_unmapped_properties(spark, mapped):
    schema = props(
        d={"type": "string", "default": "D"}, e={"enum": ["E"]}, plain={"type": "string"},
        req={"type": "array", "minItems": 2, "items": props(x=INTEGER)}, obj=props(k={"type": "string"}),
    )
    schema["required"] = ["req", "obj"]
    assert mapped(spark.range(1), [constant("z", 1)], schema) == [
        {"d": "D", "e": "E", "plain": None, "req": [{"x": None}, {"x": None}], "obj": {"k": None}, "z": 1}
    ]


def test_objects_are_completed_at_every_level(spark, mapped):
    df = spark.createDataFrame([(("v",), [("w",), None])], "o struct<a:string>, l array<struct<a:string>>")
    inner = props(a={"type": "string"}, b={"type": "string", "default": "B"})
    schema = props(o=inner, l={"type": "array", "items": inner}, built=inner)
    mapping = [entry("o", "o"), entry("l", "l"), entry("o.a", "built.a")]
    done = {"a": "v", "b": "B"}
    assert mapped(df, mapping, schema) == [{"o": done, "l": [{"a": "w", "b": "B"}, None], "built": done}]


def test_items_of_arrays_ignore_the_mapping_targets(spark, mapped):
    df = spark.createDataFrame([([("w",)],)], "l array<struct<a:string>>")
    items = props(a={"type": "string"}, c={"type": "string"})
    schema = props(l={"type": "array", "items": items})
    assert mapped(df, [entry("l[].a", "l[].a")], schema) == [{"l": [{"a": "w", "c": None}]}]


@pytest.mark.parametrize(("dummy", "values"), [(False, (None, None, None, None)), (True, ("", 0, 0.0, False))])
def test_dummy_mode(spark, mapped, dummy, values):
    kinds = ["string", "integer", "number", "boolean"]
    schema = {**props(**{kind: {"type": kind} for kind in kinds}), "required": kinds}
    row = mapped(spark.range(1), [constant("z", 1)], schema, dummy=dummy)[0]
    assert tuple(row[kind] for kind in kinds) == values


def test_without_schema_nothing_is_added_or_cast(spark, mapped):
    df = spark.createDataFrame([("1",)], "s string")
    assert mapped(df, [entry("s", "x")], None) == [{"x": "1"}]
    assert mapped(df, [entry("s", "x")], {}) == [{"x": "1"}]


# -- conflicts, registry, other operators ---------------------------------------------------


@pytest.mark.parametrize(
    "targets", [["a.b", "a[0]"], ["[0].x"], ["a", "a.b"]],
)
def test_container_conflicts(spark, targets):
    with pytest.raises(MappingError):
        apply_mapping(spark.range(1), [constant(t, "v") for t in targets], None)


@pytest.mark.parametrize("mapping", [{"src_field": "a"}, ["a"], None])
def test_mapping_must_be_a_list_of_objects(spark, mapping):
    with pytest.raises(MappingError):
        apply_mapping(spark.range(1), mapping, None)


def test_registered_transforms_only_on_request(spark, mapped):
    registry = TransformRegistry()
    registry.register("upper", F.upper)
    df = spark.createDataFrame([("x",), (None,)], "s string")
    mapping = [entry("s", "a", "upper"), entry("s", "b", "ASSISTANT"), entry("s", "c", "other")]
    plain = mapped(df, mapping, registry=registry)
    assert plain[0] == {"a": "x", "b": "x", "c": "x"}
    used = mapped(df, mapping, registry=registry, dispatch=True)
    assert used == [{"a": "X", "b": "ASSISTANT", "c": "x"}, {"a": None, "b": None, "c": None}]


def test_rows_in_are_rows_out(spark):
    df = spark.range(100).withColumn("s", F.col("id").cast("string"))
    assert apply_mapping(df, [entry("s", "x")], props(x=INTEGER)).count() == 100


def test_conform(spark, rows):
    df = spark.createDataFrame([("12", [("7",), ("x",)], 1)], "a string, b array<struct<c:string>>, z int")
    schema = {
        **props(a=INTEGER, b={"type": "array", "items": props(c=INTEGER, d={"type": "string"})},
                q={"type": "string", "enum": ["e"]}, r={"type": "number"}),
        "required": ["q"],
    }
    assert rows(conform(df, schema)) == [
        {"a": 12, "b": [{"c": 7, "d": None}, {"c": None, "d": None}], "q": "e", "r": None}
    ]


def test_preview_and_split(spark, rows):
    df = spark.createDataFrame([(2, "b"), (1, "a")], "id int, s string")
    shown = rows(preview_mapping(df, [entry("s", "x")], None, 1, order_by=["id"]))
    assert shown == [{"source": {"id": 1, "s": "a"}, "target": {"x": "a"}}]
    checked = map_and_validate(df, [entry("s", "x")], props(x={"type": "string", "enum": ["a"]}))
    good, bad = split_valid(checked)
    assert rows(good) == [{"x": "a"}] and bad.count() == 1


@pytest.mark.parametrize("size", [3, 10, 64, 65, 5000])
def test_dictionary_values_are_coerced_one_by_one_at_any_size(spark, size):
    listed = {f"k{i}": str(i) for i in range(size)} | {"bad": "abc", "minus": "-5", "yes": True, "half": 2.5}
    schema = {"type": "object", "properties": {"n": {"type": "integer"}}}
    df = spark.createDataFrame([("k1",), ("bad",), ("minus",), ("yes",), ("half",), ("none",), (None,)], "k string")
    mapped = apply_mapping(df, [{"src_field": "k", "target_field": "n", "transformation": listed}], schema, errors=True)
    got = [(r.n, len(r._errors)) for r in mapped.collect()]
    # "-5" is no whole number to these rules, wherever it stands
    assert got == [(1, 0), (None, 1), (None, 1), (1, 0), (2, 0), (None, 0), (None, 0)]


@pytest.mark.parametrize("size", [2, 100])
def test_dictionary_of_objects(spark, size):
    listed = {f"k{i}": {"x": i, "y": [str(i)]} for i in range(size)}
    schema = {"type": "object", "properties": {"o": {
        "type": "object", "properties": {"x": {"type": "integer"}, "y": {"type": "array", "items": {"type": "string"}}}}}}
    df = spark.createDataFrame([("k1",), ("no",)], "k string")
    mapped = apply_mapping(df, [{"src_field": "k", "target_field": "o", "transformation": listed}], schema)
    assert [r.o and (r.o.x, r.o.y) for r in mapped.collect()][0] == (1, ["1"])


def test_names_that_differ_in_case_alone(spark):
    """Both keys of a source are read, whatever the session says; two such targets are refused when the plan is made."""
    df = spark.createDataFrame([('{"Text":"upper","text":"lower","o":{"K":1,"k":2}}',)], "t string").select(F.parse_json("t").alias("value"))
    mapping = [entry("Text", "a"), entry("text", "b"), entry("o.K", "c"), entry("o.k", "d"), entry("TEXT", "e")]
    schema = {"type": "object", "properties": {n: {"type": ["string", "null"]} for n in "abcde"}}
    row = apply_mapping(df, mapping, schema, root="value").select(*[F.col(n).cast("string") for n in "abcde"]).first()
    assert tuple(row) == ("upper", "lower", "1", "2", None)
    for targets in (("Text", "text"), ("m[0].A", "m[0].a"), ("o.x", "o.X")):
        with pytest.raises(MappingError, match="case alone"):
            apply_mapping(df, [entry("Text", targets[0]), entry("text", targets[1])], root="value")

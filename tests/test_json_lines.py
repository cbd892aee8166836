"""Odd lines: every route refuses the same ones, no line stops a job, and nothing is dropped."""

import json

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from conformance.registry import entry
from loomrow import map_dataset
from loomrow.sources import readers
from loomrow.streaming.incremental import map_new_files, stream_source

GOOD = [
    '{"id":1,"t":"a"}', ' {"id":2,"t":5,"n":{"x":[1,2]}} ', '{"id":"x","t":null}', '{"id":12345678901234567890}', "{}", '{"id":1.5,"t":{"k":1}}',
    '{"id":7,"t":"br{ack]et","T":"other"}',
]
BAD = [
    '{"id":4,"t":"d"} junk', '[{"id":1},{"id":2}]', '{"id":1},{"id":2}', '{"id":1}]', '{"id":1}}', "not json", "5", "null", '"text"',
    '{"id":NaN}', "{'id':1}", '{"id":1,}', '{"id":01}', '{"id":1,"id":2}', '{"n":{"a":1,"a":2}}', '{"id":', '[{"id":1}]', "true", '{"id":1} {"id":2}',
]


@pytest.fixture
def folder(tmp_path):
    place = tmp_path / "in"
    place.mkdir()
    (place / "a.jsonl").write_text("\n".join([*GOOD[:4], "", " \t ", *BAD[:10]]) + "\n")
    (place / "b.json").write_text("\n".join([*BAD[10:], *GOOD[4:]]))
    return str(place)


def test_the_same_lines_are_refused_on_every_route(spark, folder):
    typed = readers.read_json_lines(spark, folder, schema="id bigint, t string")
    free = readers.read_json_variant(spark, folder)
    for df in (typed, free):
        assert sorted(r["_bad_line"] for r in df.where("_bad_line is not null").collect()) == sorted(BAD)
        assert df.where("_bad_line is null").count() == len(GOOD)
    rows = sorted((r["id"] or 0, r["t"] or "") for r in typed.where("_bad_line is null").collect())
    assert rows == [(0, ""), (0, ""), (0, ""), (0, '{"k":1}'), (1, "a"), (2, "5"), (7, "br{ack]et")]


def test_columns_are_found(spark, folder, tmp_path):
    with pytest.raises(ValueError, match="differ in case"):
        readers.read_json_lines(spark, folder)
    (tmp_path / "c.jsonl").write_text("\n".join([*GOOD[:6], *BAD]))
    found = readers.read_json_lines(spark, str(tmp_path / "c.jsonl"))
    types = {f.name: f.dataType.simpleString() for f in found.schema}
    assert types == {"id": "string", "t": "string", "n": "struct<x:array<bigint>>", "_bad_line": "string"}
    good, bad = readers.quarantine(found)
    assert (good.count(), bad.count()) == (6, len(BAD))
    assert good.where("id = 2").first()["n"]["x"] == [1, 2]
    (tmp_path / "none.jsonl").write_text("bad\n")
    assert readers.read_json_lines(spark, str(tmp_path / "none.jsonl")).columns == ["_bad_line"]


def test_values_that_do_not_fit(spark):
    lines = spark.createDataFrame([('{"a":[1,"x",2.5],"s":{"k":"v","n":"no"},"m":{"p":1,"q":"w"}}',), ('{"a":"b","s":1,"m":null}',)], "value string")
    schema = T.StructType.fromDDL("a array<int>, s struct<k string, n int>, m map<string, int>")
    rows = readers.parse_json_lines(lines, schema, bad_fields=True).collect()
    assert rows[0]["a"] == [1, None, None] and rows[0]["s"].asDict() == {"k": "v", "n": None} and rows[0]["m"] == {"p": 1, "q": None}
    assert rows[0]["_bad_fields"] == ["a", "s", "m"] and rows[1]["_bad_fields"] == ["a", "s"]
    assert (rows[1]["a"], rows[1]["s"], rows[1]["m"]) == (None, None, None)


SCHEMA = {"type": "object", "properties": {"key": {"type": "integer"}, "text": {"type": "string"}, "upper": {"type": "string"}}}
MAPPING = [entry("id", "key"), entry("t", "text"), entry("T", "upper")]


def test_whole_job_keeps_everything(spark, folder, tmp_path):
    out = str(tmp_path / "out")
    run = map_dataset(spark, folder, out, MAPPING, SCHEMA)
    assert (run.total_files, run.total_processed_samples, run.rejected_lines, run.flawed_rows) == (2, len(GOOD), len(BAD), 3)
    stored = spark.read.parquet(out)
    assert [r.upper for r in stored.where("key = 7").collect()] == ["other"]
    problems = spark.read.parquet(run.problems)
    assert sorted(r._line for r in problems.where("_outcome = 'refused'").collect()) == sorted(BAD)
    flawed = problems.where("_outcome = 'flawed'").select(F.explode("_errors").alias("e")).select("e.path", "e.keyword").collect()
    assert sorted(map(tuple, flawed)) == [("key", "cast"), ("key", "cast"), ("text", "cast")]
    again = map_dataset(spark, folder, out, MAPPING, SCHEMA, mode="append")
    assert (again.total_processed_samples, again.rejected_lines) == (len(GOOD), len(BAD)) and again.run_id != run.run_id
    assert sum(r["rows"] for r in again.per_file.collect()) == len(GOOD) and stored.sparkSession.read.parquet(out).count() == 2 * len(GOOD)
    assert spark.read.parquet(again.problems).where(F.col("_run_id") == again.run_id).count() == len(BAD) + 3


def test_one_pass_by_outcome(spark, folder, tmp_path):
    out = str(tmp_path / "out")
    run = map_dataset(spark, folder, out, MAPPING, SCHEMA, by_outcome=True)
    counts = {r["_outcome"]: r["count"] for r in spark.read.parquet(out).groupBy("_outcome").count().collect()}
    assert counts == {"mapped": len(GOOD) - 3, "flawed": 3, "refused": len(BAD)}
    assert (run.total_processed_samples, run.rejected_lines, run.flawed_rows) == (len(GOOD), len(BAD), 3)
    refused = spark.read.parquet(f"{out}/_outcome=refused")
    assert refused.where("key is not null or text is not null").isEmpty() and sorted(r._line for r in refused.collect()) == sorted(BAD)


def test_given_schema_and_no_target_schema(spark, folder, tmp_path):
    run = map_dataset(spark, folder, str(tmp_path / "a"), [entry("id", "key")], source_schema=T.StructType.fromDDL("id bigint"))
    assert (run.total_processed_samples, run.rejected_lines, run.flawed_rows) == (len(GOOD), len(BAD), 3)
    run = map_dataset(spark, folder, str(tmp_path / "b"), [entry("id", "key"), entry("n", "nested")])
    stored = spark.read.parquet(str(tmp_path / "b"))
    assert {f.name: f.dataType.simpleString() for f in stored.schema}["nested"] == "struct<x:array<bigint>>"
    assert run.total_processed_samples == len(GOOD)


def test_parquet_and_lines_in_one_folder(spark, folder, tmp_path):
    spark.createDataFrame([(90, "p")], "id int, t string").write.parquet(f"{folder}/pq")
    run = map_dataset(spark, folder, str(tmp_path / "out"), MAPPING, SCHEMA)
    assert run.total_processed_samples == len(GOOD) + 1
    assert [r.text for r in spark.read.parquet(str(tmp_path / "out")).where("key = 90").collect()] == ["p"]
    run = map_dataset(spark, folder, str(tmp_path / "free"), [entry("t", "x")])
    assert run.total_processed_samples == len(GOOD) + 1


def test_stream_keeps_everything(spark, folder, tmp_path):
    def run():
        source = stream_source(spark, f"{folder}/*.json*", T.StructType.fromDDL("id bigint, t string"), file_format="json")
        map_new_files(source, str(tmp_path / "so"), str(tmp_path / "ck"), MAPPING[:2], SCHEMA, by_outcome=True).awaitTermination()
        rows = spark.read.parquet(str(tmp_path / "so")).groupBy("_outcome").count().collect()
        return {r["_outcome"]: r["count"] for r in rows}

    assert run() == {"mapped": len(GOOD) - 3, "flawed": 3, "refused": len(BAD)}
    with open(f"{folder}/later.json", "w") as out:
        out.write(json.dumps({"id": 50}) + "\nbad\n")
    assert run() == {"mapped": len(GOOD) - 2, "flawed": 3, "refused": len(BAD) + 1}

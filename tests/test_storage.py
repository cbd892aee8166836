import gzip

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from conformance.registry import entry
from loomrow import MappingError, map_dataset
from loomrow.operators import query
from loomrow.session import work_folder
from loomrow.sinks import files
from loomrow.sources import discovery, readers
from loomrow.streaming.incremental import map_new_files, stream_source


@pytest.fixture
def base(tmp_path, spark):
    first, second = tmp_path / "v1" / "Alpha" / "data", tmp_path / "v1" / "beta" / "more" / "deep"
    first.mkdir(parents=True)
    second.mkdir(parents=True)
    (first / "a.jsonl").write_text('{"p":"1","q":{"z":1}}\nbad line\n\n{"p":"2"}\n')
    with gzip.open(first / "b.jsonl.gz", "wt") as out:
        out.write('{"p":"3"}\n')
    (first / "notes.txt").write_text("x")
    (second / "c.csv").write_text('p,q\n"a\nb",1\n"say ""hi""",2\n')
    (second / "d.tsv").write_text("p\tq\nx\t1\n")
    return str(tmp_path)


def names(df):
    return sorted(row["path"].rsplit("/", 1)[-1] for row in df.collect())


def test_discovery(spark, base, rows):
    assert names(discovery.discover_files(spark, base)) == ["a.jsonl", "b.jsonl.gz"]
    assert names(discovery.discover_files(spark, f"{base}/v1/Alpha/data/a.jsonl")) == ["a.jsonl"]
    assert discovery.discover_files(spark, f"{base}/nowhere").count() == 0
    found = rows(discovery.discover_datasets(spark, base).select("version", "dataset", "subpath", "files"), "dataset")
    assert [tuple(r.values()) for r in found] == [("v1", "Alpha", "data", 3), ("v1", "beta", "more", 2)]
    assert discovery.discover_datasets(spark, base, dataset="ALP", subpath="AT").count() == 1


def test_listing_reads_no_content(spark, base):
    plan = discovery.list_files(spark, base)._jdf.queryExecution().executedPlan().toString()
    assert "content" not in plan.split("ReadSchema")[-1]


def test_json_lines_and_quarantine(spark, base, rows):
    df = readers.read_json_lines(spark, f"{base}/v1/Alpha", file_name=True)
    good, bad = readers.quarantine(df)
    assert [r["p"] for r in rows(good, "p")] == ["1", "2", "3"]
    assert [r["_bad_line"] for r in rows(bad)] == ["bad line"]
    assert bad.count() == 1 and bad.first()["_file_name"].endswith("a.jsonl")
    with pytest.raises(Exception, match="(?i)malformed"):
        readers.read_json_lines(spark, f"{base}/v1/Alpha", schema="p string", fail_fast=True).collect()


def test_json_variant(spark, base):
    df = readers.read_json_variant(spark, f"{base}/v1/Alpha")
    assert df.count() == 4 and df.where(F.col("value").isNull()).count() == 1


def test_csv_and_tsv(spark, base, rows):
    folder = f"{base}/v1/beta/more/deep"
    assert rows(readers.read_csv(spark, f"{folder}/c.csv", multi_line=True), "q") == [{"p": "a\nb", "q": 1}, {"p": 'say "hi"', "q": 2}]
    assert rows(readers.read_tsv(spark, f"{folder}/d.tsv")) == [{"p": "x", "q": 1}]


def test_mixed_dataset(spark, base, rows):
    spark.createDataFrame([("4", "x")], "p string, extra string").write.parquet(f"{base}/v1/Alpha/data/pq")
    df = readers.quarantine(readers.read_dataset(spark, f"{base}/v1/Alpha"))[0]
    assert [(r["p"], r["extra"]) for r in rows(df, "p")] == [("1", None), ("2", None), ("3", None), ("4", "x")]
    with pytest.raises(FileNotFoundError):
        readers.read_dataset(spark, f"{base}/v1/beta")


def test_samples(spark, base, rows, tmp_path):
    assert rows(readers.sample_rows(spark, f"{base}/v1/Alpha/data", k=1)) == [{"p": "1", "z": 1, "_tags": {}}]
    assert rows(readers.sample_rows(spark, f"{base}/v1/beta/more/deep", k=1)) == [{"p": "a\nb", "q": 1, "_tags": {}}]
    (tmp_path / "empty").mkdir()
    assert readers.sample_rows(spark, str(tmp_path / "empty")) is None


def test_whole_job(spark, base, rows):
    mapping = [entry("p", "m[0].c")]
    run = map_dataset(spark, f"{base}/v1/Alpha", f"{base}/out", mapping)
    assert (run.total_files, run.successful_files, run.total_processed_samples, run.rejected_lines) == (2, 2, 3, 1)
    assert sorted(r["rows"] for r in rows(run.per_file)) == [1, 2]
    assert [r["m"] for r in rows(spark.read.parquet(f"{base}/out"), "m")] == [[{"c": "1"}], [{"c": "2"}], [{"c": "3"}]]
    assert rows(query.dataset_stats(spark, f"{base}/out"))[0]["total_rows"] == 3
    with pytest.raises(MappingError):
        map_dataset(spark, base, f"{base}/out2", [])


def test_whole_job_without_a_schema(spark, base, rows):
    schema = {"type": "object", "properties": {"p": {"type": "integer"}, "z": {"type": "integer"}}}
    mapping = [entry("p", "p"), entry("q.z", "z")]
    run = map_dataset(spark, f"{base}/v1/Alpha", f"{base}/single", mapping, schema, single_pass=True)
    assert (run.total_files, run.total_processed_samples, run.rejected_lines) == (2, 3, 1)
    stored = rows(spark.read.parquet(f"{base}/single").select("p", "z"), "p")
    assert stored == [{"p": 1, "z": 1}, {"p": 2, "z": None}, {"p": 3, "z": None}]


def test_stream_maps_every_file_once(spark, base, rows):
    schema = T.StructType.fromDDL("p string")

    def run():
        source = stream_source(spark, f"{base}/v1/Alpha/data/*.jsonl", schema, file_format="json")
        map_new_files(source, f"{base}/so", f"{base}/ck", [entry("p", "x")]).awaitTermination()
        return [r["x"] for r in rows(spark.read.parquet(f"{base}/so").select("x"), "x")]

    assert run() == ["1", "2"]
    with open(f"{base}/v1/Alpha/data/later.jsonl", "w") as out:
        out.write('{"p":"9"}\n')
    assert run() == ["1", "2", "9"]


def test_saved_results(spark, tmp_path):
    df = spark.range(0, 20000, 1, 8).withColumn("s", F.sha2(F.col("id").cast("string"), 256))
    target = files.save_results(df, str(tmp_path), "one")
    assert spark.read.parquet(target).count() == 20000
    assert len(list((tmp_path / "one").glob("*.parquet"))) == 1
    with pytest.raises(files.FolderNotEmpty):
        files.save_results(df, str(tmp_path), "one")
    (tmp_path / "empty").mkdir()
    split = files.save_results(df, str(tmp_path), "empty", max_file_bytes=200_000)
    assert spark.read.parquet(split).count() == 20000
    sizes = [p.stat().st_size for p in (tmp_path / "empty").glob("*.parquet")]
    assert len(sizes) > 1 and max(sizes) <= 1_000_000


def test_exports(spark, tmp_path, rows):
    df = spark.createDataFrame([(1, ("x",), ' a "b"\n'), (2, None, None)], "id int, o struct<k:string>, s string")
    files.export_csv(df.orderBy("id"), str(tmp_path / "csv"), 1)
    assert rows(readers.read_csv(spark, str(tmp_path / "csv"), multi_line=True)) == [{"id": 1, "o": '{"k":"x"}', "s": ' a "b"\n'}]
    for kind in ("json", "parquet"):
        files.extract_sample(df, str(tmp_path / kind), order_by=["id"], n=1, file_format=kind)
        assert spark.read.format(kind).load(str(tmp_path / kind)).count() == 1
    with pytest.raises(ValueError):
        files.extract_sample(df, str(tmp_path / "x"), order_by=["id"], file_format="orc")
    for run in ("1", "2"):
        files.append_run_log(spark, str(tmp_path / "log"), run_id=run, dataset="d", kind="mapping", rows=3, valid=True)
    assert files.read_run_log(spark, str(tmp_path / "log")).count() == 2


def test_work_folder_is_below_the_checkpoint_folder(spark):
    assert work_folder(spark, "x").startswith(spark.sparkContext.getConf().get("spark.checkpoint.dir"))


def test_results_and_limits(spark, rows):
    df = query.run_sql(spark, "SELECT id FROM numbers", {"numbers": spark.range(150)})
    assert query.limited(df).count() == 100
    assert rows(query.result_metrics(df)) == [{"total_rows": 150, "total_columns": 1, "shown_rows": 100}]
    for n in (0, 10_001):
        with pytest.raises(ValueError):
            query.limited(df, n)
    assert rows(query.stringify(spark.sql("SELECT 1 AS a, array(1) AS b, CAST(NULL AS INT) AS c"))) == [
        {"a": "1", "b": "[1]", "c": None}
    ]
    assert rows(query.describe(df)) == [{"column_name": "id", "column_type": "bigint", "position": 0}]
    assert query.preview(df, order_by=["id"]).count() == 5

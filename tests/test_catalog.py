from datetime import datetime

import pytest
from pyspark.sql import functions as F

from loomrow import MappingError
from loomrow.operators import catalog
from loomrow.operators.catalog import Catalog

NAME = {"version": "v1", "dataset": "d", "subpath": "data"}


@pytest.fixture
def docs(spark):
    def row(ts, doc_id, metadata):
        return ("v1", "d", "data", ts, doc_id, metadata, "{}", "chat.json", "[]")

    data = [row("202501010000", "old", {"_a": "1"}), row("202502010000", "new", {"_b": "2"})]
    other = [("v1", "e", "data", "202401010000", "only", None, None, None, None)]
    return spark.createDataFrame(data + other, catalog.DOCUMENT)


def ids(df):
    return sorted(row["doc_id"] for row in df.collect())


def test_latest_and_obsolete(docs):
    assert ids(catalog.latest(docs)) == ["new", "only"]
    assert ids(catalog.obsolete(docs)) == ["old"]


def test_append_and_restore(docs, rows):
    now = F.lit("2025-03-01 00:00:00").cast("timestamp")
    more = catalog.append_version(docs, docs.where("doc_id = 'old'"), now)
    assert more.count() == 4 and ids(catalog.latest(more)) == ["old", "only"]
    assert catalog.append_version(more, docs.where("doc_id = 'new'"), now).count() == 4
    back = rows(catalog.restore(docs, catalog.obsolete(docs)), "dataset")
    assert [(r["doc_id"], r["ts"]) for r in back] == [("old", "202502010000"), ("only", "202401010000")]
    assert back[0]["metadata"] == {"_a": "1"}


@pytest.fixture
def table(spark):
    return lambda *data: spark.createDataFrame(list(data), "doc_id int, x string")


@pytest.mark.parametrize(
    ("null_aware", "new", "expected"),
    [
        (False, [(2, "c"), (3, "d")], [(None, "n"), (1, "a"), (2, "c"), (3, "d")]),
        (False, [(None, "z")], [(None, "n"), (None, "z"), (1, "a"), (2, "b")]),
        (True, [(2, "c"), (3, "d")], [(1, "a"), (2, "c"), (3, "d")]),
        (True, [(None, "z")], [(None, "z")]),
        (True, [], [(None, "n"), (1, "a"), (2, "b")]),
    ],
)
def test_upsert(table, null_aware, new, expected):
    old = table((1, "a"), (2, "b"), (None, "n"))
    result = catalog.upsert(old, table(*new), null_aware=null_aware)
    assert sorted((tuple(r) for r in result.collect()), key=str) == sorted(expected, key=str)


def test_upsert_twice_changes_nothing(table):
    old, new = table((1, "a"), (2, "b")), table((2, "c"))
    once = catalog.upsert(old, new)
    assert sorted(catalog.upsert(once, new).collect()) == sorted(once.collect())


def test_upsert_keeps_the_newest_of_a_batch(spark):
    old = spark.createDataFrame([(1, "a")], "doc_id int, x string")
    new = spark.createDataFrame([(1, "b", 1), (1, "c", 2)], "doc_id int, x string, n int")
    assert [tuple(r) for r in catalog.upsert(old, new, newest_by="n").collect()] == [(1, "c")]


def test_metadata_and_sections(docs, rows):
    changed = catalog.metadata_set(catalog.metadata_set(F.col("metadata"), "_a", F.lit("9")), "_c", F.lit("3"))
    row = docs.where("doc_id = 'old'").select(changed.alias("m"), catalog.metadata_remove(F.col("metadata"), "_a").alias("r"))
    assert rows(row) == [{"m": {"_a": "9", "_c": "3"}, "r": {}}]
    done = catalog.set_section(docs, "mapping", "[1]", F.col("dataset") == "e")
    assert [r["mapping"] for r in done.orderBy("doc_id").collect()] == ["[]", "[]", "[1]"]
    with pytest.raises(ValueError):
        catalog.set_section(docs, "metadata", "{}", F.lit(True))
    filled = rows(catalog.fill_keys(docs).where("doc_id = 'only'"))[0]
    assert (filled["metadata"], filled["src_schema"], filled["dst_schema_id"], filled["mapping"]) == ({}, "{}", "", "[]")


def test_fields(spark, docs):
    def names(df):
        return [row["field"] for row in df.collect()]

    registry = spark.createDataFrame([("_size",)], "field string")
    added, rejected = catalog.add_fields(registry, spark.createDataFrame([("lang",), ("_size",), (" ",)], "field string"))
    assert sorted(names(added)) == ["_lang", "_size"] and names(rejected) == ["_size"]
    assert names(catalog.all_fields(added, docs)) == ["_a", "_b", "_lang", "_size"]
    assert names(catalog.remove_fields(added, registry)) == ["_lang"]
    assert catalog.default_registry(spark).count() == 14


def test_missing_documents(spark, docs, rows):
    datasets = spark.createDataFrame([("v1", "d", "data"), ("v2", "x", "y")], "version string, dataset string, subpath string")
    made = rows(catalog.init_missing(datasets, docs, "/base/", F.lit("2025-01-02 03:04:05").cast("timestamp")))
    assert made == [{
        "version": "v2", "dataset": "x", "subpath": "y", "ts": "202501020304", "doc_id": "/base/v2/x/y",
        "metadata": {}, "src_schema": "{}", "dst_schema_id": "", "mapping": "[]",
    }]


def test_document_files_and_schemas(spark, tmp_path, rows):
    (tmp_path / "v1__d__data__202501010000.json").write_text(
        '{"doc_id": "i", "metadata": {"_a": "1"},\n "src_schema": {"type": "object"}, "mapping": [{"src_field": "a"}]}'
    )
    (tmp_path / "notes.json").write_text("{}")
    assert rows(catalog.read_documents(spark, str(tmp_path))) == [{
        "version": "v1", "dataset": "d", "subpath": "data", "ts": "202501010000", "doc_id": "i",
        "metadata": {"_a": "1"}, "src_schema": '{"type":"object"}', "dst_schema_id": None,
        "mapping": '[{"src_field":"a"}]',
    }]
    assert [r["path"].rsplit("/", 1)[-1] for r in catalog.other_files(spark, str(tmp_path)).collect()] == ["notes.json"]
    assert catalog.list_target_schemas(spark, str(tmp_path)).count() == 2
    assert catalog.load_target_schema(spark, str(tmp_path), "notes.json") == {}
    with pytest.raises(FileNotFoundError):
        catalog.load_target_schema(spark, str(tmp_path), "none.json")


def test_stored_catalog(spark, docs, tmp_path, rows):
    store = Catalog(spark, str(tmp_path / "catalog"))
    assert store.documents().count() == 0 and store.master().count() == 0
    store.add(docs.where("doc_id = 'old'"), datetime(2025, 1, 1))
    store.add(docs.where("doc_id = 'new'"), datetime(2025, 2, 1))
    store.set_section("mapping", '[{"src_field":"s","target_field":"x"}]', NAME, datetime(2025, 3, 1))
    store.set_section("dst_schema_id", "other.json", NAME, datetime(2025, 3, 1))
    assert store.archive().count() == 2
    current = rows(store.current())[0]
    assert (current["ts"], current["doc_id"], current["dst_schema_id"]) == ("202503010000", "new", "other.json")
    assert [(r["doc_id"], r["metadata"]) for r in rows(store.master(), "doc_id")] == [
        ("new", '{"_b":"2"}'), ("old", '{"_a":"1"}')
    ]
    df = spark.createDataFrame([("v",)], "s string")
    assert rows(catalog.map_from_catalog(df, store.documents(), NAME, None)) == [{"x": "v"}]
    with pytest.raises(MappingError):
        catalog.map_from_catalog(df, docs, NAME, None)


def test_a_batch_with_two_documents_of_one_dataset(spark, docs, tmp_path):
    store = Catalog(spark, str(tmp_path / "batch"))
    twice = docs.where("doc_id = 'old'")
    store.add(twice.unionByName(twice.withColumn("mapping", F.lit("[2]"))), datetime(2025, 1, 1))
    assert store.master().count() == store.current().count() == 1
    assert store.master().first()["mapping"] == store.current().first()["mapping"]


def test_interrupted_writes_lose_nothing(spark, docs, tmp_path):
    store = Catalog(spark, str(tmp_path / "cut"))
    for month in range(1, 6):
        store.add(docs.where("doc_id = 'old'").withColumn("doc_id", F.lit(f"d{month}")).withColumn("dataset", F.lit(f"e{month}")), datetime(2025, month, 1))
    assert sorted(r["doc_id"] for r in store.master().collect()) == ["d1", "d2", "d3", "d4", "d5"]
    left = tmp_path / "cut" / "documents" / "_temporary" / "0" / "_temporary" / "attempt_1"  # what a killed job leaves
    left.mkdir(parents=True)
    (left / "part-0.parquet").write_text("half")
    assert store.master().count() == 5
    store.add(docs.where("doc_id = 'new'"), datetime(2025, 7, 1))
    assert store.master().count() == 6
    store.export_master(str(tmp_path / "master"))
    assert spark.read.parquet(str(tmp_path / "master")).count() == 6


def test_writers_that_meet_lose_nothing(spark, docs, tmp_path):
    """Two catalogs of one folder, as two jobs would hold them: each write is an append of its own."""
    one, other = Catalog(spark, str(tmp_path / "met")), Catalog(spark, str(tmp_path / "met"))
    one.add(docs.where("doc_id = 'old'"), datetime(2025, 1, 1))
    other.add(docs.where("doc_id = 'new'"), datetime(2025, 1, 1))
    assert sorted(r["doc_id"] for r in one.master().collect()) == ["new", "old"] == sorted(r["doc_id"] for r in other.master().collect())


def test_names_with_blanks_and_broken_documents(spark, tmp_path):
    (tmp_path / "v1__my data+x__sub__202501010000.json").write_text('{"doc_id": "i"}')
    assert catalog.read_documents(spark, str(tmp_path)).first()["dataset"] == "my data+x"
    (tmp_path / "v1__d__sub__202501010000.json").write_text('{"doc_id": ')
    with pytest.raises(Exception, match="(?i)malformed|parse"):
        catalog.read_documents(spark, str(tmp_path)).collect()
    assert catalog.read_documents(spark, str(tmp_path), skip_broken=True).count() == 1


def test_null_parts_of_a_key_match(docs):
    nulled = docs.withColumn("dataset", F.lit(None).cast("string")).withColumn("version", F.lit("v")).withColumn("subpath", F.lit("s"))
    newest = max(r["ts"] for r in nulled.collect())
    assert all(r["ts"] < newest for r in catalog.obsolete(nulled).collect())

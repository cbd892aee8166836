"""Languages: held-out accuracy, subwords against plain Python, calibration, and what must not be learnt from."""

import dataclasses
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from loomrow.llm import language
from loomrow.llm.language import Settings, identified, learnt, subwords, words_of
from loomrow.llm.queries import QUERIES

SMALL = Settings(documents=200, buckets=1 << 12, epochs=3, batch=16)


def test_subwords():
    words = ["ab", "", "c", "défg"]
    place, owner = subwords(words, 1 << 20)
    got = {}
    for p, w in zip(place.tolist(), owner.tolist()):
        got.setdefault(w, []).append(p)
    for i, word in enumerate(words):
        marked = f"\n{word}\n"
        pieces = [marked[a : a + n] for n in (1, 2, 3, 4) for a in range(len(marked) - n + 1)]
        pieces = [p for p in pieces if word and p.strip("\n")]
        assert len(got.get(i, [])) == len(pieces)
        # the same pieces have the same buckets wherever they stand
        alone = subwords([word], 1 << 20)[0].tolist()
        assert sorted(alone) == sorted(got.get(i, []))
    assert len(set(place.tolist())) > 20


def test_words():
    flat, owner = words_of(pa.array(["Él no-es 3 él", None, "", "x"]))
    found = [[w for w, o in zip(flat.to_pylist(), owner) if o == i and w] for i in range(4)]
    assert found == [["él", "no", "es", "él"], [], [], ["x"]]


def test_query(spark, data):
    got = QUERIES["op12_language"](spark, data)
    assert got.columns[:4] == ["doc_id", "held_out", "lang_pred", "score"]
    docs = {r.doc_id: r for r in spark.read.parquet(f"{data}/documents.parquet").collect()}
    rows = got.collect()
    assert sorted(r.doc_id for r in rows) == sorted(docs)
    for r in rows:
        assert r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) and 0 <= r.score <= 1
        assert r.lang_pred in {"de", "en", "es", "fr"} or not any(c.isalpha() for c in docs[r.doc_id].text or "")


def test_accuracy_held_out(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    model = learnt(docs)
    rows = identified(docs, model, reject=False).where(language.held_out(F.col("doc_id")) & F.col("lang").isNotNull()).collect()
    right = [r for r in rows if r.lang == r.lang_pred]
    assert len(rows) > 100 and len(right) >= 0.98 * len(rows)
    # calibration: what is said with a probability is right about as often, and few are rejected
    assert abs(np.mean([r.score for r in rows]) - len(right) / len(rows)) < 0.03
    assert np.mean([r.rejected for r in rows]) < 0.06
    strange = spark.createDataFrame([("щука жила в реке и ела рыбу",), ("xqzj wvkk qqxz jjvw",)], "text string")
    assert {r.lang_pred for r in identified(strange, model).collect()} == {"und"}


def test_nothing_is_learnt_from_rows_held_out(spark, data):
    docs = spark.read.parquet(f"{data}/documents.parquet")
    spoilt = docs.withColumn("lang", F.when(language.held_out(F.col("doc_id")), "xx").otherwise(F.col("lang")))
    spoilt = spoilt.withColumn("source", F.col("lang"))
    one, two = learnt(docs, SMALL), learnt(spoilt.repartition(3), SMALL)
    assert one.languages == two.languages and np.array_equal(one.table, two.table)
    assert (one.temperature, one.threshold) == (two.temperature, two.threshold)


def test_a_language_with_most_rows_and_bounds(spark):
    docs = spark.range(4000).select(
        F.col("id").alias("doc_id"), F.when(F.col("id") % 50 == 0, "b").otherwise("a").alias("lang"),
        F.when(F.col("id") % 50 == 0, "uvu wuv vuw").otherwise("kik lil mim").alias("text"),
    )
    settings = dataclasses.replace(SMALL, documents=40)
    rows = language.sample(docs.union(docs), settings, "text", "lang", "doc_id").collect()
    assert sorted(r.language for r in rows) == ["a"] * 20 + ["b"] * 20
    model = learnt(docs, settings)
    assert identified(docs, model).where("lang <> lang_pred").isEmpty()


def test_nulls_clashes_long_empty_and_without_labels(spark):
    rows = [(i, "lala bobo " * 30, "x", "s") for i in range(40)] + [(100 + i, "kiki tete " * 30, "y", "s") for i in range(40)]
    rows += [(None, "lala", "y", "s"), (None, None, None, None), (7, "", None, "s"), (8, "12 !?", "x", "s"), (9, "kiki " * 400_000, "y", "s"), (9, None, "x", "s")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, score string")
    model = learnt(docs, SMALL)
    found = identified(docs, model)
    assert found.columns == ["doc_id", "text", "lang", "lang_pred", "score", "rejected"]
    got = found.collect()
    assert len(got) == len(rows)
    for r in got:
        if r.text is None or not any(c.isalpha() for c in r.text):
            assert (r.lang_pred, r.score, r.rejected) == ("und", 0.0, True)
        elif len(r.text) > 50:
            assert r.lang_pred == ("x" if "lala" in r.text else "y")
    assert identified(docs.limit(0), model).count() == 0
    assert learnt(docs.limit(0), SMALL) is None and learnt(docs.withColumn("lang", F.lit(None).cast("string")), SMALL) is None
    assert {r.lang_pred for r in identified(docs, None).collect()} == {"und"}
    single = learnt(docs.where("lang = 'x'"), SMALL)
    assert identified(docs.where("doc_id = 1"), single, reject=False).head().lang_pred == "x"


def test_ties_go_to_the_first_language(spark):
    model = language.Model(["a", "b"], np.zeros((16, 2)), np.zeros(2), buckets=16)
    row = identified(spark.createDataFrame([("word",)], "text string"), model).head()
    assert (row.lang_pred, row.score) == ("a", 0.5)

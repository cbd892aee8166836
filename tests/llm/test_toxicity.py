"""The field against enumeration of all labellings, and its accuracy on held-out documents."""

import itertools
import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from loomrow.llm import toxicity
from loomrow.llm.toxicity import Field, held_out, labelled_sample, learnt, op5_toxicity, scored, trained


def test_marginals_are_those_of_all_labellings():
    rng = np.random.default_rng(4)
    field = Field(np.zeros(1), 0.0, rng.normal(size=(2, 2)), np.zeros(3))
    lengths = np.array([3, 0, 1, 5, 3])
    odds = np.exp(rng.normal(size=lengths.sum()))
    want = []
    for start, n in zip(np.cumsum(lengths) - lengths, lengths):
        own, total = np.zeros(n), 0.0
        for labels in itertools.product((0, 1), repeat=int(n)):
            weight = np.prod([odds[start + i] if y else 1.0 for i, y in enumerate(labels)])
            weight *= np.exp(sum(field.transitions[a, b] for a, b in zip(labels, labels[1:])))
            own += weight * np.array(labels)
            total += weight
        want.extend(own / total)
    assert np.allclose(field.marginals(odds, lengths), want)


def corpus():
    rng = random.Random(2)
    clean = ["word%d" % i for i in range(400)]
    rows = []
    for i in range(300):
        words = [rng.choice(clean) for _ in range(rng.randrange(5, 60))]
        toxic = i % 4 == 0
        for _ in range(3 * toxic):
            words.insert(rng.randrange(len(words)), rng.choice(["Vile", "vileish", "rotten"]))
        rows.append((i, " ".join(words), int(toxic)))
    return rows


def test_held_out_documents_and_their_spans(spark):
    rows = corpus()
    docs = spark.createDataFrame([r[:2] for r in rows], "doc_id long, text string")
    labels = spark.createDataFrame([(r[0], r[2]) for r in rows] + [(None, 1), (5, None)], "doc_id long, toxic int")
    got = scored(docs, learnt(docs, labels)).select("*", held_out(F.col("doc_id")).alias("out")).collect()
    for r in got:
        assert r.out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2)
        assert r.predicted == rows[r.doc_id][2], r.score
        found = " ".join(r.text[s.start : s.end] for s in r.spans).lower()
        assert all(w.startswith("vile") or w == "rotten" for w in found.split())


def test_nothing_to_learn(spark):
    docs = spark.createDataFrame([(1, "a b"), (2, None)], "doc_id long, text string")
    labels = spark.createDataFrame([(1, 0)], "doc_id long, toxic int")
    assert [r.score for r in scored(docs, learnt(docs, labels)).collect()] == [0.0, 0.0]
    assert trained(["a"], np.array([True])) is None


def test_nulls_repeats_clashes_long_and_empty(spark):
    rows = corpus()
    field = trained([r[1] for r in rows], np.array([r[2] for r in rows]))
    long = "word1 " * 100_000 + "é İ vile rotten"
    df = spark.createDataFrame(
        [(None, None, 1), (1, "", 2), (1, "", 2), (2, long, 3)], "doc_id long, text string, score int"
    )
    got = {(r.doc_id, r.text): r for r in scored(df, field).collect()}
    assert got[None, None].score == got[1, ""].score < 0.3 and got[1, ""].spans == []
    assert [long[s.start : s.end] for s in got[2, long].spans] == ["vile rotten"]
    assert scored(df, field).columns == ["doc_id", "text", "score", "predicted", "spans"]
    assert scored(df.limit(0), field).count() == 0


def test_query(spark, data):
    df = op5_toxicity(spark, data)
    assert df.columns[:4] == ["doc_id", "held_out", "score", "predicted"]
    assert df.where("score between 0 and 1 and predicted = int(score >= 0.3)").count() == df.count() > 0


def first_by_hash(spark, keys):
    rows = spark.createDataFrame([(k,) for k in keys], "doc_id long").where(~held_out(F.col("doc_id")))
    return rows.orderBy(F.xxhash64("doc_id")).first().doc_id


@pytest.mark.parametrize("label", [0, 1])
def test_one_very_long_text_takes_no_place(spark, label):
    rows = corpus()
    longest = first_by_hash(spark, [i for i, _, toxic in rows if toxic == label])
    rows = [(i, "word1 " * 1_700_000 if i == longest else text, toxic) for i, text, toxic in rows]
    docs = spark.createDataFrame([r[:2] for r in rows], "doc_id long, text string")
    labels = spark.createDataFrame([(r[0], r[2]) for r in rows], "doc_id long, toxic int")
    sample = labelled_sample(docs, labels)
    learnable = [r[2] for r in rows if zlib.crc32(str(r[0]).encode()) % 4 != 2 and r[0] != longest]
    assert sorted(sample["toxic"]) == sorted(learnable) and learnt(docs, labels) is not None


def test_long_texts_only_where_a_class_has_no_others(spark, monkeypatch):
    docs = spark.createDataFrame([(i, "x " * (20 if i < 4 else 40)) for i in range(9)] + [(0, "y" * 90)], "doc_id long, text string")
    labels = spark.createDataFrame([(i, int(i >= 4)) for i in range(9)], "doc_id long, toxic int")
    learnable = [i for i in range(9) if zlib.crc32(str(i).encode()) % 4 != 2]
    monkeypatch.setattr(toxicity, "LONG_TEXT", 50)
    assert sorted(labelled_sample(docs, labels)["toxic"]) == sorted(int(i >= 4) for i in learnable)
    monkeypatch.setattr(toxicity, "SAMPLE_CHARACTERS", 200)
    with pytest.warns(UserWarning, match="short enough"):
        assert labelled_sample(docs, labels)["toxic"].tolist() == [0, 0, 0]  # 134 characters: three texts of 40
    with pytest.warns(UserWarning, match="short enough"):
        assert learnt(docs, labels, characters=200) is None
    assert len(labelled_sample(docs, labels, toxic=1, clean=2, characters=10_000)) == 3


def test_classes_that_nothing_tells_apart_are_reported(spark):
    docs = spark.createDataFrame([(i, "same words") for i in range(40)], "doc_id long, text string")
    labels = spark.createDataFrame([(i, i % 2) for i in range(40)], "doc_id long, toxic int")
    with pytest.warns(UserWarning, match="apart"):
        assert learnt(docs, labels) is None

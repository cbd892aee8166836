"""Nearest neighbours and near copies of vectors against all pairs."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from loomrow.llm import embedding_dedup
from loomrow.llm.ann import nearest, op3_ann
from loomrow.llm.embedding_dedup import code, decoded, near_copies, op4_embedding_dedup

SCHEMA = "vec_id long, embedding array<float>, label int"


def loaded(spark, data):
    rows = spark.read.parquet(f"{data}/embeddings.parquet").orderBy("vec_id").collect()
    return np.array([r.vec_id for r in rows]), np.array([r.embedding for r in rows], dtype=float), [r.label for r in rows]


def test_recall_and_scores(spark, data):
    ids, x, _ = loaded(spark, data)
    scores = x @ x.T
    np.fill_diagonal(scores, -np.inf)
    found = {}
    for r in op3_ann(spark, data).orderBy("query_id", "rank").collect():
        found.setdefault(r.query_id, []).append((r.vec_id, r.score))
    assert set(found) == {i for i in ids if i % 20 == 0}
    hits = 0
    for q, best in found.items():
        row = scores[np.flatnonzero(ids == q)[0]]
        want = set(ids[np.lexsort((ids, -row))[:20]])
        hits += len(want & {i for i, _ in best})
        assert len(best) == 20 and best == sorted(best, key=lambda b: (-b[1], b[0]))
        assert all(abs(row[np.flatnonzero(ids == i)[0]] - s) < 1e-12 for i, s in best)
    assert hits >= 0.9 * 20 * len(found)


def test_odd_vectors_and_ties(spark):
    v = [1.0, 0.0, 2.0]
    rows = [(i, v, 1) for i in range(40)] + [(40, None, 1), (60, [0.0, 0.0, 0.0], 1), (80, [1.0, None, 0.0], 1), (100, [float("nan"), 1.0, 1.0], 1)]
    rows += [(120, [1.0, 2.0], 1), (None, v, 1), (140, [float("inf"), 0.0, 0.0], 1)]
    df = spark.createDataFrame(rows, SCHEMA)
    got = nearest(df, df.where("vec_id % 20 = 0"), 5).orderBy("query_id", "rank").collect()
    assert [(r.query_id, r.vec_id) for r in got] == [(0, 1), (0, 2), (0, 3), (0, 4), (0, 5), (20, 0), (20, 1), (20, 2), (20, 3), (20, 4)]
    assert nearest(df.limit(0), df.limit(0), 5).count() == 0
    few = spark.createDataFrame([(0, [1.0], 1), (1, [-1.0], 1)], SCHEMA)
    assert [(r.vec_id, r.score) for r in nearest(few, few.where("vec_id = 0"), 5).collect()] == [(1, -1.0)]


def brute(rows):
    good = [(k, np.array(v, float), lab) for k, v, lab in rows if v is not None and lab is not None and None not in v and np.isfinite(v).all() and np.any(v)]
    links = {k: set() for k, _, _ in rows}
    for i, (a, x, la) in enumerate(good):
        for b, y, lb in good[:i]:
            if la == lb and len(x) == len(y) and x @ y >= 0.93 * np.linalg.norm(x) * np.linalg.norm(y):
                links[a].add(b)
                links[b].add(a)
    out = {}
    for k in sorted(links):
        if k in out:
            continue
        todo, seen = [k], {k}
        while todo:
            for other in links[todo.pop()] - seen:
                seen.add(other)
                todo.append(other)
        out |= {s: k for s in seen}
    return {k: (len(links[k]), out[k], out[k] == k) for k in links}


def result(df):
    return {r.vec_id: (r.n_links, r.component_id, r.kept) for r in df.collect()}


@pytest.mark.parametrize("chunk", [500, 7])
def test_near_copies(spark, monkeypatch, chunk):
    monkeypatch.setattr(embedding_dedup, "CHUNK", chunk)
    rng = np.random.default_rng(3)
    rows = []
    for g in range(30):
        base = rng.normal(size=24)
        for _ in range(int(rng.integers(1, 30 if g == 0 else 5))):
            rows.append((len(rows), (base + rng.normal(size=24) * rng.choice([0, 0.05, 0.2])).tolist(), int(g % 3)))
    rows += [(900, rows[0][1], None), (901, None, 1), (902, [0.0] * 24, 1), (903, rows[0][1], 2), (904, [2 * x for x in rows[0][1]], 0), (905, rows[0][1][:7], 0)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int").repartition(3)
    assert result(near_copies(df)) == brute(rows)


def test_recall_at_the_threshold():
    rng = np.random.default_rng(1)
    halves, hits = code(64), 0
    for _ in range(300):
        x, y = rng.normal(size=(2, 64))
        x /= np.linalg.norm(x)
        y -= (y @ x) * x
        y = 0.93 * x + np.sqrt(1 - 0.93**2) * y / np.linalg.norm(y)
        hits += bool(len(np.intersect1d(decoded(x, halves), decoded(y, halves))))
    assert hits >= 0.97 * 300


def test_whole_table_and_empty_one(spark, data):
    ids, x, labels = loaded(spark, data)
    want = brute(list(zip(ids.tolist(), x.tolist(), labels)))
    assert result(op4_embedding_dedup(spark, data)) == want
    assert near_copies(spark.createDataFrame([], SCHEMA)).count() == 0


def test_clashing_columns_and_repeated_keys(spark):
    df = spark.createDataFrame([(1, [1.0, 0.0], 1, 5), (1, [1.0, 0.0], 1, 6), (None, [1.0, 0.0], 1, 7)], SCHEMA + ", n_links int")
    got = sorted((r.vec_id or 0, r.n_links, r.component_id or 0) for r in near_copies(df).collect())
    assert got == [(0, 1, 1), (1, 1, 1), (1, 1, 1)] or got[1:] == [(1, 1, 1), (1, 1, 1)]
    assert near_copies(df.where(F.col("vec_id").isNull())).first().component_id is None


def test_labels_of_any_plain_type(spark):
    vectors = [[1.0, 0.0, 0.1], [1.0, 0.0, 0.11], [1.0, 0.0, 0.1]]
    for kind, labels in (("string", ["x", "x", "y"]), ("boolean", [True, True, False]), ("double", [0.5, 0.5, 1.5])):
        df = spark.createDataFrame([(i, v, l) for i, (v, l) in enumerate(zip(vectors, labels))], f"vec_id long, embedding array<double>, label {kind}")
        assert sorted((r.vec_id, r.component_id, r.n_links) for r in near_copies(df).collect()) == [(0, 0, 1), (1, 0, 1), (2, 2, 0)]

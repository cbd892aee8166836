"""Nearest neighbours among vectors of different lengths."""

import numpy as np
import pyarrow.parquet as pq
import pytest

from loomrow.llm.ann import nearest


@pytest.mark.parametrize("kind", ["one long vector", "two groups", "spread"])
def test_recall_at_mixed_lengths(spark, data, kind):
    table = pq.read_table(f"{data}/embeddings.parquet")
    x, rng = np.array(table["embedding"].to_pylist(), dtype=float), np.random.default_rng(6)
    # enough vectors that a shard is not verified whole
    x = np.concatenate([x, *(x + rng.normal(size=x.shape) * 0.07 for _ in range(max(1, 1500 // len(x))))])
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    if kind == "one long vector":
        x[7] *= 5
    elif kind == "two groups":
        x[::2] *= 3
    else:
        x *= np.exp(rng.normal(size=(len(x), 1)) * 0.5)
    df = spark.createDataFrame([(i, v) for i, v in enumerate(x.tolist())], "vec_id long, embedding array<double>")
    found: dict[int, set] = {}
    for r in nearest(df, df.where("vec_id % 20 = 0"), 20).collect():
        found.setdefault(r.query_id, set()).add(r.vec_id)
    hits = 0
    for q in range(0, len(x), 20):
        scores = x @ x[q]
        scores[q] = -np.inf
        hits += len(found[q] & set(np.argsort(-scores)[:20].tolist()))
    assert hits >= 0.9 * 20 * len(found), hits / 20 / len(found)


def test_lengths_far_apart(spark):
    rows = [(i, [10.0**e, 0.0]) for i, e in enumerate((-300, -5, 0, 5, 150))]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    assert [r.vec_id for r in nearest(df, df.where("vec_id = 2"), 9).orderBy("rank").collect()] == [4, 3, 1, 0]

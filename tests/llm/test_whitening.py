"""Whitening against numpy's eigenvectors, exact integers, and rows without variance."""

import numpy as np
import pytest

from loomrow.llm.queries import QUERIES
from loomrow.llm.whitening import factor, through, whitened


def reference(vectors):
    x = np.floor(1024.0 * np.array(vectors, dtype=np.float64)).astype(np.int64) + 100_000
    centred = x - x.mean(axis=0)
    values, axes = np.linalg.eigh(centred.T @ centred / len(x))
    return x, values[::-1], axes[:, ::-1], centred


def test_query(spark, data):
    table = spark.read.parquet(f"{data}/embeddings.parquet").collect()
    keys = [r.vec_id for r in table]
    x, values, axes, centred = reference([r.embedding for r in table])
    n, sums = len(x), x.sum(axis=0)
    got = QUERIES["op11_whitening"](spark, data).collect()
    assert len(got) == 8 * n and len({(r.vec_id, r.component) for r in got}) == 8 * n
    z = centred @ axes[:, :8] / np.sqrt(values[:8])
    place = {k: i for i, k in enumerate(keys)}
    found = np.zeros((n, 8))
    for r in got:
        found[place[r.vec_id], r.component - 1] = r.whitened
        assert r.n == n and r.deviation == sum((n * int(v) - int(s)) ** 2 for v, s in zip(x[place[r.vec_id]], sums))
        assert abs(r.explained / (values[r.component - 1] / values.sum()) - 1) < 1e-9 and r.identity_error < 1e-9
    signs = np.sign((z * found).sum(axis=0))
    assert np.abs(z * signs - found).max() < 1e-8


def test_triangular_solves():
    rng = np.random.default_rng(1)
    rows = rng.normal(size=(500, 12)) * np.logspace(0, -6, 12)
    r = factor(rows.T @ rows, 500, shifted=True)
    assert np.allclose(through([r], rows) @ r, rows, atol=1e-12)


@pytest.mark.parametrize("spread", [0.0, 3.0])
def test_badly_conditioned_rows_become_orthogonal(spark, spread):
    rng = np.random.default_rng(2)
    mixed = rng.normal(size=(400, 10)) * np.logspace(spread, 0, 10) @ np.linalg.qr(rng.normal(size=(10, 10)))[0]
    df = spark.createDataFrame([(i, [float(c) for c in v]) for i, v in enumerate(mixed)], "vec_id long, embedding array<double>")
    rows, model = whitened(df.repartition(5), components=10)
    assert model.identity_error < 1e-9
    _, values, axes, _ = reference(mixed)
    assert np.allclose(model.values, values, rtol=1e-9)
    assert np.allclose(np.abs((model.vectors * axes).sum(axis=0)), 1.0, atol=1e-9)
    z = np.array([r.whitened for r in rows.collect()])
    assert np.abs(np.cov(z.T, bias=True) - np.eye(10)).max() < 1e-9


def test_directions_without_variance_are_no_components(spark):
    rng = np.random.default_rng(3)
    base = rng.integers(-500, 500, size=(60, 2)) / 1024.0
    vectors = np.column_stack([base, base.sum(axis=1), np.full(60, 0.25)])  # rank two
    df = spark.createDataFrame([(i, [float(c) for c in v]) for i, v in enumerate(vectors)], "vec_id long, embedding array<double>")
    rows, model = whitened(df)
    assert len(model.values) == 2 and model.identity_error < 1e-9
    assert {len(r.whitened) for r in rows.collect()} == {2}
    same = spark.createDataFrame([(i, [0.5, 0.5]) for i in range(9)], "vec_id long, embedding array<double>")
    rows, model = whitened(same)
    assert [r.whitened for r in rows.collect()] == [[]] * 9 and model.identity_error == 0
    assert rows.where("deviation <> 0").isEmpty()


def test_nulls_lengths_clashes_large_and_empty(spark):
    rows = [
        (1, [1.0, 2.0], "a"), (1, [1.0, 2.0], "a"), (None, [0.0, 0.0], "b"), (3, None, "c"), (4, [], "d"), (5, [1.0, None], "e"),
        (6, [float("nan"), 1.0], "f"), (7, [1.0, float("inf")], "g"), (8, [1.0, 2.0, 3.0], "h"), (9, [-3.0, 1e-9], "i"),
    ]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, deviation string")
    out, model = whitened(df)
    assert out.columns == ["vec_id", "embedding", "deviation", "whitened"]
    got = out.collect()
    assert sorted(r.vec_id or 0 for r in got) == [0, 1, 1, 9] and model.rows == 4
    x = np.array([[101024, 102048], [101024, 102048], [100000, 100000], [96928, 100000]])
    want = ((4 * x - x.sum(axis=0)) ** 2).sum(axis=1)
    assert sorted(r.deviation for r in got) == sorted(want.tolist())
    large = spark.createDataFrame([(1, [1e300, 0.0]), (2, [0.0, 1.0]), (3, [5.0, 2.0])], df.select("vec_id", "embedding").schema)
    assert [r.deviation for r in whitened(large)[0].collect()] == [None, None, None]
    assert whitened(df.limit(0))[0].count() == 0 and whitened(df.where("vec_id = 4"))[0].count() == 1


def test_text_keys_and_floats(spark):
    df = spark.createDataFrame([("x", [1.5]), ("y", [2.5]), ("z", [0.5])], "vec_id string, embedding array<float>")
    got = {r.vec_id: r.whitened for r in whitened(df)[0].collect()}
    assert got["x"] == pytest.approx([0.0], abs=1e-12) and got["y"] == pytest.approx([1.5**0.5])

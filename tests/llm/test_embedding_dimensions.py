"""Near copies among vectors of few components, and of few that are not zero."""

import numpy as np
import pytest

from loomrow.llm.embedding_dedup import code, decoded, near_copies

from .test_vectors import brute, result


def met(pairs):
    halves = code(pairs[0][0].size)
    return np.mean([bool(len(np.intersect1d(decoded(x, halves), decoded(y, halves)))) for x, y in pairs])


def partner(x, other):
    other = other - (other @ x) * x
    return 0.93 * x + np.sqrt(1 - 0.93**2) * other / np.linalg.norm(other)


@pytest.mark.parametrize("dimension", [2, 3, 4, 5, 6, 7, 8, 9, 11, 12, 16, 23, 24])
def test_recall_at_the_threshold(dimension):
    rng = np.random.default_rng(dimension)
    pairs = []
    for _ in range(300):
        x = rng.normal(size=dimension)
        x /= np.linalg.norm(x)
        pairs.append((x, partner(x, rng.normal(size=dimension))))
    assert met(pairs) >= (1 if dimension <= 5 else 0.98)


@pytest.mark.parametrize("full", [1, 2])
def test_recall_of_sparse_vectors(full):
    rng = np.random.default_rng(full)
    pairs = []
    for _ in range(300):
        x, y = np.zeros((2, 64))
        places = rng.permutation(64)
        x[places[:full]] = rng.normal(size=full)
        y[places[full]] = 1.0
        x /= np.linalg.norm(x)
        pairs.append((x, partner(x, y)))
    assert met(pairs) >= 0.97


@pytest.mark.parametrize("dimension", [1, 2, 3, 5])
def test_few_components(spark, dimension):
    rng = np.random.default_rng(dimension)
    rows = [(i, rng.normal(size=dimension).tolist(), i % 2) for i in range(150)]
    if dimension == 2:
        rows += [(900, [1.0, 0.0], 7), (901, [0.99, 0.05], 7)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int").repartition(3)
    assert result(near_copies(df)) == brute(rows)

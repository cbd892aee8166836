"""Components against a plain union-find."""

import random

from loomrow.llm.components import components


def brute(links):
    parent = {n: n for a, b in links for n in (a, b) if a is not None and b is not None and a != b}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in links:
        if a is not None and b is not None and a != b:
            a, b = find(a), find(b)
            parent[max(a, b)] = min(a, b)
    return sorted((n, find(n)) for n in parent)


def test_stars_chains_and_random_links(spark):
    rng = random.Random(4)
    links = [(i, i + 1) for i in range(150)] + [(1000, 1000 + i) for i in range(1, 400)] + [(5000 + i, 9000) for i in range(50)]
    links += [(rng.randrange(2000, 3000), rng.randrange(2000, 3000)) for _ in range(500)] + [(7, 7), (None, 3), (4, None), (3, 4), (3, 4)]
    df = spark.createDataFrame(links, "a long, b long")
    assert sorted(map(tuple, components(df).collect())) == brute(links)
    assert components(df.limit(0)).count() == 0

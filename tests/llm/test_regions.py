"""The steps of the region join: what is measured with pivots, and what is left for groups."""

import random

from loomrow.llm import line_dedup
from loomrow.llm.regions import metric_links


def steps(spark, rows, least):
    """The pairs measured, none of which link, and the nodes of each region that go on to groups."""
    pairs, groups = [], []

    def measure(asked):
        pairs.extend(sorted(tuple(r) for r in asked.select("a", "b", "percent").collect()))
        found = [(a, b, 10, 10, 2) for a, b, _ in pairs]
        return spark.createDataFrame(found, "a long, b long, na long, nb long, common long")

    def within(found):
        groups.extend(sorted((r.region, r.node) for r in found.collect()))
        return found.selectExpr("node as a", "node as b").limit(0)

    members = spark.createDataFrame(rows, "region long, node long, n int")
    metric_links(members, measure, within, 75, 100, least).collect()
    return pairs, groups


def test_pivots_are_done_and_chance_meetings_are_not_measured(spark):
    rows = [(1, 1, 10), (1, 2, 10)]  # two that meet once
    rows += [(r, n, 10) for r in (11, 12, 13, 14) for n in (3, 4)]  # two that meet as often as linked ones
    rows += [(21, 5, 1), (21, 6, 1)]  # too small to meet more often
    rows += [(31, 7, 10), (31, 8, 10), (31, 9, 10)]  # a third is there
    pairs, groups = steps(spark, rows, 4)
    assert pairs == [(4, 3, 75), (6, 5, 75), (8, 7, 50), (9, 7, 50)]
    assert groups == [(31, 8), (31, 9)], groups
    pairs, groups = steps(spark, rows, 1)
    assert pairs == [(2, 1, 75), (4, 3, 75), (6, 5, 75), (8, 7, 50), (9, 7, 50)]
    assert groups == [(31, 8), (31, 9)], groups


def test_packed_lines_share_what_their_texts_share():
    rng = random.Random(1)
    for _ in range(1500):
        letters = rng.choice(["ab", "abcdefgh éß", "aǿȀ字b", "a\0b\udc80"])
        x = "".join(rng.choices(letters, k=rng.randrange(1, 400)))
        y = list(x)
        for _ in range(rng.randrange(4)):
            y[rng.randrange(len(y))] = rng.choice(letters)
        y = "".join(y)[rng.randrange(3) :] or "q"
        p, q, a, b = line_dedup.packed(x), line_dedup.packed(y), line_dedup.shingles(x), line_dedup.shingles(y)
        assert (len(p), len(q), line_dedup.in_common(x, y, p, q)) == (len(a), len(b), len(a & b))

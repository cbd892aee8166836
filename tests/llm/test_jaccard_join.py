"""The Jaccard join against all pairs."""

import random
import re

import pyarrow as pa

from loomrow.llm import jaccard_join
from loomrow.llm.jaccard_join import jaccard_groups, op10_jaccard_join, without_copies, word_hashes


def shingles(text):
    lower = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    words = re.findall(r"[^\x20\x09-\x0D]+", lower)
    if len(words) < 5:
        return {tuple(words)} if words else set()
    return {tuple(words[i : i + 5]) for i in range(len(words) - 4)}


def brute(rows):
    sets = [(k, shingles(t)) for k, t in rows]
    parent = {k: k for k, _ in sets if k is not None}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i, (a, x) in enumerate(sets):
        for b, y in sets[:i]:
            if a is not None and b is not None and x and y and 100 * len(x & y) >= 75 * len(x | y):
                a_, b_ = find(a), find(b)
                parent[max(a_, b_)] = min(a_, b_)
    return sorted((k or -1, len(s), -1 if k is None else find(k)) for k, s in sets)


def got(df):
    return sorted((r[0] if r[0] else (-1 if r[0] is None else 0) or -1, r[1], -1 if r[2] is None else r[2]) for r in df.collect())


def corpus(seed=3, groups=30):
    rng = random.Random(seed)
    vocabulary = ["w%d" % i for i in range(300)] + ["É", "ü", "😀"]
    passage = [rng.choice(vocabulary) for _ in range(40)]
    texts = [None, "", "  ", "a b", "A  b", "a b c", "one two three four five", "ONE two\tthree four\nfive"]
    for g in range(groups):
        base = [rng.choice(vocabulary) for _ in range(rng.choice([6, 20, 60, 200]))]
        if g % 3 == 0:
            base += passage
        for _ in range(rng.choice([1, 2, 3, 8])):
            words = list(base)
            for _ in range(rng.choice([0, 0, 1, 2, 3, 5])):
                words[rng.randrange(len(words))] = rng.choice(vocabulary)
            texts.append(rng.choice([" ", "  ", "\n"]).join(words))
    return list(enumerate(texts, 1))


def test_groups_are_those_of_all_pairs(spark):
    rows = corpus()
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    assert got(jaccard_groups(df)) == brute(rows)


def test_regions_shrink_round_by_round(spark, monkeypatch):
    monkeypatch.setattr(jaccard_join, "SMALL_REGION", 2)
    monkeypatch.setattr(jaccard_join, "FREQUENT", 10**6)
    rows = corpus(seed=8, groups=12)
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    assert got(jaccard_groups(df)) == brute(rows)


def test_chains_cross_regions(spark):
    words = ["c%d" % i for i in range(100)]
    rows = [(i, " ".join(["n%d" % j for j in range(i * 3)] + words[i * 3 :])) for i in range(1, 20)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert got(jaccard_groups(df)) == brute(rows)


def test_nulls_repeats_clashes_and_empty(spark):
    text = "a b c d e f g"
    rows = [(None, text), (4, text), (4, text), (4, "x y z u v w"), (9, "x y z u v w"), (None, None), (7, None)]
    df = spark.createDataFrame([(k, t, 1) for k, t in rows], "doc_id long, text string, component_id int")
    found = sorted((r.doc_id or 0, r.n_shingles, r.component_id or 0) for r in jaccard_groups(df).collect())
    assert found == [(0, 0, 0), (0, 3, 0), (4, 2, 4), (4, 3, 4), (4, 3, 4), (7, 0, 7), (9, 2, 4)]
    assert without_copies(df).count() == 6 and without_copies(df).columns == df.columns
    assert jaccard_groups(df.limit(0)).count() == 0


def test_long_text(spark):
    rng = random.Random(1)
    words = ["v%d" % rng.randrange(10**6) for _ in range(60_000)]
    rows = [(1, " ".join(words)), (2, " ".join(words[:-2000])), (3, "x" * 500_000)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert [(r[0], r[2]) for r in sorted(jaccard_groups(df).collect())] == [(1, 1), (2, 1), (3, 3)]


def test_query(spark, data):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{data}/documents.parquet").collect()]
    want = brute([(k + 1, t) for k, t in rows])
    found = sorted((r[0] + 1, r[1], r[2] + 1) for r in op10_jaccard_join(spark, data).collect())
    assert found == want


def test_words_that_any_polynomial_gives_one_value(spark):
    """Thue-Morse words and their complements: equal modulo 2^64 for every base, but different words."""
    word = "a"
    while len(word) < 4096:
        word += word.translate(str.maketrans("ab", "ba"))
    rows, other = [], str.maketrans("ab", "ba")
    for i, length in enumerate((1024, 2048, 4096)):
        rows += [(2 * i, " ".join([word[:length]] * 1)), (2 * i + 1, word[:length].translate(other))]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert all(r.component_id == r.doc_id for r in jaccard_groups(df).collect())
    hashes, _ = word_hashes(pa.array(["ab ba aab", "a b", "abc", ""]))
    assert len(set(hashes.tolist())) == 6


def test_pairs_of_a_group_to_unite_it_are_fewer_than_its_nodes(spark):
    texts = ["w%d " % i + " ".join("c%d" % j for j in range(200)) for i in range(60)]
    sets = list(jaccard_join.shingle_sets(pa.array(texts)))
    nodes = spark.createDataFrame([(i, bytearray(jaccard_join.sketch(s))) for i, s in enumerate(sets)], "node long, sketch binary")
    rows = [(1, 1, i, len(s), i, 2) for i, s in enumerate(sets)]
    groups = spark.createDataFrame(rows, "group long, region long, node long, n long, component long, zone int")
    assert jaccard_join.near_in_groups(groups, nodes, few=True).count() == 59
    assert jaccard_join.near_in_groups(groups, nodes, few=False).count() == 60 * 59 // 2

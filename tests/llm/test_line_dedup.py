"""Line deduplication against all pairs of lines."""

import random

from loomrow.llm import line_dedup, regions
from loomrow.llm.components import components
from loomrow.llm.line_dedup import bands, dedup_lines, normal, op1_line_dedup, shingles


def alike(x, y):
    x, y = shingles(x), shingles(y)
    return 100 * len(x & y) >= 80 * len(x | y)


def brute(rows):
    lines = [(k, i, normal(x)) for k, t in rows if k is not None for i, x in enumerate((t or "").split("\n"))]
    lines = sorted(x for x in lines if x[2])
    parent = list(range(len(lines)))

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i, (_, _, x) in enumerate(lines):
        for j in range(i):
            if alike(x, lines[j][2]):
                a, b = find(i), find(j)
                parent[max(a, b)] = min(a, b)
    gone = {lines[i][:2] for i in range(len(lines)) if find(i) != i}
    return {k: "\n".join(x for i, x in enumerate(t.split("\n")) if (k, i) not in gone) for k, t in rows if k is not None and t}


def corpus(seed=1, count=60):
    rng = random.Random(seed)
    words = ["".join(rng.choice("abcdefghijklmnopqrstuvwxyzéß") for _ in range(rng.randrange(2, 9))) for _ in range(200)]
    pool = [" ".join(rng.choice(words) for _ in range(rng.randrange(1, 40))) for _ in range(60)]
    rows = []
    for k in range(1, count):
        lines = []
        for _ in range(rng.randrange(1, 8)):
            line = rng.choice(pool)
            for _ in range(rng.choice([0, 0, 1, 2])):
                parts = line.split(" ")
                parts[rng.randrange(len(parts))] = rng.choice(words)
                line = " ".join(parts)
            lines.append(rng.choice([line, line.upper(), "  " + line.replace(" ", "  "), ""]))
        rows.append((k, "\n".join(lines)))
    return rows


def test_first_lines_of_components_stay(spark):
    rows = corpus()
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    want = brute(rows)
    got = {r.doc_id: r.text for r in dedup_lines(df).collect()}
    wrong = [k for k in want if got[k] != want[k]]
    assert not wrong, (got[wrong[0]], want[wrong[0]])


def test_bands_find_nearly_all_similar_lines():
    rng = random.Random(7)
    letters = "abcdefghijklmnopqrstuvwxyz "
    found = total = 0
    for _ in range(400):
        line = "".join(rng.choice(letters) for _ in range(150))
        other = list(line)
        other[rng.randrange(150)] = "#"
        other = "".join(other)
        if alike(line, other):
            total += 1
            a, b = bands([line, other])
            found += bool((a == b).any())
    assert total > 300 and found / total > 0.99


def test_bands_do_not_depend_on_neighbours():
    lines = ["a", "short", "a line of some length", "é" * 50, "x" * 10_000]
    together = bands(lines)
    for i, line in enumerate(lines):
        assert (bands([line])[0] == together[i]).all()


def test_nulls_repeats_clashes_and_empty(spark):
    rows = [(None, "same line here", 1), (1, None, 1), (2, "", 1), (3, "same line here\n\nsame line here", 1), (3, "other\nsame line here", 1), (4, "SAME  line here", 1)]
    df = spark.createDataFrame(rows, "doc_id long, text string, n_kept int")
    got = sorted((r.doc_id or 0, r.text or "-", r.n_lines, r.n_kept) for r in dedup_lines(df).collect())
    assert got == [
        (0, "same line here", 1, 1), (1, "-", 0, 0), (2, "-", 0, 0), (3, "other", 2, 1), (3, "same line here\n", 2, 1), (4, "-", 1, 0),
    ]
    assert dedup_lines(df).columns == ["doc_id", "text", "n_lines", "n_kept"]
    assert dedup_lines(df.limit(0)).count() == 0


def test_long_lines(spark, monkeypatch):
    monkeypatch.setattr(line_dedup, "PART", 1000)
    text = "abc def " * 40_000
    df = spark.createDataFrame([(1, text), (2, text + "x"), (3, "y")], "doc_id long, text string")
    assert [r.n_kept for r in dedup_lines(df).orderBy("doc_id").collect()] == [1, 0, 1]


def test_query(spark, data):
    df = op1_line_dedup(spark, data)
    assert df.count() == spark.read.parquet(f"{data}/documents.parquet").count()
    assert df.where("n_kept > n_lines").isEmpty()


def test_steps_do_not_grow_with_regions(spark, monkeypatch):
    rows = corpus(seed=4, count=40)
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    calls = []

    def counted(links):
        calls.append(1)
        return components(links)

    monkeypatch.setattr(regions, "components", counted)
    monkeypatch.setattr(line_dedup, "SMALL_REGION", 2)
    monkeypatch.setattr(line_dedup, "FEW", 2)
    want = brute(rows)
    got = {r.doc_id: r.text for r in dedup_lines(df).collect()}
    assert {k: got[k] for k in want} == want
    assert len(calls) == 1


def test_links_in_a_group_are_fewer_than_its_lines(spark):
    rng = random.Random(6)
    base = ["w%d" % rng.randrange(1000) for _ in range(80)]
    texts = []
    for i in range(40):
        words = list(base)
        words[rng.randrange(80)] = "x%d" % i
        texts.append(" ".join(words))
    lines = spark.createDataFrame(list(enumerate(texts)), "node long, line string")
    for few in (0, 100):
        groups = spark.createDataFrame([(1, 1, i, 1, i, 2) for i in range(40)], "group long, region long, node long, n int, component long, zone int")
        line_dedup.FEW, before = few, line_dedup.FEW
        found = line_dedup.linked_in_groups(groups, lines).collect()
        line_dedup.FEW = before
        assert len(found) == 39

"""Personal data against a plain search in Python."""

import random
import re
from hashlib import sha256

import pytest
from pyspark.sql import functions as F

from loomrow.llm.pii import CHUNK, find_pii, listed, op2_pii, running_totals

PATTERNS = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def passes_luhn(number):
    total = 0
    for i, d in enumerate(reversed(number)):
        d = int(d) * (1 + i % 2)
        total += d - 9 * (d > 9)
    return total % 10 == 0


def brute(text):
    found = []
    for order, (kind, pattern) in enumerate(PATTERNS.items()):
        for m in re.finditer(pattern, text):
            number = re.sub("[^0-9]", "", m[0])
            good = {
                "email": lambda: True,
                "ip": lambda: all(int(p) <= 255 for p in m[0].split(".")),
                "card": lambda: 14 <= len(number) <= 19 and passes_luhn(number),
                "phone": lambda: 10 <= len(number) <= 15,
            }[kind]()
            if good:
                found.append((m.start(), order, m.end(), kind))
    return ",".join(f"{k}:{s}:{e}" for s, _, e, k in sorted(found))


def fuzzed():
    rng = random.Random(5)
    pools = ["a@b.c_d+-%é 1", "0123456789 -", "+1 ()-.2345", "1.2.25.0 ", "a.b@-\n😀 "]
    texts = ["".join(rng.choice(rng.choice(pools)) for _ in range(rng.randrange(60))) for _ in range(400)]
    texts += ["".join(rng.choice(pools[i % 5]) for _ in range(rng.randrange(40))) for i in range(600)]
    return texts + [
        "x@y.com_foo@z.org@q.de", "4539 1488 0343 6467, 4539148803436467 and 6011-1111-1111-1117-", "0000255.1.2.3.4.5.6.7",
        "é😀 4000000000000002", "1" * 20, "+1 (988) 555-2485", "",
    ]


def results(spark, texts):
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    spans = F.filter("pii", lambda s: s["order"] < 4)
    return {r[0]: r[1] for r in find_pii(df).select("doc_id", listed(spans)).collect()}


def test_base_spans_are_those_of_a_plain_search(spark):
    texts = fuzzed()
    got = results(spark, texts)
    for i, text in enumerate(texts):
        assert got[i] == brute(text), text


def test_many_spans_and_long_words(spark):
    texts = ["1.2.3.4 " * (3 * CHUNK + 5), "a" * 200_000, "7" * 200_000, "a.b" * 50_000 + "@" + "c.d" * 50_000, "+1" * 20_000]
    got = results(spark, texts)
    assert got[0] == brute(texts[0]) and got[1] == got[2] == ""
    assert got[3] == f"email:0:{len(texts[3])}" and got[4] == ""


def test_iban_and_context(spark):
    texts = ["IBAN DE89370400440532013000 ok", "GB82 WEST 1234 5698 7654 32", "DE89370400440532013001", "ssn 123-45-6789", "x 123-45-6789"]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = [r[0] for r in find_pii(df).orderBy("doc_id").select(listed(F.col("pii"))).collect()]
    assert got == ["iban:5:27", "iban:0:27", "", "ssn:4:15", ""]
    score = find_pii(df).orderBy("doc_id").select("pii.score").first()[0]
    assert score == [1.0]


def test_nulls_clashes_and_empty_table(spark):
    df = spark.createDataFrame([(None, None, 1), (1, "a@b.cd", 2), (1, "a@b.cd", 2)], "doc_id long, text string, pii int")
    got = sorted((r.doc_id or 0, len(r.pii)) for r in find_pii(df).collect())
    assert got == [(0, 0), (1, 1), (1, 1)]
    assert find_pii(df).columns == ["doc_id", "text", "pii"]
    assert find_pii(df.limit(0)).count() == 0


@pytest.mark.parametrize("size", [0, 1, CHUNK, CHUNK + 1, 5 * CHUNK])
def test_running_totals(spark, size):
    numbers = [i % 7 for i in range(size)]
    df = spark.createDataFrame([(numbers,)], "n array<int>")
    total, want = 0, []
    for x in numbers:
        total += x
        want.append(total)
    assert df.select(running_totals(F.col("n"))).first()[0] == want


def test_query(spark, data):
    df = op2_pii(spark, data)
    texts = {r.doc_id: r.text or "" for r in spark.read.parquet(f"{data}/documents.parquet").collect()}
    for r in df.collect():
        want = brute(texts[r.doc_id])
        assert r.base_sha256 == sha256(want.encode()).hexdigest()
        assert r.n_email + r.n_ip + r.n_card + r.n_phone == len([x for x in want.split(",") if x])
    assert "Python" not in df._jdf.queryExecution().executedPlan().toString()

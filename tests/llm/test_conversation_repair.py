"""Repairs against a search of all edits, conversation by conversation, and against cuts into many segments."""

import hashlib
import random
import re
import zlib
from functools import lru_cache

import pytest
from pyspark.sql import functions as F

from loomrow.llm.conversation_repair import FINAL, Repair, before_run, damaged, transition, unrolled
from loomrow.llm.queries import QUERIES

COLUMNS = ["conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256"]


def spoilt(rows):
    """The contract's damage in plain Python."""
    out = []
    for conv, turn, role, text in rows:
        role, text = " " if role is None else role, " " if text is None else text
        fault = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
        text = "" if fault == 1 else re.sub("[.!?]", "", text) if fault == 2 else text
        role = "user" if fault == 4 else role
        out += [(conv, turn, role, text)] * (0 if fault == 0 else 2 if fault == 3 else 1)
    return out


def searched(rows):
    """What the contract says of one conversation: every script of edits is weighed as (cost, letters)."""
    rows = sorted(rows, key=lambda r: (r[1] is not None, r[1] or 0, r[2], hashlib.sha256(r[3].encode()).digest()))
    faults, seen = [], set()
    for _, _, role, text in rows:
        bare = text.strip(" \t\n\x0b\x0c\r")
        faults.append("b" if not bare else "d" if (role, text) in seen else "t" if bare[-1] not in ".!?" else "")
        seen.add((role, text))
    initials = [r[2][:1] for r in rows]
    illegal = sum(a + b not in ("su", "ua", "au") for a, b in zip(initials, initials[1:]))
    turns = [r[1] for r in rows if r[1] is not None]

    @lru_cache(None)
    def best(i, state, inserted=0):
        options = []
        if i == len(rows):
            if state in ("", "a"):
                options.append((0, "", ()))
        else:
            cost, letters, texts = best(i + 1, state)
            options.append((cost + 3, "D" + letters, texts))
            if faults[i] not in ("b", "d"):
                extra, role, text = faults[i] == "t", rows[i][2], rows[i][3]
                if initials[i] in ("s", "u", "a") and {"s": state == "", "u": state != "u", "a": state == "u"}[initials[i]]:
                    cost, letters, texts = best(i + 1, initials[i])
                    options.append((cost + extra, "K" + letters, (f"{role}:{text}", *texts)))
                new = "a" if state == "u" else "u"
                cost, letters, texts = best(i + 1, new)
                options.append((cost + 2 + extra, "R" + letters, (("assistant:" if new == "a" else "user:") + text, *texts)))
        if inserted < 3:
            new = "a" if state == "u" else "u"
            cost, letters, texts = best(i, new, inserted + 1)
            options.append((cost + 2, "I" + letters, (("assistant:" if new == "a" else "user:"), *texts)))
        return min(options, key=lambda o: o[:2], default=(10**9, "", ()))

    cost, audit, texts = best(0, "") if rows else (0, "", ())
    gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
    counts = [faults.count(f) for f in "bdt"]
    return [gaps, *counts, illegal, cost, audit, hashlib.sha256("\n".join(texts).encode()).hexdigest()]


def expected(rows):
    groups = {conv: [] for conv, *_ in rows}
    for row in spoilt(rows):
        groups[row[0]].append(row)
    return {conv: tuple(searched(own)) for conv, own in groups.items()}


def test_query(spark, data):
    rows = [tuple(r) for r in spark.read.parquet(f"{data}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    got = QUERIES["op13_conversation_repair"](spark, data)
    assert got.columns == COLUMNS
    assert {r[0]: tuple(r)[1:] for r in got.collect()} == expected(rows)


def made(seed, conversations, longest):
    random.seed(seed)
    rows = []
    for conv in [None, *range(conversations)]:
        for _ in range(random.randint(0, longest)):
            rows.append((
                conv, random.choice([None, *range(6)]), random.choice(["system", "user", "assistant", "tool", "", None, "unknown"]),
                random.choice([None, "", " \n", "a.", "b", "c! ", "d? ", "ä."]),
            ))
    return rows


@pytest.mark.parametrize("partitions", ["2", "9"])
def test_made_conversations(spark, tmp_path, partitions):
    """Nulls in any column, ties, repeated rows, unknown roles; few conversations in many partitions, so that most are cut."""
    for seed, conversations, longest in ((1, 60, 9), (2, 3, 14), (3, 1, 40)):
        rows = made(seed, conversations, longest)
        folder = f"{tmp_path}/{partitions}-{seed}"
        spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").write.parquet(f"{folder}/conversations.parquet")
        before = spark.conf.get("spark.sql.shuffle.partitions")
        spark.conf.set("spark.sql.shuffle.partitions", partitions)
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
        try:
            got = {r[0]: tuple(r)[1:] for r in QUERIES["op13_conversation_repair"](spark, folder).collect()}
        finally:
            spark.conf.set("spark.sql.shuffle.partitions", before)
            spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
        assert got == expected(rows)


def test_runs_are_advanced_by_powers():
    random.seed(4)
    for _ in range(200):
        symbol, length = random.randrange(12), random.randint(1, 70)
        after = tuple(random.randint(0, 9) for _ in range(4))
        slow = after
        for _ in range(length):
            slow = tuple(min(t + c for t, c in zip(row, slow)) for row in transition(symbol))
        assert before_run(symbol, length, after) == slow


def test_one_long_conversation_and_one_repeated_row(spark):
    """A third of all rows in one conversation, a third one row; repaired rows stream in order."""
    base = spark.range(3000)
    long_one = base.select(F.lit(7).cast("long").alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") % 2 == 0, "user").otherwise("assistant").alias("role"), F.concat(F.col("id"), F.lit(".")).alias("text"))
    repeated = base.select(F.lit(8).cast("long").alias("conv_id"), F.lit(0).cast("long").alias("turn"), F.lit("user").alias("role"), F.lit("x.").alias("text"))
    found = Repair(long_one.union(repeated).repartition(6))
    report = {r.conv_id: r for r in found.report().collect()}
    assert report[7].audit == "K" * 3000 and report[7].cost == 0 and report[7].illegal == 0
    assert report[8].audit == "K" + "D" * 2999 + "I" and report[8].cost == 3 * 2999 + 2 and report[8].duplicate == 2999
    repaired = found.repaired()
    assert repaired.columns == ["conv_id", "place", "role", "text"]
    assert [(r.role, r.text) for r in repaired.where("conv_id = 8").orderBy("place").collect()] == [("user", "x."), ("assistant", "")]
    text = "\n".join(f"{r.role}:{r.text}" for r in repaired.where("conv_id = 7").orderBy("place").collect())
    assert hashlib.sha256(text.encode()).hexdigest() == report[7].repaired_sha256


def test_long_texts_clashes_other_keys_and_empty(spark):
    rows = [("a", 0, "user", "x" * 300_000 + ".", 1, "z"), ("a", 1, "assistant", "y " * 100_000, 2, "z"), (None, None, None, None, 3, "z")]
    df = spark.createDataFrame(rows, "conv_id string, turn int, role string, text string, n int, conv string")
    got = {r.conv_id: r for r in Repair(df).report().collect()}
    assert got["a"].audit == "KK" and got["a"].cost == 1 and got["a"].truncated == 1
    assert got[None].audit == "D" and got[None].gaps == 0 and got[None].blank == 1
    assert Repair(df.limit(0)).report().count() == 0 and Repair(df.limit(0)).repaired().count() == 0
    assert damaged(df.limit(0)).count() == 0


def test_a_run_without_rows():
    assert unrolled([], FINAL, True, 0) == ("", 0)

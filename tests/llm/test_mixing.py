"""The mix against its SQL, and its bounds."""

from pyspark.sql import functions as F

from conformance.check import compare, duck
from loomrow.llm.mixing import mix, mixture, source_targets
from loomrow.llm.queries import ORACLES, QUERIES


def test_query_agrees_with_sql(spark, data):
    assert compare(spark, data, QUERIES["op8_mixing"], ORACLES["op8_mixing"], duck(data)) == ""


def shared_out(sizes):
    """Targets by handing the excess on until none is above its limit."""
    weights = {s: 1 + i % 3 for i, s in enumerate(sizes)}
    total, fixed = sum(sizes.values()), {}
    while True:
        left = {s: w for s, w in weights.items() if s not in fixed}
        rest = total - sum(fixed.values())
        share = {s: rest * w / sum(left.values()) for s, w in left.items()}
        over = {s: 3.0 * sizes[s] for s in left if share[s] > 3 * sizes[s]}
        if not over:
            return fixed | share
        fixed |= over


def test_targets(spark):
    for sizes in ({"a": 100, "b": 1, "c": 40, "d": 0, "e": 7, "f": 900}, {"a": 5}, {"a": 1, "b": 10**6, "c": 2}):
        df = spark.createDataFrame(list(sizes.items()), "source string, source_size long")
        got = {r.source: r.target for r in source_targets(df).collect()}
        want = shared_out(sizes)
        assert all(abs(got[s] - want[s]) < 1e-6 for s in sizes), (got, want)


def test_one_source_with_a_third_of_all_rows(spark):
    df = spark.range(6000).select(
        F.col("id").alias("doc_id"), F.when(F.col("id") % 3 == 0, "hot").otherwise(F.concat(F.lit("s"), F.col("id") % 20)).alias("source"),
        F.repeat(F.lit("w "), (F.col("id") % 50 + 1).cast("int")).alias("text"),
    )
    mixed = mix(df)
    again = mix(df.repartition(7).orderBy(F.desc("doc_id")))
    assert sorted(map(tuple, mixed.collect())) == sorted(map(tuple, again.collect()))
    for r in mixed.groupBy("source").agg(F.sum(F.col("copies") * F.col("size")).alias("taken"), F.first("target").alias("target")).collect():
        assert abs(r.taken - r.target) <= 60
    assert mixed.where("copies > 3 or copies < 0").isEmpty()


def test_nulls_repeats_clashes_long_and_empty(spark):
    rows = [(None, None, None, 9), (1, "a b", None, 9), (1, "a b", "s", 9), (2, "", "s", 9), (3, "x " * 200_000, "t", 9)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string, size int")
    got = mix(df).collect()
    assert sorted((r.doc_id or 0, r.size) for r in got) == [(0, 0), (1, 2), (1, 2), (2, 0), (3, 200_000)]
    assert mix(df).columns == ["doc_id", "text", "source", "size", "source_size", "target", "copies"]
    assert mixture(df).columns == df.columns and mixture(df).where("size <> 9").isEmpty()
    assert mixture(df).count() == sum(r.copies for r in got)
    assert mix(df.limit(0)).count() == mixture(df.limit(0)).count() == 0

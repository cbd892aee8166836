"""Mixing sources to target weights by systematic sampling.

Every document of a source is expected ``target / size of the source`` times. The expected copies are
summed up in a fixed order, one random offset per source is added, and a document is taken once for
each whole number its part of the sum reaches. Documents are ordered by size class first, so that every
class gives its share and the words taken come near the target.
"""

from __future__ import annotations

from math import log

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import WORD, quoted, table, unpacked, whole_row

#: weights of the sources in their order, repeating
WEIGHTS = (1, 2, 3)
#: a target is at most so many times the size of its source
LIMIT = 3
SEED = "systematic"
#: about so many rows share one of the blocks in which rows are numbered
BLOCK_ROWS = 10_000_000


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def source_targets(sizes: DataFrame, weights=WEIGHTS, limit: int = LIMIT) -> DataFrame:
    """Targets of sources, from their sizes: columns ``source``, ``source_size``, ``target``.

    One row per source: this table is small, and ordering it in one task is no burden. A source is at
    its limit exactly if the share left by the sources that reach theirs earlier would exceed it.
    """
    ordered = Window.orderBy(F.col("source").asc_nulls_last())
    by_room = Window.orderBy(F.col("limit") / F.col("weight"), F.col("source").asc_nulls_last())
    all_rows = Window.partitionBy()
    turn = (F.row_number().over(ordered) - 1) % len(weights) + 1
    ranked = sizes.select(
        "source",
        "source_size",
        F.element_at(F.array(*[F.lit(float(w)) for w in weights]), turn).alias("weight"),
        (F.col("source_size") * float(limit)).alias("limit"),
        F.sum("source_size").over(all_rows).cast("double").alias("total"),
    )
    before = F.coalesce(F.sum("limit").over(by_room.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0))
    onward = F.sum("weight").over(by_room.rowsBetween(0, Window.unboundedFollowing))
    full = ranked.withColumn("full", F.col("limit") * onward <= (F.col("total") - before) * F.col("weight"))
    fixed = F.sum(F.when(F.col("full"), F.col("limit")).otherwise(0.0)).over(all_rows)
    shared = F.sum(F.when(F.col("full"), 0.0).otherwise(F.col("weight"))).over(all_rows)
    level = (F.col("total") - fixed) / F.nullif(shared, F.lit(0.0))
    return full.select(
        "source", "source_size", F.when(F.col("full"), F.col("limit")).otherwise(level * F.col("weight")).alias("target")
    )


def with_copies(docs: DataFrame, text: str, source: str, key: str, weights, limit: int, seed: str) -> DataFrame:
    """Each row of ``docs`` packed as ``row``, with its sizes, target and number of copies."""
    packed = docs.select(
        whole_row(docs).alias("row"),
        word_count(quoted(text)).alias("size"),
        quoted(source).alias("source"),
        F.coalesce(F.concat(F.lit("s"), quoted(source)), F.lit("null")).alias("part"),
        F.md5(F.coalesce(quoted(key).cast("string"), F.lit(""))).alias("tie"),
    )
    digits = 1 + int(log(max(1.0, docs.count() / BLOCK_ROWS), 16))
    bits = F.bin(F.col("size"))
    placed = packed.withColumn("class", F.concat(F.lpad(F.length(bits).cast("string"), 2, "0"), F.substr(bits, F.lit(2), F.lit(3))))
    placed = placed.withColumn("block", F.substr("tie", F.lit(1), F.lit(digits)))
    blocks = placed.groupBy("part", "class", "block").agg(
        F.count("*").alias("rows"), F.sum("size").alias("words"), F.first("source").alias("source")
    )
    targets = source_targets(blocks.groupBy("source").agg(F.sum("words").alias("source_size")), weights, limit)
    targets = targets.select(
        F.coalesce(F.concat(F.lit("s"), "source"), F.lit("null")).alias("part"), "source_size", "target"
    )
    earlier = Window.partitionBy("part").orderBy("class", "block").rowsBetween(Window.unboundedPreceding, -1)
    starts = blocks.select(
        "part", "class", "block", F.coalesce(F.sum("rows").over(earlier), F.lit(0)).alias("first")
    ).join(targets, "part")
    inside = Window.partitionBy("part", "class", "block").orderBy("tie", "size")
    numbered = placed.withColumn("number", F.row_number().over(inside) - 1).join(starts, ["part", "class", "block"])
    # 20 bits and a half: sums of the offset and whole numbers stay exact
    offset = (F.conv(F.substr(F.md5(F.concat(F.lit(seed), "part")), F.lit(1), F.lit(5)), 16, 10).cast("double") + 0.5) / float(1 << 20)
    rate = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0)
    place = F.col("first") + F.col("number")
    copies = F.floor((place + 1) * rate + offset) - F.floor(place * rate + offset)
    return numbered.select("row", "size", "source_size", "target", copies.cast("int").alias("copies"))


def mix(
    docs: DataFrame,
    text: str = "text",
    source: str = "source",
    key: str = "doc_id",
    weights=WEIGHTS,
    limit: int = LIMIT,
    seed: str = SEED,
) -> DataFrame:
    """All rows of ``docs`` with ``size``, ``source_size``, ``target`` and ``copies`` (0 or more).

    Sizes count words. A null text has size 0; a null source is a source of its own, the last in order;
    rows without a key, or with the same key, are ordered by their size and are otherwise alike. An empty
    table gives an empty result. Input columns named like a result column are replaced by it. Copies depend
    on the rows alone, not on their order or partitions, so reruns agree.
    """
    result = with_copies(docs, text, source, key, weights, limit, seed)
    return unpacked(result, "row", ["size", "source_size", "target", "copies"])


def mixture(
    docs: DataFrame,
    text: str = "text",
    source: str = "source",
    key: str = "doc_id",
    weights=WEIGHTS,
    limit: int = LIMIT,
    seed: str = SEED,
) -> DataFrame:
    """The rows of ``docs`` as often as :func:`mix` takes them, with the columns of ``docs``."""
    taken = with_copies(docs, text, source, key, weights, limit, seed).where("copies > 0")
    repeated = taken.select("row", F.explode(F.sequence(F.lit(1), F.col("copies"))).alias("copy"))
    return unpacked(repeated, "row", [])


def op8_mixing(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents").select("doc_id", "source", "text")
    mixed = mix(docs)
    return mixed.select(
        "doc_id", "size", "source_size", "target", (F.col("copies") * F.col("size")).cast("long").alias("taken")
    )


OP8_SQL = r"""
WITH d AS (
    SELECT doc_id, source, coalesce('s' || source, 'null') AS part,
           coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::BIGINT AS size,
           md5(coalesce(doc_id::VARCHAR, '')) AS tie
    FROM documents
), s AS (
    SELECT source, part, sum(size)::BIGINT AS source_size FROM d GROUP BY source, part
), w AS (
    SELECT *, [1.0, 2.0, 3.0][((row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1)::INT]::DOUBLE AS weight,
           source_size * 3.0::DOUBLE AS cap, (sum(source_size) OVER ())::DOUBLE AS total
    FROM s
), f AS (
    SELECT *, cap * sum(weight) OVER (ORDER BY cap / weight, source NULLS LAST ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)
              <= (total - coalesce(sum(cap) OVER (ORDER BY cap / weight, source NULLS LAST
                                                  ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)) * weight AS is_full
    FROM w
), t AS (
    SELECT part, source_size,
           CASE WHEN is_full THEN cap ELSE
                (total - sum(CASE WHEN is_full THEN cap ELSE 0 END) OVER ())
                / nullif(sum(CASE WHEN is_full THEN 0 ELSE weight END) OVER (), 0) * weight END AS target
    FROM f
), n AS (
    SELECT d.*, t.source_size, t.target,
           row_number() OVER (PARTITION BY part ORDER BY lpad(len(bin(size))::VARCHAR, 2, '0') || substr(bin(size), 2, 3), tie, size) - 1 AS place,
           (('0x' || substr(md5('systematic' || part), 1, 5))::BIGINT + 0.5::DOUBLE) / 1048576.0::DOUBLE AS shift,
           CASE WHEN source_size > 0 THEN target / source_size ELSE 0 END AS rate
    FROM d JOIN t USING (part)
)
SELECT doc_id, size, source_size, target::DOUBLE AS target,
       ((floor((place + 1) * rate + shift) - floor(place * rate + shift)) * size)::BIGINT AS taken
FROM n
"""

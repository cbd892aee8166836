"""Joins in the metric space of the Jaccard distance, region by region, and filters of bounded size."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import written
from .components import components

#: bits for each member of a broadcast filter, and at most in all (16 MB)
FILTER_BITS, MOST_FILTER_BITS = 16, 1 << 27


class Filter:
    """A bit array of bounded size that holds all members of a set of hashes (longs), and few others."""

    def __init__(self, members: DataFrame, column: str):
        count = members.count()
        self.bits = min(1 << max(16, (count * FILTER_BITS).bit_length()), MOST_FILTER_BITS)
        place = F.pmod(F.col(column), F.lit(self.bits))
        words = members.select(
            F.floor(place / 64).cast("int").alias("word"), F.call_function("shiftleft", F.lit(1).cast("long"), (place % 64).cast("int")).alias("bit")
        )
        found = words.groupBy("word").agg(F.bit_or("bit").alias("bits")).toPandas()
        array = np.zeros(self.bits // 64, dtype=np.int64)
        array[found["word"].to_numpy()] = found["bits"].to_numpy()
        self.shared = members.sparkSession.sparkContext.broadcast(array)

    def lookup(self):
        """A function of an array of values, for use in tasks: which of them may be members."""
        shared, bits = self.shared, self.bits

        def may_be(values: np.ndarray) -> np.ndarray:
            place = values % bits
            return (shared.value[place >> 6] >> (place & 63)) & 1 == 1

        return may_be


def shares(percent: int):
    """Whether the intersection is so many percent of the union."""
    return 100 * F.col("common") >= percent * (F.col("na") + F.col("nb") - F.col("common"))


def may_link(a: str, b: str, percent):
    """Sizes alone put two sets further apart than the distance for which ``percent`` of the union is shared."""
    return 100 * F.least(a, b) >= percent * F.greatest(a, b)


def metric_links(
    members: DataFrame,
    measure: Callable[[DataFrame], DataFrame],
    within: Callable[[DataFrame], DataFrame],
    percent: int,
    block: int,
    least: int = 1,
) -> DataFrame:
    """Links ``a, b`` among nodes of common regions, enough that their components are those of all links.

    ``members`` has ``region, node, n`` (the node's size). ``measure(pairs)`` gives ``a, b, na, nb, common`` of
    pairs ``a, b, percent``; it may leave out pairs that share less than ``percent`` of their union. ``within(groups)`` gives the links
    ``a, b`` among the members ``group, region, node, n, component, zone`` of each group that unite its components. With ``r`` the
    distance that links: the least node of a region is its pivot, nodes within ``r`` its ball (zone 0), those within ``2 r``
    its window (zone 1), the rest lie beyond (zone 2); a node of the ball links with none beyond. What links with pivots forms
    components. A pivot is done when it is measured: the other nodes of its region go on without it, so a region of two is done. Regions
    within one component are done, regions of the same nodes count once, the others are compared
    between components, in tiles of at most two blocks of ``block`` nodes (see :func:`tiles`). The number of steps does not
    depend on the regions. Linked nodes share ``least`` regions, or ``percent`` of the larger size if that is less: two nodes that only meet in
    regions of their own, and in fewer, are not measured.
    """
    wide = max(100 - 2 * (100 - percent), 1)
    pivots = members.groupBy("region").agg(F.min("node").alias("pivot"), F.min_by("n", "node").alias("np"), F.count("*").alias("size"))
    placed = written(members.join(written(pivots.where("size > 1"), "pivots"), "region").where("node <> pivot"), "placed")
    met = placed.where(may_link("n", "np", wide)).groupBy(F.col("node").alias("a"), F.col("pivot").alias("b"))
    needed = F.least(F.lit(least), F.ceil(F.max(F.greatest("n", "np")) * percent / 100))
    met = met.agg(F.max("size").alias("size"), F.count("*").alias("times"), needed.alias("needed")).where("size > 2 or times >= needed")
    measured = measure(met.select("a", "b", F.when(F.col("size") > 2, wide).otherwise(percent).alias("percent")))
    links = measured.where(shares(percent)).select("a", "b")
    labels = components(links)
    more = placed.where("size > 2").join(labels, "node", "left")
    labelled = written(more.select("region", "node", "n", "pivot", F.coalesce("component", "node").alias("component")), "labelled")
    sums = [F.bit_xor(F.xxhash64("node", F.lit(i))).alias(f"sum{i}") for i in range(2)]
    facts = [F.count("*").alias("count"), F.min("component").alias("low"), F.max("component").alias("high")]
    several = labelled.groupBy("region").agg(*facts, *sums).where("low <> high")
    several = several.groupBy("count", "sum0", "sum1").agg(F.min("region").alias("region"))
    inside = labelled.join(several.select("region", "count"), "region")
    near = measured.where(shares(wide)).select(F.col("a").alias("node"), F.col("b").alias("pivot"), F.when(shares(percent), 0).otherwise(1).alias("z"))
    inside = inside.join(near, ["node", "pivot"], "left").select("region", "node", "n", "component", F.coalesce("z", F.lit(2)).alias("zone"), "count")
    return links.union(within(tiles(written(inside, "inside"), block)))


def tiles(inside: DataFrame, block: int) -> DataFrame:
    """``group, region, node, n, component, zone``: groups in which all nodes of a region that are not of one component meet.

    A region of at most ``block`` nodes is a group. A larger one is cut into blocks: each component of ``block`` nodes has blocks of
    its own, the smaller ones share theirs. Two blocks make a group, unless both belong to one component.
    """
    columns = ["region", "node", "n", "component", "zone"]
    small = inside.where(F.col("count") <= block).select(F.col("region").alias("group"), *columns)
    large = inside.where(F.col("count") > block)
    parts = large.groupBy("region", "component").agg(F.count("*").alias("size"))
    alone = F.col("size") >= block
    parts = written(parts.withColumn("alone", alone).withColumn("of", F.when(alone, F.col("component")).otherwise(F.lit(0))), "parts")
    sizes = parts.groupBy("region", "alone", "of").agg(F.ceil(F.sum("size") / block).cast("int").alias("blocks"))
    place = F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int").alias("part")
    dealt = large.join(parts.join(sizes, ["region", "alone", "of"]).drop("size"), ["region", "component"])
    dealt = dealt.select(F.struct("alone", "of", place).alias("block"), *columns)
    blocks = sizes.select("region", "alone", "of", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("part"))
    blocks = blocks.select("region", F.struct("alone", "of", "part").alias("block"))
    pairs = blocks.withColumnRenamed("block", "x").join(blocks.withColumnRenamed("block", "y"), "region").where("x <= y")
    pairs = pairs.where("not (x.alone and y.alone and x.of = y.of)").withColumn("group", F.xxhash64("region", "x", "y"))
    ends = pairs.select("region", F.col("x").alias("block"), "group").union(pairs.where("x <> y").select("region", "y", "group"))
    return small.union(dealt.join(ends, ["region", "block"]).select("group", *columns))


def rare_first(component: np.ndarray) -> np.ndarray:
    """An order of nodes by component, the most frequent component last."""
    _, at, count = np.unique(component, return_inverse=True, return_counts=True)
    return np.lexsort((at, count[at]))


def others(i: int, component: np.ndarray, zone: np.ndarray) -> np.ndarray:
    """The places beyond ``i`` of nodes of other components that the zones let link with that at ``i``."""
    return np.flatnonzero((component[i + 1 :] != component[i]) & (np.abs(zone[i + 1 :] - zone[i]) < 2)) + i + 1


def near_by_bits(i: int, rest: np.ndarray, n: np.ndarray, bits: np.ndarray, percent: int) -> tuple[np.ndarray, np.ndarray]:
    """Those of ``rest`` that may share ``percent`` of the union with the set at ``i``, and how much at most is common.

    A bit that only one of two sets has stands for a member that only it has.
    """
    rest = rest[100 * np.minimum(n[rest], n[i]) >= percent * np.maximum(n[rest], n[i])]
    own = bits[rest]
    common = np.minimum(
        n[i] - np.bitwise_count(bits[i] & ~own).sum(axis=1, dtype=np.int64), n[rest] - np.bitwise_count(own & ~bits[i]).sum(axis=1, dtype=np.int64)
    )
    keep = 100 * common >= percent * (n[i] + n[rest] - common)
    return rest[keep], common[keep]


def gathered(groups: DataFrame, payload: DataFrame, *columns: str) -> DataFrame:
    """``region, node, n, component, zone`` and a payload of all members of each group, in lists; groups are small, so each is one row."""
    names = ["region", "node", "n", "component", "zone", *columns]
    members = groups.join(payload.select("node", *columns), "node")
    lists = members.groupBy("group").agg(F.collect_list(F.struct(*names)).alias("m"))
    return lists.select(*[F.col("m")[c].alias(c) for c in names])

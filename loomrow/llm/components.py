"""Distributed union-find: connected components of a table of links."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import written


def priority(turn: int, column: str):
    """At first the node itself, as links often lead to a group's least node; then hashes, as chains may be long."""
    return F.col(column) if turn < 2 else F.xxhash64(F.lit(turn), column)


def components(links: DataFrame, left: str = "a", right: str = "b") -> DataFrame:
    """``node, component`` for each node that has a link; the component is its smallest node.

    Each round unites every node with the neighbour of least priority (after two rounds a hash that
    changes with the round, so that long chains halve, too) and keeps the links between what is united, until none are left. Only links
    and one row per node are shuffled; a node with very many links is reduced in the tasks first.
    Links with a null end, and links of a node with itself, are without effect.
    """
    pairs = links.select(F.col(left).alias("a"), F.col(right).alias("b")).where("a <> b")
    pairs = written(pairs.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), "links")
    parents: list[DataFrame] = []
    while not pairs.isEmpty():
        turn = len(parents)

        def ranked(column: str):
            return F.struct(priority(turn, column).alias("priority"), F.col(column).alias("node"))

        both = pairs.select("a", ranked("b").alias("r")).union(pairs.select("b", ranked("a").alias("r")))
        own = ranked("a")
        nearest = both.groupBy("a").agg(F.min("r").alias("r"))
        parent = written(nearest.select(F.col("a").alias("node"), F.least("r", own)["node"].alias("parent")), "parents")
        parents.append(parent)
        moved = (
            pairs.join(parent.withColumnsRenamed({"node": "a", "parent": "pa"}), "a")
            .join(parent.withColumnsRenamed({"node": "b", "parent": "pb"}), "b")
            .where("pa <> pb")
            .select(F.least("pa", "pb").alias("a"), F.greatest("pa", "pb").alias("b"))
        )
        pairs = written(moved.distinct(), "links")
    if not parents:
        return pairs.select(F.col("a").alias("node"), F.col("b").alias("component"))

    def follow(labels: DataFrame, parent: DataFrame) -> DataFrame:
        step = parent.select(F.col("node").alias("parent"), F.col("parent").alias("next"))
        return labels.join(step, "parent", "left").select("node", F.coalesce("next", "parent").alias("parent"))

    labels = written(reduce(follow, parents), "labels")
    least = labels.groupBy("parent").agg(F.min("node").alias("component"))
    return written(labels.join(written(least, "roots"), "parent").select("node", "component"), "components")

"""Approximate nearest neighbours by counting collisions of single projections.

Every vector is projected on random lines, and each line keeps its vectors sorted. A query opens a window around its own
projection on every line; vectors that lie in the windows of enough lines are verified by their exact inner product. If too few
are, all windows widen by a factor (virtual rehashing: no line is built anew). All vectors that reach the collision threshold are
verified, however many share one place, so equal vectors are never cut off.

For inner products the vectors are first scaled to the unit ball and lifted to the unit sphere, where the nearest vector by
distance is the one of largest inner product. One long vector would squeeze all others towards one pole, so vectors are first parted in
bands of nearly the same length, and each band is scaled by its own. The vectors of a band are dealt out in shards by a hash of their id;
each shard has lines of its own and answers every query, block by block of queries, so no task holds more than a shard and a block.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import quoted, table
from .vectors import usable

LINES = 112
#: vectors that collide on this share of the lines are verified
THRESHOLD = 0.62
#: half of a window's width at first, and how it grows
WIDTH, GROWTH = 1.0, 1.08
#: windows widen until this share of a shard has been verified, and at least so many vectors for each neighbour asked for
VERIFIED, LEAST_FACTOR = 0.25, 10
SHARD_ROWS, BLOCK_ROWS = 4096, 4096
#: the longest vector of a band is at most so many times as long as the shortest
BAND = 1.1
SEED = 20


def lifted(vectors: np.ndarray) -> np.ndarray:
    """Vectors in the unit ball, with one more component that puts them on the sphere."""
    norms = np.linalg.norm(vectors, axis=1)
    scaled = vectors / max(norms.max(initial=0.0), 1e-300)
    return np.column_stack([scaled, np.sqrt(np.maximum(0.0, 1.0 - np.einsum("ij,ij->i", scaled, scaled)))])


class Lines:
    """The sorted projections of one shard."""

    def __init__(self, vectors: np.ndarray):
        rng = np.random.default_rng(SEED)
        points = lifted(vectors)
        self.directions = rng.normal(size=(points.shape[1], LINES))
        projected = (points @ self.directions).T
        order = np.argsort(projected, axis=1, kind="stable")
        self.sorted = np.take_along_axis(projected, order, axis=1)
        self.count = order.shape[1]
        kind = np.uint16 if self.count < 1 << 16 else np.uint32
        self.ranks = np.empty(order.shape, dtype=kind)
        np.put_along_axis(self.ranks, order, np.arange(self.count, dtype=kind)[None, :], axis=1)

    def candidates(self, queries: np.ndarray, wanted: int) -> Iterator[tuple[int, np.ndarray]]:
        """For each query the places of the vectors that collide often enough, at the first width that gives enough of them."""
        units = queries / np.linalg.norm(queries, axis=1, keepdims=True)
        centres = units @ self.directions[:-1]
        enough = min(self.count, max(LEAST_FACTOR * wanted, int(VERIFIED * self.count)))
        least, width = int(np.ceil(THRESHOLD * LINES)), WIDTH
        open_ = np.arange(len(queries))
        while len(open_):
            # where the windows of all open queries begin and how far they reach, line by line
            edges = [np.searchsorted(line, (c - width, c + width)) for line, c in zip(self.sorted, centres[open_].T)]
            low, high = (np.array([e[side] for e in edges]).T for side in (0, 1))
            low, size = low.astype(self.ranks.dtype), (high - low).astype(self.ranks.dtype)
            waiting = []
            for q, start, length in zip(open_, low, size):
                # one comparison: ranks before a window wrap around to large values
                inside = (self.ranks - start[:, None]) < length[:, None]
                found = np.flatnonzero(np.add.reduce(inside.view(np.uint8), axis=0, dtype=np.uint8) >= least)
                if len(found) >= enough:
                    yield q, found
                else:
                    waiting.append(q)
            open_ = np.array(waiting, dtype=np.int64)
            width *= GROWTH


def band(vector: str) -> Column:
    """The number of a vector's band of lengths; length 1 is in the middle of its band."""
    largest = F.array_max(F.transform(vector, F.abs))
    squares = F.aggregate(F.transform(vector, lambda x: x / largest), F.lit(0.0), lambda total, x: total + x * x)
    return F.round((F.log(largest) + F.log(squares) / 2) / math.log(BAND)).cast("int")


def nearest(df: DataFrame, queries: DataFrame, k: int, key: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """``query_id, rank, <key>, score``: for each query its ``k`` nearest found, by inner product, ties to the smaller key.

    ``queries`` has the same columns as ``df``; a query is not its own neighbour. Vectors that are null, zero, or hold null or
    non-finite components take no part, nor do rows without a key; vectors meet only those of their own length. Rows that repeat a key
    are candidates of their own. Empty tables give an empty result.
    """
    def prepared(rows: DataFrame) -> DataFrame:
        good = rows.where(usable(quoted(vector)) & quoted(key).isNotNull())
        return good.select(quoted(key).cast("long").alias("id"), quoted(vector).cast("array<double>").alias("v"), F.size(quoted(vector)).alias("d"))

    data, asked = prepared(df), prepared(queries)
    data = data.withColumn("band", band("v"))
    # one row for each band and number of components
    bands = data.groupBy("d", "band").agg(F.ceil(F.count("*") / SHARD_ROWS).cast("int").alias("shards"))
    blocks = max(1, -(-asked.count() // BLOCK_ROWS))
    of_shard = data.join(F.broadcast(bands), ["d", "band"])
    of_shard = of_shard.withColumn("shard", F.pmod(F.xxhash64("id"), F.col("shards")).cast("int")).drop("shards")
    of_shard = of_shard.withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))
    of_block = asked.withColumn("block", F.pmod(F.xxhash64("id", F.lit(1)), F.lit(blocks)).cast("int"))
    of_block = of_block.join(F.broadcast(bands.select("d", F.col("band").alias("number"), "shards")), "d").withColumnRenamed("number", "band")
    of_block = of_block.withColumn("shard", F.explode(F.sequence(F.lit(0), F.col("shards") - 1))).drop("shards")

    def search(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        parts = []
        if len(left) and len(right):
            vectors = np.array(left["v"].tolist(), dtype=np.float64)
            values = np.array(right["v"].tolist(), dtype=np.float64)
            ids, asked_ids = left["id"].to_numpy(), right["id"].to_numpy()
            for q, found in Lines(vectors).candidates(values, k + 1):
                found = found[ids[found] != asked_ids[q]]
                scores = vectors[found] @ values[q]
                # all that reach the k-th score are ordered, ties by id
                if len(found) > k:
                    top = np.flatnonzero(scores >= np.partition(scores, len(scores) - k)[len(scores) - k])
                    found, scores = found[top], scores[top]
                best = np.lexsort((ids[found], -scores))[:k]
                parts.append(pd.DataFrame({"query_id": asked_ids[q], "id": ids[found][best], "score": scores[best]}))
        columns = {"query_id": "int64", "id": "int64", "score": "float64"}
        return pd.concat(parts) if parts else pd.DataFrame({n: pd.Series(dtype=t) for n, t in columns.items()})

    keys = ["shard", "block", "d", "band"]
    local = of_shard.groupBy(*keys).cogroup(of_block.groupBy(*keys)).applyInPandas(search, "query_id long, id long, score double")
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "id")
    ranked = local.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    return ranked.select("query_id", "rank", F.col("id").alias(key), "score")


def op3_ann(spark: SparkSession, folder: str) -> DataFrame:
    vectors = table(spark, folder, "embeddings")
    return nearest(vectors, vectors.where("vec_id % 20 = 0"), 20)

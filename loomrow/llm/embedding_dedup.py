"""Near copies among embeddings by spherical-cap filters with structured random product codes.

A filter is a direction made of one random code word for each half of the vector's components; a vector belongs to all filters
whose direction it meets at more than a fixed height. These are found by list decoding: only code words that can still reach
the height with the best of the other half are combined. The halves are those of randomly rotated vectors, so that it makes no
difference in which components a vector has its weight. Two similar vectors share a filter with high probability. Vectors
meet in their common filters, and every pair is verified exactly there, in the first filter that both have. Vectors of few components
meet in cells of a grid instead, in which no similar pair is missed.

Equal vectors of a label are one node, with the number of its copies. A filter with many vectors is cut into chunks whose pairs
are verified in different tasks. Tasks give the number of links of each vector and a spanning forest, never the pairs themselves.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import quoted, table, written
from .components import components
from .vectors import matrix, usable

SIMILARITY = 0.93
#: independent codes, and code words for each half in each of them
CODES, WORDS = 5, 24
#: height of the caps, in standard deviations of a random direction's product with a unit vector, from so many components on
HEIGHTS = {24: 2.3, 12: 2.2, 8: 2.0, 6: 1.9}
#: sides of the cells where vectors have fewer components; at most four side by side
CELL = 0.5
#: vectors of one filter that meet in one task at most, twice
CHUNK = 500
SEED = 7


def code(dimension: int) -> list[list[np.ndarray]]:
    """For each code the unit words of the two halves, weighted by the halves' lengths and rotated."""
    rng = np.random.default_rng([SEED, dimension])
    codes = []
    rotation = np.linalg.qr(np.random.default_rng([SEED, dimension, 1]).normal(size=(dimension, dimension)))[0]
    for _ in range(CODES):
        shuffled, halves = rng.permutation(dimension), []
        for places in (shuffled[: (dimension + 1) // 2], shuffled[(dimension + 1) // 2 :]):
            words = rng.normal(size=(WORDS, max(len(places), 1)))
            words /= np.linalg.norm(words, axis=1, keepdims=True)
            whole = np.zeros((WORDS, dimension))
            whole[:, places] = words[:, : len(places)] * np.sqrt(len(places) / dimension)
            halves.append(whole @ rotation)
        codes.append(halves)
    return codes


def decoded(unit: np.ndarray, codes: list[list[np.ndarray]]) -> np.ndarray:
    """All filters of a unit vector, ascending."""
    if len(unit) < min(HEIGHTS):
        return cells(unit)
    height, found = next(h for least, h in HEIGHTS.items() if len(unit) >= least) / np.sqrt(len(unit)), []
    for number, halves in enumerate(codes):
        first, second = halves[0] @ unit, halves[1] @ unit
        left = np.flatnonzero(first + second.max() >= height)
        right = np.flatnonzero(second + first.max() >= height)
        a, b = np.nonzero(first[left][:, None] + second[right][None, :] >= height)
        found.append(np.sort((number * WORDS + left[a]) * WORDS + right[b]))
    return np.concatenate(found).astype(np.int32)


def cells(unit: np.ndarray) -> np.ndarray:
    """All cells that the point midway to a similar unit vector can lie in, ascending."""
    reach = np.sqrt(2 - 2 * SIMILARITY) / 2 + 1e-6
    low, high = (np.clip(np.floor((unit + r) / CELL), -2, 1).astype(int) + 2 for r in (-reach, reach))
    places = [0]
    for first, last in zip(low, high):
        places = [4 * place + c for place in places for c in range(first, last + 1)]
    return np.array(places, dtype=np.int32)


def listed(nodes: DataFrame) -> DataFrame:
    """``node`` with its ``filters``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codes: dict[int, list[list[np.ndarray]]] = {}
        for batch in batches:
            found = []
            for values in batch.column("v"):
                vector = np.asarray(values.as_py(), dtype=np.float64)
                vector /= np.linalg.norm(vector)
                if len(vector) not in codes:
                    codes[len(vector)] = code(len(vector))
                found.append(decoded(vector, codes[len(vector)]))
            yield pa.RecordBatch.from_arrays([batch.column("node"), pa.array(found, pa.list_(pa.int32()))], names=["node", "filters"])

    return nodes.select("node", "v").mapInArrow(run, "node long, filters array<int>")


def chunk_links(ids, side, copies, vectors, flat, lengths, here: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of the vectors that meet in one filter: ids, links (copies counted) and roots of a spanning forest."""
    units = vectors / np.linalg.norm(vectors, axis=1, keepdims=True)
    linked = np.triu(units @ units.T >= SIMILARITY, 1)
    if side.any() and not side.all():
        linked &= side[:, None] != side[None, :]
    a, b = np.nonzero(linked)
    if len(a):
        # a pair counts in the first filter that both have
        rows = np.repeat(np.arange(len(ids)), lengths)
        earlier = flat < here
        values, column = np.unique(flat[earlier], return_inverse=True)
        has = np.zeros((len(ids), len(values)), dtype=np.float32)
        has[rows[earlier], column] = 1.0
        fresh = (has @ has.T)[a, b] == 0 if len(values) else np.ones(len(a), dtype=bool)
        a, b = a[fresh], b[fresh]
    links = np.bincount(a, weights=copies[b], minlength=len(ids)) + np.bincount(b, weights=copies[a], minlength=len(ids))
    root = np.arange(len(ids))
    changed = len(a) > 0
    while changed:  # least labels spread along the links
        before = root.copy()
        np.minimum.at(root, a, root[b])
        np.minimum.at(root, b, root[a])
        root = root[root]
        changed = bool((root != before).any())
    return ids, links.astype(np.int64), ids[root]


def met(rows: DataFrame) -> DataFrame:
    """``node, links, root`` from rows sorted by the groups (label, size, filter, chunks) in which they meet."""
    keys = ["label", "d", "filter", "i", "j"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rest: pa.Table | None = None

        def groups() -> Iterator[pa.Table]:
            nonlocal rest
            for batch in batches:
                now = pa.Table.from_batches([batch])
                now = pa.concat_tables([rest, now]) if rest is not None else now
                columns = [now.column(k).to_numpy() for k in keys]
                new = np.zeros(len(now), dtype=bool)
                for c in columns:
                    new[1:] |= c[1:] != c[:-1]
                starts = np.concatenate([[0], np.flatnonzero(new)])
                for start, stop in zip(starts[:-1], starts[1:]):
                    yield now.slice(start, stop - start)
                rest = now.slice(starts[-1]) if len(now) else None
            if rest is not None and len(rest):
                yield rest

        held, size = [], 0
        for group in groups():
            if len(group) < 2:
                continue
            part = group.combine_chunks()
            filters = part.column("filters").combine_chunks()
            ids, links, roots = chunk_links(
                part.column("node").to_numpy(), part.column("side").to_numpy().astype(bool), part.column("copies").to_numpy().astype(float),
                matrix(part.column("v").combine_chunks()),
                filters.flatten().to_numpy(), np.diff(filters.offsets.to_numpy()), part.column("filter")[0].as_py(),
            )
            full = links > 0
            if full.any():
                held.append((ids[full], links[full], roots[full]))
                size += int(full.sum())
            if size > 20_000:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c)) for c in zip(*held)], names=["node", "links", "root"])
                held, size = [], 0
        if held:
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c)) for c in zip(*held)], names=["node", "links", "root"])

    return rows.mapInArrow(run, "node long, links long, root long")


def near_copies(df: DataFrame, key: str = "vec_id", vector: str = "embedding", label: str = "label") -> DataFrame:
    """``<key>, n_links, component_id, kept`` for each row.

    Rows link if their labels are equal and not null and the cosine of their vectors is at least 0.93. Vectors that are null, zero, or
    hold null or non-finite components link with nothing (labels are of any plain type, keys whole numbers), as do rows without a label or key (these have no component). Vectors of
    different lengths do not link. Rows that repeat a key are one vector with several places: they link one another's partners.
    An empty table gives an empty result.
    """
    rows = df.select(
        quoted(key).cast("long").alias("id"), quoted(label).cast("string").alias("label"),
        F.when(usable(quoted(vector)), quoted(vector)).alias("v"),
    )
    good = rows.where("id is not null and label is not null and v is not null")
    nodes = good.groupBy("label", "v").agg(F.min("id").alias("node"), F.count("*").alias("copies"))
    nodes = written(nodes.withColumn("d", F.size("v")), "nodes")
    placed = written(nodes.join(listed(nodes), "node"), "listed")
    # narrow rows find out which filters have company, and into how many chunks those are cut; vectors join afterwards
    of_filter = placed.select("node", "label", "d", F.explode("filters").alias("filter"))
    counts = of_filter.groupBy("label", "d", "filter").agg(F.count("*").alias("count")).where("count > 1")
    counts = written(counts.withColumn("chunks", F.ceil(F.col("count") / CHUNK).cast("int")).drop("count"), "counts")
    meeting = of_filter.join(counts, ["label", "d", "filter"]).withColumn("chunk", F.pmod(F.xxhash64("node"), F.col("chunks")).cast("int"))
    meeting = meeting.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)))
    meeting = meeting.select(
        "node", "label", "d", "filter", F.least("chunk", "other").alias("i"), F.greatest("chunk", "other").alias("j"),
        (F.col("chunk") > F.col("other")).cast("int").alias("side"),
    ).join(placed.select("node", "copies", "v", "filters"), "node")
    keys = ["label", "d", "filter", "i", "j"]
    found = written(met(meeting.repartition(*keys).sortWithinPartitions(*keys)), "found")
    partners = found.groupBy("node").agg(F.sum("links").alias("links"))
    groups = components(found, "node", "root")
    facts = nodes.select("node", "label", "v", "copies").join(partners, "node", "left").join(groups, "node", "left")
    facts = written(facts.select(
        "label", "v", (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links"), F.coalesce("component", "node").alias("component_id")
    ), "facts")
    result = rows.join(facts, ["label", "v"], "left")
    component = F.coalesce("component_id", "id")
    return result.select(
        F.col("id").alias(key), F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"),
        (F.col("id") == component).alias("kept"),
    )


def op4_embedding_dedup(spark: SparkSession, folder: str) -> DataFrame:
    return near_copies(table(spark, folder, "embeddings"))

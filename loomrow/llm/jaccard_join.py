"""Exact Jaccard join of documents as sets of word shingles, in the metric space of the Jaccard distance.

Two documents link when their distance is at most ``r = 1/4``. The join goes through ever smaller regions:

1. Documents with equal sets (distance 0) become one node.
2. Shingles in one fixed order are the first pivots. A shingle ``s`` of a set ``x`` is nearer to it,
   ``1 - 1/|x|``, than any it lacks (1). A node lies in the region of the first shingles of its own; the window that the
   triangle inequality demands, so that each linked pair meets, are its first ``|x| - ceil(3|x|/4) + 1``
   shingles, and three more, so that it meets four times: the node is replicated to the regions of all of them. Shingles that are
   frequent stand last in the order.
3. In each region the least node is the pivot. The exact distances to it are measured, except between two nodes that meet less often
   and have no other node in their regions. Nodes within ``r`` are its
   ball and linked. Two nodes ``x, y`` link only if ``|d(x, p) - d(y, p)| <= r``, so that a node of the ball meets only nodes
   within ``2 r`` of the pivot.
4. Pairs of a ball and its window, and pairs outside the ball, are compared only where they are not in one component yet: no
   link between different components is lost. Large regions are cut into blocks, and two blocks meet in one task. Sketches
   name the pairs that may link; the nearest that would unite a region are measured first, then what is still apart.

Document pivots alone do not part a corpus: nearly all pairs of documents share nothing, at distance 1 from one another,
hence the first level of shingles.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import mixed, quoted, slices, table, utf8_buffer, written
from .components import components
from .regions import Filter, gathered, may_link, metric_links, near_by_bits, others, rare_first, shares

WORDS = 5
#: linked when ``100 * intersection >= PERCENT * union``
PERCENT = 75
#: regions that two linked sets share; sets that meet by chance share one or two
COMMON = 4
#: each byte of a slice takes some 60 in arrays
SLICE_BYTES = 1 << 19
#: a shingle in so many different documents of one chunk, of so many shingles, is frequent there
FREQUENT, CHUNK_SHINGLES = 3, 4_000_000
#: so many frequent shingles at most stand last in the order: 8 bytes each; which ones does not change the result
MOST_FREQUENT = 1_000_000
#: nodes of a block of a region; all pairs of two blocks are compared in one task
SMALL_REGION = 1000
#: bits of the sketch that bounds the intersection of two sets from above
SKETCH_BITS = 4096

_STEP = np.uint64(0xC2B2AE3D27D4EB4F)


def word_hashes(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """A hash for each word of the texts, A-Z in lower case, and where the words of each text begin and end."""
    data, offsets = utf8_buffer(texts)
    lower = np.where((data >= 65) & (data <= 90), data | 32, data)
    space = (data == 32) | ((data >= 9) & (data <= 13))
    # a boundary before each text, so that words never join across texts
    inside = ~space
    first = np.zeros(len(data) + 1, dtype=bool)
    first[offsets[:-1]] = True
    first = first[: len(data)]
    starts = np.flatnonzero(inside & (first | np.r_[True, space[:-1]])) if len(data) else np.zeros(0, np.int64)
    last = np.zeros(len(data) + 1, dtype=bool)
    last[offsets[1:]] = True
    ends = np.flatnonzero(inside & (last[1:] | np.r_[space[1:], True])) + 1 if len(data) else np.zeros(0, np.int64)
    if not len(starts):
        return np.zeros(0, np.uint64), np.searchsorted(starts, offsets)
    # each letter counts by its place in the word, both mixed together: a polynomial of the letters would give some words one value
    begun = np.zeros(len(data), dtype=np.int64)
    begun[starts] = starts
    place = np.arange(len(data)) - np.maximum.accumulate(begun)
    sums = np.zeros(len(data) + 1, dtype=np.uint64)
    np.cumsum(mixed((place.astype(np.uint64) << np.uint64(8)) + lower.astype(np.uint64) + _STEP), out=sums[1:])
    return mixed(sums[ends] - sums[starts] + (ends - starts).astype(np.uint64)), np.searchsorted(starts, offsets)


def shingle_sets(texts: pa.Array, words: int = WORDS) -> Iterator[np.ndarray]:
    """For each text its sorted distinct shingle hashes; few words make one shingle, none make none."""
    hashes, bounds = word_hashes(texts)
    count = max(len(hashes) - words + 1, 0)
    joined = np.zeros(count, dtype=np.uint64)
    for i in range(words):
        joined = joined * _STEP + hashes[i : i + count]
    joined = mixed(joined)
    for start, stop in zip(bounds[:-1], bounds[1:]):
        if stop - start >= words:
            yield np.unique(joined[start : stop - words + 1])
        elif stop > start:
            value = np.zeros(1, dtype=np.uint64)
            for h in hashes[start:stop]:
                value = value * _STEP + h
            # a short sequence differs from every full shingle, and from those of other lengths
            yield mixed(value + np.uint64(stop - start))
        else:
            yield np.zeros(0, dtype=np.uint64)


def prefix_length(size: int) -> int:
    """Of so many first shingles in one order every linked set has ``COMMON`` among its own, or as many as the two have in common."""
    return min(size - -(-size * PERCENT // 100) + COMMON, size)


def signed(values) -> np.ndarray:
    return np.asarray(values, dtype=np.uint64).view(np.int64)


def node_of(shingles: np.ndarray) -> int:
    """One 64-bit value for a set, as good as unique."""
    total = np.add.reduce(mixed(shingles), dtype=np.uint64) if len(shingles) else np.uint64(0)
    return int(signed(mixed(np.array([total + np.uint64(len(shingles))], dtype=np.uint64)))[0])


def sketch(shingles: np.ndarray) -> bytes:
    """A bit for each shingle; a bit that only one of two sets has stands for a shingle that only it has."""
    bits = np.zeros(SKETCH_BITS, dtype=np.uint8)
    bits[(shingles >> np.uint64(20)) % np.uint64(SKETCH_BITS)] = 1
    return np.packbits(bits).tobytes()


def described(docs: DataFrame, text: str, keep: list[str]) -> DataFrame:
    """``n``, ``node`` and ``sketch`` of each row beside ``keep``; rows of another kind list frequent shingles."""
    fields = ", ".join(f"{docs.schema[c].name} {docs.schema[c].dataType.simpleString()}" for c in keep)
    names = [*keep, "n", "node", "sketch", "frequent", "times"]

    def often(chunk: dict[int, np.ndarray], kinds: list[pa.DataType]) -> Iterator[pa.RecordBatch]:
        values, times = np.unique(np.concatenate(list(chunk.values())), return_counts=True)
        found = np.flatnonzero(times >= FREQUENT)
        if len(found):
            none = [pa.nulls(len(found), kind) for kind in (*kinds, pa.int64(), pa.int64(), pa.binary())]
            facts = [pa.array(signed(values[found])), pa.array(times[found], pa.int64())]
            yield pa.RecordBatch.from_arrays([*none, *facts], names=names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        chunk, size, kinds = {}, 0, []
        for batch in batches:
            texts = batch.column(text)
            for start, stop in slices(texts, SLICE_BYTES):
                sets = list(shingle_sets(texts.slice(start, stop - start)))
                nodes = [node_of(s) for s in sets]
                own = [batch.column(c).slice(start, stop - start) for c in keep]
                kinds = [c.type for c in own]
                none = pa.nulls(stop - start, pa.int64())
                facts = [pa.array([len(s) for s in sets], pa.int64()), pa.array(nodes, pa.int64())]
                sketches = pa.array([sketch(s) for s in sets], pa.binary())
                yield pa.RecordBatch.from_arrays([*own, *facts, sketches, none, none], names=names)
                for node, shingles in zip(nodes, sets):
                    if node not in chunk:
                        chunk[node] = shingles
                        size += len(shingles)
                if size >= CHUNK_SHINGLES:
                    yield from often(chunk, kinds)
                    chunk, size = {}, 0
        if chunk:
            yield from often(chunk, kinds)

    return docs.mapInArrow(run, f"{fields}, n long, node long, sketch binary, frequent long, times long")


def windows(docs: DataFrame, text: str, frequent: np.ndarray, regions: Filter | None = None) -> DataFrame:
    """The regions of each document: ``shingle, node, n`` for the first shingles of its set; only likely ``regions`` if given."""
    last = docs.sparkSession.sparkContext.broadcast(np.sort(frequent.astype(np.int64).view(np.uint64)))

    likely = regions.lookup() if regions else None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        late = last.value
        for batch in batches:
            texts = batch.column(text)
            for start, stop in slices(texts, SLICE_BYTES):
                out, nodes, sizes = [], [], []
                seen = set()
                for shingles in shingle_sets(texts.slice(start, stop - start)):
                    node = node_of(shingles)
                    if node in seen or not len(shingles):
                        continue
                    seen.add(node)
                    first = shingles
                    if len(late):
                        often = late[np.minimum(np.searchsorted(late, shingles), len(late) - 1)] == shingles
                        first = np.concatenate([shingles[~often], shingles[often]])
                    first = first[: prefix_length(len(shingles))]
                    if likely:
                        first = first[likely(first.view(np.int64))]
                    out.append(first)
                    nodes.append(np.full(len(first), node, dtype=np.int64))
                    sizes.append(np.full(len(first), len(shingles), dtype=np.int32))
                if out:
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(signed(np.concatenate(out))), pa.array(np.concatenate(nodes)), pa.array(np.concatenate(sizes))],
                        names=["shingle", "node", "n"],
                    )

    return docs.select(text).mapInArrow(run, "shingle long, node long, n int")


def sets_of(docs: DataFrame, text: str, key: str, wanted: DataFrame) -> DataFrame:
    """``node`` and its sorted shingles, eight bytes each, of the documents whose keys are ``wanted`` (and of few others)."""
    likely = Filter(wanted, "key_hash").lookup()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = likely(batch.column("key_hash").to_numpy())
            texts = batch.column(text).filter(pa.array(keep))
            for start, stop in slices(texts, SLICE_BYTES):
                sets = list(shingle_sets(texts.slice(start, stop - start)))
                yield pa.RecordBatch.from_arrays(
                    [pa.array([node_of(s) for s in sets], pa.int64()), pa.array([s.tobytes() for s in sets], pa.binary())],
                    names=["node", "shingles"],
                )

    return docs.select(F.xxhash64(key).alias("key_hash"), text).mapInArrow(run, "node long, shingles binary")


def near_by_sketch(pairs: DataFrame, nodes: DataFrame) -> DataFrame:
    """Of pairs ``a, b, percent`` those that may share so much of their union: all that do, and few that do not."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x, y = (np.frombuffer(b"".join(batch.column(c).to_pylist()), np.uint8).reshape(-1, SKETCH_BITS // 8) for c in "xy")
            na, nb = batch.column("na").to_numpy(), batch.column("nb").to_numpy()
            only_a = np.bitwise_count(x & ~y).sum(axis=1, dtype=np.int64)
            only_b = np.bitwise_count(y & ~x).sum(axis=1, dtype=np.int64)
            common = np.minimum(na - only_a, nb - only_b)
            keep = 100 * common >= batch.column("percent").to_numpy() * (na + nb - common)
            yield batch.select(["a", "b"]).filter(pa.array(keep))

    left = nodes.select(F.col("node").alias("a"), F.col("n").alias("na"), F.col("sketch").alias("x"))
    right = nodes.select(F.col("node").alias("b"), F.col("n").alias("nb"), F.col("sketch").alias("y"))
    both = pairs.join(left, "a").join(right, "b").where(may_link("na", "nb", F.col("percent")))
    return both.select("a", "b", "percent", "na", "nb", "x", "y").mapInArrow(run, "a long, b long")


def forest(a: np.ndarray, b: np.ndarray, component: np.ndarray) -> np.ndarray:
    """Those of the pairs, in their order, that unite components which the pairs before leave apart."""
    parent = {c: c for c in component.tolist()}

    def find(x: int) -> int:
        while parent[x] != x:
            parent[x] = x = parent[parent[x]]
        return x

    kept = []
    for k, (x, y) in enumerate(zip(component[a].tolist(), component[b].tolist())):
        x, y = find(x), find(y)
        if x != y:
            parent[x] = y
            kept.append(k)
    return np.array(kept, dtype=np.int64)


def near_in_groups(groups: DataFrame, nodes: DataFrame, few: bool) -> DataFrame:
    """The pairs of each group, between components, that their sketches let link; if ``few`` only the nearest that unite its components."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            a, b = [], []
            for node, n, component, zone, bits in zip(*(batch.column(c).to_pylist() for c in ("node", "n", "component", "zone", "sketch"))):
                order = rare_first(np.array(component))
                node, n, component, zone = (np.array(x, dtype=np.int64)[order] for x in (node, n, component, zone))
                bits = np.frombuffer(b"".join(bits), np.uint64).reshape(len(node), -1)[order]
                left, right, share = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)], [np.zeros(0)]
                for i in range(len(node) - 1):
                    near, common = near_by_bits(i, others(i, component, zone), n, bits, PERCENT)
                    left.append(np.full(len(near), i))
                    right.append(near)
                    share.append(common / (n[i] + n[near] - common))
                left, right, share = (np.concatenate(x) for x in (left, right, share))
                if few:
                    best = np.argsort(-share, kind="stable")
                    best = best[forest(left[best], right[best], component)]
                    left, right = left[best], right[best]
                a.append(node[left])
                b.append(node[right])
            if a:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(a)), pa.array(np.concatenate(b))], names=["a", "b"])

    found = gathered(groups, nodes, "sketch").mapInArrow(run, "a long, b long")
    return found.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()


def shared(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """``a, b`` with the sizes of their sets and of the intersection, counted exactly."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            common, left, right = [], [], []
            for x, y in zip(batch.column("x").to_pylist(), batch.column("y").to_pylist()):
                x, y = np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64)
                left.append(len(x))
                right.append(len(y))
                if len(x) > len(y):
                    x, y = y, x
                at = np.minimum(np.searchsorted(y, x), len(y) - 1)
                common.append(int(np.count_nonzero(y[at] == x)))
            yield pa.RecordBatch.from_arrays(
                [batch.column("a"), batch.column("b"), *(pa.array(v, pa.int64()) for v in (left, right, common))],
                names=["a", "b", "na", "nb", "common"],
            )

    both = pairs.join(sets.withColumnsRenamed({"node": "a", "shingles": "x"}), "a").join(
        sets.withColumnsRenamed({"node": "b", "shingles": "y"}), "b"
    )
    return both.select("a", "b", "x", "y").mapInArrow(run, "a long, b long, na long, nb long, common long")


def node_links(docs: DataFrame, nodes: DataFrame, text: str, key: str, frequent: np.ndarray) -> DataFrame:
    """Links ``a, b`` between nodes, enough that their components are those of all linked pairs."""
    regions = windows(docs, text, frequent)
    regions = written(
        regions.groupBy("shingle").agg(F.min("node").alias("low"), F.max("node").alias("high")).where("low <> high").select("shingle"),
        "regions",
    )
    members = windows(docs, text, frequent, Filter(regions, "shingle"))
    members = members.join(regions, "shingle", "left_semi").distinct().withColumnRenamed("shingle", "region")

    def exact(near: DataFrame) -> DataFrame:
        ends = near.select(F.col("a").alias("node")).union(near.select("b")).distinct()
        wanted = written(nodes.join(ends, "node", "left_semi").select(F.xxhash64("rep").alias("key_hash")), "wanted")
        return written(shared(near, written(sets_of(docs, text, key, wanted), "sets")).distinct(), "measured")

    def measure(pairs: DataFrame) -> DataFrame:
        """The exact intersections of those pairs that may share so much, from one document of each node."""
        return exact(written(near_by_sketch(pairs, nodes), "near"))

    def within(groups: DataFrame) -> DataFrame:
        """First the nearest pairs that would unite each group, then what may still link between components."""
        groups = written(groups, "groups")
        first = exact(written(near_in_groups(groups, nodes, few=True), "near"))
        links = first.where(shares(PERCENT)).select("a", "b")
        labels = components(links.union(groups.select("node", "component").distinct()))
        named = groups.drop("component").join(labels, "node", "left").withColumn("component", F.coalesce("component", "node"))
        named = written(named.select("group", "region", "node", "n", "component", "zone"), "groups")
        open_ = named.groupBy("group").agg(F.min("component").alias("low"), F.max("component").alias("high")).where("low <> high").select("group")
        last = near_in_groups(named.join(open_, "group", "left_semi"), nodes, few=False).join(first.select("a", "b"), ["a", "b"], "left_anti")
        return links.union(exact(written(last, "near")).where(shares(PERCENT)).select("a", "b"))

    return metric_links(written(members, "members"), measure, within, PERCENT, SMALL_REGION, COMMON)


def jaccard_groups(docs: DataFrame, text: str = "text", key: str = "doc_id") -> DataFrame:
    """``key, n_shingles, component_id`` for each row of ``docs``.

    A set holds the distinct shingles of five words; fewer words are one shingle, and without words (or with a
    null text) a set is empty and links with nothing. ``component_id`` is the smallest key reachable by links. A row
    without a key links with nothing and has no component; rows of one key are one document. An empty table gives an empty result.
    """
    docs = docs.select(quoted(key).alias("key"), quoted(text).alias("text"))
    info = written(described(docs, "text", ["key"]), "described")
    often = info.where("frequent is not null").groupBy("frequent").agg(F.sum("times").alias("times"))
    frequent = often.orderBy(F.desc("times"), "frequent").limit(MOST_FREQUENT).select("frequent").toPandas()
    rows = info.where("node is not null").select("key", "n", "node")
    keyed = rows.where("key is not null and n > 0")
    nodes = written(
        info.where("key is not null and n > 0").groupBy("node").agg(
            F.min("key").alias("rep"), F.first("n").alias("n"), F.first("sketch").alias("sketch")
        ),
        "nodes",
    )
    links = node_links(docs.where("key is not null"), nodes, "text", "key", frequent["frequent"].to_numpy())
    # a key with several texts joins them
    several = keyed.groupBy("key").agg(F.min("node").alias("a"), F.max("node").alias("z")).where("a <> z")
    links = links.union(keyed.join(several.select("key", "a"), "key").select("a", F.col("node").alias("b")))
    found = components(links)
    named = nodes.select("node", "rep").join(found, "node", "left").withColumn("root", F.coalesce("component", "node"))
    named = written(named.select("node", "root", "rep"), "named")
    least = written(named.groupBy("root").agg(F.min("rep").alias("component_id")), "least")
    named = written(named.join(least, "root").select("node", "component_id"), "groups")
    result = rows.join(named, "node", "left")
    component = F.when(F.col("key").isNull(), None).when(F.col("n") == 0, F.col("key")).otherwise(F.col("component_id"))
    return result.select(F.col("key").alias(key), F.col("n").alias("n_shingles"), component.alias("component_id"))


def without_copies(docs: DataFrame, text: str = "text", key: str = "doc_id") -> DataFrame:
    """The rows of ``docs`` whose key is the smallest of its component, and those without a key."""
    groups = written(jaccard_groups(docs, text, key), "jaccard")
    dropped = groups.where(quoted(key) != F.col("component_id")).select(quoted(key).alias("__dropped")).distinct()
    return docs.join(dropped, quoted(key) == F.col("__dropped"), "left_anti")


def op10_jaccard_join(spark: SparkSession, folder: str) -> DataFrame:
    return jaccard_groups(table(spark, folder, "documents"))

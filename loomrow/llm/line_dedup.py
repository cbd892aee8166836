"""Fuzzy line deduplication by MinHash: signatures of character shingles, banding, exact verification, union-find.

Lines are compared in lower case with their white space run together. Every different line gets a signature of 48 minima
over its shingles of seven characters, cut into twelve bands of four: two lines of similarity 0.8 share a band with a
probability of 0.998. Lines that share a band are compared exactly, region by region (see :mod:`regions`), and what links
forms components by distributed union-find. The first line of each component, by document and place, stays.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import mixed, quoted, slices, table, whole_row, written
from .components import components
from .regions import Filter, gathered, metric_links, near_by_bits, others, rare_first

SHINGLE = 7
#: lines link when 100 * intersection >= PERCENT * union of their shingles
PERCENT = 80
BANDS, ROWS = 12, 4
#: nodes of a block of a region; all pairs of two blocks are compared in one task
SMALL_REGION = 1000
#: lines of a group that are compared without sketches
FEW = 16
#: bits of the sketch that bounds the intersection of two lines from above
SKETCH_BITS = 4096
#: bits of a letter in a packed shingle: seven letters make one whole number
LETTER_BITS = 9
#: letters from which on packed shingles are compared faster than texts
LONG = 128
SLICE_BYTES = 2 << 20
#: characters whose signatures are made at a time, so that they stay in a core's cache
PART = 1 << 16


def normal(line: str) -> str:
    return " ".join(line.lower().split())


def line_key(line: str) -> int:
    """One 64-bit value for a normalised line, as good as unique."""
    value = xxhash.xxh3_64_intdigest(line)
    return value - (1 << 64) if value >> 63 else value


def shingles(line: str) -> set[str]:
    return {line[i : i + SHINGLE] for i in range(max(1, len(line) - SHINGLE + 1))}


def packed(line: str) -> np.ndarray | set[str]:
    """The different shingles of a line: of long ones as sorted whole numbers, seven letters of nine bits each, if no letter is wider."""
    if len(line) < LONG:
        return shingles(line)
    codes = np.frombuffer(line.encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
    if codes.max() >= 1 << LETTER_BITS:
        return shingles(line)
    one = codes.astype(np.uint64)
    two = one[:-1] << np.uint64(LETTER_BITS) | one[1:]
    four = two[:-2] << np.uint64(2 * LETTER_BITS) | two[2:]
    values = np.sort(four[:-3] << np.uint64(3 * LETTER_BITS) | two[4:-1] << np.uint64(LETTER_BITS) | one[6:])
    return values[np.concatenate([[True], values[1:] != values[:-1]])]


def in_common(x: str, y: str, own: np.ndarray | set[str], other: np.ndarray | set[str]) -> int:
    """How many different shingles two lines share, which are ``own`` and ``other`` when :func:`packed`."""
    if isinstance(own, set) or isinstance(other, set):
        own, other = (v if isinstance(v, set) else shingles(line) for line, v in ((x, own), (y, other)))
        return len(own & other)
    both = np.sort(np.concatenate([own, other]))
    return int(np.count_nonzero(both[1:] == both[:-1]))


def windows(lines: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """A hash for each shingle of the lines, and how many each line has (none may be empty)."""
    # short lines are one shingle: padded, they have one window that begins within them
    sizes = np.array([max(len(x) - SHINGLE + 1, 1) for x in lines])
    text = "".join(x if len(x) >= SHINGLE else x.ljust(SHINGLE, "\0") for x in lines)
    codes = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype=np.uint32).astype(np.uint64)
    found = np.zeros(len(codes) - SHINGLE + 1, dtype=np.uint64)
    for i in range(SHINGLE):
        found = found * np.uint64(0x100000001B3) + codes[i : i + len(found)]
    # windows that reach into the next line are left out
    lengths = sizes + SHINGLE - 1
    begins = np.cumsum(lengths) - lengths
    inside = np.arange(sizes.sum()) + np.repeat(begins - (np.cumsum(sizes) - sizes), sizes)
    return mixed(found)[inside], sizes


def bands(lines: list[str]) -> np.ndarray:
    """A row of band hashes for each line (none may be empty)."""
    count = BANDS * ROWS
    seeds = mixed(np.arange(1, 2 * count + 1, dtype=np.uint64))
    flips, factors = seeds[:count].astype(np.uint32), seeds[count:].astype(np.uint32) | np.uint32(1)
    out = np.empty((len(lines), count), dtype=np.uint32)
    start = 0
    while start < len(lines):
        stop, size = start, 0
        while stop < len(lines) and (stop == start or size + len(lines[stop]) <= PART):
            size += len(lines[stop]) + SHINGLE
            stop += 1
        hashes, sizes = windows(lines[start:stop])
        hashes, firsts = (hashes >> np.uint64(32)).astype(np.uint32), np.cumsum(sizes) - sizes
        values = np.empty_like(hashes)
        for k in range(count):
            np.bitwise_xor(hashes, flips[k], out=values)
            np.multiply(values, factors[k], out=values)
            out[start:stop, k] = np.minimum.reduceat(values, firsts)
        start = stop
    joined = np.zeros((len(lines), BANDS), dtype=np.uint64)
    for row in range(ROWS):
        joined = joined * np.uint64(0xC2B2AE3D27D4EB4F) + out[:, row::ROWS]
    return mixed(joined + np.arange(1, BANDS + 1, dtype=np.uint64)).view(np.int64)


def sketches(lines: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """The number of different shingles of each line, and a bit for each of them."""
    bits, sizes = np.zeros((len(lines), SKETCH_BITS), dtype=bool), np.zeros(len(lines), dtype=np.int64)
    for i, line in enumerate(lines):
        hashes = np.unique(windows([line])[0])
        sizes[i] = len(hashes)
        bits[i, hashes % np.uint64(SKETCH_BITS)] = True
    return sizes, np.packbits(bits, axis=1).view(np.uint64)


def text_lines(text: str | None) -> list[str]:
    return text.split("\n") if text else []


def described(docs: DataFrame) -> DataFrame:
    """``key, place, node`` of every line that is not blank, of rows with a key; a line met first in a slice of text has ``bands``."""
    kind = docs.schema["key"].dataType.simpleString()
    names = ["key", "place", "node", "bands"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column("text")
            for start, stop in slices(texts, SLICE_BYTES):
                rows, places, nodes, firsts, lines = [], [], [], [], {}
                for i, text in enumerate(texts.slice(start, stop - start).to_pylist()):
                    for place, line in enumerate(map(normal, text_lines(text))):
                        if line:
                            node = line_key(line)
                            firsts.append(None if node in lines else len(lines))
                            lines.setdefault(node, line)
                            rows.append(start + i)
                            places.append(place)
                            nodes.append(node)
                if lines:
                    values = bands(list(lines.values())).ravel()
                    offsets = pa.array(np.arange(0, len(values) + 1, BANDS), pa.int32())
                    signed = pa.ListArray.from_arrays(offsets, pa.array(values)).take(pa.array(firsts, pa.int64()))
                    keys = batch.column("key").take(pa.array(rows, pa.int64()))
                    yield pa.RecordBatch.from_arrays([keys, pa.array(places, pa.int32()), pa.array(nodes, pa.int64()), signed], names=names)

    return docs.mapInArrow(run, f"key {kind}, place int, node long, bands array<long>")


def spot():
    """One value for a place in a document; the same as :func:`lines_of` finds."""
    return F.xxhash64("key").bitwiseXOR(F.col("place").cast("long")).alias("spot")


def lines_of(docs: DataFrame, found: DataFrame, wanted: DataFrame) -> DataFrame:
    """``node, line`` of the wanted lines, each read where it is found first."""
    first = found.join(wanted, "node", "left_semi").groupBy("node").agg(F.min(F.struct("key", "place")).alias("first"))
    likely = Filter(written(first.select("first.*").select(spot()), "spots"), "spot").lookup()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column("text")
            for start, stop in slices(texts, SLICE_BYTES):
                parts = [text_lines(t) for t in texts.slice(start, stop - start).to_pylist()]
                places = [np.arange(len(p)) for p in parts]
                keys = np.repeat(batch.column("key").slice(start, stop - start).to_numpy(), [len(p) for p in parts])
                keep = np.flatnonzero(likely(keys ^ np.concatenate(places)))
                whole = [line for p in parts for line in p]
                lines = {line_key(line): line for line in (normal(whole[k]) for k in keep) if line}
                yield pa.RecordBatch.from_arrays([pa.array(list(lines), pa.int64()), pa.array(list(lines.values()), pa.string())], names=["node", "line"])

    read = docs.select(F.xxhash64("key").alias("key"), "text").mapInArrow(run, "node long, line string")
    return read.join(wanted, "node", "left_semi").dropDuplicates(["node"])


def compared(pairs: DataFrame, lines: DataFrame) -> DataFrame:
    """``a, b, na, nb, common``: sizes of the shingle sets and of the intersection."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            facts, last, other = [], None, set()
            for x, y in zip(batch.column("x").to_pylist(), batch.column("y").to_pylist()):
                if y != last:  # rows of one b stand together
                    last, other = y, packed(y)
                own = packed(x)
                facts.append((len(own), len(other), in_common(x, y, own, other)))
            columns = [pa.array(c, pa.int64()) for c in (zip(*facts) if facts else ((), (), ()))]
            yield pa.RecordBatch.from_arrays([batch.column("a"), batch.column("b"), *columns], names=["a", "b", "na", "nb", "common"])

    both = pairs.join(lines.select(F.col("node").alias("a"), F.col("line").alias("x")), "a")
    both = both.join(lines.select(F.col("node").alias("b"), F.col("line").alias("y")), "b")
    return both.select("a", "b", "x", "y").mapInArrow(run, "a long, b long, na long, nb long, common long")


def linked_in_groups(groups: DataFrame, lines: DataFrame) -> DataFrame:
    """Links within each group, enough to unite the components that link there: fewer than it has nodes.

    Of the regions that two lines share only the least compares them.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            a, b = [], []
            for region, node, component, zone, texts, shared in zip(*(batch.column(c).to_pylist() for c in names)):
                order = rare_first(np.array(component))
                node, component, zone = (np.array(x)[order] for x in (node, component, zone))
                texts, shared = [texts[k] for k in order], [set(shared[k]) for k in order]
                few = len(node) <= FEW
                sizes, bits = (None, None) if few else sketches(texts)
                known: dict[int, np.ndarray | set[str]] = {}
                for i in range(len(node) - 1):
                    near = others(i, component, zone)
                    if not few:
                        near, _ = near_by_bits(i, near, sizes, bits, PERCENT)
                        known.clear()
                    for j in near.tolist():
                        if component[i] != component[j] and min(shared[i] & shared[j]) == region[0]:
                            for k in (i, j):
                                if k not in known:
                                    known[k] = packed(texts[k])
                            x, y = known[i], known[j] if few else known.pop(j)
                            if 100 * min(len(x), len(y)) < PERCENT * max(len(x), len(y)):
                                continue
                            common = in_common(texts[i], texts[j], x, y)
                            if 100 * common >= PERCENT * (len(x) + len(y) - common):
                                a.append(node[i])
                                b.append(node[j])
                                component[component == component[j]] = component[i]
            yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["a", "b"])

    names = ("region", "node", "component", "zone", "line", "shared")
    groups = written(groups, "groups")
    shared = groups.groupBy("node").agg(F.collect_set("region").alias("shared"))
    return gathered(groups, lines.join(shared, "node"), "line", "shared").mapInArrow(run, "a long, b long")


def line_components(docs: DataFrame, found: DataFrame) -> DataFrame:
    """``node, component`` of the lines that link with another; ``found`` are the lines as :func:`described`."""
    signed = found.where("bands is not null").select("node", "bands")
    banded = signed.select("node", F.explode("bands").alias("region"))
    shared = banded.groupBy("region").agg(F.min("node").alias("low"), F.max("node").alias("high")).where("low <> high").select("region")
    shared = written(shared, "regions")
    likely = Filter(shared, "region").lookup()

    def candidates(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            values = batch.column("bands").flatten().to_numpy()
            keep = likely(values)
            nodes = np.repeat(batch.column("node").to_numpy(), BANDS)[keep]
            yield pa.RecordBatch.from_arrays([pa.array(values[keep]), pa.array(nodes)], names=["region", "node"])

    members = signed.mapInArrow(candidates, "region long, node long").join(shared, "region", "left_semi").distinct()
    # sizes of lines are not known here: all count as equal
    members = written(members.withColumn("n", F.lit(1)), "members")
    lines = written(lines_of(docs, found, written(members.select("node").distinct(), "wanted")), "lines")

    def measure(pairs: DataFrame) -> DataFrame:
        return written(compared(pairs.select("a", "b"), lines), "measured")

    def within(groups: DataFrame) -> DataFrame:
        return linked_in_groups(groups, lines)

    return components(metric_links(members, measure, within, PERCENT, SMALL_REGION))


def dedup_lines(docs: DataFrame, text: str = "text", key: str = "doc_id", counts: bool = True) -> DataFrame:
    """All rows, their text without lines that repeat an earlier one, with ``n_lines`` and ``n_kept`` if ``counts``.

    Of each component of equal or similar lines the first stays, by key and then by place. Blank lines stay and are not
    counted. A row without a key keeps its lines and is compared with none; a null text stays null. Rows of one key are versions of one
    document: the line that stays, stays in all of them. Input columns named like a count are replaced. An empty table
    gives an empty result.
    """
    own = docs.where(quoted(key).isNotNull()).select(quoted(key).alias("key"), quoted(text).alias("text"))
    found = written(described(own), "lines")
    groups = line_components(own, found)
    grouped = found.join(groups, "node", "left").select("key", "place", "node", F.coalesce("component", "node").alias("root"))
    grouped = written(grouped, "grouped")
    first = grouped.groupBy("root").agg(F.min(F.struct("key", "place")).alias("first"), F.count("*").alias("times"))
    first = written(first.where("times > 1").select("root", "first"), "first")
    spare = grouped.join(first, "root").where((F.col("key") != F.col("first.key")) | (F.col("place") != F.col("first.place")))
    spare = spare.select("key", "place", "node").distinct()
    drops = spare.groupBy("key").agg(F.collect_list(F.struct("place", "node")).alias("drops"))
    rest = docs.select(*[quoted(n) for n in docs.columns if n != text])
    packed = docs.select(whole_row(rest).alias("row"), quoted(text).alias("text"), quoted(key).alias("key"))
    marked = packed.join(written(drops, "drops"), "key", "left").select("row", "text", "drops")
    row = marked.schema["row"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column("text")
            for start, stop in slices(texts, SLICE_BYTES):
                size = stop - start
                drops = batch.column("drops").slice(start, size).to_pylist()
                out, lines, kept = [], [], []
                for value, dropped in zip(texts.slice(start, size).to_pylist(), drops):
                    whole, gone = text_lines(value), {d["place"] for d in dropped or ()}
                    before = count = sum(1 for line in whole if line and not line.isspace())
                    if gone:  # rows of one key may have other lines at its places
                        nodes, rest = {(d["place"], d["node"]) for d in dropped}, []
                        for place, line in enumerate(whole):
                            if place not in gone or not (plain := normal(line)) or (place, line_key(plain)) not in nodes:
                                rest.append(line)
                        count -= len(whole) - len(rest)
                        whole = rest
                    out.append(None if value is None else "\n".join(whole))
                    lines.append(before)
                    kept.append(count)
                columns = [pa.array(out, pa.string()), pa.array(lines, pa.int64()), pa.array(kept, pa.int64())]
                yield pa.RecordBatch.from_arrays(
                    [batch.column("row").slice(start, size), *columns], names=["row", "cleaned", "n_lines", "n_kept"]
                )

    result = marked.mapInArrow(run, f"row {row}, cleaned string, n_lines long, n_kept long")
    added = ["n_lines", "n_kept"] if counts else []
    names = [n for n in docs.columns if n.lower() not in added]
    columns = [F.col("cleaned").alias(n) if n == text else F.col("row")[n].alias(n) for n in names]
    return result.select(*columns, *added)


def op1_line_dedup(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents").select("doc_id", "text")
    return dedup_lines(docs).select("doc_id", "n_lines", "n_kept", "text")

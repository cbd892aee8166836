"""Texts as files of token ids: ascending documents, blocks of entropy-coded ids, and the way back.

Documents are dealt out in ranges of their ids, so parts follow one another as the ids do. Each part writes its blocks in order: whole
documents up to about two million ids. A block stands alone: a header lists its documents' ids and lengths and has a checksum of its
own, the ids themselves are coded by :mod:`token_coder`, whose model starts afresh in each block. Blocks are the rows of Parquet files, so
that Spark's commit protocol and any file system apply.
"""

from __future__ import annotations

import json
import os
import struct
import zlib
from array import array
from collections.abc import Callable, Iterator
from itertools import chain, compress

import numpy as np
import pyarrow as pa
import regex
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..session import work_folder
from . import token_coder
from .common import beyond_latin, kept, latin_pattern, quoted, slices, table

TOKENIZER = "byte_bpe_50k.json"
#: a block is closed when it has so many ids
BLOCK_IDS = 1 << 21
SLICE_BYTES = 1 << 20
MEMORY_WORDS = 1_000_000
#: new words beyond Latin that the library encodes at a time
BATCH_WORDS = 10_000
#: how byte-level tokenizers part a text before they merge
WORDS = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+")
PLAIN_WORDS = latin_pattern(WORDS.pattern)
#: magic, documents, bytes of the header's arrays, their checksum
HEADER = "<4sQQI"
MAGIC = b"TIDF"


def byte_letters() -> dict[int, str]:
    """The letter by which byte-level tokenizers write each byte: those that print stand for themselves, the rest follow from U+0100 on."""
    own = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in own]
    return {b: chr(b) for b in own} | {b: chr(256 + i) for i, b in enumerate(rest)}


class Words(dict):
    """The ids of words as 32-bit integers, a fraction of what a list of them takes; a new word is given to ``ask``."""

    def __init__(self, ask: Callable[[str], list[int]]):
        self.ask = ask

    def __missing__(self, word: str) -> bytes:
        found = self[word] = array("I", self.ask(word)).tobytes()
        return found


class Encoder:
    """The library's tokenizer, asked once for each different word."""

    def __init__(self, content: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_str(content)
        self.tokenizer.no_padding()
        self.tokenizer.no_truncation()
        self.size = self.tokenizer.get_vocab_size(with_added_tokens=True)
        self.special = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        # what comes before the library's model leaves a word of a Latin text whole, in byte letters: the model may be asked at once
        parts = json.loads(content)
        before = parts.get("pre_tokenizer") or {}
        kind = (before.get("type"), before.get("add_prefix_space"), before.get("use_regex", True))
        self.direct = not parts.get("normalizer") and kind == ("ByteLevel", False, True)
        self.model, self.letters = self.tokenizer.model, byte_letters()
        self.known = Words(self.merged)

    def merged(self, word: str) -> list[int]:
        return [t.id for t in self.model.tokenize(word.encode().decode("latin-1").translate(self.letters))]

    def encode(self, texts: list[str | None]) -> list[np.ndarray]:
        """The ids of each text; a null text has none."""
        # a special token in a text is one token, and may join words that the pattern parts
        whole = [bool(t) and any(s in t for s in self.special) for t in texts]
        wide = [bool(t) and (not self.direct or bool(beyond_latin(t))) for t in texts]
        words = [[] if w or not t else (WORDS if x else PLAIN_WORDS).findall(t) for t, w, x in zip(texts, whole, wide)]
        if len(self.known) > MEMORY_WORDS:
            self.known.clear()
        new = list(set(chain.from_iterable(compress(words, wide))).difference(self.known))
        # the library's results hold far more than the ids
        for start in range(0, len(new), BATCH_WORDS):
            some = new[start : start + BATCH_WORDS]
            found = self.tokenizer.encode_batch_fast(some, add_special_tokens=False)
            self.known.update(zip(some, (array("I", f.ids).tobytes() for f in found)))
        ids = []
        for text, parts, special in zip(texts, words, whole):
            if special:
                ids.append(np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, dtype=np.uint32))
            else:
                ids.append(np.frombuffer(b"".join(map(self.known.__getitem__, parts)), dtype=np.uint32))
        return ids


def packed(keys: list[int | None], ids: list[np.ndarray], vocabulary: int) -> bytes:
    """One block of documents."""
    numbers = np.array([k or 0 for k in keys], dtype="<i8")
    absent = np.array([k is None for k in keys], dtype=np.uint8)
    lengths = np.array([len(i) for i in ids], dtype="<i8")
    head = zlib.compress(numbers.tobytes() + lengths.tobytes() + absent.tobytes())
    body = token_coder.encode(np.concatenate(ids) if ids else np.zeros(0, np.int64), vocabulary)
    return struct.pack(HEADER, MAGIC, len(keys), len(head), zlib.crc32(head)) + head + body


def unpacked_block(block: bytes) -> tuple[list[int | None], list[np.ndarray]]:
    """The keys and ids of a block's documents."""
    if len(block) < struct.calcsize(HEADER):
        raise ValueError("a block is cut off")
    magic, count, size, checksum = struct.unpack_from(HEADER, block)
    head = block[struct.calcsize(HEADER) : struct.calcsize(HEADER) + size]
    if magic != MAGIC or not size or zlib.crc32(head) != checksum:
        raise ValueError("a block's header does not have its checksum")
    head = zlib.decompress(head)
    numbers = np.frombuffer(head, "<i8", count)
    lengths = np.frombuffer(head, "<i8", count, 8 * count)
    absent = np.frombuffer(head, np.uint8, count, 16 * count)
    ids = token_coder.decode(block[struct.calcsize(HEADER) + size :])
    keys = [None if a else int(n) for n, a in zip(numbers, absent)]
    return keys, np.split(ids, np.cumsum(lengths)[:-1]) if count else []


def write_tokens(docs: DataFrame, path: str, tokenizer: str, key: str = "doc_id", text: str = "text", end: int = 0) -> None:
    """Files of ids in ascending key order, ``end`` after each document.

    Null keys come first; a null text has the end id alone; documents of one key stand next to each other, ordered by their
    texts. A document is never split, so a block holds at least one.
    """
    with open(tokenizer, encoding="utf-8") as file:
        content = file.read()
    shared = docs.sparkSession.sparkContext.broadcast(content)  # of fixed size: the vocabulary file
    rows = docs.select(quoted(key).cast("long").alias("key"), quoted(text).alias("text"))
    ordered = rows.repartitionByRange("key").sortWithinPartitions("key", "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = kept(("ids", zlib.crc32(shared.value.encode())), lambda: Encoder(shared.value))
        part, number = TaskContext.get().partitionId(), 0
        keys: list[int | None] = []
        ids: list[np.ndarray] = []
        total, last = 0, np.array([end], dtype=np.uint32)

        def block() -> pa.RecordBatch:
            columns = [pa.array([part], pa.int32()), pa.array([number], pa.int32()), pa.array([total], pa.int64())]
            return pa.RecordBatch.from_arrays(
                [*columns, pa.array([packed(keys, ids, encoder.size)], pa.binary())], names=["part", "block", "ids", "data"]
            )

        for batch in batches:
            texts = batch.column("text")
            for start, stop in slices(texts, SLICE_BYTES):
                size = stop - start
                for k, found in zip(batch.column("key").slice(start, size).to_pylist(), encoder.encode(texts.slice(start, size).to_pylist())):
                    keys.append(k)
                    ids.append(np.concatenate([found, last]))
                    total += len(found) + 1
                    if total >= BLOCK_IDS:
                        yield block()
                        keys, ids, total, number = [], [], 0, number + 1
        if keys:
            yield block()

    ordered.mapInArrow(run, "part int, block int, ids long, data binary").write.option("compression", "none").parquet(path)


def read_tokens(spark: SparkSession, path: str, tokens: bool = True) -> DataFrame:
    """``doc_id, start, n_tokens, ids_crc32`` of all documents in files of ids, and their ``tokens`` if wanted.

    ``start`` counts the ids of all documents before it. Every checksum is verified.
    """
    blocks = spark.read.schema("part int, block int, ids long, data binary").parquet(path)
    # one row for each part, then one for each block: small numbers, without the data
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    parts = blocks.groupBy("part").agg(F.sum("ids").alias("ids"))
    parts = parts.select("part", F.coalesce(F.sum("ids").over(before), F.lit(0)).alias("of_part"))
    inside = Window.partitionBy("part").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    places = blocks.select("part", "block", F.coalesce(F.sum("ids").over(inside), F.lit(0)).alias("of_block")).join(parts, "part")
    placed = blocks.join(places.select("part", "block", (F.col("of_part") + F.col("of_block")).alias("first")), ["part", "block"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first, data in zip(batch.column("first").to_pylist(), batch.column("data")):
                keys, ids = unpacked_block(data.as_py())
                lengths = np.array([len(i) for i in ids], dtype=np.int64)
                checksums = [zlib.crc32(i.astype("<u4").tobytes()) for i in ids]
                columns = [
                    pa.array(keys, pa.int64()), pa.array(first + np.cumsum(lengths) - lengths), pa.array(lengths), pa.array(checksums, pa.int64())
                ]
                names = ["doc_id", "start", "n_tokens", "ids_crc32"]
                if tokens:
                    columns.append(pa.array([i.astype(np.int32) for i in ids], pa.list_(pa.int32())))
                    names.append("tokens")
                yield pa.RecordBatch.from_arrays(columns, names=names)

    schema = "doc_id long, start long, n_tokens long, ids_crc32 long" + (", tokens array<int>" if tokens else "")
    return placed.select("first", "data").mapInArrow(run, schema)


def op7_token_io(spark: SparkSession, folder: str) -> DataFrame:
    import public_tokenizers

    path = work_folder(spark, "tokens")
    write_tokens(table(spark, folder, "documents"), path, public_tokenizers.path(TOKENIZER))
    return read_tokens(spark, path, tokens=False)

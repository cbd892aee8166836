"""What the operators share: written intermediate tables, slices of Arrow batches, row packing."""

from __future__ import annotations

import re
import sys
from collections.abc import Callable, Iterator, Sequence
from typing import Any

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import work_folder

#: a word: a run of characters other than the six ASCII white-space characters
WORD = r"[^\x20\x09-\x0D]+"


#: Latin letters beyond ASCII that every Unicode version classes as letters
LATIN = r"\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u024f"
#: finds a character that is neither ASCII nor one of these letters
beyond_latin = re.compile(f"[^\\x00-\\x7f{LATIN}]").search


def latin_pattern(pattern: str) -> re.Pattern | None:
    """A word pattern written out for texts of ASCII and Latin letters, which is found several times as fast; None if it cannot be."""
    classes = {r"\p{L}": f"A-Za-z{LATIN}", r"\p{N}": "0-9", r"\s": r"\x09-\x0d\x20"}
    out, inside, at = "", False, 0
    while at < len(pattern):
        name = next((c for c in (*classes, r"\S") if pattern.startswith(c, at)), None)
        step = name or pattern[at]
        if name == r"\S" and not inside:
            out += f"[^{classes[chr(92) + 's']}]"
        elif name in classes:
            out += classes[name] if inside else f"[{classes[name]}]"
        elif step == chr(92) or name or pattern.startswith("(?", at) and not pattern.startswith("(?!", at):
            return None
        else:
            inside = step == "[" or inside and step != "]"
            out += step
        at += len(step)
    return re.compile(out)


def written(df: DataFrame, purpose: str) -> DataFrame:
    """The same rows, written as Parquet to the shared work folder and read again: cuts the lineage."""
    spark = df.sparkSession
    path = work_folder(spark, purpose)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def quoted(name: str) -> Column:
    return F.col("`" + name.replace("`", "``") + "`")


def whole_row(df: DataFrame) -> Column:
    """All columns as one struct, so that working columns cannot clash with them."""
    return F.struct(*[quoted(name) for name in df.columns])


def unpacked(df: DataFrame, packed: str, results: Sequence[str]) -> DataFrame:
    """The columns of a packed row and the results; a result replaces a column of its name."""
    taken = {name.lower() for name in results}
    names = df.schema[packed].dataType.names
    return df.select(
        *[F.col(packed)[name].alias(name) for name in names if name.lower() not in taken], *[quoted(r) for r in results]
    )


def slices(texts: pa.Array, most_bytes: int) -> Iterator[tuple[int, int]]:
    """Ranges of rows that hold about ``most_bytes`` of text together; one row at least."""
    sizes = np.cumsum(np.asarray(pa.compute.binary_length(texts.fill_null("")), dtype=np.int64))
    start = 0
    while start < len(texts):
        before = sizes[start - 1] if start else 0
        stop = max(start + 1, int(np.searchsorted(sizes, before + most_bytes, side="right")))
        yield start, stop
        start = stop


def utf8_buffer(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of all texts in a row, and where each text begins and the last one ends."""
    texts = texts.cast(pa.large_string()).fill_null("")
    offsets = np.frombuffer(texts.buffers()[1], dtype=np.int64, count=len(texts) + 1, offset=8 * texts.offset)
    data = texts.buffers()[2]
    whole = np.frombuffer(data, dtype=np.uint8) if data is not None else np.zeros(0, np.uint8)
    return whole[offsets[0] : offsets[-1]], offsets - offsets[0]


MASK64 = (1 << 64) - 1


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values that spreads them evenly."""
    x = x ^ (x >> np.uint64(32))
    x = x * np.uint64(0xD6E8FEB86659FD93)
    x = x ^ (x >> np.uint64(32))
    x = x * np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(32))


def powers(base: int, count: int) -> np.ndarray:
    """1, base, base squared ... modulo 2 to the 64th."""
    out = np.ones(max(count, 1), dtype=np.uint64)
    done = 1
    while done < count:
        step = np.uint64(pow(base, done, 1 << 64))
        more = min(done, count - done)
        out[done : done + more] = out[:more] * step
        done += more
    return out


def kept(key: object, make: Callable[[], Any]) -> Any:
    """A value made once in each Python process, however many tasks it runs."""
    state = sys.__dict__.setdefault("_loomrow_kept", {})
    if key not in state:
        state[key] = make()
    return state[key]


def forget() -> None:
    """Let go of what other operators keep in this process, which may run their tasks no more."""
    sys.__dict__.pop("_loomrow_kept", None)

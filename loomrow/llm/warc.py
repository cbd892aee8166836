"""Legacy ARC archives to WARC: version-specific header lines and declared lengths in, WARC records out.

An ARC file begins with a version block that says which fields its header lines have; every record is one such line, as many
bytes as the line declares, and a line end. The converter synthesises what WARC wants besides: identifiers (from address, date
and content, so that reruns agree), dates in ISO form, record types, and payload digests; payloads met before become revisits.
Files are written by Spark's text writer: the line end it adds is the last byte of each record.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from hashlib import sha256
from urllib.parse import quote

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import work_folder
from .common import quoted, slices, table, written

#: payloads of fewer bytes are never revisits
LEAST_REVISIT = 100
#: when pages without a date are said to have been fetched
DATE = "20240101000000"
#: field names after the address, for each version of the ARC format
ARC_FIELDS = {
    1: ["ip", "date", "mime", "length"],
    2: ["ip", "date", "mime", "status", "checksum", "location", "offset", "filename", "length"],
}
TITLES = {
    1: "URL IP-address Archive-date Content-type Archive-length",
    2: "URL IP-address Archive-date Content-type Result-code Checksum Location Offset Filename Archive-length",
}
#: the fragment of an address that carries a page's own number
MARK = "#page_id="
BATCH_BYTES = 4 << 20
READ = 1 << 20


def version_block(version: int, name: str) -> bytes:
    body = f"{version} 0 loomrow\n{TITLES[version]}\n".encode()
    middle = "" if version == 1 else "200 - - 0 " + name + " "
    return f"filedesc://{name} 0.0.0.0 {DATE} text/plain {middle}{len(body)}\n".encode() + body + b"\n"


def arc_record(version: int, url: str, payload: bytes, name: str, offset: int) -> bytes:
    middle = "" if version == 1 else f"200 {sha256(payload).hexdigest()} - {offset} {name} "
    return f"{url} 0.0.0.0 {DATE} text/html {middle}{len(payload)}\n".encode() + payload + b"\n"


def write_arc(pages: DataFrame, path: str, key: str = "page_id", url: str = "url", html: str = "html") -> None:
    """One gzipped ARC file for each partition, of version 1 and 2 in turn; a null text is an empty payload."""
    rows = pages.select(quoted(key).cast("string").alias("key"), quoted(url).alias("url"), quoted(html).alias("html"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part = TaskContext.get().partitionId()
        version, name, offset = 1 + part % 2, f"part-{part:05d}.arc", 0
        out = [version_block(version, name)]
        for batch in batches:
            keys, urls, texts = (batch.column(c) for c in ("key", "url", "html"))
            for start, stop in slices(texts, BATCH_BYTES):
                for i in range(start, stop):
                    address = quote(urls[i].as_py() or "unknown:", safe="%/:?#[]@!$&'()*+,;=~") + MARK + quote(keys[i].as_py() or "", safe="")
                    offset += len(out[-1])
                    out.append(arc_record(version, address, (texts[i].as_py() or "").encode(), name, offset))
                yield pa.RecordBatch.from_arrays([pa.array([b"".join(out)[:-1]], pa.binary())], names=["bytes"])
                out = [b""]

    rows.mapInArrow(run, "bytes binary").select(F.col("bytes").cast("string").alias("value")).write.text(path, compression="gzip")


class Reader:
    """Bytes of a gzipped file, taken line by line or by length."""

    def __init__(self, packed: bytes):
        self.packed, self.at = packed, 0
        self.unzip = zlib.decompressobj(wbits=31)
        self.ready, self.start = b"", 0

    def fill(self) -> bool:
        """Unpack some more; false at the end of the file."""
        while True:
            data = self.unzip.decompress(self.unzip.unconsumed_tail or self.packed[self.at : self.at + READ], READ)
            if not self.unzip.unconsumed_tail:
                self.at += READ
            if self.unzip.eof and self.unzip.unused_data:  # files of several members
                self.packed, self.at = self.unzip.unused_data + self.packed[self.at :], 0
                self.unzip = zlib.decompressobj(wbits=31)
            if data:
                self.ready, self.start = self.ready[self.start :] + data, 0
                return True
            if self.at >= len(self.packed) and not self.unzip.unconsumed_tail:
                return False

    def line(self) -> bytes:
        """The next line without its end; empty at the end of the file."""
        while (end := self.ready.find(b"\n", self.start)) < 0:
            if not self.fill():
                rest, self.ready, self.start = self.ready[self.start :], b"", 0
                return rest
        found, self.start = self.ready[self.start : end], end + 1
        return found

    def take(self, length: int) -> bytes:
        parts, missing = [], length
        while missing:
            piece = self.ready[self.start : self.start + missing]
            if not piece and not self.fill():
                raise ValueError(f"{missing} of {length} declared bytes are missing")
            self.start += len(piece)
            parts.append(piece)
            missing -= len(piece)
        return b"".join(parts)

    def ended(self) -> bool:
        return self.start >= len(self.ready) and not self.fill()


def arc_records(packed: bytes) -> Iterator[tuple[dict, bytes]]:
    """Header fields and payload of each record of an ARC file, without its version block."""
    reader = Reader(packed)
    version = 1
    while not reader.ended():
        line = reader.line()
        if not line.strip():
            continue
        if line.startswith(b"filedesc://"):
            body = reader.take(int(line.rsplit(b" ", 1)[1]))
            version = int(body.split(b" ", 1)[0])
            continue
        names = ARC_FIELDS[version]
        address, *fields = line.decode("utf-8", "replace").rsplit(" ", len(names))  # an address may hold blanks
        if len(fields) < len(names):
            raise ValueError(f"fields are missing in the header line {line[:80]!r}")
        header = {"url": address} | dict(zip(names, fields))
        yield header, reader.take(int(header["length"]))


def flushed(rows: Iterator[tuple], kinds: dict[str, pa.DataType], size) -> Iterator[pa.RecordBatch]:
    """Batches of about BATCH_BYTES."""
    held, total = [], 0
    for row in rows:
        held.append(row)
        total += size(row) + 200
        if total >= BATCH_BYTES:
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*held), kinds.values())], names=list(kinds))
            held, total = [], 0
    if held:
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*held), kinds.values())], names=list(kinds))


def files(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.format("binaryFile").option("pathGlobFilter", "*.gz").load(path).select("content")


def read_arc(spark: SparkSession, path: str, payloads: bool = True) -> DataFrame:
    """``url, ip, date, mime, length, digest`` of all ARC records below a folder, and their ``payload`` if wanted."""
    text = dict.fromkeys(("url", "ip", "date", "mime"), pa.string())
    kinds = text | {"length": pa.int64(), "digest": pa.string()} | ({"payload": pa.binary()} if payloads else {})

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
        for batch in batches:
            for packed in batch.column("content"):
                for header, payload in arc_records(packed.as_py()):
                    facts = (*(header[k] for k in text), len(payload), sha256(payload).hexdigest())
                    yield (*facts, payload) if payloads else facts

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from flushed(rows(batches), kinds, lambda row: len(row[-1]) if payloads else 0)

    schema = "url string, ip string, date string, mime string, length long, digest string" + (", payload binary" if payloads else "")
    return files(spark, path).mapInArrow(run, schema)


def page_number(url: Column) -> Column:
    """What follows the last mark of an address, if it is a number."""
    return F.substring_index(url, MARK, -1).try_cast("long")


def address(url: Column) -> Column:
    """What stands before the last mark: an address may hold marks of its own."""
    number = F.substring_index(url, MARK, -1)
    return F.when(F.contains(url, F.lit(MARK)), F.left(url, F.length(url) - F.length(number) - len(MARK))).otherwise(url)


def record_id(url: Column, date: Column, digest: Column) -> Column:
    """A name-based identifier in the form of a UUID."""
    name = F.md5(F.concat_ws(" ", url, date, digest))
    return F.concat(F.lit("<urn:uuid:"), F.regexp_replace(name, "^(.{8})(.{4}).(.{3}).(.{3})(.{12})$", "$1-$2-3$3-8$4-$5"), F.lit(">"))


def iso_date(date: Column) -> Column:
    """14 digits as an ISO date; a date of another form stays as it is."""
    return F.regexp_replace(date, r"^(\d{4})(\d\d)(\d\d)(\d\d)(\d\d)(\d\d)$", "$1-$2-$3T$4:$5:$6Z")


def convert(spark: SparkSession, arcs: str, warcs: str) -> None:
    """WARC files of all records of the ARC files.

    Of records with equal payloads of at least 100 bytes the one with the smallest page number is the response and the others
    revisit it, without a payload of their own but with its digest and length.
    """
    facts = read_arc(spark, arcs, payloads=False)
    page = page_number(F.col("url"))
    first = facts.where(F.col("length") >= LEAST_REVISIT).groupBy("digest").agg(
        F.min(page).alias("first"), F.min(F.struct(page.isNull(), page, "url", "date"))["url"].alias("first_url"),
        F.min(F.struct(page.isNull(), page, "url", "date"))["date"].alias("first_date"), F.count("*").alias("times"),
    )
    first = written(first.where("times > 1 and first is not null"), "first")
    records = read_arc(spark, arcs).withColumn("page", page).join(first, "digest", "left")
    again = F.col("first").isNotNull() & ~F.col("page").eqNullSafe(F.col("first"))
    end = F.lit("\r\n")

    def line(name: str, value: Column) -> Column:
        return F.concat(F.lit(name + ": "), value, end)

    block = F.when(again, F.lit("")).otherwise(F.col("payload").cast("string"))
    header = F.concat(
        F.lit("WARC/1.1\r\n"),
        line("WARC-Type", F.when(again, F.lit("revisit")).otherwise(F.lit("response"))),
        line("WARC-Record-ID", record_id(F.col("url"), F.col("date"), F.col("digest"))),
        line("WARC-Date", iso_date(F.col("date"))),
        line("WARC-Target-URI", address(F.col("url"))),
        line("WARC-IP-Address", F.col("ip")),
        line("WARC-Payload-Digest", F.concat(F.lit("sha256:"), "digest")),
        line("X-Page-ID", F.coalesce(F.col("page").cast("string"), F.lit(""))),
        line("X-Payload-Length", F.col("length").cast("string")),
        F.when(
            again,
            F.concat(
                F.lit("WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest\r\n"),
                line("WARC-Refers-To", record_id(F.col("first_url"), F.col("first_date"), F.col("digest"))),
                line("X-Refers-To-Page", F.col("first").cast("string")),
            ),
        ).otherwise(F.lit("")),
        line("Content-Type", F.col("mime")),
        line("Content-Length", F.when(again, F.lit("0")).otherwise(F.col("length").cast("string"))),
        end,
    )
    records.select(F.concat(header, block, F.lit("\r\n\r")).alias("value")).write.text(warcs, compression="gzip")


def warc_records(packed: bytes) -> Iterator[tuple[dict, bytes]]:
    """Header fields (in lower case) and block of each record of a WARC file."""
    reader = Reader(packed)
    while not reader.ended():
        line = reader.line().rstrip(b"\r")
        if not line:
            continue
        if not line.startswith(b"WARC/"):
            raise ValueError(f"no WARC record begins with {line[:40]!r}")
        header = {}
        while line := reader.line().rstrip(b"\r"):
            name, _, value = line.decode("utf-8", "replace").partition(":")
            header[name.lower()] = value.strip()
        yield header, reader.take(int(header["content-length"]))


def read_warc(spark: SparkSession, path: str) -> DataFrame:
    """``page_id, payload_bytes, payload_digest, record_type, refers_to, url, record_id`` of all records; digests are verified."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
        for batch in batches:
            for packed in batch.column("content"):
                for header, block in warc_records(packed.as_py()):
                    digest = header["warc-payload-digest"].removeprefix("sha256:")
                    revisit = header["warc-type"] == "revisit"
                    if not revisit and sha256(block).hexdigest() != digest:
                        raise ValueError(f"the payload of {header['warc-record-id']} does not have its digest")
                    page, refers = header["x-page-id"], header.get("x-refers-to-page")
                    yield (
                        int(page) if page else None, int(header["x-payload-length"]), digest, header["warc-type"],
                        int(refers) if refers else None, header["warc-target-uri"], header["warc-record-id"],
                    )

    kinds = {
        "page_id": pa.int64(), "payload_bytes": pa.int64(), "payload_digest": pa.string(), "record_type": pa.string(),
        "refers_to": pa.int64(), "url": pa.string(), "record_id": pa.string(),
    }

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from flushed(rows(batches), kinds, lambda row: 100)

    schema = "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long, url string, record_id string"
    return files(spark, path).mapInArrow(run, schema)


def op6_warc(spark: SparkSession, folder: str) -> DataFrame:
    arcs, warcs = work_folder(spark, "arc"), work_folder(spark, "warc")
    write_arc(table(spark, folder, "pages"), arcs)
    convert(spark, arcs, warcs)
    return read_warc(spark, warcs).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


OP6_SQL = """
WITH p AS (
    SELECT page_id, coalesce(strlen(html), 0)::BIGINT AS payload_bytes, sha256(coalesce(html, '')) AS payload_digest FROM pages
), f AS (
    SELECT *, CASE WHEN payload_bytes >= 100 THEN min(page_id) OVER (PARTITION BY payload_digest) ELSE page_id END AS first FROM p
)
SELECT page_id, payload_bytes, payload_digest, CASE WHEN page_id = first THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN page_id <> first THEN first END AS refers_to
FROM f
"""

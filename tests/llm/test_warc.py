"""Archives written, converted and read back."""

import gzip

import pytest

from conformance.check import compare, duck
from loomrow.llm.queries import ORACLES, QUERIES
from loomrow.llm.warc import arc_record, arc_records, convert, read_arc, read_warc, version_block, warc_records, write_arc


def test_query_agrees_with_sql(spark, data):
    assert compare(spark, data, QUERIES["op6_warc"], ORACLES["op6_warc"], duck(data)) == ""


@pytest.mark.parametrize("version", [1, 2])
def test_header_lines_of_both_versions(version):
    payload = b"WARC/1.1\r\n\nfiledesc://x\n" + bytes(range(256))
    data = version_block(version, "x") + arc_record(version, "http://a/b c", payload, "x", 9) + arc_record(version, "u", b"", "x", 10)
    packed = gzip.compress(data[:50]) + gzip.compress(data[50:])
    found = list(arc_records(packed))
    assert [(h["url"], p) for h, p in found] == [("http://a/b c", payload), ("u", b"")]
    with pytest.raises(ValueError, match="missing"):
        list(arc_records(gzip.compress(data[:-20])))


def test_round_trip_with_odd_rows(spark, tmp_path):
    long = "<p>é\r\n\r\nWARC/1.1\n</p>" * 30_000
    same = "x" * 100
    rows = [
        (7, "http://h/ä b\n", same), (3, None, same), (None, "http://n", same), (3, "again", same), (5, "u", "y" * 99), (6, "u", "y" * 99),
        (8, "u", None), (9, "u", ""), (10, "u", long),
    ]
    df = spark.createDataFrame(rows, "page_id long, url string, html string").repartition(3)
    arcs, warcs = str(tmp_path / "arc"), str(tmp_path / "warc")
    write_arc(df, arcs)
    assert read_arc(spark, arcs).count() == len(rows)
    convert(spark, arcs, warcs)
    got = {}
    for r in read_warc(spark, warcs).collect():
        got.setdefault(r.page_id, []).append((r.record_type, r.refers_to, r.payload_bytes))
    assert got[7] == [("revisit", 3, 100)] and got[None] == [("revisit", 3, 100)] and got[3] == [("response", None, 100)] * 2
    assert got[5] == got[6] == [("response", None, 99)] and got[8] == got[9] == [("response", None, 0)]
    assert got[10] == [("response", None, len(long.encode()))]
    texts = [p.read_bytes() for p in (tmp_path / "warc").glob("*.gz")]
    blocks = {h["x-page-id"]: b.decode() for t in texts for h, b in warc_records(t)}
    assert blocks["10"] == long and blocks["7"] == ""
    dates = {h["warc-date"] for t in texts for h, _ in warc_records(t)}
    assert dates == {"2024-01-01T00:00:00Z"}


def test_empty_table(spark, tmp_path):
    df = spark.createDataFrame([], "page_id long, url string, html string")
    write_arc(df, str(tmp_path / "arc"))
    convert(spark, str(tmp_path / "arc"), str(tmp_path / "warc"))
    assert read_warc(spark, str(tmp_path / "warc")).count() == 0


def test_addresses_that_hold_marks(spark, tmp_path):
    rows = [(7, "http://x/#page_id=7/rest", "<a>"), (8, "http://y/", "<b>"), (9, "http://z/#page_id=", "<c>")]
    arcs, warcs = str(tmp_path / "arc"), str(tmp_path / "warc")
    write_arc(spark.createDataFrame(rows, "page_id long, url string, html string"), arcs)
    convert(spark, arcs, warcs)
    assert {r.page_id: r.url for r in read_warc(spark, warcs).collect()} == {p: url for p, url, _ in rows}

"""WARC: exact round trips over segments, revisits and damaged archives."""

import gzip
import hashlib

from eventlake.llm import warc
from eventlake.llm.queries import QUERIES


def test_round_trip(spark, tmp_path):
    big = "é\r\n\r\nWARC/1.1\r\n" * 9000
    html = [(1, "u", big), (2, "u\r\nX: y", big), (3, None, None), (4, "u", ""), (5, "u", "s" * 99), (6, "u", "s" * 99), (7, "u", "t" * 100), (8, "u", "t" * 100), (None, "u", "t" * 100), (9, "u", "dup" * 50), (9, "u", "dup" * 50)]
    pages = spark.createDataFrame([(*h, 1) for h in html], "page_id long, url string, html string, type int").coalesce(2)
    path = str(tmp_path / "w")
    warc.write(pages, path, files=3)
    rows = warc.index(spark, path).collect()
    assert len(rows) == len(html)
    size = {i: len((h or "").encode()) for i, _, h in html}
    sha = {i: hashlib.sha256((h or "").encode()).hexdigest() for i, _, h in html}
    key = lambda r: int(r.page_id) if r.page_id else None
    assert all(r.payload_bytes == size[key(r)] and r.payload_digest == sha[key(r)] for r in rows)
    revisits = sorted((str(key(r)), r.refers_to) for r in rows if r.record_type == "revisit")
    assert revisits == [("2", "1"), ("8", "7"), ("9", "9"), ("None", "7")]
    full = {r.page_id: bytes(r.payload).decode() for r in warc.responses(warc.read_records(spark, path)).collect()}
    assert full["1"] == big and full["3"] == ""


def test_damaged(spark, tmp_path):
    recs = warc.records_of("1", 0, "u", b"x" * 100_000, hashlib.sha256(b"x" * 100_000).hexdigest(), None, "d")
    assert len(recs) > 2
    end = b"\r\n\r\n"
    (tmp_path / "a").mkdir()
    (tmp_path / "a" / "gap.warc").write_bytes(end.join([recs[0], *recs[2:]]) + end)
    (tmp_path / "a" / "cut.warc.gz").write_bytes(gzip.compress(warc.records_of("2", 1, None, b"abc", "00", None, "d")[0][:-2]))
    records = warc.read_records(spark, str(tmp_path / "a"))
    assert records.filter("type = 'damaged'").count() == 1
    assert [(r.page_id, r.complete, r.payload) for r in warc.responses(records).collect()] == [("1", False, None)]


def test_framing_and_empty(spark, tmp_path):
    for n in (0, 1, warc.CHUNK, warc.CHUNK + 1):
        assert warc.unchunked(warc.chunked(b"z" * n)) == b"z" * n
    assert warc.unchunked(b"5\r\nabc") is None and warc.unchunked(b"") is None and warc.unchunked(b"zz\r\n") is None
    pages = spark.createDataFrame([], "page_id long, url string, html string")
    warc.write(pages, str(tmp_path / "e"))
    assert warc.index(spark, str(tmp_path / "e")).count() == 0


def test_query_with_null_ids(spark, tmp_path):
    rows = [(None, "u", "a" * 100), (None, "u", "a" * 100), (5, "u", "b" * 100), (None, None, "b" * 100), (6, "u", None), (7, "u", "a" * 99)]
    spark.createDataFrame(rows, "page_id long, url string, html string").write.parquet(str(tmp_path / "pages.parquet"))
    got = QUERIES["op2_warc"](spark, str(tmp_path)).collect()
    assert sorted((str(r.page_id), r.record_type, str(r.refers_to), r.payload_bytes) for r in got) == [
        ("5", "response", "None", 100), ("6", "response", "None", 0), ("7", "response", "None", 99),
        ("None", "response", "None", 100), ("None", "revisit", "5", 100), ("None", "revisit", "None", 100),
    ]

"""WARC archives: pages to records with revisits and segments, and back by reassembly.

Writing: the payload is sent as an HTTP response in chunked framing. A block longer than a segment becomes a first record
and continuation records that name their origin; the last one states the total length. Of records with equal payloads of
`MIN_REVISIT` bytes or more, that with the smallest page id is the response and the others are revisits without payload.
Spark's text writer lays down the records, with the end-of-record mark as its line separator, as gzip files.

Reading: archives are parsed record by record; continuation records are grouped by the id of their origin, put in order of
segment number, checked for gaps and for the total length, and the chunked framing is decoded.

Defined results: a null html is an empty payload, a null url leaves the target out; page ids may be null (they count as
largest) and repeat: of equal ids exactly one is the response. A record with a missing segment, a wrong total or broken
framing has payload null and complete false. Pages should be a stored table: a row's number in it makes record ids unique.
"""

from __future__ import annotations

import gzip
import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from eventlake.llm.common import stored

MIN_REVISIT = 100
SEGMENT = 32_768
CHUNK = 8_192
END = "\r\n\r\n"
RECORD = (
    "record_id string, type string, page_id string, origin string, number int, total long, digest string, "
    "refers_to string, url string, block binary"
)


def chunked(payload: bytes, size: int = CHUNK) -> bytes:
    parts = [b"%x\r\n%b\r\n" % (len(payload[i : i + size]), payload[i : i + size]) for i in range(0, len(payload), size)]
    return b"".join(parts) + b"0\r\n\r\n"


def unchunked(body: bytes) -> bytes | None:
    """Payload of a chunked body; None if the framing is broken."""
    out, at = [], 0
    while True:
        eol = body.find(b"\r\n", at)
        if eol < 0:
            return None
        try:
            n = int(body[at:eol].split(b";")[0], 16)
        except ValueError:
            return None
        at = eol + 2
        if n == 0:
            return b"".join(out) if body.endswith(b"\r\n") else None
        if n < 0 or body[at + n : at + n + 2] != b"\r\n":
            return None
        out.append(body[at : at + n])
        at += n + 2


def _record(headers: list[tuple[str, str]], block: bytes) -> bytes:
    lines = ["WARC/1.1", *(f"{k}: {v}" for k, v in headers), f"Content-Length: {len(block)}"]
    return "\r\n".join(lines).encode() + b"\r\n\r\n" + block


def records_of(page: str, row: int, url: str | None, payload: bytes, digest: str, refers: str | None, date: str) -> list[bytes]:
    """The WARC records of a page, without the mark that ends each."""
    own = f"<urn:eventlake:page:{page}:{row}>"
    head = [("WARC-Date", date), ("WARC-Payload-Digest", f"sha256:{digest}")]
    if url is not None:
        head.append(("WARC-Target-URI", " ".join(url.split())))
    if refers is not None:
        block = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n\r\n"
        profile = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
        named = [("WARC-Type", "revisit"), ("WARC-Record-ID", own), ("WARC-Refers-To", refers), ("WARC-Profile", profile)]
        return [_record(named + head, block)]
    block = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nTransfer-Encoding: chunked\r\n\r\n" + chunked(payload)
    first = [("WARC-Type", "response"), ("WARC-Record-ID", own), *head]
    cuts = [block[i : i + SEGMENT] for i in range(0, len(block), SEGMENT)]
    if len(cuts) == 1:
        return [_record(first, block)]
    out = [_record([*first, ("WARC-Segment-Number", "1")], cuts[0])]
    for i, cut in enumerate(cuts[1:], 2):
        more = [("WARC-Type", "continuation"), ("WARC-Record-ID", f"{own[:-1]}:{i}>"), ("WARC-Date", date)]
        more += [("WARC-Segment-Origin-ID", own), ("WARC-Segment-Number", str(i))]
        if i == len(cuts):
            more.append(("WARC-Segment-Total-Length", str(len(block))))
        out.append(_record(more, cut))
    return out


def write(pages: DataFrame, path: str, date: str = "2024-01-01T00:00:00Z", files: int = 2_000) -> None:
    """Write pages (page_id, url, html) as archives of at most `files` records each."""
    rows = pages.select(
        F.monotonically_increasing_id().alias("row"),
        F.col("page_id").cast("string").alias("page"),
        F.struct(F.col("page_id").isNull(), "page_id", F.monotonically_increasing_id()).alias("rank"),
        F.col("url").cast("string").alias("url"),
        F.coalesce(F.col("html").cast("string"), F.lit("")).cast("binary").alias("payload"),
    ).withColumn("digest", F.sha2("payload", 256))
    first = F.min(F.struct("rank", "page", "row")).alias("first")
    again = rows.filter(F.octet_length("payload") >= MIN_REVISIT).groupBy("digest").agg(first, F.count("*").alias("n"))
    again = again.filter("n > 1").select(F.col("digest").alias("d"), F.col("first.page").alias("to_page"), F.col("first.row").alias("to_row"))
    to = F.concat(F.lit("<urn:eventlake:page:"), F.coalesce("to_page", F.lit("")), F.lit(":"), F.col("to_row").cast("string"), F.lit(">"))
    refers = F.when(F.col("to_row").isNotNull() & (F.col("to_row") != F.col("row")), to)
    # a payload with copies without number: the skewed side of this join is split by the adaptive planner
    marked = rows.join(again, F.col("digest") == F.col("d"), "left").withColumn("refers", refers)
    marked = marked.select("row", "page", "url", F.when(F.col("refers").isNull(), F.col("payload")).alias("payload"), "digest", "refers")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out: list[bytes] = []
            for row, page, url, payload, digest, ref in zip(*(c.to_pylist() for c in b.columns)):
                out += records_of(page or "", row, url, payload or b"", digest, ref, date)
            yield pa.RecordBatch.from_arrays([pa.array(out, pa.binary())], ["value"])

    lines = marked.mapInArrow(run, "value binary").select(F.col("value").cast("string"))
    lines.write.option("lineSep", END).option("compression", "gzip").option("maxRecordsPerFile", files).text(path)


def parse(data: bytes) -> Iterator[tuple]:
    """Records of an archive, as RECORD has them; a damaged one ends it."""
    at = 0
    while at < len(data):
        end = data.find(b"\r\n\r\n", at)
        lines = data[at : max(end, at)].decode("utf-8", "replace").split("\r\n")
        h = {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in lines[1:])}
        n = h.get("content-length", "")
        if end < 0 or not lines[0].startswith("WARC/") or not n.isdigit() or end + 4 + int(n) > len(data):
            yield (None, "damaged", None, None, None, None, None, None, None, data[at : at + 1024])
            return
        block = data[end + 4 : end + 4 + int(n)]
        own = h.get("warc-record-id")
        page = own.split(":")[3] if own and own.startswith("<urn:eventlake:page:") else None
        number, total = h.get("warc-segment-number"), h.get("warc-segment-total-length")
        yield (
            own, h.get("warc-type"), page, h.get("warc-segment-origin-id"), int(number) if number else None, int(total) if total else None,
            (h.get("warc-payload-digest") or "").removeprefix("sha256:") or None, h.get("warc-refers-to"), h.get("warc-target-uri"), block,
        )
        at = end + 4 + int(n)
        while data[at : at + 2] == b"\r\n":
            at += 2


def read_records(spark: SparkSession, path: str, batch: int = 256) -> DataFrame:
    """All records of the archives in a folder."""
    kinds = [pa.string()] * 4 + [pa.int32(), pa.int64()] + [pa.string()] * 3 + [pa.binary()]
    names = [x.split()[0] for x in RECORD.split(", ")]

    def emit(rows: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i in range(b.num_rows):
                data = b.column(0)[i].as_py()
                data = gzip.decompress(data) if data[:2] == b"\x1f\x8b" else data
                rows = []
                for r in parse(data):
                    rows.append(r)
                    if len(rows) >= batch:
                        yield emit(rows)
                        rows = []
                if rows:
                    yield emit(rows)

    return spark.read.format("binaryFile").load(path).select("content").mapInArrow(run, RECORD)


def responses(records: DataFrame) -> DataFrame:
    """Responses with their decoded payload: segments of one origin in order, without a gap, of the stated length."""
    own = F.coalesce("origin", "record_id").alias("record_id")
    parts = records.filter(F.col("number").isNotNull() & F.col("type").isin("response", "continuation"))
    head = F.struct("page_id", "digest", "url")
    grouped = parts.groupBy(own).agg(
        F.max(F.when(F.col("number") == 1, head)).alias("head"),
        F.array_sort(F.collect_list(F.struct("number", "block"))).alias("parts"),
        F.max("total").alias("total"),
    )
    tied = grouped.select("record_id", "head.*", "parts", "total").filter(F.col("page_id").isNotNull())
    alone = records.filter(F.col("number").isNull() & (F.col("type") == "response"))
    one = F.array(F.struct(F.lit(1).alias("number"), "block"))
    alone = alone.select("record_id", "page_id", "digest", "url", one.alias("parts"), F.octet_length("block").cast("long").alias("total"))
    both = alone.unionByName(tied)
    numbers = F.transform("parts", lambda p: p.number)
    length = F.aggregate("parts", F.lit(0).cast("long"), lambda n, p: n + F.octet_length(p.block))
    fits = (numbers == F.sequence(F.lit(1), F.size("parts"))) & (length == F.col("total"))
    blocks = F.when(F.coalesce(fits, F.lit(False)), F.transform("parts", lambda p: p.block))
    both = both.select("record_id", "page_id", "digest", "url", blocks.alias("blocks"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            payloads, ok = [], []
            for stated, blocks in zip(b.column(2).to_pylist(), b.column(4).to_pylist()):
                head, _, body = b"".join(blocks or []).partition(b"\r\n\r\n")
                payload = unchunked(body) if b"chunked" in head.lower() else body if blocks else None
                good = payload is not None and (stated is None or hashlib.sha256(payload).hexdigest() == stated)
                payloads.append(payload if good else None)
                ok.append(good)
            cols = [*b.columns[:4], pa.array(payloads, pa.binary()), pa.array(ok)]
            yield pa.RecordBatch.from_arrays(cols, [*b.schema.names[:4], "payload", "complete"])

    return both.mapInArrow(run, "record_id string, page_id string, digest string, url string, payload binary, complete boolean")


def revisits(records: DataFrame) -> DataFrame:
    page = F.split("refers_to", ":")[3]
    return records.filter(F.col("type") == "revisit").select("record_id", "page_id", "digest", "url", "refers_to", page.alias("refers_page"))


def index(spark: SparkSession, path: str) -> DataFrame:
    """One row per page of the archives: size and digest of its payload, and the page it revisits.

    A revisit takes both from the response it names; they stay null where that one is missing or its digest differs.
    """
    records = read_records(spark, path)
    full = responses(records)
    size, digest = F.octet_length("payload").cast("long"), F.sha2("payload", 256)
    first = stored(full.select("record_id", "page_id", size.alias("payload_bytes"), digest.alias("payload_digest")))
    again = revisits(records)
    named = first.select(F.col("record_id").alias("to"), "payload_bytes", "payload_digest")
    on = (F.col("refers_to") == F.col("to")) & (F.col("digest") == F.col("payload_digest"))
    again = again.join(named, on, "left").select("page_id", "payload_bytes", "payload_digest", F.lit("revisit").alias("record_type"), F.col("refers_page").alias("refers_to"))
    out = first.select("page_id", "payload_bytes", "payload_digest", F.lit("response").alias("record_type"), F.lit(None).cast("string").alias("refers_to"))
    return out.unionByName(again)

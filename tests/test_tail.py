"""Tailing growing files: held-back ends, pieces, cut files."""

import os

from pyspark.sql import functions as F

from eventlake.sources import tail


def test_append_then_finish(spark, tmp_path):
    logs, out = tmp_path / "logs", str(tmp_path / "out")
    (logs / "in").mkdir(parents=True)
    a, b = logs / "a.log", logs / "in" / "b.log"
    a.write_bytes(b"one\r\ntwo\nhalf")
    b.write_bytes(b"")
    (logs / "_draft").write_bytes(b"no\n")

    def run():
        stream = tail.tailed_lines(spark, str(logs)).select(F.col("raw").cast("binary").alias("raw"), "peer")
        query = stream.writeStream.format("parquet").option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True)
        query.start(out).awaitTermination(60)
        return sorted((bytes(r.raw), os.path.basename(r.peer)) for r in spark.read.parquet(out).collect())

    first = [(b"one", "a.log"), (b"two", "a.log")]
    assert run() == first
    # nothing new, then the line is finished, bytes are no text, and another file gets its first line
    assert run() == first
    with a.open("ab") as f:
        f.write(b" line\n\xff\x00\n\nopen")
    b.write_bytes(b"first\n")
    second = sorted([*first, (b"half line", "a.log"), (b"\xff\x00", "a.log"), (b"", "a.log"), (b"first", "b.log")])
    assert run() == second
    # a cut file starts anew
    a.write_bytes(b"again\n")
    assert run() == sorted([*second, (b"again", "a.log")])


def test_pieces_hold_each_line_once(tmp_path, monkeypatch):
    data = b"".join(b"%d" % i * (i % 40) + b"\n" for i in range(400)) + b"open"
    (tmp_path / "x.log").write_bytes(data)
    reader = tail.TailReader(str(tmp_path))
    whole = data[: data.rfind(b"\n")].split(b"\n")
    for size in (1, 7, 100, 10_000, 1 << 20):
        monkeypatch.setattr(tail, "PIECE", size)
        monkeypatch.setattr(tail, "BLOCK", max(2, size // 3))
        monkeypatch.setattr(tail, "ROWS", 50)
        pieces = reader.partitions({}, reader.latestOffset())
        assert [x.as_py() for p in pieces for b in reader.read(p) for x in b.column(0)] == whole
        # a range that begins inside the file
        start = data.index(b"\n") + 1
        pieces = reader.partitions({str(tmp_path / "x.log"): start}, reader.latestOffset())
        assert [x.as_py() for p in pieces for b in reader.read(p) for x in b.column(0)] == whole[1:]

"""Streams give what the batch transform gives."""

import hashlib
import time
from datetime import datetime, timezone

import pytest

from eventlake.plans import dlq
from eventlake.plans.process import Context, process
from eventlake.sources import commits, readers
from eventlake.sources.packs import load_packs
from eventlake.streaming import jobs

NOW = datetime(2026, 9, 8, tzinfo=timezone.utc)
SCHEMA = "event_id string, raw string, received_at long"
KV = '<189>devname="f" type="traffic" eventtime=1788789731 srcip=8.8.8.{n} srcport=1 dstip=10.0.0.1 dstport=443 action="deny" proto=6 sentbyte=1 rcvdbyte=2'


def context():
    # one pack keeps the plan of each micro-batch small
    return Context(packs=load_packs().only("fortinet.fortigate.traffic"), now=NOW)


def put(spark, path, rows, schema=SCHEMA):
    spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").json(str(path))


def test_batch_and_stream_agree(spark, tmp_path):
    rows = [(f"e{i}", KV.format(n=i) if i % 3 else "junk", 1788789740000000000) for i in range(9)]
    put(spark, tmp_path / "in", rows)
    stream = spark.readStream.schema(SCHEMA).json(str(tmp_path / "in"))
    root = str(tmp_path / "out")
    job = jobs.run_events(jobs.dedupe(stream), context, root, str(tmp_path / "cp"))
    job.start().awaitTermination(120)
    want = process(spark.createDataFrame(rows, SCHEMA), context())
    cols = ["event_id", "event_action", "src_ip", "quality_score"]
    got = jobs.committed(spark, root, "lake")
    assert sorted(map(tuple, got.select(*cols).collect()), key=str) == sorted(map(tuple, want.select(*cols).collect()), key=str)
    bad = sorted(r.event_id for r in want.filter("size(violations) > 0").collect())
    assert sorted(r.event_id for r in jobs.committed(spark, root, "dlq").collect()) == bad and "e0" in bad
    assert jobs.live_table(spark, root).count() == 9
    # a redelivered batch adds nothing
    put(spark, tmp_path / "in", rows[:4])
    job.start().awaitTermination(120)
    assert jobs.committed(spark, root, "lake").count() == jobs.live_table(spark, root).count() == 9


def test_killed_batch_is_invisible_and_replayed_once(spark, tmp_path):
    rows = [(f"e{i}", KV.format(n=i) if i else "junk", 1788789740000000000) for i in range(4)]
    put(spark, tmp_path / "in", rows)
    stream = spark.readStream.schema(SCHEMA).json(str(tmp_path / "in"))
    root = str(tmp_path / "out")
    alive = []

    def sink(df):
        alive.append(df.count())

    killed = jobs.run_events(stream, context, root, str(tmp_path / "cp"), extra={"x": sink})
    real = commits.commit

    def crash(*_):
        raise OSError("killed before the commit")

    commits.commit = crash
    try:
        query = killed.start()
        with pytest.raises(Exception, match="killed"):
            query.awaitTermination(120)
    finally:
        commits.commit = real
    # all legs are on disk, and none of them shows
    assert jobs.committed(spark, root, "lake") is None and jobs.live_table(spark, root) is None
    killed.start().awaitTermination(120)
    bad = process(spark.createDataFrame(rows, SCHEMA), context()).filter("size(violations) > 0").count()
    for leg, n in (("lake", 4), ("dlq", bad), ("live", 4)):
        assert jobs.committed(spark, root, leg).count() == n, leg
    # the same events in a later batch: the lake keeps both deliveries apart by batch, the live table shows one row each
    put(spark, tmp_path / "in", rows[:2])
    killed.start().awaitTermination(120)
    assert jobs.live_table(spark, root).count() == 4 and alive == [4, 4, 2]


def test_references_wait_for_late_payloads(spark, tmp_path):
    def ref(i, seg, at):
        raw = f"payload {i}"
        return (f"e{i}", seg, i, len(raw), hashlib.sha256(raw.encode()).hexdigest(), at)

    def stored(*ids):
        seg = {0: "s1", 1: "s2", 2: "s3", 3: "s3", 4: "s2", 5: "s4"}
        return spark.createDataFrame([(seg[i], i, f"payload {i}") for i in ids], "raw_segment_id string, raw_offset long, raw string")

    out, root = str(tmp_path / "ready"), str(tmp_path / "state")
    have, now = [(0,)], [100]

    def deliver(df, version):
        df.select("event_id", "payload").write.mode("overwrite").parquet(f"{out}/v={version}")

    def ready():
        return sorted(tuple(r) for r in spark.read.parquet(out).select("event_id", "payload").collect())

    names = lambda df: sorted(r.event_id for r in df.collect())
    put(spark, tmp_path / "in", [ref(0, "s1", 90), ref(1, "s2", 90), ref(2, "s3", 20), ref(3, "s3", 95)], jobs.REF)
    stream = spark.readStream.schema(jobs.REF).json(str(tmp_path / "in"))
    job = jobs.run_refs(stream, lambda: stored(*have[0]), root, str(tmp_path / "cp"), deliver, lambda: now[0], 100)
    assert not jobs.redrive_refs(stored(0), root, deliver, 100, 100)
    job.start().awaitTermination(120)
    assert ready() == [("e0", "payload 0")] and names(jobs.waiting_refs(spark, root)) == ["e1", "e2", "e3"]
    # the payload of s2 arrives late, and no new reference comes
    assert jobs.redrive_refs(stored(0, 1), root, deliver, 110, 100)
    assert ready() == [("e0", "payload 0"), ("e1", "payload 1")] and names(jobs.waiting_refs(spark, root)) == ["e2", "e3"]
    # past the deadline of one reference its whole segment is given up, a fresh one of it as well
    put(spark, tmp_path / "in", [ref(4, "s2", 125), ref(5, "s4", 125)], jobs.REF)
    have[0], now[0] = (0, 1, 4), 130
    job.start().awaitTermination(120)
    assert names(jobs.waiting_refs(spark, root)) == ["e5"] and names(jobs.given_up_refs(spark, root)) == ["e2", "e3"]
    put(spark, tmp_path / "in", [("e6", "s3", 2, 9, "x", 129)], jobs.REF)
    have[0] = (0, 1, 2, 3, 4, 5)
    job.start().awaitTermination(120)
    assert ready() == [(f"e{i}", f"payload {i}") for i in (0, 1, 4, 5)]
    assert names(jobs.given_up_refs(spark, root)) == ["e2", "e3", "e6"] and jobs.waiting_refs(spark, root).count() == 0


def test_dead_letters_are_merged_by_bucket(spark, tmp_path):
    schema = "event_id string, raw_segment_id string, raw_offset long, raw_length long, raw_sha256 string, dlq_reasons array<string>, lineage_parser_id string, event_ingested_at long"

    def batch(*rows):
        return spark.createDataFrame([(i, "s", 0, 1, "x", [why], "p", at * 10**9) for i, why, at in rows], schema)

    path = str(tmp_path / "dlq")
    kind = dlq.entries(batch(("a", "r", 1))).schema
    seen = lambda: {r.event_id: r.reason for r in dlq.table(spark, path, kind).collect()}
    assert seen() == {}
    dlq.merge_batch(batch(*[(f"e{i}", "bad_ip", 5) for i in range(40)]), path, 0, buckets=8)
    # an older copy loses, a newer one wins, a redelivered one changes nothing, and only their buckets are rewritten
    late = batch(("e1", "old", 4), ("e2", "new", 6), ("e3", "bad_ip", 5), ("e3", "bad_ip", 5))
    assert dlq.merge_batch(late, path, 1) <= 3
    want = {f"e{i}": "bad_ip" for i in range(40)} | {"e2": "new"}
    assert seen() == want
    # the same batch again, and a batch whose data was written but never committed
    assert dlq.merge_batch(late, path, 1) <= 3 and seen() == want
    real, commits.commit = commits.commit, lambda *_: 1 / 0
    try:
        with pytest.raises(ZeroDivisionError):
            dlq.merge_batch(batch(("e9", "lost", 9)), path, 2)
    finally:
        commits.commit = real
    assert seen() == want
    dlq.merge_batch(batch(("e9", "lost", 9)), path, 2)
    assert seen() == want | {"e9": "lost"} and dlq.merge_batch(batch(), path, 3) == 0 and len(seen()) == 40


def test_multiline_state(spark, tmp_path):
    schema = "source string, line_no long, line string"
    put(spark, tmp_path / "in", [("a", 0, "START 1"), ("a", 1, " x"), ("a", 2, "START 2"), ("a", 3, " y"), ("a", 4, "START 3")], schema)
    stream = spark.readStream.schema(schema).json(str(tmp_path / "in"))
    q = jobs.multiline(stream, "^START").writeStream.format("memory").queryName("ml").outputMode("append")
    # the idle timeout keeps running empty batches, so wait for the rows and stop
    q = q.option("checkpointLocation", str(tmp_path / "cp")).start()
    for _ in range(60):
        if spark.table("ml").count() == 2:
            break
        time.sleep(0.5)
    q.stop()
    assert sorted(r.payload for r in spark.table("ml").collect()) == ["START 1\n x", "START 2\n y"]


def test_throughput_window_stream(spark, tmp_path):
    schema = "event_ts timestamp"
    put(spark, tmp_path / "in", [(datetime(2026, 1, 1, 0, 0, s, tzinfo=timezone.utc),) for s in range(9)], schema)
    stream = spark.readStream.schema(schema).json(str(tmp_path / "in")).withWatermark("event_ts", "2 minutes")
    q = jobs.throughput(stream).writeStream.format("memory").queryName("tp").outputMode("complete").trigger(availableNow=True)
    q.option("checkpointLocation", str(tmp_path / "cp")).start().awaitTermination(120)
    assert [r.events for r in spark.table("tp").orderBy("start").collect()] == [3, 3, 3]


def test_raw_ref_rejects_are_kept(spark):
    df = spark.createDataFrame([('{"event_id":"e","ref":{"segment_id":"s","offset":1,"length":2,"sha256":"x"}}',), ("nope",), ("{}",)], "value string")
    good, bad = readers.raw_ref_messages(df)
    assert good.count() == 1 and bad.count() == 2 and good.first().raw_offset == 1


def test_quality_alerts_once_per_window(spark, tmp_path):
    schema = "lineage_parser_id string, event_observed_at long, quality_score double"
    minute = 60 * 10**9
    root = str(tmp_path / "alerts")
    rows = {"a": [0.9, 0.9, 0.6, 0.6, 0.5, 0.9], "b": [0.5, 0.49, 0.6, 0.2, 0.2, 0.2]}

    def run(*windows):
        put(spark, tmp_path / "in", [(p, (15 * w + m) * minute, q[w]) for p, q in rows.items() for w in windows for m in (1, 9)], schema)
        stream = spark.readStream.schema(schema).json(str(tmp_path / "in"))
        jobs.watch_quality(stream, root, str(tmp_path / "cp"), delay="1 minute").start().awaitTermination(120)
        return sorted((r.lineage_parser_id, int(r.start.timestamp()) // 900, r.quality, r.previous) for r in jobs.quality_alerts(spark, root).collect())

    # the last window stays open until later events close it
    assert run(0, 1, 2) == []
    assert run(3) == [("a", 2, 0.6, 0.9)]
    assert run(4, 5) == [("a", 2, 0.6, 0.9), ("a", 4, 0.5, 0.6), ("b", 3, 0.2, 0.6)]

"""Merkle trees, segments, framing."""

import hashlib
import random
import re

import pytest
from pyspark.sql import functions as F

from eventlake.functions import merkle
from eventlake.operators import integrity
from eventlake.sources import readers
from eventlake.operators.framing import join_lines


def tree_root(leaves):
    level = [bytes.fromhex(x) for x in leaves]
    while len(level) > 1:
        level = [hashlib.sha256(level[i] + level[min(i + 1, len(level) - 1)]).digest() for i in range(0, len(level), 2)]
    return level[0].hex()


def test_roots_and_proofs(spark):
    for n in (1, 2, 3, 5, 8, 13):
        leaves = [hashlib.sha256(str(i).encode()).hexdigest() for i in range(n)]
        df = spark.createDataFrame([(leaves,)], "l array<string>")
        root = df.select(merkle.root(F.col("l"))).first()[0]
        assert root == tree_root(leaves)
        rows = df.select(F.posexplode("l").alias("i", "leaf"), "l").select("leaf", merkle.proof(merkle.levels(F.col("l")), F.col("i")).alias("p"))
        assert {r[0] for r in rows.select(merkle.fold(F.col("leaf"), F.col("p"))).collect()} == {root}


@pytest.fixture(scope="module")
def events(spark):
    # one five-minute slot holds most events
    rows = [(f"e{i:04d}", f"payload {i}" * (i % 7 + 1), 1_700_000_000_000_000_000 + (0 if i % 3 else i * 10**10)) for i in range(600)]
    return spark.createDataFrame(rows, "event_id string, raw string, received_at long")


def test_hot_slot_is_split_and_verifies(spark, events):
    refs = integrity.segments(events, max_events=50).cache()
    sizes = [r[1] for r in refs.groupBy("raw_segment_id").count().collect()]
    assert sum(sizes) == 600 and max(sizes) < 110
    ledger = integrity.ledger(refs).cache()
    assert integrity.overall(integrity.verify(ledger, refs)).first()["pass"]
    one = refs.filter("event_id = 'e0100'").first()
    bad = refs.withColumn("raw", F.when(F.col("event_id") == "e0100", F.lit("x")).otherwise(F.col("raw")))
    failed = integrity.verify(ledger, bad).filter("NOT pass").collect()
    assert [f.segment_id for f in failed] == [one.raw_segment_id]
    gone = integrity.verify(ledger, refs.filter(F.col("raw_segment_id") != one.raw_segment_id)).filter("NOT pass").collect()
    assert [(f.segment_id, f.reason) for f in gone] == [(one.raw_segment_id, "segment missing")]
    broken = ledger.withColumn("prev_root", F.when(F.col("segment_id") == one.raw_segment_id, F.lit("00")).otherwise(F.col("prev_root")))
    assert [f.reason for f in integrity.verify(broken, refs).filter("NOT chain_ok").collect()] == ["chain broken"]
    assert integrity.check_proofs(integrity.proofs(refs)).filter("NOT verified").count() == 0


def test_byte_limit_starts_a_new_part(spark, events):
    refs = integrity.segments(events, max_events=10**6, max_bytes=2000)
    rows = refs.groupBy("raw_segment_id").agg(F.sum("raw_length").alias("b"), F.min("raw_offset").alias("o")).collect()
    assert all(r.o == 0 for r in rows) and max(r.b for r in rows) < 2 * 2000 + 100


@pytest.mark.parametrize("chunk", [2, 7, 1000])
@pytest.mark.parametrize("limit", [1 << 20, 12])
def test_multiline_brute_force(spark, chunk, limit):
    rng = random.Random(chunk)
    sources = {s: [rng.choice(["START ", " at ", "é "]) + str(i) for i in range(rng.randint(1, 30))] for s in ("a", "b")}
    df = spark.createDataFrame([(s, i, t) for s, ts in sources.items() for i, t in enumerate(ts)], "source string, line_no int, line string")
    got = {(r.source, bytes(r.payload), r.truncated) for r in join_lines(df, "^START", chunk=chunk, max_bytes=limit).collect()}
    want = set()
    for s, ts in sources.items():
        events = []
        for t in ts:
            if not events or re.search("^START", t):
                events.append(t)
            else:
                events[-1] += "\n" + t
        want |= {(s, e.encode()[:limit], len(e.encode()) > limit) for e in events}
    assert got == want


def test_invalid_start_makes_every_line_an_event(spark):
    df = spark.createDataFrame([("a", 0, "x"), ("a", 1, "y")], "source string, line_no int, line string")
    assert join_lines(df, "(").count() == 2


def test_proofs_of_a_full_segment(spark):
    """A default segment holds 50 000 events; every event has its path, and no row carries the tree."""
    n = 50_000
    ids = F.col("id").cast("string")
    refs = spark.range(n).select(F.lit("s").alias("raw_segment_id"), ids.alias("event_id"), F.col("id").alias("raw_seq"), F.sha2(ids.cast("binary"), 256).alias("raw_sha256"))
    got = integrity.check_proofs(integrity.proofs(refs)).agg(F.count("*"), F.count_if("verified"), F.max(F.size("path"))).first()
    assert tuple(got) == (n, n, 16)


def plain_root(leaves):
    import hashlib

    level = leaves
    while len(level) > 1:
        level = level + level[-1:] if len(level) % 2 else level
        level = [hashlib.sha256(level[i] + level[i + 1]).digest() for i in range(0, len(level), 2)]
    return level[0].hex()


def leaf_hashes(name, n):
    import hashlib

    return [hashlib.sha256(f"{name}{i}".encode()).digest() for i in range(n)]


def segments_of(spark, sizes):
    """One segment per size, its leaves hashed by Spark."""
    refs = None
    for name, n in sizes.items():
        text = F.concat(F.lit(name), F.col("id").cast("string"))
        own = spark.range(n).select(
            F.lit("d").alias("dt"), F.lit(name).alias("raw_segment_id"), text.alias("event_id"), F.col("id").alias("raw_seq"), F.lit(1).alias("raw_length"),
            F.lit(0).alias("received_at"), F.sha2(text.cast("binary"), 256).alias("raw_sha256"),
        )
        refs = own if refs is None else refs.unionByName(own)
    return refs


def test_roots_of_subtrees_equal_the_plain_tree(spark):
    sizes = {"a": 1, "b": 2, "c": 1023, "d": 1024, "e": 1025, "f": 2047, "g": 2049, "h": 3333}
    refs = segments_of(spark, sizes)
    got = {r.segment_id: (r.event_count, r.merkle_root) for r in integrity.ledger(refs).collect()}
    assert got == {k: (n, plain_root(leaf_hashes(k, n))) for k, n in sizes.items()}
    proofs = integrity.check_proofs(integrity.proofs(refs)).groupBy("raw_segment_id").agg(F.count_if("verified").alias("n"), F.min(F.size("path")).alias("lo"), F.max(F.size("path")).alias("hi")).collect()
    assert {r.raw_segment_id: (r.n, r.lo, r.hi) for r in proofs} == {k: (n, (n - 1).bit_length(), (n - 1).bit_length()) for k, n in sizes.items()}


def test_a_million_leaves_in_one_segment(spark):
    n = 1_000_000
    (row,) = integrity.ledger(segments_of(spark, {"s": n})).collect()
    assert (row.event_count, row.merkle_root) == (n, plain_root(leaf_hashes("s", n)))


def test_lines_keep_their_bytes(spark, tmp_path):
    import hashlib

    lines = [b"a\xff\xfe\x00b\r", "é".encode() * 10, b"", b"\r", b"\xc3", b"plain"]
    (tmp_path / "x.log").write_bytes(b"\n".join(lines) + b"\n")
    rows = readers.envelope(readers.log_lines(spark, str(tmp_path)), "l", F.current_timestamp())
    got = {(r.h, r.byte_length) for r in rows.select(integrity.payload_hash(F.col("raw")).alias("h"), "byte_length").collect()}
    want = [x.removesuffix(b"\r") for x in lines]
    assert got == {(hashlib.sha256(x).hexdigest(), len(x)) for x in want}
    cut = readers.envelope(readers.log_lines(spark, str(tmp_path)), "l", F.current_timestamp(), max_bytes=5)
    short = {bytes(r.b): (r.truncated, r.raw_sha256) for r in cut.select(F.col("raw").cast("binary").alias("b"), "truncated", "raw_sha256").collect()}
    assert short == {x[:5]: (len(x) > 5, hashlib.sha256(x).hexdigest()) for x in want}


def test_references_do_not_carry_the_payload(spark):
    from suite import q_lake

    plan = q_lake.placed(spark, "/root/testdata/sf0.001").select("event_id", "raw_retrieval_uri")._jdf.queryExecution().optimizedPlan().toString()
    # neither the hash nor the line itself is sorted into segments for a query that reads the place only
    assert "Window" in plan and "sha2" not in plan
    refs = q_lake.references(spark, "/root/testdata/sf0.001")
    assert "raw" not in refs.columns and refs.count() == spark.read.parquet("/root/testdata/sf0.001/events.parquet").count()


def test_verify_by_hashes_of_payloads_that_stayed_behind(spark, events):
    altered = F.when(F.col("event_id") == "e0100", F.lit("x")).otherwise(F.col("raw"))
    refs = integrity.segments(events.withColumn("found", integrity.payload_hash(altered)), max_events=50).drop("raw").cache()
    report = integrity.verify(integrity.ledger(refs), refs, found="found").filter("NOT pass").collect()
    assert [r.segment_id for r in report] == [refs.filter("event_id = 'e0100'").first().raw_segment_id]
    assert "does not match its stored hash" in report[0].reason

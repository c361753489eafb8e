"""Cuckoo-filter index against brute force: groups, deletion, lookups, overflow and false hits."""

import hashlib
import random
import re

from eventlake.llm import cuckoo
from eventlake.llm.queries import QUERIES

SPACE = re.compile(r"[\x20\x09-\x0D]")


def brute(rows):
    """{position: (keep position, size)}"""
    groups = {}
    for i, (doc, text) in enumerate(rows):
        groups.setdefault(SPACE.sub("", text or ""), []).append(i)
    out = {}
    for members in groups.values():
        keep = min(members, key=lambda i: (-len(rows[i][1] or ""), rows[i][0] is None, rows[i][0] or 0, i))
        out |= {i: (keep, len(members)) for i in members}
    return out


def test_query_equals_brute_force(spark):
    d = "/root/testdata/sf0.001"
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{d}/documents.parquet").select("doc_id", "text").collect()]
    want = {rows[i][0]: (rows[k][0], n, k == i, hashlib.sha256(SPACE.sub("", rows[i][1] or "").encode()).hexdigest()) for i, (k, n) in brute(rows).items()}
    got = {r.doc_id: (r.keep_id, r.group_size, r.kept, r.text_sha256) for r in QUERIES["op13_cuckoo_dedup"](spark, d).collect()}
    assert got == want


EDGES = [(1, None), (2, ""), (3, " \t\x0b"), (4, "a b"), (5, "ab  "), (6, "ab"), (7, " ab"), (8, " ab"), (8, " ab"), (None, "ab  "), (None, "z" * 200_000), (10, "z" * 199_999 + " z"), (11, "é "), (12, "é")]


def frame(spark, rows):
    return spark.createDataFrame([(*r, "x") for r in rows], "doc_id long, text string, digest string")


def test_edges(spark):
    got = cuckoo.classes(cuckoo.insert(None, frame(spark, EDGES).coalesce(1))).collect()
    want = brute(EDGES)
    assert sorted((str(r.doc_id), str(r.keep_id), r.group_size, r.kept) for r in got) == sorted((str(EDGES[i][0]), str(EDGES[k][0]), n, k == i) for i, (k, n) in want.items())
    empty = cuckoo.insert(None, frame(spark, []))
    assert cuckoo.classes(empty).count() == 0
    assert [r.live for r in cuckoo.lookup(empty, frame(spark, EDGES[:1])).collect()] == [False]


def test_insert_delete_lookup(spark):
    rnd = random.Random(5)
    rows = [(i, rnd.choice("abc ") * rnd.randint(1, 3) + str(rnd.randint(0, 400))) for i in range(900)]
    index = cuckoo.insert(None, frame(spark, rows[:300]), per_shard=100)
    index = cuckoo.insert(index, frame(spark, rows[300:400]), per_shard=100)
    # shards are dealt anew when they hold too much
    index = cuckoo.insert(index, frame(spark, rows[400:]), per_shard=100)
    assert index.n_shards == 9
    # rows leave; one stranger and one row of another text do nothing
    index = cuckoo.delete(index, frame(spark, [*rows[100:500], (12345, "x"), (0, "other text")]))
    left = rows[:100] + rows[500:]
    want = sorted((left[i][0], left[k][0], n) for i, (k, n) in brute(left).items())
    assert sorted((r.doc_id, r.keep_id, r.group_size) for r in cuckoo.classes(index).collect()) == want
    live = {SPACE.sub("", t) for _, t in left}
    for r in cuckoo.lookup(index, frame(spark, rows)).collect():
        assert r.live == (SPACE.sub("", r.text) in live)


def test_filter_overflow_and_false_hits():
    own = cuckoo.Filter(bits=1)
    digests = [hashlib.sha256(str(i).encode()).digest() for i in range(3000)]
    for i, d in enumerate(digests):
        own.add(d, 1 + i % 3)
    assert own.bits >= 10
    again = cuckoo.Filter(*own.row(0)[1:])
    for i, d in enumerate(digests):
        assert [again.copies[j] for j in again.hits(d) if again.digests[j] == d] == [1 + i % 3]
        again.add(d, -(1 + i % 3))
    assert not any(again.slots) and not any(again.copies)
    # the same fingerprint and buckets, yet another digest: both live, and one may leave without the other
    a, b = b"\1" * 10 + b"a" * 22, b"\1" * 10 + b"b" * 22
    again.add(a, 1)
    assert again.hits(b)
    again.add(b, 1)
    again.add(a, -1)
    assert [again.digests[j] for j in again.hits(a)] == [b]

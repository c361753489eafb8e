"""Repeated byte strings against brute force."""

import hashlib
import random
from collections import Counter, defaultdict

import pytest

from eventlake.llm import suffixes
from eventlake.llm.queries import QUERIES


def brute(texts, length, keep_first):
    seen = Counter(t[i : i + length] for t in texts for i in range(len(t) - length + 1))
    done = set()
    out = []
    for t in texts:
        cover = [False] * len(t)
        for i in range(len(t) - length + 1):
            w = t[i : i + length]
            if seen[w] > 1 and not (keep_first and w not in done):
                cover[i : i + length] = [True] * length
            done.add(w)
        kept = bytes(c for c, x in zip(t, cover) if not x)
        spans = sum(1 for i, x in enumerate(cover) if x and (i == 0 or not cover[i - 1]))
        out.append((kept, len(t), sum(cover), spans))
    return out


def corpus(seed):
    rnd = random.Random(seed)
    word = lambda: "".join(rnd.choice("abcé") for _ in range(rnd.randint(1, 7)))
    passage = [" ".join(word() for _ in range(40)) for _ in range(4)]
    texts = [" ".join(word() for _ in range(rnd.randint(0, 120))) for _ in range(30)]
    texts += [t[: rnd.randint(0, 300)] + rnd.choice(passage) + t[:50] for t in texts]
    texts += texts[:6] + [texts[3] + texts[4], "x" * 500, "ab" * 300, "ab" * 301, "", (passage[0] + " ") * 3]
    rnd.shuffle(texts)
    return texts


@pytest.mark.parametrize("block", [1_000_000, 400])
@pytest.mark.parametrize("keep_first", [True, False])
def test_equals_brute_force(spark, keep_first, block):
    texts = corpus(3)
    df = spark.createDataFrame([(i, t, 5) for i, t in enumerate(texts)], "doc_id long, text string, n_bytes int").coalesce(1)
    got = {r.doc_id: (bytes(r.kept), r.n_bytes, r.n_removed, r.n_spans) for r in suffixes.remove(df, 60, keep_first, ["doc_id"], block).collect()}
    want = brute([t.encode() for t in texts], 60, keep_first)
    assert [got[i] for i in range(len(texts))] == want


def test_query_equals_brute_force(spark):
    d = "/root/testdata/sf0.001"
    rows = [(r.doc_id, (r.text or "").encode()) for r in spark.read.parquet(f"{d}/documents.parquet").collect()]
    count = defaultdict(int)
    for _, t in rows:
        for i in range(len(t) - 399):
            count[hash(t[i : i + 400])] += 1
    want = {}
    for doc, t in rows:
        cover = bytearray(len(t))
        for i in range(len(t) - 399):
            if count[hash(t[i : i + 400])] > 1:
                cover[i : i + 400] = b"\1" * 400
        kept = bytes(c for c, x in zip(t, cover) if not x)
        want[doc] = (len(t), sum(cover), (b"\0" + cover).count(b"\0\1"), hashlib.sha256(kept).hexdigest())
    got = {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in QUERIES["op7_suffix_dedup"](spark, d).collect()}
    assert got == want and sum(v[1] for v in want.values()) > 0


def test_nulls_repeats_and_empty(spark):
    df = spark.createDataFrame([(None, None), (1, "a" * 450), (1, "a" * 450), (2, "")], "doc_id long, text string")
    got = sorted((r.doc_id or 0, r.n_bytes, r.n_removed) for r in suffixes.remove(df, 400, False).collect())
    assert got == [(0, 0, 0), (1, 450, 450), (1, 450, 450), (2, 0, 0)]
    assert suffixes.remove(df.limit(0)).count() == 0


def test_documents_split_otherwise_between_scans(spark, tmp_path):
    texts = corpus(5)
    rows = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    rows.repartition(8, "doc_id").write.parquet(f"{tmp_path}/documents.parquet")
    split = "spark.sql.files.minPartitionNum"
    try:
        spark.conf.set(split, "8")
        cut = suffixes.remove(spark.read.parquet(f"{tmp_path}/documents.parquet"), 60, False, ["doc_id"])
        spark.conf.set(split, "1")
        got = {r.doc_id: (bytes(r.kept), r.n_bytes, r.n_removed, r.n_spans) for r in cut.collect()}
    finally:
        spark.conf.unset(split)
    want = brute([t.encode() for t in texts], 60, False)
    assert [got[i] for i in range(len(texts))] == want

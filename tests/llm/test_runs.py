"""Runs against brute force over all periods."""

import hashlib
import random
import re
import zlib

import numpy as np

from eventlake.llm import runs
from eventlake.llm.queries import QUERIES, with_tails


def brute(words):
    number = {}
    ids = np.array([number.setdefault(w, len(number)) for w in words], np.int64)
    found = {}
    for q in range(1, len(ids) // 2 + 1):
        same = np.concatenate([[0], (ids[q:] == ids[:-q]).astype(np.int8), [0]])
        turn = np.flatnonzero(np.diff(same))
        for a, b in zip(turn[::2].tolist(), turn[1::2].tolist()):
            if b - a + q >= max(12, 2 * q):
                found.setdefault((a, b - a + q), q)
    return sorted(((s, n, q) for (s, n), q in found.items()), key=lambda r: (r[0], r[2]))


def tailed(doc_id, text):
    words = re.findall("[^ \t-\r]+", text or "")
    h, n = zlib.crc32(str(doc_id).encode()), len(words)
    if doc_id is not None and h % 10 == 0 and n:
        g = h // 10
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        words = [words[i if i < a else a + (i - a) % p] for i in range(n)]
    return words


def expected(doc_id, text):
    words = tailed(doc_id, text)
    found = brute(words)
    top = min(((-n, s, q) for s, n, q in found), default=None)
    gone = {i for s, n, q in found for i in range(s + q, s + n)}
    lines = "".join(f"{s},{n},{q}\n" for s, n, q in found)
    first = (None,) * 4 if top is None else (top[1], -top[0], top[2], 1000 * -top[0] // top[2])
    sha = [hashlib.sha256(x.encode()).hexdigest() for x in (lines, " ".join(w for i, w in enumerate(words) if i not in gone))]
    return len(found), *first, *sha


def test_query_equals_brute_force(spark):
    d = "/root/testdata/sf0.001"
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{d}/documents.parquet").select("doc_id", "text").collect()}
    rows = QUERIES["op11_automaton_runs"](spark, d).collect()
    assert len(rows) == len(texts) and sum(r.n_runs > 0 for r in rows) > 10
    for r in rows:
        assert (r.n_runs, r.start, r.length, r.period, r.exponent_milli, r.runs_sha256, r.collapsed_sha256) == expected(r.doc_id, texts[r.doc_id])


def test_random_texts():
    rnd = random.Random(11)
    for _ in range(1500):
        letters, n, words = rnd.randint(1, 4), rnd.randint(0, 70), []
        while len(words) < n:
            p = rnd.randint(1, 12)
            words += words[-p:] * rnd.randint(1, 4) if words and rnd.random() < 0.3 else [b"%d" % rnd.randint(0, letters)]
        assert runs.find(words) == brute(words)
    fibonacci, before = [b"a", b"b"], [b"a"]
    while len(fibonacci) < 1000:
        fibonacci, before = fibonacci + before, fibonacci
    assert runs.find(fibonacci) == brute(fibonacci)


def test_long_periodic_text():
    words = [b"%d" % (i % 7919) for i in range(100_000)]
    assert runs.find(words) == [(0, 100_000, 7919)]
    assert runs.find([b"same"] * 200_000) == [(0, 200_000, 1)]


def test_edges(spark):
    twice = " ".join(f"w{i}" for i in range(6))
    texts = [None, "", " \t\n", "one", "a " * 11, "a " * 12, f"{twice} {twice}", f"{twice}\u00a0{twice}", "é\x0b" * 40, f"x {twice} {twice} {twice} y {twice} {twice}", "a b " * 30 + "b a " * 30]
    rows = [(i, t, "x", i) for i, t in enumerate(texts)] + [(None, "b " * 50, "y", 0), (3, "c " * 13, "z", 0), (3, "c " * 13, "z", 0)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, runs string, n_runs int").repartition(2)
    got = sorted((str(r.doc_id), r.n_runs, r.collapsed, [tuple(x) for x in r.runs]) for r in runs.mark(docs).collect())
    want = []
    for i, t, *_ in rows:
        words = re.findall("[^ \t-\r]+", t or "")
        found = brute(words)
        gone = {j for s, n, q in found for j in range(s + q, s + n)}
        want.append((str(i), len(found), " ".join(w for j, w in enumerate(words) if j not in gone), found))
    assert got == sorted(want)
    assert runs.mark(docs.limit(0)).count() == 0
    tails = {r.doc_id: r.text for r in with_tails(docs.filter("doc_id is null or doc_id <> 3")).collect()}
    assert [re.findall("[^ \t-\r]+", t or "") for t in tails.values()] == [tailed(i, rows[i][1] if i is not None else "b " * 50) for i in tails]

"""Phrase mining against brute-force counts and scores."""

import random
import re
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from eventlake.llm import phrases
from eventlake.llm.queries import QUERIES


def brute(rows, least, depth=5):
    counts, totals = Counter(), Counter()
    for lang, text in rows:
        lang = "und" if lang is None else lang
        low = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
        for piece in re.split("[.,;:!?\n-\r]", low):
            ws = re.findall("[^ \t]+", piece)
            totals[lang] += len(ws)
            counts.update((lang, tuple(ws[i : i + k])) for k in range(1, depth + 1) for i in range(len(ws) - k + 1))
    return {k: n for k, n in counts.items() if n >= least}, totals


def scored(counts, totals, most, share=100):
    out = {}
    for (lang, ws), a in counts.items():
        longer = [f for (g, v), f in counts.items() if g == lang and len(v) > len(ws) and any(v[i : i + len(ws)] == ws for i in range(len(v) - len(ws) + 1))]
        if len(ws) < 2 or any(100 * f >= share * a for f in longer):
            continue
        cuts = []
        for k in range(1, len(ws)):
            left, right = counts[lang, ws[:k]], counts[lang, ws[k:]]
            cuts.append((1000 * a * totals[lang] // (left * right), k, left, right))
        score, _, left, right = min(cuts)
        out.setdefault(lang, []).append((-score, -a, " ".join(ws).encode(), left, right))
    return {lang: [(i, p.decode(), -a, le, r, totals[lang], -s) for i, (s, a, p, le, r) in enumerate(sorted(found)[:most], 1)] for lang, found in out.items()}


def made(rnd, n):
    words = ["the", "The", "of", "a", "b", "c", "d", "é", "É", "x-y", "\u00a0z", "0", "rare%d"]
    rows = []
    for i in range(n):
        text = "".join(rnd.choice(words) % i if w == 12 else rnd.choice(words[:12]) + rnd.choice([" "] * 9 + ["\t ", ". ", "\n", ",", "  "]) for w in [rnd.randint(0, 11) for _ in range(rnd.randint(0, 40))])
        rows.append((rnd.choice(["en", "en", "de", None]), text))
    return rows + [("en", None), (None, ""), ("fr", "...")] + [("en", "one two three four five six seven")] * 30 + [("en", "the " * 500)]


@pytest.mark.parametrize("size", [150, 1_000_000])
def test_counts_and_scores(spark, size):
    rows = made(random.Random(size), 300)
    df = spark.createDataFrame([(*r, "x", 1) for r in rows], "lang string, text string, words string, n int").repartition(3)
    counts, totals = brute(rows, 12)
    found, n = phrases.mine(df, least=12, size=size)
    assert {(r.lang, tuple(r.words)): r.f for r in found.collect()} == counts
    assert {r.lang: r.n for r in n.collect()} == dict(+totals)
    for share in (100, 60):
        want = scored(counts, totals, 40, share)
        ranked = phrases.top(phrases.collocations(found, n, share), 40)
        got = {}
        for r in ranked.orderBy("lang", "rank").collect():
            got.setdefault(r.lang, []).append((r.rank, r.phrase, r.a, r.l, r.r, r.n, r.score))
        assert got == want


def test_query_equals_brute_force(spark):
    d = "/root/testdata/sf0.001"
    rows = [tuple(r) for r in spark.read.parquet(f"{d}/documents.parquet").select("lang", "text").collect()]
    want = scored(*brute(rows, 100), 2000)
    got = {}
    for r in QUERIES["op12_fm_collocations"](spark, d).orderBy("lang", "rank").collect():
        got.setdefault(r.lang, []).append((r.rank, r.phrase, r.a, r.l, r.r, r.n, r.score))
    assert got == want


def test_empty_rare_and_shallow(spark):
    none = spark.createDataFrame([], "lang string, text string")
    found, n = phrases.mine(none)
    assert found.count() == 0 and n.count() == 0 and phrases.top(phrases.collocations(found, n), 5).count() == 0
    rare = spark.createDataFrame([("en", "a b c")], "lang string, text string")
    assert phrases.mine(rare)[0].count() == 0
    found, _ = phrases.mine(rare, least=1, depth=1)
    assert sorted(r.words[0] for r in found.collect()) == ["a", "b", "c"]


def test_large_products(spark):
    a, n, left, right = 10**15 + 7, 10**16 + 3, 10**15 + 9, 10**15 + 11
    row = spark.range(1).select(phrases.score_of(*(F.lit(x) for x in (a, n, left, right))).alias("s")).first()
    assert row.s == 1000 * a * n // (left * right)


def test_transform_and_search():
    rnd = np.random.default_rng(1)
    s = np.append(rnd.integers(0, 5, 400), 0)
    own = phrases.Shard(np.arange(5), s)
    text = "".join(map(str, s))
    for p in ["1", "12", "121", "4321", "11111", "24"]:
        seen = sum(text.startswith(p, i) for i in range(len(text)))
        ids = np.array([[int(c) for c in p]])
        assert phrases.search(own.side(True), ids)[1] == seen and phrases.search(own.side(False), ids[:, ::-1])[1] == seen

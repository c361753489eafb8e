"""Mixing: weights against a plain bisection, quotas and epochs against their definition."""

import math
from collections import defaultdict

import pytest

from eventlake.llm import mixing
from eventlake.llm.mixing import Target


def weights(tokens, target):
    total = sum(tokens.values())

    def at(a):
        z = sum((t / total) ** a for t in tokens.values())
        return {s: (t / total) ** a / z for s, t in tokens.items()}

    def entropy(a):
        return -sum(w * math.log(w) for w in at(a).values())

    def repeats(a):
        return max(w * total * target.budget / tokens[s] for s, w in at(a).items())

    lo, hi = 0.0, 1.0
    if entropy(1.0) >= target.entropy * math.log(len(tokens)):
        lo = 1.0
    else:
        for _ in range(60):
            mid = (lo + hi) / 2
            lo, hi = (mid, hi) if entropy(mid) >= target.entropy * math.log(len(tokens)) else (lo, mid)
    if repeats(lo) > target.repetition:
        hi = 1.0
        for _ in range(60):
            mid = (lo + hi) / 2
            lo, hi = (mid, hi) if repeats(mid) > target.repetition else (lo, mid)
    return at(lo)


@pytest.mark.parametrize("target", [Target(), Target(0.999, 2.0, 1.5), Target(0.5, 1.0, 0.3)])
def test_quotas(spark, target):
    sizes = {"big": 3000, "mid": 400, "small": 60, None: 150}
    rows = [(i, s, "w " * (1 + i % 9), "x") for s, n in sizes.items() for i in range(n)]
    df = spark.createDataFrame(rows, "doc_id long, source string, text string, epoch string")
    got = mixing.mix(df, target).collect()
    have, drawn, seen = defaultdict(int), defaultdict(int), defaultdict(int)
    for i, s, t, _ in rows:
        have[s] += len(t.split())
    for r in got:
        drawn[r.source] += r.tokens
        seen[r.source, r.epoch, r.doc_id] += 1
        assert 0 <= r.turn <= 1
    assert max(seen.values()) == 1
    want, total = weights(have, target), sum(have.values())
    for s, w in want.items():
        quota = min(w * total * target.budget, have[s] * target.repetition)
        assert quota - 10 <= drawn[s] <= quota + 1
        for e in range(int(quota // have[s])):
            assert sum(1 for k in seen if k[:2] == (s, e)) == sizes[s]
        assert not [k for k in seen if k[0] == s and k[1] > quota // have[s]]


def test_edges(spark):
    df = spark.createDataFrame([(None, None, None), (1, "a", ""), (1, "a", "x y"), (1, "a", "x y")], "doc_id long, source string, text string")
    got = mixing.mix(df, Target(1.0, 1.0, 1.0)).collect()
    assert sorted(r.tokens for r in got)[-2:] == [2, 2]
    assert mixing.mix(df.limit(0)).count() == 0
    assert mixing.mix(df.filter("text is null")).count() == 0

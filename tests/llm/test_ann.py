"""Nearest neighbours: recall against brute force, exact scores, ties and unusable vectors."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from eventlake.llm import ann
from eventlake.llm.queries import QUERIES


def test_recall_on_the_table(spark):
    d = "/root/testdata/sf0.1"
    table = spark.read.parquet(f"{d}/embeddings.parquet").collect()
    ids, x = np.array([r.vec_id for r in table]), np.array([r.embedding for r in table], float)
    got: dict[int, list] = {}
    for r in QUERIES["op5_collision_ann"](spark, d).orderBy("query_id", "rank").collect():
        got.setdefault(r.query_id, []).append((r["rank"], r.vec_id, r.score))
    asked = [i for i in ids if i % 20 == 0]
    assert sorted(got) == sorted(asked)
    hit = 0
    for q in asked:
        score = x @ x[np.flatnonzero(ids == q)[0]]
        score[ids == q] = -9
        true = set(ids[np.lexsort((ids, -score))[:20]].tolist())
        assert [r for r, _, _ in got[q]] == list(range(1, 21))
        assert all(abs(s - score[np.flatnonzero(ids == v)[0]]) < 1e-12 for _, v, s in got[q])
        assert [(-s, v) for _, v, s in got[q]] == sorted((-s, v) for _, v, s in got[q])
        hit += len(true & {v for _, v, _ in got[q]})
    assert hit / (20 * len(asked)) >= 0.95


def test_small_ties_and_bad_vectors(spark):
    rows = [(0, [1.0, 0.0]), (1, [1.0, 0.0]), (2, [1.0, 0.0]), (3, [0.0, 3.0]), (4, None), (5, []), (6, [0.0, 0.0]), (7, [float("nan"), 1.0]), (8, [None, 1.0]), (9, [float("inf"), 1.0]), (10, [1.0, 2.0, 3.0]), (20, [2.0, 0.5]), (20, [2.0, 0.5])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>").coalesce(1)
    got = ann.search(ann.build(df), F.col("vec_id") % 20 == 0, k=3).collect()
    by = sorted((r.query_id, r["rank"], r.vec_id, r.score) for r in got)
    assert [b for b in by if b[0] == 0] == [(0, 1, 20, 2.0), (0, 2, 20, 2.0), (0, 3, 1, 1.0)]
    assert [b[:3] for b in by if b[0] == 20] == [(20, 1, 20), (20, 1, 20), (20, 2, 0), (20, 2, 0), (20, 3, 1), (20, 3, 1)]
    assert ann.search(ann.build(df.limit(0)), F.lit(True)).count() == 0


@pytest.mark.parametrize("norms", ["one outlier", "1 to 3", "1 to 100"])
def test_recall_with_unequal_norms(spark, norms):
    rnd = np.random.default_rng(8)
    x = rnd.standard_normal((4_000, 48))
    x /= np.linalg.norm(x, axis=1)[:, None]
    if norms == "one outlier":
        x[17] *= 100
    else:
        x *= np.exp(rnd.uniform(0, np.log(int(norms.split()[-1])), 4_000))[:, None]
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>").coalesce(1)
    got: dict[int, set] = {}
    for r in ann.search(ann.build(df), F.col("vec_id") % 40 == 0).collect():
        got.setdefault(r.query_id, set()).add(r.vec_id)
    hit = 0
    for q in range(0, 4_000, 40):
        score = x @ x[q]
        score[q] = -np.inf
        hit += len(got[q] & set(np.argsort(-score)[:20].tolist()))
    assert hit / (20 * 100) >= 0.9


@pytest.mark.parametrize("copies", [30, 119, 400])
def test_many_equal_vectors(spark, copies):
    rnd = np.random.default_rng(copies)
    kinds = rnd.standard_normal((4, 7))
    rows = [(i, kinds[i % 4].tolist()) for i in range(4 * copies)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").repartition(3)
    got: dict[int, list] = {}
    for r in ann.search(ann.build(df), F.col("vec_id") % 20 == 0).orderBy("query_id", "rank").collect():
        got.setdefault(r.query_id, []).append((r.vec_id, r.score))
    for q in range(0, 4 * copies, 20):
        score = (kinds * kinds[q % 4]).sum(1)
        want = sorted(((i, score[i % 4]) for i in range(4 * copies) if i != q), key=lambda p: (-p[1], p[0]))[:20]
        assert [v for v, _ in got[q]] == [v for v, _ in want]
        # copies score alike to the last bit
        assert len({s for v, s in got[q] if v % 4 == got[q][0][0] % 4}) == 1

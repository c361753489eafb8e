"""Nearest neighbours by collision-counting hashing with query-centred windows.

Each block of `BLOCK` vectors is cut into ranges of like norm (within a factor `RANGE`). The vectors of a range are scaled
by its largest norm and lifted by one coordinate to unit length, so that the largest inner product is the smallest distance.
Each of `PROJECTIONS` random directions gives one projection, held as a sorted array per range. Ranges are searched from the
largest norm down, until the k-th score found exceeds all that the norms of the rest allow. In a range, a query opens a window around its own projection in every array and widens it step by step (virtual
rehashing) until enough vectors lie in the windows of at least half of the arrays; those are verified with exact inner
products. The index is a table of blocks; queries come in chunks of `CHUNK`, each broadcast to one pass over the index.

Recall against brute force is measured in the tests; a wider `SHARE` raises it. Defined results: vectors that are null,
empty, zero or hold null or non-finite components take no part; only vectors of equal length meet; ids may repeat, and a
row is left out of its own neighbours only; ties go to the smaller id.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from eventlake.llm.common import stored

PROJECTIONS = 96
BLOCK = 8_192
CHUNK = 2_048
# largest norm of a range by its smallest, at most
RANGE = 1.25
# part of a range that has to collide before the windows stop widening
SHARE = 0.3
# and so many times the wanted neighbours besides, which small ranges need
SPARE = 15
SEED = 20240131
# each window is wider than the one before by this factor
WIDEN = 1.04


def usable(vector: Column) -> Column:
    """Whether a vector takes part; null vectors give false."""
    wide = F.transform(vector, lambda x: x.cast("double"))
    bad = F.exists(wide, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return F.coalesce(~bad & F.exists(wide, lambda x: x != 0), F.lit(False))


def directions(dim: int) -> np.ndarray:
    """Random directions for lifted vectors of `dim` + 1 coordinates."""
    return np.random.default_rng(SEED + dim).standard_normal((dim + 1, PROJECTIONS))


def lifted(x: np.ndarray, largest: float) -> np.ndarray:
    x = x / largest
    rest = np.sqrt(np.maximum(0.0, 1.0 - (x * x).sum(1)))
    return np.concatenate([x, rest[:, None]], 1)


def matrix(col: pa.Array) -> np.ndarray:
    """A batch of vectors of one length as rows."""
    n = len(col)
    return col.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(n, -1)


def norm_ranges(norms: np.ndarray) -> list[np.ndarray]:
    """Places of the vectors of each range, largest norms first."""
    number = np.floor(np.log(norms.max() / norms) / math.log(RANGE))
    order = np.argsort(number, kind="stable")
    return np.split(order, np.flatnonzero(np.diff(number[order])) + 1)


class Arrays:
    """Sorted projections of a range."""

    def __init__(self, x: np.ndarray, largest: float):
        p = lifted(x, largest) @ directions(x.shape[1])
        self.n = len(x)
        order = np.argsort(p, axis=0, kind="stable")
        # one search over all arrays: array j is shifted to its own range
        self.shift = 1e4 * np.arange(PROJECTIONS)
        self.flat = (np.take_along_axis(p, order, 0) + self.shift).T.ravel()
        self.order = order.T.ravel()
        self.few = p[:: max(1, len(x) // 256)]

    def first_width(self, q: np.ndarray, need: int) -> float:
        """Where to begin: about the width at which `need` vectors collide often enough, judged from a few of them."""
        enough = np.partition(np.abs(self.few - q), PROJECTIONS // 2 - 1, axis=1)[:, PROJECTIONS // 2 - 1]
        return max(0.05, 0.97 * float(np.quantile(enough, min(1.0, need / self.n))))

    def colliding(self, q: np.ndarray, need: int) -> np.ndarray:
        """Places of the vectors that collide with projections q in half of the arrays, at least `need` of them."""
        count = np.zeros(self.n, np.int64)
        lo = hi = np.searchsorted(self.flat, q + self.shift)
        width = self.first_width(q, need)
        while hi[0] - lo[0] < self.n or (hi - lo).sum() < self.n * PROJECTIONS:
            new_lo = np.searchsorted(self.flat, q - width + self.shift)
            new_hi = np.searchsorted(self.flat, q + width + self.shift, "right")
            parts = [self.order[a:b] for a, b in zip([*new_lo, *hi], [*lo, *new_hi]) if b > a]
            if parts:
                count += np.bincount(np.concatenate(parts), minlength=self.n)
            lo, hi = new_lo, new_hi
            found = np.flatnonzero(2 * count >= PROJECTIONS)
            if len(found) >= need:
                return found
            width *= WIDEN
        return np.arange(self.n)


def best(ids: np.ndarray, scores: np.ndarray, k: int) -> np.ndarray:
    """Places of the k largest scores, ties to the smaller id."""
    if len(ids) > k:
        bound = np.partition(scores, len(scores) - k)[len(scores) - k]
        some = np.flatnonzero(scores >= bound)
    else:
        some = np.arange(len(ids))
    return some[np.lexsort((ids[some], -scores[some]))[:k]]


def nearest(ids: np.ndarray, x: np.ndarray, q: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """(ids, inner products) of the k nearest of some vectors.

    A product over many rows gives equal vectors last bits by their place, so it only chooses, with a margin; what is chosen
    is scored row by row, which is the same for equal vectors.
    """
    some = np.arange(len(ids))
    if len(ids) > k:
        rough = x @ q
        bound = np.partition(rough, len(rough) - k)[len(rough) - k]
        some = np.flatnonzero(rough >= bound - 1e-9 * np.abs(rough).max())
    exact = (x[some] * q).sum(1)
    top = best(ids[some], exact, k)
    return ids[some][top], exact[top]


def build(vectors: DataFrame) -> DataFrame:
    """The index: (dim, vec_id, row, embedding) rows in stored blocks; each partition of it holds whole blocks."""
    size = F.size("embedding").alias("dim")
    rows = vectors.select("vec_id", "embedding", F.monotonically_increasing_id().alias("row")).filter(usable(F.col("embedding")))
    return stored(rows.select(size, F.col("vec_id").cast("long").alias("vec_id"), "row", F.col("embedding").cast("array<double>").alias("embedding")))


def search(index: DataFrame, queries: Column, k: int = 20, share: float = SHARE) -> DataFrame:
    """(query_id, rank, vec_id, score): the k nearest found of every row of the index for which `queries` holds."""
    spark = index.sparkSession
    shape = index.groupBy("dim").agg(F.count("*").alias("n"), F.count_if(queries).alias("q")).collect()
    parts = None
    for dim, n, asked in ((s.dim, s.n, s.q) for s in shape if s.q):
        blocks = max(1, math.ceil(n / BLOCK))
        own = index.filter(F.col("dim") == dim)
        # equal vectors are dealt over all blocks, as rows are dealt by number
        block = F.pmod(F.xxhash64("row"), F.lit(blocks)).cast("int")
        dealt = own.select(block.alias("block"), "vec_id", "row", "embedding").repartition(blocks, "block").sortWithinPartitions("block")
        chunks = max(1, math.ceil(asked / CHUNK))
        for c in range(chunks):
            chunk = own.filter(queries & (F.pmod(F.xxhash64("row"), F.lit(chunks)) == c)).select("vec_id", "row", "embedding")
            rows = list(chunk.toLocalIterator())
            if rows:
                asked_by = (np.array([r.vec_id for r in rows]), np.array([r.row for r in rows]), np.array([r.embedding for r in rows]))
                got = _pass(dealt, spark.sparkContext.broadcast(asked_by), k, share)
                parts = got if parts is None else parts.union(got)
    if parts is None:
        return index.select(F.col("vec_id").alias("query_id"), F.lit(1).alias("rank"), "vec_id", F.lit(0.0).alias("score")).limit(0)
    order = Window.partitionBy("query_row", "query_id").orderBy(F.desc("score"), "vec_id")
    ranked = parts.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)
    return ranked.select("query_id", "rank", "vec_id", "score")


def _pass(dealt: DataFrame, asked, k: int, share: float) -> DataFrame:  # noqa: ANN001
    """The k best of each partition's blocks for each query of a chunk."""

    def answer(block: list[pa.RecordBatch], held: dict) -> None:
        data = pa.Table.from_batches(block).combine_chunks().to_batches()[0]
        ids, rows, x = data.column(1).to_numpy(), data.column(2).to_numpy(), matrix(data.column(3))
        norms = np.linalg.norm(x, axis=1)
        q_ids, q_rows, q = asked.value
        lengths = np.linalg.norm(q, axis=1)
        lift = np.concatenate([q / lengths[:, None], np.zeros((len(q), 1))], 1)
        projected = lift @ directions(q.shape[1])
        for places in norm_ranges(norms):
            own_ids, own_rows, own = ids[places], rows[places], x[places]
            largest = float(norms[places].max())
            need = math.ceil(share * len(places)) + SPARE * k
            arrays = Arrays(own, largest) if need < len(places) else None
            for i in range(len(q)):
                before = held.get(i)
                # the k-th score so far exceeds all that can come, with room for rounding
                if before is not None and len(before[1]) == k and before[1][-1] > lengths[i] * largest * (1 + 1e-9):
                    continue
                at = arrays.colliding(projected[i], need) if arrays else np.arange(len(places))
                at = at[own_rows[at] != q_rows[i]]
                found = nearest(own_ids[at], own[at], q[i], k)
                if before is not None:
                    both = [np.concatenate(pair) for pair in zip(before, found)]
                    top = best(*both, k)
                    found = both[0][top], both[1][top]
                held[i] = found

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, tuple[np.ndarray, np.ndarray]] = {}
        block: list[pa.RecordBatch] = []
        for b in batches:
            keys = b.column(0).to_numpy()
            cuts = [0, *(np.flatnonzero(keys[1:] != keys[:-1]) + 1).tolist(), len(keys)]
            for lo, hi in zip(cuts, cuts[1:]):
                if hi == lo:
                    continue
                if block and block[-1].column(0)[0].as_py() != keys[lo]:
                    answer(block, held)
                    block = []
                block.append(b.slice(lo, hi - lo))
        if block:
            answer(block, held)
        q_ids, q_rows, _ = asked.value
        for i, (ids, scores) in held.items():
            n = len(ids)
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.full(n, q_ids[i])), pa.array(np.full(n, q_rows[i])), pa.array(ids), pa.array(scores)],
                ["query_id", "query_row", "vec_id", "score"],
            )

    return dealt.mapInArrow(run, "query_id long, query_row long, vec_id long, score double")

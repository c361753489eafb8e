"""Removal of long repeated byte strings by longest-previous-factor arrays over suffix order.

A string of `length` bytes that starts at two places is found in three steps.

1. Every window of `length` bytes is given to one anchor: the place of its smallest k-gram hash, the leftmost of equals.
   Equal windows hold equal anchors at equal offsets. Consecutive windows of one anchor are a run; a run is known by the
   hash of its anchor and of its bytes. Anchors that occur once are gone after one map-side combined aggregate.
2. Runs of one anchor with equal bytes are copies as a whole. Only anchors with different runs go on: one text per
   distinct run is brought together by anchor and laid out in text order, its windows are put in suffix order by prefix
   doubling, and the longest previous factor of a window reaches `length` if the neighbour of smaller position in suffix
   order shares its first `length` bytes (as ties stand in order of position, that is the entry before; the entry after
   gives the next factor likewise).
3. An anchor whose distinct runs exceed `BLOCK` bytes would be an unbounded group: its windows are counted by 128-bit
   hashes instead, in blocks that are halved where they differ; counts combine on the map side. Both ways give the same
   flags.

Run and anchor hashes are 64 bits each and compared together. Documents are stored once with a number for each row, by
which the steps meet again. Defined results: a null text is empty; ids may be null or repeat, as rows are judged, not ids;
an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from hashlib import blake2b, sha256
from itertools import groupby
from operator import itemgetter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from eventlake.llm.common import numbered, raw, stored

LENGTH = 400
GRAM = 24
BLOCK = 1_000_000
# bytes put in suffix order together; several small groups share a block
TOGETHER = 48_000
_C = [np.uint64(c) for c in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93)]
_LOW = np.uint64(0xFFFFFFFF)


def _hashes(data: bytes) -> np.ndarray:
    """Hash of the GRAM bytes from each place."""
    n = len(data) - GRAM + 1
    eight = np.ndarray((len(data) - 7,), "<u8", data, strides=(1,))
    h = eight[:n] * _C[0] + eight[8 : n + 8] * _C[1] + eight[16 : n + 16] * _C[2]
    h ^= h >> np.uint64(29)
    h *= _C[3]
    return h ^ (h >> np.uint64(32))


def runs_of(data: bytes, length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """First window, number of windows and anchor hash of each run."""
    n = len(data) - length + 1
    if n <= 0:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.uint64)
    h = _hashes(data)
    low = (h & ~_LOW) | np.arange(len(h), dtype=np.uint64)
    span, size = length - GRAM + 1, 1
    while size * 2 <= span:
        low = np.minimum(low[:-size], low[size:])
        size *= 2
    at = np.minimum(low[:n], low[span - size : span - size + n]) & _LOW
    first = np.concatenate([[0], np.flatnonzero(at[1:] != at[:-1]) + 1])
    return first, np.diff(first, append=n), h[at[first].astype(np.int64)]


def previous_factors(texts: list[bytes], windows: list[int], length: int) -> tuple[np.ndarray, np.ndarray]:
    """For the first windows of each text, texts in order of position: whether the longest previous factor reaches
    `length`, and whether the longest previous or next one does."""
    data = b"".join(texts)
    n = len(data)
    offsets = np.cumsum([0, *map(len, texts)])[:-1]
    counts = np.array(windows)
    starts = np.repeat(offsets - np.cumsum(counts) + counts, counts) + np.arange(counts.sum())
    depth = min(8, length)
    eight = np.ndarray((n,), ">u8", data + bytes(8), strides=(1,)).astype(np.uint64) >> np.uint64(8 * (8 - depth))
    rank = np.unique(eight, return_inverse=True)[1].astype(np.uint64)
    while depth < length:
        parts, bits = (4, 16) if int(rank.max()) < 1 << 16 else (2, 32)
        reach = min(length, depth * parts)
        key = rank.copy()
        for j in range(1, parts):
            off = min(j * depth, reach - depth)
            key <<= np.uint64(bits)
            key[: n - off] |= rank[off:]
        depth = reach
        rank = np.unique(key, return_inverse=True)[1].astype(np.uint64)
    own = rank[starts]
    order = np.lexsort((starts, own))
    tie = own[order][1:] == own[order][:-1]
    before, after = np.concatenate([[False], tie]), np.concatenate([tie, [False]])
    earlier, any_other = np.empty(len(order), bool), np.empty(len(order), bool)
    earlier[order], any_other[order] = before, before | after
    return earlier, any_other


def _ranges(flags: np.ndarray) -> list[int]:
    return np.flatnonzero(np.diff(np.concatenate([[0], flags.astype(np.int8), [0]]))).tolist()


def find_runs(texts: DataFrame, length: int) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows, firsts, counts, anchors, digests = [], [], [], [], []
            for row, t in zip(b.column(0).to_pylist(), raw(b.column(1))):
                first, n, anchor = runs_of(t or b"", length)
                if len(first):
                    rows.append(np.full(len(first), row))
                    firsts.append(first)
                    counts.append(n)
                    anchors.append(anchor.view(np.int64))
                    ends = (first + n + (length - 1)).tolist()
                    digests += [blake2b(t[s:e], digest_size=8).digest() for s, e in zip(first.tolist(), ends)]
            if rows:
                cols = [np.concatenate(rows), *(np.concatenate(c).astype(np.int32) for c in (firsts, counts)), np.concatenate(anchors)]
                cols.append(np.frombuffer(b"".join(digests), np.int64))
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in cols], ["row", "first", "n", "anchor", "digest"])

    return texts.mapInArrow(run, "row long, first int, n int, anchor long, digest long")


def fetch(texts: DataFrame, wanted: DataFrame, length: int) -> DataFrame:
    """Bytes of the wanted runs (row, first, n, anchor, digest, big)."""
    per_row = wanted.groupBy(F.col("row").alias("to")).agg(F.collect_list(F.struct("first", "n", "anchor", "digest", "big")).alias("runs"))
    joined = texts.join(per_row, F.col("row") == F.col("to")).select("row", "text", "runs")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = []
            for i, (row, text) in enumerate(zip(b.column(0).to_pylist(), raw(b.column(1)))):
                for r in b.column(2)[i].as_py():
                    cut = text[r["first"] : r["first"] + r["n"] + length - 1]
                    out.append((row, r["first"], r["n"], r["anchor"], r["digest"], r["big"], cut))
            kinds = [pa.int64(), pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.bool_(), pa.binary()]
            names = ["row", "first", "n", "anchor", "digest", "big", "cut"]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out), kinds)], names)

    return joined.mapInArrow(run, "row long, first int, n int, anchor long, digest long, big boolean, cut binary")


_FLAGS = "anchor long, digest long, earlier array<int>, other array<int>"


def by_suffix_order(cuts: DataFrame, length: int) -> DataFrame:
    """Flags of the windows of each distinct run, from the suffix order of its anchor's runs; a group has BLOCK bytes at most."""
    dealt = cuts.repartition("anchor").sortWithinPartitions("anchor", "row", "first")

    def solve(rows: list[tuple]) -> pa.RecordBatch:
        # groups lie behind one another; windows of different anchors differ, so they cannot meet
        earlier, other = previous_factors([r[4] for r in rows], [r[1] for r in rows], length)
        at = np.cumsum([0, *(r[1] for r in rows)])
        cols = [
            pa.array([r[2] for r in rows], pa.int64()),
            pa.array([r[3] for r in rows], pa.int64()),
            pa.array([_ranges(earlier[a:b]) for a, b in zip(at, at[1:])], pa.list_(pa.int32())),
            pa.array([_ranges(other[a:b]) for a, b in zip(at, at[1:])], pa.list_(pa.int32())),
        ]
        return pa.RecordBatch.from_arrays(cols, ["anchor", "digest", "earlier", "other"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = (r for b in batches for r in zip(*(b.column(c).to_pylist() for c in ("row", "n", "anchor", "digest", "cut"))))
        held, size = [], 0
        for _, group in groupby(rows, itemgetter(2)):
            if size >= TOGETHER:
                yield solve(held)
                held, size = [], 0
            for r in group:
                held.append(r)
                size += len(r[4])
        if held:
            yield solve(held)

    return dealt.mapInArrow(run, _FLAGS)


# windows told apart by their distance to the anchor are halved in blocks of these sizes
SIZES = (32, 8, 1)


def _distance(cut: bytes, length: int) -> int:
    """How far the anchor of a run is from its first window."""
    h = (_hashes(cut[:length]) & ~_LOW) | np.arange(length - GRAM + 1, dtype=np.uint64)
    return int(h.min() & _LOW)


def _blocks(cut: bytes, n: int, far: int, length: int, size: int, wanted: list[int] | None) -> Iterator[tuple[int, bytes, bytes | None]]:
    """(block, hash of the bytes that all its windows hold, hash of the bytes that its windows span) of a run.

    A window's distance to its anchor decides its block, so the blocks of all runs of an anchor are alike. The second hash
    is missing where the run holds a part of the block only.
    """
    for b in range((far - n + 1) // size, far // size + 1) if wanted is None else wanted:
        low, high = b * size, b * size + size - 1
        if high < far - n + 1 or low > far:
            continue
        core = blake2b(cut[far - low : far - high + length], digest_size=16).digest()
        full = high <= far and low >= far - n + 1
        yield b, core, blake2b(cut[far - high : far - low + length], digest_size=16).digest() if full else None


def by_window_hash(cuts: DataFrame, length: int) -> DataFrame:
    """The same flags for anchors whose runs are too many for one group, by counting hashes of blocks of windows.

    A block whose spanned bytes occur twice is repeated as a whole; one whose common bytes occur once holds no repeated
    window; what is between goes on in smaller blocks, and so does the first of equal blocks, which stands for them.
    """
    todo, parts = None, []
    for size in SIZES:
        source = cuts.withColumn("wanted", F.lit(None).cast("array<int>"))
        if todo is not None:
            source = cuts.join(todo, (F.col("anchor") == F.col("a")) & (F.col("digest") == F.col("d"))).drop("a", "d")

        def run(batches: Iterator[pa.RecordBatch], size: int = size) -> Iterator[pa.RecordBatch]:
            for b in batches:
                out = []
                for row, first, n, anchor, digest, cut, wanted in zip(*(b.column(c).to_pylist() for c in ("row", "first", "n", "anchor", "digest", "cut", "wanted"))):
                    far = _distance(cut, length)
                    for block, core, span in _blocks(cut, n, far, length, size, wanted):
                        lo = max(0, far - block * size - size + 1)
                        hi = min(n, far - block * size + 1)
                        out.append((row, first + lo, anchor, digest, block, core, span, lo, hi))
                kinds = [pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.binary(), pa.binary(), pa.int32(), pa.int32()]
                names = ["row", "at", "anchor", "digest", "block", "core", "span", "lo", "hi"]
                if out:
                    yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out), kinds)], names)

        schema = "row long, at long, anchor long, digest long, block int, core binary, span binary, lo int, hi int"
        blocks = stored(source.mapInArrow(run, schema))
        place = F.struct("row", "at")
        cores = stored(blocks.groupBy(F.col("anchor").alias("a"), F.col("block").alias("b"), F.col("core").alias("k")).agg(F.count("*").alias("c")).filter("c > 1").drop("c"))
        whole = blocks.filter("span is not null").groupBy(F.col("anchor").alias("a2"), F.col("block").alias("b2"), F.col("span").alias("k2"))
        whole = stored(whole.agg(F.count("*").alias("c2"), F.min(place).alias("p")).filter("c2 > 1").drop("c2"))
        met = blocks.join(cores, (F.col("anchor") == F.col("a")) & (F.col("block") == F.col("b")) & (F.col("core") == F.col("k")))
        met = met.join(whole, (F.col("anchor") == F.col("a2")) & (F.col("block") == F.col("b2")) & (F.col("span") == F.col("k2")), "left")
        met = stored(met.select("anchor", "digest", "block", "lo", "hi", F.col("p").isNotNull().alias("other"), (place != F.col("p")).alias("later")))
        parts.append(met.filter("other").select("anchor", "digest", "lo", "hi", F.coalesce("later", F.lit(False)).alias("later")))
        if size > 1:
            step = SIZES[SIZES.index(size) + 1]
            share = size // step
            inner = F.sequence(F.col("block") * share, F.col("block") * share + F.lit(share - 1))
            # the children that the run has windows in
            left = met.filter(~F.coalesce("later", F.lit(False))).groupBy(F.col("anchor").alias("a"), F.col("digest").alias("d"))
            todo = left.agg(F.flatten(F.collect_list(inner)).alias("wanted"))
    every = parts[0]
    for part in parts[1:]:
        every = every.unionByName(part)

    def ranges(c: F.Column) -> F.Column:
        return F.flatten(F.collect_list(F.when(c, F.array("lo", "hi"))))

    return every.groupBy("anchor", "digest").agg(ranges(F.col("later")).alias("earlier"), ranges(F.lit(True)).alias("other"))


def repeated(texts: DataFrame, length: int = LENGTH, keep_first: bool = True, block: int = BLOCK) -> DataFrame:
    """(row, windows): ranges [start, end) of windows with an earlier copy, or of all with any copy. texts: (row, text), stored."""
    runs = stored(find_runs(texts, length))
    place = F.struct("row", "first")
    anchors = runs.groupBy(F.col("anchor").alias("a")).agg(
        F.count("*").alias("c"), F.min("digest").alias("d0"), F.max("digest").alias("d1"), F.min(place).alias("p0")
    )
    # written, so that both sides of the joins below are plain shuffles, whose hot keys the adaptive planner splits
    anchors = stored(anchors.filter("c > 1").select("a", (F.col("d0") != F.col("d1")).alias("mixed"), "p0"))
    kept = stored(runs.join(anchors, F.col("anchor") == F.col("a")).drop("a"))

    whole = kept.filter("not mixed")
    if keep_first:
        whole = whole.filter(place != F.col("p0"))
    ranges = F.array(F.lit(0), F.col("n"))
    whole = whole.select("row", "first", ranges.alias("r"))

    mixed = kept.filter("mixed")
    classes = stored(mixed.groupBy("anchor", "digest").agg(F.count("*").alias("c"), F.min(place).alias("p"), F.max("n").alias("n")))
    sizes = classes.groupBy(F.col("anchor").alias("a")).agg((F.sum(F.col("n") + length - 1) > block).alias("big"))
    sizes = stored(sizes)
    wanted = classes.join(sizes, F.col("anchor") == F.col("a")).select("p.row", "p.first", "n", "anchor", "digest", "big")
    cuts = stored(fetch(texts, wanted, length))
    flags = by_suffix_order(cuts.filter("not big"), length).unionByName(by_window_hash(cuts.filter("big"), length))
    named = flags.select(F.col("anchor").alias("a"), F.col("digest").alias("d"), "earlier", "other")
    about = stored(classes.select(F.col("anchor").alias("a"), F.col("digest").alias("d"), "c", "p").join(named, ["a", "d"], "left"))
    both = mixed.join(about, (F.col("anchor") == F.col("a")) & (F.col("digest") == F.col("d")))
    if keep_first:
        r = F.when(place != F.col("p"), ranges).otherwise(F.col("earlier"))
    else:
        r = F.when(F.col("c") > 1, ranges).otherwise(F.col("other"))
    parts = whole.unionByName(both.select("row", "first", r.alias("r"))).filter(F.size("r") > 0)
    # ranges of windows, as places in the document
    placed = parts.select("row", F.transform("r", lambda x: x + F.col("first")).alias("r"))
    return placed.groupBy("row").agg(F.flatten(F.collect_list("r")).alias("windows"))


def remove(docs: DataFrame, length: int = LENGTH, keep_first: bool = True, keep: list[str] | None = None, block: int = BLOCK) -> DataFrame:
    """The columns `keep` of docs, and kept (the remaining bytes), n_bytes, n_removed, n_spans (maximal removed runs)."""
    columns = keep if keep is not None else [c for c in docs.columns if c not in ("kept", "n_bytes", "n_removed", "n_spans")]
    source = numbered(docs.select(F.col("text").cast("string").alias("__text"), *columns), "__row")
    texts = source.select(F.col("__row").alias("row"), F.col("__text").alias("text"))
    found = repeated(texts, length, keep_first, block).withColumnRenamed("row", "to")
    joined = source.join(found, F.col("__row") == F.col("to"), "left").select(*columns, "__text", "windows")
    names = [f.name for f in joined.schema.fields[:-2]]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            left, sizes, gone, spans = [], [], [], []
            for t, w in zip(raw(b.column(b.num_columns - 2)), b.column(b.num_columns - 1).to_pylist()):
                t = t or b""
                cover = np.zeros(len(t) + 1, np.int64)
                if w:
                    np.add.at(cover, np.array(w[::2]), 1)
                    np.add.at(cover, np.array(w[1::2]) + (length - 1), -1)
                cut = _ranges(np.cumsum(cover)[:-1] > 0)
                left.append(b"".join(t[a:e] for a, e in zip([0, *cut[1::2]], [*cut[::2], len(t)])))
                sizes.append(len(t))
                gone.append(len(t) - len(left[-1]))
                spans.append(len(cut) // 2)
            new = [pa.array(left, pa.binary()), *(pa.array(x, pa.int64()) for x in (sizes, gone, spans))]
            yield pa.RecordBatch.from_arrays([*b.columns[:-2], *new], [*names, "kept", "n_bytes", "n_removed", "n_spans"])

    head = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in joined.schema.fields[:-2])
    return joined.mapInArrow(run, f"{head}{', ' if head else ''}kept binary, n_bytes long, n_removed long, n_spans long")

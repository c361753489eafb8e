"""Benchmark decontamination as a prefix-filtered set join.

Both sides are word sequences. A window is `size` consecutive words of a benchmark item, or the whole item where it has
fewer. A window is the set of its shingles, all of which a document must hold, so one of them is a sufficient prefix:
the rarest over all documents. The join goes by this shingle; where in the document it stands and how long the document
is bound the place of the window, and the words there are then compared.

The benchmark's windows are cut into blocks of bounded size; each block is broadcast and meets all documents, once to
count its shingles over the corpus and once to join.

Defined results: a null or empty text has no words and no hits, whichever side it stands on; items without an id hit
words but are not listed; repeated documents are judged one by one, repeated items and windows count once.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from itertools import chain, repeat

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from eventlake.llm.common import raw, words_of

WINDOW = 10
SHINGLE = 3
# windows in a block: what a broadcast and a worker hold, some 10 MB
BLOCK = 50_000


class Block:
    """Windows of one block as word numbers, with their shingles."""

    def __init__(self, rows: list[tuple[bytes, str | None]]):
        by_window: dict[bytes, list[str | None]] = {}
        for window, item in rows:
            by_window.setdefault(window, []).append(item)
        self.items = [[i for i in v if i is not None] for v in by_window.values()]
        texts = [w.split(b" ") for w in by_window]
        self.vocab = {w: i + 1 for i, w in enumerate(dict.fromkeys(chain.from_iterable(texts)))}
        self.base = len(self.vocab) + 1
        self.length = np.array([len(t) for t in texts], np.int64)
        self.words = np.zeros((len(texts), int(self.length.max())), np.int64)
        for i, t in enumerate(texts):
            self.words[i, : len(t)] = [self.vocab[w] for w in t]
        # shingles by window and offset, per shingle size
        self.sizes = sorted({min(SHINGLE, int(n)) for n in self.length})
        self.codes: dict[int, np.ndarray] = {}
        for k in self.sizes:
            own = self.words[np.minimum(self.length, SHINGLE) == k]
            found = [self.shingles(row[row > 0], k) for row in own]
            self.codes[k] = np.unique(np.concatenate(found))

    def numbers(self, words: list[bytes]) -> np.ndarray:
        return np.fromiter(map(self.vocab.get, words, repeat(0)), np.int64, len(words))

    def shingles(self, ids: np.ndarray, k: int) -> np.ndarray:
        """Code of the k words from each position; below 0 where one is no benchmark word."""
        n = len(ids) - k + 1
        if n <= 0:
            return np.zeros(0, np.int64)
        out, known = ids[:n].copy(), ids[:n] > 0
        for j in range(1, k):
            out = out * self.base + ids[j : n + j]
            known &= ids[j : n + j] > 0
        return np.where(known, out, -1)

    def found(self, ids: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
        """Positions whose shingle some window holds, and which one."""
        code, keys = self.shingles(ids, k), self.codes[k]
        at = np.flatnonzero(code >= 0)
        slot = np.searchsorted(keys, code[at])
        ok = (slot < len(keys)) & (keys[np.minimum(slot, len(keys) - 1)] == code[at])
        return at[ok], slot[ok]


class Prefixes:
    """For each shingle the windows of which it is the rarest, and where in them it stands."""

    def __init__(self, block: Block, counts: dict[tuple[int, int], int]):
        self.post: dict[int, tuple[np.ndarray, np.ndarray, np.ndarray]] = {}
        for k in block.sizes:
            slots, windows, offsets = [], [], []
            for w in np.flatnonzero(np.minimum(block.length, SHINGLE) == k):
                row = block.words[w, : block.length[w]]
                slot = np.searchsorted(block.codes[k], block.shingles(row, k))
                off = min(range(len(slot)), key=lambda j: (counts.get((k, int(slot[j])), 0), j))
                slots.append(slot[off])
                windows.append(w)
                offsets.append(off)
            order = np.argsort(slots, kind="stable")
            bounds = np.searchsorted(np.array(slots)[order], np.arange(len(block.codes[k]) + 1))
            self.post[k] = (bounds, np.array(windows)[order], np.array(offsets)[order])


def occurrences(block: Block, prefixes: Prefixes, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and windows of all window occurrences in a document."""
    starts, windows = [], []
    for k in block.sizes:
        at, slot = block.found(ids, k)
        bounds, owners, offsets = prefixes.post[k]
        n = bounds[slot + 1] - bounds[slot]
        if not n.sum():
            continue
        which = np.repeat(bounds[slot], n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
        start, window = np.repeat(at, n) - offsets[which], owners[which]
        fits = (start >= 0) & (start + block.length[window] <= len(ids))
        start, window = start[fits], window[fits]
        same = np.ones(len(start), bool)
        for j in range(block.words.shape[1]):
            inside = j < block.length[window]
            same &= ~inside | (ids[np.minimum(start + j, len(ids) - 1)] == block.words[window, j])
        starts.append(start[same])
        windows.append(window[same])
    if not starts:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    return np.concatenate(starts), np.concatenate(windows)


def item_windows(benchmark: DataFrame, size: int = WINDOW) -> DataFrame:
    """Distinct (window, item): words joined by blanks, and the item's id as text."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            windows, items = [], []
            for text, item in zip(raw(b.column(0)), b.column(1).to_pylist()):
                words = words_of(text or b"")
                for i in range(max(1, len(words) - size + 1) if words else 0):
                    windows.append(b" ".join(words[i : i + size]))
                    items.append(item)
            yield pa.RecordBatch.from_arrays([pa.array(windows, pa.binary()), pa.array(items, pa.string())], ["w", "item"])

    rows = benchmark.select(F.col("text").cast("string"), F.col("item_id").cast("string").alias("item"))
    return rows.mapInArrow(cut, "w binary, item string").distinct()


def blocks_of(windows: DataFrame, block: int = BLOCK) -> Iterator[Block]:
    n = max(1, math.ceil(windows.count() / block))
    for i in range(n):
        rows = windows.filter(F.pmod(F.xxhash64("w"), F.lit(n)) == i).toLocalIterator()
        if got := [(bytes(r.w), r.item) for r in rows]:
            yield Block(got)


def shingle_counts(docs: DataFrame, block: Block, text: str = "text") -> dict[tuple[int, int], int]:
    """How often each shingle of the block occurs in the corpus; as many rows as the block has shingles at most."""
    shared = docs.sparkSession.sparkContext.broadcast(block)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = shared.value
        sums = {k: np.zeros(len(own.codes[k]), np.int64) for k in own.sizes}
        for b in batches:
            for t in raw(b.column(0)):
                ids = own.numbers(words_of(t or b""))
                for k in own.sizes:
                    slot = own.found(ids, k)[1]
                    if len(slot):
                        sums[k] += np.bincount(slot, minlength=len(sums[k]))
        for k, v in sums.items():
            at = np.flatnonzero(v)
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(at), k, np.int32)), pa.array(at), pa.array(v[at])], ["k", "slot", "n"])

    parts = docs.select(F.col(text).cast("string")).mapInArrow(count, "k int, slot long, n long")
    return {(r.k, r.slot): r.n for r in parts.groupBy("k", "slot").agg(F.sum("n").alias("n")).toLocalIterator()}


def mark(docs: DataFrame, benchmark: DataFrame, text: str = "text", prefix: str = "", block: int = BLOCK) -> DataFrame:
    """docs with n_words, hits (disjoint [start, end) word ranges, flat), n_hit and items (ids as text, sorted).

    `prefix` goes before the four new names; columns of docs that have these names are replaced.
    """
    out = docs.drop(*(prefix + n for n in ("n_words", "hits", "n_hit", "items"))).select(
        "*",
        F.lit(0).cast("long").alias(f"{prefix}n_words"),
        F.array().cast("array<long>").alias(f"{prefix}hits"),
        F.lit(0).cast("long").alias(f"{prefix}n_hit"),
        F.array().cast("array<string>").alias(f"{prefix}items"),
    )
    share = docs.sparkSession.sparkContext.broadcast
    none = True
    for own in blocks_of(item_windows(benchmark), block):
        out = _join(out, share((own, Prefixes(own, shingle_counts(docs, own, text)))), text, prefix)
        none = False
    return _join(out, share(None), text, prefix) if none else out


def _join(out: DataFrame, shared: Broadcast, text: str, prefix: str) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        got = shared.value
        for b in batches:
            cols = {n: b.column(i) for i, n in enumerate(b.schema.names)}
            n_words, hits, n_hit, items = [], [], [], []
            for t, old, named in zip(raw(cols[text]), cols[f"{prefix}hits"].to_pylist(), cols[f"{prefix}items"].to_pylist()):
                words = words_of(t or b"")
                edge = np.zeros(len(words) + 1, np.int64)
                if old:
                    np.add.at(edge, old[::2], 1)
                    np.add.at(edge, old[1::2], -1)
                if got is not None and words:
                    block, prefixes = got
                    start, window = occurrences(block, prefixes, block.numbers(words))
                    if len(start):
                        np.add.at(edge, start, 1)
                        np.add.at(edge, start + block.length[window], -1)
                        named = sorted({*named, *(i for w in set(window.tolist()) for i in block.items[w])})
                covered = np.concatenate([[0], (np.cumsum(edge)[:-1] > 0).astype(np.int8), [0]])
                turns = np.flatnonzero(np.diff(covered))
                n_words.append(len(words))
                hits.append(turns)
                n_hit.append(int((turns[1::2] - turns[::2]).sum()))
                items.append(named)
            new = {
                "n_words": pa.array(n_words, pa.int64()),
                "hits": pa.array(hits, pa.list_(pa.int64())),
                "n_hit": pa.array(n_hit, pa.int64()),
                "items": pa.array(items, pa.list_(pa.string())),
            }
            yield pa.RecordBatch.from_arrays([new.get(n.removeprefix(prefix) if n.startswith(prefix) else None, c) for n, c in cols.items()], list(cols))

    return out.mapInArrow(run, T.StructType(out.schema.fields))


def clean(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The documents that hold no window of the benchmark, with their own columns."""
    marked = mark(docs.withColumn("__text", F.col("text").cast("string")), benchmark, "__text", "__d_")
    return marked.filter(F.col("__d_n_hit") == 0).select(*docs.columns)

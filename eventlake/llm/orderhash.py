"""Near-duplicates by order MinHash.

A document is the sequence of its five-word shingles (the whole text, where it has fewer words); a repeated shingle is
labelled with its occurrence. For each of `SKETCHES` hash functions the `PICKS` smallest labelled shingles are taken and
kept in text order; their hash is a bucket. Two texts meet in a bucket if they share these shingles and their order, which
follows edit similarity. At similarity 0.8 an entry is shared with probability 0.8^3, and all 16 are missed in about 1 of
100 000 pairs.

Texts of equal words are one node from the start. In a bucket all nodes are first compared with its hub, the node whose
buckets are fullest (the centre of a family of copies, not a random member), so a bucket of n nodes costs n comparisons.
Where the other nodes of a bucket are not all in one component then, every two of them that lie in different components are
decided in that bucket: it is cut into blocks of bounded size, pairs of blocks count the shingles that their texts have in
common, and pairs that can reach the threshold are aligned. So all pairs that share a bucket are decided, directly or by
their component; no bucket is capped, and nothing ends early.

A comparison aligns the two sequences of distinct shingles inside the band that the threshold leaves: M shingles matched
in order, of n and m, are a link if M / (n + m - M) >= 0.8. As shingles in a sequence are distinct, the alignment is a
longest increasing subsequence.

Defined results: texts without words are alone in their class; ids may be null (they name a class only if all its ids are
null) or repeat. Documents are stored once with a number for each row, by which the steps meet again.
"""

from __future__ import annotations

from bisect import bisect_left
from collections.abc import Iterator
from hashlib import blake2b

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from xxhash import xxh3_64_intdigest

from eventlake.llm.common import numbered, raw, stored, words_of
from eventlake.llm.components import components

WORDS = 5
SKETCHES = 16
PICKS = 3
# bytes of a block of nodes, and what a node counts for at least
BLOCK, LEAST = 2_000_000, 2_000
# threshold 0.8 of M / (n + m - M), as 9 M >= 4 (n + m)
_PART, _WHOLE = 9, 4
_C = np.uint64(0x9E3779B97F4A7C15)
_D = np.uint64(0xD6E8FEB86659FD93)
_SEEDS = (np.arange(1, SKETCHES + 1, dtype=np.uint64) * np.uint64(0xA0761D6478BD642F))[:, None]


def shingles(words: list[bytes]) -> np.ndarray:
    """Hashes of the five-word shingles in text order."""
    h = np.fromiter(map(xxh3_64_intdigest, words), np.uint64, len(words))
    n = max(1, len(h) - WORDS + 1)
    out = np.zeros(n, np.uint64)
    for j in range(min(WORDS, len(h))):
        out = (out + h[j : n + j]) * _C
        out ^= out >> np.uint64(31)
    return out


def labelled(s: np.ndarray) -> np.ndarray:
    """Shingles made distinct by their occurrence number."""
    order = np.argsort(s, kind="stable")
    own = s[order]
    first = np.concatenate([[True], own[1:] != own[:-1]])
    if first.all():
        return s
    at = np.arange(len(s))
    seen = at - np.maximum.accumulate(np.where(first, at, 0))
    out = np.empty_like(s)
    out[order] = own + seen.astype(np.uint64) * _D
    return out


def sketch(words: list[bytes]) -> list[int]:
    """A bucket for each hash function."""
    x = labelled(shingles(words))
    picked = []
    step = max(1, 2_000_000 // len(x))
    for i in range(0, SKETCHES, step):
        h = (x + _SEEDS[i : i + step]) * _D
        h ^= h >> np.uint64(32)
        h *= _C
        if len(x) > PICKS:
            picked.append(np.sort(np.argpartition(h, PICKS - 1, axis=1)[:, :PICKS], axis=1))
        else:
            picked.append(np.tile(np.arange(len(x)), (len(h), 1)))
    at = np.concatenate(picked)
    out = _SEEDS[:, 0].copy()
    for j in range(at.shape[1]):
        out = (out ^ x[at[:, j]]) * _C
        out ^= out >> np.uint64(29)
    return out.view(np.int64).tolist()


def distinct(s: np.ndarray) -> np.ndarray:
    """The distinct shingles in order of their first occurrence."""
    return s[np.sort(np.unique(s, return_index=True)[1])]


def similar(a: np.ndarray, b: np.ndarray) -> bool:
    """Whether the banded alignment of two sequences of distinct shingles reaches the threshold."""
    n, m = len(a), len(b)
    least = -(-_WHOLE * (n + m) // _PART)
    if min(n, m) < least:
        return False
    _, i, j = np.intersect1d(a, b, assume_unique=True, return_indices=True)
    near = np.abs(i - j) <= n + m - 2 * least
    i, j = i[near], j[near]
    if len(i) < least:
        return False
    j = j[np.argsort(i)]
    if (np.diff(j) > 0).all():
        return True
    tails: list[int] = []
    for x in j.tolist():
        k = bisect_left(tails, x)
        if k == len(tails):
            tails.append(x)
        else:
            tails[k] = x
    return len(tails) >= least


def sketches(docs: DataFrame) -> DataFrame:
    """(row, doc_id, node, buckets) of (row, doc_id, text): node is the digest of the words, null where there are none."""
    rows = docs.select("row", "doc_id", F.col("text").cast("string").alias("text"))
    kind = rows.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            nodes, buckets = [], []
            for t in raw(b.column(2)):
                words = words_of(t or b"")
                nodes.append(blake2b(b" ".join(words), digest_size=16).digest() if words else None)
                buckets.append(sketch(words) if words else None)
            cols = [b.column(0), b.column(1), pa.array(nodes, pa.binary()), pa.array(buckets, pa.list_(pa.int64()))]
            yield pa.RecordBatch.from_arrays(cols, ["row", "doc_id", "node", "buckets"])

    return rows.mapInArrow(run, f"row long, doc_id {kind}, node binary, buckets array<long>")


def verified(pairs: DataFrame, texts: DataFrame) -> DataFrame:
    """pairs (a, b) with ok. texts: (node, text). Pairs come sorted by a, whose shingles are made once per stretch."""
    left = texts.select(F.col("node").alias("na"), F.col("text").alias("ta"))
    right = texts.select(F.col("node").alias("nb"), F.col("text").alias("tb"))
    both = pairs.join(right, F.col("b") == F.col("nb")).join(left, F.col("a") == F.col("na")).select("a", "b", "ta", "tb")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, own = None, None
        for batch in batches:
            ok = []
            for a, ta, tb in zip(batch.column(0).to_pylist(), raw(batch.column(2)), raw(batch.column(3))):
                if a != last:
                    last, own = a, distinct(shingles(words_of(ta)))
                ok.append(similar(own, distinct(shingles(words_of(tb)))))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(ok)], ["a", "b", "ok"])

    return both.mapInArrow(run, "a binary, b binary, ok boolean")


def _in_common(a: list[np.ndarray], b: list[np.ndarray]) -> np.ndarray:
    """For every two sequences of distinct shingles, how many they have in common."""
    sides = []
    vocabulary = np.intersect1d(np.concatenate(a), np.concatenate(b))
    out = np.zeros(len(a) * len(b), np.int64)
    if not len(vocabulary):
        return out.reshape(len(a), len(b))
    for texts in (a, b):
        row = np.repeat(np.arange(len(texts)), [len(x) for x in texts])
        value = np.concatenate(texts)
        column = np.minimum(np.searchsorted(vocabulary, value), len(vocabulary) - 1)
        both = vocabulary[column] == value
        order = np.argsort(column[both], kind="stable")
        column, row = column[both][order], row[both][order]
        sides.append((row, column, np.bincount(column, minlength=len(vocabulary))))
    (row_a, col_a, n_a), (row_b, col_b, n_b) = sides
    # shingles of many texts by matrix products, the others by their pairs
    often = n_a * n_b * 64 > len(a) * len(b)
    number = np.cumsum(often) - 1
    for lo in range(0, int(often.sum()), 1_024):
        dense = []
        for texts, row, column in ((a, row_a, col_a), (b, row_b, col_b)):
            some = often[column] & (number[column] >= lo) & (number[column] < lo + 1_024)
            m = np.zeros((len(texts), 1_024), np.float32)
            m[row[some], number[column[some]] - lo] = 1
            dense.append(m)
        out += (dense[0] @ dense[1].T).astype(np.int64).ravel()
    start = np.cumsum(n_b) - n_b
    row_a, col_a = row_a[~often[col_a]], col_a[~often[col_a]]
    times = np.cumsum(n_b[col_a])
    lo = 0
    while lo < len(row_a):
        hi = max(lo + 1, int(np.searchsorted(times, (times[lo - 1] if lo else 0) + 4_000_000, "right")))
        n = n_b[col_a[lo:hi]]
        inner = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
        out += np.bincount(np.repeat(row_a[lo:hi], n) * len(b) + row_b[np.repeat(start[col_a[lo:hi]], n) + inner], minlength=len(out))
        lo = hi
    return out.reshape(len(a), len(b))


def _decided(group: pa.Table) -> pa.Table:
    """Links (a, b) between two blocks, or inside one; pairs that are joined already, or meanwhile, are not compared."""
    side, node, label = (group.column(c).to_pylist() for c in ("side", "node", "label"))
    texts = [distinct(shingles(words_of(t))) for t in raw(group.column("text").combine_chunks())]
    left = [i for i, x in enumerate(side) if x == 0]
    right = [i for i, x in enumerate(side) if x == 1] or left
    names = {x: i for i, x in enumerate(dict.fromkeys(label))}
    own = np.array([names[x] for x in label])
    n, m = (np.array([len(texts[i]) for i in x])[:, None] for x in (left, right))
    may = (_in_common([texts[i] for i in left], [texts[i] for i in right]) * _PART >= _WHOLE * (n + m.T)) & (own[left][:, None] != own[right])
    if right is left:
        may = np.triu(may)
    parent = list(range(len(names)))

    def root(i: int) -> int:
        while parent[i] != i:
            parent[i] = parent[parent[i]]
            i = parent[i]
        return i

    links = []
    for i, j in np.argwhere(may).tolist():
        x, y = left[i], right[j]
        p, q = root(own[x]), root(own[y])
        if p != q and similar(texts[x], texts[y]):
            parent[q] = p
            links.append((node[x], node[y]))
    return pa.table({"a": pa.array([x for x, _ in links], pa.binary()), "b": pa.array([y for _, y in links], pa.binary())})


def _others(members: DataFrame, labels: DataFrame, texts: DataFrame) -> DataFrame:
    """Links (a, b) among the members (bucket, node) of each bucket that are in different components."""
    names = labels.select(F.col("node").alias("x"), F.col("label").alias("l"))
    own = members.join(names, F.col("node") == F.col("x"), "left").select("bucket", "node", F.coalesce("l", "node").alias("label"))
    own = stored(own)
    torn = own.groupBy(F.col("bucket").alias("k")).agg(F.min("label").alias("lo"), F.max("label").alias("hi")).filter("lo != hi")
    own = own.join(stored(torn.select("k")), F.col("bucket") == F.col("k")).drop("k")
    size = texts.select(F.col("node").alias("x"), F.greatest(F.octet_length("text"), F.lit(LEAST)).cast("long").alias("size"))
    own = stored(own.join(size, F.col("node") == F.col("x")).select("bucket", "node", "label", "size"))
    # blocks of a large component hold nothing else and are not compared with each other
    each = stored(own.groupBy(F.col("bucket").alias("k"), F.col("label").alias("l")).agg(F.sum("size").alias("whole")))
    mixed = stored(each.filter(F.col("whole") <= BLOCK).groupBy(F.col("k").alias("j")).agg(F.sum("whole").alias("rest")))
    large = each.filter(F.col("whole") > BLOCK)
    own = own.join(stored(large), (F.col("bucket") == F.col("k")) & (F.col("label") == F.col("l")), "left")
    own = own.join(mixed, F.col("bucket") == F.col("j"), "left")
    blocks = F.ceil(F.coalesce("whole", "rest") / BLOCK)
    block = F.struct(F.coalesce("l", F.lit(b"")).alias("only"), F.pmod(F.xxhash64("node"), blocks).alias("number")).alias("block")
    own = stored(own.select("bucket", "node", "label", block))
    at = stored(own.select(F.col("bucket").alias("k"), F.col("block").alias("p")).distinct())
    other = at.select(F.col("k").alias("j"), F.col("p").alias("q"))
    pairs = at.join(other, F.col("k") == F.col("j")).filter("p < q AND (p.only != q.only OR p.only = X'') OR p = q AND p.only = X''").select("k", "p", "q")
    pairs = pairs.select("k", "p", "q", F.explode(F.when(F.expr("p = q"), F.array(F.lit(0))).otherwise(F.array(F.lit(0), F.lit(1)))).alias("side"))
    pairs = stored(pairs.withColumn("at", F.when(F.col("side") == 0, F.col("p")).otherwise(F.col("q"))))
    met = own.join(pairs, (F.col("bucket") == F.col("k")) & (F.col("block") == F.col("at"))).select("bucket", "p", "q", "side", "node", "label")
    text = texts.select(F.col("node").alias("x"), "text")
    met = met.join(text, F.col("node") == F.col("x")).select("bucket", "p", "q", "side", "node", "label", "text")
    return met.groupBy("bucket", "p", "q").applyInArrow(_decided, "a binary, b binary")


def linked(nodes: DataFrame, texts: DataFrame) -> DataFrame:
    """(node, label): the component of every node with a link. nodes: (node, buckets); texts: (node, text)."""
    own = nodes.select("node", F.explode("buckets").alias("bucket"))
    full = own.groupBy(F.col("bucket").alias("k")).agg(F.count("*").alias("c")).filter("c > 1")
    members = own.join(stored(full), F.col("bucket") == F.col("k")).select("bucket", "node", "c")
    rank = members.groupBy(F.col("node").alias("x")).agg(F.sum("c").alias("rank"))
    members = stored(members.join(rank, F.col("node") == F.col("x")).select("bucket", "node", "rank"))
    hubs = members.groupBy(F.col("bucket").alias("k")).agg(F.max(F.struct("rank", "node")).alias("hub"))
    met = members.join(stored(hubs), F.col("bucket") == F.col("k")).filter("node != hub.node")
    met = stored(met.select("bucket", F.col("hub.node").alias("hub"), "node"))
    pairs = met.select(F.col("hub").alias("a"), F.col("node").alias("b")).distinct()
    links = stored(verified(pairs, texts).filter("ok").select("a", "b"))
    labels = components(links)
    # a hub has met all others of its bucket
    more = stored(_others(met.select("bucket", "node"), labels, texts))
    return labels if more.isEmpty() else components(links.union(more))


def classes(docs: DataFrame) -> DataFrame:
    """(row, doc_id, class_id, first): the class of every row, its smallest id, and the row that stands for it."""
    return _classes(numbered(docs.select("doc_id", "text"), "row"))


def _classes(docs: DataFrame) -> DataFrame:
    """The classes of (row, doc_id, text), stored with its numbers, by which the steps meet again."""
    own = stored(sketches(docs))
    rank = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "row")
    nodes = stored(own.filter("node is not null").groupBy("node").agg(F.min(rank).alias("rep"), F.first("buckets").alias("buckets")))
    all_buckets = nodes.select(F.explode("buckets").alias("bucket"), "node")
    full = all_buckets.groupBy(F.col("bucket").alias("k")).agg(F.count("*").alias("c")).filter("c > 1").select("k")
    members = all_buckets.join(full, F.col("bucket") == F.col("k"), "left_semi").select(F.col("node").alias("n")).distinct()
    shared = stored(nodes.join(members, F.col("node") == F.col("n"), "left_semi"))
    # one text of each node that shares a bucket
    wanted = shared.select("node", F.col("rep.row").alias("to"))
    text = docs.select("row", F.col("text").cast("string").alias("text"))
    texts = stored(text.join(wanted, F.col("row") == F.col("to")).select("node", "text"))
    label = linked(shared.select("node", "buckets"), texts)
    tied = label.join(nodes.select(F.col("node").alias("n"), "rep"), F.col("node") == F.col("n")).select("node", "label", "rep")
    best = tied.groupBy(F.col("label").alias("l")).agg(F.min("rep").alias("best"))
    tied = tied.join(best, F.col("label") == F.col("l")).select(F.col("node").alias("n"), "best")
    rep = nodes.join(tied, F.col("node") == F.col("n"), "left").select(F.col("node").alias("n"), F.coalesce("best", "rep").alias("rep"))
    joined = own.select("row", "doc_id", "node").join(rep, F.col("node") == F.col("n"), "left")
    single = F.col("rep").isNull()
    return joined.select(
        "row",
        "doc_id",
        F.when(single, F.col("doc_id")).otherwise(F.col("rep.doc_id")).alias("class_id"),
        F.when(single, F.col("row")).otherwise(F.col("rep.row")).alias("first"),
    )


def keep_one(docs: DataFrame) -> DataFrame:
    """The document of smallest id of each class, with the columns of docs."""
    source = numbered(docs, "__row")
    stay = _classes(source.select(F.col("__row").alias("row"), "doc_id", "text")).filter("row = first").select(F.col("row").alias("__to"))
    return source.join(stay, F.col("__row") == F.col("__to"), "left_semi").select(*docs.columns)



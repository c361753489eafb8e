"""Exact dedup over a cuckoo-filter index of live digests, with insertion and deletion.

Texts are equal when they agree after white space is deleted; a text is known by the SHA-256 of what is left. The index
is a table of shards. A shard holds a cuckoo filter of 16-bit fingerprints in buckets of four slots and, slot by slot,
the digest that owns the fingerprint and its number of live rows: the content that a hit is verified against. So a hit
of the filter alone never decides; a digest whose fingerprint is only similar is inserted beside the other. Deleting the
last live row of a digest frees its slot. A shard where an insertion finds no slot in `KICKS` moves doubles its buckets
and is filled anew from its own stored digests; when shards hold too much on average, all are dealt anew in the same way.

Arrivals are combined per batch before they are shuffled, so a text that makes up a third of all rows comes as a few rows.
A lookup reads the fingerprints only, and joins nothing but hits with the content. Groups are formed only for digests
with more than one live row; all other rows stand alone without a join partner.

Defined results: a null text is empty; ids may be null (they rank last) or repeat: of rows that agree in length and id
exactly one is kept. Deleting rows that are not live does nothing. An empty table gives no rows.
"""

from __future__ import annotations

import math
from array import array
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from eventlake.llm.common import stored

SLOTS = 4
KICKS = 500
# rows a shard should hold on average, at most
PER_SHARD = 250_000
START_BITS = 10
SPACE = " \t\n\x0b\x0c\r"
DIGEST = 32
_NONE = bytes(DIGEST)
SHARD = "shard int, bits int, slots binary, digests binary, copies binary"


class Filter:
    """A cuckoo filter with the digests behind its fingerprints."""

    def __init__(self, bits: int = START_BITS, slots: bytes = b"", digests: bytes = b"", copies: bytes = b""):
        self.bits = bits
        size = SLOTS << bits
        self.slots = array("H", slots or bytes(2 * size))
        self.digests = [digests[i : i + DIGEST] for i in range(0, len(digests), DIGEST)] if digests else [_NONE] * size
        self.copies = array("q", copies or bytes(8 * size))

    @staticmethod
    def print_of(digest: bytes) -> int:
        return int.from_bytes(digest[:2], "big") or 1

    def buckets(self, digest: bytes) -> tuple[int, int]:
        first = int.from_bytes(digest[2:10], "big") & ((1 << self.bits) - 1)
        return first, self.other(first, self.print_of(digest))

    def other(self, bucket: int, mark: int) -> int:
        """The second bucket of a fingerprint in a bucket; its own inverse."""
        return bucket ^ ((mark * 0x9E3779B97F4A7C15 >> 20) & ((1 << self.bits) - 1))

    def hits(self, digest: bytes) -> list[int]:
        """Slots that hold the fingerprint of a digest in one of its buckets."""
        mark, (a, b) = self.print_of(digest), self.buckets(digest)
        return [j for i in ((a, b) if a != b else (a,)) for j in range(SLOTS * i, SLOTS * i + SLOTS) if self.slots[j] == mark]

    def add(self, digest: bytes, n: int) -> None:
        """n more live rows of a digest; fewer where n is negative."""
        for j in self.hits(digest):
            if self.digests[j] == digest:
                self.copies[j] += n
                if self.copies[j] <= 0:
                    self.slots[j], self.digests[j], self.copies[j] = 0, _NONE, 0
                return
        if n > 0:
            self.place(digest, n)

    def place(self, digest: bytes, n: int) -> None:
        """Put a digest that is not live in a slot, moving others to their second bucket; double the filter if that fails."""
        at = self.buckets(digest)[0]
        for turn in range(KICKS):
            mark = self.print_of(digest)
            for i in (at, self.other(at, mark)):
                for j in range(SLOTS * i, SLOTS * i + SLOTS):
                    if not self.slots[j]:
                        self.slots[j], self.digests[j], self.copies[j] = mark, digest, n
                        return
            # the newcomer takes the place of another, which goes on to its other bucket
            j = SLOTS * self.other(at, mark) + turn * 7 % SLOTS
            held = self.slots[j], self.digests[j], self.copies[j]
            self.slots[j], self.digests[j], self.copies[j] = mark, digest, n
            mark, digest, n = held
            at = self.other(j // SLOTS, mark)
        self.grow(digest, n)

    def grow(self, digest: bytes, n: int) -> None:
        """Twice the buckets, filled from the stored digests."""
        if self.bits > 40:
            raise ValueError("more equal digests than the buckets of a fingerprint can hold")
        live = [(d, c) for d, c in zip(self.digests, self.copies) if c]
        self.__init__(self.bits + 1)
        for d, c in (*live, (digest, n)):
            self.place(d, c)

    def row(self, shard: int) -> tuple:
        return shard, self.bits, self.slots.tobytes(), b"".join(self.digests), self.copies.tobytes()


@dataclass(frozen=True)
class Index:
    """Shards of the filter, and the live rows: digest, doc_id, points (code points of the text), row."""

    shards: DataFrame
    members: DataFrame
    n_shards: int


def digest_of(text: Column) -> Column:
    """SHA-256 of the text without white space, as lower-case hex."""
    return F.sha2(F.translate(F.coalesce(text.cast("string"), F.lit("")), SPACE, "").cast("binary"), 256)


def rows_of(docs: DataFrame) -> DataFrame:
    """digest, doc_id and points of every document."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    return docs.select(F.unhex(digest_of(F.col("text"))).alias("digest"), "doc_id", F.length(text).cast("long").alias("points"))


def _arrivals(rows: DataFrame, sign: int) -> DataFrame:
    """digest and number of its rows, combined per batch."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                count = Counter(b.column(0).to_pylist())
                yield pa.RecordBatch.from_arrays([pa.array(list(count), pa.binary()), pa.array([sign * c for c in count.values()], pa.int64())], ["digest", "n"])

    return rows.select("digest").mapInArrow(run, "digest binary, n long")


def _live(shards: DataFrame) -> DataFrame:
    """digest and n of every live digest of the index."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for digests, copies in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                n = array("q", copies)
                at = [i for i, c in enumerate(n) if c]
                yield pa.RecordBatch.from_arrays([pa.array([digests[DIGEST * i : DIGEST * i + DIGEST] for i in at], pa.binary()), pa.array([n[i] for i in at], pa.int64())], ["digest", "n"])

    return shards.select("digests", "copies").mapInArrow(run, "digest binary, n long")


def _shard_of(digest: Column, n_shards: int) -> Column:
    return F.pmod(F.xxhash64(digest), F.lit(n_shards)).cast("int")


def _merge(old: DataFrame | None, arrivals: DataFrame, n_shards: int) -> DataFrame:
    """The shards after arrivals (digest, n): rows of a shard stream through its filter, the filter first."""
    rows = arrivals.select(_shard_of(F.col("digest"), n_shards).alias("shard"), "digest", "n")
    if old is not None:
        rows = rows.unionByName(old, allowMissingColumns=True)
    else:
        rows = rows.select("*", *(F.lit(None).cast(k).alias(c) for c, k in (x.split() for x in SHARD.split(", ")[1:])))
    rows = rows.select("shard", "digest", "n", "bits", "slots", "digests", "copies")
    dealt = rows.repartition("shard").sortWithinPartitions("shard", F.col("bits").isNull())

    def emit(shard: int, own: Filter) -> pa.RecordBatch:
        kinds = [pa.int32(), pa.int32(), pa.binary(), pa.binary(), pa.binary()]
        return pa.RecordBatch.from_arrays([pa.array([v], k) for v, k in zip(own.row(shard), kinds)], [x.split()[0] for x in SHARD.split(", ")])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, own = None, Filter()
        for b in batches:
            for shard, digest, n, *state in zip(*(c.to_pylist() for c in b.columns)):
                if shard != at:
                    if at is not None:
                        yield emit(at, own)
                    at, own = shard, Filter()
                if digest is None:
                    own = Filter(*state)
                else:
                    own.add(digest, n)
        if at is not None:
            yield emit(at, own)

    return stored(dealt.mapInArrow(run, SHARD))


def insert(index: Index | None, docs: DataFrame, per_shard: int = PER_SHARD) -> Index:
    """The index with the rows of docs (doc_id, text) besides."""
    rows = rows_of(docs)
    if index is None:
        members = stored(rows.withColumn("row", F.monotonically_increasing_id()))
        n_shards = max(1, math.ceil(members.count() / per_shard))
        return Index(_merge(None, _arrivals(members, 1), n_shards), members, n_shards)
    new = stored(rows)
    # row numbers are dealt again over old and new rows
    members = stored(index.members.drop("row").unionByName(new).withColumn("row", F.monotonically_increasing_id()))
    wanted = math.ceil(members.count() / per_shard)
    if wanted > 2 * index.n_shards:
        return Index(_merge(None, _live(index.shards).unionByName(_arrivals(new, 1)), wanted), members, wanted)
    return Index(_merge(index.shards, _arrivals(new, 1), index.n_shards), members, index.n_shards)


def delete(index: Index, docs: DataFrame) -> Index:
    """The index without the live rows of the same doc_id and text as rows of docs."""
    gone = rows_of(docs).select("digest", F.col("doc_id").alias("gone_id")).distinct()
    on = (F.col("digest") == F.col("gone_digest")) & F.col("doc_id").eqNullSafe(F.col("gone_id"))
    marked = gone.withColumnRenamed("digest", "gone_digest")
    leaving = stored(index.members.join(marked, on, "left_semi"))
    members = stored(index.members.join(marked, on, "left_anti"))
    return Index(_merge(index.shards, _arrivals(leaving, -1), index.n_shards), members, index.n_shards)


def lookup(index: Index, docs: DataFrame) -> DataFrame:
    """docs with `live`: whether a text equal to theirs is in the index.

    Fingerprints say which rows may be; only those meet the stored digests.
    """
    keyed = docs.drop("live", "__row", "__digest").withColumn("__row", F.monotonically_increasing_id())
    keyed = stored(keyed.withColumn("__digest", F.unhex(digest_of(F.col("text")))))
    asked = keyed.select(_shard_of(F.col("__digest"), index.n_shards).alias("shard"), F.col("__digest").alias("digest")).distinct()
    both = asked.unionByName(index.shards.select("shard", "bits", "slots"), allowMissingColumns=True).select("shard", "digest", "bits", "slots")
    dealt = both.repartition("shard").sortWithinPartitions("shard", F.col("bits").isNull())

    def probe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, own = None, None
        for b in batches:
            found = []
            for shard, digest, bits, slots in zip(*(c.to_pylist() for c in b.columns)):
                if digest is None:
                    at, own = shard, Filter.__new__(Filter)
                    own.bits, own.slots = bits, array("H", slots)
                elif shard == at and own.hits(digest):
                    found.append(digest)
            yield pa.RecordBatch.from_arrays([pa.array(found, pa.binary())], ["digest"])

    hits = dealt.mapInArrow(probe, "digest binary")
    verified = hits.join(_live(index.shards).select("digest"), "digest", "left_semi").select(F.col("digest").alias("__known"), F.lit(True).alias("live"))
    joined = keyed.join(verified, F.col("__digest") == F.col("__known"), "left")
    return joined.withColumn("live", F.coalesce("live", F.lit(False))).drop("__row", "__digest", "__known")


def classes(index: Index) -> DataFrame:
    """digest, doc_id, row, keep_id, group_size and kept of every live row: the longest of a group stays, then the smallest id."""
    repeated = _live(index.shards).filter("n > 1").select(F.col("digest").alias("twice"))
    again = index.members.join(repeated, F.col("digest") == F.col("twice"), "left_semi")
    # the first in this order stays
    rank = F.struct((-F.col("points")).alias("points"), F.col("doc_id").isNull().alias("last"), "doc_id", "row")
    groups = again.groupBy(F.col("digest").alias("of")).agg(F.min(rank).alias("first"), F.count("*").alias("size"))
    joined = index.members.join(groups, F.col("digest") == F.col("of"), "left")
    alone = F.col("of").isNull()
    return joined.select(
        "digest",
        "doc_id",
        "row",
        F.when(alone, F.col("doc_id")).otherwise(F.col("first.doc_id")).alias("keep_id"),
        F.coalesce("size", F.lit(1)).cast("long").alias("group_size"),
        (alone | (F.col("first.row") == F.col("row"))).alias("kept"),
    )

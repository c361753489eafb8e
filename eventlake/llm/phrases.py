"""Phrase collocation mining with one FM-index per shard of the corpus.

A text is cut into pieces at punctuation, and pieces into words. Documents are dealt into shards of about `SHARD` words of
one language. Word counts are summed first; words rarer than `least` end a piece, as no phrase with one can be frequent.
Each shard then holds its text as word ids and has two Burrows-Wheeler transforms, of the text and of its reverse, sorted
by the first `DEPTH` words, which is all that patterns up to that length need. A phrase is an interval in both; prepending
or appending a word is one step of interval extension that gives the counts of all extensions at once.

Phrases grow a word at a time, on the left and on the right by turns. In a round a shard finds its own survivors of the
round before by backward search, extends them, and keeps an extension only if its other end is a survivor too. Counts are
summed over shards by key, phrases below `least` go, and the rest returns to the shards that hold it. So counts are exact
and what is shuffled are phrases whose parts are all frequent. Counts and keys move as packed blocks, one per shard and part.

Defined results: a null text is empty, a null language is `und`; ids and other columns are not looked at; repeated rows
count as often as they stand there; an empty table gives no phrases, a language without words no total.
"""

from __future__ import annotations

from array import array
from collections.abc import Iterator
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from eventlake.llm.common import raw, stored

LEAST = 100
DEPTH = 5
# words in a shard
SHARD = 1_000_000
# lower-cased letters; punctuation and line ends end a piece; tabs are blanks
_TABLE = bytes(b + 32 if 65 <= b <= 90 else 10 if b in b".,;:!?\n\x0b\x0c\r" else 32 if b == 9 else b for b in range(256))


def pack(values: np.ndarray, kind: str = "<i8") -> bytes:
    return pa.compress(np.ascontiguousarray(values, dtype=kind).tobytes(), codec="zstd", asbytes=True)


def unpack(blob: bytes, n: int, kind: str = "<i8") -> np.ndarray:
    width = np.dtype(kind).itemsize
    return np.frombuffer(pa.decompress(blob, n * width, codec="zstd", asbytes=True), dtype=kind)


class Vocabulary(dict):
    """Numbers words from 1 as they come."""

    def __missing__(self, word: bytes) -> int:
        self[word] = n = len(self) + 1
        return n


def shards(docs: DataFrame, size: int = SHARD) -> DataFrame:
    """shard, lang, n (places), ids (packed word numbers, 0 between pieces), words and counts by number."""

    def emit(shard: int, lang: str, known: Vocabulary, ids: array) -> pa.RecordBatch:
        seen = np.frombuffer(ids, np.int32)
        counts = np.bincount(seen, minlength=len(known) + 1)[1:]
        words = pa.array(list(known), pa.binary()).cast(pa.string())
        cols = [[shard], [lang], [len(seen)], [pack(seen, "<i4")]]
        kinds = [pa.int64(), pa.string(), pa.int64(), pa.binary()]
        lists = [pa.ListArray.from_arrays([0, len(words)], words), pa.ListArray.from_arrays([0, len(words)], pa.array(counts, pa.int64()))]
        return pa.RecordBatch.from_arrays([*(pa.array(c, k) for c, k in zip(cols, kinds)), *lists], ["shard", "lang", "n", "ids", "words", "counts"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = TaskContext.get().partitionId() << 32
        open_: dict[str, tuple[Vocabulary, array]] = {}
        held = 0
        for b in batches:
            for lang, text in zip(b.column(0).to_pylist(), raw(b.column(1))):
                if lang not in open_:
                    open_[lang] = Vocabulary(), array("i", [0])
                known, ids = open_[lang]
                before, number_of = len(ids), known.__getitem__
                for piece in text.translate(_TABLE).split(b"\n"):
                    if words := piece.split():
                        ids.extend(map(number_of, words))
                        ids.append(0)
                held += len(ids) - before
                # a shard that is full goes out; so does the largest of many languages before they add up
                if len(ids) > size or held > 2 * size:
                    full = lang if len(ids) > size else max(open_, key=lambda x: len(open_[x][1]))
                    yield emit(number, full, *open_[full])
                    held -= len(open_.pop(full)[1])
                    number += 1
        for lang, (known, ids) in open_.items():
            if known:
                yield emit(number, lang, known, ids)
                number += 1

    lang = F.coalesce(F.col("lang").cast("string"), F.lit("und")).alias("lang")
    rows = docs.select(lang, F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    return stored(rows.mapInArrow(run, "shard long, lang string, n long, ids binary, words array<string>, counts array<long>"))


# ---- the index of a shard


def transform(s: np.ndarray) -> np.ndarray:
    """Burrows-Wheeler transform of a cyclic sequence whose rotations are sorted by their first DEPTH symbols at least."""
    n = len(s)
    rank, reach = s.astype(np.int64), 1
    while reach < DEPTH:
        step = min(reach, DEPTH - reach)
        key = rank * (int(rank.max()) + 1) + np.roll(rank, -step)
        order = np.argsort(key, kind="stable")
        new = key[order]
        rank = np.empty(n, np.int64)
        rank[order] = np.concatenate([[0], np.cumsum(new[1:] != new[:-1])])
        reach += step
    return s[np.argsort(rank, kind="stable") - 1]


class Side:
    """One transform with what interval extension needs: the place of each row's symbol in the first column."""

    def __init__(self, bwt: np.ndarray, symbols: int):
        self.bwt = bwt
        self.order = np.argsort(bwt, kind="stable")
        self.first = np.concatenate([[0], np.cumsum(np.bincount(bwt, minlength=symbols))])
        self.to = np.empty(len(bwt), np.int64)
        self.to[self.order] = np.arange(len(bwt))
        # rows by symbol and then by place: the ranks of a symbol are found by one search
        self.ranks = bwt[self.order].astype(np.int64) * (len(bwt) + 1) + self.order

    def before(self, symbol: np.ndarray, at: np.ndarray) -> np.ndarray:
        """Place in the first column of the first of a symbol's rows from `at` on."""
        return np.searchsorted(self.ranks, symbol.astype(np.int64) * (len(self.bwt) + 1) + at)


def _rows(lo: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """All rows of intervals, and which interval each is of."""
    of = np.repeat(np.arange(len(lo)), size)
    return np.arange(len(of)) + np.repeat(lo - (np.cumsum(size) - size), size), of


def search(left: Side, phrases: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Interval (lo, size) of each phrase, a row of symbols, by backward search; in reverse phrases for the other side."""
    lo, hi = left.first[phrases[:, -1]], left.first[phrases[:, -1] + 1]
    for j in range(phrases.shape[1] - 2, -1, -1):
        lo, hi = left.before(phrases[:, j], lo), left.before(phrases[:, j], hi)
    return lo, hi - lo


def extend(side: Side, lo: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, ...]:
    """Every extension of intervals on one side: (interval it is of, symbol, lo, size)."""
    rows, of = _rows(lo, size)
    symbol = side.bwt[rows].astype(np.int64)
    order = np.argsort(of * np.int64(len(side.first)) + symbol, kind="stable")
    rows, of, symbol = rows[order], of[order], symbol[order]
    cuts = np.flatnonzero(np.concatenate([[True], (of[1:] != of[:-1]) | (symbol[1:] != symbol[:-1]), [True]])) if len(of) else np.zeros(1, np.int64)
    new = cuts[:-1]
    out = of[new], symbol[new], side.to[rows[new]], np.diff(cuts)
    return tuple(x[symbol[new] > 0] for x in out)


def holds(lo: np.ndarray, size: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Whether places lie in one of the given disjoint intervals."""
    order = np.argsort(lo)
    where = np.searchsorted(lo[order], at, "right") - 1
    return (where >= 0) & (at < (lo[order] + size[order])[where])


def symbols_of(ids: np.ndarray, known: np.ndarray) -> tuple[np.ndarray, np.ndarray] | None:
    """(global id of each symbol, text as symbols) with rare words as ends of pieces.

    known: for each word number its global id, or -1.
    """
    frequent = np.unique(known[known >= 0])
    symbol = np.where(known >= 0, np.searchsorted(frequent, known) + 1, 0)
    s = symbol[ids]
    # ends of pieces in a row, and words that stand alone between them, are of no use
    s = np.where((np.roll(s, 1) == 0) & (np.roll(s, -1) == 0), 0, s)
    s = s[(s > 0) | (np.roll(s, 1) > 0)]
    if not s.any():
        return None
    s = np.append(s, 0) if s[-1] else s
    return np.concatenate([[-1], frequent]), s


class Shard:
    """A shard's text; the index of a side is made when that side is extended, which is cheaper than to move it about."""

    def __init__(self, words: np.ndarray, text: np.ndarray):
        self.words, self.text = words, text

    def side(self, on_left: bool) -> Side:
        return Side(transform(self.text if on_left else self.text[::-1]), len(self.words))

    def grown(self, phrases: np.ndarray | None, on_left: bool) -> tuple[np.ndarray, np.ndarray]:
        """Extensions (symbols, counts) of survivors; of all words where phrases is None."""
        if phrases is None:
            phrases = np.arange(1, len(self.words))[:, None]
        side = self.side(on_left)
        lo, size = search(side, phrases if on_left else phrases[:, ::-1])
        of, symbol, at, count = extend(side, lo, size)
        # what the extension begins with, read from its own side, has to be a survivor as well
        if phrases.shape[1] > 1:
            real = holds(lo, size, at)
            of, symbol, count = of[real], symbol[real], count[real]
        grown = (symbol[:, None], phrases[of]) if on_left else (phrases[of], symbol[:, None])
        return np.concatenate(grown, 1), count


# ---- rounds over all shards

INDEX = "shard long, lang string, n long, wide boolean, symbols long, words binary, text binary"
WORDS = "shard long, lang string, part int, n long, words binary, at binary, counts binary"
KNOWN = "shard long, lang string, part int, n long, words binary, at binary, ids binary, counts binary"
GROWN = "shard long, lang string, part int, n long, phrases binary, counts binary"
KEPT = "shard long, lang string, part int, n long, phrases binary, counts binary, sums boolean"
_KINDS = {"long": pa.int64(), "int": pa.int32(), "string": pa.string(), "binary": pa.binary(), "boolean": pa.bool_()}


def _table(rows: list[tuple], schema: str) -> pa.Table:
    fields = [x.split() for x in schema.split(", ")]
    return pa.Table.from_arrays([pa.array([r[i] for r in rows], _KINDS[k]) for i, (_, k) in enumerate(fields)], [n for n, _ in fields])


def _cuts(keys: np.ndarray) -> list[tuple[int, int]]:
    """Stretches of equal keys in a sorted array."""
    at = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1], [True]])) if len(keys) else np.zeros(1, np.int64)
    return list(zip(at.tolist(), at[1:].tolist()))


def _word_blocks(cut: DataFrame, parts: int) -> DataFrame:
    """The words of each shard with their numbers and counts, in blocks by part."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i in range(b.num_rows):
                words, counts = raw(b.column(2)[i].values), b.column(3)[i].values.to_numpy()
                part = np.array([crc32(w) % parts for w in words])
                order = np.argsort(part, kind="stable")
                out = []
                for lo, hi in _cuts(part[order]):
                    at = order[lo:hi]
                    text = pa.compress(b"\n".join([words[j] for j in at.tolist()]) + b"\n", codec="lz4_raw", asbytes=True)
                    size = sum(len(words[j]) + 1 for j in at.tolist()).to_bytes(8, "little")
                    out.append((b.column(0)[i].as_py(), b.column(1)[i].as_py(), int(part[at[0]]), hi - lo, size + text, pack(at + 1), pack(counts[at])))
                yield from _table(out, WORDS).to_batches()

    return cut.select("shard", "lang", "words", "counts").mapInArrow(run, WORDS)


def _block_words(blob: bytes) -> list[bytes]:
    text = pa.decompress(blob[8:], int.from_bytes(blob[:8], "little"), codec="lz4_raw", asbytes=True)
    return text.split(b"\n")[:-1]


def _known_words(blocks: DataFrame, parts: int, least: int) -> DataFrame:
    """Words whose counts over all shards reach `least`, with ids: a block per language and part, and each shard's own."""

    def add(table: pa.Table) -> pa.Table:
        rows = table.to_pylist()
        of = np.repeat(np.arange(len(rows)), [r["n"] for r in rows])
        words = pa.array([w for r in rows for w in _block_words(r["words"])], pa.binary()).dictionary_encode()
        code = words.indices.to_numpy()
        counts = np.concatenate([unpack(r["counts"], r["n"]) for r in rows])
        total = np.zeros(len(words.dictionary), np.int64)
        np.add.at(total, code, counts)
        good = np.flatnonzero(total >= least)
        id_ = np.full(len(total), -1, np.int64)
        id_[good] = np.arange(len(good)) * parts + rows[0]["part"]
        lang, part, out = rows[0]["lang"], rows[0]["part"], []
        if len(good):
            names = b"\n".join(words.dictionary.take(pa.array(good)).to_pylist())
            out.append((None, lang, part, len(good), names, None, pack(id_[good]), pack(total[good])))
        at = np.concatenate([unpack(r["at"], r["n"]) for r in rows])
        stays = id_[code] >= 0
        of, at, code = of[stays], at[stays], code[stays]
        out += [(rows[of[a]]["shard"], lang, part, b - a, None, pack(at[a:b]), pack(id_[code[a:b]]), None) for a, b in _cuts(of)]
        return _table(out, KNOWN)

    return stored(blocks.groupBy("lang", "part").applyInArrow(add, KNOWN))


def _named(known: DataFrame) -> DataFrame:
    """lang, word, id and f of all frequent words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for lang, n, words, ids, counts in zip(*(c.to_pylist() for c in b.columns)):
                cols = [pa.array([lang] * n, pa.string()), pa.array(words.split(b"\n"), pa.binary()).cast(pa.string())]
                yield pa.RecordBatch.from_arrays([*cols, pa.array(unpack(ids, n), pa.int64()), pa.array(unpack(counts, n), pa.int64())], ["lang", "word", "id", "f"])

    return known.filter("shard is null").select("lang", "n", "words", "ids", "counts").mapInArrow(run, "lang string, word string, id long, f long")


def _index(cut: DataFrame, known: DataFrame) -> DataFrame:
    def build(own: pa.Table, ids: pa.Table) -> pa.Table:
        out = []
        if own.num_rows and ids.num_rows:
            row = own.to_pylist()[0]
            of = np.full(row["n_words"] + 1, -1, np.int64)
            for n, at, id_ in zip(*(ids.column(c).to_pylist() for c in ("n", "at", "ids"))):
                of[unpack(at, n)] = unpack(id_, n)
            made = symbols_of(unpack(row["ids"], row["n"], "<i4"), of)
            if made:
                words, text = made
                wide = len(words) > 65_535
                out.append((row["shard"], row["lang"], len(text), wide, len(words), pack(words), pack(text, "<i4" if wide else "<u2")))
        return _table(out, INDEX)

    left = cut.select("shard", "lang", "n", "ids", F.size("words").alias("n_words"))
    own = known.filter("shard is not null").select(F.col("shard").alias("of"), "n", "at", "ids")
    return stored(left.groupBy("shard").cogroup(own.groupBy("of")).applyInArrow(build, INDEX))


def _open(row: dict) -> Shard:
    return Shard(unpack(row["words"], row["symbols"]), unpack(row["text"], row["n"], "<i4" if row["wide"] else "<u2"))


def _part_of(keys: np.ndarray, parts: int) -> np.ndarray:
    mixed = np.zeros(len(keys), np.uint64)
    for j in range(keys.shape[1]):
        mixed = (mixed ^ keys[:, j].astype(np.uint64)) * np.uint64(0x9E3779B97F4A7C15)
        mixed ^= mixed >> np.uint64(29)
    return (mixed % np.uint64(parts)).astype(np.int64)


def _blocks(row: dict, phrases: np.ndarray | None, on_left: bool, parts: int) -> pa.Table:
    """The extensions of a shard, in blocks by part of the keys."""
    own = _open(row)
    grown, counts = own.grown(phrases, on_left)
    keys = own.words[grown]
    part = _part_of(keys, parts)
    order = np.lexsort((*keys.T[::-1], part))
    keys, counts, part = keys[order], counts[order], part[order]
    return _table([(row["shard"], row["lang"], int(part[a]), b - a, pack(keys[a:b].T), pack(counts[a:b])) for a, b in _cuts(part)], GROWN)


def _first_round(index: DataFrame, parts: int) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i in range(b.num_rows):
                yield from _blocks(b.slice(i, 1).to_pylist()[0], None, True, parts).to_batches()

    return index.mapInArrow(run, GROWN)


def _next_round(index: DataFrame, kept: DataFrame, length: int, on_left: bool, parts: int) -> DataFrame:
    def run(own: pa.Table, survivors: pa.Table) -> pa.Table:
        if not own.num_rows or not survivors.num_rows:
            return _table([], GROWN)
        row = own.to_pylist()[0]
        words = unpack(row["words"], row["symbols"])
        keys = [unpack(p, n * length).reshape(length, n).T for n, p in zip(survivors.column("n").to_pylist(), survivors.column("phrases").to_pylist())]
        return _blocks(row, np.searchsorted(words, np.concatenate(keys)), on_left, parts)

    return index.groupBy("shard").cogroup(kept.groupBy("of")).applyInArrow(run, GROWN)


def _summed(grown: DataFrame, length: int, least: int) -> DataFrame:
    """Phrases whose counts over all shards reach `least`: a block of sums per language and part, and each shard's own."""

    def add(blocks: pa.Table) -> pa.Table:
        rows = blocks.to_pylist()
        keys = np.concatenate([unpack(r["phrases"], r["n"] * length).reshape(length, r["n"]).T for r in rows])
        counts = np.concatenate([unpack(r["counts"], r["n"]) for r in rows])
        of = np.repeat(np.arange(len(rows)), [r["n"] for r in rows])
        order = np.lexsort(keys.T[::-1])
        keys, counts, of = keys[order], counts[order], of[order]
        new = np.concatenate([[True], (keys[1:] != keys[:-1]).any(1)])
        at = np.flatnonzero(new)
        total = np.add.reduceat(counts, at)
        good = total >= least
        out = []
        if good.any():
            out.append((None, rows[0]["lang"], rows[0]["part"], int(good.sum()), pack(keys[at[good]].T), pack(total[good]), True))
        stays = good[np.cumsum(new) - 1]
        keys, of = keys[stays], of[stays]
        order = np.argsort(of, kind="stable")
        keys, of = keys[order], of[order]
        out += [(rows[of[a]]["shard"], rows[0]["lang"], rows[0]["part"], b - a, pack(keys[a:b].T), b"", False) for a, b in _cuts(of)]
        return _table(out, KEPT)

    return stored(grown.groupBy("lang", "part").applyInArrow(add, KEPT))


def _phrases(sums: DataFrame, length: int) -> DataFrame:
    """lang, ids and f of the phrases in blocks of sums."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for lang, n, phrases, counts in zip(*(c.to_pylist() for c in b.columns)):
                keys = unpack(phrases, n * length).reshape(length, n).T
                lists = pa.ListArray.from_arrays(pa.array(range(0, length * n + 1, length), pa.int32()), pa.array(keys.ravel(), pa.int64()))
                yield pa.RecordBatch.from_arrays([pa.array([lang] * n, pa.string()), lists, pa.array(unpack(counts, n), pa.int64())], ["lang", "ids", "f"])

    return sums.select("lang", "n", "phrases", "counts").mapInArrow(run, "lang string, ids array<long>, f long")


def mine(docs: DataFrame, least: int = LEAST, depth: int = DEPTH, size: int = SHARD) -> tuple[DataFrame, DataFrame]:
    """(phrases, totals): lang, words (array) and f of every phrase of 1 to `depth` words that occurs `least` times in its
    language; and lang and n, its number of words. docs: lang, text."""
    spark = docs.sparkSession
    if not 1 <= depth <= DEPTH:
        raise ValueError(f"phrases have 1 to {DEPTH} words")
    cut = shards(docs, size)
    in_all = F.aggregate("counts", F.lit(0).cast("long"), lambda a, c: a + c)
    totals = cut.select("lang", in_all.alias("n")).groupBy("lang").agg(F.sum("n").alias("n"))
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    known = _known_words(_word_blocks(cut, parts), parts, least)
    frequent = _named(known)
    found = [frequent.select("lang", F.array("word").alias("words"), "f")]
    index = _index(cut, known) if depth > 1 else None
    kept = ids = None
    for length in range(2, depth + 1):
        on_left = length % 2 == 0
        grown = _first_round(index, parts) if kept is None else _next_round(index, kept, length - 1, on_left, parts)
        blocks = _summed(grown, length, least)
        kept = blocks.filter(~F.col("sums")).select(F.col("shard").alias("of"), "n", "phrases")
        own = _phrases(blocks.filter("sums"), length)
        ids = own if ids is None else ids.unionByName(own)
    if ids is not None:
        # the words of survivors by their ids
        placed = stored(ids.withColumn("k", F.monotonically_increasing_id()))
        flat = placed.select("k", "lang", F.posexplode("ids").alias("at", "id")).join(frequent.select("lang", "id", "word"), ["lang", "id"])
        worded = flat.groupBy("k").agg(F.array_sort(F.collect_list(F.struct("at", "word"))).alias("w"))
        found.append(placed.join(worded, "k").select("lang", F.transform("w", lambda x: x.word).alias("words"), "f"))
    out = found[0]
    for more in found[1:]:
        out = out.unionByName(more)
    return stored(out), stored(totals)


def score_of(a: Column, n: Column, left: Column, right: Column) -> Column:
    """floor(1000 * a * n / (l * r)), exact: products are decimals, of up to 38 digits."""
    wide = [c.cast("decimal(19,0)") for c in (a, n, left, right)]
    top = (wide[0] * wide[1]).cast("decimal(35,0)") * F.lit(1000).cast("decimal(4,0)")
    return F.call_function("div", top.cast("decimal(38,0)"), (wide[2] * wide[3]).cast("decimal(38,0)"))


def collocations(phrases: DataFrame, totals: DataFrame, closure: int = 100) -> DataFrame:
    """lang, phrase, a, l, r, n and score of phrases of two words and more, each by its lowest-scoring cut.

    A phrase is left out where a phrase one word longer holds it and has `closure` per cent of its count at least; as
    counts only fall with length, a phrase longer still can say nothing else.
    """
    text = F.array_join("words", " ")
    all_ = phrases.select("lang", text.alias("phrase"), "words", F.size("words").alias("size"), "f")
    many = all_.filter("size > 1")
    # extensions on both sides: the longest count that holds a phrase
    ends = F.explode(F.array(F.array_join(F.slice("words", F.lit(1), F.col("size") - 1), " "), F.array_join(F.slice("words", F.lit(2), F.col("size") - 1), " ")))
    longer = many.filter("size > 2").select("lang", ends.alias("phrase"), "f").groupBy("lang", "phrase").agg(F.max("f").alias("held"))
    open_ = many.join(longer, ["lang", "phrase"], "left").filter(F.col("held").isNull() | (100 * F.col("held") < closure * F.col("f")))
    cut = F.explode(F.sequence(F.lit(1), F.col("size") - 1)).alias("k")
    cuts = open_.select("lang", "phrase", F.col("f").alias("a"), "words", "size", cut)
    head = F.array_join(F.slice("words", F.lit(1), F.col("k")), " ")
    tail = F.array_join(F.slice("words", F.col("k") + 1, F.col("size") - F.col("k")), " ")
    cuts = cuts.select("lang", "phrase", "a", "k", head.alias("head"), tail.alias("tail"))
    counts = all_.select("lang", "phrase", "f")
    cuts = cuts.join(counts.select("lang", F.col("phrase").alias("head"), F.col("f").alias("l")), ["lang", "head"])
    cuts = cuts.join(counts.select("lang", F.col("phrase").alias("tail"), F.col("f").alias("r")), ["lang", "tail"])
    scored = cuts.join(totals, "lang").withColumn("score", score_of(F.col("a"), F.col("n"), F.col("l"), F.col("r")))
    lowest = scored.groupBy("lang", "phrase").agg(F.min(F.struct("score", "k", "a", "l", "r", "n")).alias("m"))
    return lowest.select("lang", "phrase", "m.a", "m.l", "m.r", "m.n", "m.score")


def top(found: DataFrame, most: int) -> DataFrame:
    """The first of each language, by score, count and phrase, with their rank."""
    order = Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), "phrase")
    return found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= most)

"""Runs: maximal stretches of a text, in words, that repeat with a period.

The words of a text are appended one by one to a suffix automaton. Its suffix links form a tree whose path from a prefix
to the root holds all strings that end there, and a link-cut forest keeps that tree cut into segments of equal last
occurrence. Appending word i opens the path of the new prefix: each segment it meets ended last at a word e, with its
longest string of L words. Where the distance i - e is at most L, the two occurrences touch: a square of that period, and
with it the stretch of L + (i - e) words that ends at i. Then the whole path is recoloured with i. A run is reported at
each of its ends from its second period on, always with the same start and period, so the last report is the whole run.

Work is O(n log n) splay steps for n words. A run of `SHORTEST` words or more repeats `GRAM` words at its period, so words that
no repeated group of `GRAM` words covers lie in no run; only the stretches between them are appended, each to an automaton
of its own, and those are cut again by what repeats inside. Nothing is cut by this: a stretch holds each of its runs whole.

Defined results: a null text has no words and no runs; ids are not looked at, and rows may repeat; texts of one word,
empty texts and empty tables have no runs.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from eventlake.llm.common import raw

SHORTEST = 12
GRAM = SHORTEST // 2
# times a stretch is cut again by what repeats inside
CUTS = 8


class Automaton:
    """Suffix automaton whose tree of suffix links is held in a link-cut forest; a segment knows its last occurrence."""

    def __init__(self) -> None:
        # states: transitions, suffix link, longest length
        self.next: list[dict[int, int]] = [{}]
        self.link, self.size = [-1], [0]
        self.last = 0
        # forest: splay trees of segments, by depth; the parent of a root is the tree node above its segment
        self.up, self.left, self.right = [-1], [-1], [-1]
        # last occurrence of a segment, right at the root of its splay tree
        self.seen = [-1]

    def _state(self, size: int, moves: dict[int, int], link: int) -> int:
        self.next.append(moves)
        self.size.append(size)
        self.link.append(link)
        self.up.append(link)
        self.left.append(-1)
        self.right.append(-1)
        self.seen.append(-1)
        return len(self.size) - 1

    def append(self, word: int) -> int:
        """Add a word; the state of the new prefix."""
        moves, link, size = self.next, self.link, self.size
        new = self._state(size[self.last] + 1, {}, 0)
        p = self.last
        while p >= 0 and word not in moves[p]:
            moves[p][word] = new
            p = link[p]
        if p >= 0:
            q = moves[p][word]
            if size[q] != size[p] + 1:
                q = self._split(q, size[p] + 1, word, p)
            link[new] = self.up[new] = q
        self.last = new
        return new

    def _split(self, q: int, size: int, word: int, p: int) -> int:
        """A state for the strings of q up to a length; it stands right above q, in the same segment."""
        copy = self._state(size, dict(self.next[q]), self.link[q])
        self.splay(q)
        above = self.left[q]
        self.left[copy], self.left[q], self.up[copy] = above, copy, q
        if above >= 0:
            self.up[above] = copy
        self.link[q] = copy
        moves, link = self.next, self.link
        while p >= 0 and moves[p].get(word) == q:
            moves[p][word] = copy
            p = link[p]
        return copy

    def splay(self, x: int) -> None:
        """Make x the root of the splay tree of its segment."""
        up, left, right = self.up, self.left, self.right
        top = -1
        while True:
            p = up[x]
            if p < 0 or (left[p] != x and right[p] != x):
                break
            g = up[p]
            inner = g >= 0 and (left[g] == p or right[g] == p)
            if not inner:
                top = p
                self._rotate(x, p, g)
                break
            if (left[g] == p) == (left[p] == x):
                self._rotate(p, g, up[g])
                top = g
                self._rotate(x, p, up[p])
            else:
                self._rotate(x, p, g)
                top = g
                self._rotate(x, g, up[g])
        if top >= 0:
            self.seen[x] = self.seen[top]

    def _rotate(self, x: int, p: int, g: int) -> None:
        up, left, right = self.up, self.left, self.right
        if left[p] == x:
            b = right[x]
            left[p], right[x] = b, p
        else:
            b = left[x]
            right[p], left[x] = b, p
        if b >= 0:
            up[b] = p
        if g >= 0:
            if left[g] == p:
                left[g] = x
            elif right[g] == p:
                right[g] = x
        up[p], up[x] = x, g

    def visit(self, state: int, at: int) -> list[tuple[int, int]]:
        """(last occurrence, longest length) of the segments on the path of a state to the root; all become one, seen at `at`."""
        out = []
        right, seen, up, size = self.right, self.seen, self.up, self.size
        x, below = state, -1
        while x >= 0:
            self.splay(x)
            if seen[x] >= 0:
                out.append((seen[x], size[x]))
            # what hangs below x in its segment keeps the older occurrence, as a segment of its own
            rest = right[x]
            if rest >= 0:
                seen[rest] = seen[x]
            right[x] = below
            if below >= 0:
                up[below] = x
            below, x = x, up[x]
        self.seen[below] = at
        return out


def runs_of(words: list[int], shortest: int = SHORTEST) -> list[tuple[int, int, int]]:
    """(start, length, period) of the runs of a word sequence, by start and period."""
    own = Automaton()
    ends: dict[tuple[int, int], int] = {}
    for i, w in enumerate(words):
        for e, size in own.visit(own.append(w), i):
            d = i - e
            if d <= size and d + size >= shortest:
                ends[i - size - d + 1, d] = i
    return sorted((s, e - s + 1, d) for (s, d), e in ends.items())


def stretches(words: np.ndarray, gram: int = GRAM) -> Iterator[tuple[int, int]]:
    """(start, end) of stretches covered by groups of `gram` words that repeat inside the stretch."""
    todo = [(0, len(words), CUTS)]
    while todo:
        lo, hi, cuts = todo.pop()
        n = hi - lo - gram + 1
        if n < 2:
            continue
        # groups are numbered by doubling, so equal numbers are equal groups
        key, reach = words[lo:hi], 1
        while reach < gram:
            step = min(reach, gram - reach)
            key = np.unique(key[: len(key) - step] * (int(key.max()) + 1) + key[step:], return_inverse=True)[1]
            reach += step
        again = np.bincount(key)[key] > 1
        edge = np.zeros(hi - lo + 1, np.int64)
        edge[:n] += again
        edge[gram : gram + n] -= again
        cover = np.concatenate([[0], (np.cumsum(edge[:-1]) > 0).astype(np.int8), [0]])
        turn = np.flatnonzero(np.diff(cover))
        found = [(lo + int(a), lo + int(b)) for a, b in zip(turn[::2], turn[1::2])]
        if found == [(lo, hi)] or not cuts:
            yield from found
        else:
            todo += [(a, b, cuts - 1) for a, b in found]


def find(words: list[bytes]) -> list[tuple[int, int, int]]:
    """(start, length, period) of all runs of `SHORTEST` words or more, by start and period."""
    if len(words) < SHORTEST:
        return []
    number: dict[bytes, int] = {}
    ids = np.array([number.setdefault(w, len(number)) for w in words], np.int64)
    out = []
    for lo, hi in stretches(ids):
        out += [(lo + s, n, d) for s, n, d in runs_of(ids[lo:hi].tolist())]
    return sorted(out, key=lambda r: (r[0], r[2]))


def kept(words: list[bytes], runs: list[tuple[int, int, int]]) -> list[bytes]:
    """Words without those that a run repeats after its first period."""
    edge = np.zeros(len(words) + 1, np.int64)
    for s, n, d in runs:
        edge[s + d] += 1
        edge[s + n] -= 1
    return [w for w, c in zip(words, np.cumsum(edge[:-1])) if c == 0] if runs else words


def mark(docs: DataFrame) -> DataFrame:
    """docs with n_runs, runs (array of start, length, period) and collapsed (the text with each run cut to one period)."""
    names = ["n_runs", "runs", "collapsed"]
    source = docs.drop(*names)
    run_type = T.StructType([T.StructField(n, T.LongType()) for n in ("start", "length", "period")])
    schema = T.StructType([*source.schema.fields, T.StructField("n_runs", T.LongType()), T.StructField("runs", T.ArrayType(run_type)), T.StructField("collapsed", T.StringType())])
    kind = pa.list_(pa.struct([(n, pa.int64()) for n in ("start", "length", "period")]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            counts, lists, texts = [], [], []
            for text in raw(b.column(b.schema.names.index("text"))):
                words = (text or b"").split()
                found = find(words)
                counts.append(len(found))
                lists.append([dict(zip(("start", "length", "period"), r)) for r in found])
                texts.append(b" ".join(kept(words, found)))
            new = [pa.array(counts, pa.int64()), pa.array(lists, kind), pa.array(texts, pa.binary()).cast(pa.string())]
            yield pa.RecordBatch.from_arrays([*b.columns, *new], [*b.schema.names, *names])

    return source.mapInArrow(run, schema)



"""Personal data by fixed patterns and a semi-Markov conditional random field.

The patterns give the base spans. The field works on tokens: an entity holds tokens with a digit or an @ only, stands in
one run of them (a zone), and has `LONGEST` tokens at most. Features describe a candidate segment as a whole: its shape, its
digits, check sums and octets, and what stands before and after. Dynamic programming over the end, length and type of the
last segment chooses boundaries and types together. Weights are learnt from zones of a bounded sample of documents, where
base spans that fit token boundaries are the truth, and zones of more than `PIECE` tokens are learnt in pieces; in decoding, segments that touch a base span are left out, so the
field only adds.

Defined results: a null text is empty and has no spans; spans are in code points, end exclusive; ids are never looked at.
"""

from __future__ import annotations

import json
import math
import re
from bisect import bisect_left
from collections import defaultdict, deque
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

KINDS = ("email", "ip", "card", "phone")
LONGEST = 6
# documents in the training sample at most
SAMPLE = 2_000
EPOCHS = 4
# tokens that training takes at once: longer zones are learnt in pieces
PIECE = 64

# fixed patterns: what the contract of the query states; an address is sought from its @, which comes to the same
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_IP = re.compile(r"(?<![0-9])[0-9]+(?:\.[0-9]+){3}")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_ANY = re.compile(r"[0-9@]")


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = ord(c) - 48
        total += d if i % 2 == 0 else 2 * d - 9 * (d > 4)
    return total % 10 == 0


def _digits(s: str) -> str:
    return "".join(c for c in s if "0" <= c <= "9")


def octets(s: str) -> bool:
    """Whether all dotted parts are at most 255; long ones are not even read as numbers."""
    return all(len(d := p.lstrip("0")) < 4 and int(d or "0") < 256 for p in s.split("."))


def emails(text: str) -> Iterator[tuple[int, int]]:
    end, at = 0, text.find("@")
    while at >= 0:
        if at >= end and (m := _DOMAIN.match(text, at + 1)):
            start = at
            while start > end and text[start - 1] in _LOCAL:
                start -= 1
            if start < at:
                end = m.end()
                yield start, end
        at = text.find("@", at + 1)


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, number of the kind, end), sorted."""
    if not _ANY.search(text):
        return []
    out = [(s, 0, e) for s, e in emails(text)]
    out += [(m.start(), 1, m.end()) for m in _IP.finditer(text) if octets(m[0])]
    out += [(m.start(), 2, m.end()) for m in _CARD.finditer(text) if 14 <= len(d := _digits(m[0])) <= 19 and luhn(d)]
    out += [(m.start(), 3, m.end()) for m in _PHONE.finditer(text) if 10 <= len(_digits(m[0])) <= 15]
    return sorted(out)


# tokens that may be part of an entity; a zone is a run of them with one blank between
_TOKEN = re.compile(r"[^\s\"'<>|,;:!?#$&*=\[\]{}]+")


def zones(text: str) -> Iterator[list[tuple[int, int]]]:
    held: list[tuple[int, int]] = []
    for m in _TOKEN.finditer(text):
        if not _ANY.search(m[0]):
            continue
        s, e = m.start(), m.end()
        while e > s and text[e - 1] in "./-%(":
            e -= 1
        if held and not (s == held[-1][1] + 1 and text[s - 1] == " "):
            yield held
            held = []
        if e > s:
            held.append((s, e))
    if held:
        yield held


def shape(s: str) -> str:
    kinds = ("9" if c.isdigit() else "a" if c.isalpha() else c for c in s)
    out: list[str] = []
    for k in kinds:
        if not out or out[-1] != k:
            out.append(k)
    return "".join(out)


def features(text: str, start: int, end: int, n: int) -> list[str]:
    """What describes a candidate segment of n tokens."""
    s = text[start:end]
    d = _digits(s)
    out = ["bias", f"shape {shape(s)}", f"tokens {n}", f"digits {min(len(d), 24)}", f"before {shape(text[max(0, start - 1) : start])}", f"after {shape(text[end : end + 1])}"]
    if 14 <= len(d) <= 19:
        out.append(f"luhn {luhn(d)}")
    if s.count(".") == 3 and s.replace(".", "").isdigit():
        out.append(f"octets {octets(s)}")
    if "@" in s:
        out.append(f"domain {bool(_DOMAIN.fullmatch(s.rpartition('@')[2]))}")
    if s[0] == "+":
        out.append(f"plus {10 <= len(d) <= 15}")
    return out


class Field:
    """Weights by (type, feature); type 0 is no entity, which has one token."""

    def __init__(self, weights: dict[str, float] | None = None):
        self.w: dict[str, float] = defaultdict(float, weights or {})
        self.square: dict[str, float] = defaultdict(float)

    def ending(self, text: str, zone: list[tuple[int, int]], j: int) -> list[tuple[int, int, list[str], float]]:
        """The segments (length, type, keys, score) that may end with token j."""
        here = []
        for n in range(1, min(LONGEST, j + 1) + 1):
            found = features(text, zone[j - n + 1][0], zone[j][1], n)
            for t in range(len(KINDS) + 1) if n == 1 else range(1, len(KINDS) + 1):
                keys = [f"{t} {f}" for f in found]
                here.append((n, t, keys, sum(self.w.get(k, 0.0) for k in keys)))
        return here

    def best(self, text: str, zone: list[tuple[int, int]]) -> list[tuple[int, int, int]]:
        """The segments of the best segmentation that are entities: (first token, number of tokens, type).

        Only scores of the last LONGEST ends and one choice per token are held, whatever the length of the zone.
        """
        score, back = deque([0.0], LONGEST), bytearray()
        for j in range(len(zone)):
            s, n, t = max((score[-n] + w, -n, -t) for n, t, _, w in self.ending(text, zone, j))
            score.append(s)
            back.append(-16 * n - t)
        out, j = [], len(zone)
        while j:
            n, t = divmod(back[j - 1], 16)
            j -= n
            if t:
                out.append((j, n, t))
        return out[::-1]

    def step(self, text: str, zone: list[tuple[int, int]], truth: set[tuple[int, int, int]], rate: float = 0.5) -> None:
        """One gradient step on the log-likelihood of the true segmentation. truth: (first token, tokens, type)."""
        rows, n_tok = [self.ending(text, zone, j) for j in range(len(zone))], len(zone)

        def soft(values: list[float]) -> float:
            top = max(values)
            return top + math.log(sum(math.exp(v - top) for v in values))

        ahead = [0.0]
        for j, here in enumerate(rows):
            ahead.append(soft([ahead[j + 1 - n] + w for n, _, _, w in here]))
        behind = [0.0] * (n_tok + 1)
        opens: list[list[tuple[int, float]]] = [[] for _ in range(n_tok)]
        for j, here in enumerate(rows):
            for n, _, _, w in here:
                opens[j + 1 - n].append((j + 1, w))
        for i in range(n_tok - 1, -1, -1):
            behind[i] = soft([behind[j] + w for j, w in opens[i]])
        grad: dict[str, float] = defaultdict(float)
        for j, here in enumerate(rows):
            for n, t, keys, w in here:
                g = ((j + 1 - n, n, t) in truth) - math.exp(ahead[j + 1 - n] + w + behind[j + 1] - ahead[-1])
                if abs(g) > 1e-6:
                    for k in keys:
                        grad[k] += g
        for k, g in grad.items():
            self.square[k] += g * g
            self.w[k] += rate * g / math.sqrt(1e-8 + self.square[k])


def truth_of(zone: list[tuple[int, int]], base: list[tuple[int, int, int]]) -> set[tuple[int, int, int]]:
    """Base spans that begin and end with tokens of the zone, as segments, and single tokens elsewhere."""
    starts, ends = {s: i for i, (s, _) in enumerate(zone)}, {e: i for i, (_, e) in enumerate(zone)}
    out, free = set(), [True] * len(zone)
    for s, kind, e in base:
        i, j = starts.get(s), ends.get(e)
        if i is not None and j is not None and 0 <= j - i < LONGEST and all(free[i : j + 1]):
            out.add((i, j - i + 1, kind + 1))
            free[i : j + 1] = [False] * (j - i + 1)
    return out | {(i, 1, 0) for i, f in enumerate(free) if f}


def learn(texts: list[str]) -> dict[str, float]:
    field = Field()
    known = [(t, base_spans(t)) for t in texts]
    for _ in range(EPOCHS):
        for text, base in known:
            for zone in zones(text):
                for i in range(0, len(zone), PIECE):
                    piece = zone[i : i + PIECE]
                    field.step(text, piece, truth_of(piece, base))
    return {k: round(v, 4) for k, v in field.w.items() if abs(v) > 1e-3}


def train(docs: DataFrame, sample: int = SAMPLE) -> dict[str, float]:
    """Weights from at most `sample` documents with a digit or an @: those with the smallest hash of their text."""
    text = F.col("text").cast("string")
    key = F.xxhash64(text)
    # copies go first, so that a text with very many does not fill the sample
    some = docs.filter(text.rlike("[0-9@]")).select(key.alias("k")).distinct().orderBy("k").limit(sample)
    picked = docs.select(key.alias("key"), text.alias("text")).join(F.broadcast(some), F.col("key") == F.col("k"))
    picked = picked.groupBy("key").agg(F.first("text").alias("text"))

    def fit(rows: pd.DataFrame) -> pd.DataFrame:
        weights = learn(rows.sort_values("key")["text"].tolist())
        return pd.DataFrame({"w": [json.dumps(weights)]})

    got = picked.groupBy(F.lit(1).alias("one")).applyInPandas(fit, "w string").collect()
    return json.loads(got[0].w) if got else {}


def all_spans(text: str, field: Field) -> tuple[list[tuple[int, int, int]], list[tuple[int, int, int]]]:
    """Base spans, and base spans with what the field adds."""
    base = base_spans(text)
    if not _ANY.search(text) or not field.w:
        return base, base
    # base spans as stretches that do not meet, so one search tells whether a segment touches any
    starts, ends = [], []
    for s, _, e in base:
        if ends and s < ends[-1]:
            ends[-1] = max(ends[-1], e)
        else:
            starts.append(s)
            ends.append(e)
    added = []
    for zone in zones(text):
        for i, n, t in field.best(text, zone):
            s, e = zone[i][0], zone[i + n - 1][1]
            at = bisect_left(starts, e)
            if not at or ends[at - 1] <= s:
                added.append((s, t - 1, e))
    return base, sorted(base + added)


def named(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[k]}:{s}:{e}" for s, k, e in spans)


def redacted(text: str, spans: list[tuple[int, int, int]]) -> str:
    """The text with each stretch of spans replaced by the kind of its first one."""
    out, at = [], 0
    for s, k, e in spans:
        if s >= at:
            out += [text[at:s], f"[{KINDS[k].upper()}]"]
        at = max(at, e)
    return "".join([*out, text[at:]])


def mark(docs: DataFrame, weights: dict[str, float], prefix: str = "") -> DataFrame:
    """docs with base and spans (kind:start:end, comma-joined), n_<kind> of the base, and redacted; `prefix` before the names."""
    names = [prefix + n for n in ("base", "spans", *(f"n_{k}" for k in KINDS), "redacted")]
    source = docs.drop(*names)
    shared = docs.sparkSession.sparkContext.broadcast(weights)
    kinds = [T.StringType()] * 2 + [T.LongType()] * len(KINDS) + [T.StringType()]
    schema = T.StructType([*source.schema.fields, *(T.StructField(n, k) for n, k in zip(names, kinds))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        field = Field(shared.value)
        for b in batches:
            rows = []
            for text in b.column(b.schema.names.index("text")).to_pylist():
                base, spans = all_spans(text or "", field)
                count = [sum(1 for _, k, _ in base if k == i) for i in range(len(KINDS))]
                rows.append((named(base), named(spans), *count, redacted(text, spans) if spans else text))
            new = [pa.array(c, pa.int64() if 2 <= i < 2 + len(KINDS) else pa.string()) for i, c in enumerate(zip(*rows))]
            yield pa.RecordBatch.from_arrays([*b.columns, *new], [*b.schema.names, *names])

    return source.mapInArrow(run, schema)


def redact(docs: DataFrame) -> DataFrame:
    """docs with every span in the text replaced by its kind; all other columns as they are."""
    source = docs.withColumn("text", F.col("text").cast("string"))
    marked = mark(source, train(docs), "__p_")
    return marked.select(*[F.col("__p_redacted").alias("text") if c == "text" else F.col(c) for c in docs.columns])

"""Quality classifier: hashed word n-grams, logistic regression learnt by follow-the-regularised-leader.

Tokens are runs of letters and digits and runs of other visible signs, case kept. Uni- and bigrams are hashed into
2^bits slots; a document is the scaled bag of its n-grams, so a score is one sparse dot product.

Defined results: a null or empty text has no n-gram and gets the score of the bias alone; labels other than 0 and 1,
null labels and labels of unknown documents take no part in training; repeated label rows count as often as they
occur; with no usable label every score is 0.5. Rows are scored on their own: repeated ids give repeated rows.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import repeat
from zlib import crc32

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from eventlake.llm.common import raw

_TOKEN = re.compile(rb"[0-9A-Za-z\x80-\xff]+|[^\s0-9A-Za-z\x80-\xff]+")
_MIX = np.uint64(0x9E3779B97F4A7C15)


@dataclass(frozen=True)
class Settings:
    bits: int = 20
    alpha: float = 0.5
    beta: float = 1.0
    l1: float = 1e-3
    l2: float = 1e-4
    epochs: int = 4
    shards: int = 4
    # training rows at most; the bounded sample of labelled documents
    sample: int = 6000
    seed: int = 7


def bag(text: bytes | None, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """Slots of the uni- and bigrams of a text and their values: log counts, scaled to a length of 4."""
    tokens = _TOKEN.findall(text or b"")
    one = np.fromiter(map(crc32, tokens), np.uint64, len(tokens))
    if not len(one):
        return np.zeros(0, np.int64), np.zeros(0)
    two = one[:-1] * _MIX + one[1:] + np.uint64(1)
    two[one[:-1] == one[1:]] = 1  # a word twice in a row is one bigram, whatever the word
    slot, count = np.unique((np.concatenate([one, two]) * _MIX) >> np.uint64(64 - bits), return_counts=True)
    value = np.log1p(count)
    return slot.astype(np.int64), value * (4.0 / math.sqrt(float(value @ value)))


def _logistic(z: float) -> float:
    return 1.0 / (1.0 + math.exp(-max(-35.0, min(35.0, z))))


def score(text: bytes | None, weights: np.ndarray) -> float:
    """Probability of label 1. weights: one per slot, the bias last."""
    slot, value = bag(text, int(math.log2(len(weights) - 1)))
    return _logistic(float(weights[slot] @ value) + float(weights[-1]))


def learn(texts: list[bytes], labels: list[int], s: Settings) -> np.ndarray:
    """FTRL-proximal, several times over the documents in the given order. The rarer label weighs as much as the other."""
    size = (1 << s.bits) + 1
    z, n = np.zeros(size), np.zeros(size)
    rows = [(np.append(slot, size - 1), np.append(x, 1.0)) for slot, x in (bag(t, s.bits) for t in texts)]
    share = max(1, sum(labels)), max(1, len(labels) - sum(labels))
    cost = {1: max(1.0, share[1] / share[0]), 0: max(1.0, share[0] / share[1])}

    def weight(zi: np.ndarray, ni: np.ndarray) -> np.ndarray:
        w = -(zi - np.sign(zi) * s.l1) / ((s.beta + np.sqrt(ni)) / s.alpha + s.l2)
        return np.where(np.abs(zi) <= s.l1, 0.0, w)

    for _ in range(s.epochs):
        for (at, x), y in zip(rows, labels):
            zi, ni = z[at], n[at]
            w = weight(zi, ni)
            g = (_logistic(float(w @ x)) - y) * x * cost[y]
            sigma = (np.sqrt(ni + g * g) - np.sqrt(ni)) / s.alpha
            z[at] = zi + g - sigma * w
            n[at] = ni + g * g
    return weight(z, n)


def sample_labels(labels: DataFrame, s: Settings = Settings()) -> DataFrame:
    """Of rows (key, label), at most `sample`: those with the smallest hash of their key, half from each label."""
    known = labels.filter(F.col("label").isin(0, 1) & F.col("key").isNotNull())
    ranked = known.select("key", "label", F.xxhash64(F.col("key").cast("string"), F.lit(s.seed)).alias("at"))
    good, bad = (ranked.filter(F.col("label") == y).orderBy("at", "key").limit(s.sample // 2) for y in (1, 0))
    return good.unionByName(bad)


def train(rows: DataFrame, s: Settings = Settings()) -> np.ndarray:
    """Weights from a bounded table (key, label, at, text), dealt over `shards` tasks and averaged by their rows."""
    shard = F.pmod(F.xxhash64(F.col("key").cast("string"), F.lit(s.seed + 1)), F.lit(s.shards))

    def fit(part: pd.DataFrame) -> pd.DataFrame:
        part = part.sort_values(["at", "key"], kind="stable")
        w = learn([t.encode() for t in part["text"]], [int(y) for y in part["label"]], s)
        return pd.DataFrame({"n": [len(part)], "w": [w.astype(np.float32).tobytes()]})

    dealt = rows.filter(F.col("text").isNotNull()).withColumn("shard", shard)
    total, mass = np.zeros((1 << s.bits) + 1), 0
    for row in dealt.groupBy("shard").applyInPandas(fit, "n long, w binary").toLocalIterator():
        total += row.n * np.frombuffer(row.w, np.float32)
        mass += row.n
    return total / max(1, mass)


def with_score(docs: DataFrame, weights: np.ndarray, text: str = "text", name: str = "score") -> DataFrame:
    """All columns of docs and the score of each row's whole text."""
    shared = docs.sparkSession.sparkContext.broadcast(weights)
    out = docs.drop(name)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        w = shared.value
        for b in batches:
            got = pa.array(list(map(score, raw(b.column(text)), repeat(w))), pa.float64())
            yield pa.RecordBatch.from_arrays([*b.columns, got], [*b.schema.names, name])

    schema = T.StructType([*out.schema.fields, T.StructField(name, T.DoubleType())])
    return out.mapInArrow(run, schema)


def held_out(doc_id: Column) -> Column:
    """True for the fifth of the documents that training never sees."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 5 == 0, F.lit(False))


def fit_on(docs: DataFrame, labels: DataFrame, label: str = "quality", s: Settings = Settings()) -> np.ndarray:
    """Weights learnt from the labelled documents that are not held out."""
    known = labels.filter(~held_out(F.col("doc_id")))
    picked = sample_labels(known.select(F.col("doc_id").alias("key"), F.col(label).alias("label")), s)
    text = docs.select(F.col("doc_id").alias("__id"), "text")
    # the sample is bounded by its settings, so it may be broadcast; of rows that share an id the smallest text is learnt
    joined = text.join(F.broadcast(picked), F.col("key") == F.col("__id")).drop("__id")
    one = joined.groupBy(*picked.columns).agg(F.min("text").alias("text"))
    return train(one, s)

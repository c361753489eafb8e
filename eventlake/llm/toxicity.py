"""Toxicity by a chain of linear classifiers.

The categories are predicted in order. The model of a category sees the distinct words of a text and their beginnings,
hashed and counted (abusive words come in inflected forms), and the probabilities of the earlier categories. In training these are out of fold: each fold's probabilities come from a model
that has not seen the fold, so a later model meets in training what it meets in use. Models are logistic regressions with
follow-the-regularised-leader updates, whose l1 term keeps the weight of words that say nothing at zero, so that long
texts are judged by the few words that count. The chain's folds are trained in parallel tasks from a bounded sample.

The labels give toxic and quality; the chain is low_quality, toxic, toxic_junk (both at once).

Defined results: a null or empty text has no words and gets what the biases give; documents without labels, null labels
and null ids take no part in training; without labels every probability is 0.5; repeated rows are judged each.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass
from zlib import crc32

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from eventlake.llm.common import raw, stored, words_of

CATEGORIES = ("low_quality", "toxic", "toxic_junk")


@dataclass(frozen=True)
class Settings:
    bits: int = 18
    folds: int = 3
    epochs: int = 5
    alpha: float = 1.0
    l1: float = 15.0
    l2: float = 0.01
    # labelled documents in the training sample at most
    sample: int = 8_000
    seed: int = 5


# lengths in bytes of the word beginnings that are features besides the whole words
BEGINNINGS = (3, 4, 5, 6, 7, 8)
Bag = tuple[np.ndarray, np.ndarray]


def bag(text: bytes | None, bits: int) -> Bag:
    """Slots of the distinct words and their beginnings, and the logarithm of how many words each stands for."""
    words = set(words_of(text or b""))
    found = [crc32(w) for w in words]
    for k in BEGINNINGS:
        found += [crc32(w[:k], k) for w in words if len(w) > k]
    at = np.array(found, np.uint64) * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(64 - bits)
    slot, count = np.unique(at, return_counts=True)
    return slot.astype(np.int64), np.log2(1.0 + count)


def probability(w: np.ndarray, own: Bag, earlier: list[float]) -> float:
    """w: slots, then the earlier categories, then the bias."""
    z = float(w[own[0]] @ own[1]) + float(w[-1]) + sum(float(a) * p for a, p in zip(w[-1 - len(earlier) : -1], earlier))
    return 1.0 / (1.0 + math.exp(-max(-35.0, min(35.0, z))))


def learn(rows: list[Bag], earlier: np.ndarray, labels: np.ndarray, s: Settings) -> np.ndarray:
    """Weights of one category; a rare label weighs up to four times as much as the other."""
    size, k = 1 << s.bits, earlier.shape[1]
    z, n = np.zeros(size + k + 1), np.zeros(size + k + 1)
    extra = np.arange(size, size + k + 1)
    ones = max(1, int(labels.sum()))
    cost = (1.0, min(4.0, max(1.0, (len(labels) - ones) / ones)))

    def weight(zi: np.ndarray, ni: np.ndarray) -> np.ndarray:
        w = -(zi - np.sign(zi) * s.l1) / ((1.0 + np.sqrt(ni)) / s.alpha + s.l2)
        return np.where(np.abs(zi) <= s.l1, 0.0, w)

    for _ in range(s.epochs):
        for (slot, count), before, y in zip(rows, earlier, labels):
            at = np.concatenate([slot, extra])
            x = np.concatenate([count, before, [1.0]])
            zi, ni = z[at], n[at]
            w = weight(zi, ni)
            p = 1.0 / (1.0 + math.exp(-max(-35.0, min(35.0, float(w @ x)))))
            g = (p - y) * x * cost[int(y)]
            z[at] = zi + g - (np.sqrt(ni + g * g) - np.sqrt(ni)) / s.alpha * w
            n[at] = ni + g * g
    return weight(z, n)


def sample_of(docs: DataFrame, labels: DataFrame, s: Settings) -> DataFrame:
    """(key, text, the categories, fold) of at most `sample` labelled documents, those with the smallest hash of their id."""
    low, toxic = (F.col("quality") == 0).cast("int"), F.col("toxic").cast("int")
    known = labels.filter(F.col("doc_id").isNotNull() & F.col("quality").isin(0, 1) & F.col("toxic").isin(0, 1))
    known = known.select(F.col("doc_id").alias("key"), low.alias("low_quality"), toxic.alias("toxic"), (low * toxic).alias("toxic_junk"))
    at = F.xxhash64(F.col("key").cast("string"), F.lit(s.seed))
    picked = known.withColumn("at", at).orderBy("at", "key").limit(s.sample)
    fold = F.pmod(F.xxhash64("at"), F.lit(s.folds)).cast("int")
    text = docs.select(F.col("doc_id").alias("__id"), F.col("text").cast("string").alias("text"))
    # bounded by the sample's size
    joined = text.join(F.broadcast(picked), F.col("__id") == F.col("key"))
    # of rows that share an id the smallest text is learnt
    joined = joined.groupBy("key", "at", *CATEGORIES).agg(F.min("text").alias("text"))
    return stored(joined.select("key", "at", "text", *CATEGORIES, fold.alias("fold")))


def _fitter(name: str, earlier: list[str], s: Settings):  # noqa: ANN202
    """Trains one model of a category: number f leaves fold f out and predicts it, the last one takes all."""

    def fit(part: pd.DataFrame) -> pd.DataFrame:
        part = part.sort_values(["at", "key"], kind="stable")
        at = [bag(t.encode() if t is not None else None, s.bits) for t in part["text"]]
        before = part[earlier].to_numpy(float).reshape(len(part), len(earlier))
        model, labels, fold = int(part["model"].iloc[0]), part[name].to_numpy(int), part["fold"].to_numpy()
        own = np.flatnonzero(fold != model)
        w = learn([at[i] for i in own], before[own], labels[own], s)
        if model == s.folds:
            return pd.DataFrame({"key": [None], "p": [None], "w": [w.astype(np.float32).tobytes()]})
        out = np.flatnonzero(fold == model)
        p = [probability(w, at[i], list(before[i])) for i in out]
        return pd.DataFrame({"key": part["key"].astype(str).to_numpy()[out], "p": p, "w": [None] * len(out)})

    return fit


def train(sample: DataFrame, s: Settings = Settings(), categories: tuple[str, ...] = CATEGORIES) -> list[np.ndarray]:
    """One weight vector per category, in order of the chain."""
    chain: list[np.ndarray] = []
    earlier: list[str] = []
    rows = sample
    for name in categories:
        models = rows.withColumn("model", F.explode(F.sequence(F.lit(0), F.lit(s.folds))))
        got = stored(models.groupBy("model").applyInPandas(_fitter(name, list(earlier), s), "key string, p double, w binary"))
        weights = got.filter("w is not null").collect()
        if not weights:
            return [np.zeros((1 << s.bits) + i + 1) for i in range(len(categories))]
        chain.append(np.frombuffer(weights[0].w, np.float32).astype(float))
        probs = got.filter("w is null").select(F.col("key").alias("__k"), F.col("p").alias(f"p_{name}")).dropDuplicates(["__k"])
        rows = rows.join(probs, F.col("key").cast("string") == F.col("__k")).drop("__k")
        earlier.append(f"p_{name}")
    return chain


def with_probabilities(docs: DataFrame, chain: list[np.ndarray], categories: tuple[str, ...] = CATEGORIES) -> DataFrame:
    """docs and p_<category>; columns of these names are replaced."""
    names = [f"p_{c}" for c in categories]
    source = docs.drop(*names)
    shared = docs.sparkSession.sparkContext.broadcast(chain)
    bits = int(math.log2(len(chain[0]) - 1))
    schema = T.StructType([*source.schema.fields, *(T.StructField(n, T.DoubleType()) for n in names)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        models = shared.value
        for b in batches:
            out: list[list[float]] = []
            for t in raw(b.column(b.schema.names.index("text"))):
                at, got = bag(t, bits), []
                for w in models:
                    got.append(probability(w, at, got))
                out.append(got)
            yield pa.RecordBatch.from_arrays([*b.columns, *(pa.array(c, pa.float64()) for c in zip(*out))], [*b.schema.names, *names])

    return source.mapInArrow(run, schema)


def is_toxic(cut: float = 0.5) -> Column:
    return F.col("p_toxic") >= cut

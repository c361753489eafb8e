"""Temperature mixing of sources, realised as budgeted block permutations.

A source with a share p of all tokens gets the weight p^a / sum p^a. The exponent a lies in [0, 1] and is bisected, many
cuts at a time as aggregates over the table of sources: the largest a whose weights reach the wanted entropy, then raised
until no source is repeated more often than allowed. Of a token budget each source gets its weight's part: whole epochs
of all its documents, and of one more epoch the first documents that fit.

Documents are dealt by hash over `BLOCKS` blocks per source. Every epoch permutes the blocks, and the documents inside
each, by its own hash. Running sums need only the blocks' totals; documents are summed one by one in the single block
where the budget ends. So a source with a third of all rows is thousands of groups, and none is summed in one task.

Defined results: a null source is a source of its own; a text without words has no tokens, costs nothing and is drawn
where its place comes up; repeated rows are drawn each; without tokens or budget nothing is drawn.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from eventlake.llm.common import stored

BLOCKS = 1024


@dataclass(frozen=True)
class Target:
    """Wanted entropy as a part of the largest possible one, repetitions allowed, and budget as a part of all tokens."""

    entropy: float = 0.98
    repetition: float = 4.0
    budget: float = 1.0
    seed: int = 11


def totals_of(docs: DataFrame) -> DataFrame:
    """(source, tokens) of the sources that have tokens."""
    return docs.groupBy("source").agg(F.sum("tokens").alias("tokens")).filter("tokens > 0")


def exponent(totals: DataFrame, target: Target) -> tuple[float, float, float]:
    """The exponent, the sum of the powers of all shares under it, and the number of tokens of all sources."""
    n, total = totals.agg(F.count("*"), F.sum("tokens")).first()
    if not n:
        return 1.0, 1.0, 0.0
    logs = totals.select("tokens", F.log(F.col("tokens") / F.lit(float(total))).alias("l"))
    wanted, budget = target.entropy * math.log(n), target.budget * total

    def states(grid: list[float]) -> list[tuple[float, float, float, float]]:
        """(exponent, entropy, largest repetition, sum of powers) for each exponent."""
        power = [F.exp(F.col("l") * a) for a in grid]
        sums = [x for p in power for x in (F.sum(p), F.sum(p * F.col("l")), F.max(p / F.col("tokens")))]
        row = logs.agg(*sums).first()
        return [(a, math.log(z) - a * m / z, top * budget / z, z) for a, z, m, top in zip(grid, row[::3], row[1::3], row[2::3])]

    def last(ok, lo: float, hi: float) -> float:  # noqa: ANN001
        """The edge up to which `ok` holds, if it holds at lo and falls once."""
        for _ in range(8):
            grid = [lo + (hi - lo) * i / 16 for i in range(17)]
            good = [a for s in states(grid) if ok(s) for a in s[:1]]
            if len(good) == 17:
                return hi
            lo = max(good, default=lo)
            hi = min(a for a in grid if a > lo)
        return lo

    a = last(lambda s: s[1] >= wanted, 0.0, 1.0)
    if states([a])[0][2] > target.repetition:
        # repetition falls as the exponent grows; where even natural shares repeat too often these are kept
        a = min(1.0, last(lambda s: s[2] > target.repetition, a, 1.0) + 16.0**-8)
    return a, states([a])[0][3], float(total)


def words_in(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text.cast("string"), F.lit(r"\S+")), F.lit(0)).cast("long")


def mix(docs: DataFrame, target: Target = Target()) -> DataFrame:
    """The drawn documents: (doc_id, source, tokens, epoch, turn).

    Sorted by turn, which runs from 0 to 1 through each source's part of the budget, they are the training order. All
    documents of a block have its turn, plus a fraction for their place in it.
    """
    seed = target.seed
    key = F.xxhash64(F.col("doc_id").cast("string"), F.col("text").cast("string"), F.lit(seed))
    own = stored(docs.select("doc_id", "source", words_in(F.col("text")).alias("tokens"), key.alias("key")))
    own = own.withColumn("block", F.pmod("key", F.lit(BLOCKS)).cast("int"))
    totals = stored(totals_of(own))
    a, z, total = exponent(totals, target)
    weight = F.exp(F.log(F.col("tokens") / F.lit(max(total, 1.0))) * a) / z
    quota = F.least(weight * F.lit(total * target.budget), F.col("tokens") * F.lit(target.repetition))
    quota = F.floor(quota + 1e-6)
    plan = totals.select(F.col("source").alias("s"), F.col("tokens").alias("have"), quota.alias("quota"))

    blocks = own.groupBy("source", "block").agg(F.sum("tokens").alias("t"))
    blocks = blocks.join(plan, F.col("source").eqNullSafe(F.col("s"))).drop("s")
    last = F.floor(F.col("quota") / F.col("have"))
    blocks = blocks.withColumn("epoch", F.explode(F.sequence(F.lit(0).cast("long"), last)))
    order = Window.partitionBy("source", "epoch").orderBy(F.xxhash64("block", "epoch", F.lit(seed)), "block")
    before = F.coalesce(F.sum("t").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    room = F.col("quota") - F.col("epoch") * F.col("have") - F.col("before")
    blocks = blocks.withColumn("before", before).withColumn("room", room).filter("room >= 0")
    start = (F.col("epoch") * F.col("have") + F.col("before")) / F.greatest("quota", F.lit(1))
    blocks = blocks.select(F.col("source").alias("s"), F.col("block").alias("b"), "epoch", "t", "room", "quota", start.alias("start"))

    on = F.col("source").eqNullSafe(F.col("s")) & (F.col("block") == F.col("b"))
    drawn = own.join(blocks, on).withColumn("place", F.xxhash64("key", "epoch"))
    # a place in the block as a fraction of its tokens
    turn = F.col("start") + F.pmod("place", F.lit(1 << 20)) / (1 << 20) * F.col("t") / F.greatest("quota", F.lit(1))
    drawn = drawn.withColumn("turn", turn)
    columns = ["doc_id", "source", "tokens", F.col("epoch").cast("int").alias("epoch"), "turn"]
    whole = drawn.filter("t <= room").select(*columns)
    line = Window.partitionBy("source", "block", "epoch").orderBy("turn", "place", "key", "doc_id")
    part = drawn.filter("t > room").withColumn("sum", F.sum("tokens").over(line.rowsBetween(Window.unboundedPreceding, 0)))
    return whole.unionByName(part.filter("sum <= room").select(*columns))

"""Lookup joins: a dimension whose estimated bytes are bounded is broadcast, a larger one is joined by shuffle."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Bytes, as the optimizer estimates them, up to which a dimension is broadcast.
BROADCAST_BYTES = 64 << 20
# Fact rows without a key match nothing; in a shuffle they are dealt over this many groups.
SPREAD = 256


@dataclass(frozen=True)
class LookupTable:
    """A dimension with one row per key and the verdict of its size check. A small one is cached until released."""

    df: DataFrame
    small: bool

    def release(self) -> None:
        self.df.unpersist()


def estimated_bytes(df: DataFrame) -> int:
    """The optimizer's estimate for a plan; no job runs."""
    return int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))


def lookup_table(df: DataFrame, limit: int | None = None) -> LookupTable:
    """Decide by estimated bytes whether a broadcast is bounded; building the plan runs no job.

    A table that passes is cached when first used: it is small, and every lookup and every run reads it again.
    """
    small = estimated_bytes(df) <= (BROADCAST_BYTES if limit is None else limit)
    return LookupTable(df.persist() if small else df, small)


def last_wins(df: DataFrame, keys: list[str], order: str = "ord") -> DataFrame:
    """One row per key: the last in file order."""
    rest = [c for c in df.columns if c not in keys]
    picked = df.groupBy(*keys).agg(F.max_by(F.struct(*rest), order).alias("__row"))
    return picked.select(*keys, *[F.col("__row")[c].alias(c) for c in rest if c != order])


def first_wins(df: DataFrame, keys: list[str], order: str = "ord") -> DataFrame:
    rest = [c for c in df.columns if c not in keys]
    picked = df.groupBy(*keys).agg(F.min_by(F.struct(*rest), order).alias("__row"))
    return picked.select(*keys, *[F.col("__row")[c].alias(c) for c in rest])


def lookup_join(
    facts: DataFrame,
    table: LookupTable,
    keys: dict[str, str | Column],
    columns: dict[str, str],
    spread: Column | None = None,
) -> DataFrame:
    """Left join that can neither drop nor multiply fact rows.

    keys: dimension column -> fact column (or expression); columns: dimension column -> new name.
    spread: expression that varies between rows without a key; used only for large dimensions.
    """
    exprs = {k: (F.col(v) if isinstance(v, str) else v) for k, v in keys.items()}
    dim = table.df.select(*[F.col(k).alias(f"__k_{k}") for k in keys], *[F.col(c).alias(n) for c, n in columns.items()])
    left = facts.withColumns({f"__f_{k}": e for k, e in exprs.items()})
    on = [F.col(f"__f_{k}") == F.col(f"__k_{k}") for k in keys]
    helper = [f"__f_{k}" for k in keys] + [f"__k_{k}" for k in keys]
    if table.small:
        return left.join(F.broadcast(dim), on, "left").drop(*helper)
    # rows without a key are kept out of the one task where they would meet; hot keys are split by the adaptive planner
    some = spread if spread is not None else F.xxhash64(*facts.columns[:1])
    lost = F.lit(False)
    for k in keys:
        lost = lost | F.col(f"__f_{k}").isNull()
    left = left.withColumn("__fs", F.when(lost, F.pmod(some, F.lit(SPREAD)) + F.lit(1)).otherwise(F.lit(0)))
    dim = dim.withColumn("__ks", F.lit(0).cast("long"))
    return left.join(dim, [*on, F.col("__fs") == F.col("__ks")], "left").drop(*helper, "__fs", "__ks")

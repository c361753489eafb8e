"""Merkle tree expressions over an ordered array of hex SHA-256 leaves."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

ZERO_ROOT = "0" * 64
# leaves of a subtree that is folded as one array, as a power of two
FAN_BITS = 10


def hash_pair(left: Column, right: Column) -> Column:
    return F.sha2(F.unhex(F.concat(left, right)), 256)


def next_level(level: Column) -> Column:
    """Hash neighbours; the last node of an odd level pairs with itself."""
    last = F.size(level) - F.lit(1)
    index = F.sequence(F.lit(0), F.floor(last / F.lit(2)).cast("int"))
    return F.transform(
        index,
        lambda i: hash_pair(F.get(level, i * F.lit(2)), F.get(level, F.least(i * F.lit(2) + F.lit(1), last))),
    )


def root(leaves: Column) -> Column:
    steps = F.filter(F.sequence(F.lit(0), F.lit(30)), lambda h: F.call_function("shiftleft", F.lit(1).cast("long"), h) < F.size(leaves))
    top = F.aggregate(steps, leaves, lambda level, _: next_level(level))
    return F.when(F.size(leaves) > 0, F.get(top, F.lit(0)))


def subtree(nodes: Column) -> Column:
    """The node FAN_BITS levels above: every step is taken, so a lone last node pairs with itself as in the whole tree."""
    return F.get(F.aggregate(F.sequence(F.lit(1), F.lit(FAN_BITS)), nodes, lambda level, _: next_level(level)), F.lit(0))


def subtree_levels(nodes: Column) -> Column:
    """ARRAY of the FAN_BITS levels below that node, the given one first."""
    return F.aggregate(
        F.sequence(F.lit(2), F.lit(FAN_BITS)), F.array(nodes), lambda acc, _: F.concat(acc, F.array(next_level(F.element_at(acc, -1))))
    )


def levels(leaves: Column) -> Column:
    """ARRAY of levels from the leaves to just below the root."""
    steps = F.filter(F.sequence(F.lit(1), F.lit(30)), lambda h: F.call_function("shiftleft", F.lit(1).cast("long"), h) < F.size(leaves))
    start = F.array(leaves)
    return F.when(
        F.size(leaves) > 1,
        F.aggregate(steps, start, lambda acc, _: F.concat(acc, F.array(next_level(F.element_at(acc, -1))))),
    ).otherwise(F.slice(start, 1, 0))


def proof(all_levels: Column, index: Column) -> Column:
    """ARRAY of {sibling, side}: one step per level for the leaf at `index`."""

    def step(level: Column, k: Column) -> Column:
        at = F.call_function("shiftright", index, k)
        even = at % F.lit(2) == F.lit(0)
        sibling = F.when(even, F.coalesce(F.get(level, at + F.lit(1)), F.get(level, at))).otherwise(
            F.get(level, at - F.lit(1))
        )
        return F.struct(sibling.alias("sibling"), F.when(even, F.lit("right")).otherwise(F.lit("left")).alias("side"))

    return F.transform(all_levels, step)


def fold(leaf: Column, path: Column) -> Column:
    """Root reached from a leaf by its proof."""
    return F.aggregate(
        path,
        leaf,
        lambda acc, s: F.when(s["side"] == "left", hash_pair(s["sibling"], acc)).otherwise(hash_pair(acc, s["sibling"])),
    )

"""CIDR lookup: overlapping networks are flattened once into disjoint ranges, and an address is searched in its block.

The networks of one or more tables are dealt over blocks of 2^16 IPv4 addresses. A sweep over a block keeps, for every
table, the first listed network that covers the sweep point, and opens a range wherever one of them changes; so a range
carries the payload of all tables together. A block is one row with the sorted starts of its ranges. An address meets its
block by one equi-join, finds its range there by binary search, and takes the payload by the range's number.

IPv6 networks, few and of few lengths, stay equi-joins on their prefix, one per length present.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field
from heapq import heappop, heappush

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from eventlake.functions.net import IPV4, ipv4_to_long, ipv6_to_hex, is_ipv6
from eventlake.operators.lookup import LookupTable, first_wins, lookup_join, lookup_table

# addresses of a block, as a power of two: a /0 lies in 2^16 blocks, and a block has 2^16 ranges at most
BLOCK_BITS = 16


@dataclass(frozen=True)
class CidrTable:
    """blocks: block, starts (offsets of its ranges, the first 0), first (number of its first range);
    ranges: id and hit, a struct with one field per payload column, prefixed by the number of its table;
    v6: per table and prefix length, one row per prefix with the payload of its first network."""

    blocks: LookupTable
    ranges: LookupTable
    columns: list[list[str]]
    v6: dict[tuple[int, int], LookupTable] = field(default_factory=dict)

    def release(self) -> None:
        for t in (self.blocks, self.ranges, *self.v6.values()):
            t.release()


def with_network(df: DataFrame, cidr: str = "cidr") -> DataFrame:
    """Add ip version, prefix length and the numeric/hex network; a bad CIDR is a load error."""
    ip, plen = F.substring_index(cidr, "/", 1), F.try_element_at(F.split(cidr, "/"), F.lit(2)).try_cast("int")
    v4 = ip.rlike(IPV4) & plen.between(0, 32)
    v6 = is_ipv6(ip) & plen.between(0, 128)
    checked = F.when(F.coalesce(v4 | v6, F.lit(False)), plen).otherwise(
        F.raise_error(F.concat(F.lit("bad cidr "), F.coalesce(F.col(cidr), F.lit("NULL")))).cast("int")
    )
    return df.withColumns(
        {"__plen": checked, "__net": ipv4_to_long(ip), "__net6": ipv6_to_hex(ip)}
    )


def sweep(networks: list[tuple[int, int, int, int]], tables: int) -> Iterator[tuple[int, list[int]]]:
    """(start, winner of each table) of the disjoint ranges of a block; -1 where no network of a table covers a range.

    networks: (table, order, first offset, last offset); a winner is a place in this list, of the smallest order.
    """
    opens: dict[int, list[int]] = {0: []}
    for at, (_, _, lo, hi) in enumerate(networks):
        opens.setdefault(lo, []).append(at)
        opens.setdefault(hi + 1, [])
    covering: list[list[tuple[int, int]]] = [[] for _ in range(tables)]
    before = None
    for start in sorted(opens):
        for at in opens[start]:
            heappush(covering[networks[at][0]], (networks[at][1], at))
        won = []
        for heap in covering:
            while heap and networks[heap[0][1]][3] < start:
                heappop(heap)
            won.append(heap[0][1] if heap else -1)
        if won != before and start < 1 << BLOCK_BITS:
            yield start, won
            before = won


def flatten(sources: list[tuple[DataFrame, list[str]]]) -> DataFrame:
    """block, starts and hits (structs of <table>_<column>) of the IPv4 networks of tables (__plen, __net, ord, payload)."""
    fields = [[T.StructField(f"t{i}_{c}", df.schema[c].dataType) for c in columns] for i, (df, columns) in enumerate(sources)]
    rows = None
    for i, (df, columns) in enumerate(sources):
        plen, net = F.col("__plen"), F.col("__net")
        count = F.call_function("shiftleft", F.lit(1).cast("long"), F.greatest(F.lit(0), F.lit(BLOCK_BITS) - plen))
        first = F.call_function("shiftright", net, F.lit(32 - BLOCK_BITS))
        base = first - F.pmod(first, count)
        size = F.call_function("shiftleft", F.lit(1).cast("long"), F.least(F.lit(BLOCK_BITS), F.lit(32) - plen))
        low = F.pmod(net, F.lit(1 << BLOCK_BITS))
        # the network's own low bits do not count
        lo = F.when(plen <= BLOCK_BITS, F.lit(0)).otherwise(low - F.pmod(low, size)).cast("long")
        own = df.filter(net.isNotNull()).select(F.explode(F.sequence(base, base + count - 1)).alias("block"), lo.alias("lo"), (lo + size - 1).alias("hi"), "ord", *columns)
        # a network that is listed again stays away, so a block holds 2^17 networks of a table at most
        own = first_wins(own, ["block", "lo", "hi"], "ord")
        payload = F.struct(*[F.col(c).alias(f"t{i}_{c}") for c in columns]).alias(f"p{i}")
        own = own.select("block", F.lit(i).alias("table"), "ord", "lo", "hi", payload)
        rows = own if rows is None else rows.unionByName(own, allowMissingColumns=True)
    hit = T.StructType([f for of in fields for f in of])
    schema = T.StructType([T.StructField("block", T.LongType()), T.StructField("starts", T.ArrayType(T.IntegerType())), T.StructField("hits", T.ArrayType(hit))])
    tables = len(sources)

    def blocks_of(rows: pa.Table) -> pa.RecordBatch:
        keys = rows.column("block").to_pylist()
        networks = list(zip(*(rows.column(c).to_pylist() for c in ("table", "ord", "lo", "hi"))))
        cuts = [i for i in range(len(keys)) if not i or keys[i] != keys[i - 1]] + [len(keys)]
        starts, won, ends = [], [[] for _ in fields], [0]
        for lo, hi in zip(cuts, cuts[1:]):
            for start, winners in sweep(networks[lo:hi], tables):
                starts.append(start)
                for of, w in zip(won, winners):
                    of.append(lo + w if w >= 0 else None)
            ends.append(len(starts))
        cols = [c for i, of in enumerate(won) for c in rows.column(f"p{i}").combine_chunks().take(pa.array(of, pa.int64())).flatten()]
        hits = pa.StructArray.from_arrays(cols, [f.name for f in hit])
        offsets = pa.array(ends, pa.int32())
        lists = [pa.ListArray.from_arrays(offsets, v) for v in (pa.array(starts, pa.int32()), hits)]
        return pa.RecordBatch.from_arrays([pa.array([keys[i] for i in cuts[:-1]], pa.int64()), *lists], ["block", "starts", "hits"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None
        for b in batches:
            rows = pa.Table.from_batches([b])
            held = rows if held is None else pa.concat_tables([held, rows])
            # the last block may go on in the next batch
            last = held.column("block")[-1].as_py()
            whole = pc.sum(pc.not_equal(held.column("block"), last)).as_py()
            if whole:
                yield blocks_of(held.slice(0, whole))
                held = held.slice(whole)
        if held is not None and held.num_rows:
            yield blocks_of(held)

    return rows.repartition("block").sortWithinPartitions("block").mapInArrow(run, schema)


def build_tables(sources: list[tuple[DataFrame, list[str]]], cidr: str = "cidr", order: str = "ord") -> CidrTable:
    """Prepare network tables (frame, payload columns) for one common lookup. `order` is the position in the file."""
    nets = [(with_network(df.withColumnRenamed(order, "ord"), cidr).select("__plen", "__net", "__net6", "ord", *columns), columns) for df, columns in sources]
    flat = flatten(nets)
    # numbers of ranges follow from block and place, so no count over all blocks is needed
    numbered = F.col("block") * (1 << BLOCK_BITS)
    blocks = lookup_table(flat.select("block", "starts", numbered.alias("first")))
    ranges = flat.select(numbered.alias("first"), F.posexplode("hits").alias("at", "hit"))
    ranges = lookup_table(ranges.select((F.col("first") + F.col("at")).alias("id"), "hit"))
    v6: dict[tuple[int, int], LookupTable] = {}
    for i, (df, columns) in enumerate(nets):
        # at most 129 lengths; a network that does not parse ends the load here
        six = F.col("__net6").isNotNull()
        lengths = df.select(F.when(six, F.col("__plen")).otherwise(F.least(F.col("__plen"), F.lit(-1))).alias("w")).distinct().limit(130).collect()
        for plen in sorted(r.w for r in lengths if r.w >= 0):
            part = df.filter(F.col("__net6").isNotNull() & (F.col("__plen") == plen))
            keyed = part.withColumn("__block", _v6_prefix(F.col("__net6"), plen))
            v6[i, plen] = lookup_table(first_wins(keyed.select("__block", "ord", *columns), ["__block"], "ord"))
    return CidrTable(blocks, ranges, [c for _, c in sources], v6)


def build_cidr_table(df: DataFrame, columns: list[str], cidr: str = "cidr", order: str = "ord") -> CidrTable:
    """Prepare one network table for lookup."""
    return build_tables([(df, columns)], cidr, order)


def _v6_prefix(hexed: Column, plen: int) -> Column:
    """First `plen` bits of a 32-digit hex address as text."""
    whole, bits = divmod(plen, 4)
    head = F.substring(hexed, 1, whole) if whole else F.lit("")
    if not bits:
        return head
    nibble = F.conv(F.substring(hexed, whole + 1, 1), 16, 10).cast("int")
    return F.concat(head, F.lit("/"), F.shiftright(nibble, 4 - bits).cast("string"))


def _place(starts: Column, offset: Column) -> Column:
    """Place of the last start that is not beyond an offset, by halving steps; the first start is 0."""
    steps = F.array(*[F.lit(1 << k) for k in range(BLOCK_BITS, -1, -1)])
    return F.aggregate(steps, F.lit(0), lambda at, step: F.when(F.get(starts, at + step) <= offset, at + step).otherwise(at))


def cidr_lookup(
    df: DataFrame,
    table: CidrTable,
    ip: str,
    names: dict[str, str] | list[dict[str, str]],
    spread: Column | None = None,
    number: str | None = None,
) -> DataFrame:
    """Add payload columns (`names`: payload column -> output column, one dict per table) for the first network holding `ip`.

    `number` names a column with the IPv4 value, when there is one.
    """
    wanted = [names] if isinstance(names, dict) else names
    keep = df.columns
    if number is None:
        number = "__ipn"
        df = df.withColumn(number, ipv4_to_long(F.col(ip)))
    block = F.call_function("shiftright", F.col(number), F.lit(32 - BLOCK_BITS))
    df = lookup_join(df, table.blocks, {"block": block}, {"starts": "__starts", "first": "__first"}, spread)
    offset = F.pmod(F.col(number), F.lit(1 << BLOCK_BITS)).cast("int")
    range_id = F.when(F.col("__first").isNotNull(), F.col("__first") + _place(F.col("__starts"), offset))
    df = df.withColumn("__range", range_id).drop("__starts", "__first")
    df = lookup_join(df, table.ranges, {"id": F.col("__range")}, {"hit": "__hit"}, spread)
    best = {i: [] for i in range(len(wanted))}
    if table.v6:
        df = df.withColumn("__ip6", F.when(F.col(number).isNull(), ipv6_to_hex(F.col(ip))))
        for (i, plen), level in table.v6.items():
            packed = LookupTable(level.df.select("__block", F.struct("ord", *table.columns[i]).alias("__hit")), level.small)
            df = lookup_join(df, packed, {"__block": _v6_prefix(F.col("__ip6"), plen)}, {"__hit": f"__s{i}_{plen}"}, spread)
            best[i].append(F.col(f"__s{i}_{plen}"))
    out = {}
    for i, of in enumerate(wanted):
        six = F.least(*best[i]) if len(best[i]) > 1 else best[i][0] if best[i] else None
        for c, name in of.items():
            four = F.col("__hit")[f"t{i}_{c}"]
            out[name] = F.coalesce(four, six[c]) if six is not None else four
    return df.select(*[c for c in keep if c not in out], *[v.alias(n) for n, v in out.items()])

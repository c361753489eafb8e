"""Tamper evidence: segments, raw references, Merkle roots, chained ledger, verification.

Every window and every array is bounded by a segment or by the segments of a day, never by
the events of a day.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from eventlake.functions import merkle, timefmt

SEGMENT_BYTES = 64 * 1024 * 1024
SEGMENT_EVENTS = 50_000
SEGMENT_AGE_NS = 300 * timefmt.NS_PER_S


def payload_hash(raw: Column) -> Column:
    return F.sha2(raw.cast("binary"), 256)


def event_id(segment: Column, seq: Column) -> Column:
    """Stable on retry: the same segment and position give the same id."""
    return F.substring(F.sha2(F.concat_ws("|", segment, seq.cast("string")).cast("binary"), 256), 1, 32)


def retrieval_uri(segment: Column, bucket: str = "raw-vault") -> Column:
    return F.format_string("s3a://" + bucket + "/segments/dt=%s/%s.zst", F.substring(segment, 1, 10), segment)


def slots(df: DataFrame, age_ns: int = SEGMENT_AGE_NS) -> DataFrame:
    """Day and time slot of arrival. A slot never crosses a UTC day when age divides a day."""
    slot = timefmt.idiv(F.col("received_at"), age_ns)
    return df.withColumns(
        {"dt": F.date_format(timefmt.from_ns(F.col("received_at")), "yyyy-MM-dd"), "__slot": slot}
    )


def segments(
    df: DataFrame,
    raw: str = "raw",
    age_ns: int = SEGMENT_AGE_NS,
    max_events: int = SEGMENT_EVENTS,
    max_bytes: int = SEGMENT_BYTES,
    bucket: str = "raw-vault",
) -> DataFrame:
    """Add segment, offset, length and hash to every event.

    A busy slot is first counted (map-side combined), then split by a hash of the event id into as
    many buckets as its count asks for. One slot may hold a third of all rows and still no window
    sees more than a bounded bucket.
    """
    rows = slots(df, age_ns).withColumns(
        {"raw_sha256": payload_hash(F.col(raw)), "raw_length": F.octet_length(F.col(raw)).cast("long")}
    )
    sizes = rows.groupBy("dt", "__slot").agg(
        F.ceil(F.greatest(F.count("*") / F.lit(max_events), F.sum("raw_length") / F.lit(max_bytes))).alias("__buckets")
    )
    # one row per time slot; whether it is small enough to broadcast is the planner's to measure
    rows = rows.join(sizes, ["dt", "__slot"])
    rows = rows.withColumn("__bucket", F.pmod(F.xxhash64("event_id"), F.col("__buckets").cast("long")))
    order = Window.partitionBy("dt", "__slot", "__bucket").orderBy("received_at", "event_id")
    before = F.coalesce(F.sum("raw_length").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    rows = rows.withColumns({"__start": before, "__part": timefmt.idiv(before, max_bytes)})
    segment = F.format_string("%s-%012d-%04d-%03d", "dt", "__slot", "__bucket", "__part")
    rows = rows.withColumn("raw_segment_id", segment)
    in_part = Window.partitionBy("dt", "__slot", "__bucket", "__part").orderBy("received_at", "event_id")
    first = F.first("__start").over(in_part)
    return rows.withColumns(
        {
            "raw_offset": F.col("__start") - first,
            "raw_seq": (F.row_number().over(in_part) - F.lit(1)).cast("long"),
            "raw_retrieval_uri": retrieval_uri(F.col("raw_segment_id"), bucket),
        }
    ).drop("__slot", "__buckets", "__bucket", "__start", "__part")


# rounds of 2^10 leaves each: up to 2^30 leaves a segment
ROUNDS = 3


def _round(nodes: DataFrame) -> DataFrame:
    """seg, chunk, its nodes in order (2^FAN_BITS at most), and whether it is the only chunk of its tree."""
    chunk = F.call_function("shiftright", F.col("at"), F.lit(merkle.FAN_BITS)).alias("chunk")
    whole = nodes.groupBy("seg", chunk).agg(F.sort_array(F.collect_list(F.struct("at", "sha"))).alias("own"))
    top = F.max("chunk").over(Window.partitionBy("seg"))
    return whole.select("seg", "chunk", F.col("own.sha").alias("own"), (top == 0).alias("only"))


def tree_roots(nodes: DataFrame) -> DataFrame:
    """seg and root of leaves (seg, at, sha); at counts from 0 without gaps.

    Subtrees of a fixed number of leaves are folded where they are grouped, then their roots in the same way, so no row
    holds a whole segment.
    """
    for _ in range(ROUNDS):
        node = F.when(F.col("only"), merkle.root(F.col("own"))).otherwise(merkle.subtree(F.col("own")))
        nodes = _round(nodes).select("seg", F.col("chunk").alias("at"), node.alias("sha"))
    return nodes.select("seg", F.col("sha").alias("root"))


def tree_nodes(nodes: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(seg, height, at, sha of every node below the root; seg and root) of leaves (seg, at, sha)."""
    out = None
    for i in range(ROUNDS):
        parts = _round(nodes)
        below = F.when(F.col("only"), merkle.levels(F.col("own"))).otherwise(merkle.subtree_levels(F.col("own")))
        rows = parts.select("seg", "chunk", F.posexplode(below).alias("k", "level"))
        rows = rows.select("seg", "chunk", "k", F.posexplode("level").alias("p", "sha"))
        first = F.call_function("shiftleft", F.col("chunk"), F.lit(merkle.FAN_BITS) - F.col("k"))
        rows = rows.select("seg", (F.lit(i * merkle.FAN_BITS) + F.col("k")).alias("height"), (first + F.col("p")).alias("at"), "sha")
        out = rows if out is None else out.unionByName(rows)
        node = F.when(F.col("only"), merkle.root(F.col("own"))).otherwise(merkle.subtree(F.col("own")))
        nodes = parts.select("seg", F.col("chunk").alias("at"), node.alias("sha"))
    return out, nodes.select("seg", F.col("sha").alias("root"))


def _ranked(rows: DataFrame, sha: str, *more: str) -> DataFrame:
    """seg, at (place by sequence number, without gaps), sha and more; a segment is sorted, never gathered in one row."""
    order = Window.partitionBy("raw_segment_id").orderBy("raw_seq", sha, *more)
    at = (F.row_number().over(order) - F.lit(1)).cast("long")
    return rows.select(F.col("raw_segment_id").alias("seg"), at.alias("at"), F.col(sha).alias("sha"), *more)


def ledger(refs: DataFrame) -> DataFrame:
    """One row per segment, chained to the one before it in the same day."""
    sealed = refs.groupBy("dt", F.col("raw_segment_id").alias("segment_id")).agg(
        F.count("*").alias("event_count"),
        F.sum("raw_length").alias("byte_size"),
        F.max("received_at").alias("sealed_at_ns"),
    )
    roots = tree_roots(_ranked(refs, "raw_sha256")).select("seg", F.col("root").alias("merkle_root"))
    return chain(sealed.join(roots, F.col("segment_id") == F.col("seg")).drop("seg"))


def chain(sealed: DataFrame) -> DataFrame:
    day = Window.partitionBy("dt").orderBy("sealed_at_ns", "segment_id")
    return sealed.withColumn("prev_root", F.lag("merkle_root", 1, merkle.ZERO_ROOT).over(day))


def verify(entries: DataFrame, stored: DataFrame, raw: str = "raw", found: str | None = None) -> DataFrame:
    """Recompute hashes and roots of stored payloads and compare them with the ledger.

    One row per ledger segment: pass, reason, recomputed root, chain_ok. A missing segment fails. `found` names a column with
    the hash of the payload as it was read, where it was computed before rows are dealt; payloads then need not travel.
    """
    now = stored.withColumn("__hash", F.col(found) if found else payload_hash(F.col(raw)))
    bad = now.groupBy("raw_segment_id").agg(F.min(F.when(F.col("__hash") != F.col("raw_sha256"), F.col("raw_seq"))).alias("__bad"))
    roots = tree_roots(_ranked(now, "__hash"))
    again = roots.join(bad, F.col("seg") == F.col("raw_segment_id")).select(F.col("seg").alias("segment_id"), F.col("root").alias("recomputed_root"), "__bad")
    day = Window.partitionBy("dt").orderBy("sealed_at_ns", "segment_id")
    rows = entries.withColumn(
        "chain_ok", F.col("prev_root") == F.lag("merkle_root", 1, merkle.ZERO_ROOT).over(day)
    ).join(again, "segment_id", "left")
    reason = (
        F.when(F.col("recomputed_root").isNull(), F.lit("segment missing"))
        .when(F.col("__bad").isNotNull(), F.format_string("event %d does not match its stored hash", "__bad"))
        .when(F.col("recomputed_root") != F.col("merkle_root"), F.lit("root differs from ledger"))
        .when(~F.col("chain_ok"), F.lit("chain broken"))
    )
    return rows.select(
        "segment_id",
        "dt",
        "event_count",
        F.col("merkle_root").alias("ledger_root"),
        "recomputed_root",
        "chain_ok",
        reason.isNull().alias("pass"),
        reason.alias("reason"),
    )


def overall(report: DataFrame) -> DataFrame:
    return report.agg(
        F.coalesce(F.bool_and("pass"), F.lit(True)).alias("pass"),
        F.count("*").alias("segments"),
        F.count_if(~F.col("pass")).alias("failed"),
    )


def proofs(refs: DataFrame) -> DataFrame:
    """Inclusion proof of every event: leaf, index, path, root.

    Trees are laid out as one row per node, built from subtrees of a bounded size; a leaf finds its sibling on each level
    by an equi-join, so a segment of n events makes n log n narrow rows and neither an event nor a row carries the tree.
    """
    ranked = _ranked(refs, "raw_sha256", "event_id")
    leaves = ranked.select(F.col("seg").alias("__seg"), "event_id", F.col("at").alias("index"), F.col("sha").alias("leaf"))
    nodes, tops = tree_nodes(ranked.select("seg", "at", "sha"))
    nodes = nodes.select(F.col("seg").alias("__t"), F.col("height").alias("__h"), F.col("at").alias("__at"), F.col("sha").alias("sibling"))
    sizes = refs.groupBy(F.col("raw_segment_id").alias("__s")).agg(F.count("*").alias("__n"))
    height = F.size(F.filter(F.sequence(F.lit(0), F.lit(30)), lambda h: F.call_function("shiftleft", F.lit(1).cast("long"), h) < F.col("__n")))
    roots = sizes.join(tops, F.col("__s") == F.col("seg")).select("__s", "root", height.alias("__depth"), "__n")
    rows = leaves.join(roots, F.col("__seg") == F.col("__s")).drop("__s")
    step = F.when(F.col("__depth") > 0, F.sequence(F.lit(0), F.col("__depth") - F.lit(1)))
    walk = rows.withColumn("__k", F.explode(step))
    own = F.call_function("shiftright", F.col("index"), F.col("__k"))
    # width of a level: each is half of the one below, rounded up
    width = F.ceil(F.col("__n") / F.call_function("shiftleft", F.lit(1).cast("long"), F.col("__k")))
    even = own % F.lit(2) == F.lit(0)
    beside = F.when(even, F.least(own + F.lit(1), width - F.lit(1))).otherwise(own - F.lit(1))
    walk = walk.select("__seg", "index", "__k", beside.cast("long").alias("__b"), F.when(even, "right").otherwise("left").alias("side"))
    met = walk.join(nodes, (F.col("__seg") == F.col("__t")) & (F.col("__k") == F.col("__h")) & (F.col("__b") == F.col("__at")))
    paths = met.groupBy("__seg", "index").agg(F.sort_array(F.collect_list(F.struct("__k", "sibling", "side"))).alias("__p"))
    paths = paths.select("__seg", "index", F.transform("__p", lambda s: F.struct(s["sibling"].alias("sibling"), s["side"].alias("side"))).alias("path"))
    none = F.array().cast("array<struct<sibling:string,side:string>>")
    out = rows.join(paths, ["__seg", "index"], "left")
    return out.select(F.col("__seg").alias("raw_segment_id"), "event_id", "index", "leaf", F.coalesce("path", none).alias("path"), "root")


def check_proofs(df: DataFrame) -> DataFrame:
    return df.withColumn("verified", merkle.fold(F.col("leaf"), F.col("path")) == F.col("root"))


def read_by_ref(refs: DataFrame, stored: DataFrame, raw: str = "raw") -> DataFrame:
    """Payloads for references, each checked against its hash.

    status: ok, integrity_error (bytes changed), not_found. The join key is unique per event.
    """
    keys = ["raw_segment_id", "raw_offset"]
    have = stored.select(*keys, F.col(raw).alias("payload"))
    rows = refs.join(have, keys, "left")
    good = payload_hash(F.col("payload")) == F.col("raw_sha256")
    status = F.when(F.col("payload").isNull(), "not_found").when(good, "ok").otherwise("integrity_error")
    return rows.withColumns({"status": status, "payload": F.when(good, F.col("payload"))})


def raw_index(refs: DataFrame) -> DataFrame:
    return refs.select(
        "event_id",
        F.col("raw_segment_id").alias("segment_id"),
        F.col("raw_offset").alias("offset"),
        F.col("raw_length").alias("length"),
        F.col("raw_sha256").alias("sha256"),
        "dt",
    )


def trace(events: DataFrame, index: DataFrame, entries: DataFrame) -> DataFrame:
    """Event to index row to sealed segment."""
    seg = entries.select("segment_id", "merkle_root", "prev_root", "sealed_at_ns")
    return events.join(index.drop("dt"), "event_id").join(seg, "segment_id")


def manifest_check(files: DataFrame, manifest: DataFrame) -> DataFrame:
    """Manifest lines whose file is missing or changed. files: binaryFile rows; manifest: name, sha256."""
    have = files.select(
        F.substring_index("path", "/", -1).alias("name"), F.sha2("content", 256).alias("sha256")
    )
    return manifest.join(have, ["name", "sha256"], "left_anti")

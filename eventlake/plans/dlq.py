"""Dead-letter table: shape, upsert, listing, replay, explanation."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from eventlake.functions import timefmt
from eventlake.sources import merge


# entries that a page may have
PAGE = 500


def entries(dead: DataFrame) -> DataFrame:
    """Dead letters to DLQ rows: combined reason, raw reference, open."""
    reason = F.nullif(F.array_join("dlq_reasons", ","), F.lit(""))
    return dead.select(
        "event_id",
        F.struct(
            F.col("raw_segment_id").alias("segment_id"),
            F.col("raw_offset").alias("offset"),
            F.col("raw_length").alias("length"),
            F.col("raw_sha256").alias("sha256"),
        ).alias("raw_ref"),
        F.coalesce(reason, F.lit("unspecified")).alias("reason"),
        F.col("lineage_parser_id").alias("parser_id"),
        timefmt.from_ns(F.col("event_ingested_at")).alias("occurred_at"),
        F.lit(False).alias("resolved"),
    )


def upsert(current: DataFrame, incoming: DataFrame) -> DataFrame:
    """Latest row per event_id; an incoming row beats a current one of the same time."""
    both = current.withColumn("__new", F.lit(0)).unionByName(incoming.withColumn("__new", F.lit(1)))
    rest = [c for c in current.columns if c != "event_id"]
    # max_by combines on the map side, so copies of one event never meet in one task unreduced
    best = both.groupBy("event_id").agg(F.max_by(F.struct(*rest), F.struct("occurred_at", "__new")).alias("r"))
    return best.select("event_id", *[F.col("r")[c].alias(c) for c in rest])


def merge_batch(dead: DataFrame, path: str, version: int, buckets: int = merge.BUCKETS) -> int:
    """Upsert dead letters into the table at `path`; only the buckets of their ids are rewritten. For foreachBatch."""
    incoming = upsert(entries(dead).limit(0), entries(dead))
    return merge.merge(incoming, path, version, "event_id", upsert, buckets)


def table(spark: SparkSession, path: str, schema) -> DataFrame:  # noqa: ANN001
    """The merged table, one row per event; schema as `entries` gives it."""
    return merge.read(spark, path, schema)


def listing(
    rows: DataFrame,
    reason: str | None = None,
    parser_id: str | None = None,
    resolved: bool | None = None,
    limit: int | None = None,
) -> DataFrame:
    """Entries, newest first: all of them, or the first `limit` (1 to 500) as a page."""
    if limit is not None and not 1 <= limit <= PAGE:
        raise ValueError(f"a page has 1 to {PAGE} entries, not {limit}")
    if reason:
        rows = rows.filter(F.col("reason") == reason)
    if parser_id:
        rows = rows.filter(F.col("parser_id") == parser_id)
    if resolved is not None:
        rows = rows.filter(F.col("resolved") == resolved)
    rows = rows.orderBy(F.desc("occurred_at"), "event_id")
    return rows if limit is None else rows.limit(limit)


def by_reason(rows: DataFrame, examples: int = 5) -> DataFrame:
    """Count per combined reason with the first few event ids (a bounded list, not the group)."""
    counts = rows.groupBy("reason").agg(F.count("*").alias("events"), F.min("occurred_at").alias("first_at"))
    first = Window.partitionBy("reason").orderBy("event_id")
    # a per-partition top-n runs before the shuffle (WindowGroupLimit), so a hot reason stays small
    top = rows.withColumn("__rn", F.row_number().over(first)).filter(F.col("__rn") <= examples)
    ids = top.groupBy("reason").agg(F.sort_array(F.collect_list("event_id")).alias("event_ids"))
    return counts.join(ids, "reason")


def replay(rows: DataFrame, ids: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(rows to re-drive, ids that are not in the table)."""
    wanted = ids.select("event_id").distinct()
    return rows.join(wanted, "event_id", "left_semi"), wanted.join(rows, "event_id", "left_anti")


def resolve(rows: DataFrame, ids: DataFrame) -> DataFrame:
    """The table with the entries of these ids marked as resolved; others stay as they are."""
    done = ids.select("event_id").distinct().withColumn("__done", F.lit(True))
    out = rows.join(done, "event_id", "left")
    return out.withColumn("resolved", F.col("resolved") | F.coalesce("__done", F.lit(False))).select(*rows.columns)


def replay_messages(found: DataFrame) -> DataFrame:
    """The raw references to read again, as ordinary ingest messages."""
    return found.select(
        "event_id", F.col("raw_ref").alias("ref"), F.lit("dlq-replay").alias("listener_id"), F.lit("").alias("peer_ip")
    )


# Reason codes with the stage that raises them; texts are our own.
REASONS = {
    "bad_ip": ("validate", "an address does not parse", "look at the raw address and its mapping"),
    "bad_port": ("validate", "a port is outside 0 to 65535", "look at the raw port and its conversion"),
    "schema_violation": ("validate", "the event breaks a schema rule", "compare mapping and schema"),
    "timestamp_out_of_range": ("validate", "the event time is too far from now", "check time zone and clock"),
}


def explain(rows: DataFrame) -> DataFrame:
    """One row per reason code of an event with stage and hints."""
    code = F.explode(F.filter(F.transform(F.split(F.coalesce("reason", F.lit("unknown")), ","), F.trim), lambda c: c != ""))
    out = rows.select("event_id", code.alias("code"))

    def pick(i: int, default: str):
        pairs = [F.lit(x) for k, v in REASONS.items() for x in (k, v[i])]
        return F.coalesce(F.create_map(*pairs)[F.col("code")], F.lit(default))

    return out.withColumns(
        {
            "stage": pick(0, "unknown"),
            "explanation": pick(1, "the reason code is not known"),
            "next_check": pick(2, "read the raw event"),
        }
    )

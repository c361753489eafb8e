"""Relationship graph: vendor to event, event to endpoint, event to dead-letter reason."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def edges(rows: DataFrame) -> DataFrame:
    """Edges of every event. rows: event_id, observer_vendor, src_ip, dst_ip, state, is_dlq, dlq_reason."""
    event = F.concat(F.lit("event:"), F.col("event_id"))
    vendor = F.concat(F.lit("vendor:"), F.coalesce("observer_vendor", F.lit("Unknown vendor")))

    def edge(source, target, state):
        return F.struct(source.alias("source"), target.alias("target"), state.alias("state"))

    reasons = F.filter(
        F.transform(F.split(F.coalesce("dlq_reason", F.lit("unknown reason")), ","), F.trim), lambda r: r != ""
    )
    to_reason = F.transform(reasons, lambda r: edge(event, F.concat(F.lit("reason:"), r), F.lit("dlq")))
    ips = F.array_compact(F.array("src_ip", "dst_ip"))
    to_ip = F.transform(ips, lambda ip: edge(event, F.concat(F.lit("ip:"), ip), F.col("state")))
    everything = F.concat(
        F.array(edge(vendor, event, F.col("state"))),
        F.when(F.col("is_dlq"), to_reason).otherwise(F.slice(to_reason, 1, 0)),
        to_ip,
    )
    return rows.select(F.explode(everything).alias("e")).select("e.*")


def nodes(links: DataFrame) -> DataFrame:
    """Distinct nodes with kind and label."""
    ids = links.select(F.explode(F.array("source", "target")).alias("id")).distinct()
    kind = F.substring_index("id", ":", 1)
    label = F.expr("substring(id, locate(':', id) + 1)")
    return ids.select(
        "id",
        F.when(kind == "ip", "endpoint").otherwise(kind).alias("kind"),
        F.when(kind == "reason", F.replace(label, F.lit("_"), F.lit(" ")))
        .when(kind == "event", F.substring(label, 1, 12))
        .otherwise(label)
        .alias("label"),
    )


def events_for_node(rows: DataFrame, links: DataFrame, node: str) -> DataFrame:
    """Events next to a node (or the event itself), newest first."""
    if node.startswith("event:"):
        hit = rows.filter(F.col("event_id") == node.split(":", 1)[1])
    else:
        near = links.filter((F.col("source") == node) | (F.col("target") == node))
        other = F.when(F.col("source") == node, F.col("target")).otherwise(F.col("source"))
        ids = near.select(F.regexp_replace(other, "^event:", "").alias("event_id")).distinct()
        hit = rows.join(ids, "event_id", "left_semi")
    return hit.orderBy(F.desc("event_ingested_at"), "event_id")


def neighbours(links: DataFrame, node: str) -> DataFrame:
    """Nodes one hop away, in either direction."""
    near = links.filter((F.col("source") == node) | (F.col("target") == node))
    return near.select(F.when(F.col("source") == node, F.col("target")).otherwise(F.col("source")).alias("id")).distinct()

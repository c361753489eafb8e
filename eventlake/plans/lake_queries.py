"""The canonical queries over the event table and its companions."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from eventlake.functions import timefmt


def _day(df: DataFrame, dt: str | None) -> DataFrame:
    return df.filter(F.col("dt") == dt) if dt else df


def cross_vendor(events: DataFrame, dt: str | None = None, port: int = 443) -> DataFrame:
    return (
        _day(events, dt)
        .filter(F.col("dst_port") == port)
        .groupBy("observer_vendor", "observer_product", "event_action")
        .agg(F.count("*").alias("events"), F.sum("network_bytes_total").alias("bytes"))
        .orderBy(F.desc("events"), "observer_vendor", "event_action")
    )


def hot_and_cold(stream: DataFrame, events: DataFrame, dt: str | None = None) -> DataFrame:
    def tier(df: DataFrame, name: str) -> DataFrame:
        return df.groupBy("src_ip").agg(F.count("*").alias("events")).select(F.lit(name).alias("tier"), "src_ip", "events")

    return tier(stream, "live").unionByName(tier(_day(events, dt), "historical"))


def registry_quality(events: DataFrame, registry: DataFrame, dt: str | None = None) -> DataFrame:
    """Quality per vendor, parser and registered version. A parser with n versions counts n times.

    Events are reduced to one row per vendor and parser before the join, so nothing fans out at full size.
    """
    per_parser = (
        _day(events, dt)
        .groupBy("observer_vendor", "lineage_parser_id")
        .agg(F.count("*").alias("n"), F.sum("quality_score").alias("q"))
    )
    reg = registry.select("parser_id", F.col("version").alias("registered_version"), "published_at")
    return (
        per_parser.join(reg, per_parser.lineage_parser_id == reg.parser_id)
        .groupBy("observer_vendor", "lineage_parser_id", "registered_version", "published_at")
        .agg(F.sum("n").alias("events"), (F.sum("q") / F.sum("n")).alias("avg_quality"))
    )


def custody(events: DataFrame, segments: DataFrame, event_id: str | None = None) -> DataFrame:
    """Pointer of an event to its sealed segment; all events when no id is given."""
    if event_id is not None:
        events = events.filter(F.col("event_id") == event_id)
    refs = events.select("event_id", "raw_sha256", "raw_segment_id", "raw_offset", "raw_length")
    seg = segments.select("segment_id", "merkle_root", "prev_root", "sealed_at_ns")
    return refs.join(seg, refs.raw_segment_id == seg.segment_id).drop("segment_id")


def losslessness(events: DataFrame, dt: str | None = None) -> DataFrame:
    return (
        _day(events, dt)
        .groupBy("observer_vendor")
        .agg(
            F.count("*").alias("events"),
            F.avg(F.size("unmapped")).alias("avg_unmapped_fields"),
            F.count_if(F.col("raw_sha256").isNull()).alias("missing_raw_ref"),
        )
    )


def parser_health(events: DataFrame, dt: str | None = None) -> DataFrame:
    return (
        _day(events, dt)
        .groupBy("lineage_parser_id", "hour")
        .agg(
            F.avg("quality_score").alias("avg_quality"),
            F.count_if(F.col("lineage_parse_status") == "partial").alias("partials"),
        )
        .orderBy("lineage_parser_id", "hour")
    )


def source_features(events: DataFrame, dt: str | None = None, approximate: bool = False) -> DataFrame:
    """Per source address and hour: fan-out, byte ratio, block rate.

    Exact distinct counts first reduce to one row per (source, hour, destination, port), which splits a
    hot source over many tasks; `approximate` uses sketches in one pass.
    """
    hour = F.date_trunc("hour", timefmt.from_ns(F.col("event_observed_at"))).alias("hr")
    rows = _day(events, dt).select("src_ip", hour, "dst_ip", "dst_port", "network_bytes_out", "network_bytes_in", "event_action")
    blocked = F.count_if(F.col("event_action") == "blocked")
    if approximate:
        return rows.groupBy("src_ip", "hr").agg(
            F.approx_count_distinct("dst_ip").alias("distinct_dsts"),
            F.approx_count_distinct("dst_port").alias("distinct_ports"),
            F.try_divide(F.sum("network_bytes_out"), F.sum("network_bytes_in")).alias("out_in_ratio"),
            (blocked / F.count("*")).alias("block_rate"),
        )
    keys = ["src_ip", "hr"]
    fine = rows.groupBy(*keys, "dst_ip", "dst_port").agg(
        F.sum("network_bytes_out").alias("o"),
        F.sum("network_bytes_in").alias("i"),
        blocked.alias("b"),
        F.count("*").alias("n"),
    )
    return fine.groupBy(*keys).agg(
        F.count_distinct("dst_ip").alias("distinct_dsts"),
        F.count_distinct("dst_port").alias("distinct_ports"),
        F.try_divide(F.sum("o"), F.sum("i")).alias("out_in_ratio"),
        (F.sum("b") / F.sum("n")).alias("block_rate"),
    )


def recent(events: DataFrame, n: int = 100) -> DataFrame:
    return events.orderBy(F.desc("event_ingested_at"), "event_id").limit(n)


def by_id(events: DataFrame, event_id: str) -> DataFrame:
    return events.filter(F.col("event_id") == event_id).limit(1)


def vault_chain(segments: DataFrame, n: int = 20) -> DataFrame:
    """Newest segments, oldest of them first."""
    newest = segments.orderBy(F.desc("sealed_at_ns"), F.desc("segment_id")).limit(n)
    return newest.orderBy("sealed_at_ns", "segment_id")


def totals(events: DataFrame, column: str = "observer_vendor") -> DataFrame:
    name = F.coalesce(F.col(column), F.lit("unknown"))
    return events.groupBy(name.alias("name")).agg(F.count("*").alias("events")).orderBy(F.desc("events"), "name")


# --- parser registry, rollout, inventory -------------------------------------------


def latest_versions(registry: DataFrame) -> DataFrame:
    rest = [c for c in registry.columns if c != "parser_id"]
    best = registry.groupBy("parser_id").agg(F.max_by(F.struct(*rest), F.struct("published_at", "id")).alias("r"))
    return best.select("parser_id", *[F.col("r")[c].alias(c) for c in rest])


def version_history(registry: DataFrame, parser_id: str) -> DataFrame:
    return registry.filter(F.col("parser_id") == parser_id).orderBy(F.desc("published_at"), F.desc("id"))


def rollback_targets(registry: DataFrame) -> DataFrame:
    """Second newest published version per parser; parsers with fewer than two have none."""
    newest = Window.partitionBy("parser_id").orderBy(F.desc("published_at"), F.desc("id"))
    published = registry.filter(F.col("state") == "published")
    # rank <= 2 is pushed below the shuffle as a per-partition limit
    ranked = published.withColumn("rn", F.row_number().over(newest)).filter(F.col("rn") <= 2)
    return ranked.filter(F.col("rn") == 2).drop("rn")


def rollout(reports: DataFrame, registry: DataFrame) -> DataFrame:
    """Latest report per node and parser next to the newest registered version."""
    last = reports.groupBy("node_id", "parser_id").agg(
        F.max_by("loaded_version", "reported_at").alias("loaded_version"), F.max("reported_at").alias("reported_at")
    )
    newest = latest_versions(registry).select("parser_id", F.col("version").alias("latest_version"))
    return last.join(newest, "parser_id", "left").withColumn(
        "behind", ~F.coalesce(F.col("loaded_version") == F.col("latest_version"), F.lit(False))
    )


def source_inventory(sources: DataFrame, events: DataFrame) -> DataFrame:
    seen = events.groupBy(F.col("observer_vendor").alias("vendor")).agg(F.max("event_ingested_at").alias("last_seen_ns"))
    return sources.join(seen, "vendor", "left").orderBy("name")

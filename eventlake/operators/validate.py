"""Validation: schema rules, type rules, quality score, violations as data."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from eventlake.functions.net import is_ip
from eventlake.functions.timefmt import NS_PER_S

YEAR_NS = 365 * 86_400 * NS_PER_S

# Schema rules by column.
# Other required keys are always written, empty at worst, so they cannot be missing.
REQUIRED = (
    "event_id event_kind event_observed_at event_ingested_at raw_sha256 lineage_parser_id lineage_parse_status"
).split()
ENUMS = {
    "event_kind": "event alert metric state",
    "event_outcome": "success failure unknown",
    "network_direction": "inbound outbound internal unknown",
    "lineage_parse_status": "ok partial failed",
}
RANGES = {
    "event_severity_id": (0, 6),
    "src_port": (0, 65535),
    "dst_port": (0, 65535),
    "network_bytes_in": (0, None),
    "network_bytes_out": (0, None),
    "network_bytes_total": (0, None),
    "network_packets_in": (0, None),
    "network_packets_out": (0, None),
    "network_duration_ms": (0, None),
    "enrich_risk_score": (0, 100),
    "raw_offset": (0, None),
    "raw_length": (0, None),
}
SHA256_HEX = r"\A[a-f0-9]{64}\z"


# made by the chain itself as a capped sum of weights, never null and never negative: its rule cannot fail
OWN = "enrich_risk_score"


def schema_errors(skip: tuple[str, ...] = ()) -> list[Column]:
    """One nullable message per rule, but for rules on the columns of `skip`."""
    out = [F.when(F.col(c).isNull(), F.lit(f"{c}: missing")) for c in REQUIRED]
    for c, words in ENUMS.items():
        out.append(F.when(~F.col(c).isin(words.split()), F.lit(f"{c}: not in the allowed set")))
    for c, (lo, hi) in RANGES.items():
        if c in skip:
            continue
        bad = F.col(c) < lo if hi is None else ~F.col(c).between(lo, hi)
        out.append(F.when(bad, F.lit(f"{c}: out of range")))
    out.append(F.when(~F.col("raw_sha256").rlike(SHA256_HEX), F.lit("raw_sha256: bad format")))
    return out


def bad_port(port: str) -> Column:
    return F.when(~F.col(port).between(0, 65535), _violation("bad_port", F.concat(F.lit(f"{port} "), F.col(port), F.lit(" out of range"))))


def bad_ip(ip: str) -> Column:
    return F.when(~is_ip(F.col(ip)), _violation("bad_ip", F.concat(F.lit(f"{ip} "), F.col(ip), F.lit(" does not parse"))))


def out_of_range(now_ns: Column) -> Column:
    observed = F.col("event_observed_at")
    return F.when(
        (observed != 0) & (F.abs(now_ns - observed) > F.lit(YEAR_NS)),
        _violation("timestamp_out_of_range", F.lit("event_observed_at is more than a year from now")),
    )


def _violation(reason: str | Column, message: Column) -> Column:
    reason = F.lit(reason) if isinstance(reason, str) else reason
    return F.struct(reason.alias("reason"), message.alias("message"))


def quality(mapped: Column, expected: Column, confidence: Column) -> Column:
    """min(1, mapped/expected) × confidence within 0 … 1; nothing expected scores 0."""
    ratio = F.least(F.lit(1.0), mapped.cast("double") / F.nullif(expected, F.lit(0)).cast("double"))
    return F.coalesce(F.greatest(F.lit(0.0), F.least(F.lit(1.0), ratio * confidence)), F.lit(0.0))


def violations(now_ns: Column, skip: tuple[str, ...] = ()) -> Column:
    """ARRAY of {reason, message}. Identification faults stand alone."""
    errors = schema_errors(skip)
    broken = reduce(lambda a, b: a | b, [e.isNotNull() for e in errors])
    schema = F.when(broken, _violation("schema_violation", F.array_join(F.array_compact(F.array(*errors)), "; ")))
    checks = [schema, bad_port("src_port"), bad_port("dst_port"), bad_ip("src_ip"), bad_ip("dst_ip"), out_of_range(now_ns)]
    fault = F.array(_violation(F.col("v_fault"), F.concat(F.lit("parser "), F.col("lineage_parser_id"))))
    return F.when(F.col("v_fault").isNotNull(), fault).otherwise(F.array_compact(F.array(*checks)))


# Columns that validation makes and what it reads for them.
CHECKS: dict[str, tuple[str, ...]] = {
    "quality_score": ("v_mapped", "v_expected", "v_confidence", "v_fault"),
    "violations": (*REQUIRED, *ENUMS, *(c for c in RANGES if c != OWN), "src_ip", "dst_ip", "v_fault"),
}


def validate(df: DataFrame, now_ns: Column, wanted: set[str] | None = None) -> DataFrame:
    """Add quality_score and violations, or those of them that are wanted.

    With `wanted`, the chain's own score is not made for its rule alone: the lookups behind it would run for a rule that holds.
    """
    score = quality(F.col("v_mapped"), F.col("v_expected"), F.col("v_confidence"))
    if wanted is None or "quality_score" in wanted:
        df = df.withColumn("quality_score", F.when(F.col("v_fault").isNotNull(), F.lit(0.0)).otherwise(score))
    skip = (OWN,) if wanted is not None and OWN not in wanted else ()
    return df.withColumn("violations", violations(now_ns, skip)) if wanted is None or "violations" in wanted else df


def count_by_reason(df: DataFrame) -> DataFrame:
    """Dead-letter count per reason: one per violation, so an event may count more than once."""
    return df.select(F.explode("violations.reason").alias("reason")).groupBy("reason").agg(F.count("*").alias("events"))


def field_loss(df: DataFrame) -> DataFrame:
    """Extracted keys that are neither consumed by the mapping nor kept in unmapped (must be empty)."""
    known = F.array_union(F.col("consumed"), F.map_keys("unmapped"))
    return df.withColumn("lost_fields", F.array_except(F.map_keys("fields"), known))

"""The event schema: one table of columns drives projection, nesting and validation."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import types as T

_S, _L, _D, _B = T.StringType(), T.LongType(), T.DoubleType(), T.BooleanType()
_M = T.MapType(T.StringType(), T.StringType())


@dataclass(frozen=True)
class EventColumn:
    namespace: str
    field: str
    dtype: T.DataType
    settable: bool  # may a mapping pack write it?

    @property
    def path(self) -> str:
        return f"{self.namespace}.{self.field}" if self.field else self.namespace

    @property
    def name(self) -> str:
        return f"{self.namespace}_{self.field}" if self.field else self.namespace


# The column contract of the event table, in table order.
# "!" marks columns only the library sets, a suffix gives a non-string type.
_SPEC = {
    "event": "!id kind category type action outcome severity_id:l original_time_string observed_at:l "
    "!ingested_at:l !time_skew_ms:l dataset",
    "observer": "vendor product type hostname ip version",
    "src": "ip port:l mac hostname user zone",
    "dst": "ip port:l mac hostname zone",
    "network": "transport direction bytes_in:l bytes_out:l bytes_total:l packets_in:l packets_out:l "
    "duration_ms:l protocol",
    "http": "method status_code:l user_agent",
    "url": "full domain path",
    "dns": "question_name question_type response_code",
    "tls": "version sni cipher",
    "actor": "user id",
    "threat": "signature_id signature_name category severity mitre_tactic mitre_technique",
    "enrich": "!src_geo_country !src_geo_city !src_asn:l !src_as_org !dst_geo_country !dst_geo_city "
    "!dst_asn:l !dst_as_org !src_is_internal:b !dst_is_internal:b !ioc_match:b !ioc_indicator !risk_score:d",
    "raw": "!sha256 !segment_id !offset:l !length:l !retrieval_uri",
    "lineage": "!parser_id !parser_version !parse_status !node_id !processing_ms:d",
    "quality": "!score:d",
}


def _expand() -> list[EventColumn]:
    kinds = {"": _S, "l": _L, "d": _D, "b": _B}
    out = []
    for ns, words in _SPEC.items():
        for word in words.split():
            locked = word.startswith("!")
            field, _, kind = word.lstrip("!").partition(":")
            out.append(EventColumn(ns, field, kinds[kind], not locked))
    out.append(EventColumn("unmapped", "", _M, False))
    return out


COLUMNS: list[EventColumn] = _expand()
BY_PATH = {c.path: c for c in COLUMNS}
BY_NAME = {c.name: c for c in COLUMNS}
FLAT_NAMES = [c.name for c in COLUMNS]
SETTABLE_PATHS = [c.path for c in COLUMNS if c.settable]
PARTITIONS = ["dt", "hour", "vendor"]

FLAT_SCHEMA = T.StructType([T.StructField(c.name, c.dtype) for c in COLUMNS])
LAKE_SCHEMA = T.StructType(FLAT_SCHEMA.fields + [T.StructField(p, _S) for p in PARTITIONS])

RAW_REF = T.StructType(
    [
        T.StructField("segment_id", _S),
        T.StructField("offset", _L),
        T.StructField("length", _L),
        T.StructField("sha256", _S),
    ]
)
RAW_REF_MESSAGE = T.StructType(
    [
        T.StructField("event_id", _S),
        T.StructField("ref", RAW_REF),
        T.StructField("listener_id", _S),
        T.StructField("peer_ip", _S),
        T.StructField("received_at", _S),
    ]
)
LEDGER_SCHEMA = T.StructType(
    [
        T.StructField("segment_id", _S),
        T.StructField("event_count", _L),
        T.StructField("merkle_root", _S),
        T.StructField("prev_root", _S),
        T.StructField("sealed_at_ns", _L),
        T.StructField("byte_size", _L),
    ]
)

# The columns the live stream table exposes.
STREAM_COLUMNS = (
    "event_id event_kind event_category event_type event_action event_outcome event_severity_id event_dataset "
    "event_observed_at event_ingested_at observer_vendor observer_product observer_type observer_hostname "
    "src_ip src_port src_zone dst_ip dst_port dst_zone network_transport network_direction network_bytes_in "
    "network_bytes_out network_bytes_total network_duration_ms actor_user threat_signature_id threat_category "
    "enrich_src_geo_country enrich_dst_geo_country enrich_src_is_internal enrich_ioc_match enrich_risk_score "
    "raw_sha256 raw_segment_id lineage_parser_id lineage_parser_version lineage_parse_status quality_score"
).split()

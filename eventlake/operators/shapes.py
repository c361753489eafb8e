"""Render event rows in other schemas."""

from __future__ import annotations

from itertools import groupby

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from eventlake.functions import timefmt
from eventlake.schema import COLUMNS


def nested(df: DataFrame) -> Column:
    """One struct per namespace, as in the nested event document."""
    have = set(df.columns)
    out = []
    for ns, cols in groupby([c for c in COLUMNS if c.field and c.name in have], key=lambda c: c.namespace):
        out.append(F.struct(*[F.col(c.name).alias(c.field) for c in cols]).alias(ns))
    return F.struct(*out, F.coalesce("unmapped", F.create_map().cast("map<string,string>")).alias("unmapped"))


def nested_json(df: DataFrame) -> Column:
    return F.to_json(nested(df))


def _iso_ns(ns: Column) -> Column:
    """RFC 3339 in UTC with the fraction only as long as needed."""
    base = F.date_format(timefmt.from_ns(ns), "yyyy-MM-dd'T'HH:mm:ss")
    fraction = F.rtrim(F.lpad(F.pmod(ns, F.lit(timefmt.NS_PER_S)).cast("string"), 9, "0"), F.lit("0"))
    return F.concat(base, F.when(fraction != "", F.concat(F.lit("."), fraction)).otherwise(F.lit("")), F.lit("Z"))


def _text(name: str) -> Column:
    return F.coalesce(F.col(name), F.lit(""))


def _int(name: str) -> Column:
    return F.coalesce(F.col(name), F.lit(0))


def ecs() -> Column:
    """Elastic Common Schema subset as JSON text; threat only when there is a signature."""
    s = lambda **kw: F.struct(*[c.alias(k) for k, c in kw.items()])
    side = lambda p: s(ip=_text(f"{p}_ip"), port=_int(f"{p}_port"), address=_text(f"{p}_ip"))
    threat = F.when(
        F.col("threat_signature_id").isNotNull(),
        s(
            indicator=s(provider=_text("observer_vendor")),
            technique=s(id=_text("threat_mitre_technique"), name=_text("threat_mitre_technique")),
            tactic=s(id=_text("threat_mitre_tactic")),
        ),
    )
    doc = F.struct(
        _iso_ns(F.col("event_observed_at")).alias("@timestamp"),
        s(
            id=F.col("event_id"),
            kind=_text("event_kind"),
            category=F.array(_text("event_category")),
            type=F.array(_text("event_type")),
            action=_text("event_action"),
            outcome=_text("event_outcome"),
            severity=_int("event_severity_id"),
            dataset=_text("event_dataset"),
            original=_text("event_original_time_string"),
        ).alias("event"),
        s(
            vendor=_text("observer_vendor"),
            product=_text("observer_product"),
            type=_text("observer_type"),
            name=_text("observer_hostname"),
        ).alias("observer"),
        side("src").alias("source"),
        side("dst").alias("destination"),
        s(
            transport=_text("network_transport"),
            direction=_text("network_direction"),
            protocol=_text("network_protocol"),
            bytes=_int("network_bytes_total"),
        ).alias("network"),
        threat.alias("threat"),
    )
    return F.to_json(doc)


# OCSF class and category numbers for network activity.
_OCSF = {
    "class_uid": 4001,
    "class_name": "Network Activity",
    "category_uid": 4,
    "category_name": "Network Activity",
    "activity_id": 1,
    "activity_name": "Traffic",
    "type_uid": 400101,
}


def ocsf() -> Column:
    """OCSF network activity as JSON text."""
    s = lambda **kw: F.struct(*[c.alias(k) for k, c in kw.items()])
    status = F.when(F.col("event_outcome") == "success", 1).when(F.col("event_outcome") == "failure", 2).otherwise(0)
    side = lambda p: s(ip=_text(f"{p}_ip"), port=_int(f"{p}_port"))
    product = s(vendor_name=_text("observer_vendor"), name=_text("observer_product"), version=_text("observer_version"))
    return F.to_json(
        F.struct(
            *[F.lit(v).alias(k) for k, v in _OCSF.items()],
            _int("event_severity_id").alias("severity_id"),
            status.alias("status_id"),
            _text("event_outcome").alias("status"),
            timefmt.idiv(F.col("event_observed_at"), timefmt.NS_PER_MS).alias("time"),
            side("src").alias("src_endpoint"),
            side("dst").alias("dst_endpoint"),
            s(protocol_name=_text("network_transport"), direction=_text("network_direction")).alias("connection_info"),
            s(
                bytes_in=_int("network_bytes_in"), bytes_out=_int("network_bytes_out"), bytes=_int("network_bytes_total")
            ).alias("traffic"),
            s(product=product, uid=F.col("event_id")).alias("metadata"),
            F.col("unmapped"),
        )
    )


# CEF extension keys and the columns they carry, in output order.
_CEF_EXT = {
    "src": "src_ip",
    "spt": "src_port",
    "dst": "dst_ip",
    "dpt": "dst_port",
    "proto": "network_transport",
    "act": "event_action",
    "outcome": "event_outcome",
    "out": "network_bytes_out",
    "in": "network_bytes_in",
    "dhost": "dst_hostname",
    "shost": "src_hostname",
    "cs1": "event_dataset",
}


def _escape(text: Column, special: str) -> Column:
    text = F.replace(text, F.lit("\\"), F.lit("\\\\"))
    return F.replace(text, F.lit(special), F.lit("\\" + special))


def cef(dataset_label: str = "dataset") -> Column:
    """One CEF line; absent and zero extension values are left out."""
    header = [
        F.coalesce("observer_vendor", F.lit("unknown")),
        F.coalesce("observer_product", F.lit("unknown")),
        F.coalesce("observer_version", F.lit("1.0")),
        F.coalesce("threat_signature_id", "event_dataset", F.lit("")),
        F.coalesce("event_action", "event_type", F.lit("")),
    ]
    head = F.concat_ws(
        "|", F.lit("CEF:0"), *[_escape(h, "|") for h in header], _int("event_severity_id").cast("string")
    )
    ext = []
    for key, name in _CEF_EXT.items():
        text = F.nullif(F.nullif(F.col(name).cast("string"), F.lit("")), F.lit("0"))
        ext.append(F.concat(F.lit(key + "="), _escape(text, "=")))
    ext.append(F.lit(f"cs1Label={dataset_label}"))
    return F.concat(head, F.lit("|"), F.concat_ws(" ", *ext))

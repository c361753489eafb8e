"""Project extracted fields onto the event schema without losing any."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from eventlake.functions import timefmt
from eventlake.operators.fieldset import empty_map, seal
from eventlake.operators.parse import ParsedPack, by_pack, compile_packs
from eventlake.operators.parse_ops import literal_lookup, to_bool, to_float, to_int
from eventlake.schema import BY_PATH, COLUMNS, SETTABLE_PATHS
from eventlake.sources.packs import Mapping, PackError, PackSet

_UNIT_NS = {"seconds": timefmt.NS_PER_S, "milliseconds": timefmt.NS_PER_MS, "nanoseconds": 1}
_TEXT = "string"


def dictionary_value(table: dict[str, str] | None, text: Column) -> Column:
    """Case-insensitive lookup; unknown words give the default, else pass through."""
    if table is None:
        return text
    default = table.get("_default")
    known = {k: v for k, v in table.items() if k != "_default"}
    fallback = F.lit(default) if default is not None else text
    return F.when(text.isNotNull(), F.coalesce(literal_lookup(known, F.lower(text)), fallback))


def timestamp_value(text: Column, spec: dict, now: Column) -> Column:
    """Epoch nanoseconds, NULL when the text does not parse."""
    unit = spec.get("epoch_unit")
    if unit:
        if unit not in _UNIT_NS:
            raise PackError(f"unknown epoch_unit {unit}")
        return F.call_function("try_multiply", text.try_cast("long"), F.lit(_UNIT_NS[unit]))
    layouts = spec.get("formats") or []
    if not layouts:
        raise PackError("timestamp without formats")
    zone = spec.get("timezone")
    tries = []
    for layout in layouts:
        if not timefmt.has_year(layout) and spec.get("infer_missing_year"):
            tries.append(timefmt.infer_year(text, layout, zone, now))
        else:
            tries.append(timefmt.parse_layout(text, layout, zone))
    return timefmt.to_ns(F.coalesce(*tries))


class MappedField:
    """One mapping line compiled for one pack."""

    def __init__(self, path: str, spec: dict, parsed: ParsedPack, packs: PackSet, now: Column):
        kind = BY_PATH[path].dtype.typeName()
        source = spec.get("from") if not spec.get("const") else None
        number = None
        if spec.get("const"):
            text = F.lit(str(spec["const"]))
        else:
            value = parsed.fields.get(source) if source else None
            text = value.text if value is not None else F.lit(None).cast(_TEXT)
            number = value.number if value is not None else None
            if spec.get("default"):
                text, number = F.coalesce(text, F.lit(str(spec["default"]))), None
        self.source = source
        self.present = text.isNotNull()
        if spec.get("skip_if"):
            keep = ~F.coalesce(text == F.lit(str(spec["skip_if"])), F.lit(False))
            self.present = self.present & keep
            text, number = F.when(keep, text), None
        if spec.get("dictionary"):
            text, number = dictionary_value(packs.dictionaries.get(spec["dictionary"]), text), None

        transform = spec.get("transform") or "string"
        if spec.get("timestamp"):
            self.value = timestamp_value(text, spec["timestamp"], now)
        elif transform == "int":
            self.value = number if number is not None else to_int(text)
        elif transform == "float":
            self.value = to_float(text)
        elif transform == "bool":
            self.value = to_bool(text)
        else:
            self.value = text
        self.mapped = self.value.isNotNull()
        # typed for its column: numbers in text columns print, text in number columns is absent
        if kind == "string":
            self.column = F.nullif(self.value.cast(_TEXT), F.lit(""))
        elif transform in ("int", "float") or spec.get("timestamp"):
            self.column = self.value.cast(kind)
        else:
            self.column = F.lit(None).cast(kind)
        self.can_fail = bool(spec.get("timestamp")) or transform in ("int", "float", "bool")

    @property
    def failed(self) -> Column:
        return self.present & ~self.mapped


def compile_mapping(parsed: ParsedPack, mapping: Mapping, packs: PackSet, now: Column) -> dict[str, MappedField]:
    return {path: MappedField(path, spec, parsed, packs, now) for path, spec in mapping.fields.items()}


def unmapped_fields(parsed: ParsedPack, mapping: Mapping, fields: dict[str, MappedField]) -> Column:
    """Everything no mapping line consumed, and values a mapping line could not convert."""
    rest = parsed.fields.to_map(skip=mapping.consumed)
    kept: dict[str, Column] = {}
    for f in fields.values():
        if f.source and f.can_fail:
            kept[f.source] = kept[f.source] | f.failed if f.source in kept else f.failed
    if not kept:
        return rest
    pairs: list[Column] = []
    for name, failed in kept.items():
        pairs += [F.lit(name), F.when(failed, parsed.fields.get(name).text)]
    any_failed = reduce(lambda a, b: a | b, kept.values())
    extra = F.map_filter(F.create_map(*pairs), lambda _, v: v.isNotNull())
    return F.when(any_failed, F.map_concat(rest, extra)).otherwise(rest)


def normalize(
    df: DataFrame, packs: PackSet, now: Column, text: str = "raw", node_id: str = "", wanted: set[str] | None = None
) -> DataFrame:
    """Identified lines to flat event rows (enrichment and quality still empty): all columns, or those of `wanted`.

    Input columns: parser_id, the line, event_id, received_at (ns); optional raw_* references and
    processing_ms. Helper columns for validation start with `v_`.
    """
    have = set(df.columns)
    df, parsed = compile_packs(df, packs, text)
    known = [p for p in parsed if p.pack.id in packs.mappings]
    maps = {p.pack.id: compile_mapping(p, packs.mappings[p.pack.id], packs, now) for p in known}

    def column(path: str) -> Column:
        kind = BY_PATH[path].dtype
        none = F.lit(None).cast(kind)
        if path == "observer.type":
            none = F.lit("unknown")
        if path == "event.dataset":
            none = F.col("parser_id")

        def one(p: ParsedPack) -> Column | None:
            f = maps[p.pack.id].get(path)
            if f is not None:
                return f.column
            # only rows without a mapping take the failed-event default
            return F.lit(None).cast(kind) if path in ("observer.type", "event.dataset") else None

        return by_pack(known, one, none)

    out: dict[str, Column] = {BY_PATH[p].name: column(p) for p in SETTABLE_PATHS}
    out["event_kind"] = F.coalesce(out["event_kind"], F.lit("event"))
    ingested = F.col("received_at")
    out["event_id"] = F.col("event_id")
    out["event_ingested_at"] = ingested
    # failed events take the arrival time, so they land in the partition they arrived in
    out["event_observed_at"] = F.coalesce(F.nullif(out["event_observed_at"], F.lit(0)), ingested)
    out["unmapped"] = by_pack(
        known, lambda p: unmapped_fields(p, packs.mappings[p.pack.id], maps[p.pack.id]), empty_map()
    )
    out["lineage_parser_id"] = F.col("parser_id")
    out["lineage_parser_version"] = by_pack(parsed, lambda p: F.lit(p.pack.version), F.lit(None).cast(_TEXT))
    out["lineage_parse_status"] = by_pack(known, lambda p: p.fields.status(), F.lit("failed"))
    out["lineage_node_id"] = F.lit(node_id or None).cast(_TEXT)
    out["lineage_processing_ms"] = F.col("processing_ms") if "processing_ms" in have else F.lit(0.0)
    for name in ("raw_sha256", "raw_segment_id", "raw_offset", "raw_length", "raw_retrieval_uri"):
        kind = "long" if name in ("raw_offset", "raw_length") else _TEXT
        out[name] = F.col(name) if name in have else F.lit(None).cast(kind)
    if "raw_sha256" not in have:
        out["raw_sha256"] = F.sha2(F.col(text).cast("binary"), 256)
        out["raw_length"] = F.octet_length(F.col(text)).cast("long")

    # mapping report and what validation needs to know about the parser
    count = lambda p: sum((f.mapped.cast("int") for f in maps[p.pack.id].values()), F.lit(0))
    errors = lambda p: _error_list(maps[p.pack.id])
    out["v_mapped"] = by_pack(known, count, F.lit(0))
    out["v_expected"] = by_pack(known, lambda p: F.lit(len(maps[p.pack.id])), F.lit(0))
    out["v_confidence"] = by_pack(known, lambda p: F.lit(p.pack.confidence), F.lit(0.0))
    out["v_errors"] = by_pack(known, errors, F.array().cast("array<string>"))
    unidentified = ~F.col("parser_id").isin([p.pack.id for p in parsed]) if parsed else F.lit(True)
    unmappable = ~F.col("parser_id").isin([p.pack.id for p in known]) if known else F.lit(True)
    out["v_fault"] = F.when(unidentified, F.lit("unknown_source")).when(unmappable, F.lit("missing_mapping"))

    names = [c.name for c in COLUMNS if c.name in out] + [n for n in out if n.startswith("v_")]
    if wanted is not None:
        names = [n for n in names if n in wanted]
    # plain columns of the input stay outside the seal, so a filter on them reaches the source
    plain = [n for n in names if n in ("event_id", "event_ingested_at")]
    flat = df.select(*[out[n].alias(n) for n in names])
    if names != plain:
        flat = seal(flat, [n for n in names if n not in plain]).select(*names)
    total = F.coalesce(F.nullif(F.col("network_bytes_total"), F.lit(0)), _sum_if_any("network_bytes_in", "network_bytes_out"))
    skew = timefmt.idiv(F.col("event_ingested_at") - F.col("event_observed_at"), timefmt.NS_PER_MS)
    derived = {"network_bytes_total": total, "event_time_skew_ms": F.when(F.col("v_fault").isNull(), skew)}
    return flat.withColumns({n: c for n, c in derived.items() if wanted is None or n in wanted})


def _sum_if_any(a: str, b: str) -> Column:
    either = F.col(a).isNotNull() | F.col(b).isNotNull()
    return F.when(either, F.coalesce(F.col(a), F.lit(0)) + F.coalesce(F.col(b), F.lit(0)))


def _error_list(fields: dict[str, MappedField]) -> Column:
    bad = [F.when(f.failed, F.lit(f"{path}: not convertible")) for path, f in fields.items() if f.can_fail]
    return F.array_compact(F.array(*bad)) if bad else F.array().cast("array<string>")


def mapping_report(df: DataFrame) -> DataFrame:
    """Mapped and unmapped counts and conversion errors per event."""
    return df.select(
        "event_id",
        F.col("v_mapped").alias("mapped_fields"),
        F.size("unmapped").alias("unmapped_fields"),
        F.col("v_errors").alias("errors"),
    )

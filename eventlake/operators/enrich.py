"""Enrichment: geo, ASN, internal flags, assets, identities, indicators, ATT&CK, risk."""

from __future__ import annotations

import warnings
from collections.abc import Callable
from dataclasses import dataclass, field
from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from eventlake.functions.net import ipv4_to_long, is_internal
from eventlake.operators.cidr import CidrTable, build_cidr_table, build_tables, cidr_lookup
from eventlake.operators.lookup import LookupTable, last_wins, lookup_join, lookup_table

Enricher = Callable[[DataFrame], DataFrame]

# Risk weights.
RISK = {
    "ioc_match": 40.0,
    "external_source": 15.0,
    "action_blocked": 10.0,
    "severity_weight": 3.0,
    "dst_asset_critical": 15.0,
}
HIGH_SEVERITY = 5
# payload columns of the network tables
GEO, ASN = ["country", "city"], ["asn", "as_org"]
RISK_CAP = 100.0


@dataclass
class Dimensions:
    """Lookup tables, each with its size already checked. A missing one skips its enricher."""

    geo: CidrTable | None = None
    asn: CidrTable | None = None
    # both together, which is one lookup per address
    places: CidrTable | None = None
    assets: LookupTable | None = None
    identities: LookupTable | None = None
    iocs: LookupTable | None = None
    mitre: LookupTable | None = None
    internal_cidrs: list[str] = field(default_factory=list)
    match_domains: bool = False

    @staticmethod
    def build(
        geo: DataFrame | None = None,
        asn: DataFrame | None = None,
        assets: DataFrame | None = None,
        identities: DataFrame | None = None,
        iocs: DataFrame | None = None,
        mitre: DataFrame | None = None,
        **options,
    ) -> "Dimensions":
        """From plain frames that carry `ord`, the row position in the file."""

        def table(df: DataFrame | None, key: str) -> LookupTable | None:
            return lookup_table(last_wins(df, [key])) if df is not None else None

        networks = {"geo": (geo, GEO), "asn": (asn, ASN)}
        there = {k: v for k, v in networks.items() if v[0] is not None}
        return Dimensions(
            places=build_tables(list(there.values())) if len(there) == 2 else None,
            **{k: build_cidr_table(*v) for k, v in there.items() if len(there) == 1},
            assets=table(assets, "ip"),
            identities=table(identities, "username"),
            iocs=table(iocs, "indicator"),
            mitre=table(mitre, "signature_id"),
            **options,
        )


def _number(df: DataFrame, side: str) -> str | None:
    name = f"__{side}_n"
    return name if name in df.columns else None


def _names(kind: list[str], side: str) -> dict[str, str]:
    prefix = "geo_" if kind is GEO else ""
    return {c: f"enrich_{side}_{prefix}{c}" for c in kind}


def _networks(df: DataFrame, table: CidrTable, kinds: list[list[str]]) -> DataFrame:
    for side in ("src", "dst"):
        df = cidr_lookup(df, table, f"{side}_ip", [_names(k, side) for k in kinds], number=_number(df, side))
    return df


def geo(df: DataFrame, table: CidrTable) -> DataFrame:
    return _networks(df, table, [GEO])


def asn(df: DataFrame, table: CidrTable) -> DataFrame:
    return _networks(df, table, [ASN])


def places(df: DataFrame, table: CidrTable) -> DataFrame:
    """Country, city and autonomous system of both addresses, by one lookup each."""
    return _networks(df, table, [GEO, ASN])


def internal(df: DataFrame, extra: list[str] = ()) -> DataFrame:
    def flag(side: str) -> Column:
        number = _number(df, side)
        return is_internal(F.col(f"{side}_ip"), extra, F.col(number) if number else None)

    return df.withColumns({f"enrich_{s}_is_internal": flag(s) for s in ("src", "dst")})


def asset(df: DataFrame, table: LookupTable) -> DataFrame:
    df = lookup_join(df, table, {"ip": "dst_ip"}, {"criticality": "__criticality"})
    return df.withColumn("dst_asset_critical", F.coalesce(F.col("__criticality") == "critical", F.lit(False))).drop(
        "__criticality"
    )


def identity(df: DataFrame, table: LookupTable) -> DataFrame:
    user = F.coalesce("actor_user", "src_user")
    df = lookup_join(df, table, {"username": user}, {"username": "__known"})
    return df.withColumn("actor_user", F.coalesce("actor_user", "__known")).drop("__known")


def ioc(df: DataFrame, table: LookupTable, match_domains: bool = False) -> DataFrame:
    """Source address first, then destination; a match overwrites the threat category."""
    probes = [("src_ip", "__i1"), ("dst_ip", "__i2")] + ([("url_domain", "__i3")] if match_domains else [])
    for source, name in probes:
        df = lookup_join(df, table, {"indicator": source}, {"category": name})
    hit = F.coalesce(*[F.when(F.col(n).isNotNull(), F.struct(F.col(s).alias("ind"), F.col(n).alias("cat"))) for s, n in probes])
    return df.withColumns(
        {
            "enrich_ioc_match": F.when(hit.isNotNull(), F.lit(True)),
            "enrich_ioc_indicator": hit["ind"],
            "threat_category": F.coalesce(hit["cat"], F.col("threat_category")),
        }
    ).drop(*[n for _, n in probes])


def mitre(df: DataFrame, table: LookupTable) -> DataFrame:
    df = lookup_join(
        df, table, {"signature_id": "threat_signature_id"}, {"tactic": "__tactic", "technique_id": "__technique"}
    )
    return df.withColumns(
        {
            "threat_mitre_tactic": F.coalesce("__tactic", "threat_mitre_tactic"),
            "threat_mitre_technique": F.coalesce("__technique", "threat_mitre_technique"),
        }
    ).drop("__tactic", "__technique")


def risk_parts(has_asset: bool) -> dict[str, Column]:
    severity = F.col("event_severity_id")
    parts = {
        "ioc_match": F.when(F.col("enrich_ioc_match"), F.lit(RISK["ioc_match"])),
        "external_source": F.when(~F.col("enrich_src_is_internal"), F.lit(RISK["external_source"])),
        "action_blocked": F.when(F.col("event_action").isin("blocked", "dropped"), F.lit(RISK["action_blocked"])),
        "high_severity": F.when(severity >= HIGH_SEVERITY, severity.cast("double") * F.lit(RISK["severity_weight"])),
    }
    if has_asset:
        parts["dst_asset_critical"] = F.when(F.col("dst_asset_critical"), F.lit(RISK["dst_asset_critical"]))
    return parts


def risk(df: DataFrame) -> DataFrame:
    """Sum of weighted factors, capped; the factors stay visible in risk_factors."""
    parts = risk_parts("dst_asset_critical" in df.columns)
    total = reduce(lambda a, b: a + b, [F.coalesce(p, F.lit(0.0)) for p in parts.values()])
    pairs = [x for name, p in parts.items() for x in (F.lit(name), p)]
    return df.withColumns(
        {
            "enrich_risk_score": F.least(F.lit(RISK_CAP), total),
            "risk_factors": F.map_filter(F.create_map(*pairs), lambda _, v: v.isNotNull()),
        }
    )


def _isolated(df: DataFrame, step: Enricher) -> DataFrame:
    """The step's result, or df where the step does not plan or loses a column: one bad enricher leaves out only itself."""
    try:
        out = step(df)
        lost = set(df.columns) - set(out.columns)
    except Exception as exc:  # noqa: BLE001 - foreign code, reported and left out
        warnings.warn(f"enricher {getattr(step, '__name__', step)} left out: {exc}", stacklevel=3)
        return df
    if lost:
        warnings.warn(f"enricher {getattr(step, '__name__', step)} left out: it drops {sorted(lost)}", stacklevel=3)
        return df
    return out


def _by_halves(fn: Callable[[pd.DataFrame], pd.DataFrame], rows: pd.DataFrame, names: list[str]) -> pd.DataFrame:
    """fn on rows; where it fails, on halves of them, until the rows that fail stand alone with their error."""
    try:
        out = fn(rows)
        if len(out) != len(rows):
            raise ValueError(f"{len(out)} rows for {len(rows)}")
        return out[names].reset_index(drop=True).assign(error=None)
    except Exception as exc:  # noqa: BLE001 - foreign code; the row keeps its event and the error is recorded
        if len(rows) == 1:
            return pd.DataFrame({n: [None] for n in names}).assign(error=f"{type(exc).__name__}: {exc}"[:500])
        half = len(rows) // 2
        parts = [_by_halves(fn, rows.iloc[:half], names), _by_halves(fn, rows.iloc[half:], names)]
        return pd.concat([p.astype(object) for p in parts], ignore_index=True)


def guarded(name: str, fn: Callable[[pd.DataFrame], pd.DataFrame], inputs: list[str], outputs: str) -> Enricher:
    """An enricher by a pandas function of some columns that gives the columns `outputs` ("a string, b long"), row by row.

    A row on which it fails at run time keeps its event: its new columns are null, and `enrich_errors` names the enricher
    and the error. Rows beside it are not touched. Only the inputs travel to Python, in Arrow batches.
    """
    names = [f.split()[0] for f in outputs.split(", ")]

    @F.pandas_udf(f"{outputs}, error string")
    def run(rows: pd.DataFrame) -> pd.DataFrame:
        # pieces that were computed apart may differ in their pandas types; missing values are null in all of them
        out = _by_halves(fn, rows, names)
        return out.astype(object).where(out.notna(), None)

    def step(df: DataFrame) -> DataFrame:
        before = F.col("enrich_errors") if "enrich_errors" in df.columns else F.array().cast("array<string>")
        rows = df.withColumn("__got", run(F.struct(*inputs)))
        error = F.concat(F.lit(f"{name}: "), F.col("__got.error"))
        own = {n: F.col(f"__got.{n}") for n in names}
        errors = F.when(error.isNotNull(), F.concat(before, F.array(error))).otherwise(before)
        return rows.withColumns({**own, "enrich_errors": errors}).drop("__got")

    step.__name__ = name
    return step


# Columns that a step of the chain makes and what it reads for them. Risk comes last.
ADDRESSES = ("src_ip", "dst_ip")
GEO_MADE = tuple(n for s in ("src", "dst") for n in _names(GEO, s).values())
ASN_MADE = tuple(n for s in ("src", "dst") for n in _names(ASN, s).values())
STEPS: dict[str, tuple[tuple[str, ...], tuple[str, ...]]] = {
    "places": (GEO_MADE + ASN_MADE, ADDRESSES),
    "geo": (GEO_MADE, ADDRESSES),
    "asn": (ASN_MADE, ADDRESSES),
    "internal": (("enrich_src_is_internal", "enrich_dst_is_internal"), ADDRESSES),
    "asset": (("dst_asset_critical",), ("dst_ip",)),
    "identity": (("actor_user",), ("actor_user", "src_user")),
    "ioc": (("enrich_ioc_match", "enrich_ioc_indicator", "threat_category"), (*ADDRESSES, "url_domain", "threat_category")),
    "mitre": (("threat_mitre_tactic", "threat_mitre_technique"), ("threat_mitre_tactic", "threat_mitre_technique", "threat_signature_id")),
    "risk": (
        ("enrich_risk_score", "risk_factors"),
        ("event_severity_id", "event_action", "enrich_ioc_match", "enrich_src_is_internal", "dst_asset_critical"),
    ),
}


def enrich(df: DataFrame, dims: Dimensions, extra: list[Enricher] = (), wanted: set[str] | None = None) -> DataFrame:
    """The fixed chain, then any extra enrichers, then risk. Left joins only, so no row is lost.

    With `wanted`, steps that make none of these columns are left out; df has what the others read.

    Rows that could not be identified or mapped (v_fault) have no addresses, so they pass through.
    """

    def runs(step: str) -> bool:
        return wanted is None or not wanted.isdisjoint(STEPS[step][0])

    steps: list[Enricher] = []
    if dims.places and runs("places"):
        steps.append(lambda d: places(d, dims.places))
    if dims.geo and runs("geo"):
        steps.append(lambda d: geo(d, dims.geo))
    if dims.asn and runs("asn"):
        steps.append(lambda d: asn(d, dims.asn))
    if runs("internal"):
        steps.append(lambda d: internal(d, dims.internal_cidrs))
    if dims.assets and runs("asset"):
        steps.append(lambda d: asset(d, dims.assets))
    if dims.identities and runs("identity"):
        steps.append(lambda d: identity(d, dims.identities))
    if dims.iocs and runs("ioc"):
        steps.append(lambda d: ioc(d, dims.iocs, dims.match_domains))
    if dims.mitre and runs("mitre"):
        steps.append(lambda d: mitre(d, dims.mitre))
    missing = {"enrich_ioc_match": F.lit(None).cast("boolean")}
    # the numeric addresses are computed once and shared by every range lookup
    df = df.withColumns({f"__{s}_n": ipv4_to_long(F.col(f"{s}_ip")) for s in ("src", "dst") if f"{s}_ip" in df.columns})
    for step in steps:
        df = df.transform(step)
    for step in extra:
        df = _isolated(df, step)
    df = df.drop("__src_n", "__dst_n")
    for name, empty in missing.items():
        if name not in df.columns:
            df = df.withColumn(name, empty)
    return risk(df) if runs("risk") else df

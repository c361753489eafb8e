"""Raw lines to validated event rows: one lazy plan without a shuffle of its own."""

from __future__ import annotations

from dataclasses import dataclass, field
from datetime import datetime

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from eventlake.functions import timefmt
from eventlake.operators.enrich import STEPS, Dimensions, Enricher, enrich
from eventlake.operators.identify import identify
from eventlake.operators.lookup import LookupTable
from eventlake.operators.normalize import normalize
from eventlake.operators.validate import CHECKS, validate
from eventlake.schema import COLUMNS, STREAM_COLUMNS
from eventlake.sources.packs import PackSet, load_packs


@dataclass
class Context:
    """Everything a run needs besides the lines. `now` None means the wall clock."""

    packs: PackSet = field(default_factory=load_packs)
    dims: Dimensions = field(default_factory=Dimensions)
    bindings: LookupTable | None = None
    now: datetime | None = None
    node_id: str = ""
    enrichers: list[Enricher] = field(default_factory=list)

    @property
    def now_ts(self) -> Column:
        return F.lit(self.now) if self.now else F.current_timestamp()

    @property
    def now_ns(self) -> Column:
        return timefmt.to_ns(self.now_ts)


# what a derived column is made of; a column that is not named here comes from the line itself
MADE_OF: dict[str, set[str]] = {
    "network_bytes_total": {"network_bytes_total", "network_bytes_in", "network_bytes_out"},
    "event_time_skew_ms": {"event_ingested_at", "event_observed_at", "v_fault"},
    **{name: set(reads) for made, reads in STEPS.values() for name in made},
    **{name: set(reads) for name, reads in CHECKS.items()},
}


def needed(columns: list[str]) -> set[str]:
    """These columns and all that they are made of."""
    found, ahead = set(), set(columns)
    while ahead:
        found |= ahead
        ahead = {n for c in ahead for n in MADE_OF.get(c, ())} - found
    return found


def process(df: DataFrame, ctx: Context, text: str = "raw", columns: list[str] | None = None) -> DataFrame:
    """identify, parse, normalize, enrich, validate. Every input row gives one output row.

    With `columns`, only these and what they are made of are computed, and only these returned. The seal behind the parsers
    keeps the optimizer from finding out itself what nobody reads. Own enrichers may read anything, so with them all is made.
    """
    wanted = needed(columns) if columns is not None and not ctx.enrichers else None
    rows = identify(df, ctx.packs, ctx.bindings, text)
    rows = normalize(rows, ctx.packs, ctx.now_ts, text, ctx.node_id, wanted)
    rows = enrich(rows, ctx.dims, ctx.enrichers, wanted)
    rows = validate(rows, ctx.now_ns, wanted)
    return rows.select(*columns) if columns is not None else rows


def flat_columns(df: DataFrame) -> list[Column]:
    """The event table columns in order; absent values are NULL, flags and the map never are."""
    have = set(df.columns)
    cols = []
    for c in COLUMNS:
        col = F.col(c.name) if c.name in have else F.lit(None).cast(c.dtype)
        if c.dtype.typeName() == "boolean":
            col = F.coalesce(col, F.lit(False))
        cols.append(col.cast(c.dtype).alias(c.name))
    return cols


def flat_rows(df: DataFrame) -> DataFrame:
    return df.select(*flat_columns(df))


def compat_rows(df: DataFrame) -> DataFrame:
    """Flat rows with "" and 0 in place of NULL, for queries written against such tables."""
    fill = {"string": F.lit(""), "long": F.lit(0).cast("long"), "double": F.lit(0.0)}
    flat = flat_rows(df)
    return flat.select(
        *[F.coalesce(F.col(c.name), fill[c.dtype.typeName()]).alias(c.name) if c.dtype.typeName() in fill else c.name for c in COLUMNS]
    )


def with_partitions(df: DataFrame) -> DataFrame:
    """dt and hour (UTC) of the event's own time, vendor or `unknown`."""
    at = timefmt.from_ns(F.col("event_observed_at"))
    return df.withColumns(
        {
            "dt": F.date_format(at, "yyyy-MM-dd"),
            "hour": F.date_format(at, "HH"),
            "vendor": F.coalesce("observer_vendor", F.lit("unknown")),
        }
    )


def lake_rows(df: DataFrame) -> DataFrame:
    return with_partitions(flat_rows(df))


def stream_rows(df: DataFrame) -> DataFrame:
    """Key and JSON value of the live table."""
    flat = flat_rows(df).select(*STREAM_COLUMNS)
    return flat.select(F.col("event_id").alias("key"), F.to_json(F.struct(*STREAM_COLUMNS)).alias("value"))


def dead_letters(df: DataFrame) -> DataFrame:
    """Rows with violations: the flat row plus reasons and detail. They are in the lake as well."""
    bad = df.filter(F.size("violations") > 0)
    return bad.select(
        *flat_columns(bad),
        F.col("violations.reason").alias("dlq_reasons"),
        F.array_join(F.col("violations.message"), "; ").alias("dlq_detail"),
    )

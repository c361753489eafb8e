"""Event framing: multi-line records and size limits."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from eventlake.functions import regexes, timefmt


def compiles(pattern: str | None) -> bool:
    if not pattern:
        return False
    try:
        regexes.to_java(pattern)
        re.compile(pattern)
        return True
    except (re.error, regexes.UnsafePattern):
        return False


MAX_EVENT_BYTES = 1 << 20
# Lines of a source that one window task sees; larger sources are stitched from such pieces.
CHUNK_LINES = 50_000


def join_lines(
    df: DataFrame,
    start: str | None,
    source: str = "source",
    order: str = "line_no",
    text: str = "line",
    max_bytes: int = MAX_EVENT_BYTES,
    chunk: int = CHUNK_LINES,
) -> DataFrame:
    """Lines of a source to events: a line that matches `start` begins one, others are appended.

    A missing or invalid pattern makes every line an event. Events are cut at `max_bytes` and flagged.
    Running counts are taken per chunk of a source and then offset by a prefix sum over chunks, so a
    single huge source still spreads over many tasks.
    """
    if not compiles(start):
        return df.select(
            source,
            F.col(order).cast("long").alias("event_no"),
            _cut(F.col(text), max_bytes).alias("payload"),
            (F.octet_length(text) > max_bytes).alias("truncated"),
        )
    lines = df.select(
        source,
        F.col(order).cast("long").alias("__n"),
        F.col(text).alias("__t"),
        regexes.matches(F.col(text), start).cast("long").alias("__b"),
        (F.octet_length(text) + F.lit(1)).cast("long").alias("__len"),
    ).withColumn("__c", timefmt.idiv(F.col("__n"), chunk))
    inside = Window.partitionBy(source, "__c").orderBy("__n")
    upto = inside.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    lines = lines.withColumns({"__run": F.sum("__b").over(upto), "__pos": F.sum("__len").over(upto) - F.col("__len")})
    # chunk totals: starts, bytes, and where the last event of the chunk begins
    totals = lines.groupBy(source, "__c").agg(
        F.sum("__b").alias("__starts"),
        F.sum("__len").alias("__bytes"),
        F.max(F.when(F.col("__b") == 1, F.col("__pos"))).alias("__last"),
    )
    before = Window.partitionBy(source).orderBy("__c").rowsBetween(Window.unboundedPreceding, -1)
    totals = totals.withColumns(
        {"__base": F.coalesce(F.sum("__starts").over(before), F.lit(0)), "__off": F.coalesce(F.sum("__bytes").over(before), F.lit(0))}
    )
    carried = F.last(F.col("__last") + F.col("__off"), ignorenulls=True).over(before)
    totals = totals.select(source, "__c", "__base", "__off", F.coalesce(carried, F.lit(0)).alias("__open"))
    rows = lines.join(totals, [source, "__c"])
    began = F.coalesce(
        F.last(F.when(F.col("__b") == 1, F.col("__pos") + F.col("__off")), ignorenulls=True).over(upto), F.col("__open")
    )
    rows = rows.withColumns({"event_no": F.col("__run") + F.col("__base"), "__at": F.col("__pos") + F.col("__off") - began})
    # text beyond the limit is only counted, never gathered
    kept = F.when(F.col("__at") <= max_bytes, F.struct("__n", "__t"))
    return (
        rows.groupBy(source, "event_no")
        .agg(F.sort_array(F.collect_list(kept)).alias("__lines"), (F.sum("__len") - F.lit(1)).alias("__size"))
        .select(
            source,
            "event_no",
            _cut(F.array_join(F.col("__lines.__t"), "\n"), max_bytes).alias("payload"),
            (F.col("__size") > max_bytes).alias("truncated"),
        )
    )


def _cut(text: Column, max_bytes: int) -> Column:
    over = F.octet_length(text) > max_bytes
    return F.when(over, F.substring(text.cast("binary"), 1, max_bytes)).otherwise(text.cast("binary"))


def truncate(payload: Column, max_bytes: int) -> tuple[Column, Column]:
    """(bytes cut to the limit, was it cut?)"""
    data = payload.cast("binary")
    return F.substring(data, 1, max_bytes), F.octet_length(data) > F.lit(max_bytes)

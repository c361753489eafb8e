"""Reference-time layouts ("2006-01-02 15:04:05") to Spark datetime patterns."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

NS_PER_MS = 1_000_000
NS_PER_S = 1_000_000_000

# Layout elements and the Spark pattern letters with the same meaning.
_ELEMENTS = {
    "January": "MMMM",
    "Jan": "MMM",
    "Monday": "EEEE",
    "Mon": "EEE",
    "MST": "zzz",
    "2006": "yyyy",
    "Z07:00": "XXX",
    "-07:00": "xxx",
    "Z0700": "XX",
    "-0700": "xx",
    "_2": "d",
    "01": "MM",
    "02": "dd",
    "03": "hh",
    "04": "mm",
    "05": "ss",
    "06": "yy",
    "15": "HH",
    "PM": "a",
    "1": "M",
    "2": "d",
    "3": "h",
    "4": "m",
    "5": "s",
}
_TOKEN = re.compile(r"[.,](?:0+|9+)(?!\d)|" + "|".join(re.escape(k) for k in sorted(_ELEMENTS, key=len, reverse=True)))


def spark_pattern(layout: str) -> str:
    out, pos = [], 0
    for m in _TOKEN.finditer(layout):
        out.append(_literal(layout[pos : m.start()]))
        tok = m.group()
        if tok in _ELEMENTS:
            out.append(_ELEMENTS[tok])
        elif tok[1] == "0":
            out.append(tok[0] + "S" * (len(tok) - 1))
        else:
            out.append("[" + tok[0] + "S" * (len(tok) - 1) + "]")
        pos = m.end()
    out.append(_literal(layout[pos:]))
    return "".join(out)


def _literal(text: str) -> str:
    return re.sub(r"[A-Za-z]+", lambda m: f"'{m.group()}'", text)


def has_year(layout: str) -> bool:
    return "2006" in layout or re.search(r"(?<!\d)06(?!\d)", layout) is not None


def parse_layout(text: Column, layout: str, zone: str | None = None) -> Column:
    """Timestamp, or NULL when the text does not match the layout."""
    if "_2" in layout:
        text = F.regexp_replace(text, " +", " ")
        layout = re.sub(" +", " ", layout.replace("_2", "2"))
    ts = F.try_to_timestamp(text, F.lit(spark_pattern(layout)))
    has_offset = re.search(r"Z07|-07|MST", layout)
    return F.to_utc_timestamp(ts, zone) if zone and zone != "UTC" and not has_offset else ts


def to_ns(ts: Column) -> Column:
    return F.unix_micros(ts) * F.lit(1000)


def from_ns(ns: Column) -> Column:
    """Epoch nanoseconds to TIMESTAMP (microsecond precision)."""
    return F.timestamp_micros(idiv(ns, 1000))


def idiv(col: Column, n: int | Column) -> Column:
    """Integer division that truncates toward zero, exact for 64-bit values."""
    return F.call_function("div", col, F.lit(n).cast("long") if isinstance(n, int) else n)


def infer_year(text: Column, layout: str, zone: str | None, now: Column) -> Column:
    """Give a year-less timestamp the year (this, last, next) that puts it nearest to `now`."""
    year = F.year(now)

    def candidate(offset: int) -> Column:
        dated = F.concat((year + F.lit(offset)).cast("string"), F.lit(" "), text)
        return parse_layout(dated, "2006 " + layout, zone)

    def ranked(offset: int, order: int) -> Column:
        ts = candidate(offset)
        gap = F.abs(F.unix_micros(now) - F.unix_micros(ts))
        return F.when(ts.isNotNull(), F.struct(gap.alias("gap"), F.lit(order).alias("ord"), ts.alias("ts")))

    return F.least(ranked(0, 0), ranked(-1, 1), ranked(1, 2))["ts"]

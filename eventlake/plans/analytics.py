"""Dashboard analytics over event rows, dead letters and metric samples."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from eventlake.functions import timefmt
from eventlake.operators.lookup import LookupTable, lookup_join

STATES = ["normal", "elevated", "threat", "dlq"]


def visual_state(is_dlq: Column | None = None) -> Column:
    """threat on an indicator or threat category, elevated from risk 40, else normal; dlq for dead letters."""
    category = F.trim(F.coalesce("threat_category", F.lit("")))
    state = (
        F.when(F.coalesce("enrich_ioc_match", F.lit(False)) | (category != ""), "threat")
        .when(F.col("enrich_risk_score") >= 40, "elevated")
        .otherwise("normal")
    )
    return F.when(is_dlq, "dlq").otherwise(state) if is_dlq is not None else state


def state_counts(rows: DataFrame) -> DataFrame:
    """One row per state, zero when empty."""
    counts = rows.agg(*[F.count_if(F.col("state") == s).alias(s) for s in STATES])
    return counts.select(F.explode(F.array(*[F.struct(F.lit(s).alias("state"), F.col(s).alias("events")) for s in STATES]))).select("col.*")


def risk_bands(rows: DataFrame) -> DataFrame:
    r = F.col("enrich_risk_score")
    band = F.when(r >= 75, "Critical").when(r >= 50, "High").when(r >= 25, "Moderate").otherwise("Low")
    return rows.groupBy(band.alias("band")).agg(F.count("*").alias("events"))


def volume(rows: DataFrame, at: str = "event_ingested_at", bins: int = 12) -> DataFrame:
    """Equal-width histogram between first and last arrival; the last bin is closed, empty bins are 0."""
    ms = rows.select((F.col(at) / F.lit(timefmt.NS_PER_MS)).alias("t"))
    low, high = ms.agg(F.min("t")).scalar(), ms.agg(F.max("t")).scalar()
    span = F.greatest(F.lit(1.0), high - low)
    index = F.least(F.lit(bins - 1), F.floor((F.col("t") - low) / span * F.lit(bins)).cast("int"))
    counts = ms.groupBy(index.alias("bin")).agg(F.count("*").alias("events"))
    all_bins = rows.sparkSession.range(bins).select(F.col("id").cast("int").alias("bin"))
    return all_bins.join(counts, "bin", "left").select("bin", F.coalesce("events", F.lit(0)).alias("events"))


def summary(rows: DataFrame) -> DataFrame:
    """Averages, raw-linked share, parsers, and the exact 95th percentile of processing time, in one aggregate.

    The percentile is the value that 95 % of the measured events do not exceed; its state is one counter per distinct
    value, combined on the map side.
    """
    linked = F.col("raw_sha256").isNotNull() & F.col("raw_segment_id").isNotNull()
    return rows.agg(
        (F.avg("quality_score") * 100).alias("avg_quality"),
        F.avg("enrich_risk_score").alias("avg_risk"),
        (F.count_if(linked) * F.lit(100.0) / F.count("*")).alias("raw_linked_pct"),
        F.count_distinct("lineage_parser_id").alias("parsers"),
        F.expr("percentile_disc(0.95) WITHIN GROUP (ORDER BY lineage_processing_ms)").alias("p95_processing_ms"),
    )


def top_vendors(rows: DataFrame, k: int = 6) -> DataFrame:
    name = F.coalesce("observer_vendor", F.lit("unknown"))
    return rows.groupBy(name.alias("vendor")).agg(F.count("*").alias("events")).orderBy(F.desc("events"), "vendor").limit(k)


def timeline(rows: DataFrame, n: int = 40) -> DataFrame:
    """Newest n events in time order with rounded quality and risk."""
    newest = rows.orderBy(F.desc("event_ingested_at"), F.desc("event_id")).limit(n)
    place = F.row_number().over(Window.orderBy("event_ingested_at", "event_id"))
    half_up = lambda c: F.floor(c + F.lit(0.5)).cast("long")
    return newest.select(
        place.alias("position"),
        half_up(F.col("quality_score") * 100).alias("quality"),
        half_up(F.col("enrich_risk_score")).alias("risk"),
    )


def internal_assets(rows: DataFrame, k: int = 12) -> DataFrame:
    hits = rows.filter(F.col("enrich_dst_is_internal") & F.col("dst_ip").isNotNull())
    return hits.groupBy(F.col("dst_ip").alias("ip")).agg(F.count("*").alias("hits")).orderBy(F.desc("hits"), "ip").limit(k)


def related_counts(rows: DataFrame) -> DataFrame:
    """Per event: how many others share one of its addresses in either role.

    Counted as n(src) + n(dst) - n(both) - 1, so no pair of events is ever formed.
    """
    ends = rows.select("event_id", "src_ip", "dst_ip")
    # one row per event and address, whichever roles it has
    one = F.array_distinct(F.array_compact(F.array("src_ip", "dst_ip")))
    per_ip = ends.select(F.explode(one).alias("ip")).groupBy("ip").agg(F.count("*").alias("n"))
    two = F.col("src_ip") != F.col("dst_ip")
    low, high = F.least("src_ip", "dst_ip"), F.greatest("src_ip", "dst_ip")
    per_pair = ends.filter(two).groupBy(low.alias("a"), high.alias("b")).agg(F.count("*").alias("n"))
    # as many rows as there are addresses: joined lazily, and broadcast only where the adaptive planner sees them small
    ips, pairs = LookupTable(per_ip, False), LookupTable(per_pair, False)
    spread = F.xxhash64("event_id")
    out = lookup_join(ends, ips, {"ip": "src_ip"}, {"n": "__s"}, spread)
    out = lookup_join(out, ips, {"ip": "dst_ip"}, {"n": "__d"}, spread)
    out = lookup_join(out, pairs, {"a": low, "b": high}, {"n": "__p"}, spread)
    zero = F.lit(0)
    total = (
        F.when(F.col("src_ip") == F.col("dst_ip"), F.col("__s"))
        .otherwise(F.coalesce("__s", zero) + F.coalesce("__d", zero) - F.coalesce("__p", zero))
    )
    return out.select("event_id", F.greatest(zero, total - F.lit(1)).alias("related"))


def facet_filter(
    rows: DataFrame,
    states: list[str],
    dlq_only: bool = False,
    vendors: list[str] = (),
    outcomes: list[str] = (),
) -> DataFrame:
    keep = F.col("state").isin(list(states))
    if dlq_only:
        keep = keep & F.col("is_dlq")
    if vendors:
        keep = keep & F.coalesce("observer_vendor", F.lit("")).isin(list(vendors))
    if outcomes:
        keep = keep & F.coalesce("event_action", F.lit("unknown")).isin(list(outcomes))
    return rows.filter(keep)


def facet_values(rows: DataFrame) -> DataFrame:
    """Distinct vendors and outcomes, sorted."""
    pair = F.explode(
        F.array(
            F.struct(F.lit("vendor").alias("facet"), F.col("observer_vendor").alias("value")),
            F.struct(F.lit("outcome").alias("facet"), F.coalesce("event_action", F.lit("unknown")).alias("value")),
        )
    )
    return rows.select(pair.alias("p")).select("p.*").filter("value IS NOT NULL").distinct().orderBy("facet", "value")


def quota_sample(rows: DataFrame, cap: int = 150) -> DataFrame:
    """At most `cap` events: one row per id (dead letters win), a quarter kept for dead letters,
    spare places given to them, newest first. `overflow` tells how many are not shown."""
    rest = [c for c in rows.columns if c != "event_id"]
    order = F.struct(F.col("is_dlq"), F.col("event_ingested_at"))
    unique = rows.groupBy("event_id").agg(F.max_by(F.struct(*rest), order).alias("r"))
    unique = unique.select("event_id", *[F.col("r")[c].alias(c) for c in rest])
    newest = [F.desc("event_ingested_at"), "event_id"]
    # only the newest `cap` of each class can be shown
    dlq = unique.filter("is_dlq").orderBy(*newest).limit(cap)
    normal = unique.filter("NOT is_dlq").orderBy(*newest).limit(cap)
    both = dlq.unionByName(normal)
    everyone = Window.partitionBy()
    d, n = F.count_if("is_dlq").over(everyone), F.count_if(~F.col("is_dlq")).over(everyone)
    slots = F.least(d, F.greatest(F.lit(1), F.ceil(F.lit(cap) * F.lit(0.25))))
    fits = d + n <= cap
    normal_slots = F.when(fits, n).otherwise(F.least(n, F.lit(cap) - slots))
    dlq_slots = F.when(fits, d).otherwise(F.lit(cap) - normal_slots)
    rank = F.row_number().over(Window.partitionBy("is_dlq").orderBy(*newest))
    ranked = both.withColumns({"__rank": rank, "__slots": F.when(F.col("is_dlq"), dlq_slots).otherwise(normal_slots)})
    shown = ranked.filter(F.col("__rank") <= F.col("__slots")).drop("__rank", "__slots")
    total = unique.agg(F.count("*").alias("n")).scalar()
    return shown.withColumn("overflow", F.greatest(F.lit(0), total - F.lit(cap))).orderBy(*newest)


def risk_vs_average(rows: DataFrame) -> DataFrame:
    mean = rows.agg(F.avg("enrich_risk_score").alias("m")).scalar()
    return rows.select("event_id", (F.col("enrich_risk_score") - mean).alias("risk_delta"))


def unseen(rows: DataFrame, seen: DataFrame) -> DataFrame:
    return rows.join(seen.select("event_id").distinct(), "event_id", "left_anti")


# --- metric samples: ts (ns), name, labels, value ----------------------------------


def counter_rate(samples: DataFrame, series: list[str], clamp: bool = False, chunk_ns: int = 86_400 * timefmt.NS_PER_S) -> DataFrame:
    """Change per second since the previous sample; NULL on the first one and after a reset.

    Each series is cut by time; the last sample of a piece is handed to the next one, so a long
    series does not become one task.
    """
    rows = samples.withColumn("__c", timefmt.idiv(F.col("ts"), chunk_ns))
    here = Window.partitionBy(*series, "__c").orderBy("ts")
    last = rows.groupBy(*series, "__c").agg(F.max_by(F.struct("ts", "value"), "ts").alias("__l"))
    pieces = Window.partitionBy(*series).orderBy("__c")
    carried = last.select(*series, "__c", F.lag("__l").over(pieces).alias("__p"))
    rows = rows.join(carried, [*series, "__c"])
    prev = F.coalesce(F.lag(F.struct("ts", "value")).over(here), F.col("__p"))
    rows = rows.withColumn("__prev", prev)
    dt = (F.col("ts") - F.col("__prev.ts")) / F.lit(timefmt.NS_PER_S)
    delta = F.col("value") - F.col("__prev.value")
    rate = F.when((dt > 0) & (delta >= 0), delta / dt)
    if clamp:
        rate = F.coalesce(F.greatest(F.lit(0.0), F.when(dt > 0, delta / dt)), F.lit(0.0))
    return rows.select(*series, "ts", "value", rate.alias("rate"))


def rate_by_label(rows: DataFrame, label: str, at: str = "event_ingested_at", minutes: int = 1) -> DataFrame:
    """Events per second by label in tumbling windows."""
    w = F.window(timefmt.from_ns(F.col(at)), f"{minutes} minutes")
    counts = rows.groupBy(w.alias("w"), label).agg(F.count("*").alias("n"))
    return counts.select(F.col("w.start").alias("start"), label, (F.col("n") / F.lit(60.0 * minutes)).alias("per_second"))


def histogram_quantile(buckets: DataFrame, group: list[str], q: float) -> DataFrame:
    """Quantile from cumulative buckets (`le`, `cumulative`), linear inside the bucket that holds it."""
    order = Window.partitionBy(*group).orderBy("le")
    rows = buckets.withColumns(
        {
            "__lo": F.coalesce(F.lag("le").over(order), F.lit(0.0)),
            "__before": F.coalesce(F.lag("cumulative").over(order), F.lit(0)),
            "__total": F.max("cumulative").over(Window.partitionBy(*group)),
        }
    )
    rank = F.lit(q) * F.col("__total")
    hit = (F.col("cumulative") >= rank) & (F.col("__before") < rank)
    width = F.col("le") - F.col("__lo")
    value = F.when(F.col("le") == float("inf"), F.col("__lo")).otherwise(
        F.col("__lo") + width * (rank - F.col("__before")) / (F.col("cumulative") - F.col("__before"))
    )
    return rows.filter(hit).groupBy(*group).agg(F.min(value).alias("quantile"))


def to_buckets(rows: DataFrame, group: list[str], value: str, bounds: list[float]) -> DataFrame:
    """Cumulative histogram of a column: one row per group and bound, the last bound is infinite."""
    limits = [*bounds, float("inf")]
    counts = rows.groupBy(*group).agg(*[F.count_if(F.col(value) <= b).alias(f"b{i}") for i, b in enumerate(limits)])
    pairs = F.array(*[F.struct(F.lit(b).alias("le"), F.col(f"b{i}").alias("cumulative")) for i, b in enumerate(limits)])
    return counts.select(*group, F.explode(pairs).alias("p")).select(*group, "p.*")


def counter_totals(samples: DataFrame) -> DataFrame:
    """A counter summed over its label sets."""
    return samples.groupBy("name").agg(F.sum("value").alias("total"))

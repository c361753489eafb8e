"""Sources: log lines, NDJSON, raw-reference topics, lake, ledger, dimensions, metadata."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from eventlake.functions import timefmt
from eventlake.schema import LEDGER_SCHEMA, RAW_REF_MESSAGE
from eventlake.session import ensure_session


def log_lines(spark: SparkSession, paths: str | list[str], streaming: bool = False, **options) -> DataFrame:
    """One row per line: `raw` without a trailing carriage return, `peer` = file path.

    The bytes of a line are never decoded: `raw` holds them as they stand in the file, valid UTF-8 or not, so its hash
    and length are those of the file. Only parse steps read it as text.
    """
    ensure_session(spark)
    reader = (spark.readStream if streaming else spark.read).options(lineSep="\n", **options)
    data = F.col("value").cast("binary")
    ends = F.substring(data, F.octet_length(data), F.lit(1)) == F.lit(b"\r")
    line = F.when(ends, F.substring(data, F.lit(1), F.octet_length(data) - F.lit(1))).otherwise(data)
    return reader.text(paths).select(line.cast("string").alias("raw"), F.col("_metadata.file_path").alias("peer"))


def ndjson_lines(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    """Lines of (optionally gzipped) NDJSON kept verbatim, empty ones skipped. Parsing is a later step."""
    return log_lines(spark, paths).filter(F.length("raw") > 0)


def envelope(df: DataFrame, listener_id: str, now: Column | None = None, max_bytes: int | None = None) -> DataFrame:
    """Stamp listener, arrival time (ns), byte length and the truncation flag.

    Payloads stay whole unless `max_bytes` asks for a cut; the cut is made on bytes and may end inside a character.
    `raw_sha256` is then the hash of the whole payload.
    """
    size = F.octet_length("raw")
    at = timefmt.to_ns(now if now is not None else F.current_timestamp())
    columns = {
        "listener_id": F.lit(listener_id),
        "received_at": F.col("received_at") if "received_at" in df.columns else at,
        "byte_length": size.cast("long"),
        "truncated": F.lit(False),
    }
    if max_bytes is not None:
        data = F.col("raw").cast("binary")
        columns["truncated"] = size > max_bytes
        columns["raw_sha256"] = F.sha2(data, 256)
        columns["raw"] = F.when(size > max_bytes, F.substring(data, 1, max_bytes)).otherwise(data).cast("string")
    return df.withColumns(columns)


def raw_ref_messages(df: DataFrame, value: str = "value") -> tuple[DataFrame, DataFrame]:
    """Decode raw-reference JSON messages: (decoded rows, rejects). Undecodable ones are kept apart, not skipped."""
    text = F.col(value).cast("string")
    parsed = df.withColumn("__m", F.from_json(text, RAW_REF_MESSAGE, {"mode": "PERMISSIVE"}))
    good = F.col("__m.event_id").isNotNull() & F.col("__m.ref.segment_id").isNotNull()
    rows = parsed.filter(good).select(
        F.col("__m.event_id").alias("event_id"),
        F.col("__m.listener_id").alias("listener_id"),
        F.col("__m.peer_ip").alias("peer"),
        timefmt.to_ns(F.try_to_timestamp(F.col("__m.received_at"))).alias("received_at"),
        F.col("__m.ref.segment_id").alias("raw_segment_id"),
        F.col("__m.ref.offset").alias("raw_offset"),
        F.col("__m.ref.length").alias("raw_length"),
        F.col("__m.ref.sha256").alias("raw_sha256"),
    )
    return rows, parsed.filter(~F.coalesce(good, F.lit(False))).drop("__m")


def kafka_stream(spark: SparkSession, servers: str, topic: str, **options) -> DataFrame:
    """Topic as a stream of key/value rows. Needs the Kafka connector on the class path."""
    ensure_session(spark)
    opts = {"kafka.bootstrap.servers": servers, "subscribe": topic, **options}
    return spark.readStream.format("kafka").options(**opts).load()


def lake(spark: SparkSession, path: str, dt_from: str | None = None, dt_to: str | None = None) -> DataFrame:
    """Event table with partition pruning on dt (text, compared as text)."""
    ensure_session(spark)
    df = spark.read.option("basePath", path).parquet(path)
    df = df.withColumns({c: F.col(c).cast("string") for c in ("hour", "vendor") if c in df.columns})
    day = F.col("dt").cast("string")
    if dt_from:
        df = df.filter(F.col("dt") >= F.lit(dt_from))
    if dt_to:
        df = df.filter(F.col("dt") <= F.lit(dt_to))
    return df.withColumns({"dt": day, "hour": F.lpad(F.col("hour"), 2, "0")})


def hot_tier(df: DataFrame, now_ns: Column, minutes: int = 30) -> DataFrame:
    """Rows that arrived within the retention of the live table."""
    return df.filter(F.col("event_ingested_at") >= now_ns - F.lit(minutes * 60 * timefmt.NS_PER_S))


def recent_days(df: DataFrame, today: str | Column, days: int = 14) -> DataFrame:
    day = F.to_date(F.lit(today)) if isinstance(today, str) else today
    return df.filter(F.col("dt") >= F.date_format(F.date_sub(day, days), "yyyy-MM-dd"))


def ledger(spark: SparkSession, path: str) -> DataFrame:
    """Sealed-segment ledger: JSON lines under dt=… directories."""
    return spark.read.schema(LEDGER_SCHEMA).option("basePath", path).json(f"{path}/dt=*")


def segments_by_day(entries: DataFrame, dt_from: str, dt_to: str) -> DataFrame:
    cols = ["segment_id", "merkle_root", "prev_root", "event_count", "sealed_at_ns", "byte_size"]
    return entries.filter(F.col("dt").between(dt_from, dt_to)).select(*cols, F.col("dt").cast("string").alias("dt"))


# Header columns of the dimension files and how many must be filled.
DIMENSION_COLUMNS = {
    "geo": ("cidr country city", 3),
    "asn": ("cidr asn as_org", 3),
    "assets": ("ip asset_id owner criticality environment", 5),
    "identities": ("username department manager employee_id", 4),
    "iocs": ("indicator type category confidence", 4),
    "mitre": ("signature_id tactic technique_id technique_name", 4),
}


def dimension_csv(spark: SparkSession, kind: str, path: str) -> DataFrame:
    """Dimension files with their row order in `ord`. Short rows and bad numbers are load errors.

    Order: by file name, then by place in the file. Rows with fewer filled columns than the kind needs stop the load.
    """
    names, filled = DIMENSION_COLUMNS[kind]
    numeric = {"asn", "confidence"}
    schema = T.StructType([T.StructField(n, T.LongType() if n in numeric else T.StringType()) for n in names.split()])
    df = spark.read.schema(schema).csv(path, header=True, mode="FAILFAST", enforceSchema=True)
    # row numbers grow inside a file, as its splits are numbered in order of their start
    place = F.struct(F.col("_metadata.file_name"), F.col("_metadata.file_block_start"), F.monotonically_increasing_id())
    have = sum((F.coalesce(F.col(n).cast("string") != "", F.lit(False)).cast("int") for n in names.split()[:filled]), F.lit(0))
    bad = F.raise_error(F.lit(f"{kind}: a row has fewer than {filled} filled columns"))
    return df.select(*names.split(), F.when(have < filled, bad.cast("string")).alias("__bad"), place.alias("ord")).filter("__bad IS NULL").drop("__bad")


def jdbc_table(spark: SparkSession, url: str, table: str, **options) -> DataFrame:
    """Metadata table over JDBC. Needs the driver jar; pass partitionColumn/bounds for large tables."""
    return spark.read.format("jdbc").options(url=url, dbtable=table, **options).load()

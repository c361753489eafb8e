"""Sinks: lake, dead letters, raw index, segments, keyed topic, fan-out."""

from __future__ import annotations

import logging
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from eventlake.plans.process import dead_letters, lake_rows, stream_rows
from eventlake.schema import PARTITIONS

log = logging.getLogger(__name__)

ROWS_PER_FILE = 200_000
Sink = Callable[[DataFrame], None]


def clustered(df: DataFrame, partitions: list[str] = PARTITIONS) -> DataFrame:
    """Bring the rows of a partition together and sort them by destination and time.

    rebalance lets adaptive execution split a partition that is too large (one hour of one vendor may be
    most of the data) and merge small ones, so neither a giant task nor tiny files result.
    """
    return df.hint("rebalance", *[F.col(c) for c in partitions]).sortWithinPartitions(
        *partitions, "dst_ip", "event_observed_at"
    )


def write_lake(
    df: DataFrame, path: str, mode: str = "append", cluster: bool = True, partitions: list[str] = PARTITIONS
) -> None:
    """Validated rows to Parquet under dt/hour/vendor of the event's own time.

    Lakes with few rows per hour can partition by dt alone; hour and vendor then stay ordinary columns.
    """
    rows = lake_rows(df)
    rows = clustered(rows, partitions) if cluster else rows
    (
        rows.write.mode(mode)
        .partitionBy(*partitions)
        .option("maxRecordsPerFile", ROWS_PER_FILE)
        .option("compression", "zstd")
        .parquet(path)
    )


def write_dead_letters(df: DataFrame, path: str, mode: str = "append") -> None:
    dead_letters(df).write.mode(mode).option("compression", "zstd").parquet(path)


def write_raw_index(index: DataFrame, path: str, mode: str = "append") -> None:
    index.write.mode(mode).partitionBy("dt").option("compression", "zstd").parquet(path)


def write_segments(entries: DataFrame, path: str) -> None:
    """Replace only the days present in `entries`, so a re-run of a range is idempotent."""
    entries.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("dt").parquet(path)


def append_ledger(entries: DataFrame, path: str) -> None:
    entries.write.mode("append").partitionBy("dt").json(path)


def write_topic(df: DataFrame, servers: str, topic: str) -> None:
    """Keyed JSON events. Needs the Kafka connector on the class path."""
    rows = stream_rows(df)
    rows.write.format("kafka").option("kafka.bootstrap.servers", servers).option("topic", topic).save()


def register_partitions(spark: SparkSession, table: str) -> None:
    """Make new lake directories visible to a catalog table."""
    spark.catalog.recoverPartitions(table)


def fan_out(df: DataFrame, primary: Sink, secondaries: dict[str, Sink]) -> dict[str, str]:
    """Primary first: its failure is raised. A failing secondary is logged and reported."""
    primary(df)
    failed = {}
    for name, sink in secondaries.items():
        try:
            sink(df)
        except Exception as exc:  # any sink error must not undo the primary write
            log.warning("sink %s failed: %s", name, exc)
            failed[name] = str(exc)
    return failed


def count_dead_letters(dead: DataFrame) -> DataFrame:
    return dead.select(F.explode("dlq_reasons").alias("reason")).groupBy("reason").count()

"""The four logical catalogs as temporary views, so cross-catalog questions are plain SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from eventlake.functions import timefmt
from eventlake.schema import STREAM_COLUMNS
from eventlake.sources.readers import hot_tier

# Metadata tables.
META_TABLES = ["sources", "parser_registry", "parser_artifacts", "routes", "audit_log", "dlq_events", "processor_nodes", "users"]


class Catalog:
    """lake_events, stream_events, meta_*, vault_raw_segments, vault_raw_index."""

    def __init__(self, spark: SparkSession):
        self.spark = spark

    def lake(self, events: DataFrame) -> "Catalog":
        events.createOrReplaceTempView("lake_events")
        return self

    def stream(self, events: DataFrame, now=None) -> "Catalog":
        now_ns = timefmt.to_ns(now if now is not None else F.current_timestamp())
        # an event table of fewer columns gives a live view of those among them
        live = [c for c in STREAM_COLUMNS if c in events.columns]
        hot_tier(events.select(*live), now_ns).createOrReplaceTempView("stream_events")
        return self

    def meta(self, **tables: DataFrame) -> "Catalog":
        for name, df in tables.items():
            df.createOrReplaceTempView(f"meta_{name}")
        return self

    def vault(self, segments: DataFrame, index: DataFrame) -> "Catalog":
        segments.createOrReplaceTempView("vault_raw_segments")
        index.createOrReplaceTempView("vault_raw_index")
        return self

    def sql(self, text: str, **args) -> DataFrame:
        return self.spark.sql(text, args=args or None)

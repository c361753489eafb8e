"""A keyed table on plain files: copy-on-write merge by hash bucket.

Rows live in buckets of their key's hash. A merge reads and rewrites only the buckets that incoming rows touch, under a
folder of its version, and then commits which folder each bucket is read from. A merge that is repeated after a failure
starts from the version before its own, so it gives the same table; readers see whole merges only.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from eventlake.sources import commits

BUCKETS = 64


def bucket_of(key: str, buckets: int) -> F.Column:
    return F.pmod(F.xxhash64(key), F.lit(buckets)).cast("int")


def read(spark: SparkSession, root: str, schema, only: list[int] | None = None, before: int | None = None) -> DataFrame:  # noqa: ANN001
    """Rows of the newest commit (below version `before`), of some buckets or all."""
    found = commits.latest(spark, root, before)
    places = found[1]["buckets"] if found else {}
    paths = [f"{root}/{folder}/bucket={b}" for b, folder in sorted(places.items()) if only is None or int(b) in only]
    return spark.read.schema(schema).parquet(*paths) if paths else spark.createDataFrame([], schema)


def merge(
    incoming: DataFrame, root: str, version: int, key: str, combine: Callable[[DataFrame, DataFrame], DataFrame], buckets: int = BUCKETS
) -> int:
    """Merge rows into the table as a version: combine(current, incoming) gives the new rows. Number of buckets rewritten.

    The number of buckets is fixed by the first commit of a table.
    """
    spark = incoming.sparkSession
    found = commits.latest(spark, root, version)
    state = found[1] if found else {"n": buckets, "buckets": {}}
    n = state["n"]
    marked = incoming.withColumn("__bucket", bucket_of(key, n)).persist()
    try:
        # at most as many rows as the table has buckets
        touched = [r["__bucket"] for r in marked.select("__bucket").distinct().collect()]
        if touched:
            current = read(spark, root, incoming.schema, touched, version)
            merged = combine(current, marked.drop("__bucket")).withColumn("bucket", bucket_of(key, n))
            dealt = merged.repartition(min(len(touched), n), "bucket")
            dealt.write.mode("overwrite").partitionBy("bucket").option("compression", "zstd").parquet(f"{root}/data/v={version}")
        places = state["buckets"] | {str(b): f"data/v={version}" for b in touched}
        commits.commit(spark, root, version, {"n": n, "buckets": places})
    finally:
        marked.unpersist()
    return len(touched)

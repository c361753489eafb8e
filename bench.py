"""Headline timings. Prints one JSON line.

BENCH_SF_DIR: table directory (default sf0.1), BENCH_CPUS: local cores. Each figure is the second run.
"""

from __future__ import annotations

import json
import os
import sys
import tempfile
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from pyspark.sql import DataFrame, SparkSession  # noqa: E402
from pyspark.sql import functions as F  # noqa: E402

from eventlake.operators import integrity  # noqa: E402
from eventlake.operators.enrich import enrich  # noqa: E402
from eventlake.operators.identify import identify  # noqa: E402
from eventlake.operators.normalize import normalize  # noqa: E402
from eventlake.plans import analytics, lake_queries, onboarding  # noqa: E402
from eventlake.plans.process import process  # noqa: E402
from eventlake.sources import readers, writers  # noqa: E402
from suite import inputs  # noqa: E402
from suite.q_core import registry  # noqa: E402


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = (
        SparkSession.builder.master(f"local[{cpus}]")
        .config("spark.sql.shuffle.partitions", cpus)
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", "12g")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    base = spark.conf.get("spark.checkpoint.dir", None) or tempfile.gettempdir()
    root = f"{base.rstrip('/')}/eventlake-bench-{spark.sparkContext.applicationId}"

    # input: the log lines as files, as an ingest leaves them
    inputs.raw_events(spark, sf_dir).write.parquet(f"{root}/lines")
    lines = spark.read.parquet(f"{root}/lines")
    n = lines.count()
    ctx = inputs.context(spark, sf_dir)
    processed = process(lines, ctx)
    writers.write_lake(processed, f"{root}/lake", mode="overwrite", partitions=["dt"])
    lake = readers.lake(spark, f"{root}/lake")
    normalize(identify(lines, ctx.packs), ctx.packs, ctx.now_ts).write.parquet(f"{root}/norm")
    norm = spark.read.parquet(f"{root}/norm")
    refs = integrity.segments(lines, age_ns=6 * 3600 * 10**9)
    refs.write.parquet(f"{root}/refs")
    refs = spark.read.parquet(f"{root}/refs")
    ledger = integrity.ledger(refs)
    day = "2024-01-15"
    # published versions of the parsers that wrote the lake, so the join finds partners
    known = F.array(*[F.lit(p.id) for p in ctx.packs.packs])
    versions = registry(spark, sf_dir).withColumn("parser_id", F.element_at(known, (F.col("id") % F.size(known) + 1).cast("int")))

    def noop(df: DataFrame) -> None:
        df.write.format("noop").mode("overwrite").save()

    jobs = {
        "process_lines": lambda: noop(processed),
        "enrich": lambda: noop(enrich(norm, ctx.dims)),
        "segment_and_ledger": lambda: noop(integrity.ledger(integrity.segments(lines, age_ns=6 * 3600 * 10**9))),
        "verify": lambda: noop(integrity.verify(ledger, refs)),
        "q1": lambda: noop(lake_queries.cross_vendor(lake)),
        "q1_one_day": lambda: noop(lake_queries.cross_vendor(lake, day)),
        "q2": lambda: noop(lake_queries.hot_and_cold(readers.hot_tier(lake, F.lit(inputs.NOW_NS)), lake)),
        "q3": lambda: noop(lake_queries.registry_quality(lake, versions)),
        "q4": lambda: noop(lake_queries.custody(refs, ledger, "ev-0000000042")),
        "q5": lambda: noop(lake_queries.losslessness(lake)),
        "q6": lambda: noop(lake_queries.parser_health(lake)),
        "q7": lambda: noop(lake_queries.source_features(lake)),
        "count_unpruned": lambda: noop(lake.agg(F.count("*"))),
        "recent": lambda: noop(lake_queries.recent(lake, 200)),
        "related": lambda: noop(analytics.related_counts(norm)),
        "templates": lambda: noop(
            onboarding.mine_templates(lines.select(F.lit("s").alias("source"), F.col("raw").alias("line")))
        ),
    }
    times: dict[str, float] = {}
    for name, job in jobs.items():
        job()
        start = time.perf_counter()
        job()
        times[name] = round(time.perf_counter() - start, 3)
        print(name, times[name], file=sys.stderr, flush=True)
    out = {
        "metric": "headline_queries_total",
        "value": round(sum(times.values()), 3),
        "unit": "sec",
        "queries": times,
        "sf": sf_dir.rstrip("/").rsplit("sf", 1)[-1],
        "lines": n,
        "process_lines_per_sec": round(n / times["process_lines"]),
        "enrich_rows_per_sec": round(n / times["enrich"]),
        "verify_events_per_sec": round(n / times["verify"]),
    }
    print(json.dumps(out))


if __name__ == "__main__":
    main()

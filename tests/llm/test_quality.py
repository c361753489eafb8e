"""Quality classifier: held-out accuracy, edges, and scores that depend on the text alone."""

import zlib

from pyspark.sql import functions as F

from eventlake.llm import quality
from eventlake.llm.queries import QUERIES


def test_held_out_accuracy(spark):
    d = "/root/testdata/sf0.1"
    rows = QUERIES["op9_quality_ftrl"](spark, d)
    docs = spark.read.parquet(f"{d}/documents.parquet")
    assert rows.count() == docs.count()
    some = rows.limit(500).collect()
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) and r.predicted == int(r.score >= 0.3) for r in some)
    known = rows.filter("held_out").join(spark.read.parquet(f"{d}/labels.parquet"), "doc_id")
    hit = {r.quality: r.acc for r in known.groupBy("quality").agg(F.avg((F.col("predicted") == F.col("quality")).cast("int")).alias("acc")).collect()}
    assert hit[1] > 0.99 and hit[0] > 0.9


def test_edges(spark):
    docs = spark.createDataFrame([(1, "good words here", "s"), (2, "bad ### bad", "s"), (3, None, "s"), (4, "", "s"), (None, "good", "s"), (6, "good " * 30_000, "s"), (1, "good words here", "s")], "doc_id long, text string, score string")
    labels = spark.createDataFrame([(1, 1), (2, 0), (9, 1), (3, 1), (None, 0), (4, None), (1, 7)], "doc_id long, quality int")
    w = quality.fit_on(docs.drop("score"), labels)
    rows = quality.with_score(docs, w).collect()
    assert len(rows) == 7 and all(0 <= r.score <= 1 for r in rows)
    by_text = {}
    for r in rows:
        by_text.setdefault(r.text or "", set()).add(r.score)
    assert all(len(v) == 1 for v in by_text.values())
    none = quality.fit_on(docs.drop("score"), labels.limit(0))
    assert {r.score for r in quality.with_score(docs.limit(0).union(docs), none).collect()} == {0.5}
    assert quality.with_score(docs.limit(0), w).count() == 0

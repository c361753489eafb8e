"""Classifier chain: held-out accuracy and edges. About one toxic label in 25 stands on a text without any sign of it."""

from pyspark.sql import functions as F

from eventlake.llm import quality, toxicity
from eventlake.llm.queries import QUERIES


def test_held_out(spark):
    d = "/root/testdata/sf0.1"
    rows = QUERIES["op3_toxicity_chain"](spark, d)
    assert rows.count() == spark.read.parquet(f"{d}/documents.parquet").count()
    labels = spark.read.parquet(f"{d}/labels.parquet").withColumnRenamed("toxic", "truth").filter(quality.held_out(F.col("doc_id")))
    got = {(r.truth, r.toxic): r["count"] for r in rows.join(labels, "doc_id").groupBy("truth", "toxic").count().collect()}
    caught, missed, false, clean = (got.get(k, 0) for k in ((1, True), (1, False), (0, True), (0, False)))
    assert caught / (caught + missed) > 0.88 and false / (false + clean) < 0.01


def test_edges(spark):
    docs = spark.createDataFrame([(i, t, 1.0) for i, t in enumerate(["nice day", "you idiot", None, "", "idiot " * 9000, "fine words"] * 8)] + [(None, "x", 0.0)], "doc_id long, text string, p_toxic double")
    labels = spark.createDataFrame([(i, 1, int(i % 6 in (1, 4))) for i in range(40)] + [(None, 1, 1), (2, None, 1), (3, 1, None), (999, 0, 1)], "doc_id long, quality int, toxic int")
    s = toxicity.Settings(l1=0.1)
    chain = toxicity.train(toxicity.sample_of(docs, labels, s), s)
    rows = toxicity.with_probabilities(docs, chain).collect()
    assert len(rows) == 49
    assert all((r.p_toxic >= 0.5) == ("idiot" in (r.text or "")) for r in rows)
    none = toxicity.train(toxicity.sample_of(docs, labels.limit(0), s), s)
    assert {r.p_toxic for r in toxicity.with_probabilities(docs, none).collect()} == {0.5}

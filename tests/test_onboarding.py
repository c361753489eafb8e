"""Profiling of unknown sources: templates, shapes, types."""

import pytest
from pyspark.sql import functions as F

from eventlake.functions import regexes
from eventlake.plans import dlq
from eventlake.plans import onboarding as ob




def lines(spark, rows):
    return spark.createDataFrame([("s", i, x) for i, x in enumerate(rows)], "source string, line_no long, line string")


def test_uniform_prose_is_one_template(spark):
    df = lines(spark, [f"user u{i} logged in from 10.0.0.{i} port {1000 + i}" for i in range(20)])
    (row,) = ob.mine_templates(df).collect()
    assert row.template == "user <*> logged in from <*> port <*>" and (row["size"], row.coverage_pct) == (20, 100.0)
    assert len(row.examples) == 1 and row.examples[0].startswith("user u0 ")


def test_two_kinds_are_two_templates(spark):
    df = lines(spark, [f"link eth{i} went down" for i in range(10)] + [f"temperature of fan {i} is high now" for i in range(10)])
    got = {r.template: r["size"] for r in ob.mine_templates(df).collect()}
    assert got == {"link <*> went down": 10, "temperature of fan <*> is high now": 10}
    # every line carries its template
    tagged = {r.template: r["count"] for r in ob.line_templates(df).groupBy("template").count().collect()}
    assert tagged == got


def test_words_that_vary_are_wild(spark):
    df = lines(spark, [f"job {w} done in time" for w in ("alpha", "beta", "gamma", "delta", "eps")] * 3)
    rows = ob.mine_templates(df, support=0.4).collect()
    assert sum(r["size"] for r in rows) == 15


def test_alike_templates_are_merged(spark):
    # two halves keep their own words by support; they agree in three of five places
    rows = [f"send mail to {w} now" for w in ("alice", "bob") for _ in range(5)]
    assert [(r.template, r["size"]) for r in ob.mine_templates(lines(spark, rows)).collect()] == [("send mail to <*> now", 10)]
    apart = ob.mine_templates(lines(spark, rows), similarity=0.9).collect()
    assert sorted((r.template, r["size"]) for r in apart) == [("send mail to alice now", 5), ("send mail to bob now", 5)]
    # one leaf, nothing alike: both lead; blank lines have the empty template
    rows = ["go on x a b c d"] * 4 + ["go on y e f g h"] * 4 + ["", "  "]
    got = sorted((r.template, r["size"]) for r in ob.mine_templates(lines(spark, rows)).collect())
    assert got == [("", 2), ("go on x a b c d", 4), ("go on y e f g h", 4)]
    tagged = {r.template: r["count"] for r in ob.line_templates(lines(spark, rows)).groupBy("template").count().collect()}
    assert tagged == dict(got)


def test_shape_is_judged_on_all_lines(spark):
    rows = ["a,b,c"] * 25 + ['{"k": 1}'] * 400 + ["broken"]
    assert [r.shape for r in ob.shape(lines(spark, rows)).collect()] == ["json"]
    assert [r.shape for r in ob.shape(lines(spark, ["1,2,3,4"] * 19 + ["x"])).collect()] == ["csv"]
    assert [r.shape for r in ob.shape(lines(spark, ["src=1 dst=2 free words"] * 6 + ["x"] * 4)).collect()] == ["kv"]
    assert [r.shape for r in ob.shape(lines(spark, ["", "  "])).collect()] == ["free_text"]
    assert ob.shape(lines(spark, ["x"]).limit(0)).count() == 0


def test_domains_and_layouts(spark):
    names = ["a.example.org", "x-1.de", "-a.de", "a..de", "a.d1", "localhost", "a.b-.c", "l" * 63 + ".org", "l" * 64 + ".org"]
    df = spark.createDataFrame([(n,) for n in names], "v string")
    assert [r.d for r in df.select(ob.is_domain(F.col("v")).alias("d")).collect()] == [True, True, False, False, False, False, False, True, False]
    values = [("s", "t", v) for v in ("2024-01-02T03:04:05Z", "2024-01-02 03:04:05.1", "Jan  2 03:04:05", "1700000000")]
    got = ob.infer_types(spark.createDataFrame(values, "source string, field string, value string"), {}).collect()
    assert [r.type for r in got] == ["timestamp"]


def test_ambiguous_repeats_are_refused():
    for bad in (r"(a+)+", r"(a|a)*", r"((a+)b*)*", r"(\w*)+x", r"(?:x|\d+)*"):
        with pytest.raises(regexes.UnsafePattern):
            regexes.to_java(bad)
    for good in (r"(\w+,)*x", r"^<\d+>(?P<rest>.*)$", r"(?:ab|cd)+", r"(a{1,3})+"):
        regexes.to_java(good)


def test_listing_has_no_silent_limit(spark):
    rows = spark.range(700).select(F.col("id").cast("string").alias("event_id"), F.lit("r").alias("reason"), F.lit("p").alias("parser_id"), F.timestamp_seconds("id").alias("occurred_at"), F.lit(False).alias("resolved"))
    assert dlq.listing(rows).count() == 700 and dlq.listing(rows, limit=5).count() == 5
    with pytest.raises(ValueError):
        dlq.listing(rows, limit=501)


def test_types_without_a_shuffle_of_values(spark):
    # 10 distinct values are an enumeration, 11 are not, wherever they are read; far more are none either
    sizes = {"ten": 10, "eleven": 11, "many": 6000}
    rows = [(f, f"w {i % n}x") for f, n in sizes.items() for i in range(6000)] + [("ten", ""), ("ten", None)]
    df = spark.createDataFrame(rows, "field string, value string").withColumn("source", F.lit("s")).repartition(7)
    types = ob.infer_types(df, {})
    got = {r.field: (r.type, r.confidence) for r in types.collect()}
    assert got == {"ten": ("enum", round(1 - 10 / 6000, 2)), "eleven": ("free_text", 1.0), "many": ("free_text", 1.0)}
    shuffled = types._jdf.queryExecution().optimizedPlan().toString()
    assert shuffled.count("Aggregate") == 1 and "theta_sketch_agg" in shuffled


def test_port_by_its_digits(spark):
    texts = ["0", "-0", "-00", "-1", "1", "443", "65535", "65536", "65540", "65600", "66000", "70000", "99999", "100000", "0065535", "000000000000000000000080", "5.5", "", "x", "9" * 30]
    df = spark.createDataFrame([(t,) for t in texts], "v string").withColumn("f", F.lit("port"))
    port = dict(ob.detectors(F.col("v"), F.col("f"), {}))["port"]
    got = {r.v for r in df.filter(port).collect()}
    assert got == {t for t in texts if t.removeprefix("-").isdigit() and 0 <= int(t) <= 65535}
    # no cast, which raises and catches an exception for every value that is no number
    assert "cast" not in str(port).lower()

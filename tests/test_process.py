"""Identification to routing on small inputs."""

import ipaddress
import json
import random
from datetime import datetime, timezone

import pytest
from pyspark.sql import functions as F

from eventlake.functions.net import ipv4_to_long, ipv6_to_hex, is_ip, is_internal
from eventlake.operators import lookup
from eventlake.operators.cidr import build_cidr_table, build_tables, cidr_lookup
from eventlake.operators.enrich import guarded, Dimensions
from eventlake.operators.normalize import timestamp_value
from eventlake.plans.process import Context, compat_rows, dead_letters, flat_rows, process
from eventlake.schema import FLAT_NAMES
from eventlake.sources import readers, writers

NOW = datetime(2026, 9, 8, tzinfo=timezone.utc)
PANOS = "<14>Sep  7 14:02:11 pa-edge-9 1,2026/09/07 14:02:11,0042,TRAFFIC,end,{src},10.0.0.5,r1,ssl,untrust,trust,7,{sport},443,tcp,deny,10,20,3,4,dev"


def lines(spark, *raw):
    return spark.createDataFrame([(f"e{i}", r, 1788789740000000000) for i, r in enumerate(raw)], "event_id string, raw string, received_at long")


def test_known_unknown_and_failed_conversion(spark):
    df = lines(spark, PANOS.format(src="203.0.113.5", sport=1024), "who knows", PANOS.format(src="203.0.113.5", sport="abc"), PANOS.format(src="300.1.1.1", sport=99999))
    rows = {r.event_id: r for r in process(df, Context(now=NOW)).collect()}
    ok = rows["e0"]
    assert (ok.observer_vendor, ok.event_action, ok.event_severity_id, ok.network_bytes_total) == ("paloalto", "blocked", 1, 30)
    assert ok.event_observed_at == 1788789731000000000 and ok.violations == [] and ok.lineage_parse_status == "ok"
    assert ok.enrich_risk_score == 25.0 and ok.risk_factors == {"external_source": 15.0, "action_blocked": 10.0}
    lost = rows["e1"]
    assert lost.lineage_parser_id == "source.unknown" and [v.reason for v in lost.violations] == ["unknown_source"]
    assert lost.quality_score == 0.0 and lost.raw_sha256 and lost.observer_type == "unknown"
    # a value that does not convert is kept, not lost
    part = rows["e2"]
    assert part.lineage_parse_status == "partial" and part.src_port is None and part.unmapped["src_port"] == "abc"
    assert [v.reason for v in rows["e3"].violations] == ["schema_violation", "bad_port", "bad_ip"]


def test_flat_and_compat(spark):
    rows = process(lines(spark, "x"), Context(now=NOW))
    assert flat_rows(rows).columns == FLAT_NAMES and len(FLAT_NAMES) == 83
    r = compat_rows(rows).collect()[0]
    assert r.src_ip == "" and r.src_port == 0 and r.enrich_ioc_match is False and r.unmapped == {}


def test_addresses_match_ipaddress(spark):
    rng = random.Random(3)
    texts = ["", "1.2.3.4", "01.2.3.4", "1.2.3", "256.1.1.1", "::", "::1", "1::", "fe80::1%eth0", "1:2:3:4:5:6:7:8", "1:2:3:4:5:6:7::", "::ffff:1.2.3.4", "1:2:3:4:5:6:7:8:9", ":::", "1::2::3", "12345::"]
    for _ in range(200):
        groups = [f"{rng.randrange(65536):x}" for _ in range(rng.randint(1, 9))]
        t = ":".join(groups)
        texts.append(t.replace(":", "::", 1) if rng.random() < 0.5 else t)
    rows = spark.createDataFrame([(t,) for t in texts], "ip string").select("ip", is_ip(F.col("ip")).alias("ok"), ipv6_to_hex(F.col("ip")).alias("h"), ipv4_to_long(F.col("ip")).alias("n")).collect()
    for r in rows:
        try:
            want = None if "%" in r.ip else ipaddress.ip_address(r.ip)
        except ValueError:
            want = None
        assert r.ok == (want is not None), r.ip
        if want is not None:
            assert int(want) == (r.n if want.version == 4 else int(r.h, 16)), r.ip


@pytest.mark.parametrize("limit", [1 << 20, 0])
def test_cidr_first_listed_wins_brute_force(spark, limit, monkeypatch, tmp_path):
    # limit 0 forces the shuffled join that large tables take
    monkeypatch.setattr(lookup, "BROADCAST_BYTES", limit)
    rng = random.Random(5)
    nets = []
    for i in range(60):
        plen = rng.choice([8, 12, 16, 20, 24, 30, 32])
        nets.append((str(ipaddress.ip_network((rng.choice([10, 11, 12]) << 24 | rng.getrandbits(12) << 12 | rng.getrandbits(8), plen), strict=False)), i))
    nets += [("2001:db8::/32", 100), ("2001:db8:1::/45", 99)]
    ips = [str(ipaddress.ip_address(rng.choice([10, 11, 12, 13]) << 24 | rng.getrandbits(24))) for _ in range(300)] + ["2001:db8:1::7", "2001:db8:9::7", "bad", None]
    dim = spark.createDataFrame(nets, "cidr string, ord long").withColumn("name", F.concat(F.lit("n"), F.col("ord").cast("string")))
    dim.write.parquet(str(tmp_path / "networks"))
    table = build_cidr_table(spark.read.parquet(str(tmp_path / "networks")), ["name"])
    assert table.blocks.small == table.ranges.small == (limit > 0)
    got = cidr_lookup(spark.createDataFrame([(i, x) for i, x in enumerate(ips)], "id int, ip string"), table, "ip", {"name": "hit"}).collect()
    assert len(got) == len(ips)
    for r in got:
        want = None
        if r.ip and r.ip != "bad":
            a = ipaddress.ip_address(r.ip)
            inside = [o for c, o in nets if ipaddress.ip_network(c, strict=False).version == a.version and a in ipaddress.ip_network(c, strict=False)]
            want = f"n{min(inside)}" if inside else None
        assert r.hit == want, r.ip


def test_two_tables_in_one_lookup(spark, tmp_path):
    rng = random.Random(9)

    def table(n, wide):
        nets = [(f"{rng.choice([10, 11])}.{rng.choice([0, 1, 200])}.{rng.getrandbits(8)}.{rng.getrandbits(8)}/{rng.choice([9, 14, 17, 22, 25, 31, 32])}", 7 * i) for i in range(n)]
        # listed twice, and everything as the last resort
        return nets + [(nets[0][0], 999)] + ([("0.0.0.0/0", 1000)] if wide else [])

    one, two = table(40, True), table(25, False)

    def frame(nets, c):
        spark.createDataFrame([(n, o, f"{c}{o}", o) for n, o in nets], f"cidr string, ord long, {c} string, {c}_n long").write.parquet(str(tmp_path / c))
        return spark.read.parquet(str(tmp_path / c))

    both = build_tables([(frame(one, "a"), ["a", "a_n"]), (frame(two, "b"), ["b"])])
    ips = [f"{rng.choice([9, 10, 11])}.{rng.choice([0, 1, 2, 200])}.{rng.getrandbits(8)}.{rng.getrandbits(8)}" for _ in range(400)] + [n.partition("/")[0] for n, _ in one + two] + ["0.0.0.0", "255.255.255.255", "::1", "", None]
    df = spark.createDataFrame([(x,) for x in ips], "ip string")
    got = cidr_lookup(df, both, "ip", [{"a": "x", "a_n": "n"}, {"b": "y"}]).collect()
    assert len(got) == len(ips) and {r.ip for r in got} == set(ips)

    def first(nets, ip):
        return min((o for n, o in nets if ipaddress.ip_address(ip) in ipaddress.ip_network(n, strict=False)), default=None)

    for r in got:
        v4 = r.ip and ":" not in r.ip
        a, b = (first(one, r.ip), first(two, r.ip)) if v4 else (None, None)
        assert (r.x, r.n, r.y) == (None if a is None else f"a{a}", a, None if b is None else f"b{b}"), r.ip
    plan = cidr_lookup(df, both, "ip", [{"a": "x"}, {"b": "y"}])._jdf.queryExecution().executedPlan().toString()
    assert plan.count("BroadcastHashJoin") == 2


def test_rows_that_fail_at_run_time_keep_their_event(spark):
    def halve(rows):
        if (rows["n"] == 13).any() or rows["s"].isna().any():
            raise ValueError("no half of it")
        return rows.assign(half=rows["n"] // 2, low=rows["s"].str.lower())

    df = spark.range(200).select("id", F.col("id").alias("n"), F.when(F.col("id") != 150, F.concat(F.lit("S"), F.col("id").cast("string"))).alias("s")).coalesce(1)
    steps = [guarded("halve", halve, ["n", "s"], "half long, low string"), guarded("drop", lambda rows: rows[rows["n"] > 5].assign(x=1), ["n"], "x int")]
    out = df
    for step in steps:
        out = step(out)
    rows = {r.id: r for r in out.collect()}
    assert sorted(rows) == list(range(200))
    for i, r in rows.items():
        bad = i in (13, 150)
        assert (r.half, r.low) == ((None, None) if bad else (i // 2, f"s{i}"))
        # the second enricher loses rows: each of them is one that failed
        want = (["halve: ValueError: no half of it"] if bad else []) + (["drop: ValueError: 0 rows for 1"] if i <= 5 else [])
        assert r.enrich_errors == want and r.x == (None if i <= 5 else 1)


def test_bad_cidr_is_a_load_error(spark):
    with pytest.raises(Exception, match="bad cidr"):
        build_cidr_table(spark.createDataFrame([("10.0.0.0/99", 0, "x")], "cidr string, ord long, name string"), ["name"])


def test_last_row_wins_and_indicator_order(spark):
    iocs = spark.createDataFrame([("203.0.113.5", "old", 0), ("203.0.113.5", "new", 1), ("10.0.0.5", "dst", 2)], "indicator string, category string, ord long")
    dims = Dimensions.build(iocs=iocs)
    df = lines(spark, PANOS.format(src="203.0.113.5", sport=1), PANOS.format(src="203.0.113.6", sport=1))
    rows = process(df, Context(now=NOW, dims=dims)).orderBy("event_id").collect()
    assert [(r.enrich_ioc_indicator, r.threat_category) for r in rows] == [("203.0.113.5", "new"), ("10.0.0.5", "dst")]


def test_internal_flag_is_three_valued(spark):
    df = spark.createDataFrame([("10.1.1.1",), ("8.8.8.8",), ("x",), (None,), ("172.32.0.1",), ("100.64.0.1",)], "ip string")
    got = [r[0] for r in df.select(is_internal(F.col("ip"), ["100.64.0.0/10"])).collect()]
    assert got == [True, False, None, None, False, True]


def test_year_inference_across_new_year(spark):
    df = spark.createDataFrame([("Dec 31 23:59:59",), ("Jan 1 00:00:01",)], "t string")
    spec = {"formats": ["Jan 2 15:04:05"], "infer_missing_year": True}
    at = lambda s: F.lit(s).cast("timestamp")
    got = df.select(F.timestamp_seconds(timestamp_value(F.col("t"), spec, at("2026-01-02 00:00:00")) / 1e9).alias("a")).collect()
    assert [r.a.year for r in got] == [2025, 2026]


def test_files_round_trip(spark, tmp_path):
    log = tmp_path / "in" / "a.log"
    log.parent.mkdir()
    log.write_bytes((PANOS.format(src="203.0.113.5", sport=5) + "\r\n" + "other\r\n").encode())
    df = readers.envelope(readers.log_lines(spark, str(log.parent)), "file", F.lit(NOW)).withColumn("event_id", F.md5("raw"))
    rows = process(df, Context(now=NOW))
    writers.write_lake(rows, str(tmp_path / "lake"))
    writers.write_dead_letters(rows, str(tmp_path / "dlq"))
    lake = readers.lake(spark, str(tmp_path / "lake"), "2026-09-01", "2026-09-30")
    assert {(r.dt, r.hour, r.vendor) for r in lake.collect()} == {("2026-09-07", "14", "paloalto"), ("2026-09-08", "00", "unknown")}
    plan = readers.lake(spark, str(tmp_path / "lake"), "2026-09-08")._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(dt" in plan
    assert spark.read.parquet(str(tmp_path / "dlq")).select("dlq_reasons").collect()[0][0] == ["unknown_source"]


def test_fan_out_keeps_primary(spark):
    seen = []

    def broken(_):
        raise RuntimeError("down")

    failed = writers.fan_out(spark.range(1), lambda d: seen.append(d.count()), {"b": broken, "c": lambda d: seen.append(2)})
    assert seen == [1, 2] and list(failed) == ["b"]
    with pytest.raises(RuntimeError):
        writers.fan_out(spark.range(1), broken, {})


def test_dimension_csv(spark, tmp_path):
    p = tmp_path / "asn.csv"
    p.write_text("cidr,asn,as_org\n10.0.0.0/8,64500,One\n")
    assert readers.dimension_csv(spark, "asn", str(p)).collect()[0].asn == 64500
    p.write_text("cidr,asn,as_org\n10.0.0.0/8,many,One\n")
    with pytest.raises(Exception):
        readers.dimension_csv(spark, "asn", str(p)).collect()


def test_dead_letter_columns(spark):
    dead = dead_letters(process(lines(spark, "x"), Context(now=NOW)))
    assert dead.columns == [*FLAT_NAMES, "dlq_reasons", "dlq_detail"]
    assert json.loads(dead.toJSON().first())["dlq_reasons"] == ["unknown_source"]


def test_a_failing_enricher_leaves_out_only_itself(spark):
    df = lines(spark, PANOS.format(src="203.0.113.5", sport=1024))

    def broken(d):
        return d.withColumn("x", F.col("no_such_column"))

    def greedy(d):
        return d.select("event_id")

    def tagged(d):
        return d.withColumn("threat_category", F.lit("tagged"))

    with pytest.warns(UserWarning, match="left out"):
        (row,) = process(df, Context(now=NOW, enrichers=[broken, greedy, tagged])).collect()
    assert row.threat_category == "tagged" and row.enrich_risk_score == 25.0


def test_resolve_marks_entries(spark):
    from eventlake.plans import dlq

    rows = spark.createDataFrame([("a", False), ("b", False), ("c", True)], "event_id string, resolved boolean")
    ids = spark.createDataFrame([("a",), ("z",), ("a",)], "event_id string")
    assert sorted(map(tuple, dlq.resolve(rows, ids).collect())) == [("a", True), ("b", False), ("c", True)]


def test_columns_are_those_of_the_whole_row(spark):
    iocs = spark.createDataFrame([("203.0.113.5", "bad", 0)], "indicator string, category string, ord long")
    assets = spark.createDataFrame([("10.0.0.5", "critical", 0)], "ip string, criticality string, ord long")
    dims = Dimensions.build(iocs=iocs, assets=assets)
    df = lines(spark, PANOS.format(src="203.0.113.5", sport=1), PANOS.format(src="300.1.1.1", sport=99999), "junk")
    ctx = Context(now=NOW, dims=dims)
    full = {r.event_id: r for r in process(df, ctx).collect()}
    for some in (["event_id"], ["event_id", "enrich_risk_score", "risk_factors"], ["event_id", "quality_score", "violations"], ["event_id", "network_bytes_total", "event_time_skew_ms", "enrich_src_is_internal"]):
        rows = process(df, ctx, columns=some)
        assert rows.columns == some
        got = rows.collect()
        assert len(got) == 3 and all(r[c] == full[r.event_id][c] for r in got for c in some)
    plan = lambda rows: rows._jdf.queryExecution().optimizedPlan().toString()
    # no lookup and no parser for what nobody reads; a filter on the id is below the seal
    assert "Join" in plan(process(df, ctx, columns=["event_id", "risk_factors"]))
    assert "Join" not in plan(process(df, ctx, columns=["event_id", "src_ip"])) and "Generate" not in plan(process(df, ctx, columns=["event_id"]))
    one = plan(process(df, ctx).filter("event_id = 'x'"))
    assert "'x'" in one or "= x" in one
    assert one.rindex("= x") > one.rindex("Generate")

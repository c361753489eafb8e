"""Queries over the event table, integrity jobs, dashboard analytics."""

from __future__ import annotations

from pyspark.sql import functions as F

from eventlake.functions import timefmt
from eventlake.functions.session_functions import register
from eventlake.operators import integrity
from eventlake.plans import analytics as an
from eventlake.plans import graph
from eventlake.plans import lake_queries as lq
from eventlake.plans.catalog import Catalog
from eventlake.plans.process import dead_letters, flat_rows, process
from eventlake.sources.readers import recent_days
from suite import inputs
from suite.inputs import NOW
from suite.oracle import sql
from suite.q_core import registry
from suite.registry import query

r6 = lambda c: F.round(c, 6)

# --- canonical queries -------------------------------------------------------------


@query(
    "qry1_cross_vendor",
    sql("SELECT observer_vendor, observer_product, event_action, count(*) AS events, CAST(sum(network_bytes_total) AS BIGINT) AS bytes FROM norm WHERE dst_port = 443 GROUP BY 1, 2, 3", "norm"),
)
def _(spark, sf):
    return lq.cross_vendor(inputs.lake(spark, sf))


@query(
    "qry2_hot_and_cold",
    sql("SELECT 'live' AS tier, n_src_ip AS src_ip, count(*) AS events FROM norm WHERE event_ingested_at >= 1706572800000000000 - 1800000000000 GROUP BY 1, 2 "
        "UNION ALL SELECT 'historical', n_src_ip, count(*) FROM norm GROUP BY 1, 2", "norm"),
)
def _(spark, sf):
    lake = inputs.columns_of(spark, sf, "src_ip", "event_ingested_at")
    Catalog(spark).lake(lake).stream(lake, F.timestamp_micros(F.lit(1706572800000000)))
    return lq.hot_and_cold(spark.table("stream_events"), spark.table("lake_events"))


_REG = "SELECT o_orderkey AS id, o_orderpriority AS pid, 'v' || o_orderkey AS version, CASE o_orderstatus WHEN 'P' THEN 'draft' ELSE 'published' END AS state, o_orderdate AS published FROM orders"


@query(
    "qry3_registry_join",
    sql("SELECT observer_vendor, parser_id AS lineage_parser_id, version AS registered_version, count(*) AS events, round(avg(quality), 6) AS avg_quality FROM val JOIN reg USING (parser_id) GROUP BY 1, 2, 3",
        extra={"reg": f"SELECT *, CASE id % 5 WHEN 0 THEN 'paloalto.panos.traffic' WHEN 1 THEN 'fortinet.fortigate.traffic' WHEN 2 THEN 'cisco.asa.302013' WHEN 3 THEN 'acme.sensor.alert' ELSE 'orion.guard.cef' END AS parser_id FROM ({_REG})"}),
)
def _(spark, sf):
    ids = F.element_at(F.array(*[F.lit(inputs.PARSERS[i][0]) for i in range(5)]), (F.col("id") % 5 + 1).cast("int"))
    reg = registry(spark, sf).withColumn("parser_id", ids)
    out = lq.registry_quality(inputs.lake(spark, sf), reg)
    return out.select("observer_vendor", "lineage_parser_id", "registered_version", "events", r6("avg_quality").alias("avg_quality"))


@query(
    "qry5_losslessness",
    sql("SELECT observer_vendor, count(*) AS events, round(avg(unmapped_count), 6) AS avg_unmapped_fields, CAST(0 AS BIGINT) AS missing_raw_ref FROM norm GROUP BY 1", "norm"),
)
def _(spark, sf):
    return lq.losslessness(inputs.lake(spark, sf)).withColumn("avg_unmapped_fields", r6("avg_unmapped_fields"))


@query(
    "qry6_parser_health",
    sql("SELECT parser_id AS lineage_parser_id, hour, round(avg(quality), 6) AS avg_quality, CAST(0 AS BIGINT) AS partials FROM val GROUP BY 1, 2"),
)
def _(spark, sf):
    return lq.parser_health(inputs.lake(spark, sf)).withColumn("avg_quality", r6("avg_quality"))


@query(
    "qry7_source_features",
    sql("SELECT n_src_ip AS src_ip, event_observed_at // 3600000000000 AS hour_no, count(DISTINCT n_dst_ip) AS distinct_dsts, count(DISTINCT dst_port) AS distinct_ports, "
        "round(sum(network_bytes_out)::DOUBLE / nullif(sum(network_bytes_in), 0), 6) AS out_in_ratio, round(sum(CASE WHEN event_action = 'blocked' THEN 1 ELSE 0 END)::DOUBLE / count(*), 6) AS block_rate FROM norm GROUP BY 1, 2", "norm"),
)
def _(spark, sf):
    f = lq.source_features(inputs.lake(spark, sf))
    hour_no = timefmt.idiv(F.unix_seconds("hr"), 3600)
    return f.select("src_ip", hour_no.alias("hour_no"), "distinct_dsts", "distinct_ports", r6("out_in_ratio").alias("out_in_ratio"), r6("block_rate").alias("block_rate"))


@query("qry8_recent", sql("SELECT event_id, observer_vendor FROM norm ORDER BY event_ingested_at DESC, event_id LIMIT 200", "norm"))
def _(spark, sf):
    return lq.recent(inputs.lake(spark, sf), 200).select("event_id", "observer_vendor")


@query("qry9_recent_window", sql("SELECT event_id, dt FROM norm WHERE dt >= '2024-01-17' ORDER BY event_ingested_at DESC, event_id LIMIT 240", "norm"))
def _(spark, sf):
    return lq.recent(recent_days(inputs.lake(spark, sf), "2024-01-31"), 240).select("event_id", "dt")


@query("qry10_full_record", sql("SELECT event_id, n_src_ip AS src_ip, dst_port, event_action FROM norm WHERE event_id = 'ev-0000000042'", "norm"))
def _(spark, sf):
    # the whole record is processed, but only that of the event: the filter reaches the source
    rows = process(inputs.raw_events(spark, sf), inputs.context(spark, sf))
    return lq.by_id(flat_rows(rows), "ev-0000000042").select("event_id", "src_ip", "dst_port", "event_action")


@query("qry12_totals", sql("SELECT coalesce(observer_vendor, 'unknown') AS name, count(*) AS events FROM norm GROUP BY 1", "norm"))
def _(spark, sf):
    return lq.totals(inputs.lake(spark, sf))


@query(
    "qry12_action_totals",
    sql("SELECT coalesce(event_action, 'unknown') AS name, count(*) AS events FROM norm GROUP BY 1", "norm"),
)
def _(spark, sf):
    return lq.totals(inputs.lake(spark, sf), "event_action")


@query("qry13_latest_versions", f"SELECT pid AS parser_id, version FROM ({_REG}) QUALIFY row_number() OVER (PARTITION BY pid ORDER BY published DESC, id DESC) = 1")
def _(spark, sf):
    return lq.latest_versions(registry(spark, sf)).select("parser_id", "version")


@query("qry14_version_history", f"SELECT id, version FROM ({_REG}) WHERE pid = '2-HIGH'")
def _(spark, sf):
    return lq.version_history(registry(spark, sf), "2-HIGH").select("id", "version")


@query("qry15_rollback", f"SELECT pid AS parser_id, version FROM ({_REG}) WHERE state = 'published' QUALIFY row_number() OVER (PARTITION BY pid ORDER BY published DESC, id DESC) = 2")
def _(spark, sf):
    return lq.rollback_targets(registry(spark, sf)).select("parser_id", "version")


@query(
    "qry16_rollout",
    f"""WITH reg AS ({_REG}), last AS (SELECT node, pid, arg_max(version, id) AS loaded FROM (SELECT 'node-' || (id % 7) AS node, * FROM reg) GROUP BY 1, 2),
 newest AS (SELECT pid, version FROM reg QUALIFY row_number() OVER (PARTITION BY pid ORDER BY published DESC, id DESC) = 1)
 SELECT node AS node_id, last.pid AS parser_id, loaded AS loaded_version, newest.version AS latest_version, loaded <> newest.version AS behind FROM last JOIN newest USING (pid)""",
)
def _(spark, sf):
    reg = registry(spark, sf)
    reports = reg.select(
        F.concat(F.lit("node-"), (F.col("id") % 7).cast("string")).alias("node_id"), "parser_id", F.col("version").alias("loaded_version"), F.col("id").alias("reported_at")
    )
    return lq.rollout(reports, reg).select("node_id", "parser_id", "loaded_version", "latest_version", "behind")


@query(
    "qry17_inventory",
    sql("SELECT s_name AS name, s_suppkey AS log_source_id, vendor, last_seen AS last_seen_ns FROM src LEFT JOIN (SELECT observer_vendor AS vendor, max(event_ingested_at) AS last_seen FROM norm GROUP BY 1) USING (vendor)", "norm",
        extra={"src": "SELECT *, CASE s_suppkey % 4 WHEN 0 THEN 'paloalto' WHEN 1 THEN 'cisco' WHEN 2 THEN 'acme' ELSE 'silent' END AS vendor FROM supplier"}),
)
def _(spark, sf):
    vendor = F.element_at(F.array(*[F.lit(v) for v in ("paloalto", "cisco", "acme", "silent")]), (F.col("s_suppkey") % 4 + 1).cast("int"))
    src = inputs.table(spark, sf, "supplier").select(F.col("s_name").alias("name"), F.col("s_suppkey").alias("log_source_id"), vendor.alias("vendor"))
    return lq.source_inventory(src, inputs.lake(spark, sf)).select("name", "log_source_id", "vendor", "last_seen_ns")


# --- integrity ---------------------------------------------------------------------

_AGE = 6 * 3600 * timefmt.NS_PER_S


def preserved(spark, sf):
    """Lines with raw references: six-hour segments (stored once)."""
    return inputs.stored(spark, sf, "raw_refs", lambda: placed(spark, sf).drop("listener_id", "peer", "processing_ms", "raw_retrieval_uri"))


def placed(spark, sf):
    """References of all lines, not stored and without payload: for a query that reads some of their columns once."""
    return integrity.segments(inputs.raw_events(spark, sf), age_ns=_AGE, max_events=1_000_000)


def references(spark, sf):
    """What tells where a line is preserved, without its payload (stored once)."""
    columns = ["event_id", "received_at", "dt", "raw_sha256", "raw_length", "raw_segment_id", "raw_offset", "raw_seq"]
    return inputs.stored(spark, sf, "references", lambda: placed(spark, sf).select(*columns))


_SEG = {
    "refs": f"SELECT event_id, raw, sha256(raw) AS sha, octet_length(encode(raw)) AS len, received_at, strftime(make_timestamp(received_at // 1000), '%Y-%m-%d') AS day, "
    f"strftime(make_timestamp(received_at // 1000), '%Y-%m-%d') || '-' || lpad(CAST(received_at // {_AGE} AS VARCHAR), 12, '0') || '-0000-000' AS seg FROM ln",
    "ordered": "SELECT *, row_number() OVER w - 1 AS seq, coalesce(sum(len) OVER (PARTITION BY seg ORDER BY received_at, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS off FROM refs WINDOW w AS (PARTITION BY seg ORDER BY received_at, event_id)",
    "leaves": "SELECT seg, day, list(sha ORDER BY seq) AS l, count(*) AS n, sum(len) AS bytes, max(received_at) AS sealed FROM ordered GROUP BY 1, 2",
    "tree": "SELECT seg, 0 AS lvl, l FROM leaves UNION ALL SELECT seg, lvl + 1, list_transform(range(0, (len(l) + 1) // 2), lambda i: sha256(unhex(l[2 * i + 1] || coalesce(l[2 * i + 2], l[2 * i + 1])))) FROM tree WHERE len(l) > 1",
    "roots": "SELECT seg, l[1] AS root FROM tree WHERE len(l) = 1",
    "ledger": "SELECT leaves.*, root, lag(root, 1, repeat('0', 64)) OVER (PARTITION BY day ORDER BY sealed, seg) AS prev FROM leaves JOIN roots USING (seg)",
}


def seg_sql(body: str) -> str:
    return sql(body, "ln", _SEG)


@query("int1_payload_hash", sql("SELECT event_id, sha256(raw) AS sha256 FROM ln", "ln"))
def _(spark, sf):
    return inputs.raw_events(spark, sf).select("event_id", integrity.payload_hash(F.col("raw")).alias("sha256"))


@query("int2_segments", seg_sql("SELECT seg AS segment_id, count(*) AS events, CAST(sum(len) AS BIGINT) AS bytes FROM refs GROUP BY 1"))
def _(spark, sf):
    rows = references(spark, sf)
    return rows.groupBy(F.col("raw_segment_id").alias("segment_id")).agg(F.count("*").alias("events"), F.sum("raw_length").alias("bytes"))


@query("int3_raw_refs", seg_sql("SELECT event_id, seg AS segment_id, CAST(off AS BIGINT) AS \"offset\", CAST(len AS BIGINT) AS length, CAST(seq AS BIGINT) AS seq FROM ordered"))
def _(spark, sf):
    return references(spark, sf).select(
        "event_id", F.col("raw_segment_id").alias("segment_id"), F.col("raw_offset").alias("offset"), F.col("raw_length").alias("length"), F.col("raw_seq").alias("seq")
    )


@query("int4_merkle_roots", seg_sql("SELECT seg AS segment_id, root AS merkle_root FROM roots"))
def _(spark, sf):
    return integrity.ledger(references(spark, sf)).select("segment_id", "merkle_root")


@query("ext5_merkle_in_sql", seg_sql("SELECT seg AS segment_id, root AS merkle_root FROM roots"))
def _(spark, sf):
    register(spark)
    return spark.sql(
        "SELECT raw_segment_id AS segment_id, merkle_root(transform(array_sort(array_agg(struct(raw_seq, raw_sha256))), x -> x.raw_sha256)) AS merkle_root "
        "FROM {refs} GROUP BY raw_segment_id",
        refs=references(spark, sf),
    )


@query("int5_chain", seg_sql("SELECT seg AS segment_id, prev AS prev_root, day AS dt FROM ledger"))
def _(spark, sf):
    return integrity.ledger(references(spark, sf)).select("segment_id", "prev_root", "dt")


@query("int6_ledger", seg_sql("SELECT seg AS segment_id, n AS event_count, CAST(bytes AS BIGINT) AS byte_size, sealed AS sealed_at_ns FROM ledger"))
def _(spark, sf):
    return integrity.ledger(references(spark, sf)).select("segment_id", "event_count", "byte_size", "sealed_at_ns")


@query(
    "int7_verify",
    # one altered byte in every 1000th event: exactly the segments that hold one fail
    seg_sql("SELECT seg AS segment_id, NOT bool_or(CAST(substr(event_id, 4) AS BIGINT) % 1000 = 500) AS pass, true AS chain_ok FROM ordered GROUP BY 1"),
)
def _(spark, sf):
    hit = F.substring("event_id", 4, 10).cast("long") % 1000 == 500
    altered = F.when(hit, F.concat(F.lit("~"), F.expr("substring(raw, 2)"))).otherwise(F.col("raw"))
    # stored payloads are hashed where they are read; of a line only its place and its two hashes meet in a segment
    lines = inputs.raw_events(spark, sf).withColumn("found_sha256", integrity.payload_hash(altered))
    columns = ["received_at", "dt", "raw_sha256", "raw_length", "raw_segment_id", "raw_seq", "found_sha256"]
    build = lambda: integrity.segments(lines, age_ns=_AGE, max_events=1_000_000).select(*columns)
    rows = inputs.stored(spark, sf, "rehashed", build)
    return integrity.verify(integrity.ledger(rows), rows, found="found_sha256").select("segment_id", "pass", "chain_ok")


@query(
    "int8_proofs",
    seg_sql("SELECT event_id, root, CAST(ceil(log2(n)) AS INTEGER) AS steps, true AS verified FROM ordered JOIN leaves USING (seg) JOIN roots USING (seg)"),
)
def _(spark, sf):
    rows = integrity.check_proofs(integrity.proofs(references(spark, sf)))
    return rows.select("event_id", "root", F.size("path").alias("steps"), "verified")


@query(
    "int10_verified_read",
    sql("SELECT event_id, CASE WHEN id % 50 = 7 THEN 'not_found' WHEN id % 20 = 3 THEN 'integrity_error' ELSE 'ok' END AS status FROM ev", "ev"),
)
def _(spark, sf):
    rows = preserved(spark, sf)
    num = F.substring("event_id", 4, 10).cast("long")
    stored = rows.filter(num % 50 != 7).withColumn("raw", F.when(num % 20 == 3, F.concat("raw", F.lit("!"))).otherwise(F.col("raw")))
    refs = rows.select("event_id", "raw_segment_id", "raw_offset", "raw_length", "raw_sha256")
    return integrity.read_by_ref(refs, stored).select("event_id", "status")


@query("int11_uri", seg_sql("SELECT event_id, 's3a://raw-vault/segments/dt=' || substr(seg, 1, 10) || '/' || seg || '.zst' AS uri FROM refs"))
def _(spark, sf):
    return placed(spark, sf).select("event_id", F.col("raw_retrieval_uri").alias("uri"))


@query("snk5_raw_index", seg_sql("SELECT dt, count(*) AS rows, CAST(sum(len) AS BIGINT) AS bytes FROM (SELECT day AS dt, len FROM ordered) GROUP BY 1"))
def _(spark, sf):
    idx = integrity.raw_index(references(spark, sf))
    return idx.groupBy("dt").agg(F.count("*").alias("rows"), F.sum("length").alias("bytes"))


@query("snk6_segments_export", seg_sql("SELECT seg AS segment_id, root AS merkle_root, n AS event_count FROM ledger WHERE day BETWEEN '2024-01-05' AND '2024-01-09'"))
def _(spark, sf):
    from eventlake.sources.readers import segments_by_day

    # segments and their chain never cross a day, so other days are left out before any tree is built
    days = references(spark, sf).filter(F.col("dt").between("2024-01-05", "2024-01-09"))
    rows = segments_by_day(integrity.ledger(days), "2024-01-05", "2024-01-09")
    return rows.select("segment_id", "merkle_root", "event_count")


def linked(spark, sf):
    """Event rows that carry their raw references."""
    rows = references(spark, sf).select("event_id", "raw_sha256", "raw_segment_id", "raw_offset", "raw_length")
    lake = inputs.lake(spark, sf).drop("raw_sha256", "raw_segment_id", "raw_offset", "raw_length")
    return lake.join(rows, "event_id")


@query("qry4_custody", seg_sql("SELECT event_id, seg AS raw_segment_id, CAST(off AS BIGINT) AS raw_offset, root AS merkle_root, prev AS prev_root FROM ordered JOIN ledger USING (seg)"))
def _(spark, sf):
    refs = references(spark, sf)
    return lq.custody(refs, integrity.ledger(refs)).select("event_id", "raw_segment_id", "raw_offset", "merkle_root", "prev_root")


@query("qry11_vault_chain", seg_sql("SELECT seg AS segment_id, root AS merkle_root FROM ledger ORDER BY sealed DESC, seg DESC LIMIT 20"))
def _(spark, sf):
    return lq.vault_chain(integrity.ledger(references(spark, sf))).select("segment_id", "merkle_root")


@query(
    "qry18_trace",
    sql("SELECT norm.event_id, norm.observer_vendor, seg AS segment_id, CAST(off AS BIGINT) AS \"offset\", sha AS sha256, root AS merkle_root FROM norm JOIN ordered USING (event_id) JOIN ledger USING (seg)", "norm", _SEG),
)
def _(spark, sf):
    refs = references(spark, sf)
    out = integrity.trace(inputs.columns_of(spark, sf, "event_id", "observer_vendor"), integrity.raw_index(refs), integrity.ledger(refs))
    return out.select("event_id", "observer_vendor", "segment_id", "offset", "sha256", "merkle_root")


# --- dashboard analytics -----------------------------------------------------------


def board(spark, sf):
    """Event rows with their state, and dead letters as rows of their own."""
    cols = ["event_id", "observer_vendor", "event_action", "src_ip", "dst_ip", "event_ingested_at"]
    made_of = [*cols, "enrich_ioc_match", "threat_category", "enrich_risk_score", "lineage_parser_id", "violations"]
    # stored once: a board is read twice, for its events and its dead letters
    live = inputs.stored(spark, sf, "board_events", lambda: inputs.columns_of(spark, sf, *made_of))
    ev = live.select(*cols, an.visual_state().alias("state"), F.lit(False).alias("is_dlq"), F.lit(None).cast("string").alias("dlq_reason"))
    dead = dead_letters(live).select(
        "event_id", F.substring_index("lineage_parser_id", ".", 1).alias("observer_vendor"), F.lit(None).cast("string").alias("event_action"),
        F.lit(None).cast("string").alias("src_ip"), F.lit(None).cast("string").alias("dst_ip"), "event_ingested_at",
        F.lit("dlq").alias("state"), F.lit(True).alias("is_dlq"), F.array_join("dlq_reasons", ",").alias("dlq_reason"),
    )
    return ev.unionByName(dead)


_BOARD = {
    "board": "SELECT event_id, observer_vendor, event_action, n_src_ip AS src_ip, n_dst_ip AS dst_ip, received_at, state, false AS is_dlq, CAST(NULL AS VARCHAR) AS reason FROM val "
    "UNION ALL SELECT event_id, split_part(parser_id, '.', 1), CAST(NULL AS VARCHAR), CAST(NULL AS VARCHAR), CAST(NULL AS VARCHAR), received_at, 'dlq', true, array_to_string(reasons, ',') FROM val WHERE len(reasons) > 0"
}


def b_sql(body: str, **extra: str) -> str:
    return sql(body, "val", {**_BOARD, **extra})


@query("ana1_states", b_sql("SELECT event_id, state FROM board"))
def _(spark, sf):
    return board(spark, sf).select("event_id", "state")


@query("ana2_state_counts", b_sql("SELECT s AS state, (SELECT count(*) FROM board WHERE state = s) AS events FROM (VALUES ('normal'), ('elevated'), ('threat'), ('dlq')) v(s)"))
def _(spark, sf):
    return an.state_counts(board(spark, sf))


@query("ana3_risk_bands", sql("SELECT CASE WHEN risk >= 75 THEN 'Critical' WHEN risk >= 50 THEN 'High' WHEN risk >= 25 THEN 'Moderate' ELSE 'Low' END AS band, count(*) AS events FROM enr GROUP BY 1", "enr"))
def _(spark, sf):
    return an.risk_bands(inputs.event_rows(spark, sf))


@query(
    "ana4_volume",
    sql("SELECT b AS bin, count(bin) AS events FROM (SELECT CAST(range AS INTEGER) AS b FROM range(12)) LEFT JOIN (SELECT CAST(least(11, floor((t - lo) / greatest(1, hi - lo) * 12)) AS INTEGER) AS bin FROM (SELECT received_at / 1e6 AS t, min(received_at / 1e6) OVER () AS lo, max(received_at / 1e6) OVER () AS hi FROM ev)) ON b = bin GROUP BY 1", "ev"),
)
def _(spark, sf):
    return an.volume(inputs.event_rows(spark, sf))


@query(
    "ana5_summary",
    sql("SELECT round(avg(quality) * 100, 4) AS avg_quality, round(avg(risk), 4) AS avg_risk, 0.0::DOUBLE AS raw_linked_pct, count(DISTINCT parser_id) AS parsers, "
        "list_sort(list(processing_ms))[CAST(floor(count(*) * 0.95) AS BIGINT) + 1] AS p95_processing_ms FROM val"),
)
def _(spark, sf):
    s = an.summary(inputs.event_rows(spark, sf))
    return s.select(F.round("avg_quality", 4).alias("avg_quality"), F.round("avg_risk", 4).alias("avg_risk"), "raw_linked_pct", "parsers", "p95_processing_ms")


@query("ana6_top_vendors", sql("SELECT coalesce(observer_vendor, 'unknown') AS vendor, count(*) AS events FROM norm GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 6", "norm"))
def _(spark, sf):
    return an.top_vendors(inputs.event_rows(spark, sf))


@query(
    "ana7_timeline",
    sql("SELECT row_number() OVER (ORDER BY received_at, event_id) AS position, CAST(floor(quality * 100 + 0.5) AS BIGINT) AS quality, CAST(floor(risk + 0.5) AS BIGINT) AS risk FROM (SELECT * FROM val ORDER BY received_at DESC, event_id DESC LIMIT 40)"),
)
def _(spark, sf):
    return an.timeline(inputs.event_rows(spark, sf))


@query("ana8_internal_assets", sql("SELECT n_dst_ip AS ip, count(*) AS hits FROM enr WHERE dst_internal GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 12", "enr"))
def _(spark, sf):
    return an.internal_assets(inputs.event_rows(spark, sf))


@query(
    "ana9_related",
    sql("SELECT event_id, CAST(greatest(0, coalesce(s.n, 0) + coalesce(d.n, 0) - coalesce(p.n, 0) - 1) AS BIGINT) AS related FROM norm LEFT JOIN per s ON s.ip = n_src_ip LEFT JOIN per d ON d.ip = n_dst_ip "
        "LEFT JOIN (SELECT n_src_ip AS a, n_dst_ip AS b, count(*) AS n FROM norm WHERE known GROUP BY 1, 2) p ON p.a = n_src_ip AND p.b = n_dst_ip", "norm",
        extra={"per": "SELECT ip, count(*) AS n FROM (SELECT n_src_ip AS ip FROM norm WHERE known UNION ALL SELECT n_dst_ip FROM norm WHERE known) GROUP BY 1"}),
)
def _(spark, sf):
    return an.related_counts(inputs.event_rows(spark, sf))


_EDGES = {
    "edges": "SELECT 'vendor:' || coalesce(observer_vendor, 'Unknown vendor') AS source, 'event:' || event_id AS target, state FROM board "
    "UNION ALL SELECT 'event:' || event_id, 'ip:' || src_ip, state FROM board WHERE src_ip IS NOT NULL "
    "UNION ALL SELECT 'event:' || event_id, 'ip:' || dst_ip, state FROM board WHERE dst_ip IS NOT NULL "
    "UNION ALL SELECT 'event:' || event_id, 'reason:' || unnest(string_split(reason, ',')), 'dlq' FROM board WHERE is_dlq"
}


@query("ana10_edges", b_sql("SELECT source, target, state FROM edges", **_EDGES))
def _(spark, sf):
    return graph.edges(board(spark, sf))


@query(
    "ana10_nodes",
    b_sql("SELECT DISTINCT id, CASE split_part(id, ':', 1) WHEN 'ip' THEN 'endpoint' ELSE split_part(id, ':', 1) END AS kind FROM (SELECT source AS id FROM edges UNION ALL SELECT target FROM edges)", **_EDGES),
)
def _(spark, sf):
    return graph.nodes(graph.edges(board(spark, sf))).select("id", "kind")


# every board row of an event that is next to the node, whichever of its rows names the reason
@query("ana11_events_for_node", b_sql("SELECT event_id FROM board WHERE event_id IN (SELECT event_id FROM board WHERE is_dlq AND list_contains(string_split(reason, ','), 'bad_ip'))"))
def _(spark, sf):
    rows = board(spark, sf)
    return graph.events_for_node(rows, graph.edges(rows), "reason:bad_ip").select("event_id")


@query(
    "ana12_quota_sample",
    b_sql("SELECT event_id, is_dlq, (SELECT count(DISTINCT event_id) FROM board) - 150 AS overflow FROM ("
          "(SELECT event_id, is_dlq FROM board WHERE is_dlq ORDER BY received_at DESC, event_id LIMIT 38) UNION ALL "
          "(SELECT event_id, is_dlq FROM board b WHERE NOT is_dlq AND event_id NOT IN (SELECT event_id FROM board WHERE is_dlq) ORDER BY received_at DESC, event_id LIMIT 112))"),
)
def _(spark, sf):
    return an.quota_sample(board(spark, sf), 150).select("event_id", "is_dlq", "overflow")


@query("ana13_facet_filter", b_sql("SELECT event_id FROM board WHERE state IN ('threat', 'elevated') AND observer_vendor IN ('acme', 'orion') AND event_action = 'blocked'"))
def _(spark, sf):
    return an.facet_filter(board(spark, sf), ["threat", "elevated"], vendors=["acme", "orion"], outcomes=["blocked"]).select("event_id")


def samples(spark, sf):
    """Hourly cumulative counters per event type that restart every ten hours."""
    from pyspark.sql import Window

    ev = inputs.values(spark, sf)
    hourly = ev.groupBy("event_type", timefmt.idiv(F.col("sec"), 3600).alias("h")).agg(F.count("*").alias("n"))
    upto = Window.partitionBy("event_type", timefmt.idiv(F.col("h"), 10)).orderBy("h")
    return hourly.select(
        F.lit("events_total").alias("name"), F.col("event_type").alias("label"), (F.col("h") * 3600 * timefmt.NS_PER_S).alias("ts"), F.sum("n").over(upto).alias("value")
    )


_SAMPLES = {
    "samples": "SELECT event_type AS label, h * 3600 AS t, sum(n) OVER (PARTITION BY event_type, h // 10 ORDER BY h) AS value FROM (SELECT event_type, sec // 3600 AS h, count(*) AS n FROM ev GROUP BY 1, 2)"
}


@query(
    "ana14_counter_rate",
    sql("SELECT label, t AS second, CASE WHEN value >= p THEN round((value - p)::DOUBLE / (t - pt), 9) END AS rate FROM (SELECT *, lag(value) OVER w AS p, lag(t) OVER w AS pt FROM samples WINDOW w AS (PARTITION BY label ORDER BY t))", "ev", _SAMPLES),
)
def _(spark, sf):
    r = an.counter_rate(samples(spark, sf), ["label"])
    return r.select("label", timefmt.idiv(F.col("ts"), timefmt.NS_PER_S).alias("second"), F.round("rate", 9).alias("rate"))


@query("ana15_rate_by_label", sql("SELECT received_at // 60000000000 AS minute, observer_vendor, round(count(*) / 60.0, 6)::DOUBLE AS per_second FROM norm GROUP BY 1, 2", "norm"))
def _(spark, sf):
    r = an.rate_by_label(inputs.event_rows(spark, sf), "observer_vendor")
    return r.select(timefmt.idiv(F.unix_seconds("start"), 60).alias("minute"), "observer_vendor", r6("per_second").alias("per_second"))


@query(
    "ana16_histogram_quantile",
    sql("""SELECT event_type, round(CASE WHEN isinf(le) THEN lo ELSE lo + (le - lo) * (0.99 * total - before) / (c - before) END, 6) AS q FROM (
 SELECT *, coalesce(lag(le) OVER w, 0) AS lo, coalesce(lag(c) OVER w, 0) AS before, max(c) OVER (PARTITION BY event_type) AS total FROM (
  SELECT event_type, le, count(*) FILTER (processing_ms <= le) AS c FROM ev, (SELECT unnest([0.5, 1.0, 2.5, 4.0, 'inf'::DOUBLE]) AS le) GROUP BY 1, 2) WINDOW w AS (PARTITION BY event_type ORDER BY le))
 WHERE c >= 0.99 * total AND before < 0.99 * total""", "ev"),
)
def _(spark, sf):
    b = an.to_buckets(inputs.values(spark, sf), ["event_type"], "processing_ms", [0.5, 1.0, 2.5, 4.0])
    return an.histogram_quantile(b, ["event_type"], 0.99).select("event_type", r6("quantile").alias("q"))


@query("ana17_counter_totals", sql("SELECT 'events_total' AS name, CAST(sum(value) AS BIGINT) AS total FROM samples", "ev", _SAMPLES))
def _(spark, sf):
    return an.counter_totals(samples(spark, sf))


@query("ana18_facets", b_sql("SELECT DISTINCT 'vendor' AS facet, observer_vendor AS value FROM board WHERE observer_vendor IS NOT NULL UNION SELECT 'outcome', coalesce(event_action, 'unknown') FROM board"))
def _(spark, sf):
    return an.facet_values(board(spark, sf))


@query("ana19_risk_delta", sql("SELECT event_id, round(risk - avg(risk) OVER (), 6) AS risk_delta FROM enr", "enr"))
def _(spark, sf):
    return an.risk_vs_average(inputs.event_rows(spark, sf)).select("event_id", r6("risk_delta").alias("risk_delta"))


@query("ana20_neighbours", b_sql("SELECT DISTINCT CASE WHEN source = 'vendor:acme' THEN target ELSE source END AS id FROM edges WHERE source = 'vendor:acme' OR target = 'vendor:acme'", **_EDGES))
def _(spark, sf):
    return graph.neighbours(graph.edges(board(spark, sf)), "vendor:acme")


@query("ana21_unseen", sql("SELECT event_id FROM norm WHERE id % 4 > 0", "norm"))
def _(spark, sf):
    seen = inputs.values(spark, sf).filter(F.col("id") % 4 == 0)
    return an.unseen(inputs.columns_of(spark, sf, "event_id"), seen)

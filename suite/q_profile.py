"""Source profiling, renderings, framing and stream-style queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from eventlake.functions import timefmt
from eventlake.operators.framing import join_lines, truncate
from eventlake.operators.identify import identify
from eventlake.operators.parse import extract, parse
from eventlake.operators.shapes import ecs, nested_json, ocsf
from eventlake.plans import onboarding as ob
from eventlake.plans.process import flat_rows, process
from eventlake.streaming.jobs import quality_drops, resolve_refs, throughput
from suite import inputs
from suite.oracle import sql
from suite.q_lake import preserved
from suite.registry import query

r6 = lambda c: F.round(c, 6)

# --- other renderings (JSON text, so key facts are read back out of it) -------------


@query("nrm14_nested", sql("SELECT event_id, n_src_ip AS src_ip, CAST(dst_port AS VARCHAR) AS dst_port, parser_id FROM norm", "norm"))
def _(spark, sf):
    # the whole record is rendered as it is processed, without a table of it in between, and each document is read once
    rows = flat_rows(process(inputs.raw_events(spark, sf), inputs.context(spark, sf)))
    doc = rows.select(nested_json(rows).alias("d"))
    read = doc.select(F.from_json("d", "event struct<id: string>, src struct<ip: string>, dst struct<port: string>, lineage struct<parser_id: string>").alias("d"))
    return read.select(F.col("d.event.id").alias("event_id"), F.col("d.src.ip").alias("src_ip"), F.col("d.dst.port").alias("dst_port"), F.col("d.lineage.parser_id").alias("parser_id"))


@query(
    "nrm15_ecs",
    sql("SELECT event_id, coalesce(n_src_ip, '') AS source_ip, coalesce(event_action, '') AS action, threat_signature_id IS NOT NULL AS has_threat, CASE WHEN known THEN strftime(make_timestamp(sec * 1000000), '%Y-%m-%dT%H:%M:%SZ') END AS at FROM norm", "norm"),
)
def _(spark, sf):
    doc = inputs.lake(spark, sf).select(ecs().alias("d"), (F.col("lineage_parse_status") != "failed").alias("known"))
    get = lambda p: F.get_json_object("d", p)
    return doc.select(
        get("$.event.id").alias("event_id"), get("$.source.ip").alias("source_ip"), get("$.event.action").alias("action"),
        get("$.threat").isNotNull().alias("has_threat"), F.when(F.col("known"), get("$['@timestamp']")).alias("at"),
    )


@query(
    "nrm16_ocsf",
    sql("SELECT event_id, CASE event_outcome WHEN 'success' THEN '1' WHEN 'failure' THEN '2' ELSE '0' END AS status_id, CAST(event_observed_at // 1000000 AS VARCHAR) AS time_ms, CAST(coalesce(network_bytes_total, 0) AS VARCHAR) AS bytes FROM norm", "norm"),
)
def _(spark, sf):
    doc = inputs.lake(spark, sf).select(ocsf().alias("d"))
    get = lambda p: F.get_json_object("d", p)
    return doc.select(get("$.metadata.uid").alias("event_id"), get("$.status_id").alias("status_id"), get("$.time").alias("time_ms"), get("$.traffic.bytes").alias("bytes"))


# --- profiling ---------------------------------------------------------------------


def source_lines(spark, sf):
    """Lines of six unknown sources, one per format."""
    ev = inputs.values(spark, sf)
    return ev.select(
        F.concat(F.lit("source-"), F.col("vix").cast("string")).alias("source"), F.col("id").alias("line_no"), F.expr(inputs.line_sql(False)).alias("line"), "event_id"
    )


@query(
    "onb1_shapes",
    sql(
        """SELECT 'source-' || vix AS source, CASE WHEN avg(js) >= 0.9 THEN 'json' WHEN avg(kv) >= 0.5 THEN 'kv'
             WHEN avg((commas = usual)::INT) >= 0.9 AND max(usual) >= 2 THEN 'csv' ELSE 'free_text' END AS shape
           FROM (SELECT *, mode(commas) OVER (PARTITION BY vix) AS usual FROM (SELECT vix, (raw LIKE '{%}')::INT AS js, length(raw) - length(replace(raw, ',', '')) AS commas,
             (len([w FOR w IN string_split_regex(raw, '\\s+') IF regexp_matches(w, '^[A-Za-z_]') AND instr(w, '=') > 1 AND NOT suffix(w, '=')]) >= 2)::INT AS kv FROM ln)) GROUP BY vix""",
        "ln",
    ),
)
def _(spark, sf):
    return ob.shape(source_lines(spark, sf))


TEMPLATES = r"""
form AS (SELECT source, m, CAST(len(m) AS VARCHAR) || '|' || array_to_string(m[1:2], ' ') AS leaf, count(*) AS n, min(line) AS line
         FROM (SELECT source, line, [CASE WHEN regexp_matches(t, '[0-9]') THEN '<*>' ELSE t END for t in regexp_split_to_array(trim(line), '\s+')] AS m FROM lines)
         GROUP BY source, m),
place AS (SELECT source, leaf, n, unnest(m) AS t, generate_subscripts(m, 1) AS p FROM form),
often AS (SELECT source, leaf, p, t FROM (SELECT source, leaf, p, t, sum(n) AS k FROM place GROUP BY ALL)
          JOIN (SELECT source, leaf, sum(n) AS total FROM form GROUP BY ALL) USING (source, leaf) WHERE k >= 0.4 * total AND t <> '<*>'),
own AS (SELECT f.source, f.leaf, f.m, any_value(f.n) AS n, any_value(f.line) AS line, list(CASE WHEN o.t IS NULL THEN '<*>' ELSE f.t END ORDER BY f.p) AS tokens
        FROM (SELECT source, leaf, m, n, line, unnest(m) AS t, generate_subscripts(m, 1) AS p FROM form) f
        LEFT JOIN often o ON o.source = f.source AND o.leaf = f.leaf AND o.p = f.p AND o.t = f.t GROUP BY f.source, f.leaf, f.m),
tpl AS (SELECT source, leaf, tokens, array_to_string(tokens, ' ') AS txt, sum(n) AS n FROM own GROUP BY ALL),
turn AS (SELECT *, first_value(tokens) OVER (PARTITION BY source, leaf ORDER BY n DESC, txt) AS lead FROM tpl
         UNION ALL
         SELECT source, leaf, tokens, txt, n, first_value(tokens) OVER (PARTITION BY source, leaf ORDER BY n DESC, txt) FROM turn
         WHERE NOT (tokens = lead OR len([z for z in list_zip(lead, tokens) if z[1] = z[2] AND z[1] <> '<*>']) >= 0.4 * len(tokens))),
led AS (SELECT source, leaf, tokens, lead FROM turn
        WHERE tokens = lead OR len([z for z in list_zip(lead, tokens) if z[1] = z[2] AND z[1] <> '<*>']) >= 0.4 * len(tokens)),
agreed AS (SELECT source, leaf, lead, p, CASE WHEN min(t) = max(t) THEN min(t) ELSE '<*>' END AS t
           FROM (SELECT source, leaf, lead, unnest(tokens) AS t, generate_subscripts(tokens, 1) AS p FROM led) GROUP BY ALL),
named AS (SELECT source, leaf, lead, string_agg(t, ' ' ORDER BY p) AS template FROM agreed GROUP BY ALL),
final AS (SELECT own.source, own.n, own.line, template FROM own JOIN led USING (source, leaf, tokens) JOIN named USING (source, leaf, lead)),
shown AS (SELECT source, template, string_agg(line, ' || ' ORDER BY line) AS examples
          FROM (SELECT *, row_number() OVER (PARTITION BY source, template ORDER BY line) AS rn FROM final) WHERE rn <= 3 GROUP BY ALL)
SELECT source, template, CAST(sum(n) AS BIGINT) AS size, round(sum(n) * 100.0 / (SELECT sum(n) FROM final g WHERE g.source = final.source), 2) AS coverage_pct,
       any_value(examples) AS examples
FROM final JOIN shown USING (source, template) GROUP BY source, template"""


@query("onb2_templates", sql(", lines AS (SELECT 'source-' || vix AS source, raw AS line FROM ln)," + TEMPLATES, "ln"))
def _(spark, sf):
    return ob.mine_templates(source_lines(spark, sf)).select("source", "template", "size", "coverage_pct", F.array_join("examples", " || ").alias("examples"))


@query(
    "onb2_template_sizes",
    sql("SELECT 'source-' || vix AS source, count(*) AS lines FROM ev GROUP BY 1", "ev"),
)
def _(spark, sf):
    # every line is in exactly one template
    return ob.mine_templates(source_lines(spark, sf)).groupBy("source").agg(F.sum("size").alias("lines"))


@query(
    "onb3_field_names",
    "SELECT 'source-5' AS source, p AS position, n AS name FROM (VALUES (0, 'node'), (1, 'seq'), (2, 'load')) t(p, n) WHERE (SELECT count(*) FROM events) > 0",
)
def _(spark, sf):
    templates = ob.mine_templates(source_lines(spark, sf).filter("source = 'source-5'")).select("source", "template")
    return ob.field_names(templates, ["source"])


@query(
    "onb4_template_values",
    sql("SELECT event_id, CASE vix WHEN 5 THEN CAST(user_id AS VARCHAR) END AS node, CASE vix WHEN 5 THEN CAST(id AS VARCHAR) END AS seq, CASE vix WHEN 5 THEN CAST(k AS VARCHAR) END AS load FROM ev", "ev"),
)
def _(spark, sf):
    rows = source_lines(spark, sf)
    vals = ob.template_values(F.lit("heartbeat node <*> seq <*> load <*>"), F.col("line"))
    return rows.select("event_id", *[F.get(vals, F.lit(i)).alias(n) for i, n in enumerate(["node", "seq", "load"])])


def field_values(spark, sf):
    ev = inputs.values(spark, sf)
    pairs = {
        "src_ip": F.col("dst_ip"),
        "dst_port": F.col("sport").cast("string"),
        "mac": F.concat(F.lit("00:1b:44:11:3a:"), F.lpad(F.col("k").cast("string"), 2, "0")),
        "when": F.date_format("ts", "yyyy-MM-dd HH:mm:ss"),
        "link": F.concat(F.lit("http://h/"), F.col("id").cast("string")),
        "digest": F.md5(F.col("id").cast("string")),
        "site": F.concat(F.lit("h"), F.col("id").cast("string"), F.lit(".example.org")),
        "verb": F.col("act"),
        "sent_total": (F.col("id") * 1000 + 11).cast("string"),
        "user_name": F.col("username"),
        "ratio": F.concat(F.col("id").cast("string"), F.lit(".5")),
        "number": (-F.col("id") - 100).cast("string"),
        "kind": F.concat(F.lit("kind "), F.col("event_type")),
        "note": F.concat(F.lit("some note "), F.col("id").cast("string")),
        "mixed": F.when(F.col("id") % 4 == 0, F.lit("n/a")).otherwise(F.concat(F.lit("-"), F.col("id").cast("string"))),
    }
    entries = F.array(*[F.struct(F.lit(k).alias("field"), v.alias("value")) for k, v in pairs.items()])
    return ev.select(F.lit("s").alias("source"), F.explode(entries).alias("e")).select("source", "e.*")


@query(
    "onb5_field_types",
    """WITH n AS (SELECT count(*) AS n, count(*) FILTER (event_id % 4 > 0) AS i FROM events)
SELECT f AS field, t AS type, CASE WHEN f = 'mixed' THEN round(i::DOUBLE / n, 2) WHEN f = 'kind' THEN round(1.0 - 5.0 / n, 2)::DOUBLE WHEN t = 'free_text' THEN 1.0 ELSE 1.0 END::DOUBLE AS confidence
FROM n, (VALUES ('src_ip','ipv4'),('dst_port','port'),('mac','mac'),('when','timestamp'),('link','url'),('digest','hash'),('site','domain'),('verb','verdict'),
('sent_total','byte_count'),('user_name','free_text'),('ratio','float'),('number','integer'),('kind','enum'),('note','free_text'),('mixed','integer')) v(f, t)""",
)
def _(spark, sf):
    types = ob.infer_types(field_values(spark, sf), inputs.packs().dictionaries)
    return types.select("field", "type", "confidence")


@query(
    "onb7_draft_mapping",
    "SELECT f AS field, p AS path, d AS dictionary, x AS transform FROM (VALUES ('src_ip','src.ip',NULL,NULL),('dst_port','dst.port',NULL,'int'),('verb','event.action','action',NULL)) v(f, p, d, x) WHERE (SELECT count(*) FROM events) > 0",
)
def _(spark, sf):
    types = ob.infer_types(field_values(spark, sf), inputs.packs().dictionaries)
    return ob.draft_mapping(types).filter("path IS NOT NULL").select("field", "path", "dictionary", "transform")


@query(
    "onb6_dominant_literal",
    sql("SELECT 'source-' || vix AS source, token, count(*) AS n FROM (SELECT vix, unnest(string_split_regex(trim(raw), '\\s+')) AS token FROM ln) WHERE length(token) >= 4 GROUP BY 1, 2 QUALIFY row_number() OVER (PARTITION BY source ORDER BY count(*) DESC, token) = 1", "ln"),
)
def _(spark, sf):
    return ob.dominant_literal(source_lines(spark, sf))


@query(
    "onb8_success_rate",
    sql("SELECT 'source-' || vix AS source, count(*) AS lines, CASE WHEN vix = 4 THEN 1.0 ELSE 0.0 END::DOUBLE AS success_rate FROM ev GROUP BY 1, vix", "ev"),
)
def _(spark, sf):
    rows = source_lines(spark, sf).withColumnRenamed("line", "raw")
    return ob.success_rate(extract(rows, [{"op": "cef"}]), ["source"])


@query(
    "onb9_field_success",
    sql(
        """SELECT source, field, round(count(DISTINCT id)::DOUBLE / any_value(total), 3) AS success_rate
           FROM (SELECT 'source-' || vix AS source, id, unnest(regexp_extract_all(raw, '([^ =]+)=("[^"]*"|[^ ]+)', 1)) AS field, count(*) OVER (PARTITION BY vix) AS total FROM ln)
           GROUP BY source, field""",
        "ln",
    ),
)
def _(spark, sf):
    rows = source_lines(spark, sf).withColumnRenamed("line", "raw")
    return ob.field_success(extract(rows, [{"op": "kv"}]), ["source"]).select("source", "field", "success_rate")


@query(
    "onb10_comparison",
    sql("SELECT event_id, raw, CASE WHEN vix < 5 THEN 'ok' ELSE 'failed' END AS parse_status FROM ln ORDER BY event_id LIMIT 5", "ln"),
)
def _(spark, sf):
    packs = inputs.packs()
    rows = parse(identify(inputs.raw_events(spark, sf), packs), packs)
    return ob.comparison(rows.select("event_id", "raw", "parse_status"))


# --- framing and stream-style --------------------------------------------------------


def document_lines(spark, sf):
    docs = inputs.table(spark, sf, "documents")
    return docs.select(F.col("doc_id").alias("source"), F.posexplode(F.split("text", "\n")).alias("line_no", "line"))


_LINES = "SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS n FROM documents"


@query(
    "str3_multiline",
    f"""WITH l AS ({_LINES}), g AS (SELECT *, sum(CASE WHEN regexp_matches(line, '^[A-M]') THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY n) AS e FROM l)
SELECT doc_id AS source, CAST(e AS BIGINT) AS event_no, sha256(string_agg(line, chr(10) ORDER BY n)) AS payload_hash, count(*) > 100000 AS truncated FROM g GROUP BY 1, 2""",
)
def _(spark, sf):
    # small chunks, so that events and counts cross chunk borders
    rows = join_lines(document_lines(spark, sf), "^[A-M]", chunk=3)
    return rows.select("source", "event_no", F.sha2("payload", 256).alias("payload_hash"), "truncated")


@query(
    "str4_truncate",
    "SELECT doc_id, CAST(least(1000, octet_length(encode(text))) AS BIGINT) AS bytes, octet_length(encode(text)) > 1000 AS truncated FROM documents",
)
def _(spark, sf):
    payload, cut = truncate(F.col("text"), 1000)
    return inputs.table(spark, sf, "documents").select("doc_id", F.octet_length(payload).cast("long").alias("bytes"), cut.alias("truncated"))


@query("str5_throughput", sql("SELECT us // 3000000 AS slot, count(*) AS events FROM ev GROUP BY 1", "ev"))
def _(spark, sf):
    ev = inputs.values(spark, sf).withColumn("event_ts", F.timestamp_micros("us"))
    t = throughput(ev)
    return t.select(timefmt.idiv(F.unix_seconds("start"), 3).alias("slot"), "events")


@query(
    "str8_retry",
    sql("SELECT event_id, CASE WHEN id % 10 > 0 THEN 'ready' WHEN id % 40 = 0 THEN 'gone' ELSE 'gone' END AS outcome FROM ev WHERE received_at < 1706486400000000000 UNION ALL "
        "SELECT event_id, CASE WHEN id % 10 > 0 THEN 'ready' ELSE 'retry' END FROM ev WHERE received_at >= 1706486400000000000", "ev"),
)
def _(spark, sf):
    # every tenth payload is missing; references older than a day before 30 January are past the deadline
    refs = preserved(spark, sf)
    stored = refs.filter(F.substring("event_id", 4, 10).cast("long") % 10 > 0)
    wanted = refs.select("event_id", "raw_segment_id", "raw_offset", "raw_length", "raw_sha256", "received_at")
    ready, retry, gone = resolve_refs(wanted, stored, F.lit(1706572800000000000), 86_400 * timefmt.NS_PER_S)
    name = lambda df, n: df.select("event_id", F.lit(n).alias("outcome"))
    return name(ready, "ready").unionByName(name(retry, "retry")).unionByName(name(gone, "gone"))


@query(
    "str9_quality_drops",
    sql("SELECT parser_id AS lineage_parser_id, slot, round(q, 6) AS quality FROM (SELECT *, lag(q) OVER (PARTITION BY parser_id ORDER BY slot) AS p FROM "
        "(SELECT parser_id, event_observed_at // 900000000000 AS slot, avg(quality) AS q FROM val GROUP BY 1, 2)) WHERE q < p * 0.98"),
)
def _(spark, sf):
    out = quality_drops(inputs.lake(spark, sf), drop=0.02)
    return out.select("lineage_parser_id", timefmt.idiv(F.unix_seconds("start"), 900).alias("slot"), r6("quality").alias("quality"))

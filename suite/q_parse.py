"""Parse operators, one query each, over lines or text built from the given tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from eventlake.operators.identify import identify
from eventlake.operators.parse import extract, parse
from eventlake.plans.onboarding import fixture_diff, fixture_summary
from suite import inputs
from suite.oracle import sql
from suite.registry import query


def _lines(spark, sf, built: str | None = None):
    """Lines of all sources, or of a text built from the value columns (Spark SQL)."""
    return inputs.values(spark, sf).select("event_id", F.expr(built or inputs.line_sql(False)).alias("raw"))


def _run(spark, sf, steps, names, built=None, dictionaries=None):
    out = extract(_lines(spark, sf, built), steps, dictionaries, names=names)
    return out.select("event_id", *names, "parse_status")


@query(
    "prs1_syslog_priority",
    sql("SELECT event_id, CASE vix WHEN 0 THEN '14' WHEN 1 THEN '189' WHEN 2 THEN '166' END AS pri, CASE vix WHEN 0 THEN '1' WHEN 1 THEN '23' WHEN 2 THEN '20' END AS facility, CASE vix WHEN 0 THEN '6' WHEN 1 THEN '5' WHEN 2 THEN '6' END AS severity, 'ok' AS parse_status FROM ev", "ev"),
)
def _(spark, sf):
    return _run(spark, sf, [{"op": "syslog"}], ["pri", "facility", "severity"])


_5424 = "concat('<165>1 ', date_format(ts, \"yyyy-MM-dd'T'HH:mm:ss\"), 'Z host', user_id % 9, ' app ', id, ' ID', k, ' ', CASE k % 3 WHEN 0 THEN '- ' WHEN 1 THEN '[x@1 a=\"b c\"] ' ELSE '' END, 'msg of ', user_id)"


@query(
    "prs2_rfc5424",
    sql("SELECT event_id, strftime(ts, '%Y-%m-%dT%H:%M:%S') || 'Z' AS timestamp, 'host' || (user_id % 9) AS hostname, 'app' AS appname, CAST(id AS VARCHAR) AS procid, 'ID' || k AS msgid, CASE k % 3 WHEN 1 THEN '[x@1 a=\"b c\"]' END AS structured_data, 'msg of ' || user_id AS message, 'ok' AS parse_status FROM ev", "ev"),
)
def _(spark, sf):
    names = ["timestamp", "hostname", "appname", "procid", "msgid", "structured_data", "message"]
    return _run(spark, sf, [{"op": "syslog"}], names, built=_5424)


@query(
    "prs3_rfc3164",
    # a header is three tokens whatever they are; a line with fewer than four is a message
    sql("SELECT event_id, CASE WHEN vix = 0 THEN strftime(ts, '%b %-d %H:%M:%S') WHEN vix = 2 THEN strftime(ts, '%b %d %Y %H:%M:%S') WHEN vix <> 3 THEN array_to_string(tok[1:3], ' ') END AS timestamp, "
        "CASE WHEN vix = 0 THEN 'pa-edge-0' || (user_id % 3) WHEN vix = 2 THEN 'asa-fw-0' || (user_id % 3) WHEN vix <> 3 THEN tok[4] END AS hostname, CASE vix WHEN 2 THEN '' END AS appname, "
        "CASE vix WHEN 0 THEN substr(raw, 32) WHEN 2 THEN substr(raw, 39) WHEN 3 THEN raw ELSE array_to_string(tok[5:], ' ') END AS message, 'ok' AS parse_status "
        "FROM (SELECT *, string_split(regexp_replace(raw, '^<[0-9]+>', ''), ' ') AS tok FROM ln)", "ln"),
)
def _(spark, sf):
    return _run(spark, sf, [{"op": "syslog"}], ["timestamp", "hostname", "appname", "message"])


@query(
    "prs4_dissect",
    sql("SELECT event_id, CAST(user_id AS VARCHAR) AS node, CASE WHEN k % 4 = 0 THEN id || ' end' ELSE CAST(id AS VARCHAR) END AS seq, CASE WHEN k % 4 > 0 THEN CAST(k AS VARCHAR) END AS load, CASE WHEN k % 4 = 0 THEN 'partial' ELSE 'ok' END AS parse_status FROM ev", "ev"),
)
def _(spark, sf):
    built = "concat('noise heartbeat node ', user_id, ' seq ', id, CASE WHEN k % 4 = 0 THEN ' end' ELSE concat(' load ', k) END)"
    steps = [{"op": "dissect", "pattern": "heartbeat %{_}node %{node} seq %{seq} load %{load}"}]
    return _run(spark, sf, steps, ["node", "seq", "load"], built=built)


@query(
    "prs5_regex",
    sql("SELECT event_id, CASE vix WHEN 5 THEN CAST(user_id AS VARCHAR) END AS node_id, CASE vix WHEN 5 THEN CAST(k AS VARCHAR) END AS load, CASE vix WHEN 5 THEN 'ok' ELSE 'failed' END AS parse_status FROM ev", "ev"),
)
def _(spark, sf):
    steps = [{"op": "regex", "pattern": r"node (?P<node_id>\d+) seq \d+ load (?P<load>\d+)$"}]
    return _run(spark, sf, steps, ["node_id", "load"])


@query(
    "prs6_grok",
    sql("SELECT event_id, CASE WHEN vix = 2 THEN CASE k % 2 WHEN 0 THEN 'inbound' ELSE 'outbound' END END AS direction, CASE vix WHEN 2 THEN src_ip END AS src_ip, "
        "CASE vix WHEN 2 THEN CAST(sport AS VARCHAR) END AS port, CASE vix WHEN 2 THEN 'ok' ELSE 'failed' END AS parse_status FROM ev", "ev"),
)
def _(spark, sf):
    steps = [{"op": "grok", "pattern": "Built %{WORD:direction} %{WORD} connection %{INT} for %{WORD}:%{IP:src_ip}/%{INT:port} "}]
    return _run(spark, sf, steps, ["direction", "src_ip", "port"])


@query(
    "prs7_json",
    sql("SELECT event_id, CASE vix WHEN 3 THEN src_ip END AS src, CASE vix WHEN 3 THEN CAST(sport AS VARCHAR) END AS spt, CASE vix WHEN 3 THEN '{\"rev\":' || k || ',\"tags\":[\"a\",\"b\"]}' END AS meta, "
        "CAST(NULL AS VARCHAR) AS note, CASE vix WHEN 3 THEN 'ok' ELSE 'failed' END AS parse_status FROM ev", "ev"),
)
def _(spark, sf):
    return _run(spark, sf, [{"op": "json"}], ["src", "spt", "meta", "note"])


_XML = "concat('<event id=\"', id, '\"><src port=\"', sport, '\">', src_ip, '</src><user><name>', username, '</name></user></event>')"


@query(
    "prs8_xml",
    sql("SELECT event_id, CAST(id AS VARCHAR) AS eid, src_ip AS src, CAST(sport AS VARCHAR) AS sport, username AS name, 'ok' AS parse_status FROM ev", "ev"),
)
def _(spark, sf):
    steps = [{"op": "xml"}, {"op": "rename", "from": "event_id", "to": "eid"}, {"op": "rename", "from": "event.src", "to": "src"},
             {"op": "rename", "from": "event.src_port", "to": "sport"}, {"op": "rename", "from": "event.user.name", "to": "name"}]
    return _run(spark, sf, steps, ["eid", "src", "sport", "name"], built=_XML)


_CSV = "concat(id, ',\"', username, ', \"\"', app, '\"\"\",', src_ip, ',', act, ',x', k)"


@query(
    "prs9_csv",
    sql("SELECT event_id, CAST(id AS VARCHAR) AS num, username || ', \"' || app || '\"' AS who, act AS verb, 'x' || k AS col_5, 'ok' AS parse_status FROM ev", "ev"),
)
def _(spark, sf):
    steps = [{"op": "csv", "columns": ["num", "who", "_", "verb"]}]
    return _run(spark, sf, steps, ["num", "who", "verb", "col_5"], built=_CSV)


@query(
    "prs10_kv",
    # lines without these keys, or without any pair, give fewer fields and no error
    sql("SELECT event_id, CASE vix WHEN 1 THEN 'fg branch ' || (user_id % 3) END AS devname, CASE vix WHEN 1 THEN act END AS action, CASE vix WHEN 1 THEN username END AS user, "
        "CASE vix WHEN 1 THEN CAST(sent AS VARCHAR) END AS sentbyte, CASE vix WHEN 4 THEN 'out' END AS has_out, 'ok' AS parse_status FROM ev", "ev"),
)
def _(spark, sf):
    rows = _run(spark, sf, [{"op": "kv"}], ["devname", "action", "user", "sentbyte", "out"])
    return rows.withColumn("out", F.when(F.col("out").isNotNull(), "out")).withColumnRenamed("out", "has_out")


@query(
    "prs11_cef",
    sql("SELECT event_id, CASE vix WHEN 4 THEN 'Orion' END AS device_vendor, CASE vix WHEN 4 THEN CAST(100 + k AS VARCHAR) END AS signature_id, CASE vix WHEN 4 THEN 'conn|' || act END AS name, "
        "CASE vix WHEN 4 THEN src_ip END AS src, CASE vix WHEN 4 THEN username END AS suser, CASE vix WHEN 4 THEN 'ok' ELSE 'failed' END AS parse_status FROM ev", "ev"),
)
def _(spark, sf):
    return _run(spark, sf, [{"op": "cef"}], ["device_vendor", "signature_id", "name", "src", "suser"])


_LEEF = "concat('LEEF:', CASE k % 2 WHEN 0 THEN '1.0' ELSE '2.0' END, '|Maker|Box|3|E', k, '|', CASE k % 2 WHEN 0 THEN '' ELSE '^|' END, 'src=', src_ip, CASE k % 2 WHEN 0 THEN '\\t' ELSE '^' END, 'usr=', username, CASE k % 2 WHEN 0 THEN '\\t' ELSE '^' END, 'n=a b')"


@query(
    "prs12_leef",
    sql("SELECT event_id, CASE k % 2 WHEN 0 THEN '1.0' ELSE '2.0' END AS leef_version, src_ip AS src, username AS usr, 'a b' AS n, 'ok' AS parse_status FROM ev", "ev"),
)
def _(spark, sf):
    return _run(spark, sf, [{"op": "leef"}], ["leef_version", "src", "usr", "n"], built=_LEEF)


@query(
    "prs13_date",
    sql("SELECT event_id, CAST(sec_ns AS VARCHAR) AS d_epoch_ns, CAST(sec_ns - 3600000000000 AS VARCHAR) AS berlin, 'ok' AS parse_status FROM ev", "ev"),
)
def _(spark, sf):
    steps = [
        {"op": "regex", "pattern": r"(?P<d>\S+ \S+)"},
        {"op": "date", "field": "d", "formats": ["02.01.2006", "2006-01-02 15:04:05"]},
        {"op": "date", "field": "d", "as": "berlin", "formats": ["2006-01-02 15:04:05"], "timezone": "Europe/Berlin"},
    ]
    return _run(spark, sf, steps, ["d_epoch_ns", "berlin"], built="date_format(ts, 'yyyy-MM-dd HH:mm:ss')")


@query(
    "prs14_convert",
    sql("SELECT event_id, CAST(id AS VARCHAR) AS i, CASE WHEN k % 10 = 0 THEN 'n/a' ELSE CAST(k AS VARCHAR) END AS j, CASE WHEN k % 2 = 0 THEN 'true' ELSE 'false' END AS b, CASE WHEN k % 10 = 0 THEN 'partial' ELSE 'ok' END AS parse_status FROM ev", "ev"),
)
def _(spark, sf):
    built = "concat('i= ', id, ';j=', CASE WHEN k % 10 = 0 THEN 'n/a' ELSE concat('00', k) END, ';b=', CASE WHEN k % 2 = 0 THEN 'T' ELSE '0' END)"
    steps = [{"op": "kv", "pair_sep": ";"}] + [{"op": "convert", "field": f, "type": t} for f, t in (("i", "int"), ("j", "int"), ("b", "bool"))]
    return _run(spark, sf, steps, ["i", "j", "b"], built=built)


_KV = "concat('act=', act, ' app=', app, ' ip=', src_ip, ' path=a/b/', k)"
_D = {"verbs": {"allow": "yes", "deny": "no"}}


@query(
    "prs15_lookup",
    sql("SELECT event_id, CASE act WHEN 'allow' THEN 'yes' WHEN 'deny' THEN 'no' ELSE 'other' END AS verdict, act, 'ok' AS parse_status FROM ev", "ev"),
)
def _(spark, sf):
    steps = [{"op": "kv"}, {"op": "lookup", "field": "act", "as": "verdict", "dictionary": "verbs", "default": "other"}]
    return _run(spark, sf, steps, ["verdict", "act"], built=_KV, dictionaries=_D)


@query(
    "prs16_rename_copy_drop",
    sql("SELECT event_id, act AS verb, CAST(NULL AS VARCHAR) AS act, app AS app2, app, CAST(NULL AS VARCHAR) AS ip, 'ok' AS parse_status FROM ev", "ev"),
)
def _(spark, sf):
    steps = [
        {"op": "kv"},
        {"op": "rename", "from": "act", "to": "verb"},
        {"op": "rename", "from": "absent", "to": "app"},
        {"op": "copy", "from": "app", "to": "app2"},
        {"op": "drop_field", "field": "ip"},
    ]
    return _run(spark, sf, steps, ["verb", "act", "app2", "app", "ip"], built=_KV)


@query(
    "prs19_gsub",
    sql("SELECT event_id, replace(src_ip, '.', '-') AS dashed, regexp_replace(src_ip, '^([0-9]+).([0-9]+)', '\\2_\\1x') AS swapped, '' AS made, 'ok' AS parse_status FROM ev", "ev"),
)
def _(spark, sf):
    steps = [
        {"op": "kv"},
        {"op": "gsub", "field": "ip", "as": "dashed", "match": r"\.", "replacement": "-"},
        {"op": "gsub", "field": "ip", "as": "swapped", "match": r"^(?P<a>\d+)\.(?P<b>\d+)", "replacement": "${b}_${a}x"},
        {"op": "gsub", "field": "nothing", "as": "made", "match": "x", "replacement": "y"},
    ]
    return _run(spark, sf, steps, ["dashed", "swapped", "made"], built=_KV)


@query(
    "prs20_split",
    sql("SELECT event_id, 'b' AS second, CAST(k AS VARCHAR) AS third, CAST(NULL AS VARCHAR) AS ninth, 'partial' AS parse_status FROM ev", "ev"),
)
def _(spark, sf):
    steps = [{"op": "kv"}] + [
        {"op": "split", "field": "path", "separator": "/", "index": i, "as": n} for i, n in ((1, "second"), (2, "third"), (9, "ninth"))
    ]
    return _run(spark, sf, steps, ["second", "third", "ninth"], built=_KV)


@query(
    "prs21_conditional",
    sql("SELECT event_id, CASE act WHEN 'deny' THEN 'deny' END AS blocked, CASE WHEN act <> 'deny' THEN app END AS passed, CAST(NULL AS VARCHAR) AS never, CASE WHEN act = 'deny' THEN 'partial' ELSE 'ok' END AS parse_status FROM ev", "ev"),
)
def _(spark, sf):
    steps = [
        {"op": "kv"},
        {
            "op": "conditional",
            "field": "act",
            "when": {"prefix": "deny"},
            "then": [
                {"op": "copy", "from": "act", "to": "blocked"},
                {"op": "convert", "field": "act", "type": "int"},  # fails, so the next step must not run
                {"op": "copy", "from": "app", "to": "never"},
            ],
            "else": [{"op": "copy", "from": "app", "to": "passed"}],
        },
    ]
    return _run(spark, sf, steps, ["blocked", "passed", "never"], built=_KV)


@query(
    "prs22_parse_status",
    sql("SELECT parser_id, parse_status, count(*) AS events, CAST(sum(CASE vix WHEN 0 THEN 27 WHEN 1 THEN 21 WHEN 2 THEN 17 WHEN 3 THEN 14 WHEN 4 THEN 17 ELSE 0 END) AS BIGINT) AS fields FROM norm GROUP BY 1, 2", "norm"),
)
def _(spark, sf):
    packs = inputs.packs()
    rows = parse(identify(inputs.raw_events(spark, sf), packs), packs)
    return rows.groupBy("parser_id", "parse_status").agg(F.count("*").alias("events"), F.sum(F.size("fields")).alias("fields"))


@query(
    "onb11_fixture_regression",
    sql("SELECT count(*) AS fixtures, count(*) - count(CASE WHEN id % 11 = 0 THEN 1 END) AS passed FROM ev", "ev"),
)
def _(spark, sf):
    # fixtures of all sources: five of them expect the line to fail; every 11th expects what is not so
    ev = inputs.values(spark, sf)
    own, wrong = F.col("vix") == 5, F.col("id") % 11 == 0
    load = F.when(wrong, F.lit("-1")).otherwise(F.concat(F.col("k").cast("string"), F.lit(".0")))
    fields = F.when(own, F.create_map(F.lit("node"), F.col("user_id").cast("string"), F.lit("load"), load)).otherwise(F.create_map().cast("map<string,string>"))
    status = F.when(own | wrong, F.lit("ok")).otherwise(F.lit("failed"))
    expected = ev.select(F.col("event_id").alias("fixture_id"), status.alias("status"), fields.alias("fields"))
    steps = [{"op": "dissect", "pattern": "node %{node} seq %{_} load %{load}"}]
    got = extract(_lines(spark, sf), steps).select(F.col("event_id").alias("fixture_id"), F.col("parse_status").alias("status"), "fields")
    return fixture_summary(expected, fixture_diff(expected, got))

"""Inputs of the registered queries: log lines and lookup tables derived from the given tables.

The derivation is plain string and integer arithmetic written once as SQL that Spark and
DuckDB both run, so a query and its check start from the same text.
"""

from __future__ import annotations

import tempfile
from collections.abc import Callable
from datetime import datetime, timezone
from functools import lru_cache

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from eventlake import ensure_session
from eventlake.operators.enrich import Dimensions
from eventlake.operators.lookup import last_wins
from eventlake.plans.process import Context, flat_columns, process, with_partitions
from eventlake.sources.packs import load_packs

NOW = datetime(2024, 1, 31, tzinfo=timezone.utc)
NOW_NS = int(NOW.timestamp()) * 1_000_000_000


class Dialect:
    """The few functions that are spelled differently."""

    def __init__(self, duck: bool):
        self.duck = duck

    def text(self, x: str) -> str:
        return f"CAST({x} AS {'VARCHAR' if self.duck else 'STRING'})"

    def div(self, a: str, b: int) -> str:
        return f"(({a}) // {b})" if self.duck else f"(({a}) div {b})"

    def fmt(self, ts: str, duck: str, spark: str) -> str:
        return f"strftime({ts}, '{duck}')" if self.duck else f"date_format({ts}, \"{spark}\")"

    def micros(self, ts: str) -> str:
        return f"epoch_us({ts})" if self.duck else f"unix_micros(CAST({ts} AS TIMESTAMP))"

    def json_int(self, col: str, key: str) -> str:
        get = f"json_extract_string({col}, '$.{key}')" if self.duck else f"get_json_object({col}, '$.{key}')"
        return f"CAST({get} AS BIGINT)"

    def lpad(self, x: str, n: int, ch: str = "0") -> str:
        return f"lpad({self.text(x)}, {n}, '{ch}')"


PARSERS = {
    0: ("paloalto.panos.traffic", "1.0.0", "paloalto", "panos", "firewall", 0.95),
    1: ("fortinet.fortigate.traffic", "1.0.0", "fortinet", "fortigate", "firewall", 0.95),
    2: ("cisco.asa.302013", "1.0.0", "cisco", "asa", "firewall", 0.95),
    3: ("acme.sensor.alert", "1.2.0", "acme", "sensor", "ids", 0.9),
    4: ("orion.guard.cef", "2.1.0", "orion", "guard", "proxy", 0.8),
}


def values_sql(duck: bool, table: str = "events") -> str:
    """One row per event with every value the lines are made of."""
    d = Dialect(duck)
    return f"""
SELECT v.*,
  {d.div('us', 1000000)} AS sec,
  ({d.div('us', 1000000)}) * 1000000000 AS sec_ns,
  us * 1000 + 2000000000 AS received_at,
  concat('ev-', {d.lpad('id', 10)}) AS event_id,
  concat('lsn-', {d.text('user_id % 4')}) AS listener_id,
  concat('192.168.', {d.text('user_id % 8')}, '.', {d.text('user_id % 250')}) AS peer,
  concat({d.text("CASE WHEN id % 101 = 0 THEN 300 ELSE 20 + user_id % 200 END")}, '.', {d.text('id % 255')}, '.',
         {d.text('k % 255')}, '.', {d.text('1 + user_id % 254')}) AS src_ip,
  CASE WHEN id % 7 = 0 THEN concat('203.0.113.', {d.text('k % 255')})
       ELSE concat('10.0.', {d.text('user_id % 255')}, '.', {d.text('id % 255')}) END AS dst_ip,
  1024 + id % 60000 AS sport,
  CASE WHEN id % 97 = 0 THEN 70000 WHEN id % 5 < 2 THEN 443 WHEN id % 5 = 2 THEN 80 WHEN id % 5 = 3 THEN 22 ELSE 53 END AS dport,
  CASE WHEN id % 5 = 4 THEN 'udp' ELSE 'tcp' END AS proto,
  CASE WHEN id % 5 < 2 THEN 'https' WHEN id % 5 = 2 THEN 'http' WHEN id % 5 = 3 THEN 'ssh' ELSE 'dns' END AS app,
  CASE event_type WHEN 'purchase' THEN 'accept' WHEN 'signup' THEN 'drop' WHEN 'error' THEN 'deny' ELSE 'allow' END AS act,
  100 + (id * 37) % 50000 AS sent,
  100 + (id * 91) % 50000 AS rcvd,
  concat('Customer#', {d.lpad('user_id', 9)}) AS username,
  CAST(k % 50 AS DOUBLE) / 10 AS processing_ms
FROM (
  SELECT event_id AS id, ts, user_id, event_type, {d.json_int('props', 'k')} AS k, event_id % 6 AS vix, {d.micros('ts')} AS us
  FROM {table}
) v"""


def line_sql(duck: bool) -> str:
    """The raw line of a row of values_sql."""
    d = Dialect(duck)
    t = d.text

    def cat(*parts: str) -> str:
        return "concat(" + ", ".join(parts) + ")"

    unit = t("user_id % 3")
    day = d.lpad(d.fmt("ts", "%-d", "d"), 2, " ")
    hms = d.fmt("ts", "%H:%M:%S", "HH:mm:ss")
    panos = cat(
        "'<14>'", d.fmt("ts", "%b", "MMM"), "' '", day, "' '", hms, "' pa-edge-0'", unit, "' 1,'",
        d.fmt("ts", "%Y/%m/%d %H:%M:%S", "yyyy/MM/dd HH:mm:ss"), "',0016'", d.lpad("user_id", 8), "',TRAFFIC,end,'",
        "src_ip", "','", "dst_ip", "',rule-'", t("k % 10"), "','", "app", "',untrust,trust,'", t("1000 + id % 50000"),
        "','", t("sport"), "','", t("dport"), "','", "proto", "','", "act", "','", t("sent"), "','", t("rcvd"), "','",
        t("10 + k % 40"), "','", t("k"), "',pa-edge-0'", unit,
    )
    fortigate = cat(
        "'<189>date='", d.fmt("ts", "%Y-%m-%d", "yyyy-MM-dd"), "' time='", hms, "' devname=\"fg branch '", unit,
        "'\" type=\"traffic\" eventtime='", t("sec"), "' srcip='", "src_ip", "' srcport='", t("sport"),
        "' srcintf=\"wan1\" dstip='", "dst_ip", "' dstport='", t("dport"), "' dstintf=\"lan\" action=\"'", "act",
        "'\" policyid='", t("k"), "' proto='", "CASE proto WHEN 'udp' THEN '17' ELSE '6' END", "' service=\"'", "upper(app)",
        "'\" user=\"'", "username", "'\" sentbyte='", t("sent"), "' rcvdbyte='", t("rcvd"), "' duration='", t("k"),
    )
    asa = cat(
        "'<166>'", d.fmt("ts", "%b %d %Y %H:%M:%S", "MMM dd yyyy HH:mm:ss"), "' asa-fw-0'", unit,
        "' : %ASA-6-302013: Built '", "CASE k % 2 WHEN 0 THEN 'inbound' ELSE 'outbound' END", "' TCP connection '",
        t("id"), "' for outside:'", "src_ip", "'/'", t("sport"), "' ('", "src_ip", "'/'", t("sport"),
        "') to inside:'", "dst_ip", "'/'", t("dport"), "' ('", "dst_ip", "'/'", t("dport"), "')'",
    )
    sensor = cat(
        "'{\"time\":\"'", d.fmt("ts", "%Y-%m-%dT%H:%M:%S", "yyyy-MM-dd'T'HH:mm:ss"), "'\",\"sensor\":\"ids-'", unit,
        "'\",\"src\":\"'", "src_ip", "'\",\"spt\":'", t("sport"), "',\"dst\":\"'", "dst_ip", "'\",\"dpt\":'", t("dport"),
        "',\"proto\":\"'", "proto", "'\",\"act\":\"'", "act", "'\",\"sev\":\"'", t("k % 8"), "'\",\"sid\":\"'",
        "CASE WHEN k % 3 = 0 THEN '-' ELSE " + cat("'22100'", d.lpad("k % 30", 2)) + " END", "'\",\"class\":\"'",
        "CASE k % 4 WHEN 0 THEN 'scan' WHEN 1 THEN 'malware' WHEN 2 THEN 'beacon' ELSE '-' END",
        "'\",\"out\":'", t("sent"), "',\"in\":'", t("rcvd"), "',\"meta\":{\"rev\":'", t("k"), "',\"tags\":[\"a\",\"b\"]},\"note\":null}'",
    )
    guard = cat(
        "'CEF:0|Orion|Guard|2.1|'", t("100 + k"), "'|conn\\|'" if duck else "'|conn\\\\|'", "act", "'|'", t("k % 8"), "'|src='", "src_ip",
        "' spt='", t("sport"), "' dst='", "dst_ip", "' dpt='", t("dport"), "' proto='", "upper(proto)", "' act='", "act",
        "' out='", t("sent"), "' in='", t("rcvd"), "' rt='", t("sec * 1000"), "' suser='", "username",
    )
    other = cat("'heartbeat node '", t("user_id"), "' seq '", t("id"), "' load '", t("k"))
    return (
        f"CASE vix WHEN 0 THEN {panos} WHEN 1 THEN {fortigate} WHEN 2 THEN {asa} WHEN 3 THEN {sensor} "
        f"WHEN 4 THEN {guard} ELSE {other} END"
    )


def path(sf_dir: str, table: str) -> str:
    return f"{sf_dir.rstrip('/')}/{table}.parquet"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    ensure_session(spark)
    return spark.read.parquet(path(sf_dir, name))


def spread(df: DataFrame) -> DataFrame:
    """Deal the narrow events anew before lines are rendered from them: the given tables are single small files.

    The number is stated, as the adaptive planner would else merge these few bytes into two or three parts, and all that is
    made of them, parsing included, would use as many cores.
    """
    return df.repartition(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), "event_id")


def values(spark: SparkSession, sf_dir: str) -> DataFrame:
    """values_sql over the events table."""
    ensure_session(spark)
    return spark.sql(values_sql(False, "{events}"), events=spread(table(spark, sf_dir, "events")))


def raw_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Log lines with their envelope."""
    keep = ["event_id", "listener_id", "peer", "received_at", "processing_ms"]
    return values(spark, sf_dir).select(*keep, F.expr(line_sql(False)).alias("raw"))


# --- lookup tables -----------------------------------------------------------------


def dimension_sql(duck: bool) -> dict[str, str]:
    """Lookup tables as SQL over nation, customer and events; `ord` is the row position."""
    d = Dialect(duck)
    t = d.text
    key = "CAST(n_nationkey AS BIGINT)"
    octets = " UNION ALL ".join(f"SELECT {j} AS j" for j in range(8))
    geo = f"""
SELECT concat({t(f'20 + {key} + 25 * j')}, '.0.0.0/8') AS cidr, n_name AS country, concat(n_name, '-', {t('j')}) AS city,
       1000 + 10 * {key} + j AS ord FROM {{nation}} CROSS JOIN ({octets}) o
UNION ALL
SELECT concat({t(f'20 + {key}')}, '.', {t(f'{key} * 3')}, '.0.0/16'), 'Override', concat('city ', {t(key)}),
       CASE WHEN {key} % 2 = 0 THEN {key} ELSE 5000 + {key} END FROM {{nation}}
UNION ALL
SELECT concat('203.0.113.', {t(f'{key} * 4')}, '/30'), 'Test', concat('block ', {t(key)}), 6000 + {key} FROM {{nation}}
UNION ALL
SELECT concat('10.0.', {t(f'{key} * 2')}, '.0/23'), 'Office', concat('site ', {t(key)}), 7000 + {key} FROM {{nation}}"""
    asn = f"""
SELECT concat({t(f'20 + {key} + 25 * j')}, '.0.0.0/8') AS cidr, 64500 + {key} AS asn, concat('AS of ', n_name) AS as_org,
       {key} * 8 + j AS ord FROM {{nation}} CROSS JOIN ({octets}) o"""
    assets = f"""
SELECT concat('10.0.', {t('c_custkey % 255')}, '.', {t('c_custkey % 251')}) AS ip, concat('asset-', {t('c_custkey')}) AS asset_id,
       c_name AS owner, CASE c_mktsegment WHEN 'BUILDING' THEN 'critical' WHEN 'MACHINERY' THEN 'high' ELSE 'low' END AS criticality,
       CASE WHEN c_custkey % 2 = 0 THEN 'prod' ELSE 'test' END AS environment, c_custkey AS ord FROM {{customer}}"""
    identities = f"""
SELECT c_name AS username, c_mktsegment AS department, concat('manager', {t('c_nationkey')}) AS manager,
       concat('E', {t('10000 + c_custkey')}) AS employee_id, c_custkey AS ord FROM {{customer}} WHERE c_custkey % 3 > 0"""
    category = "CASE id % 5 WHEN 0 THEN 'botnet' WHEN 1 THEN 'c2' WHEN 2 THEN 'phishing' WHEN 3 THEN 'malware' ELSE 'scanner' END"
    iocs = f"""
SELECT src_ip AS indicator, 'ip' AS type, {category} AS category, 40 + id % 60 AS confidence, id AS ord
FROM ({values_sql(duck, '{events}')}) a WHERE id % 50 = 0
UNION ALL
SELECT dst_ip, 'ip', {category}, 40 + id % 60, id FROM ({values_sql(duck, '{events}')}) b WHERE id % 77 = 0 AND id % 50 > 0"""
    mitre = f"""
SELECT concat('22100', {d.lpad(key, 2)}) AS signature_id, concat('TA00', {d.lpad(f'{key} % 12 + 1', 2)}) AS tactic,
       concat('T1', {d.lpad(f'{key} * 7', 3)}) AS technique_id, concat('technique ', n_name) AS technique_name, {key} AS ord FROM {{nation}}"""
    return {"geo": geo, "asn": asn, "assets": assets, "identities": identities, "iocs": iocs, "mitre": mitre}


def dimension(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    ensure_session(spark)
    sql = dimension_sql(False)[name]
    names = [n for n in ("nation", "customer", "events") if "{" + n + "}" in sql]
    return spark.sql(sql, **{n: table(spark, sf_dir, n) for n in names})


_DIMS: dict[tuple[str, str], Dimensions] = {}


def dimensions(spark: SparkSession, sf_dir: str) -> Dimensions:
    """Built once per application: building checks sizes, which runs small jobs."""
    key = (spark.sparkContext.applicationId, sf_dir)
    if key not in _DIMS:
        _DIMS[key] = Dimensions.build(**{n: loaded(spark, sf_dir, n) for n in ("geo", "asn", "assets", "identities", "iocs", "mitre")})
    return _DIMS[key]


# lookup tables made from tables that grow, and their keys
KEYS = {"assets": "ip", "identities": "username", "iocs": "indicator"}


def loaded(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A lookup table as it is loaded. One that is made from a table that grows is stored with one row per key.

    Its size is then that of its own rows. The optimizer's estimate over the derivation is that of the tables behind it: it
    made lookups of a few MB join by a shuffle of the whole event rows, and derived the table anew for each of them.
    """
    df = dimension(spark, sf_dir, name)
    if name not in KEYS:
        return df
    rows = stored(spark, sf_dir, f"dimension_{name}", lambda: last_wins(df, [KEYS[name]]))
    return rows.withColumn("ord", F.lit(0))


@lru_cache(maxsize=1)
def packs():
    return load_packs()


def context(spark: SparkSession, sf_dir: str) -> Context:
    return Context(packs=packs(), dims=dimensions(spark, sf_dir), now=NOW, node_id="node-1")


_STORED: dict[tuple[str, str, str], str] = {}


def _shared_root(spark: SparkSession) -> str:
    """The shared folder of the session; its own default only where the session names none and there is no cluster."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root and not spark.sparkContext.master.startswith("local"):
        raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
    return f"{(root or tempfile.gettempdir()).rstrip('/')}/eventlake-{spark.sparkContext.applicationId}"


def stored(spark: SparkSession, sf_dir: str, name: str, build: Callable[[], DataFrame]) -> DataFrame:
    """A derived table written once per application to the shared folder and read back, as a lake is."""
    ensure_session(spark)
    key = (spark.sparkContext.applicationId, sf_dir, name)
    if key not in _STORED:
        root = _shared_root(spark)
        df = build()
        target = f"{root}/{sf_dir.strip('/').replace('/', '_')}/{name}"
        writer = df.hint("rebalance", F.col("dt")).sortWithinPartitions("dt") if "dt" in df.columns else df
        out = writer.write.mode("overwrite")
        (out.partitionBy("dt") if "dt" in df.columns else out).parquet(target)
        _STORED[key] = target
    df = spark.read.parquet(_STORED[key])
    return df.withColumn("dt", F.date_format("dt", "yyyy-MM-dd")) if dict(df.dtypes).get("dt") == "date" else df


def event_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every line of the events table, processed to the end, with its partition columns."""
    build = lambda: with_partitions(process(raw_events(spark, sf_dir), context(spark, sf_dir)))
    return stored(spark, sf_dir, "event_rows", build)


def columns_of(spark: SparkSession, sf_dir: str, *columns: str) -> DataFrame:
    """The same columns of every line as `event_rows` has; where a query reads few of them once, no table of all is written."""
    return process(raw_events(spark, sf_dir), context(spark, sf_dir), columns=list(columns))


def lake(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The event table: flat columns and partition columns."""
    rows = event_rows(spark, sf_dir)
    return rows.select(*flat_columns(rows), "dt", "hour", "vendor")

"""Expected values in DuckDB SQL, computed from the base columns and not by parsing the lines."""

from __future__ import annotations

from suite.inputs import NOW_NS, PARSERS, dimension_sql, line_sql, values_sql


def _case(index: int, unknown: str = "NULL") -> str:
    arms = " ".join(f"WHEN {v} THEN '{p[index]}'" for v, p in PARSERS.items())
    return f"CASE vix {arms} ELSE {unknown} END"


# severity of the event scale for a syslog severity s
def _sev(s: str) -> str:
    return f"CASE {s} WHEN 0 THEN 6 WHEN 1 THEN 6 WHEN 2 THEN 5 WHEN 3 THEN 4 WHEN 4 THEN 3 WHEN 5 THEN 2 WHEN 6 THEN 1 ELSE 0 END"


EV = values_sql(True)
LN = f"SELECT *, {line_sql(True)} AS raw FROM ev"

NORM = f"""
SELECT ev.*,
  vix < 5 AS known,
  {_case(0, "'source.unknown'")} AS parser_id,
  {_case(1)} AS parser_version,
  {_case(2)} AS observer_vendor, {_case(3)} AS observer_product, {_case(4, "'unknown'")} AS observer_type,
  CASE WHEN vix = 2 THEN 'allowed' WHEN vix < 5 THEN CASE act WHEN 'deny' THEN 'blocked' WHEN 'drop' THEN 'dropped' ELSE 'allowed' END END AS event_action,
  CASE WHEN vix = 2 THEN 'success' WHEN vix < 5 THEN CASE WHEN act IN ('deny', 'drop') THEN 'failure' ELSE 'success' END END AS event_outcome,
  CASE WHEN vix IN (0, 2) THEN 1 WHEN vix IN (3, 4) THEN {_sev('k % 8')} END AS event_severity_id,
  CASE WHEN vix < 5 THEN sec_ns ELSE received_at END AS event_observed_at,
  received_at AS event_ingested_at,
  CASE WHEN vix < 5 THEN (received_at - sec_ns) // 1000000 END AS event_time_skew_ms,
  CASE WHEN vix < 5 THEN src_ip END AS n_src_ip, CASE WHEN vix < 5 THEN dst_ip END AS n_dst_ip,
  CASE WHEN vix < 5 THEN sport END AS src_port, CASE WHEN vix < 5 THEN dport END AS dst_port,
  CASE WHEN vix = 1 THEN username END AS src_user, CASE WHEN vix = 4 THEN username END AS n_actor,
  CASE WHEN vix = 2 THEN 'tcp' WHEN vix < 5 THEN proto END AS network_transport,
  CASE WHEN vix = 2 THEN CASE k % 2 WHEN 0 THEN 'inbound' ELSE 'outbound' END END AS network_direction,
  CASE WHEN vix IN (0, 1, 3, 4) THEN rcvd END AS network_bytes_in,
  CASE WHEN vix IN (0, 1, 3, 4) THEN sent END AS network_bytes_out,
  CASE WHEN vix IN (0, 1, 3, 4) THEN rcvd + sent END AS network_bytes_total,
  CASE WHEN vix = 3 AND k % 3 > 0 THEN '22100' || lpad(CAST(k % 30 AS VARCHAR), 2, '0') END AS threat_signature_id,
  CASE WHEN vix = 3 THEN CASE k % 4 WHEN 0 THEN 'reconnaissance' WHEN 1 THEN 'malware' WHEN 2 THEN 'unknown' END END AS n_category,
  CASE WHEN vix < 5 THEN 'ok' ELSE 'failed' END AS parse_status,
  CASE vix WHEN 0 THEN 23 WHEN 1 THEN 22 WHEN 2 THEN 20 WHEN 4 THEN 20
           WHEN 3 THEN 21 - CASE WHEN k % 3 = 0 THEN 1 ELSE 0 END - CASE WHEN k % 4 = 3 THEN 1 ELSE 0 END ELSE 0 END AS mapped,
  CASE vix WHEN 0 THEN 23 WHEN 1 THEN 22 WHEN 2 THEN 20 WHEN 4 THEN 20 WHEN 3 THEN 21 ELSE 0 END AS expected,
  CASE vix WHEN 0 THEN 0.95 WHEN 1 THEN 0.95 WHEN 2 THEN 0.95 WHEN 3 THEN 0.9 WHEN 4 THEN 0.8 ELSE 0 END AS confidence,
  CASE vix WHEN 0 THEN 12 WHEN 1 THEN 7 WHEN 2 THEN 6 WHEN 3 THEN 1 WHEN 4 THEN 5 ELSE 0 END AS unmapped_count,
  strftime(make_timestamp(CASE WHEN vix < 5 THEN sec * 1000000 ELSE received_at // 1000 END), '%Y-%m-%d') AS dt,
  strftime(make_timestamp(CASE WHEN vix < 5 THEN sec * 1000000 ELSE received_at // 1000 END), '%H') AS hour
FROM ln ev"""


def _num(ip: str) -> str:
    p = [f"CAST(split_part({ip}, '.', {i}) AS BIGINT)" for i in (1, 2, 3, 4)]
    return f"({p[0]} * 16777216 + {p[1]} * 65536 + {p[2]} * 256 + {p[3]})"


def _nets(name: str, cols: str) -> str:
    inner = dimension_sql(True)[name].format(nation="nation", customer="customer", events="events")
    return (
        f"SELECT {cols}, ord, lo - lo % span AS lo, lo - lo % span + span - 1 AS hi FROM (SELECT *, "
        f"{_num('split_part(cidr, chr(47), 1)')} AS lo, CAST(pow(2, 32 - CAST(split_part(cidr, '/', 2) AS INTEGER)) AS BIGINT) AS span FROM ({inner}))"
    )


def _hit(table: str, ip: str, cols: list[str], prefix: str) -> str:
    picks = ", ".join(f"arg_min({c}, ord) AS {prefix}_{c}" for c in cols)
    return f"SELECT event_id, {picks} FROM ips JOIN {table} ON {ip} BETWEEN lo AND hi GROUP BY event_id"


def _last(name: str, key: str) -> str:
    inner = dimension_sql(True)[name].format(nation="nation", customer="customer", events="events")
    return f"SELECT * FROM ({inner}) QUALIFY row_number() OVER (PARTITION BY {key} ORDER BY ord DESC) = 1"


_VALID_SRC = "id % 101 > 0"
_ENR_PARTS = {
    "ips": f"SELECT event_id, CASE WHEN {_VALID_SRC} THEN {_num('n_src_ip')} END AS s, {_num('n_dst_ip')} AS d FROM norm WHERE known",
    "geo": _nets("geo", "country, city"),
    "asn": _nets("asn", "asn, as_org"),
    "gs": _hit("geo", "s", ["country", "city"], "s"),
    "gd": _hit("geo", "d", ["country", "city"], "d"),
    "as_": _hit("asn", "s", ["asn", "as_org"], "s"),
    "ad": _hit("asn", "d", ["asn", "as_org"], "d"),
    "assets": _last("assets", "ip"),
    "identities": _last("identities", "username"),
    "iocs": _last("iocs", "indicator"),
    "mitre": _last("mitre", "signature_id"),
}
ENR = f"""
SELECT *, least(100.0, CASE WHEN ioc_match THEN 40.0 ELSE 0 END + CASE WHEN NOT src_internal THEN 15.0 ELSE 0 END
  + CASE WHEN event_action IN ('blocked', 'dropped') THEN 10.0 ELSE 0 END
  + CASE WHEN event_severity_id >= 5 THEN event_severity_id * 3.0 ELSE 0 END
  + CASE WHEN critical THEN 15.0 ELSE 0 END) AS risk
FROM (
SELECT n.*, gs.s_country, gs.s_city, gd.d_country, gd.d_city, as_.s_asn, as_.s_as_org, ad.d_asn, ad.d_as_org,
  CASE WHEN known AND {_VALID_SRC} THEN (s BETWEEN 167772160 AND 184549375 OR s BETWEEN 2886729728 AND 2887778303
    OR s BETWEEN 3232235520 AND 3232301055 OR s BETWEEN 2130706432 AND 2147483647) END AS src_internal,
  CASE WHEN known THEN n_dst_ip LIKE '10.%' END AS dst_internal,
  coalesce(a.criticality = 'critical', false) AS critical,
  coalesce(n_actor, u.username) AS actor_user,
  i1.indicator IS NOT NULL OR i2.indicator IS NOT NULL AS ioc_match,
  coalesce(i1.indicator, i2.indicator) AS ioc_indicator,
  coalesce(i1.category, i2.category, n_category) AS threat_category,
  m.tactic, m.technique_id,
  CASE WHEN expected = 0 THEN 0.0 ELSE least(1.0, CAST(mapped AS DOUBLE) / expected) * CAST(n.confidence AS DOUBLE) END AS quality
FROM norm n LEFT JOIN ips USING (event_id) LEFT JOIN gs USING (event_id) LEFT JOIN gd USING (event_id)
LEFT JOIN as_ USING (event_id) LEFT JOIN ad USING (event_id)
LEFT JOIN assets a ON a.ip = n.n_dst_ip
LEFT JOIN identities u ON u.username = coalesce(n.n_actor, n.src_user)
LEFT JOIN iocs i1 ON i1.indicator = n.n_src_ip LEFT JOIN iocs i2 ON i2.indicator = n.n_dst_ip
LEFT JOIN mitre m ON m.signature_id = n.threat_signature_id) x"""

VAL = f"""
SELECT *,
  CASE WHEN NOT known THEN ['unknown_source'] ELSE
    CASE WHEN dst_port > 65535 THEN ['schema_violation', 'bad_port'] ELSE CAST([] AS VARCHAR[]) END
    || CASE WHEN id % 101 = 0 THEN ['bad_ip'] ELSE CAST([] AS VARCHAR[]) END
    || CASE WHEN abs({NOW_NS} - event_observed_at) > 31536000000000000 THEN ['timestamp_out_of_range'] ELSE CAST([] AS VARCHAR[]) END
  END AS reasons,
  CASE WHEN ioc_match OR coalesce(trim(threat_category), '') <> '' THEN 'threat' WHEN risk >= 40 THEN 'elevated' ELSE 'normal' END AS state
FROM enr"""

_CHAIN = {"ev": EV, "ln": LN, "norm": NORM, **_ENR_PARTS, "enr": ENR, "val": VAL}


def sql(body: str, upto: str = "val", extra: dict[str, str] | None = None) -> str:
    """Query text with the shared expressions up to `upto` in front."""
    ctes = []
    for name, text in _CHAIN.items():
        ctes.append(f"{name} AS MATERIALIZED ({text})")
        if name == upto:
            break
    for name, text in (extra or {}).items():
        ctes.append(f"{name} AS ({text})")
    return "WITH RECURSIVE " + ",\n".join(ctes) + "\n" + body

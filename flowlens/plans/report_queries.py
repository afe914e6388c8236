"""Registered queries: traffic reports, search, alert lists."""

from __future__ import annotations

from pyspark.sql import functions as F

from .. import adapters as A
from ..functions import verdicts
from ..functions.values import iso_text
from ..operators import alerts as al
from ..operators import reports as R
from ..operators import search as S
from .oracle_views import AS_OF, iso, with_views
from .registry import as_of, query

W = with_views


def _talkers(view: str, key: str) -> str:
    return W(view) + f"""SELECT {key} AS ip, CAST(sum(total_bytes) AS BIGINT) AS bytes, count(*) AS flows
FROM {view} GROUP BY 1 ORDER BY bytes DESC, ip LIMIT 5"""


@query("top_talkers_src", _talkers("shipments", "src_ip"))
def top_talkers_src(spark, sf):
    return R.top_by_bytes(A.shipment_logs(spark, sf), "src_ip")


@query("top_talkers_dest", _talkers("logs", "dest_ip"))
def top_talkers_dest(spark, sf):
    return R.top_by_bytes(A.logs(spark, sf), "dest_ip")


def _frequent(view: str, key: str) -> str:
    return W(view) + f"SELECT {key}, count(*) AS flows FROM {view} GROUP BY 1 ORDER BY flows DESC, {key} LIMIT 5"


@query("top_ports_dest", _frequent("shipments", "dest_port"))
def top_ports_dest(spark, sf):
    return R.top_by_flows(A.shipment_logs(spark, sf), "dest_port")


@query("top_ports_src", _frequent("logs", "src_port"))
def top_ports_src(spark, sf):
    return R.top_by_flows(A.logs(spark, sf), "src_port")


@query("top_destinations", _frequent("logs", "dest_ip"))
def top_destinations(spark, sf):
    return R.top_by_flows(A.logs(spark, sf), "dest_ip")


@query(
    "protocol_stats",
    W("logs") + """SELECT protocol, CAST(sum(n) AS BIGINT) AS flows FROM (
  SELECT protocol, 1 AS n FROM logs
  UNION ALL SELECT unnest(['TCP', 'UDP', 'ICMP', 'DNS', 'HTTP', 'HTTPS']), 0) GROUP BY 1""",
)
def protocol_stats(spark, sf):
    return R.protocol_counts(A.logs(spark, sf))


@query(
    "daily_summary",
    W("logs") + f"""SELECT strftime(timestamp, '%Y-%m-%d') AS date, count(*) AS flows,
  CAST(sum(total_bytes) AS BIGINT) AS bytes,
  count(*) FILTER (prediction_label IN ('Malicious', 'Suspicious')) AS alerts
FROM logs WHERE timestamp >= {AS_OF} - INTERVAL 7 DAY GROUP BY 1""",
)
def daily_summary(spark, sf):
    return R.daily_summary(A.logs(spark, sf), as_of())


@query(
    "history_bins",
    W("logs", extra=f"""bins AS (SELECT CAST(b AS INTEGER) AS bin, {AS_OF} - INTERVAL 60 MINUTE + to_minutes(5 * b) AS start
  FROM range(12) t(b))""")
    + """SELECT bin, strftime(any_value(start), '%H:%M') AS time, CAST(coalesce(sum(total_bytes), 0) AS BIGINT) AS bytes,
  count(id) AS flows, count(id) FILTER (prediction_label IN ('Malicious', 'Suspicious')) AS alerts
FROM bins LEFT JOIN logs ON timestamp >= start AND timestamp < start + INTERVAL 5 MINUTE GROUP BY bin""",
)
def history_bins(spark, sf):
    return R.history_bins(A.logs(spark, sf), as_of())


@query(
    "active_hosts",
    W("logs", extra=f"r AS (SELECT * FROM logs WHERE timestamp >= {AS_OF} - INTERVAL 24 HOUR)")
    + """SELECT count(*) AS active_hosts FROM (SELECT src_ip FROM r UNION SELECT dest_ip FROM r)""",
)
def active_hosts(spark, sf):
    return R.active_hosts(A.logs(spark, sf), as_of())


@query("hosts_union", W("logs") + "SELECT src_ip AS ip FROM logs UNION SELECT dest_ip FROM logs")
def hosts_union(spark, sf):
    return R.hosts(A.logs(spark, sf))


@query(
    "hosts_union_shipments",
    W("shipments") + "SELECT src_ip AS ip FROM shipments UNION SELECT dest_ip FROM shipments",
)
def hosts_union_shipments(spark, sf):
    return R.hosts(A.shipment_logs(spark, sf))


@query(
    "system_counts",
    W("logs", "alerts") + """SELECT (SELECT count(*) FROM logs) AS logs,
  (SELECT count(*) FROM alerts WHERE NOT is_resolved) AS open_alerts""",
)
def system_counts(spark, sf):
    return R.system_counts(A.logs(spark, sf), A.alerts(spark, sf))


_LEVELS = """lv AS (SELECT
  CAST(coalesce(sum(n) FILTER (threat_level = 'Critical'), 0) AS BIGINT) AS critical,
  CAST(coalesce(sum(n) FILTER (threat_level = 'High'), 0) AS BIGINT) AS high,
  CAST(coalesce(sum(n) FILTER (threat_level = 'Medium'), 0) AS BIGINT) AS medium,
  CAST(coalesce(sum(n) FILTER (threat_level = 'Low'), 0) AS BIGINT) AS low
  FROM (SELECT *, {weight} AS n FROM alerts WHERE NOT is_resolved))"""
_SCORED = """, sc AS (SELECT *, least({cap}, 25 * critical + 15 * high + 5 * medium + 2 * low) AS threat_score FROM lv)"""


@query(
    "threat_score",
    W("alerts", extra=_LEVELS.format(weight="coalesce(count, 1)") + _SCORED.format(cap=95))
    + """SELECT *, greatest(5, 100 - threat_score) AS health_score,
  CASE WHEN greatest(5, 100 - threat_score) < 50 THEN 'Critical' WHEN greatest(5, 100 - threat_score) < 85 THEN 'Warning'
       ELSE 'Optimal' END AS health_status FROM sc""",
)
def threat_score(spark, sf):
    return R.threat_score(A.alerts(spark, sf))


_DEVICE_SCORE = """SELECT device_id, least(95, sum(CASE threat_level WHEN 'Critical' THEN 25 WHEN 'High' THEN 15
  WHEN 'Medium' THEN 5 ELSE 2 END)) AS s FROM alerts GROUP BY 1"""


@query(
    "report_score",
    W("alerts", extra=_LEVELS.format(weight="1") + _SCORED.format(cap=100))
    + """SELECT (SELECT count(*) FROM alerts WHERE NOT is_resolved) AS active,
  (SELECT count(*) FROM alerts WHERE is_resolved) AS resolved, sc.*,
  CASE WHEN threat_score > 70 THEN 'IMMEDIATELY deploy firewall blocking rules against active malicious source IPs to secure network boundaries.; Throttle connection rates on affected interfaces and flag destination IPs for potential containment.'
       WHEN threat_score > 30 THEN 'Flag suspicious devices for active monitoring. Inspect L7 DNS/HTTP query histories for anomalies.; Conduct signature-level inspections on active protocols showing abnormal flow ratios.'
       ELSE 'Continue running default passive monitoring sniffing threads.; Periodically backup SQL flow records and capture local PCAPs to maintain streaming accuracy indicators.' END AS advice
FROM sc""",
)
def report_score(spark, sf):
    out = R.report_score(A.alerts(spark, sf))
    return out.withColumn("advice", F.concat_ws("; ", "advice"))


@query(
    "health_factors",
    W("alerts", "logs", extra=_LEVELS.format(weight="coalesce(count, 1)") + _SCORED.format(cap=95) + f""",
  h AS (SELECT count(DISTINCT x) AS n FROM (SELECT unnest([src_ip, dest_ip]) AS x FROM logs
        WHERE timestamp >= {AS_OF} - INTERVAL 24 HOUR))""")
    + """SELECT 1 AS place,
  CASE WHEN threat_score > 0 THEN 'Active threat signals detected (' || critical || ' Critical, ' || high || ' High, ' || medium || ' Medium)'
       ELSE 'Zero active high-severity threats detected' END AS factor,
  CASE WHEN threat_score > 0 THEN 'negative' ELSE 'positive' END AS impact, CAST(-threat_score AS BIGINT) AS points,
  CASE WHEN threat_score > 0 THEN 'Unresolved security alerts require triage and remediation.'
       ELSE 'No unresolved malicious or suspicious flows in perimeter.' END AS detail FROM sc
UNION ALL SELECT 2, 'Active hosts observed: ' || n || ' host(s) communicating', 'positive', 0,
  'Perimeter devices transmitting telemetry normally.' FROM h
UNION ALL SELECT 3, 'Streaming flow engine: 0 packets processed across 0 live flows', 'neutral', 0,
  'Passive flow extraction windowing operational.'
UNION ALL SELECT 4, 'Adaptive ML Classifier: ADWIN calibrated & drift-monitored', 'positive', 0,
  'Hoeffding adaptive tree weights dynamically track concept drift.'""",
)
def health_factors(spark, sf):
    return R.health_factors(A.alerts(spark, sf), A.logs(spark, sf), as_of())


_FOUND = """f AS (SELECT * FROM logs WHERE timestamp >= TIMESTAMP '2024-01-05 00:00:00'
  AND timestamp <= TIMESTAMP '2024-01-25 12:00:00' AND protocol ILIKE '%http%' AND total_bytes >= 500
  AND (src_ip LIKE '%.1%' OR dest_ip LIKE '%.1%'))"""


def _found(spark, sf):
    return S.search(
        A.logs(spark, sf),
        start_time="2024-01-05T00:00:00Z",
        end_time="2024-01-25T12:00:00",
        protocol="http",
        prediction_label="all",
        search_ip=".1",
        min_bytes=500,
    )


@query(
    "research_summary",
    W("logs", extra=_FOUND) + """SELECT count(*) AS matching_flows, CAST(coalesce(sum(total_bytes), 0) AS BIGINT) AS total_bytes,
  CAST(printf('%.2f', CAST(sum(duration) AS DOUBLE) / count(*)) AS DOUBLE) AS avg_duration_sec,
  CAST(printf('%.1f', CAST(sum(total_bytes) AS DOUBLE) / count(*)) AS DOUBLE) AS avg_bytes_per_flow,
  CAST(printf('%.1f', CAST(count(*) FILTER (prediction_label IN ('Malicious', 'Suspicious')) AS DOUBLE) / count(*) * 100) AS DOUBLE)
    AS malicious_share_pct FROM f""",
)
def research_summary(spark, sf):
    return S.search_summary(_found(spark, sf))


_SHAPED = f"""SELECT id, {iso("timestamp")} AS timestamp, src_ip, dest_ip, src_port, dest_port, protocol, duration,
  total_bytes AS bytes, prediction_label AS label, confidence_score AS confidence, coalesce(info, '') AS info,
  connection_state AS state, source, import_batch_id"""


@query(
    "research_page",
    W("logs", extra=_FOUND) + _SHAPED + " FROM f ORDER BY timestamp DESC, id DESC LIMIT 100 OFFSET 20",
)
def research_page(spark, sf):
    return S.shape_records(S.page(_found(spark, sf), 100, 20))


@query(
    "log_search",
    W("logs") + _SHAPED + " FROM logs WHERE src_ip LIKE '%1.5%' OR dest_ip LIKE '%1.5%' ORDER BY timestamp DESC, id DESC LIMIT 50",
)
def log_search(spark, sf):
    return S.shape_records(S.log_search(A.logs(spark, sf), "1.5"))


@query(
    "log_filter",
    W("logs") + _SHAPED + """ FROM logs WHERE (src_ip LIKE '%168.1.7%' OR dest_ip LIKE '%168.1.7%')
  AND source = 'live' AND protocol = 'UDP' AND prediction_label = 'Malicious'""",
)
def log_filter(spark, sf):
    return S.shape_records(S.filter_logs(A.logs(spark, sf), "168.1.7", "live", "udp", "malicious"))


@query(
    "batch_records",
    W("logs") + _SHAPED + " FROM logs WHERE import_batch_id = 2 AND source ILIKE '%IMPORT%'",
)
def batch_records(spark, sf):
    return S.shape_records(S.search(A.logs(spark, sf), import_batch_id=2, source="IMPORT"))


_LISTED = f"""SELECT a.id, coalesce(l.src_ip, d.device_ip, 'Unknown') AS src_ip, coalesce(l.dest_ip, 'Internal') AS dest_ip,
  coalesce(l.src_port, 0) AS src_port, coalesce(l.dest_port, 0) AS dest_port, coalesce(l.protocol, 'IP') AS protocol,
  coalesce(l.prediction_label, 'Suspicious') AS label, a.threat_level, a.status, coalesce(a.count, 1) AS count,
  a.alert_type, a.is_simulated, CAST(printf('%.2f', coalesce(l.confidence_score, 0.85)) AS DOUBLE) AS confidence, a.is_resolved, a.notes,
  {iso("a.alert_time")} AS first_seen, {iso("coalesce(a.last_seen, a.alert_time)")} AS last_seen
FROM alerts a LEFT JOIN logs l ON a.traffic_log_id = l.id LEFT JOIN devices d ON a.device_id = d.id"""


@query(
    "alerts_listed",
    W("alerts", "logs", "devices") + _LISTED + """ WHERE NOT a.is_resolved
ORDER BY coalesce(a.last_seen, a.alert_time) DESC, a.id DESC LIMIT 150 OFFSET 10""",
)
def alerts_listed(spark, sf):
    return al.list_alerts(A.alerts(spark, sf), A.logs(spark, sf), A.device_directory(spark, sf), "unresolved", 150, 10)


@query("alerts_with_context", W("alerts", "logs", "devices") + _LISTED)
def alerts_with_context(spark, sf):
    out = al.with_context(A.alerts(spark, sf), A.logs(spark, sf), A.device_directory(spark, sf))
    return (
        out.withColumn("first_seen", iso_text(F.col("alert_time")))
        .withColumn("last_seen", iso_text(F.col("last_seen")))
        .drop("alert_time", "has_log")
    )


_STATES = ("all", "active", "new", "acknowledged", "resolved", "unresolved")


@query(
    "alerts_by_status",
    W("alerts") + """SELECT 'all' AS state, count(*) AS n, CAST(sum(id) AS BIGINT) AS ids FROM alerts
UNION ALL SELECT 'active', count(*), CAST(sum(id) AS BIGINT) FROM alerts WHERE NOT is_resolved AND status IN ('Active', 'New')
UNION ALL SELECT 'new', count(*), CAST(sum(id) AS BIGINT) FROM alerts WHERE NOT is_resolved AND status = 'New'
UNION ALL SELECT 'acknowledged', count(*), CAST(sum(id) AS BIGINT) FROM alerts WHERE NOT is_resolved AND status = 'Acknowledged'
UNION ALL SELECT 'resolved', count(*), CAST(sum(id) AS BIGINT) FROM alerts WHERE is_resolved
UNION ALL SELECT 'unresolved', count(*), CAST(sum(id) AS BIGINT) FROM alerts WHERE NOT is_resolved""",
)
def alerts_by_status(spark, sf):
    rows = A.alerts(spark, sf)
    out = None
    for state in _STATES:
        part = al.with_status(rows, state).agg(F.count(F.lit(1)).alias("n"), F.sum("id").alias("ids"))
        part = part.select(F.lit(state).alias("state"), "n", "ids")
        out = part if out is None else out.unionByName(part)
    return out


@query(
    "alert_filter",
    W("alerts", "logs", "devices", extra=f"x AS ({_LISTED})")
    + "SELECT id, src_ip, dest_ip, threat_level FROM x WHERE (src_ip LIKE '%.12%' OR dest_ip LIKE '%.12%') AND threat_level = 'High'",
)
def alert_filter(spark, sf):
    listed = al.with_context(A.alerts(spark, sf), A.logs(spark, sf), A.device_directory(spark, sf))
    return al.filter_alerts(listed, ".12", "HIGH").select("id", "src_ip", "dest_ip", "threat_level")


@query(
    "severity_tally",
    W("alerts", "logs", "devices", extra=f"x AS ({_LISTED})")
    + """SELECT CAST(coalesce(sum(count) FILTER (threat_level = 'Critical'), 0) AS BIGINT) AS critical,
  CAST(coalesce(sum(count) FILTER (threat_level = 'High'), 0) AS BIGINT) AS high,
  CAST(coalesce(sum(count) FILTER (threat_level NOT IN ('Critical', 'High')), 0) AS BIGINT) AS medium,
  coalesce(bool_or(protocol = 'ARP' OR notes LIKE '%ARP%'), false) AS arp_spoofing FROM x""",
)
def severity_tally(spark, sf):
    return al.severity_tally(al.with_context(A.alerts(spark, sf), A.logs(spark, sf), A.device_directory(spark, sf)))


@query(
    "report_threats",
    W("alerts", "logs") + """SELECT a.id, a.threat_level, l.src_ip, l.dest_ip, l.protocol,
  '[' || strftime(a.alert_time, '%Y-%m-%d %H:%M:%S') || '] Severity: ' || a.threat_level || ' | Src: ' || l.src_ip || ':' || l.src_port
  || ' -> Dst: ' || l.dest_ip || ':' || l.dest_port || ' | Proto: ' || l.protocol || ' | Count: ' || coalesce(a.count, 1)
  || chr(10) || 'Notes: ' || a.notes AS line
FROM alerts a JOIN logs l ON a.traffic_log_id = l.id
WHERE NOT a.is_resolved AND a.threat_level IN ('Critical', 'High') ORDER BY a.alert_time DESC, a.id DESC LIMIT 8""",
)
def report_threats(spark, sf):
    return al.report_threats(A.alerts(spark, sf), A.logs(spark, sf))


_HOURS = 48
_RECENT = f"w AS (SELECT * FROM logs WHERE timestamp >= {AS_OF} - INTERVAL {_HOURS} HOUR)"


@query(
    "baseline",
    W("logs", extra=_RECENT) + f"""SELECT {_HOURS} AS window_hours, count(*) AS total_flows,
  CAST(coalesce(sum(total_bytes), 0) AS BIGINT) AS total_bytes, CAST(printf('%.2f', count(*) / {_HOURS * 60}.0e0) AS DOUBLE) AS flow_rate_per_min,
  coalesce(CAST(printf('%.1f', CAST(sum(total_bytes) AS DOUBLE) / count(*)) AS DOUBLE), 0) AS avg_bytes_per_flow,
  coalesce(CAST(printf('%.2f', CAST(sum(duration) AS DOUBLE) / count(*)) AS DOUBLE), 0) AS avg_duration_sec FROM w""",
)
def baseline(spark, sf):
    return R.baseline(A.logs(spark, sf), as_of(), _HOURS)


@query(
    "baseline_protocol_share",
    W("logs", extra=_RECENT) + """SELECT protocol, count(*) AS flows,
  CAST(printf('%.1f', CAST(count(*) AS DOUBLE) / (SELECT count(*) FROM w) * 100) AS DOUBLE) AS share_pct FROM w GROUP BY 1""",
)
def baseline_protocol_share(spark, sf):
    return R.protocol_shares(A.logs(spark, sf), as_of(), _HOURS)


@query(
    "baseline_ports",
    W("logs", extra=_RECENT) + "SELECT dest_port, count(*) AS flows FROM w GROUP BY 1 ORDER BY flows DESC, dest_port LIMIT 5",
)
def baseline_ports(spark, sf):
    return R.common_ports(A.logs(spark, sf), as_of(), _HOURS)


DEVIATIONS_SQL = (
    W("logs", extra=_RECENT + f""",
  s AS (SELECT CAST(printf('%.2f', count(*) / {_HOURS * 60}.0e0) AS DOUBLE) AS br, coalesce(CAST(printf('%.1f', CAST(sum(total_bytes) AS DOUBLE) / count(*)) AS DOUBLE), 0) AS bb,
    CAST(printf('%.2f', count(*) FILTER (timestamp >= {AS_OF} - INTERVAL 5 MINUTE) / 5.0e0) AS DOUBLE) AS r,
    coalesce(CAST(sum(total_bytes) FILTER (timestamp >= {AS_OF} - INTERVAL 5 MINUTE) AS DOUBLE)
      / nullif(count(*) FILTER (timestamp >= {AS_OF} - INTERVAL 5 MINUTE), 0), 0) AS b,
    count(*) FILTER (timestamp >= {AS_OF} - INTERVAL 5 MINUTE) AS n FROM w)""")
    + """SELECT 'Flow Creation Rate' AS metric, 'Warning' AS severity,
  'Flow velocity surged to ' || r || ' flows/min (baseline: ' || br || ' flows/min).' AS detail,
  'Indicates network-wide connection surge, mass browser reload, or multi-threaded scans.' AS implication
FROM s WHERE br > 5 AND r > 2.5 * br
UNION ALL SELECT 'Packet Velocity (PPS)', 'Elevated', 'Packet velocity currently at 400 PPS.',
  'High volume traffic generation; observe if accompanied by socket resets or buffer saturation.'
UNION ALL SELECT 'Payload Volume per Flow', 'Notice',
  'Average flow payload surged to ' || CAST(round_even(b, 0) AS BIGINT) || ' B (baseline: ' || CAST(round_even(bb, 0) AS BIGINT) || ' B).',
  'Large file transfers, streaming video initialization, or potential data staging in progress.'
FROM s WHERE bb > 0 AND b > 4 * bb AND n > 10"""
)


@query("deviations", DEVIATIONS_SQL)
def deviations(spark, sf):
    return R.deviations(A.logs(spark, sf), as_of(), 400, _HOURS)


STATUS_SQL = (
    W("logs", extra=_RECENT + f", r AS (SELECT * FROM logs WHERE timestamp >= {AS_OF} - INTERVAL 5 MINUTE)")
    + f"""SELECT 'Deviation Detected' AS profile_status, true AS is_deviating,
  (SELECT CAST(printf('%.2f', count(*) / {_HOURS * 60}.0e0) AS DOUBLE) FROM w) AS flow_rate_per_min,
  (SELECT coalesce(CAST(printf('%.1f', CAST(sum(total_bytes) AS DOUBLE) / count(*)) AS DOUBLE), 0) FROM w) AS avg_bytes_per_flow,
  (SELECT coalesce(CAST(printf('%.2f', CAST(sum(duration) AS DOUBLE) / count(*)) AS DOUBLE), 0) FROM w) AS avg_duration_sec,
  (SELECT count(*) FROM w) AS total_flows,
  (SELECT CAST(printf('%.2f', count(*) / 5.0e0) AS DOUBLE) FROM r) AS recent_rate_per_min,
  (SELECT CASE WHEN count(*) > 0 THEN CAST(printf('%.1f', CAST(sum(total_bytes) AS DOUBLE) / count(*)) AS DOUBLE) ELSE 0 END FROM r) AS recent_avg_bytes"""
)


@query("profile_status", STATUS_SQL)
def profile_status(spark, sf):
    return R.profile_status(A.logs(spark, sf), as_of(), 400, _HOURS)


def surge(logs):
    """All logs in the last hours, a part of them in the last five minutes with a thousand times the bytes."""
    late = F.col("id") % 100 < 22
    back = F.when(late, F.col("id") % 280).otherwise(301 + F.col("id") % 3200)
    shifted = F.timestamp_seconds(F.unix_seconds(as_of()) - back)
    return logs.withColumns({"timestamp": shifted, "total_bytes": F.when(late, F.col("total_bytes") * 1000).otherwise(F.col("total_bytes"))})


def _surging(sql: str) -> str:
    """The SQL over the shifted logs and one hour."""
    late = "logs.id % 100 < 22"
    view = f"""surge AS (SELECT * REPLACE ({AS_OF} - to_seconds(CASE WHEN {late} THEN logs.id % 280 ELSE 301 + logs.id % 3200 END) AS timestamp,
    CASE WHEN {late} THEN total_bytes * 1000 ELSE total_bytes END AS total_bytes) FROM logs),
  w AS ("""
    sql = sql.replace("FROM logs WHERE timestamp >=", "FROM surge WHERE timestamp >=").replace("w AS (", view, 1)
    return sql.replace(f"INTERVAL {_HOURS} HOUR", "INTERVAL 1 HOUR").replace(f"{_HOURS * 60}.0e0", "60.0e0")


@query("deviations_surge", _surging(DEVIATIONS_SQL))
def deviations_surge(spark, sf):
    """Every rule fires."""
    return R.deviations(surge(A.logs(spark, sf)), as_of(), 400, 1)


@query("profile_status_surge", _surging(STATUS_SQL))
def profile_status_surge(spark, sf):
    return R.profile_status(surge(A.logs(spark, sf)), as_of(), 0, 1)


@query("profile_status_stable", STATUS_SQL.replace("'Deviation Detected' AS profile_status, true AS", "'Baseline Stable' AS profile_status, false AS"))
def profile_status_stable(spark, sf):
    """No rule fires on the logs as they are."""
    return R.profile_status(A.logs(spark, sf), as_of(), 0, _HOURS)


_NAMES = {
    "TCP": "Transmission Control Protocol", "UDP": "User Datagram Protocol", "DNS": "Domain Name System",
    "HTTP": "Hypertext Transfer Protocol", "HTTPS": "Hypertext Transfer Protocol Secure",
    "ICMP": "Internet Control Message Protocol", "ARP": "Address Resolution Protocol",
}


@query(
    "protocol_telemetry",
    W("logs", extra=f"""p(protocol, name) AS (VALUES {", ".join(f"('{k}', '{v}')" for k, v in _NAMES.items())}),
  t AS (SELECT p.protocol, p.name,
    (SELECT count(*) FROM logs l WHERE l.protocol ILIKE '%' || p.protocol || '%' AND l.timestamp >= {AS_OF} - INTERVAL 24 HOUR) AS n,
    (SELECT coalesce(sum(total_bytes), 0) FROM logs l WHERE l.protocol ILIKE '%' || p.protocol || '%' AND l.timestamp >= {AS_OF} - INTERVAL 24 HOUR) AS b,
    (SELECT max({{'ts': l.timestamp, 'id': l.id, 's': l.src_ip, 'd': l.dest_ip, 'i': coalesce(l.info, 'State: ' || l.connection_state)}})
     FROM logs l WHERE l.protocol ILIKE '%' || p.protocol || '%') AS e FROM p),
  u AS (SELECT *, CAST(printf('%.1f', CAST(n AS DOUBLE) / (SELECT count(*) FROM logs WHERE timestamp >= {AS_OF} - INTERVAL 24 HOUR) * 100) AS DOUBLE) AS pct FROM t)""")
    + f"""SELECT protocol, name, n AS count_1h, CAST(b AS BIGINT) AS bytes_1h, pct AS traffic_pct,
  CASE WHEN n > 0 THEN n || ' active ' || protocol || ' flows (' || pct || '% of network traffic) in the past hour.'
       ELSE 'No ' || protocol || ' flows captured on the active interface in the past hour.' END AS observation,
  {iso("e.ts")} AS example_time, e.s AS example_src, e.d AS example_dest, e.i AS example_info FROM u""",
)
def protocol_telemetry(spark, sf):
    return R.protocol_telemetry(A.logs(spark, sf), as_of(), 24)


@query(
    "latest_per_protocol",
    W("logs") + f"""SELECT protocol, {iso("timestamp")} AS timestamp, id, src_ip, total_bytes FROM logs
QUALIFY row_number() OVER (PARTITION BY protocol ORDER BY timestamp DESC, id DESC) = 1""",
)
def latest_per_protocol(spark, sf):
    out = R.latest_per(A.logs(spark, sf), "protocol", ["src_ip", "total_bytes"])
    return out.withColumn("timestamp", iso_text(F.col("timestamp")))


@query(
    "threat_levels",
    W("logs") + """SELECT id, CASE prediction_label WHEN 'Malicious' THEN CASE WHEN confidence_score >= 0.9 THEN 'Critical' ELSE 'High' END
    WHEN 'Suspicious' THEN CASE WHEN confidence_score >= 0.8 THEN 'Medium' ELSE 'Low' END END AS live_level,
  CASE WHEN total_bytes > 9000 THEN 'High' WHEN prediction_label = 'Malicious' THEN 'Critical'
       WHEN prediction_label = 'Suspicious' THEN 'Medium' END AS import_level,
  CASE WHEN total_bytes > 9000 THEN 'watchlist_match' ELSE 'flow_classification' END AS alert_type,
  CASE WHEN total_bytes > 9000 THEN 'IOC Watchlist Cross-Correlation Hit' ELSE 'Imported Volumetric / Flow Anomaly' END AS threat_type,
  CASE WHEN confidence_score >= 0.85 THEN 'High' ELSE 'Medium' END AS device_level,
  source LIKE 'sim:%' AS simulated FROM logs""",
)
def threat_levels(spark, sf):
    hit = F.col("total_bytes") > 9000
    return A.logs(spark, sf).select(
        "id",
        verdicts.live_level(F.col("prediction_label"), F.col("confidence_score")).alias("live_level"),
        verdicts.import_level(hit, F.col("prediction_label")).alias("import_level"),
        verdicts.import_alert_type(hit).alias("alert_type"),
        verdicts.import_threat_type(hit).alias("threat_type"),
        verdicts.device_level(F.col("confidence_score")).alias("device_level"),
        verdicts.is_simulated(F.col("source")).alias("simulated"),
    )


_EXPLAIN = """x AS (SELECT *, CAST(total_bytes AS DOUBLE) / (src_pkts + dest_pkts) AS size, src_pkts + dest_pkts AS pk,
    CAST(duration AS DOUBLE) / 10000 AS gap FROM logs),
  y AS (SELECT *, CASE WHEN prediction_label = 'Normal' THEN 'Normal Traffic'
    WHEN prediction_label = 'Malicious' THEN CASE WHEN src_bytes > 15000 OR pk > 100 THEN 'Potential DoS / Volumetric Flood'
      WHEN size > 1000 THEN 'Anomalous Volume / Potential Exfiltration' ELSE 'Anomalous Traffic Deviation' END
    WHEN gap < 0.005 AND pk > 5 THEN 'Possible Port Scan / Reconnaissance'
    WHEN src_bytes < 500 AND pk <= 2 THEN 'Possible Port Probe' ELSE 'Unusual Flow Characteristic' END AS threat_type FROM x),
  z AS (SELECT *, CASE threat_type
    WHEN 'Normal Traffic' THEN 'Traffic patterns match standard operational baselines (balanced payload size and normal timing).'
    WHEN 'Potential DoS / Volumetric Flood' THEN 'High source data volume (' || src_bytes || ' bytes) over ' || pk || ' packets. Characteristically observed in volumetric DoS floods or large unauthorized transfers.'
    WHEN 'Anomalous Volume / Potential Exfiltration' THEN 'Anomalously large average packet size (' || printf('%.1f', size) || ' bytes) indicates heavy buffer utilization, characteristic of data staging or potential exfiltration.'
    WHEN 'Anomalous Traffic Deviation' THEN 'Multi-feature statistical profile deviates significantly from established baseline characteristics.'
    WHEN 'Possible Port Scan / Reconnaissance' THEN 'Abnormally compressed packet inter-arrival interval (' || printf('%.6f', gap) || 's) indicates automated probing or rapid connection sweeps.'
    WHEN 'Possible Port Probe' THEN 'Sparse single-packet flow (' || src_bytes || ' bytes, ' || pk || ' pkts) characteristic of exploratory TCP flag probing.'
    ELSE 'Flow timing and packet size parameters exhibit minor divergence from typical traffic patterns.' END AS reason,
  CASE threat_type WHEN 'Normal Traffic' THEN 'Low' WHEN 'Potential DoS / Volumetric Flood' THEN 'Critical'
    WHEN 'Anomalous Volume / Potential Exfiltration' THEN 'High' WHEN 'Anomalous Traffic Deviation' THEN 'High'
    WHEN 'Unusual Flow Characteristic' THEN 'Low' ELSE 'Medium' END AS severity,
  CASE threat_type WHEN 'Normal Traffic' THEN 'No immediate response needed. Maintain active monitoring.'
    WHEN 'Potential DoS / Volumetric Flood' THEN 'Investigate source IP connection rates. Verify affected service health and socket states.'
    WHEN 'Anomalous Volume / Potential Exfiltration' THEN 'Inspect connection endpoint and audit active payload flows on the local subnet.'
    WHEN 'Anomalous Traffic Deviation' THEN 'Flag connection for investigation. Correlate with concurrent host activity logs.'
    WHEN 'Possible Port Scan / Reconnaissance' THEN 'Investigate originating host. Check for sequential destination port connections.'
    WHEN 'Possible Port Probe' THEN 'Monitor source IP for broader scanning activity across other local hosts.'
    ELSE 'Maintain passive observation. No immediate intervention required.' END AS action FROM y)"""


def _explained(spark, sf):
    logs = A.logs(spark, sf)
    packets = F.col("src_pkts") + F.col("dest_pkts")
    told = verdicts.explanation(
        F.col("prediction_label"),
        F.col("src_bytes").cast("double"),
        F.col("duration").cast("double") / F.lit(10000.0),
        packets.cast("double"),
        F.col("total_bytes") / packets,
    )
    return logs.withColumn("x", told).select("*", "x.*")


@query("explanation", W("logs", extra=_EXPLAIN) + "SELECT id, threat_type, reason, severity, action FROM z")
def explanation(spark, sf):
    return _explained(spark, sf).select("id", "threat_type", "reason", "severity", "action")


_NOTE = """CASE WHEN source LIKE 'sim:%' THEN '[SIMULATION] ' ELSE '' END || '[' || src_ip || ' -> ' || dest_ip || ' | ' || protocol
  || '] Diagnosis: ' || threat_type || ' | Reason: ' || reason || ' | Action: ' || action
  || CASE WHEN info IS NOT NULL THEN ' | Context: ' || info ELSE '' END"""


def _noted(spark, sf):
    names = ("src_ip", "dest_ip", "protocol", "threat_type", "reason", "action", "info")
    note = verdicts.note(verdicts.is_simulated(F.col("source")), *[F.col(n) for n in names])
    return _explained(spark, sf).withColumn("notes", note)


@query(
    "note_text",
    W("logs", extra=_EXPLAIN) + f"""SELECT id, {_NOTE} AS notes,
  '[IMPORT BATCH #' || coalesce(import_batch_id, 0) || '] ' || threat_type || ' on ' || src_ip || '->' || dest_ip || ' (' || protocol || ')'
  || CASE WHEN info IS NOT NULL THEN ' | Context: ' || info ELSE '' END AS import_note FROM z""",
)
def note_text(spark, sf):
    batch = F.coalesce("import_batch_id", F.lit(0))
    names = ("threat_type", "src_ip", "dest_ip", "protocol", "info")
    return _noted(spark, sf).select(
        "id", "notes", verdicts.import_note(batch, *[F.col(n) for n in names]).alias("import_note")
    )


@query(
    "note_parse",
    W("logs", extra=_EXPLAIN) + """SELECT id,
  CASE WHEN prediction_label = 'Normal' THEN 'Anomaly Intrusion Signature' ELSE threat_type END AS threat_type,
  CASE WHEN prediction_label = 'Normal' THEN 'The classifier identified packet characteristics deviating significantly from normal baseline profiles.' ELSE reason END AS reason,
  CASE WHEN prediction_label = 'Normal' THEN 'Deploy perimeter firewall blocking rules against the offending source IP address.' ELSE action END AS action
FROM z""",
)
def note_parse(spark, sf):
    """Notes of threats read back; flows without an alert have no note and get the defaults."""
    notes = F.when(verdicts.is_threat(F.col("prediction_label")), F.col("notes"))
    return _noted(spark, sf).select("id", verdicts.parse_note(notes).alias("p")).select("id", "p.*")


@query(
    "recommendations",
    W("alerts", extra=f"s AS ({_DEVICE_SCORE})") + """SELECT coalesce(device_id, -1) AS device_id, CAST(s AS BIGINT) AS score, CASE WHEN s > 70 THEN 'IMMEDIATELY' WHEN s > 30 THEN 'Flag' ELSE 'Continue' END AS first_word FROM s""",
)
def recommendations(spark, sf):
    """Advice per device from the weighted sum of its alerts."""
    weight = F.coalesce(*[F.when(F.col("threat_level") == k, F.lit(v)) for k, v in R.THREAT_WEIGHTS.items()])
    score = A.alerts(spark, sf).groupBy("device_id").agg(F.least(F.lit(95), F.sum(weight)).alias("score"))
    first = F.substring_index(verdicts.recommendations(F.col("score"))[0], " ", 1)
    return score.select(F.coalesce("device_id", F.lit(-1)).alias("device_id"), "score", first.alias("first_word"))

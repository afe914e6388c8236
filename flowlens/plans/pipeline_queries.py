"""Registered queries: normalisation, flows, watchlist, alerts, anomaly, drift, evaluation."""

from __future__ import annotations

from pyspark.sql import functions as F

from .. import adapters as A
from ..functions import payloads
from ..functions import values as V
from ..functions.values import iso_text
from ..operators import alerts as al
from ..operators import anomaly, arp, devices, drift, evaluate, flows, model, normalize, ordering, watchlist
from ..operators.ordering import HOUR
from ..session import shared_dir
from ..sinks import tables
from ..sources.indicators import extract_indicators
from .oracle_views import iso, with_views
from .registry import as_of, query

W = with_views

# --- single values ------------------------------------------------------------------------------


def _raw(spark, sf):
    return A.raw_records(spark, sf)


@query("validate_ip", W("norm") + "SELECT row_id, src_ip, dest_ip FROM norm")
def validate_ip(spark, sf):
    return _raw(spark, sf).select(
        "row_id",
        V.clean_ip(F.col("Source IP")).alias("src_ip"),
        V.clean_ip(F.col("Destination IP")).alias("dest_ip"),
    )


@query("normalize_ports", W("norm") + "SELECT row_id, sport, dport FROM norm")
def normalize_ports(spark, sf):
    return _raw(spark, sf).select(
        "row_id", V.clean_port(F.col("sport")).alias("sport"), V.clean_port(F.col("dport")).alias("dport")
    )


@query(
    "normalize_protocol",
    W("norm", "logs") + """SELECT row_id, n.protocol,
  CASE WHEN n.protocol IN ('TCP', 'TLS') THEN 1.0e0 WHEN n.protocol = 'UDP' THEN 2.0e0 WHEN n.protocol = 'ICMP' THEN 3.0e0 ELSE 0.0e0 END AS import_id,
  CASE n.protocol WHEN 'TCP' THEN 1.0e0 WHEN 'UDP' THEN 2.0e0 WHEN 'ICMP' THEN 3.0e0 ELSE 0.0e0 END AS flow_id,
  CASE n.protocol WHEN 'TCP' THEN 6.0e0 WHEN 'UDP' THEN 17.0 WHEN 'ICMP' THEN 1.0e0 ELSE 0.0e0 END AS device_id FROM norm n""",
)
def normalize_protocol(spark, sf):
    named = _raw(spark, sf).select("row_id", V.protocol_name(F.col("proto")).alias("protocol"))
    name = F.col("protocol")
    return named.select(
        "row_id",
        "protocol",
        V.protocol_id(name).alias("import_id"),
        V.flow_protocol_id(name).alias("flow_id"),
        V.device_protocol_id(name).alias("device_id"),
    )


@query("normalize_time", W("norm") + f"SELECT row_id, {iso("CASE WHEN time <> '' THEN ts END")} AS ts FROM norm")
def normalize_time(spark, sf):
    return _raw(spark, sf).select("row_id", iso_text(V.parse_time(F.col("ts"))).alias("ts"))


@query("normalize_numbers", W("norm") + "SELECT row_id, duration, src_bytes, dest_bytes FROM norm")
def normalize_numbers(spark, sf):
    return _raw(spark, sf).select(
        "row_id",
        V.clean_number(F.col("dur")).alias("duration"),
        V.clean_count(F.col("sbytes")).alias("src_bytes"),
        V.clean_count(F.col("dbytes")).alias("dest_bytes"),
    )


@query(
    "label_aliases",
    W("norm") + """SELECT row_id, CASE WHEN label IN ('BENIGN', '0') THEN 'Normal' WHEN label IN ('PortScan', 'ddos') THEN 'Malicious'
  WHEN label = 'Probe' THEN 'Suspicious' END AS truth FROM norm""",
)
def label_aliases(spark, sf):
    return _raw(spark, sf).select("row_id", V.ground_truth(F.col("class")).alias("truth"))


# --- whole records ------------------------------------------------------------------------------

# Column names of the raw records are the header of the file they stand for.
_HEADERS = "Source IP,Destination IP,sport,dport,proto,ts,dur,sbytes,dbytes,bytes,spkts,dpkts,packets,class,host".split(",")


def _normalized(spark, sf):
    mapping = normalize.auto_mapping(_HEADERS)
    return normalize.normalize(_raw(spark, sf), mapping, as_of(), batch_id=7, filename="raw.csv", keep=["row_id"])


_ERRORS = """list_filter([CASE WHEN src_ip IS NULL THEN 'Invalid source IP: ''' || raw_src || '''' END,
    CASE WHEN dest_ip IS NULL THEN 'Invalid destination IP: ''' || raw_dest || '''' END], lambda m: m IS NOT NULL) AS errors"""
_WARNINGS = """list_filter([CASE WHEN sport IS NULL THEN 'Malformed source port ''' || raw_sport || ''' defaulted to 0' END,
    CASE WHEN ts IS NULL THEN 'Unparseable timestamp ''' || time || ''' defaulted to UTC now' END], lambda m: m IS NOT NULL) AS warnings"""
_CHECKED = f"checked AS (SELECT *, {_ERRORS}, {_WARNINGS} FROM norm)"


@query(
    "normalize_record",
    W("norm", extra=_CHECKED) + f"""SELECT row_id, {iso("coalesce(ts, TIMESTAMP '2024-01-31 00:00:00')")} AS timestamp, src_ip, dest_ip,
  coalesce(sport, 0) AS src_port, dport AS dest_port, protocol, duration, src_bytes, dest_bytes, total_bytes, src_pkts, dest_pkts,
  packet_count, CAST(total_bytes AS DOUBLE) / packet_count AS avg_pkt_size, label AS ground_truth_label, info,
  array_to_string(errors, '; ') AS errors, array_to_string(warnings, '; ') AS warnings FROM checked""",
)
def normalize_record(spark, sf):
    out = _normalized(spark, sf)
    return out.select(
        "row_id", iso_text(F.col("timestamp")).alias("timestamp"), "src_ip", "dest_ip", "src_port", "dest_port",
        "protocol", "duration", "src_bytes", "dest_bytes", "total_bytes", "src_pkts", "dest_pkts", "packet_count",
        "avg_pkt_size", "ground_truth_label", "info", F.concat_ws("; ", "errors").alias("errors"),
        F.concat_ws("; ", "warnings").alias("warnings"),
    )


@query(
    "normalize_features",
    W("norm", extra=_CHECKED) + """SELECT row_id, CAST(src_bytes AS DOUBLE) AS sbytes, CAST(dest_bytes AS DOUBLE) AS dbytes,
  0.0e0 AS splt_mean, 0.0e0 AS dplt_mean,
  CASE WHEN protocol IN ('TCP', 'TLS') THEN 1.0e0 WHEN protocol = 'UDP' THEN 2.0e0 WHEN protocol = 'ICMP' THEN 3.0e0 ELSE 0.0e0 END AS proto_id,
  CAST(packet_count AS DOUBLE) AS packet_count, CAST(total_bytes AS DOUBLE) / packet_count AS avg_pkt_size
FROM checked WHERE len(errors) = 0""",
)
def normalize_features(spark, sf):
    valid = normalize.valid_rows(_normalized(spark, sf)).where(normalize.can_classify())
    return normalize.to_features(valid, ["row_id"])


@query(
    "validation_counts",
    W("norm", extra=_CHECKED) + """SELECT count(*) AS sample_validated, count(*) FILTER (len(errors) = 0) AS valid_count,
  count(*) FILTER (len(errors) > 0) AS invalid_count, count(*) FILTER (len(warnings) > 0) AS warning_count FROM checked""",
)
def validation_counts(spark, sf):
    return normalize.validation_counts(_normalized(spark, sf))


@query(
    "rejections",
    W("norm", extra=_CHECKED) + """SELECT row_id, array_to_string(errors, '; ') AS errors FROM checked WHERE len(errors) > 0
ORDER BY row_id LIMIT 100""",
)
def rejections(spark, sf):
    out = normalize.rejections(_normalized(spark, sf), "row_id", 100)
    return out.withColumn("errors", F.concat_ws("; ", "errors"))


# --- flows --------------------------------------------------------------------------------------

_GAP = 6 * 3600
_FLOWS = f"""marked AS (SELECT *, CASE WHEN us - lag(us) OVER c >= {_GAP}000000 OR lag(us) OVER c IS NULL THEN 1 ELSE 0 END AS opens
    FROM packets WINDOW c AS (PARTITION BY user_id ORDER BY us, pkt_id)),
  numbered AS (SELECT *, sum(opens) OVER (PARTITION BY user_id ORDER BY us, pkt_id) AS flow_no FROM marked),
  directed AS (SELECT *, first_value(back) OVER f AS opened_back, back = first_value(back) OVER f AS forward,
    row_number() OVER f AS n, contains(flags, 'S') OR contains(flags, 'F') OR contains(flags, 'R') AS hard
    FROM numbered WINDOW f AS (PARTITION BY user_id, flow_no ORDER BY us, pkt_id)),
  hards AS (SELECT *, max(n) FILTER (hard) OVER (PARTITION BY user_id, flow_no) AS last_hard FROM directed),
  summed AS (SELECT user_id, flow_no, any_value(opened_back) AS opened_back, any_value(client) AS client, any_value(server) AS server,
    any_value(cport) AS cport, arg_min(info, n) FILTER (info IS NOT NULL) AS info, min(us) AS first_us, max(us) AS last_us,
    CAST(sum(length) FILTER (forward) AS BIGINT) AS sbytes, CAST(coalesce(sum(length) FILTER (NOT forward), 0) AS BIGINT) AS dbytes,
    count(*) FILTER (forward) AS sn, count(*) FILTER (NOT forward) AS dn,
    max(us) FILTER (forward) - min(us) FILTER (forward) AS sspan, max(us) FILTER (NOT forward) - min(us) FILTER (NOT forward) AS dspan,
    count(*) AS packet_count, arg_max(flags, n) FILTER (hard) AS hard_flags,
    bool_or(NOT hard AND contains(flags, 'A') AND n > coalesce(last_hard, 0)) AS acked
    FROM hards GROUP BY user_id, flow_no)"""
_FLOW_COLUMNS = f"""CASE WHEN opened_back THEN server ELSE client END AS src_ip, CASE WHEN opened_back THEN client ELSE server END AS dest_ip,
  CASE WHEN opened_back THEN 443 ELSE cport END AS src_port, CASE WHEN opened_back THEN cport ELSE 443 END AS dest_port,
  {iso("make_timestamp(first_us)")} AS start_time"""


def _built(spark, sf):
    return flows.build_flows(A.packets(spark, sf), timeout=_GAP, decode="http")


FLOW_SESSIONS_SQL = (
    W("packets", extra=_FLOWS) + f"""SELECT {_FLOW_COLUMNS}, {iso("make_timestamp(last_us)")} AS last_seen, sbytes, dbytes, packet_count,
  sbytes + dbytes AS total_bytes, info FROM summed"""
)


def flow_session_columns(built):
    return built.select(
        "src_ip", "dest_ip", "src_port", "dest_port", iso_text(F.col("start_time")).alias("start_time"),
        iso_text(F.col("last_seen")).alias("last_seen"), "sbytes", "dbytes", "packet_count", "total_bytes", "info",
    )


@query("flow_sessions", FLOW_SESSIONS_SQL)
def flow_sessions(spark, sf):
    return flow_session_columns(_built(spark, sf))


@query(
    "flow_features",
    W("packets", extra=_FLOWS) + f"""SELECT {_FLOW_COLUMNS}, CAST(sbytes AS DOUBLE) AS sbytes, CAST(dbytes AS DOUBLE) AS dbytes,
  CASE WHEN sn > 1 THEN sspan / 1000000.0e0 / (sn - 1) ELSE 0 END AS splt_mean,
  CASE WHEN dn > 1 THEN dspan / 1000000.0e0 / (dn - 1) ELSE 0 END AS dplt_mean, 1.0e0 AS proto_id,
  CAST(packet_count AS DOUBLE) AS packet_count, CAST(sbytes + dbytes AS DOUBLE) / packet_count AS avg_pkt_size,
  greatest(0.001e0, (last_us - first_us) / 1000000.0e0) AS duration FROM summed""",
)
def flow_features(spark, sf):
    built = _built(spark, sf).withColumn("start_time", iso_text(F.col("start_time")))
    return flows.feature_vector(built, ["src_ip", "dest_ip", "src_port", "dest_port", "start_time", "duration"])


@query(
    "tcp_state",
    W("packets", extra=_FLOWS) + f"""SELECT {_FLOW_COLUMNS}, CASE
  WHEN hard_flags IS NULL THEN CASE WHEN acked THEN 'ESTABLISHED' ELSE 'INIT' END
  WHEN contains(hard_flags, 'S') THEN CASE WHEN acked THEN 'ESTABLISHED' WHEN contains(hard_flags, 'A') THEN 'SYN_RCVD' ELSE 'SYN_SENT' END
  WHEN contains(hard_flags, 'F') THEN CASE WHEN acked THEN 'CLOSED' ELSE 'FIN_WAIT' END ELSE 'RESET' END AS connection_state FROM summed""",
)
def tcp_state(spark, sf):
    built = _built(spark, sf).withColumn("start_time", iso_text(F.col("start_time")))
    return built.select("src_ip", "dest_ip", "src_port", "dest_port", "start_time", "connection_state")


@query(
    "packet_rate",
    W("packets") + f"""SELECT {iso("make_timestamp(us // 3600000000 * 3600000000)")} AS window_start, count(*) AS packets,
  CAST(sum(length) AS BIGINT) AS bytes, count(*) / 3600.0e0 AS packets_per_sec, CAST(sum(length) AS DOUBLE) / 3600.0e0 AS bytes_per_sec
FROM packets GROUP BY us // 3600000000""",
)
def packet_rate(spark, sf):
    out = flows.packet_rate(A.packets(spark, sf), 3600)
    return out.withColumn("window_start", iso_text(F.col("window_start")))


@query(
    "host_from_url",
    """SELECT page_id, 'HTTP' AS protocol_l7, 'HTTP Host: ' || regexp_extract(url, '^[a-z]+://([^/]+)', 1) AS info FROM pages""",
)
def host_from_url(spark, sf):
    """Every page as the request that would fetch it, read back by the payload rules."""
    host = F.regexp_extract("url", "^[a-z]+://([^/]+)", 1)
    path = F.regexp_extract("url", "^[a-z]+://[^/]+(.*)$", 1)
    request = F.concat(F.lit("GET "), path, F.lit(" HTTP/1.1\r\nUser-Agent: x\r\nhOsT: "), host, F.lit(" \r\n\r\n"), "html")
    packets = A.table(spark, sf, "pages").select("page_id", F.encode(request, "UTF-8").alias("payload"))
    l7 = payloads.http_application(F.lit("TCP"), F.lit(40000), F.lit(80), F.col("payload"))
    return packets.select("page_id", l7.alias("l7")).select("page_id", "l7.*")


# --- watchlist ----------------------------------------------------------------------------------

_WATCH = """ips AS (SELECT value, max(id) AS id FROM watch WHERE entry_type = 'ipv4' GROUP BY 1),
  doms AS (SELECT lower(value) AS value, min(id) AS place, max(id) AS id FROM watch WHERE entry_type = 'domain' GROUP BY 1),
  hits AS (SELECT l.*, s.id AS sid, d.id AS did,
    (SELECT arg_min(m.id, m.place) FROM doms m WHERE contains(lower(l.info), m.value)) AS mid
    FROM logs l LEFT JOIN ips s ON s.value = l.src_ip LEFT JOIN ips d ON d.value = l.dest_ip)"""


@query(
    "watchlist_match",
    W("logs", "watch", extra=_WATCH) + """SELECT h.id, coalesce(sid, did, mid) AS watch_id,
  CASE WHEN sid IS NOT NULL THEN 'src' WHEN did IS NOT NULL THEN 'dest' WHEN mid IS NOT NULL THEN 'info' END AS watch_side,
  w.value AS watch_value, w.label AS watch_label
FROM hits h LEFT JOIN watch w ON w.id = coalesce(sid, did, mid)""",
)
def watchlist_match(spark, sf):
    entries = A.watchlist(spark, sf)
    matched = watchlist.match_watchlist(A.logs(spark, sf), entries)
    return watchlist.attach_entry(matched, entries).select("id", "watch_id", "watch_side", "watch_value", "watch_label")


@query(
    "watchlist_domain_pages",
    """WITH hosts AS (SELECT DISTINCT lower(regexp_extract(url, '^[a-z]+://([^/]+)', 1)) AS h FROM pages),
  parts AS (SELECT substr(h, strpos(h, '.') + 1) AS value, count(*) AS n FROM hosts GROUP BY 1)
SELECT page_id, min(value) AS first_domain FROM pages JOIN parts ON contains(lower(url), value) GROUP BY 1""",
)
def watchlist_domain_pages(spark, sf):
    """Parent domains of all hosts as the list, in order of name; page addresses as texts."""
    host = F.lower(F.regexp_extract("url", "^[a-z]+://([^/]+)", 1))
    pages = A.table(spark, sf, "pages")
    names = pages.select(F.regexp_replace(host, r"^[^.]*\.", "").alias("key")).distinct()
    entries = names.select("key", F.col("key").alias("place"), F.col("key").alias("entry_id"))
    hits = watchlist.text_hits(pages.select("url").distinct(), "url", entries)
    return pages.join(hits, "url").select("page_id", F.col("entry_id").alias("first_domain"))


# --- indicators ---------------------------------------------------------------------------------

_IOC = r"""lines AS (SELECT doc_id, generate_subscripts(l, 1) AS line, trim(unnest(l)) AS text
    FROM (SELECT doc_id, string_split_regex(text, '\r\n|\r|\n') AS l FROM documents)),
  found AS (SELECT doc_id, line, 'ipv4' AS entry_type, unnest(regexp_extract_all(text, '\b(?:[0-9]{1,3}\.){3}[0-9]{1,3}\b')) AS value
      FROM lines WHERE text <> '' AND text NOT LIKE '#%'
    UNION ALL
    SELECT doc_id, line, 'domain', unnest(regexp_extract_all(text, '\b(?:[a-zA-Z0-9](?:[a-zA-Z0-9\-]{0,61}[a-zA-Z0-9])?\.)+[a-zA-Z]{2,}\b'))
      FROM lines WHERE text <> '' AND text NOT LIKE '#%'),
  good AS (SELECT * FROM found WHERE CASE WHEN entry_type = 'domain' THEN NOT regexp_matches(value, '^([0-9]{1,3}\.){3}[0-9]{1,3}\b') ELSE len(list_filter(string_split(value, '.'),
      lambda o: regexp_full_match(o, '0|[1-9][0-9]{0,2}') AND CAST(o AS INTEGER) <= 255)) = 4 END),
  feed AS (SELECT value, min({'f': doc_id, 'l': line}) AS place, min(entry_type) AS entry_type FROM good GROUP BY value)"""


def _indicators(spark, sf):
    docs = A.table(spark, sf, "documents").select(F.col("doc_id").alias("feed"), "text")
    return extract_indicators(docs)


@query("ioc_extract", f"WITH {_IOC} SELECT value, entry_type, place.f AS feed, place.l AS line FROM feed")
def ioc_extract(spark, sf):
    return _indicators(spark, sf)


@query(
    "watchlist_new",
    f"WITH {_IOC}, known AS (SELECT DISTINCT regexp_extract(url, '^[a-z]+://([^/]+)', 1) AS value FROM pages)"
    + " SELECT value, entry_type, place.l AS line FROM feed WHERE value NOT IN (SELECT value FROM known)",
)
def watchlist_new(spark, sf):
    """Indicators of the documents that are not hosts of the pages."""
    known = A.table(spark, sf, "pages").select(F.regexp_extract("url", "^[a-z]+://([^/]+)", 1).alias("value"))
    return watchlist.new_indicators(_indicators(spark, sf), known)


# --- ARP and alerts -----------------------------------------------------------------------------

_ARP = """firsts AS (SELECT *, first_value(mac) OVER (PARTITION BY ip ORDER BY ts, id) AS old_mac FROM arp WHERE op = 2)"""


@query(
    "arp_conflicts",
    W("arp", extra=_ARP) + f"SELECT id, {iso('ts')} AS ts, ip, old_mac, mac AS new_mac FROM firsts WHERE mac <> old_mac",
)
def arp_conflicts(spark, sf):
    return arp.arp_conflicts(A.arp_replies(spark, sf)).withColumn("ts", iso_text(F.col("ts")))


@query(
    "arp_alerts",
    W("arp", extra=_ARP) + """SELECT id, 'Critical' AS threat_level, 'arp_spoofing' AS alert_type, ip AS src_ip, 'Broadcast' AS dest_ip,
  '[' || ip || ' -> Broadcast | ARP] Diagnosis: ARP Spoofing / MITM | Reason: Duplicate MAC bindings detected for IP ' || ip || ': ' || mac
  || ' vs ' || old_mac || ' | Action: Audit active MAC tables and isolate device matching MAC ' || mac || '. | Context: Prior MAC: '
  || old_mac || ' -> Infiltrating MAC: ' || mac AS notes FROM firsts WHERE mac <> old_mac""",
)
def arp_alerts(spark, sf):
    events = al.event_notes(arp.arp_events(arp.arp_conflicts(A.arp_replies(spark, sf))))
    return events.select("id", "threat_level", "alert_type", "src_ip", "dest_ip", "notes")


@query(
    "alert_union",
    W("logs", "arp", extra=_ARP) + """SELECT id, CASE WHEN confidence_score >= 0.9 THEN 'Critical' ELSE 'High' END AS threat_level,
  'flow_classification' AS alert_type, src_ip FROM logs WHERE prediction_label = 'Malicious'
UNION ALL SELECT id, CASE WHEN confidence_score >= 0.8 THEN 'Medium' ELSE 'Low' END, 'flow_classification', src_ip FROM logs
  WHERE prediction_label = 'Suspicious'
UNION ALL SELECT id, 'Critical', 'arp_spoofing', ip FROM firsts WHERE mac <> old_mac""",
)
def alert_union(spark, sf):
    logs = A.logs(spark, sf)
    packets = F.col("src_pkts") + F.col("dest_pkts")
    labelled = logs.select(
        "*",
        F.col("src_bytes").cast("double").alias("sbytes"),
        F.lit(0.0).alias("splt_mean"),
        packets.cast("double").alias("packet_count"),
        (F.col("total_bytes") / packets).alias("avg_pkt_size"),
    )
    events = al.union_events(al.flow_events(labelled), arp.arp_events(arp.arp_conflicts(A.arp_replies(spark, sf))))
    return events.select("id", "threat_level", "alert_type", "src_ip")


ALERT_INCIDENTS_SQL = (
    W(
        "alert_events",
        "alert_actions",
        extra="""line AS (
    SELECT threat_level, device, ts, 0 AS kind, id, NULL AS action, is_simulated FROM alert_events
    UNION ALL SELECT threat_level, device, ts, 1, id, action, false FROM alert_actions),
  numbered AS (SELECT *, coalesce(sum(CASE WHEN action = 'resolve' THEN 1 ELSE 0 END) OVER
    (PARTITION BY threat_level, device ORDER BY ts, kind, id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS incident FROM line),
  grouped AS (SELECT threat_level, device, incident, count(*) FILTER (kind = 0) AS n, min(ts) FILTER (kind = 0) AS opened,
    arg_min(id, {'t': ts, 'i': id}) FILTER (kind = 0) AS alert_id, max(ts) FILTER (kind = 0) AS last_seen,
    bool_or(is_simulated) AS sim, bool_or(coalesce(action = 'resolve', false)) AS resolved, max(ts) FILTER (action = 'acknowledge') AS acked
    FROM numbered GROUP BY ALL)""",
    )
    + f"""SELECT alert_id, threat_level, 'flow_classification' AS alert_type, device, CAST(incident AS BIGINT) AS incident,
  {iso("opened")} AS alert_time, {iso("last_seen")} AS last_seen, n AS count,
  CASE WHEN resolved THEN 'Resolved' WHEN acked >= opened THEN 'Acknowledged' WHEN n > 1 THEN 'Active' ELSE 'New' END AS status,
  resolved AS is_resolved, sim AS is_simulated FROM grouped WHERE n > 0"""
)


@query("alert_incidents", ALERT_INCIDENTS_SQL)
def alert_incidents(spark, sf):
    out = al.incidents(A.alert_events(spark, sf), A.alert_actions(spark, sf)).drop("notes", "log_id", "device_id")
    return out.withColumn("alert_time", iso_text(F.col("alert_time"))).withColumn("last_seen", iso_text(F.col("last_seen")))


_NOTED = """'[' || device || ' -> ' || dest_ip || ' | ' || protocol || '] Diagnosis: Odd flow | Reason: Value ' || id || ' | Action: Look'"""
_STORED = _ARP + f""",
  united AS (SELECT id, ts, threat_level, 'flow_classification' AS alert_type, device, is_simulated,
      CASE WHEN is_simulated THEN '[SIMULATION] ' ELSE '' END || {_NOTED} AS note FROM alert_events
    UNION ALL SELECT id, ts, 'Critical', 'arp_spoofing', ip, false, '[' || ip || ' -> Broadcast | ARP] Diagnosis: ARP Spoofing / MITM | Reason: '
      || 'Duplicate MAC bindings detected for IP ' || ip || ': ' || mac || ' vs ' || old_mac || ' | Action: Audit active MAC tables and isolate '
      || 'device matching MAC ' || mac || '. | Context: Prior MAC: ' || old_mac || ' -> Infiltrating MAC: ' || mac FROM firsts WHERE mac <> old_mac),
  opened AS (SELECT arg_min(id, {{'t': ts, 'i': id}}) AS id, arg_max(id, {{'t': ts, 'i': id}}) AS traffic_log_id, alert_type, threat_level,
      min(ts) AS alert_time, max(ts) AS last_seen, count(*) AS count, bool_or(is_simulated) AS is_simulated, arg_min(note, {{'t': ts, 'i': id}}) AS note
    FROM united GROUP BY threat_level, alert_type, device)"""
_STORED_COLUMNS = f"""id, traffic_log_id, alert_type, threat_level, {iso('alert_time')} AS alert_time, {iso('last_seen')} AS last_seen, count, is_simulated,
  CASE WHEN is_simulated AND NOT contains(note, '[SIMULATION]') THEN '[SIMULATION] ' || note ELSE note END AS notes"""


def explained(events):
    """Alert events of the test tables with what their notes say."""
    odd = events.select(
        "*", F.lit("Odd flow").alias("threat_type"), F.concat(F.lit("Value "), "id").alias("reason"), F.lit("Look").alias("action"),
        F.lit(None).cast("string").alias("context"), F.col("id").alias("log_id"),
    )
    return al.event_notes(odd)


def _stored_alerts(spark, sf):
    """Events of two detectors as stored alerts."""
    conflicts = al.event_notes(arp.arp_events(arp.arp_conflicts(A.arp_replies(spark, sf))))
    events = al.union_events(explained(A.alert_events(spark, sf)), conflicts)
    return al.alert_rows(al.incidents(events, al.no_actions(events)))


def alert_columns(alerts):
    shown = alerts.withColumn("alert_time", iso_text(F.col("alert_time"))).withColumn("last_seen", iso_text(F.col("last_seen")))
    return shown.select(
        "id", "traffic_log_id", "alert_type", "threat_level", "alert_time", "last_seen", "count", "is_simulated", "notes", "status", "is_resolved"
    )


STORED_ALERTS_SQL = (
    W("alert_events", "arp", extra=_STORED)
    + f"""SELECT {_STORED_COLUMNS}, CASE WHEN count > 1 THEN 'Active' ELSE 'New' END AS status, false AS is_resolved FROM opened"""
)


@query("incident_alerts", STORED_ALERTS_SQL)
def incident_alerts(spark, sf):
    return alert_columns(_stored_alerts(spark, sf))


@query(
    "alerts_acted_on",
    W("alert_events", "alert_actions", "arp", extra=_STORED + """,
  acts AS (SELECT id - 1 AS alert_id, ts, action, id FROM alert_actions),
  done AS (SELECT alert_id, arg_max(action, {'t': ts, 'a': action}) AS last, bool_or(action = 'resolve') AS resolved FROM acts GROUP BY 1)""")
    + f"""SELECT {_STORED_COLUMNS}, CASE last WHEN 'resolve' THEN 'Resolved' WHEN 'acknowledge' THEN 'Acknowledged'
  ELSE CASE WHEN count > 1 THEN 'Active' ELSE 'New' END END AS status, coalesce(resolved, false) AS is_resolved
FROM opened LEFT JOIN done ON alert_id = opened.id""",
)
def alerts_acted_on(spark, sf):
    """An action on the event before it, which is an alert or not."""
    actions = A.alert_actions(spark, sf).select((F.col("id") - 1).alias("alert_id"), "ts", "action")
    return alert_columns(al.apply_actions(_stored_alerts(spark, sf), actions))


_WINDOW_HOURS = 12


@query(
    "alert_windows",
    W(
        "alert_events",
        extra=f"""o AS (SELECT *, CASE WHEN epoch_us(ts) - lag(epoch_us(ts)) OVER w < {_WINDOW_HOURS * 3600}000000 THEN 0 ELSE 1 END AS opens
    FROM alert_events WINDOW w AS (PARTITION BY threat_level, device ORDER BY ts)),
  s AS (SELECT *, sum(opens) OVER (PARTITION BY threat_level, device ORDER BY ts) AS no FROM o)""",
    )
    + f"""SELECT threat_level, 'flow_classification' AS alert_type, device, {iso("min(ts)")} AS first_seen, {iso("max(ts)")} AS last_seen,
  count(*) AS count FROM s GROUP BY threat_level, device, no""",
)
def alert_windows(spark, sf):
    out = al.alert_windows(A.alert_events(spark, sf), _WINDOW_HOURS * 3600)
    return out.withColumn("first_seen", iso_text(F.col("first_seen"))).withColumn("last_seen", iso_text(F.col("last_seen")))


NOTIFY_SECONDS = 36 * 3600
NOTIFICATION_SQL = (
    W(
        "alert_events",
        recursive=True,
        extra=f"""ev AS (SELECT threat_level, device, epoch_us(ts) AS us, id FROM alert_events),
  picked AS (SELECT threat_level, device, min(us) AS us FROM ev GROUP BY ALL
    UNION ALL
    SELECT p.threat_level, p.device, (SELECT min(e.us) FROM ev e WHERE e.threat_level = p.threat_level AND e.device = p.device
      AND e.us >= p.us + {NOTIFY_SECONDS}000000) AS us FROM picked p WHERE p.us IS NOT NULL)""",
    )
    + f"""SELECT p.threat_level, p.device, {iso("make_timestamp(p.us)")} AS ts, e.id FROM picked p
JOIN ev e ON e.threat_level = p.threat_level AND e.device = p.device AND e.us = p.us"""
)


@query("notification_limit", NOTIFICATION_SQL)
def notification_limit(spark, sf):
    out = al.rate_limit(A.alert_events(spark, sf), NOTIFY_SECONDS, ["threat_level", "device"])
    return out.withColumn("ts", iso_text(F.col("ts")))


@query(
    "open_alert_lookup",
    f"WITH inc AS ({ALERT_INCIDENTS_SQL})"
    + " SELECT threat_level, alert_type, device, arg_min(alert_id, {'t': alert_time, 'i': alert_id}) AS alert_id FROM inc WHERE NOT is_resolved GROUP BY ALL",
)
def open_alert_lookup(spark, sf):
    return al.open_alerts(al.incidents(A.alert_events(spark, sf), A.alert_actions(spark, sf))).drop("alert_time")


# --- device anomaly -----------------------------------------------------------------------------


def loud(logs):
    """Now and then a flow far beyond what its device does otherwise."""
    odd = F.col("id") % 97 == 5
    return logs.withColumns(
        {
            "total_bytes": F.when(odd, F.col("total_bytes") + 40_000_000 + F.col("id") % 7 * 9_000_000).otherwise(F.col("total_bytes")),
            "duration": F.when(odd, F.col("duration") + 1500 + F.col("id") % 5 * 500).otherwise(F.col("duration")),
            "src_pkts": F.when(odd, F.col("src_pkts") + F.col("id") % 3 * 20_000).otherwise(F.col("src_pkts")),
        }
    )


_LOUD = """loud AS (SELECT * REPLACE (CASE WHEN id % 97 = 5 THEN total_bytes + 40000000 + id % 7 * 9000000 ELSE total_bytes END AS total_bytes,
    CASE WHEN id % 97 = 5 THEN duration + 1500 + id % 5 * 500 ELSE duration END AS duration,
    CASE WHEN id % 97 = 5 THEN src_pkts + id % 3 * 20000 ELSE src_pkts END AS src_pkts) FROM logs)"""


def scored_flows(spark, sf):
    logs = loud(A.logs(spark, sf)).withColumn("packet_count", F.col("src_pkts") + F.col("dest_pkts"))
    return logs.select("id", "timestamp", "src_ip", "total_bytes", "duration", "protocol", "packet_count")


def _hst_sql(trees: int = 25, height: int = 8, window: int = 20) -> str:
    """The tree walk as SQL: leaf by leaf, then shared path lengths with the previous block."""
    forest = anomaly.build_forest(trees, height, window)
    rows = ",\n".join(
        f"({t}, [{', '.join(str(d + 1) for d in forest.dims[t])}], [{', '.join(repr(float(c)) + 'e0' for c in forest.cuts[t])}])"
        for t in range(trees)
    )
    steps = "SELECT id, tree, dims, cuts, x, 1 AS node FROM feats, forest"
    for _ in range(height):
        steps = f"SELECT id, tree, dims, cuts, x, 2 * node + CASE WHEN x[dims[node + 1]] >= cuts[node + 1] THEN 1 ELSE 0 END AS node FROM ({steps})"
    masses = ", ".join(
        f"count(*) FILTER (a.node >> {height - d} = r.node >> {height - d}) AS m{d}" for d in range(height + 1)
    )
    walk = "0"
    for d in range(height, -1, -1):
        term = f"m{d} * {1 << d}"
        walk = f"{term} + CASE WHEN m{d} < {0.1 * window} THEN 0 ELSE {walk} END" if d < height else term
    total = trees * window * (2 ** (height + 1) - 1)
    return f"""forest(tree, dims, cuts) AS (VALUES {rows}),
  {_LOUD},
  numbered AS (SELECT *, row_number() OVER (PARTITION BY src_ip ORDER BY timestamp, id) AS sample_no FROM loud),
  feats AS (SELECT id, [least(CAST(total_bytes AS DOUBLE), 1e8) / 1e8, least(CAST(duration AS DOUBLE), 3600e0) / 3600e0,
    CASE protocol WHEN 'TCP' THEN 6e0 WHEN 'UDP' THEN 17e0 ELSE 0e0 END / 255e0, CAST(hour(timestamp) AS DOUBLE) / 24e0,
    least(CAST(src_pkts + dest_pkts AS DOUBLE), 5e4) / 5e4] AS x FROM loud),
  leaves AS (SELECT l.id, l.tree, l.node, n.src_ip, (n.sample_no - 1) // {window} AS blk FROM ({steps}) l JOIN numbered n ON n.id = l.id),
  mass AS (SELECT a.id, a.tree, {masses} FROM leaves a JOIN leaves r ON r.src_ip = a.src_ip AND r.tree = a.tree AND r.blk = a.blk - 1
    GROUP BY a.id, a.tree),
  scored AS (SELECT n.*, CASE WHEN s.total IS NULL THEN 0e0 ELSE 1 - s.total / {float(total)!r}e0 END AS score FROM numbered n
    LEFT JOIN (SELECT id, CAST(sum({walk}) AS DOUBLE) AS total FROM mass GROUP BY 1) s ON s.id = n.id)"""


_HST = _hst_sql()
DEVICE_ANOMALY_SQL = (
    W("logs", extra=_HST) + """SELECT id, src_ip, sample_no, score, sample_no > 20 AND score >= 0.7 AS is_anomalous,
  CASE WHEN sample_no <= 20 THEN 'warming_up' WHEN score >= 0.7 THEN 'anomalous' ELSE 'normal' END AS status,
  CASE WHEN sample_no > 20 AND score >= 0.85 THEN 'High' WHEN sample_no > 20 AND score >= 0.7 THEN 'Medium' END AS threat_level,
  CASE WHEN sample_no > 20 AND score >= 0.7 THEN 'Device ' || src_ip || ' showed anomalous flow behavior relative to its historical baseline (HST score: '
    || printf('%.2f', score) || ' >= threshold 0.7). Payload: ' || total_bytes || 'B, Protocol: ' || protocol || ', Duration: '
    || printf('%.2f', CAST(duration AS DOUBLE)) || 's.' END AS reason FROM scored"""
)


@query("device_anomaly", DEVICE_ANOMALY_SQL)
def device_anomaly(spark, sf):
    scored = anomaly.device_anomaly(scored_flows(spark, sf))
    return scored.select("id", "src_ip", "sample_no", "score", "is_anomalous", "status", "threat_level", "reason")


_DEVICES = (
    _HST + f""", dev AS (SELECT src_ip AS device_ip, {iso("min(timestamp)")} AS first_seen, {iso("max(timestamp)")} AS last_seen, count(*) AS sample_count,
    count(*) FILTER (sample_no > 20 AND score >= 0.7) AS anomaly_count, CAST(printf('%.1f', CAST(sum(total_bytes) AS DOUBLE) / count(*)) AS DOUBLE) AS avg_bytes,
    CAST(printf('%.2f', CAST(sum(duration) AS DOUBLE) / count(*)) AS DOUBLE) AS avg_duration, CAST(sum(total_bytes) AS BIGINT) AS total_bytes,
    CAST(sum(duration) AS BIGINT) AS total_duration, arg_max(score, sample_no) AS last_score FROM scored GROUP BY src_ip),
  protos AS (SELECT src_ip, string_agg(protocol || '=' || n, ',' ORDER BY protocol) AS protocols FROM
    (SELECT src_ip, protocol, count(*) AS n FROM logs GROUP BY 1, 2) GROUP BY 1)"""
)
_DEVICE_COLUMNS = """device_ip, first_seen, last_seen, sample_count, anomaly_count, avg_bytes, avg_duration, total_bytes, total_duration, protocols,
  CAST(printf('%.2f', last_score) AS DOUBLE) AS recent_score, sample_count > 20 AND last_score >= 0.7 AS recent_alert,
  CASE WHEN sample_count <= 20 THEN 'Warming Up' WHEN last_score >= 0.7 THEN 'Anomalous' ELSE 'Normal' END AS status,
  CASE WHEN sample_count <= 20 THEN 'Warming Up' WHEN last_score >= 0.7 THEN 'Anomalous Spike' ELSE 'Baseline Stable' END AS badge
FROM dev JOIN protos ON src_ip = device_ip"""


def _shown(profiles):
    pairs = F.transform(F.map_entries("protocols"), lambda e: F.concat(e["key"], F.lit("="), e["value"].cast("string")))
    return (
        profiles.withColumn("protocols", F.concat_ws(",", pairs))
        .withColumn("first_seen", iso_text(F.col("first_seen")))
        .withColumn("last_seen", iso_text(F.col("last_seen")))
    )


@query("device_summary", W("logs", extra=_DEVICES) + f"SELECT {_DEVICE_COLUMNS}")
def device_summary(spark, sf):
    return _shown(devices.device_summary(anomaly.device_anomaly(scored_flows(spark, sf))))


@query("stored_devices", W("logs", extra=_DEVICES) + f"SELECT {_DEVICE_COLUMNS}")
def stored_devices(spark, sf):
    """Profiles stored epoch by epoch, with a merge in between, and read back."""
    scored = ordering.in_parts(anomaly.device_anomaly(scored_flows(spark, sf)), [], ["timestamp", "id"], "scored")
    low, high = scored.agg(F.min("timestamp"), F.max("timestamp")).head()
    path, epochs = shared_dir(spark, "devices"), 3
    place = F.unix_micros("timestamp") - F.unix_micros(F.lit(low))
    step = F.floor((F.unix_micros(F.lit(high)) - F.unix_micros(F.lit(low))) / epochs) + 1
    for epoch in (0, 1, 1, 2):  # the one that merges twice, as after a failure
        tables.upsert_devices(devices.device_sums(scored.where(F.floor(place / step) == epoch)), path, epoch, every=2)
    return _shown(tables.read_devices(spark, path))


@query("recent_devices", W("logs", extra=_DEVICES) + f"SELECT {_DEVICE_COLUMNS} ORDER BY last_seen DESC, device_ip LIMIT 50")
def recent_devices(spark, sf):
    profiles = devices.device_summary(anomaly.device_anomaly(scored_flows(spark, sf)))
    return _shown(devices.recent_devices(profiles, 50))


@query(
    "profiler_stats",
    W("logs") + """SELECT least(count(DISTINCT src_ip), 100) AS active_devices, 100 AS max_device_capacity,
  greatest(count(DISTINCT src_ip) - 100, 0) AS total_evictions, count(*) AS total_flows_evaluated FROM logs""",
)
def profiler_stats(spark, sf):
    return devices.profiler_stats(A.logs(spark, sf), 100)


# --- evaluation, drift, model -------------------------------------------------------------------


@query(
    "confusion_matrix",
    W("predictions", extra="n(x) AS (VALUES ('Normal'), ('Suspicious'), ('Malicious'))")
    + """SELECT t.x AS truth, p.x AS predicted, (SELECT count(*) FROM predictions q WHERE q.truth = t.x AND q.predicted = p.x) AS n
FROM n t, n p""",
)
def confusion_matrix(spark, sf):
    return evaluate.confusion(A.predictions(spark, sf))


@query(
    "eval_metrics",
    W(
        "predictions",
        extra="""s AS (SELECT count(*) AS total, count(*) FILTER (truth = predicted) AS ok,
    count(*) FILTER (truth = 'Malicious' AND predicted = 'Malicious') AS tp,
    count(*) FILTER (truth <> 'Malicious' AND predicted = 'Malicious') AS fp,
    count(*) FILTER (truth = 'Malicious' AND predicted <> 'Malicious') AS fn FROM predictions),
  r AS (SELECT total AS total_evaluated, CAST(printf('%.4f', ok / CAST(total AS DOUBLE)) AS DOUBLE) AS accuracy,
    CASE WHEN tp + fp > 0 THEN CAST(printf('%.4f', tp / CAST(tp + fp AS DOUBLE)) AS DOUBLE) ELSE 0 END AS precision,
    CASE WHEN tp + fn > 0 THEN CAST(printf('%.4f', tp / CAST(tp + fn AS DOUBLE)) AS DOUBLE) ELSE 0 END AS recall FROM s)""",
    )
    + """SELECT *, CASE WHEN precision + recall > 0 THEN CAST(printf('%.4f', 2 * (precision * recall) / (precision + recall)) AS DOUBLE)
  ELSE 0 END AS f1_score FROM r""",
)
def eval_metrics(spark, sf):
    return evaluate.eval_metrics(A.predictions(spark, sf))


@query(
    "label_evaluation",
    """WITH l AS (SELECT CASE WHEN toxic = 1 THEN 'Malicious' ELSE 'Normal' END AS t, CASE WHEN quality = 1 THEN 'Normal' ELSE 'Malicious' END AS p
  FROM labels) SELECT t.x AS truth, p.x AS predicted, (SELECT count(*) FROM l WHERE l.t = t.x AND l.p = p.x) AS n
FROM (VALUES ('Normal'), ('Suspicious'), ('Malicious')) t(x), (VALUES ('Normal'), ('Suspicious'), ('Malicious')) p(x)""",
)
def label_evaluation(spark, sf):
    labels = A.table(spark, sf, "labels")
    predicted = F.when(F.col("quality") == 1, "Normal").otherwise("Malicious")
    return evaluate.confusion(labels.select(F.col("toxic").cast("string").alias("truth"), predicted.alias("predicted")))


@query(
    "model_metrics",
    W("predictions") + """SELECT count(*) AS samples_processed,
  CAST(printf('%.4f', count(*) FILTER (truth = predicted) / CAST(count(*) AS DOUBLE)) AS DOUBLE) AS rolling_accuracy FROM predictions""",
)
def model_metrics(spark, sf):
    return evaluate.model_metrics(A.predictions(spark, sf), V.ground_truth(F.col("truth")) == F.col("predicted"))


@query(
    "running_accuracy",
    W("predictions") + """SELECT event_id, stream, row_number() OVER w AS samples,
  CAST(sum(CASE WHEN truth = predicted THEN 1 ELSE 0 END) OVER w AS BIGINT) AS "right",
  CAST(sum(CASE WHEN truth = predicted THEN 1 ELSE 0 END) OVER w AS DOUBLE) / row_number() OVER w AS accuracy
FROM predictions WINDOW w AS (PARTITION BY stream ORDER BY ts, event_id)""",
)
def running_accuracy(spark, sf):
    rows = A.predictions(spark, sf)
    correct = V.ground_truth(F.col("truth")) == F.col("predicted")
    out = evaluate.running_accuracy(rows, "stream", ["ts", "event_id"], correct)
    return out.select("event_id", "stream", "samples", "right", "accuracy")


@query(
    "error_blocks",
    W("predictions") + """SELECT stream, epoch_us(ts) // 3600000000 AS block, count(*) AS n,
  CAST(sum(CASE WHEN truth <> predicted THEN 1 ELSE 0 END) AS BIGINT) AS errors FROM predictions GROUP BY 1, 2""",
)
def error_blocks(spark, sf):
    wrong = V.ground_truth(F.col("truth")) != F.col("predicted")
    return drift.error_blocks(A.predictions(spark, sf), "stream", "ts", wrong, HOUR)


def shifting_errors_of(rows):
    """Predictions that are right most of the time at first and turn bad later, for a drift to find."""
    late = F.dayofmonth("ts") > 15
    wrong = F.when(late, F.col("predicted") != "Normal").otherwise(F.col("predicted") == "Malicious")
    return rows.select("event_id", "stream", "ts", wrong.alias("wrong"))


def shifting_errors(spark, sf):
    return shifting_errors_of(A.predictions(spark, sf))


@query("drift_points")
def drift_points(spark, sf):
    out = drift.drift_points(shifting_errors(spark, sf), "stream", "ts", F.col("wrong"), block_us=HOUR)
    return out.withColumn("timestamp", iso_text(F.col("timestamp")))


@query("drift_history")
def drift_history(spark, sf):
    return drift.drift_history(
        drift.drift_points(shifting_errors(spark, sf), "stream", "ts", F.col("wrong"), block_us=HOUR), 50
    )


@query("classify")
def classify(spark, sf):
    """All flows built from the packets, labelled by the baseline forest."""
    built = _built(spark, sf)
    features = flows.feature_vector(built, ["src_ip", "dest_ip", "start_time"])
    out = model.classify(features, model.train_baseline(spark))
    return out.withColumn("start_time", iso_text(F.col("start_time")))


# A forest that knows all three labels on the test tables, and the same trees in SQL.
FOREST = model.FixedForest(
    [
        ("sbytes", 80.0, (0.2, 0.7, 0.1), ("packet_count", 3.0, (0.8, 0.15, 0.05), (0.1, 0.2, 0.7))),
        ("dbytes", 1.0, ("splt_mean", 1.0, (0.3, 0.6, 0.1), (0.5, 0.3, 0.2)), ("avg_pkt_size", 90.0, (0.7, 0.2, 0.1), (0.2, 0.1, 0.7))),
        ("packet_count", 2.0, (0.4, 0.5, 0.1), (0.3, 0.1, 0.6)),
    ]
)
FOREST_SQL = """SELECT *, CASE WHEN sbytes < 80 THEN [0.2e0, 0.7e0, 0.1e0] WHEN packet_count < 3 THEN [0.8e0, 0.15e0, 0.05e0] ELSE [0.1e0, 0.2e0, 0.7e0] END AS t1,
  CASE WHEN dbytes < 1 THEN CASE WHEN splt_mean < 1 THEN [0.3e0, 0.6e0, 0.1e0] ELSE [0.5e0, 0.3e0, 0.2e0] END
    WHEN avg_pkt_size < 90 THEN [0.7e0, 0.2e0, 0.1e0] ELSE [0.2e0, 0.1e0, 0.7e0] END AS t2,
  CASE WHEN packet_count < 2 THEN [0.4e0, 0.5e0, 0.1e0] ELSE [0.3e0, 0.1e0, 0.6e0] END AS t3"""
VOTED_SQL = """voted AS (SELECT *, [(t1[1] + t2[1] + t3[1]) / 3, (t1[2] + t2[2] + t3[2]) / 3, (t1[3] + t2[3] + t3[3]) / 3] AS c FROM trees),
  named AS (SELECT *, list_max(c) AS confidence_score, ['Normal', 'Suspicious', 'Malicious'][list_position(c, list_max(c))] AS prediction_label FROM voted)"""
_FEATURES = """f AS (SELECT *, CASE WHEN sn > 1 THEN sspan / 1000000.0e0 / (sn - 1) ELSE 0 END AS splt_mean,
    CAST(sbytes + dbytes AS DOUBLE) / packet_count AS avg_pkt_size FROM summed)"""


@query(
    "classify_fixed",
    W("packets", extra=f"{_FLOWS},\n  {_FEATURES},\n  trees AS ({FOREST_SQL} FROM f),\n  {VOTED_SQL}")
    + f"SELECT {_FLOW_COLUMNS}, prediction_label, confidence_score FROM named",
)
def classify_fixed(spark, sf):
    """All flows built from the packets, labelled by a forest that SQL can state."""
    features = flows.feature_vector(_built(spark, sf), ["src_ip", "dest_ip", "src_port", "dest_port", "start_time"])
    out = model.classify(features, FOREST).withColumn("start_time", iso_text(F.col("start_time")))
    return out.select("src_ip", "dest_ip", "src_port", "dest_port", "start_time", "prediction_label", "confidence_score")


IMPORTED_SQL = f"""f AS (SELECT row_id, label, CAST(src_bytes AS DOUBLE) AS sbytes, CAST(dest_bytes AS DOUBLE) AS dbytes, 0.0e0 AS splt_mean,
    CAST(packet_count AS DOUBLE) AS packet_count, CAST(total_bytes AS DOUBLE) / packet_count AS avg_pkt_size FROM checked WHERE len(errors) = 0),
  trees AS ({FOREST_SQL} FROM f),
  {VOTED_SQL}"""


@query("import_labels_fixed", W("norm", extra=f"{_CHECKED},\n  {IMPORTED_SQL}") + "SELECT row_id, prediction_label, confidence_score FROM named")
def import_labels_fixed(spark, sf):
    valid = normalize.valid_rows(_normalized(spark, sf))
    out = model.classify(normalize.to_features(valid, ["row_id"]), FOREST)
    return out.select("row_id", "prediction_label", "confidence_score")


@query("import_labels")
def import_labels(spark, sf):
    """Imported rows labelled by the model if their volume is known."""
    valid = normalize.valid_rows(_normalized(spark, sf))
    out = model.classify(normalize.to_features(valid, ["row_id"]), model.train_baseline(spark))
    return out.select("row_id", "prediction_label", "confidence_score")

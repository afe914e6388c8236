"""SQL forms of the test-table adapters, as WITH parts for the checking engine."""

AS_OF = "TIMESTAMP '2024-01-31 00:00:00'"

VIEWS = {
    "base": """
  SELECT event_id, ts, user_id, event_type, value,
         CAST(regexp_extract(props, '([0-9]+)', 1) AS BIGINT) AS k,
         '10.0.' || CAST(user_id // 256 AS VARCHAR) || '.' || CAST(user_id % 256 AS VARCHAR) AS ip
  FROM events""",
    "logs": """
  SELECT event_id AS id, ts AS timestamp, ip AS src_ip,
         '192.168.1.' || CAST(k AS VARCHAR) AS dest_ip,
         CAST(40000 + event_id % 20000 AS INTEGER) AS src_port,
         CASE event_type WHEN 'view' THEN 443 WHEN 'click' THEN 80 WHEN 'signup' THEN 53
              WHEN 'purchase' THEN 8443 WHEN 'error' THEN 22 END AS dest_port,
         CASE event_type WHEN 'view' THEN 'HTTPS' WHEN 'click' THEN 'HTTP' WHEN 'signup' THEN 'DNS'
              WHEN 'purchase' THEN 'TCP' WHEN 'error' THEN 'UDP' END AS protocol,
         event_id % 120 AS duration,
         CAST(floor(value * 100) AS BIGINT) AS src_bytes,
         CAST(floor(value * 37) AS BIGINT) AS dest_bytes,
         CAST(floor(value * 100) + floor(value * 37) AS BIGINT) AS total_bytes,
         1 + k % 40 AS src_pkts, event_id % 7 AS dest_pkts,
         CASE event_type WHEN 'error' THEN 'Malicious' WHEN 'signup' THEN 'Suspicious' ELSE 'Normal' END
           AS prediction_label,
         CAST(50 + k % 50 AS DOUBLE) / 100 AS confidence_score,
         CASE event_type WHEN 'view' THEN 'HTTPS/TLS SNI: host' || CAST(k AS VARCHAR) || '.example.com'
              WHEN 'click' THEN 'HTTP Host: host' || CAST(k AS VARCHAR) || '.example.com'
              WHEN 'signup' THEN 'DNS Query: host' || CAST(k AS VARCHAR) || '.example.com' END AS info,
         CASE event_type WHEN 'click' THEN 'import:' || CAST(1 + user_id % 3 AS VARCHAR)
              WHEN 'signup' THEN 'sim:scan' WHEN 'purchase' THEN 'pcap:office.pcap' ELSE 'live' END AS source,
         CASE event_type WHEN 'view' THEN 'CLOSED' WHEN 'purchase' THEN 'ESTABLISHED' ELSE 'N/A' END
           AS connection_state,
         CASE WHEN event_type = 'click' THEN 1 + user_id % 3 END AS import_batch_id
  FROM base""",
    "shipments": """
  SELECT l_shipdate AS timestamp,
         '10.0.' || CAST(o_custkey // 256 AS VARCHAR) || '.' || CAST(o_custkey % 256 AS VARCHAR) AS src_ip,
         '192.168.1.' || CAST(l_suppkey AS VARCHAR) AS dest_ip,
         l_partkey % 1024 AS dest_port,
         CAST(floor(l_extendedprice) AS BIGINT) AS total_bytes
  FROM lineitem JOIN orders ON l_orderkey = o_orderkey""",
    "alerts": """
  SELECT event_id AS id,
         CASE WHEN event_type <> 'purchase' THEN event_id END AS traffic_log_id,
         CASE WHEN event_type = 'purchase' THEN user_id END AS device_id,
         CASE WHEN event_type = 'purchase' THEN 'device_behaviour' ELSE 'flow_classification' END AS alert_type,
         ts AS alert_time,
         CASE WHEN k >= 50 THEN ts + to_seconds(k) END AS last_seen,
         CASE event_type WHEN 'error' THEN CASE WHEN k % 50 >= 40 THEN 'Critical' ELSE 'High' END
              WHEN 'signup' THEN CASE WHEN k % 50 >= 30 THEN 'Medium' ELSE 'Low' END
              ELSE 'Medium' END AS threat_level,
         CASE WHEN k < 40 THEN 'New' WHEN k < 60 THEN 'Active' WHEN k < 75 THEN 'Acknowledged'
              ELSE 'Resolved' END AS status,
         k >= 95 AS is_simulated,
         '[x -> y | ' || CASE event_type WHEN 'signup' THEN 'ARP' WHEN 'purchase' THEN 'IP' ELSE 'UDP' END
           || '] Diagnosis: D' || CAST(k AS VARCHAR) || ' | Reason: R' || CAST(k % 10 AS VARCHAR)
           || ' | Action: block' AS notes,
         k >= 75 AS is_resolved,
         CASE WHEN k % 5 <> 0 THEN k % 5 END AS count
  FROM base WHERE event_type IN ('error', 'signup', 'purchase')""",
    "devices": """
  SELECT c_custkey AS id,
         '10.0.' || CAST(c_custkey // 256 AS VARCHAR) || '.' || CAST(c_custkey % 256 AS VARCHAR) AS device_ip
  FROM customer""",
    "watch": """
  SELECT c_custkey AS id,
         '10.0.' || CAST(c_custkey // 256 AS VARCHAR) || '.' || CAST(c_custkey % 256 AS VARCHAR) AS value,
         'ipv4' AS entry_type, c_mktsegment AS label
  FROM customer WHERE c_acctbal < 0
  UNION ALL
  SELECT 1000000000 + s_suppkey, 'Host' || CAST(s_suppkey AS VARCHAR) || '.example', 'domain', s_name
  FROM supplier WHERE s_acctbal < 0""",
    "packets": """
  SELECT event_id AS pkt_id, ts, epoch_us(ts) AS us, user_id,
         event_id % 2 = 1 AS back, ip AS client,
         '192.168.1.' || CAST(user_id % 8 AS VARCHAR) AS server, 40000 + user_id % 20000 AS cport,
         40 + CAST(floor(value) AS BIGINT) AS length,
         CASE event_type WHEN 'view' THEN 'A' WHEN 'click' THEN 'PA' WHEN 'signup' THEN 'S'
              WHEN 'purchase' THEN 'FA' WHEN 'error' THEN 'R' END AS flags,
         CASE WHEN event_type = 'click' THEN 'HTTP Host: host' || CAST(k AS VARCHAR) || '.example.com' END AS info
  FROM base""",
    "arp": """
  SELECT event_id AS id, ts, CASE event_type WHEN 'view' THEN 2 ELSE 1 END AS op, ip,
         '02:00:00:00:00:0' || CAST(k % 3 AS VARCHAR) AS mac
  FROM base WHERE event_type IN ('view', 'signup')""",
    "predictions": """
  SELECT event_id, ts, k % 4 AS stream,
         CASE event_type WHEN 'view' THEN 'Normal' WHEN 'click' THEN 'Normal' WHEN 'signup' THEN 'Suspicious'
              WHEN 'purchase' THEN 'Normal' WHEN 'error' THEN 'Malicious' END AS truth,
         CASE WHEN value < 20 THEN 'Normal' WHEN value < 60 THEN 'Suspicious' ELSE 'Malicious' END AS predicted
  FROM base""",
    "alert_events": """
  SELECT event_id AS id, ts, CASE event_type WHEN 'error' THEN 'High' ELSE 'Low' END AS threat_level,
         ip AS device, ip AS src_ip, '192.168.1.' || CAST(k AS VARCHAR) AS dest_ip,
         CASE event_type WHEN 'signup' THEN 'DNS' ELSE 'UDP' END AS protocol, k >= 90 AS is_simulated
  FROM base WHERE event_type IN ('error', 'signup')""",
    "alert_actions": """
  SELECT event_id AS id, ts, CASE WHEN value >= 20 THEN 'High' ELSE 'Low' END AS threat_level, ip AS device,
         CASE event_type WHEN 'click' THEN 'acknowledge' ELSE 'resolve' END AS action
  FROM base WHERE event_type IN ('click', 'purchase')""",
    "raw": """
  SELECT event_id AS row_id, ts AS seen, k, user_id, event_type, value,
         CASE k WHEN 13 THEN '999.1.1.1' WHEN 14 THEN '010.0.0.1' WHEN 15 THEN '2001:db8::1'
                WHEN 16 THEN '::ffff:10.0.0.1' WHEN 17 THEN '' WHEN 18 THEN '1:2:3' WHEN 19 THEN 'fe80::1%eth0'
                WHEN 20 THEN '1::2::3' ELSE ' ' || ip || ' ' END AS src,
         CASE WHEN k = 99 THEN 'host' ELSE '192.168.1.' || CAST(k AS VARCHAR) END AS dest,
         CASE k WHEN 21 THEN '70000' WHEN 22 THEN 'x' WHEN 23 THEN '80.7' WHEN 24 THEN '' WHEN 25 THEN '-1'
                WHEN 26 THEN '1e3' WHEN 27 THEN 'nan' WHEN 28 THEN ' 53 '
                ELSE CAST(40000 + event_id % 20000 AS VARCHAR) END AS sport,
         CASE event_type WHEN 'view' THEN '443' WHEN 'click' THEN '80' WHEN 'signup' THEN '53'
              WHEN 'purchase' THEN '8443' ELSE '22' END AS dport,
         CASE event_type WHEN 'view' THEN 'tcp' WHEN 'click' THEN '6' WHEN 'signup' THEN 'IPPROTO_UDP'
              WHEN 'purchase' THEN CASE WHEN k < 50 THEN 'TLS' ELSE 'gre' END
              ELSE CASE WHEN k < 50 THEN '' ELSE '1' END END AS proto,
         CASE k % 8 WHEN 0 THEN CAST(epoch_us(ts) // 1000000 AS VARCHAR)
                    WHEN 1 THEN CAST(epoch_us(ts) // 1000 AS VARCHAR)
                    WHEN 2 THEN CASE event_id % 8 WHEN 0 THEN strftime(ts, '%Y-%m-%dT%H:%M:%SZ')
                         WHEN 1 THEN strftime(ts, '%Y-%m-%dT%H:%M:%S.%f+0000')
                         WHEN 2 THEN strftime(ts + INTERVAL 330 MINUTE, '%Y-%m-%dT%H:%M:%S+0530')
                         WHEN 3 THEN strftime(ts - INTERVAL 5 HOUR, '%Y-%m-%dT%H:%M:%S-05')
                         WHEN 4 THEN strftime(ts, '%Y-%m-%dT%H') WHEN 5 THEN strftime(ts, '%Y-%m-%dT%H%M')
                         WHEN 6 THEN strftime(ts, '%Y%m%dT%H%M%SZ') ELSE strftime(ts, '%G-W%V-%u') END
                    WHEN 3 THEN strftime(ts, '%d/%m/%Y %H:%M:%S')
                    WHEN 4 THEN strftime(ts, '%Y/%m/%d %H:%M:%S')
                    WHEN 5 THEN strftime(ts, '%Y-%m-%d %H:%M:%S')
                    WHEN 6 THEN 'soon' ELSE '' END AS time,
         CASE k WHEN 31 THEN '-3' WHEN 32 THEN 'abc' WHEN 33 THEN 'inf' WHEN 34 THEN '1.5e+005' WHEN 35 THEN '2.5E-003'
                WHEN 36 THEN '1e100' ELSE CAST(k AS VARCHAR) || '.5' END AS dur,
         CASE k WHEN 41 THEN '' WHEN 42 THEN 'NaN' WHEN 43 THEN '1.5e+003' ELSE CAST(CAST(floor(value * 100) AS BIGINT) AS VARCHAR) END AS sbytes,
         CAST(CAST(floor(value * 37) AS BIGINT) AS VARCHAR) AS dbytes,
         CASE k % 3 WHEN 0 THEN '0' WHEN 1 THEN '9999' ELSE '' END AS bytes,
         CAST(k % 7 AS VARCHAR) AS spkts, CAST(event_id % 5 AS VARCHAR) AS dpkts,
         CASE WHEN k % 2 = 0 THEN '0' ELSE '12' END AS packets,
         CASE event_type WHEN 'view' THEN 'BENIGN' WHEN 'click' THEN '0' WHEN 'signup' THEN 'PortScan'
              WHEN 'purchase' THEN 'Probe' ELSE CASE WHEN k < 50 THEN 'ddos' ELSE 'Worms' END END AS class,
         CASE WHEN k % 2 = 0 THEN ' evil' || CAST(k AS VARCHAR) || '.example.com' ELSE '' END AS host
  FROM base""",
    # The cleaning rules stated on their own terms, field by field.
    "norm": r"""
  SELECT row_id,
         CASE WHEN trim(src) IN ('2001:db8::1', '::ffff:10.0.0.1', 'fe80::1%eth0') THEN trim(src)
              WHEN len(string_split(trim(src), '.')) = 4
                   AND len(list_filter(string_split(trim(src), '.'), lambda o: regexp_full_match(o, '0|[1-9][0-9]{0,2}')
                                       AND try_cast(o AS INTEGER) <= 255)) = 4 THEN trim(src) END AS src_ip,
         CASE WHEN dest LIKE '192.%' THEN dest END AS dest_ip,
         CASE WHEN trim(sport) = '' THEN 0
              WHEN isfinite(try_cast(trim(sport) AS DOUBLE)) AND trunc(try_cast(trim(sport) AS DOUBLE)) BETWEEN 0 AND 65535
              THEN CAST(trunc(try_cast(trim(sport) AS DOUBLE)) AS INTEGER) END AS sport,
         CAST(dport AS INTEGER) AS dport,
         CASE lower(proto) WHEN 'tcp' THEN 'TCP' WHEN '6' THEN 'TCP' WHEN 'ipproto_udp' THEN 'UDP' WHEN '1' THEN 'ICMP'
              WHEN '' THEN 'OTHER' ELSE upper(proto) END AS protocol,
         CASE WHEN time = '' THEN TIMESTAMP '2024-01-31 00:00:00'
              WHEN k % 8 = 0 THEN make_timestamp(CAST(time AS BIGINT) * 1000000)
              WHEN k % 8 = 1 THEN make_timestamp(CAST(time AS BIGINT) * 1000)
              WHEN k % 8 = 2 AND row_id % 8 = 1 THEN seen
              WHEN k % 8 = 2 AND row_id % 8 = 4 THEN date_trunc('hour', seen)
              WHEN k % 8 = 2 AND row_id % 8 = 5 THEN date_trunc('minute', seen)
              WHEN k % 8 = 2 AND row_id % 8 = 7 THEN date_trunc('day', seen)
              WHEN time <> 'soon' THEN date_trunc('second', seen) END AS ts,
         time, sport AS raw_sport, src AS raw_src, dest AS raw_dest,
         CASE WHEN dur = 'inf' OR try_cast(dur AS DOUBLE) IS NULL THEN 0.0 ELSE greatest(CAST(dur AS DOUBLE), 0.0) END
           AS duration,
         coalesce(CASE WHEN sbytes <> 'NaN' THEN CAST(trunc(try_cast(sbytes AS DOUBLE)) AS BIGINT) END, 0) AS src_bytes,
         CAST(dbytes AS BIGINT) AS dest_bytes,
         CASE WHEN bytes = '9999' THEN 9999
              ELSE coalesce(CASE WHEN sbytes <> 'NaN' THEN CAST(trunc(try_cast(sbytes AS DOUBLE)) AS BIGINT) END, 0) + CAST(dbytes AS BIGINT) END
           AS total_bytes,
         CAST(spkts AS BIGINT) AS src_pkts, CAST(dpkts AS BIGINT) AS dest_pkts,
         CASE WHEN packets = '12' THEN 12 ELSE greatest(1, CAST(spkts AS BIGINT) + CAST(dpkts AS BIGINT)) END AS packet_count,
         class AS label, CASE WHEN host <> '' THEN trim(host) END AS info
  FROM raw""",
}

# Which parts a part needs.
NEEDS = {
    "logs": ["base"],
    "alerts": ["base"],
    "packets": ["base"],
    "arp": ["base"],
    "predictions": ["base"],
    "alert_events": ["base"],
    "alert_actions": ["base"],
    "raw": ["base"],
    "norm": ["raw"],
}


def with_views(*names: str, extra: str = "", recursive: bool = False) -> str:
    """``WITH`` clause with the named views (and what they need), then extra parts."""
    ordered: list[str] = []

    def add(name: str) -> None:
        for need in NEEDS.get(name, []):
            add(need)
        if name not in ordered:
            ordered.append(name)

    for name in names:
        add(name)
    parts = [f"{n} AS ({VIEWS[n]})" for n in ordered]
    if extra:
        parts.append(extra)
    return ("WITH RECURSIVE " if recursive else "WITH ") + ",\n".join(parts) + "\n"


def iso(expr: str) -> str:
    return f"strftime({expr}, '%Y-%m-%dT%H:%M:%S.%f')"

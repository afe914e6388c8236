"""Registered queries: foreign files. The raw records of the test tables are written as files of each
format to the shared folder and read back by the readers, whole."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from .. import adapters as A
from ..functions.values import iso_text
from ..operators import alerts as al
from ..operators import evaluate, model
from ..operators.normalize import valid_rows
from ..session import shared_dir
from ..sinks import exports, tables
from ..sources import captures, files
from . import importer
from . import pipeline_queries as P
from .oracle_views import iso, with_views
from .registry import as_of, query

W = with_views

_SHOWN = f"""SELECT {iso("coalesce(ts, TIMESTAMP '2024-01-31 00:00:00')")} AS timestamp, src_ip, dest_ip, coalesce(sport, 0) AS src_port,
  dport AS dest_port, protocol, duration, src_bytes, dest_bytes, total_bytes, packet_count, label AS ground_truth_label, info,
  array_to_string(errors, '; ') AS errors, array_to_string(warnings, '; ') AS warnings FROM checked"""
_RECORDS = W("norm", extra=P._CHECKED) + _SHOWN


def _shown(flows):
    return flows.select(
        iso_text(F.col("timestamp")).alias("timestamp"), "src_ip", "dest_ip", "src_port", "dest_port", "protocol", "duration",
        "src_bytes", "dest_bytes", "total_bytes", "packet_count", "ground_truth_label", "info",
        F.concat_ws("; ", "errors").alias("errors"), F.concat_ws("; ", "warnings").alias("warnings"),
    )


def _raw(spark, sf):
    return A.raw_records(spark, sf).drop("row_id")


@query("read_csv", _RECORDS.replace(" info,", " replace(info, 'evil46.', 'evil46' || chr(10) || '.') AS info,"))
def read_csv(spark, sf):
    """A quoted cell with a line break is one cell."""
    path = shared_dir(spark, "csv")
    raw = _raw(spark, sf).withColumn("host", F.replace(F.col("host"), F.lit("evil46."), F.lit("evil46\n.")))
    raw.write.csv(path, header=True, sep=";", escape='"', ignoreLeadingWhiteSpace=False, ignoreTrailingWhiteSpace=False)
    return _shown(files.read_flows(spark, path, as_of(), fmt="csv"))


@query("read_jsonl", _RECORDS)
def read_jsonl(spark, sf):
    path = shared_dir(spark, "jsonl")
    _raw(spark, sf).write.json(path)
    return _shown(files.read_flows(spark, path, as_of(), fmt="jsonl"))


@query("read_json_documents", _RECORDS)
def read_json_documents(spark, sf):
    """Files of up to 512 records each, under a key next to other fields."""
    path = shared_dir(spark, "json")
    raw = _raw(spark, sf)
    record = F.struct(*[F.col(f"`{c}`") for c in raw.columns])
    docs = (
        A.raw_records(spark, sf)
        .select(F.floor(F.col("row_id") / 512).alias("part"), record.alias("r"))
        .groupBy("part")
        .agg(F.collect_list("r").alias("flows"))
        .select("part", F.to_json(F.struct(F.lit("export").alias("kind"), "flows")).alias("value"))
    )
    docs.write.partitionBy("part").text(path)
    return _shown(files.read_flows(spark, path, as_of(), fmt="json"))


#: Most records of a Zeek file.
ZEEK_RECORDS = 250_000
_ZEEK = {
    "ts": "ts", "id.orig_h": "Source IP", "id.orig_p": "sport", "id.resp_h": "Destination IP", "id.resp_p": "dport",
    "proto": "proto", "service": "host", "duration": "dur", "orig_bytes": "sbytes", "resp_bytes": "dbytes",
    "orig_pkts": "spkts", "resp_pkts": "dpkts",
}


@query(
    "read_zeek",
    W("norm", extra=P._CHECKED) + f"""SELECT {iso("coalesce(ts, TIMESTAMP '2024-01-31 00:00:00')")} AS timestamp, src_ip, dest_ip,
  coalesce(sport, 0) AS src_port, dport AS dest_port, protocol, duration, src_bytes, dest_bytes, src_bytes + dest_bytes AS total_bytes,
  greatest(1, src_pkts + dest_pkts) AS packet_count, info FROM checked WHERE len(errors) = 0""",
)
def read_zeek(spark, sf):
    """Connection logs whose layout changes inside the file; ``-`` stands for nothing.

    A file has a stretch of records, with one layout in its first half and another in the second. There are at most about
    64 files until they have `ZEEK_RECORDS` records each.
    """
    path = shared_dir(spark, "zeek")
    raw = A.raw_records(spark, sf)

    def line(names):
        cells = [F.when(F.trim(F.col(f"`{c}`")) == "", "-").otherwise(F.col(f"`{c}`")) for c in names.values()]
        return F.concat_ws("\t", *cells)

    turned = dict(reversed(_ZEEK.items()))
    n = raw.count()
    size = min(max(1000, n // 64), ZEEK_RECORDS)
    other, stretch = F.pmod("row_id", F.lit(size)) >= size // 2, F.floor(F.col("row_id") / size)
    run = F.pmod(stretch, F.lit(1 + n // size)).alias("run")  # numbers may have gaps, files are bounded all the same
    lines = raw.select(run, F.col("row_id").alias("at"), F.lit(1).alias("kind"), F.when(other, line(turned)).otherwise(line(_ZEEK)).alias("value"))
    head = F.when(F.col("other"), "#fields\t" + "\t".join(turned)).otherwise("#fields\t" + "\t".join(_ZEEK))
    halves = raw.groupBy(run, stretch.alias("stretch"), other.alias("other")).agg(F.min("row_id").alias("at"))
    heads = halves.select("run", "at", F.lit(0).alias("kind"), head.alias("value"))
    ordered = lines.unionByName(heads).repartition("run").sortWithinPartitions("run", "at", "kind")
    ordered.select("run", "value").write.partitionBy("run").text(path)
    flows = valid_rows(files.read_flows(spark, path, as_of(), fmt="zeek"))
    return _shown(flows).drop("ground_truth_label", "errors", "warnings")


@query(
    "read_eve",
    W("norm", extra=P._CHECKED) + f"""SELECT {iso("coalesce(ts, TIMESTAMP '2024-01-31 00:00:00')")} AS timestamp, src_ip, dest_ip,
  coalesce(sport, 0) AS src_port, dport AS dest_port, protocol, duration, src_bytes, dest_bytes, src_bytes + dest_bytes AS total_bytes,
  greatest(1, src_pkts + dest_pkts) AS packet_count, label AS ground_truth_label FROM checked WHERE len(errors) = 0""",
)
def read_eve(spark, sf):
    """Nested flow events."""
    path = shared_dir(spark, "eve")
    raw = A.raw_records(spark, sf)
    event = F.struct(
        F.col("ts").alias("timestamp"),
        F.lit("flow").alias("event_type"),
        F.col("Source IP").alias("src_ip"),
        F.col("sport").alias("src_port"),
        F.col("Destination IP").alias("dest_ip"),
        F.col("dport").alias("dest_port"),
        "proto",
        F.struct(
            F.col("sbytes").alias("bytes_toserver"),
            F.col("dbytes").alias("bytes_toclient"),
            F.col("spkts").alias("pkts_toserver"),
            F.col("dpkts").alias("pkts_toclient"),
            F.col("dur").alias("age"),
        ).alias("flow"),
        F.struct(F.col("class").alias("signature")).alias("alert"),
    )
    raw.select(F.to_json(event).alias("value")).write.text(path)
    flows = valid_rows(files.read_flows(spark, path, as_of(), fmt="eve"))
    return _shown(flows).drop("info", "errors", "warnings")


_BROKEN = "CAST(split_part(client, '.', 4) AS INTEGER) % 50 = 7"


@query(
    "read_captures",
    W("packets", extra=f"""placed AS (SELECT *, row_number() OVER (PARTITION BY client ORDER BY us, pkt_id) - 1 AS n,
    count(*) OVER (PARTITION BY client) AS total FROM packets)""") + f"""SELECT 'pcap:' || client || '.pcap' AS source, n AS pkt_id,
  {iso("ts")} AS ts, CASE WHEN back THEN server ELSE client END AS src_ip, CASE WHEN back THEN client ELSE server END AS dest_ip,
  CASE WHEN back THEN 443 ELSE cport END AS src_port, CASE WHEN back THEN cport ELSE 443 END AS dest_port,
  flags AS tcp_flags, coalesce(len(request), 0) AS payload_bytes
FROM (SELECT *, CASE WHEN info IS NOT NULL THEN 'GET /' || substr(info, 16, len(info) - 27) || ' HTTP/1.1__Host: ' || substr(info, 12) || '____' END AS request
  FROM placed) WHERE NOT ({_BROKEN} AND n = total - 1)""",
)
def read_captures(spark, sf):
    """Captures made of the packets, one per client, read back packet by packet."""
    rows = captures.packets_of(A.capture_files(spark, sf))
    return rows.select(
        "source", "pkt_id", iso_text(F.col("ts")).alias("ts"), "src_ip", "dest_ip", "src_port", "dest_port", "tcp_flags",
        F.coalesce(F.length("payload"), F.lit(0)).cast("long").alias("payload_bytes"),
    )


@query(
    "capture_errors",
    W("packets") + f"""SELECT 'pcap:' || client || '.pcap' AS source, count(*) - 1 AS packets, 'broken packet record' AS error
FROM packets WHERE {_BROKEN} GROUP BY client""",
)
def capture_errors(spark, sf):
    """The captures that are cut off, with the packets that could be read."""
    found = captures.errors_of(A.capture_files(spark, sf))
    return found.withColumn("error", F.regexp_replace("error", " at byte [0-9]+$", ""))


@query(
    "export_research",
    W("logs") + f"""SELECT id, {iso("timestamp")} AS timestamp, src_ip, dest_ip, src_port, dest_port, protocol, duration AS duration_sec,
  total_bytes, prediction_label AS label, confidence_score AS confidence, coalesce(info, '') AS l7_metadata, connection_state AS tcp_state
FROM logs WHERE protocol ILIKE '%http%' ORDER BY timestamp DESC, logs.id DESC LIMIT 5000""",
)
def export_research(spark, sf):
    return exports.research_rows(A.logs(spark, sf), protocol="http", limit=5000)


@query(
    "export_report",
    W("logs") + f"""SELECT id AS "ID", {iso("timestamp")} AS "Timestamp", src_ip AS "Source IP", dest_ip AS "Destination IP",
  src_port AS "Source Port", dest_port AS "Destination Port", protocol AS "Protocol", duration AS "Duration", total_bytes AS "Bytes",
  prediction_label AS "Label", confidence_score AS "Confidence", coalesce(info, '') AS "Metadata Context", source AS "Source",
  connection_state AS "TCP State" FROM logs ORDER BY logs.timestamp DESC, logs.id DESC LIMIT 1000""",
)
def export_report(spark, sf):
    return exports.report_rows(A.logs(spark, sf), limit=1000)


@query(
    "export_batch",
    W("logs") + f"""SELECT id, {iso("timestamp")} AS timestamp, src_ip, dest_ip, src_port, dest_port, protocol, duration AS duration_sec,
  total_bytes, prediction_label AS label, confidence_score AS confidence, coalesce(info, '') AS info, import_batch_id
FROM logs WHERE import_batch_id = 2""",
)
def export_batch(spark, sf):
    """Written as CSV and read back."""
    path = shared_dir(spark, "export")
    rows = exports.batch_rows(A.logs(spark, sf), 2)
    exports.write_csv(rows, path)
    return spark.read.schema(rows.schema).csv(path, header=True, escape='"')


@query(
    "batch_summary",
    W("norm", "watch", extra=P._CHECKED + """,
  v AS (SELECT c.*, s.value IS NOT NULL OR d.value IS NOT NULL OR EXISTS (SELECT 1 FROM watch w WHERE w.entry_type = 'domain'
      AND contains(lower(c.info), lower(w.value))) AS hit FROM checked c
    LEFT JOIN (SELECT DISTINCT value FROM watch WHERE entry_type = 'ipv4') s ON s.value = c.src_ip
    LEFT JOIN (SELECT DISTINCT value FROM watch WHERE entry_type = 'ipv4') d ON d.value = c.dest_ip WHERE len(errors) = 0)""")
    + """SELECT 7 AS id, (SELECT count(*) FROM checked) AS record_count, count(*) AS valid_count,
  (SELECT count(*) FROM checked WHERE len(errors) > 0) AS invalid_count, count(*) FILTER (len(warnings) > 0) AS warning_count,
  count(*) FILTER (NOT hit) AS normal_count, count(*) FILTER (hit) AS suspicious_count, 0 AS malicious_count, 0 AS anomaly_count,
  count(*) FILTER (hit) AS watchlist_matches, count(*) FILTER (hit) AS alerts_count FROM v""",
)
def batch_summary(spark, sf):
    """An import without classifier and profile: labels come from the watchlist alone."""
    normalized = P._normalized(spark, sf).withColumnRenamed("row_id", files.ROW_ID)
    done = importer.run_batch(normalized, A.watchlist(spark, sf), None, batch_id=7, can_classify=False, can_profile=False)
    return done.summary


_HIT = """s.value IS NOT NULL OR d.value IS NOT NULL OR EXISTS (SELECT 1 FROM watch w WHERE w.entry_type = 'domain'
      AND contains(lower(c.info), lower(w.value)))"""
_HITS = f"""v AS (SELECT c.*, {_HIT} AS hit FROM checked c LEFT JOIN (SELECT DISTINCT value FROM watch WHERE entry_type = 'ipv4') s ON s.value = c.src_ip
    LEFT JOIN (SELECT DISTINCT value FROM watch WHERE entry_type = 'ipv4') d ON d.value = c.dest_ip WHERE len(errors) = 0)"""


@query(
    "import_two_batches",
    W("norm", "watch", extra=P._CHECKED + f""",
  {_HITS}""") + """SELECT 1 + row_id % 2 AS batch, (1 + row_id % 2) * 17592186044416 + row_id // 2 AS id, src_ip, dest_ip,
  coalesce(sport, 0) AS src_port, dport AS dest_port, 'Suspicious' AS label, 'High' AS threat_level, true AS has_log FROM v WHERE hit""",
)
def import_two_batches(spark, sf):
    """Two imports with the same row numbers, stored, and their alerts with the logs they belong to."""
    store = tables.Tables().prefixed(f"two_{uuid.uuid4().hex[:8]}_")
    entries = A.watchlist(spark, sf)
    for batch in (1, 2):
        normalized = P._normalized(spark, sf).where(F.col("row_id") % 2 == batch - 1)
        normalized = normalized.withColumn(files.ROW_ID, F.floor(F.col("row_id") / 2)).drop("row_id")
        importer.run_batch(normalized, entries, None, batch_id=batch, mode="historical", can_classify=False, can_profile=False, store=store)
    alerts = spark.table(store.alerts)
    listed = al.with_context(alerts, spark.table(store.logs), A.device_directory(spark, sf))
    batch = alerts.select("id", F.col("import_batch_id").alias("batch"))
    return listed.join(batch, "id").select("batch", "id", "src_ip", "dest_ip", "src_port", "dest_port", "label", "threat_level", "has_log")


@query(
    "import_two_captures",
    f"""SELECT b AS batch, src_ip, dest_ip, src_port, dest_port, last_seen, 1 AS logs_of_id, b AS batch_of_id
FROM ({P.FLOW_SESSIONS_SQL}) f, (VALUES (1), (2)) t(b)""",
)
def import_two_captures(spark, sf):
    """The same packets imported twice and stored: every id stands for one log of one batch."""
    store = tables.Tables().prefixed(f"cap_{uuid.uuid4().hex[:8]}_")
    packets, none = A.packets(spark, sf), spark.createDataFrame([], "source string, packets long, error string")
    for batch in (1, 2):
        importer.import_capture(
            spark, "", A.watchlist(spark, sf), batch_id=batch, mode="historical", classifier=P.FOREST, timeout=P._GAP, packets=packets, errors=none, store=store
        )
    logs = spark.table(store.logs)
    ids = logs.groupBy("id").agg(F.count(F.lit(1)).alias("logs_of_id"), F.shiftright(F.min("id"), importer.NUMBER_BITS).alias("batch_of_id"))
    return logs.join(ids, "id").select(
        F.col("import_batch_id").alias("batch"), "src_ip", "dest_ip", "src_port", "dest_port",
        iso_text(F.col("timestamp")).alias("last_seen"), "logs_of_id", "batch_of_id",
    )


_TRUTH = """CASE WHEN label IN ('BENIGN', '0') THEN 'Normal' WHEN label IN ('PortScan', 'ddos') THEN 'Malicious' WHEN label = 'Probe' THEN 'Suspicious' END"""


@query(
    "import_evaluation_fixed",
    W("norm", extra=f"{P._CHECKED},\n  {P.IMPORTED_SQL}") + f"""SELECT t.x AS truth, p.x AS predicted,
  (SELECT count(*) FROM named WHERE {_TRUTH} = t.x AND prediction_label = p.x) AS n
FROM (VALUES ('Normal'), ('Suspicious'), ('Malicious')) t(x), (VALUES ('Normal'), ('Suspicious'), ('Malicious')) p(x)""",
)
def import_evaluation_fixed(spark, sf):
    """An import with classifier and profile, labelled by a forest that SQL can state, against its ground truth."""
    normalized = P._normalized(spark, sf).withColumnRenamed("row_id", files.ROW_ID)
    done = importer.run_batch(normalized, A.watchlist(spark, sf), P.FOREST, batch_id=7, mode="analyze_only")
    return evaluate.confusion(done.logs, "ground_truth_label", "prediction_label")


@query("import_evaluation")
def import_evaluation(spark, sf):
    """An import labelled by the classifier and compared with its ground truth."""
    normalized = P._normalized(spark, sf).withColumnRenamed("row_id", files.ROW_ID)
    done = importer.run_batch(normalized, A.watchlist(spark, sf), model.train_baseline(spark), batch_id=7)
    return evaluate.confusion(done.logs, "ground_truth_label", "prediction_label")

"""Registered queries: the streaming forms, run over the whole table until nothing is left.

They have the same checking SQL as their batch forms.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from .. import adapters as A
from ..functions.values import iso_text, micros
from ..operators import alerts as al
from ..operators import model
from ..session import shared_dir
from ..sources.ranges import listed
from ..sources.streams import stream_table
from ..streaming import state
from ..streaming.flows import build_flows_stream
from ..streaming.run import drain as drain_stream
from ..streaming.run import state_partitions, to_folder
from . import live
from . import pipeline_queries as P
from .oracle_views import iso, with_views
from .registry import query


def drain(spark, stream, name):
    """As many state stores as the session has cores: the test tables are small."""
    return drain_stream(spark, stream, name, spark.sparkContext.defaultParallelism)


#: The events arrive in so many micro-batches, each dealt over files of about so many rows.
PARTS, FILE_ROWS = 4, 250_000


#: Rows of the keyed streams arrive up to so many seconds late, so files overlap in time.
LATE = 6 * 3600
#: Nobody's events far behind all others: they only move the clock. The number is far below those of users.
CLOCK_USER, CLOCK_DAYS = -(1 << 62), 3


def _stream(spark, sf, late: int = 0):
    """The events as a stream of several micro-batches, their rows in any order.

    Rows arrive up to ``late`` seconds after their time. Then a last file moves the clock, with an event of each kind.
    """
    events = A.table(spark, sf, "events")
    us = micros(F.col("ts"))
    n, low, high = events.agg(F.count(F.lit(1)), F.min(us), F.max(us)).head()
    files = 1 + n // (PARTS * FILE_ROWS)
    out = shared_dir(spark, "events")
    step = ((high or 0) - (low or 0) + late * 1_000_000) // PARTS + 1
    arrival = us - F.lit(low) + F.pmod(F.xxhash64("event_id"), F.lit(max(1, late * 1_000_000)))
    for i in range(PARTS):
        part = events.where(F.floor(arrival / F.lit(step)) == i)
        part.repartition(files).sortWithinPartitions(F.xxhash64("event_id")).write.mode("append").parquet(out)
        # A micro-batch takes so many files: had it those of two parts, rows of the second would come too late.
        for _ in range(files * (i + 1) - listed(spark, out).count()):
            events.limit(0).write.mode("append").parquet(out)
    if late:
        kinds = events.groupBy("event_type").agg(F.max("event_id").alias("event_id"), F.first("value").alias("value"), F.first("props").alias("props"))
        last = F.timestamp_micros(F.lit((high or 0) + CLOCK_DAYS * 86_400_000_000)).cast(events.schema["ts"].dataType)
        clock = kinds.withColumn("ts", last).withColumn("user_id", F.lit(CLOCK_USER).cast("long"))
        clock.select(*[F.col(f.name).cast(f.dataType) for f in events.schema]).coalesce(1).write.mode("append").parquet(out)
    return stream_table(spark, out, events.schema, files_per_trigger=files)


def _told(rows, key):
    """The rows of others than the clock."""
    return rows.where(F.col(key) != A.host_ip(F.lit(CLOCK_USER)))


_DELAY = f"{LATE} seconds"
_DELAY_MS = 60_000
_CLOSED = f"last_us + {P._GAP}000000 - 1 <= ((SELECT max(us) FROM packets) // 1000 - {_DELAY_MS}) * 1000"


@query("stream_flows", P.FLOW_SESSIONS_SQL + f" WHERE {_CLOSED}")
def stream_flows(spark, sf):
    """Flows closed by the watermark; those still open at the end of the data are kept back."""
    packets = A.packets_of(_stream(spark, sf))
    flows = build_flows_stream(packets, P._GAP, f"{_DELAY_MS // 1000} seconds", decode="http")
    return P.flow_session_columns(drain(spark, flows, "stream-flows"))


@query("stream_incidents", P.ALERT_INCIDENTS_SQL)
def stream_incidents(spark, sf):
    rows = state.timeline(A.alert_events_of(_stream(spark, sf, LATE)), A.alert_actions_of(_stream(spark, sf, LATE)))
    changes = _told(drain(spark, state.incidents_stream(rows, _DELAY), "stream-incidents"), "device")
    out = state.present_incidents(changes).drop("notes", "log_id", "device_id")
    return out.withColumn("alert_time", iso_text(F.col("alert_time"))).withColumn("last_seen", iso_text(F.col("last_seen")))


@query("stream_alerts", P.STORED_ALERTS_SQL)
def stream_alerts(spark, sf):
    """Two detectors to stored events, and these to alerts with notes and logs, micro-batch by micro-batch."""
    out = shared_dir(spark, "stream-alerts")
    events = P.explained(A.alert_events_of(_stream(spark, sf, LATE)))
    with state_partitions(spark, spark.sparkContext.defaultParallelism):
        detectors = [
            live.run_arp(A.arp_replies_of(_stream(spark, sf, LATE)), out, delay=_DELAY, availableNow=True),
            to_folder(events, f"{out}/alert_events", f"{out}/events_checkpoint"),
        ]
        for running in detectors:
            running.awaitTermination()
        # Both detectors are read to their ends at once, as neither waits for the other.
        stored = live.stored_events(spark, out, ("alert_events", "arp_events"))
        for running in live.run_alerts(stored, out, delay=_DELAY, availableNow=True):
            running.awaitTermination()
    changes = _told(spark.read.parquet(f"{out}/alert_changes"), "device")
    return P.alert_columns(al.alert_rows(state.present_incidents(changes)))


@query("stream_notifications", P.NOTIFICATION_SQL)
def stream_notifications(spark, sf):
    events = A.alert_events_of(_stream(spark, sf, LATE))
    sent = state.rate_limit_stream(events, P.NOTIFY_SECONDS, ["threat_level", "device"], _DELAY)
    out = _told(drain(spark, sent, "stream-notifications"), "device")
    return out.select("threat_level", "device", iso_text(F.timestamp_micros("us")).alias("ts"), "id")


@query("stream_device_anomaly", P.DEVICE_ANOMALY_SQL)
def stream_device_anomaly(spark, sf):
    logs = P.loud(A.logs_of(_stream(spark, sf, LATE))).withColumn("packet_count", F.col("src_pkts") + F.col("dest_pkts"))
    out = _told(drain(spark, state.device_anomaly_stream(logs, delay=_DELAY), "stream-anomaly"), "src_ip")
    return out.select("id", "src_ip", "sample_no", "score", "is_anomalous", "status", "threat_level", "reason")


@query("stream_drift")
def stream_drift(spark, sf):
    rows = P.shifting_errors_of(A.predictions_of(_stream(spark, sf, LATE)))
    out = drain(spark, state.drift_stream(rows, "stream", "ts", F.col("wrong"), block_us=P.HOUR, delay_seconds=LATE), "stream-drift")
    return out.withColumn("timestamp", iso_text(F.col("timestamp")))


@query(
    "stream_rate_bins",
    with_views("logs") + f"""SELECT {iso("make_timestamp(epoch_us(timestamp) // 300000000 * 300000000)")} AS start, count(*) AS flows,
  CAST(sum(total_bytes) AS BIGINT) AS bytes FROM logs GROUP BY epoch_us(timestamp) // 300000000
HAVING (min(epoch_us(timestamp)) // 300000000 + 1) * 300000000 <= ((SELECT max(epoch_us(timestamp)) FROM logs) // 1000 - {_DELAY_MS}) * 1000""",
)
def stream_rate_bins(spark, sf):
    """Tumbling five-minute windows on the stream, emitted when the watermark has passed them."""
    logs = A.logs_of(_stream(spark, sf)).withWatermark("timestamp", f"{_DELAY_MS // 1000} seconds")
    bins = logs.groupBy(F.window("timestamp", "5 minutes").alias("w")).agg(
        F.count(F.lit(1)).alias("flows"), F.sum("total_bytes").alias("bytes")
    )
    out = drain(spark, bins.select(F.col("w.start").alias("start"), "flows", "bytes"), "stream-bins")
    return out.withColumn("start", iso_text(F.col("start")))


@query(
    "stream_labels_fixed",
    with_views("packets", extra=f"{P._FLOWS},\n  {P._FEATURES},\n  trees AS ({P.FOREST_SQL} FROM f),\n  {P.VOTED_SQL}")
    + f"""SELECT CASE WHEN opened_back THEN server ELSE client END AS src_ip, CASE WHEN opened_back THEN client ELSE server END AS dest_ip,
  CASE WHEN info IS NULL THEN 'TCP' ELSE 'HTTP' END AS protocol, sbytes + dbytes AS total_bytes, prediction_label, confidence_score
FROM named WHERE {_CLOSED}""",
)
def stream_labels_fixed(spark, sf):
    """Packet stream to labelled logs with a forest that SQL can state."""
    out = shared_dir(spark, "stream-labels")
    packets = A.packets_of(_stream(spark, sf))
    with state_partitions(spark, spark.sparkContext.defaultParallelism):
        live.run_stream(packets, P.FOREST, A.watchlist(spark, sf), out, timeout=P._GAP, decode="http", availableNow=True).awaitTermination()
    logs = spark.read.parquet(f"{out}/logs")
    return logs.select("src_ip", "dest_ip", "protocol", "total_bytes", "prediction_label", "confidence_score")


@query("stream_labels")
def stream_labels(spark, sf):
    """Packet stream to labelled logs: flows, classifier, watchlist, alerts."""
    out = shared_dir(spark, "stream-labels")
    packets = A.packets_of(_stream(spark, sf))
    fitted, entries = model.train_baseline(spark), A.watchlist(spark, sf)
    with state_partitions(spark, spark.sparkContext.defaultParallelism):
        live.run_stream(packets, fitted, entries, out, timeout=P._GAP, decode="http", availableNow=True).awaitTermination()
    logs = spark.read.parquet(f"{out}/logs")
    return logs.select("src_ip", "dest_ip", "protocol", "total_bytes", "prediction_label", "confidence_score", "watch_id", "connection_state")

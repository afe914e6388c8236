"""Alert events to alerts: union, incidents with a lifecycle, notification limits, lists."""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import verdicts
from ..functions.values import iso_text, micros, round_places
from .ordering import gap_sessions, in_parts, running_totals

SIGNATURE = ["threat_level", "alert_type", "device"]
SECOND = 1_000_000
# A page of up to so many rows may be sent to every task.
MOST_PAGE_ROWS = 10_000
EVENT_COLUMNS = [
    "id", "ts", "threat_level", "alert_type", "device", "src_ip", "dest_ip", "protocol",
    "is_simulated", "threat_type", "reason", "action", "context",
]


def union_events(*events: DataFrame) -> DataFrame:
    """One event table from all detectors; columns a detector lacks become null."""
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), events)


def flow_events(labelled: DataFrame) -> DataFrame:
    """Alert events of labelled flows (columns of a flow plus label and confidence)."""
    told = labelled.where(verdicts.is_threat(F.col("prediction_label"))).withColumn(
        "__x",
        verdicts.explanation(
            F.col("prediction_label"), F.col("sbytes"), F.col("splt_mean"), F.col("packet_count"), F.col("avg_pkt_size")
        ),
    )
    return told.select(
        "id",
        F.col("id").alias("log_id"),
        F.col("timestamp").alias("ts"),
        verdicts.live_level(F.col("prediction_label"), F.col("confidence_score")).alias("threat_level"),
        F.lit("flow_classification").alias("alert_type"),
        F.col("src_ip").alias("device"),
        "src_ip",
        "dest_ip",
        "protocol",
        verdicts.is_simulated(F.col("source")).alias("is_simulated"),
        "__x.threat_type",
        "__x.reason",
        "__x.action",
        F.col("info").alias("context"),
    )


def event_notes(events: DataFrame) -> DataFrame:
    names = ("is_simulated", "src_ip", "dest_ip", "protocol", "threat_type", "reason", "action", "context")
    return events.withColumn("notes", verdicts.note(*[F.col(n) for n in names]))


def incidents(events: DataFrame, actions: DataFrame) -> DataFrame:
    """Deduplicated alerts: one row per signature and incident.

    An incident collects all events of a signature up to the next resolve. Status: Resolved if one
    came; else Acknowledged once acknowledged; else Active from the second event on; else New.
    Events before actions at the same instant.

    Seconds without any action collapse to one row before anything is ordered, so an alert storm
    of one signature shrinks in the map-side aggregate. The incident number is a running count of
    resolves over parts of bounded size.

    If the events have ``notes``, ``log_id`` and ``device_id``, an alert has the note of its first event (marked
    once an event was simulated), the log of its last event with one, and that event's device.
    """
    none = {"notes": "string", "log_id": "long", "device_id": "long"}

    def extra(rows: DataFrame) -> list[Column]:
        return [F.col(c).cast(t) if c in rows.columns else F.lit(None).cast(t).alias(c) for c, t in none.items()]

    event_rows = events.select(
        *SIGNATURE, "ts", F.lit(0).alias("kind"), "id", F.lit(None).cast("string").alias("action"), "is_simulated", *extra(events)
    )
    action_rows = actions.select(
        *SIGNATURE, "ts", F.lit(1).alias("kind"), "id", "action", F.lit(False).alias("is_simulated"),
        *[F.lit(None).cast(t).alias(c) for c, t in none.items()],
    )
    logged = F.when(F.col("log_id").isNotNull(), F.struct("ts", "id", "log_id", "device_id"))
    second = F.floor(micros(F.col("ts")) / F.lit(SECOND))
    # Per second and signature: a quiet second has no action and needs no order inside.
    cells = (
        event_rows.unionByName(action_rows)
        .withColumn("__sec", second)
        # Rows of a second that share the instant and the kind are interchangeable.
        .groupBy(*SIGNATURE, "__sec", "ts", "kind", "action")
        .agg(
            F.count(F.lit(1)).alias("n"),
            F.min(F.struct("id", "notes")).alias("first"),
            F.max(logged).alias("logged"),
            F.max(F.col("is_simulated").cast("int")).alias("sim"),
        )
    )
    busy = (
        actions.select(*SIGNATURE, second.alias("__sec")).distinct().withColumn("__busy", F.lit(True))
    )
    cells = cells.join(busy, [*SIGNATURE, "__sec"], "left")
    point = F.when(F.col("__busy"), micros(F.col("ts")))  # null: the whole second is one point
    points = cells.groupBy(*SIGNATURE, "__sec", point.alias("__point"), "kind", "action").agg(
        F.sum("n").alias("n"),
        F.min(F.struct("ts", F.col("first.id").alias("first_id"), F.col("first.notes").alias("notes"))).alias("first"),
        F.max("logged").alias("logged"),
        F.max("ts").alias("last_seen"),
        F.max("sim").alias("sim"),
    )
    points = points.withColumn("ts", F.col("first.ts")).withColumn("first_id", F.col("first.first_id"))
    numbered = running_totals(
        points,
        SIGNATURE,
        ["ts", "kind", "first_id"],
        {"incident": F.coalesce(F.col("action") == "resolve", F.lit(False)).cast("long")},
        inclusive=False,
    )
    is_event = F.col("kind") == 0
    grouped = numbered.groupBy(*SIGNATURE, "incident").agg(
        F.coalesce(F.sum(F.when(is_event, F.col("n"))), F.lit(0)).alias("count"),
        F.min(F.when(is_event, F.col("first"))).alias("opening"),
        F.max(F.when(is_event, F.col("last_seen"))).alias("last_seen"),
        F.max(F.when(is_event, F.col("logged"))).alias("logged"),
        F.max(F.when(is_event, F.col("sim"))).alias("sim"),
        F.max(F.when(F.col("action") == "resolve", F.col("ts"))).alias("resolved_at"),
        # Acknowledging needs an open alert, that is one opened before.
        F.max(F.when(F.col("action") == "acknowledge", F.col("ts"))).alias("acknowledged_at"),
    )
    resolved = F.col("resolved_at").isNotNull()
    acked = F.col("acknowledged_at") >= F.col("opening.ts")
    return grouped.where(F.col("count") > 0).select(
        F.col("opening.first_id").alias("alert_id"),
        *SIGNATURE,
        "incident",
        F.col("opening.ts").alias("alert_time"),
        "last_seen",
        "count",
        F.when(resolved, "Resolved")
        .when(acked, "Acknowledged")
        .when(F.col("count") > 1, "Active")
        .otherwise("New")
        .alias("status"),
        resolved.alias("is_resolved"),
        (F.col("sim") == 1).alias("is_simulated"),
        verdicts.simulated_note(F.col("sim") == 1, F.col("opening.notes")).alias("notes"),
        F.col("logged.log_id").alias("log_id"),
        F.col("logged.device_id").alias("device_id"),
    )


def alert_rows(found: DataFrame, batch_id: int | None = None) -> DataFrame:
    """Incidents in the shape of the alerts table."""
    return found.select(
        F.col("alert_id").alias("id"),
        F.col("log_id").alias("traffic_log_id"),
        "device_id",
        F.lit(batch_id).cast("long").alias("import_batch_id"),
        "alert_type",
        "alert_time",
        "last_seen",
        "threat_level",
        "status",
        "is_simulated",
        "notes",
        "is_resolved",
        F.col("count").cast("long").alias("count"),
    )


def no_actions(events: DataFrame) -> DataFrame:
    """An empty table of actions, for events that nobody has acted on yet."""
    return events.where(F.lit(False)).select(*SIGNATURE, "ts", "id", F.lit(None).cast("string").alias("action"))


def apply_actions(alerts: DataFrame, actions: DataFrame) -> DataFrame:
    """Stored alerts after actions ``(alert_id, ts, action)``: the last one gives the status, a resolve stays.

    Actions on unknown alerts do nothing. Actions are few per alert and become one row before the join.
    """
    status = F.when(F.col("action") == "resolve", "Resolved").when(F.col("action") == "acknowledge", "Acknowledged")
    last = actions.where(F.col("action").isin("acknowledge", "resolve")).groupBy(F.col("alert_id").alias("id")).agg(
        F.max(F.struct("ts", status.alias("status"))).alias("__last"), F.bool_or(F.col("action") == "resolve").alias("__resolved")
    )
    joined = alerts.join(last, "id", "left")
    return joined.withColumns(
        {
            "status": F.coalesce("__last.status", "status"),
            "is_resolved": F.col("is_resolved") | F.coalesce("__resolved", F.lit(False)),
        }
    ).select(*alerts.columns)


def alert_windows(events: DataFrame, seconds: int = 30) -> DataFrame:
    """Alerts of a signature that follow each other within ``seconds`` become one row."""
    sessions = gap_sessions(
        events, SIGNATURE, "ts", seconds * SECOND, {"count": (F.count(F.lit(1)), F.sum)}
    )
    return sessions.select(
        *SIGNATURE,
        F.timestamp_micros("__first").alias("first_seen"),
        F.timestamp_micros("__last").alias("last_seen"),
        "count",
    )


# --- notification limit -------------------------------------------------------------------------

NOTIFY_KEY = ["src_ip", "dest_ip", "protocol", "threat_level"]


def _after(times: np.ndarray, gap: int) -> np.ndarray:
    """For each time the place of the next one that may be sent."""
    return np.searchsorted(times, times + gap, side="left")


def _exits(times: np.ndarray, gap: int) -> np.ndarray:
    """For each time, taken as sent, the last time sent in the same chunk: steps of 1, 2, 4 ... sendings."""
    n = len(times)
    steps = [np.append(_after(times, gap), n)]
    while (steps[-1][:n] < n).any():
        steps.append(steps[-1][steps[-1]])
    at = np.arange(n)
    for step in reversed(steps):
        ahead = step[at]
        at = np.where(ahead < n, ahead, at)
    return times[at]


def _groups(batch: pa.RecordBatch) -> Iterator[tuple[tuple, int, int]]:
    """Key and part of the stretches of equal ones in a batch in order, with their first and last place."""
    key, part = batch.column("__key").to_numpy(zero_copy_only=False), batch.column("__part").to_numpy()
    turns = np.flatnonzero((key[1:] != key[:-1]) | (part[1:] != part[:-1])) + 1
    edges = [0, *turns.tolist(), len(part)]
    for a, b in zip(edges[:-1], edges[1:]):
        if b > a:
            yield (key[a], int(part[a])), a, b


def _effects(gap: int):
    """Per (key, part) what it does to the last time sent, as lines (first, last): if the first time sent in the part is
    ``first`` or, after the line before, an earlier one, the last one is ``last``. One part is held at a time."""

    def lines(group: tuple, times: np.ndarray) -> pa.RecordBatch:
        # An earlier part sends before this one begins, so no later start than this is possible.
        starts = int(np.searchsorted(times, times[0] + gap, side="left")) + 1
        last = _exits(times, gap)[:starts]
        keep = np.append(np.diff(last) != 0, True)
        n = int(keep.sum())
        columns = [pa.array([group[0]] * n, pa.string()), pa.array([group[1]] * n, pa.int32()), pa.array(times[:starts][keep]), pa.array(last[keep])]
        return pa.RecordBatch.from_arrays(columns, ["__key", "__part", "first", "last"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        current, held = None, []
        for batch in batches:
            us = batch.column("us").to_numpy()
            for group, a, b in _groups(batch):
                if group != current and held:
                    yield lines(current, np.concatenate(held))
                    held = []
                current = group
                held.append(us[a:b])
        if held:
            yield lines(current, np.concatenate(held))

    return run


def _entries(gap: int):
    """Walk the lines of all parts of a key in order; the last time sent is the only state. Gives it as each part begins."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        current, sent, after, found = (None, None), None, None, True
        for batch in batches:
            first, last = batch.column("first").to_numpy(), batch.column("last").to_numpy()
            out = []
            for group, a, b in _groups(batch):
                if group != current:
                    sent = after if group[0] == current[0] else None
                    current, after, found = group, sent, False
                    out.append((*group, sent))
                if not found:
                    at = a if sent is None else a + int(np.searchsorted(first[a:b], sent + gap, side="left"))
                    if at < b:
                        after, found = int(last[at]), True
            key, part, entry = zip(*out) if out else ((), (), ())
            columns = [pa.array(key, pa.string()), pa.array(part, pa.int32()), pa.array(entry, pa.int64())]
            yield pa.RecordBatch.from_arrays(columns, ["__key", "__part", "__entry"])

    return run


def _picks(gap: int):
    """The rows that are sent, part by part, from the last time sent before each."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        current, sent = None, None
        for batch in batches:
            us, entry = batch.column("us").to_numpy(), batch.column("__entry")
            picks = []
            for group, a, b in _groups(batch):
                if group != current:
                    current, sent = group, entry[a].as_py()
                times = us[a:b]
                following = _after(times, gap)
                at = 0 if sent is None else int(np.searchsorted(times, sent + gap, side="left"))
                while at < b - a:
                    picks.append(a + at)
                    sent, at = int(times[at]), int(following[at])
            yield batch.take(pa.array(picks, pa.int64()))

    return run


def rate_limit(events: DataFrame, seconds: float = 2.0, keys: list[str] | None = None) -> DataFrame:
    """Events that are sent out: per key none within ``seconds`` after the last one sent.

    Which event is sent depends on the one sent before, all the way back. What a stretch of time does to that state is
    a map from the first time sent in it to the last one, and such maps can be strung together. So the instants are
    cut into parts of bounded size by key and time (`in_parts`), wherever that falls in a hot key; every part gives its
    map; these are walked in order of key and time; then all parts are finished side by side. Equal instants of a key
    count once, with the smallest id. Null keys are keys; no events, no rows.
    """
    keys = keys or NOTIFY_KEY
    gap = round(seconds * 1e6)
    points = events.groupBy(*keys, micros(F.col("ts")).alias("us")).agg(F.min("id").alias("id"))
    # One text stands for the key, so that rows of a null key meet as well.
    parts = in_parts(points.withColumn("__key", F.md5(F.to_json(F.struct(*keys)))), ["__key"], ["us"], "rate-limit")
    by = ["__key", "__part"]
    effects = parts.select(*by, "us").repartition(*by).sortWithinPartitions(*by, "us")
    effects = effects.mapInArrow(_effects(gap), "__key string, __part int, first long, last long")
    effects = effects.repartition("__key").sortWithinPartitions(*by, "first")
    entries = effects.mapInArrow(_entries(gap), "__key string, __part int, __entry long")
    ready = parts.join(entries, by).repartition(*by).sortWithinPartitions(*by, "us")
    sent = ready.mapInArrow(_picks(gap), ready.schema)
    return sent.select(*keys, F.timestamp_micros("us").alias("ts"), "id")


# --- lists --------------------------------------------------------------------------------------


def with_status(alerts: DataFrame, status: str = "all") -> DataFrame:
    """Lifecycle filter by name."""
    open_ = ~F.col("is_resolved")
    rules: dict[str, Column] = {
        "all": F.lit(True),
        "active": open_ & F.col("status").isin("Active", "New"),
        "new": open_ & (F.col("status") == "New"),
        "acknowledged": open_ & (F.col("status") == "Acknowledged"),
        "resolved": F.col("is_resolved"),
        "unresolved": open_,
    }
    return alerts.where(rules.get(status.lower(), F.lit(True)))


def with_context(alerts: DataFrame, logs: DataFrame, devices: DataFrame) -> DataFrame:
    """Alerts with the columns of their log, or the device's address, or fixed defaults."""
    log = logs.select(
        F.col("id").alias("__log"),
        F.col("src_ip").alias("__src"),
        F.col("dest_ip").alias("__dest"),
        F.col("src_port").alias("__sport"),
        F.col("dest_port").alias("__dport"),
        F.col("protocol").alias("__proto"),
        F.col("prediction_label").alias("__label"),
        F.col("confidence_score").alias("__conf"),
    )
    device = devices.select(F.col("id").alias("__dev"), F.col("device_ip").alias("__ip"))
    # Alerts without a log (or device) get a key of their own that matches nothing: no null pile.
    by_log = F.coalesce("traffic_log_id", -1 - F.col("id")) == F.col("__log")
    by_device = F.coalesce("device_id", -1 - F.col("id")) == F.col("__dev")
    joined = alerts.join(log, by_log, "left").join(device, by_device, "left")
    has_log = F.col("__log").isNotNull()
    shown = F.when(has_log, F.col("__src")).otherwise(F.coalesce("__ip", F.lit("Unknown")))
    return joined.select(
        "id",
        "alert_time",
        F.coalesce("last_seen", "alert_time").alias("last_seen"),
        shown.alias("src_ip"),
        F.coalesce("__dest", F.lit("Internal")).alias("dest_ip"),
        F.coalesce("__sport", F.lit(0)).alias("src_port"),
        F.coalesce("__dport", F.lit(0)).alias("dest_port"),
        F.coalesce("__proto", F.lit("IP")).alias("protocol"),
        F.coalesce("__label", F.lit("Suspicious")).alias("label"),
        "threat_level",
        "status",
        F.coalesce("count", F.lit(1)).alias("count"),
        "alert_type",
        "is_simulated",
        round_places(F.coalesce("__conf", F.lit(0.85)), 2).alias("confidence"),
        "is_resolved",
        "notes",
        has_log.alias("has_log"),
    )


def list_alerts(
    alerts: DataFrame, logs: DataFrame, devices: DataFrame, status: str = "all", limit: int = 150, offset: int = 0
) -> DataFrame:
    """A page of alerts, last seen first. The page is cut before anything is joined, and only its logs and devices
    are looked up: the keys of a page, at most ``limit`` of them, go to the tables, which stay where they are."""
    page = (
        with_status(alerts, status)
        .orderBy(F.coalesce("last_seen", "alert_time").desc(), F.col("id").desc())
        .offset(offset)
        .limit(limit)
    )
    return (
        with_context(page, looked_up(logs, page, "traffic_log_id", limit), looked_up(devices, page, "device_id", limit))
        .withColumn("first_seen", iso_text(F.col("alert_time")))
        .withColumn("last_seen", iso_text(F.col("last_seen")))
        .drop("alert_time", "has_log")
    )


def looked_up(table: DataFrame, page: DataFrame, key: str, limit: int) -> DataFrame:
    """Rows of a large table whose id a page of at most ``limit`` rows names; at most that many."""
    keys = page.where(F.col(key).isNotNull()).select(F.col(key).alias("__key")).distinct()
    keys = F.broadcast(keys) if limit <= MOST_PAGE_ROWS else keys
    return table.join(keys, F.col("id") == F.col("__key"), "left_semi")


def report_threats(alerts: DataFrame, logs: DataFrame, limit: int = 8) -> DataFrame:
    """Newest open Critical and High alerts with their flow, and the report line."""
    wanted = alerts.where(~F.col("is_resolved") & F.col("threat_level").isin("Critical", "High"))
    # Deleting a log deletes its alerts, so an alert with a log id has its log.
    newest = wanted.where(F.col("traffic_log_id").isNotNull()).orderBy(F.col("alert_time").desc(), F.col("id").desc()).limit(limit)
    log = logs.select(
        F.col("id").alias("traffic_log_id"), "src_ip", "src_port", "dest_ip", "dest_port", "protocol"
    )
    top = log.join(F.broadcast(newest) if limit <= MOST_PAGE_ROWS else newest, "traffic_log_id")
    line = F.format_string(
        "[%s] Severity: %s | Src: %s:%d -> Dst: %s:%d | Proto: %s | Count: %d\nNotes: %s",
        F.date_format("alert_time", "yyyy-MM-dd HH:mm:ss"),
        "threat_level",
        "src_ip",
        "src_port",
        "dest_ip",
        "dest_port",
        "protocol",
        F.coalesce("count", F.lit(1)),
        F.coalesce("notes", F.lit("N/A")),
    )
    return top.select("id", "threat_level", "src_ip", "dest_ip", "protocol", line.alias("line"))


def filter_alerts(listed: DataFrame, ip: str = "", severity: str = "all") -> DataFrame:
    """Address part in either end, severity without regard to case."""
    out = listed
    if ip:
        part = ip.lower()
        out = out.where(F.lower("src_ip").contains(part) | F.lower("dest_ip").contains(part))
    if severity != "all":
        out = out.where(F.lower("threat_level") == severity.lower())
    return out


def severity_tally(listed: DataFrame) -> DataFrame:
    """Alert counts by severity; everything below High goes to the medium bucket."""
    level, n = F.lower("threat_level"), F.coalesce("count", F.lit(1))
    arp = (F.col("protocol") == "ARP") | F.coalesce(F.col("notes").contains("ARP"), F.lit(False))

    def total(rule: Column) -> Column:
        return F.coalesce(F.sum(F.when(rule, n)), F.lit(0))

    return listed.agg(
        total(level == "critical").alias("critical"),
        total(level == "high").alias("high"),
        total(~level.isin("critical", "high")).alias("medium"),
        F.coalesce(F.bool_or(arp), F.lit(False)).alias("arp_spoofing"),
    )


def open_alerts(alerts: DataFrame) -> DataFrame:
    """The open alert of each signature, for looking up where a new event belongs."""
    return (
        alerts.where(~F.col("is_resolved"))
        .groupBy(*SIGNATURE)
        .agg(F.min(F.struct("alert_time", "alert_id")).alias("open"))
        .select(*SIGNATURE, F.col("open.alert_id").alias("alert_id"), F.col("open.alert_time").alias("alert_time"))
    )



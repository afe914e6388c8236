"""Foreign files to labelled flows, alerts and a batch summary."""

from __future__ import annotations

import json
from collections.abc import Mapping
from dataclasses import dataclass
from datetime import datetime, timezone

from pyspark.ml import Model
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import values, verdicts
from ..operators import alerts as al
from ..operators import anomaly, drift, evaluate, flows, model, normalize, ordering, watchlist
from ..sinks import tables
from ..sources import captures, files, indicators
from . import live

MODES = ("analyze_only", "historical", "replay", "label_eval")


@dataclass
class Import:
    """Frames of one import; all lazy unless the mode stored them."""

    logs: DataFrame
    alerts: DataFrame
    summary: DataFrame
    rejections: DataFrame
    confusion: DataFrame | None = None
    metrics: DataFrame | None = None
    drifts: DataFrame | None = None


def label_flows(flows: DataFrame, entries: DataFrame, classifier: Model, can_classify: bool) -> DataFrame:
    """Watchlist hit, label and confidence of normalised flows."""
    matched = watchlist.attach_entry(watchlist.match_watchlist(flows, entries), entries)
    hit, eligible = F.col("watch_id").isNotNull(), normalize.can_classify(can_classify)
    if not can_classify:  # the model is not asked at all
        nothing = F.lit(None)
        rule = model.label_rule(hit, F.lit(False), nothing.cast("string"), nothing.cast("double"))
        return matched.select("*", *rule)
    names = ["sbytes", "dbytes", "proto_id"]
    with_inputs = matched.select(
        "*",
        F.col("src_bytes").cast("double").alias("sbytes"),
        F.col("dest_bytes").cast("double").alias("dbytes"),
        F.col("proto_num").alias("proto_id"),
    )
    told = model.classify(with_inputs, classifier)
    told = told.withColumnsRenamed({"prediction_label": "__label", "confidence_score": "__conf"})
    rule = model.label_rule(hit, eligible, F.col("__label"), F.col("__conf"))
    return told.select("*", *rule).drop("__label", "__conf", *names)


#: Ids of logs: the import batch and a number of up to 44 bits within it, or bit 62, the epoch and a number within it.
NUMBER_BITS, LOG_NUMBER = 44, "__log_number"


def log_id(batch_id: int, number: Column) -> Column:
    """Id of a log, unique over all batches: batch and number within the batch (`ordering.dense_places`, `ordering.numbered`)."""
    if not 0 <= batch_id < 1 << (62 - NUMBER_BITS):
        raise ValueError(f"batch ids go up to 2**{62 - NUMBER_BITS}")
    return F.lit(batch_id << NUMBER_BITS) + number


def log_rows(labelled: DataFrame, batch_id: int, source: str) -> DataFrame:
    """Traffic-log rows; a watchlist hit without any info text becomes the info."""
    hit_text = F.when(F.col("watch_id").isNotNull(), F.concat(F.lit("Watchlist Match: "), F.col("watch_value")))
    return labelled.select(
        log_id(batch_id, F.col(LOG_NUMBER)).alias("id"),
        "timestamp",
        "src_ip",
        "dest_ip",
        "src_port",
        "dest_port",
        "protocol",
        F.floor("duration").alias("duration"),
        "total_bytes",
        "packet_count",
        "prediction_label",
        "confidence_score",
        F.coalesce(F.nullif(F.col("info"), F.lit("")), hit_text, F.lit("")).alias("info"),
        F.lit(source).alias("source"),
        F.lit("N/A").alias("connection_state"),
        F.lit(batch_id).cast("long").alias("import_batch_id"),
        "watch_id",
        "ground_truth_label",
        (F.size("warnings") > 0).alias("has_warning"),
    )


def alert_rows(logs: DataFrame) -> DataFrame:
    """Alerts of imported flows, raised by the watchlist hit itself or by a threat label."""
    hit = F.col("watch_id").isNotNull()
    kind = verdicts.import_threat_type(hit)
    note = verdicts.import_note(*[F.col("import_batch_id"), kind, F.col("src_ip"), F.col("dest_ip"), F.col("protocol"), F.col("info")])
    return logs.where(hit | verdicts.is_threat(F.col("prediction_label"))).select(
        "id",
        F.col("id").alias("traffic_log_id"),
        F.lit(None).cast("long").alias("device_id"),
        "import_batch_id",
        verdicts.import_alert_type(hit).alias("alert_type"),
        F.col("timestamp").alias("alert_time"),
        F.col("timestamp").alias("last_seen"),
        verdicts.import_level(hit, F.col("prediction_label")).alias("threat_level"),
        F.lit("New").alias("status"),
        F.lit(False).alias("is_simulated"),
        note.alias("notes"),
        F.lit(False).alias("is_resolved"),
        F.lit(1).cast("long").alias("count"),
    )


def batch_summary(logs: DataFrame, rejected: DataFrame, anomalies: DataFrame | None, batch_id: int) -> DataFrame:
    """One row of counters. The rejected rows and anomalies come in as scalar subqueries."""

    def n(rule: Column) -> Column:
        return F.count_if(rule)

    label = F.col("prediction_label")
    hit = F.col("watch_id").isNotNull()
    sums = logs.agg(
        F.count(F.lit(1)).alias("valid_count"),
        n(F.col("has_warning")).alias("warning_count"),
        n(label == "Normal").alias("normal_count"),
        n(label == "Suspicious").alias("suspicious_count"),
        n(label == "Malicious").alias("malicious_count"),
        n(hit).alias("watchlist_matches"),
        n(hit | verdicts.is_threat(label)).alias("alerts_count"),
    )
    invalid = rejected.agg(F.count(F.lit(1))).scalar()
    odd = F.lit(0) if anomalies is None else anomalies.agg(F.count_if("is_anomalous")).scalar()
    return sums.select(
        F.lit(batch_id).cast("long").alias("id"),
        "*",
        invalid.alias("invalid_count"),
        odd.cast("long").alias("anomaly_count"),
        (F.col("valid_count") + invalid).alias("record_count"),
    )


def run_batch(
    normalized: DataFrame,
    entries: DataFrame,
    classifier: Model,
    *,
    batch_id: int,
    mode: str = "analyze_only",
    name: str = "",
    can_classify: bool = True,
    can_profile: bool = True,
    isolate_profile: bool = False,
    record: DataFrame | None = None,
    store: tables.Tables = tables.Tables(),
) -> Import:
    """Label normalised rows. ``analyze_only`` stores nothing; the other modes store logs and alerts
    and then count what was stored, so the work is done once. ``record`` has one row with what is known
    of the file (`file_record`) for the batch table."""
    if mode not in MODES:
        raise ValueError(f"mode must be one of {MODES}")
    spark = normalized.sparkSession
    valid = normalize.valid_rows(ordering.dense_places(normalized, files.ROW_ID, LOG_NUMBER))
    rejected = normalize.rejected_rows(normalized)
    source = f"replay:{name}" if mode == "replay" else f"import:{batch_id}"
    logs = log_rows(label_flows(valid, entries, classifier, can_classify), batch_id, source)
    alerts = alert_rows(logs)
    if mode != "analyze_only":
        logs, alerts = store_batch(spark, logs, alert_rows, batch_id, store)
    scored = anomaly.device_anomaly(logs) if can_profile and not isolate_profile else None
    out = Import(logs, alerts, batch_summary(logs, rejected, scored, batch_id), normalize.rejections(normalized, files.ROW_ID))
    if mode == "label_eval":
        out.confusion = evaluate.confusion(logs, "ground_truth_label", "prediction_label")
        out.metrics = evaluate.eval_metrics(logs, "ground_truth_label", "prediction_label")
    if mode != "analyze_only":
        tables.append_metrics(drift_events(logs, batch_id), store.metrics)
        own = F.col("import_batch_id") == batch_id
        out.drifts = spark.table(store.metrics).where(own)
        tables.append_batch(batch_record(out, name, mode, record), store.batches)
    return out


def drift_events(logs: DataFrame, batch_id: int) -> DataFrame:
    """Where the labels of a batch began to fit their ground truth better or worse, in the order of time, as metrics rows."""
    truth = values.ground_truth(F.col("ground_truth_label"))
    told = logs.where(truth.isNotNull() & F.col("prediction_label").isNotNull())
    wrong = truth != F.col("prediction_label")
    cuts = drift.drift_points(told, "import_batch_id", "timestamp", wrong)
    return cuts.select("timestamp", "accuracy", "drift_detected", "samples_processed", F.lit(batch_id).cast("long").alias("import_batch_id"))


def store_batch(spark: SparkSession, logs: DataFrame, alerts_of, batch_id: int, store: tables.Tables) -> tuple[DataFrame, DataFrame]:
    """Store the logs, then the alerts made of the stored logs; both as read back."""

    def own(name: str) -> DataFrame:
        return spark.table(name).where(F.col("import_batch_id") == batch_id).drop("log_date")

    tables.append_logs(logs, store.logs)
    tables.append_alerts(alerts_of(own(store.logs)), store.alerts)
    return own(store.logs), own(store.alerts)


def batch_record(done: Import, name: str, mode: str, record: DataFrame | None) -> DataFrame:
    """The row of the batch table: counters, file, mapping, capabilities, evaluation and times."""
    none = F.lit(None).cast("string")
    evaluation = none
    if done.metrics is not None:
        cells = F.map_from_entries(F.array_sort(F.collect_list(F.struct(F.concat_ws("/", "truth", "predicted"), "n"))))
        matrix = done.confusion.agg(F.to_json(cells)).scalar()
        body = done.metrics.select(F.to_json(F.struct("*", matrix.alias("confusion_matrix"))).alias("j"))
        evaluation = body.agg(F.max("j")).scalar()

    def of_file(column: str) -> Column:
        value = F.lit(None) if record is None else record.agg(F.max(column)).scalar()
        return value.cast(FILE_RECORD[column]).alias(column)

    started = F.lit(None).cast("timestamp") if record is None else record.agg(F.max("started_at")).scalar()
    return done.summary.select(
        "*",
        (F.lit(0) if done.drifts is None else done.drifts.agg(F.count(F.lit(1))).scalar()).cast("long").alias("drift_count"),
        F.lit(name).alias("dataset_name"),
        F.lit(mode).alias("analysis_mode"),
        F.lit("completed").alias("status"),
        *[of_file(c) for c in FILE_RECORD],
        evaluation.alias("eval_metrics_json"),
        F.current_timestamp().alias("completed_at"),
        F.round((F.unix_millis(F.current_timestamp()) - F.unix_millis(started)) / 1000.0, 2).alias("duration_sec"),
    )


#: What the batch table keeps of a file.
FILE_RECORD = {
    "filename": "string", "file_type": "string", "file_size": "long", "file_hash": "string", "duplicate_of": "long",
    "mapping_json": "string", "capabilities_json": "string", "uploaded_at": "timestamp", "started_at": "timestamp",
}


def file_record(spark: SparkSession, path: str, fmt: str, mapping: Mapping[str, str], store: tables.Tables) -> DataFrame:
    """One row about the file or folder of an import: name, size, hash, the first batch with the same hash, mapping and
    capabilities. The hash of a folder is that of its files' hashes in order."""
    hashes = files.file_hashes(spark, path)
    one = hashes.agg(F.sum("length").alias("file_size"), F.sort_array(F.collect_list("file_hash")).alias("h"))
    one = one.withColumn("file_hash", F.when(F.size("h") == 1, F.col("h")[0]).otherwise(F.sha2(F.array_join("h", ""), 256)))
    before = F.lit(None).cast("long")
    if tables.exists(spark, store.batches):
        earlier = spark.table(store.batches).groupBy("file_hash").agg(F.min("id").alias("duplicate_of"))
        one, before = one.join(earlier, "file_hash", "left"), F.col("duplicate_of")
    rows = normalize.CAPTURE_CAPABILITIES if fmt == "pcap" else normalize.capability_rows(mapping)
    able = {name: {"supported": supported, "status": status, "reason": reason} for name, supported, status, reason in rows}
    return one.select(
        F.lit(path.rstrip("/").rsplit("/", 1)[-1]).alias("filename"),
        F.lit(fmt).alias("file_type"),
        "file_size",
        "file_hash",
        before.alias("duplicate_of"),
        F.lit(json.dumps(dict(mapping), sort_keys=True)).alias("mapping_json"),
        F.lit(json.dumps(able, sort_keys=True)).alias("capabilities_json"),
        F.current_timestamp().alias("uploaded_at"),
        F.lit(datetime.now(timezone.utc)).cast("timestamp").alias("started_at"),
    )


def import_capture(
    spark: SparkSession, path: str, entries: DataFrame, *, batch_id: int, mode: str = "analyze_only", classifier: Model | None = None,
    timeout: float = 2.0, packets: DataFrame | None = None, errors: DataFrame | None = None, store: tables.Tables = tables.Tables(),
) -> Import:
    """Captures to flows, labels, logs and alerts, as on the live path. What could not be read are the rejections.

    Alerts of the same signature are one alert. ``packets`` and ``errors`` may be given instead of a path.
    """
    packets = captures.read_captures(spark, path) if packets is None else packets
    errors = captures.capture_errors(spark, path) if errors is None else errors
    built = ordering.numbered(flows.build_flows(packets, timeout=timeout), live.FLOW_ORDER)
    built = built.withColumn("id", log_id(batch_id, F.col("number"))).drop("number")
    logs, _ = live.enrich(built, classifier or model.train_baseline(spark), entries, keep_features=True)
    batch = F.lit(batch_id).cast("long").alias("import_batch_id")
    logs = logs.select("*", batch, F.lit(None).cast("string").alias("ground_truth_label"), F.lit(False).alias("has_warning"))

    def alerts_of(rows: DataFrame) -> DataFrame:
        events = al.event_notes(al.flow_events(rows))
        return al.alert_rows(al.incidents(events, al.no_actions(events)), batch_id)

    # Incidents store their rows on the way, so they are made once: of the logs that are stored, if any are.
    if mode == "analyze_only":
        alerts = alerts_of(logs)
    else:
        logs, alerts = store_batch(spark, logs, alerts_of, batch_id, store)
    summary = batch_summary(logs, errors, None, batch_id)
    summary = summary.withColumn("alerts_count", alerts.agg(F.count(F.lit(1))).scalar())
    out = Import(logs, alerts, summary, errors)
    if mode != "analyze_only":
        name = path.rstrip("/").rsplit("/", 1)[-1]
        record = file_record(spark, path, "pcap", {}, store) if path else None
        tables.append_batch(batch_record(out, name, mode, record), store.batches)
    return out


def import_feed(spark: SparkSession, path: str, as_of: Column, *, label: str = "Imported Threat Feed", store: tables.Tables = tables.Tables()) -> DataFrame:
    """The indicators of a feed that the stored watchlist lacks, added to it; one row with both counts."""
    found = indicators.read_indicators(spark, path)
    name = path.rstrip("/").rsplit("/", 1)[-1]
    before = spark.table(store.watchlist).count() if tables.exists(spark, store.watchlist) else 0
    tables.add_to_watchlist(found, name, as_of, label, store.watchlist)
    total = found.agg(F.count(F.lit(1))).scalar()
    return spark.table(store.watchlist).agg((F.count(F.lit(1)) - before).alias("imported_count"), total.alias("total_found"))


def import_dataset(
    spark: SparkSession,
    path: str,
    entries: DataFrame,
    as_of: Column,
    *,
    batch_id: int,
    mode: str = "analyze_only",
    fmt: str | None = None,
    mapping: Mapping[str, str] | None = None,
    classifier: Model | None = None,
    isolate_profile: bool = False,
    store: tables.Tables = tables.Tables(),
) -> Import | DataFrame:
    """Import a file or folder: detect the format, map the columns, normalise, label, store.

    Captures go through the flows; a threat feed goes to the watchlist and gives the counts of `import_feed`.
    """
    fmt = fmt or files.detect_format(spark, path)
    if fmt == "pcap":
        return import_capture(spark, path, entries, batch_id=batch_id, mode=mode, classifier=classifier, store=store)
    if fmt == "txt_ioc":
        return import_feed(spark, path, as_of, store=store)
    raw = files.read_raw(spark, path, fmt)
    mapping = mapping if mapping is not None else normalize.auto_mapping(files.headers(raw), fmt)
    name = path.rstrip("/").rsplit("/", 1)[-1]
    normalized = normalize.normalize(raw, mapping, as_of, fmt=fmt, batch_id=batch_id, filename=name, keep=[files.ROW_ID])
    return run_batch(
        normalized,
        entries,
        classifier or model.train_baseline(spark),
        batch_id=batch_id,
        mode=mode,
        name=name,
        can_classify=normalize.supports(mapping, "arf_classification"),
        can_profile=normalize.supports(mapping, "behaviour_profiling"),
        isolate_profile=isolate_profile,
        record=None if mode == "analyze_only" else file_record(spark, path, fmt, mapping, store),
        store=store,
    )

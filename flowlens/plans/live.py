"""Packet stream to labelled logs, alerts, and a classifier that keeps learning."""

from __future__ import annotations

from pyspark.ml import Model, PipelineModel
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import alerts as al
from ..operators import anomaly, arp, devices, model, watchlist
from ..operators.ordering import numbered
from ..sinks.tables import upsert_devices, write_epoch
from ..streaming import state
from ..streaming.flows import build_flows_stream
from ..streaming.run import for_each_epoch


#: What tells the flows of a batch apart.
FLOW_ORDER = ["start_time", "src_ip", "dest_ip", "src_port", "dest_port", "protocol"]


def live_id(epoch: int, number: Column) -> Column:
    """Id of a log of a micro-batch, above all ids of imports: the epoch (30 bits) and a number within it (32 bits)."""
    return F.lit((1 << 62) + (epoch << 32)) + number


def enrich(flows: DataFrame, classifier: Model, entries: DataFrame, keep_features: bool = False) -> tuple[DataFrame, DataFrame]:
    """Log rows and alert events of closed flows with an ``id``. ``keep_features``: the logs also hold what explains their alerts."""
    labelled = model.classify(flows, classifier)
    logs = labelled.withColumn("timestamp", F.col("last_seen")).withColumn(
        "protocol", F.coalesce("protocol_l7", "protocol")
    )
    logs = watchlist.match_watchlist(logs, entries)
    events = al.event_notes(al.flow_events(logs))
    rows = logs.select(
        "id", "timestamp", "src_ip", "dest_ip", "src_port", "dest_port", "protocol",
        F.floor("duration").alias("duration"), "total_bytes", "packet_count", "prediction_label", "confidence_score",
        "info", "source", "connection_state", "watch_id", *(["sbytes", "splt_mean", "avg_pkt_size"] if keep_features else []),
    )
    return rows, events


def run_stream(
    packets: DataFrame, classifier: Model, entries: DataFrame, out: str, *, timeout: float = 2.0, delay: str = "1 minute",
    decode: str = "full", **trigger,
):
    """Label every closed flow; ``logs`` and ``alert_events`` grow below ``out``, one partition per epoch.

    An epoch that is run again writes the same partition again, so nothing is counted twice.
    """

    def work(flows: DataFrame, epoch: int) -> None:
        flows = numbered(flows, FLOW_ORDER)  # stored, as two outputs are made of it
        flows = flows.withColumn("id", live_id(epoch, F.col("number"))).drop("number")
        logs, events = enrich(flows, classifier, entries)
        write_epoch(logs, f"{out}/logs", epoch)
        write_epoch(events, f"{out}/alert_events", epoch)

    return for_each_epoch(build_flows_stream(packets, timeout, delay, decode), f"{out}/checkpoint", work, **trigger)


def run_devices(logs: DataFrame, out: str, *, trees: int = 25, delay: str = state.DELAY, **trigger):
    """Score every log of a stream against its device's past: ``device_events`` and ``device_profiles`` grow below ``out``.

    `tables.read_devices` gives the present profiles.
    """

    def work(scored: DataFrame, epoch: int) -> None:
        scored.persist()
        try:
            write_epoch(al.event_notes(anomaly.device_events(scored)), f"{out}/device_events", epoch)
            upsert_devices(devices.device_sums(scored), f"{out}/device_profiles", epoch)
        finally:
            scored.unpersist()

    return for_each_epoch(state.device_anomaly_stream(logs, trees=trees, delay=delay), f"{out}/device_checkpoint", work, **trigger)


def run_arp(replies: DataFrame, out: str, *, delay: str = state.DELAY, **trigger):
    """ARP conflicts of a stream: ``arp_logs`` and ``arp_events`` grow below ``out``."""

    def work(conflicts: DataFrame, epoch: int) -> None:
        conflicts.persist()
        try:
            write_epoch(arp.arp_logs(conflicts), f"{out}/arp_logs", epoch)
            write_epoch(al.event_notes(arp.arp_events(conflicts)), f"{out}/arp_events", epoch)
        finally:
            conflicts.unpersist()

    return for_each_epoch(state.arp_conflicts_stream(replies, delay), f"{out}/arp_checkpoint", work, **trigger)


def run_alerts(events: DataFrame, out: str, *, seconds: float = 2.0, delay: str = state.DELAY, **trigger) -> list:
    """Events of all detectors to alerts and notifications, both below ``out``.

    ``alert_changes`` holds every change of an alert (`state.present_incidents` gives their present form, fit for the
    alerts table through `alerts.alert_rows`), ``notifications`` the events that are sent out. ``delay`` has to cover
    how far one detector lags behind another.
    """
    changes = state.incidents_stream(state.event_timeline(events), delay)
    sent = state.rate_limit_stream(events, seconds, delay=delay)
    return [
        for_each_epoch(changes, f"{out}/alerts_checkpoint", lambda df, epoch: write_epoch(df, f"{out}/alert_changes", epoch), **trigger),
        for_each_epoch(sent, f"{out}/notify_checkpoint", lambda df, epoch: write_epoch(df, f"{out}/notifications", epoch), **trigger),
    ]


def stored_events(spark: SparkSession, out: str, names: tuple[str, ...] = ("alert_events", "device_events", "arp_events"), **options) -> DataFrame:
    """What the detectors have written below ``out`` as one stream of events."""
    parts = []
    for name in names:
        schema = spark.read.parquet(f"{out}/{name}").drop("epoch").schema
        parts.append(spark.readStream.schema(schema).option("recursiveFileLookup", True).options(**options).parquet(f"{out}/{name}"))
    return al.union_events(*parts)


def refit_stream(labelled: DataFrame, out: str, *, keep_epochs: int = 20, trees: int = 3, **trigger):
    """Predict, then learn: each micro-batch is labelled by the current model and joins the training
    window of the last ``keep_epochs`` micro-batches, on which the model is fitted anew.

    Until the window knows two classes the baseline forest answers. ``labelled`` has the seven
    features and ``label``; predictions go to ``<out>/predictions``, models to ``<out>/models``.
    """
    spark = labelled.sparkSession
    baseline = model.train_baseline(spark)
    index = f"{out}/model_index"

    def newest(epoch: int) -> str | None:
        """The model of the last epoch before this one; asked each time, so a restart finds it too."""
        if epoch == 0:
            return None
        rows = spark.read.schema("path string, epoch long").parquet(index).where(F.col("epoch") < epoch)
        return rows.agg(F.max_by("path", "epoch").alias("path")).head().path

    def work(rows: DataFrame, epoch: int) -> None:
        path = newest(epoch)
        current = PipelineModel.load(path) if path else baseline
        write_epoch(model.classify(rows, current), f"{out}/predictions", epoch)
        write_epoch(rows, f"{out}/window", epoch)
        window = spark.read.parquet(f"{out}/window").where(F.col("epoch").between(epoch - keep_epochs + 1, epoch))
        if model.knows_enough(window):
            path = f"{out}/models/epoch-{epoch}"
            model.train(window, trees=trees).write().overwrite().save(path)
        write_epoch(spark.createDataFrame([(path,)], "path string"), index, epoch)

    return for_each_epoch(labelled, f"{out}/checkpoint", work, **trigger)

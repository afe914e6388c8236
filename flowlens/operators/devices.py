"""Device profiles from scored flows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import verdicts
from ..functions.values import round_places


def device_sums(scored: DataFrame) -> DataFrame:
    """What a profile is made of, one row per device; such rows of several epochs can be merged.

    Aggregated per (device, protocol) first, so the map of a device is built from a few rows.
    """
    per_protocol = scored.groupBy("src_ip", "protocol").agg(
        F.count(F.lit(1)).alias("n"),
        F.count_if("is_anomalous").alias("anomalies"),
        F.sum("total_bytes").alias("bytes"),
        F.sum("duration").alias("time"),
        F.min("timestamp").alias("first_seen"),
        F.max(F.struct("timestamp", "id", "score", "is_anomalous")).alias("last"),
    )
    return per_protocol.groupBy(F.col("src_ip").alias("device_ip")).agg(
        F.sum("n").alias("sample_count"),
        F.sum("anomalies").alias("anomaly_count"),
        F.sum("bytes").alias("total_bytes"),
        F.sum("time").alias("total_duration"),
        F.map_from_entries(F.array_sort(F.collect_list(F.struct("protocol", "n")))).alias("protocols"),
        F.min("first_seen").alias("first_seen"),
        F.max("last").alias("last"),
    )


def merged_sums(parts: DataFrame) -> DataFrame:
    """The sums of devices from those of several epochs."""
    apart = parts.select(*[c for c in parts.columns if c != "protocols"], F.explode_outer("protocols").alias("protocol", "n"))
    flows = apart.groupBy("device_ip", "protocol").agg(F.sum("n").alias("n")).where("n is not null")
    maps = flows.groupBy("device_ip").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("protocol", "n")))).alias("protocols"))
    sums = ["sample_count", "anomaly_count", "total_bytes", "total_duration"]
    whole = parts.groupBy("device_ip").agg(*[F.sum(c).alias(c) for c in sums], F.min("first_seen").alias("first_seen"), F.max("last").alias("last"))
    return whole.join(maps, "device_ip").select("device_ip", *sums, "protocols", "first_seen", "last")


def profiles_of(sums: DataFrame, window: int = 20) -> DataFrame:
    """Profiles from the sums of devices: counts, averages, flows per protocol, first and last seen, last score."""
    alert = F.col("last.is_anomalous")
    score = round_places(F.col("last.score"), 2)
    return sums.select(
        "device_ip",
        "first_seen",
        F.col("last.timestamp").alias("last_seen"),
        "sample_count",
        "anomaly_count",
        round_places(F.col("total_bytes") / F.col("sample_count"), 1).alias("avg_bytes"),
        round_places(F.col("total_duration") / F.col("sample_count"), 2).alias("avg_duration"),
        "total_bytes",
        "total_duration",
        "protocols",
        score.alias("recent_score"),
        alert.alias("recent_alert"),
        verdicts.device_status(alert, F.col("sample_count"), window).alias("status"),
        verdicts.device_badge(alert, F.col("sample_count"), F.col("last.score"), window).alias("badge"),
    )


def device_summary(scored: DataFrame, window: int = 20) -> DataFrame:
    """One row per device."""
    return profiles_of(device_sums(scored), window)


def recent_devices(profiles: DataFrame, n: int = 50) -> DataFrame:
    """The devices seen last."""
    return profiles.orderBy(F.col("last_seen").desc(), "device_ip").limit(n)


def profiler_stats(flows: DataFrame, capacity: int = 200) -> DataFrame:
    """Devices seen, how many of them go beyond the capacity, flows seen."""
    counted = flows.agg(F.count_distinct("src_ip").alias("n"), F.count(F.lit(1)).alias("flows"))
    return counted.select(
        F.least("n", F.lit(capacity)).alias("active_devices"),
        F.lit(capacity).alias("max_device_capacity"),
        F.greatest(F.col("n") - capacity, F.lit(0)).alias("total_evictions"),
        F.col("flows").alias("total_flows_evaluated"),
    )


def latest_profiles(snapshots: DataFrame) -> DataFrame:
    """The newest snapshot per device, as an aggregate."""
    others = [c for c in snapshots.columns if c not in ("device_ip", "last_seen")]
    packed = F.struct("last_seen", *[c for c in others if c != "protocols"])
    newest = snapshots.groupBy("device_ip").agg(F.max_by(F.struct(*others), packed).alias("row"), F.max("last_seen").alias("last_seen"))
    return newest.select("device_ip", "last_seen", *[f"row.{c}" for c in others])

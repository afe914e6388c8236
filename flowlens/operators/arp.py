"""ARP replies that claim an address for another MAC than the one first seen."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def arp_conflicts(replies: DataFrame) -> DataFrame:
    """Every reply whose MAC differs from the first one seen for that address.

    The first MAC per address is an aggregate (no per-address window), joined back; a hot address
    is split by the adaptive skew join.
    """
    answers = replies.where((F.col("op") == 2) & F.col("ip").isNotNull() & F.col("mac").isNotNull())
    first = answers.groupBy("ip").agg(F.min(F.struct("ts", "id", "mac")).alias("first"))
    first = first.select("ip", F.col("first.mac").alias("old_mac"))
    return answers.join(first, "ip").where(F.col("mac") != F.col("old_mac")).select(
        "id", "ts", "ip", "old_mac", F.col("mac").alias("new_mac")
    )


def arp_logs(conflicts: DataFrame) -> DataFrame:
    """Traffic-log rows of the conflicts."""
    return conflicts.select(
        "id",
        F.col("ts").alias("timestamp"),
        F.col("ip").alias("src_ip"),
        F.lit("Broadcast").alias("dest_ip"),
        F.lit(0).alias("src_port"),
        F.lit(0).alias("dest_port"),
        F.lit("ARP").alias("protocol"),
        F.lit(0).cast("long").alias("duration"),
        F.lit(42).cast("long").alias("total_bytes"),
        F.lit("Malicious").alias("prediction_label"),
        F.lit(1.0).alias("confidence_score"),
        F.format_string("ARP Spoofing: IP %s claimed by MAC %s (previously %s)", "ip", "new_mac", "old_mac").alias("info"),
        F.lit("live").alias("source"),
        F.lit("N/A").alias("connection_state"),
        F.lit(None).cast("long").alias("import_batch_id"),
    )


def arp_events(conflicts: DataFrame) -> DataFrame:
    """Alert events of the conflicts."""
    return conflicts.select(
        "id",
        F.col("id").alias("log_id"),
        "ts",
        F.lit("Critical").alias("threat_level"),
        F.lit("arp_spoofing").alias("alert_type"),
        F.col("ip").alias("device"),
        F.col("ip").alias("src_ip"),
        F.lit("Broadcast").alias("dest_ip"),
        F.lit("ARP").alias("protocol"),
        F.lit(False).alias("is_simulated"),
        F.lit("ARP Spoofing / MITM").alias("threat_type"),
        F.format_string("Duplicate MAC bindings detected for IP %s: %s vs %s", "ip", "new_mac", "old_mac").alias("reason"),
        F.format_string("Audit active MAC tables and isolate device matching MAC %s.", "new_mac").alias("action"),
        F.format_string("Prior MAC: %s -> Infiltrating MAC: %s", "old_mac", "new_mac").alias("context"),
    )

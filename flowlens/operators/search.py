"""Multi-criteria search over the logs. Arguments that are unset (or ``all``) add no filter."""

from __future__ import annotations

from datetime import datetime, timezone

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import verdicts
from ..functions.values import iso_text, round_places



def _has_any_case(column: str, part: str) -> Column:
    return F.lower(column).contains(part.lower())


def _time(text: str | None) -> Column | None:
    """A time argument as a literal; text that is no ISO time is ignored."""
    try:
        when = datetime.fromisoformat((text or "").replace("Z", "+00:00"))
    except ValueError:
        return None
    if when.tzinfo is None:
        when = when.replace(tzinfo=timezone.utc)
    return F.lit(when)


def search(
    logs: DataFrame,
    *,
    start_time: str | None = None,
    end_time: str | None = None,
    protocol: str | None = None,
    prediction_label: str | None = None,
    search_ip: str | None = None,
    src_ip: str | None = None,
    dest_ip: str | None = None,
    min_bytes: int | None = None,
    source: str | None = None,
    import_batch_id: int | None = None,
) -> DataFrame:
    def set_(value: str | None) -> bool:
        return bool(value) and value != "all"

    out = logs
    start, end = _time(start_time), _time(end_time)
    if start is not None:
        out = out.where(F.col("timestamp") >= start)
    if end is not None:
        out = out.where(F.col("timestamp") <= end)
    if set_(protocol):
        out = out.where(_has_any_case("protocol", protocol))
    if set_(prediction_label):
        out = out.where(F.col("prediction_label") == prediction_label)
    if search_ip:
        out = out.where(_has_any_case("src_ip", search_ip) | _has_any_case("dest_ip", search_ip))
    if src_ip:
        out = out.where(_has_any_case("src_ip", src_ip))
    if dest_ip:
        out = out.where(_has_any_case("dest_ip", dest_ip))
    if min_bytes and min_bytes > 0:
        out = out.where(F.col("total_bytes") >= min_bytes)
    if set_(source):
        out = out.where(_has_any_case("source", source))
    if import_batch_id:
        out = out.where(F.col("import_batch_id") == import_batch_id)
    return out


def search_summary(found: DataFrame) -> DataFrame:
    """Matches, bytes, averages and the share of threat flows, in one aggregate."""
    sums = found.agg(
        F.count(F.lit(1)).alias("n"),
        F.coalesce(F.sum("total_bytes"), F.lit(0)).alias("b"),
        F.coalesce(F.sum("duration"), F.lit(0)).alias("d"),
        F.count_if(verdicts.is_threat(F.col("prediction_label"))).alias("t"),
    )

    def per_match(total: Column) -> Column:
        return F.when(F.col("n") > 0, total / F.col("n")).otherwise(0.0)

    return sums.select(
        F.col("n").alias("matching_flows"),
        F.col("b").alias("total_bytes"),
        round_places(per_match(F.col("d")), 2).alias("avg_duration_sec"),
        round_places(per_match(F.col("b")), 1).alias("avg_bytes_per_flow"),
        round_places(per_match(F.col("t")) * 100.0, 1).alias("malicious_share_pct"),
    )


def page(logs: DataFrame, limit: int = 100, offset: int = 0) -> DataFrame:
    """Newest first."""
    return logs.orderBy(F.col("timestamp").desc(), F.col("id").desc()).offset(offset).limit(limit)


def shape_records(found: DataFrame) -> DataFrame:
    """Rows as reports print them: ISO time, short names, default texts for null."""
    return found.select(
        "id",
        iso_text(F.col("timestamp")).alias("timestamp"),
        "src_ip",
        "dest_ip",
        "src_port",
        "dest_port",
        "protocol",
        "duration",
        F.col("total_bytes").alias("bytes"),
        F.col("prediction_label").alias("label"),
        F.col("confidence_score").alias("confidence"),
        F.coalesce("info", F.lit("")).alias("info"),
        F.coalesce("connection_state", F.lit("N/A")).alias("state"),
        F.coalesce("source", F.lit("live")).alias("source"),
        "import_batch_id",
    )


def log_search(logs: DataFrame, search_ip: str | None = None, limit: int = 50, offset: int = 0) -> DataFrame:
    return page(search(logs, search_ip=search_ip), limit, offset)


def filter_logs(logs: DataFrame, ip: str = "", source: str = "all", protocol: str = "all", label: str = "all") -> DataFrame:
    """Filter of the log list: address part, exact source, protocol and label without regard to case."""
    out = logs
    if ip:
        out = out.where(_has_any_case("src_ip", ip) | _has_any_case("dest_ip", ip))
    if source != "all":
        out = out.where(F.col("source") == source)
    if protocol != "all":
        out = out.where(F.upper("protocol") == protocol.upper())
    if label != "all":
        out = out.where(F.lower("prediction_label") == label.lower())
    return out


def recent_batches(batches: DataFrame, n: int = 100) -> DataFrame:
    """Import history: the batches uploaded last."""
    return batches.orderBy(F.col("uploaded_at").desc(), F.col("id").desc()).limit(n)

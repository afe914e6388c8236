"""Stored tables: append, replace, delete, retention.

Log-like tables are partitioned, so deleting a batch or old days drops partitions and reads nothing.
Small tables are rewritten into a new folder to which the table then points, so a failure loses nothing.
"""

from __future__ import annotations

import time
from datetime import date
from typing import NamedTuple

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.devices import merged_sums, profiles_of
from ..operators.watchlist import new_indicators, watchlist_rows

LOGS, ALERTS, WATCHLIST = "traffic_logs", "alerts", "watchlist_entries"
DEVICES, METRICS, BATCHES = "device_profiles", "model_metrics", "import_batches"
LIVE = 0  # partition of rows that belong to no import batch


class Tables(NamedTuple):
    """Names of the stored tables; another set of them is a prefix away."""

    logs: str = LOGS
    alerts: str = ALERTS
    watchlist: str = WATCHLIST
    devices: str = DEVICES
    metrics: str = METRICS
    batches: str = BATCHES

    def prefixed(self, prefix: str) -> Tables:
        return Tables(*[prefix + name for name in self])


def exists(spark: SparkSession, name: str) -> bool:
    return spark.catalog.tableExists(name)


def append(df: DataFrame, name: str, partition_by: list[str] | None = None) -> None:
    """Append by column name; files of a partition are balanced by size, hot partitions split."""
    partition_by = partition_by or []
    if partition_by:
        df = df.hint("rebalance", *partition_by)
    if exists(df.sparkSession, name):
        columns = df.sparkSession.table(name).columns
        df.select(*columns).write.mode("append").insertInto(name)
    else:
        others = [c for c in df.columns if c not in partition_by]
        df.select(*others, *partition_by).write.partitionBy(*partition_by).format("parquet").saveAsTable(name)


def _dated(df: DataFrame, time: str) -> DataFrame:
    batch = F.coalesce(F.col("import_batch_id"), F.lit(LIVE)).cast("long")
    return df.withColumn("import_batch_id", batch).withColumn("log_date", F.date_format(time, "yyyy-MM-dd"))


def append_logs(logs: DataFrame, name: str = LOGS) -> None:
    append(_dated(logs, "timestamp"), name, ["import_batch_id", "log_date"])


def append_alerts(alerts: DataFrame, name: str = ALERTS) -> None:
    append(_dated(alerts, "alert_time"), name, ["import_batch_id", "log_date"])


def _partitions(spark: SparkSession, name: str) -> list[dict[str, str]]:
    """Partition names of a table (metadata, no data)."""
    rows = spark.sql(f"SHOW PARTITIONS {name}").collect()
    return [dict(part.split("=", 1) for part in row.partition.split("/")) for row in rows]


def _drop(spark: SparkSession, name: str, parts: list[dict[str, str]]) -> int:
    if parts:
        specs = ", ".join("PARTITION (" + ", ".join(f"{k} = '{v}'" for k, v in p.items()) + ")" for p in parts)
        spark.sql(f"ALTER TABLE {name} DROP IF EXISTS {specs}")
    return len(parts)


def delete_batch(spark: SparkSession, batch_id: int, logs: str = LOGS, alerts: str = ALERTS, watchlist: str = WATCHLIST, batches: str = BATCHES) -> None:
    """Remove a batch with its alerts, logs and watchlist entries; everything else stays."""
    for name in (alerts, logs):
        if exists(spark, name):
            _drop(spark, name, [p for p in _partitions(spark, name) if p["import_batch_id"] == str(batch_id)])
    if exists(spark, watchlist):
        replace(spark.table(watchlist).where(~F.col("import_batch_id").eqNullSafe(batch_id)), watchlist)
    if exists(spark, batches):
        replace(spark.table(batches).where(~F.col("id").eqNullSafe(batch_id)), batches)


def purge_before(spark: SparkSession, day: date, name: str = LOGS) -> int:
    """Retention: drop the days before ``day``; returns the number of partitions dropped."""
    old = [p for p in _partitions(spark, name) if p["log_date"] < day.isoformat()]
    return _drop(spark, name, old)


def replace(df: DataFrame, name: str) -> None:
    """Put rows, which may come from the table itself, in the place of a small table.

    They are written to a new folder first; then the table points to it, which is one step of the catalog. Whatever fails
    before leaves the old rows. The folder that the table pointed to before is kept for readers under way, older ones go.
    """
    spark = df.sparkSession
    columns = spark.table(name).columns
    root = spark.conf.get("spark.sql.warehouse.dir").rstrip("/") + f"/_snapshots/{name}"
    folder = f"{root}/{time.time_ns():020d}"
    df.select(*columns).write.parquet(folder)
    _point(spark, name, folder)
    for old in sorted(_folders(spark, root))[:-2]:
        _remove(spark, f"{root}/{old}")


def _point(spark: SparkSession, name: str, folder: str) -> None:
    spark.sql(f"ALTER TABLE {name} SET LOCATION '{folder}'")
    spark.catalog.refreshTable(name)


def _folder(spark: SparkSession, path: str):
    """File system and path as Hadoop knows them."""
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    return place.getFileSystem(spark._jsc.hadoopConfiguration()), place


def _folders(spark: SparkSession, path: str) -> list[str]:
    system, place = _folder(spark, path)
    return [x.getPath().getName() for x in system.listStatus(place) if x.isDirectory()] if system.exists(place) else []


def _remove(spark: SparkSession, path: str) -> None:
    system, place = _folder(spark, path)
    system.delete(place, True)


def add_to_watchlist(feed: DataFrame, feed_name: str, as_of: Column, label: str = "Imported Threat Feed", name: str = WATCHLIST) -> None:
    """Append the feed's indicators ``(value, entry_type, line)`` that the list lacks."""
    spark = feed.sparkSession
    new = new_indicators(feed, spark.table(name) if exists(spark, name) else None)
    append(watchlist_rows(new, feed_name, as_of, label), name)


def remove_from_watchlist(spark: SparkSession, entry_id: int, name: str = WATCHLIST) -> None:
    replace(spark.table(name).where(F.col("id") != entry_id), name)


def write_epoch(df: DataFrame, path: str, epoch: int) -> None:
    """Output of one micro-batch; written again, it replaces itself, so a retried epoch counts once."""
    (
        df.withColumn("epoch", F.lit(epoch))
        .write.mode("overwrite")
        .option("partitionOverwriteMode", "dynamic")
        .partitionBy("epoch")
        .parquet(path)
    )


def upsert_devices(sums: DataFrame, path: str, epoch: int, every: int = 20) -> None:
    """Add what an epoch tells of its devices (`devices.device_sums`).

    Each epoch writes its own devices only. After every ``every`` epochs all are merged into one base and what went into
    it is dropped, so what is stored follows the number of devices and not that of epochs. An epoch that is run again
    replaces itself. A merge that fails leaves the parts; the newest whole base counts.
    """
    spark = sums.sparkSession
    write_epoch(sums, f"{path}/parts", epoch)
    if (epoch + 1) % every == 0:
        device_parts(spark, path, epoch).transform(merged_sums).write.mode("overwrite").parquet(f"{path}/base/epoch={epoch}")
        # What the base before was made of goes; that base and the parts after it stay, should this epoch be run again.
        before = _newest_base(spark, path, epoch)
        for kind in ("base", "parts"):
            for name in _folders(spark, f"{path}/{kind}"):
                if before is not None and name.startswith("epoch=") and _epoch(name) < before + (kind == "parts"):
                    _remove(spark, f"{path}/{kind}/{name}")


def device_parts(spark: SparkSession, path: str, until: int | None = None) -> DataFrame:
    """The newest base and the parts after it (up to an epoch)."""
    base = _newest_base(spark, path, until)
    first = -1 if base is None else base
    parts = [p for p in _folders(spark, f"{path}/parts") if p.startswith("epoch=") and _epoch(p) > first and (until is None or _epoch(p) <= until)]
    folders = [f"{path}/parts/{p}" for p in parts] + ([] if base is None else [f"{path}/base/epoch={base}"])
    return spark.read.parquet(*folders)


def _epoch(name: str) -> int:
    return int(name.partition("=")[2])


def _newest_base(spark: SparkSession, path: str, until: int | None) -> int | None:
    """Epoch of the newest base that is whole (before an epoch)."""
    whole = [_epoch(b) for b in _folders(spark, f"{path}/base") if "_SUCCESS" in _files(spark, f"{path}/base/{b}")]
    return max((e for e in whole if until is None or e < until), default=None)


def _files(spark: SparkSession, path: str) -> list[str]:
    system, place = _folder(spark, path)
    return [x.getPath().getName() for x in system.listStatus(place)]


def read_devices(spark: SparkSession, path: str) -> DataFrame:
    """The present profile of every device that `upsert_devices` knows below a path."""
    return profiles_of(merged_sums(device_parts(spark, path)))


def append_metrics(metrics: DataFrame, name: str = METRICS) -> None:
    """Add drift events; the table is there even if there were none."""
    append(metrics, name)


def append_batch(summary: DataFrame, name: str = BATCHES) -> None:
    append(summary, name)

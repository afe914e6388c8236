"""CSV and JSON exports in the column layouts users know."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.values import iso_text
from ..operators.search import page, search

# Column name in the file -> log column.
RESEARCH_COLUMNS = {
    "id": "id",
    "timestamp": "timestamp",
    "src_ip": "src_ip",
    "dest_ip": "dest_ip",
    "src_port": "src_port",
    "dest_port": "dest_port",
    "protocol": "protocol",
    "duration_sec": "duration",
    "total_bytes": "total_bytes",
    "label": "prediction_label",
    "confidence": "confidence_score",
    "l7_metadata": "info",
    "tcp_state": "connection_state",
}
REPORT_COLUMNS = {
    "ID": "id",
    "Timestamp": "timestamp",
    "Source IP": "src_ip",
    "Destination IP": "dest_ip",
    "Source Port": "src_port",
    "Destination Port": "dest_port",
    "Protocol": "protocol",
    "Duration": "duration",
    "Bytes": "total_bytes",
    "Label": "prediction_label",
    "Confidence": "confidence_score",
    "Metadata Context": "info",
    "Source": "source",
    "TCP State": "connection_state",
}
BATCH_COLUMNS = {
    "id": "id",
    "timestamp": "timestamp",
    "src_ip": "src_ip",
    "dest_ip": "dest_ip",
    "src_port": "src_port",
    "dest_port": "dest_port",
    "protocol": "protocol",
    "duration_sec": "duration",
    "total_bytes": "total_bytes",
    "label": "prediction_label",
    "confidence": "confidence_score",
    "info": "info",
    "import_batch_id": "import_batch_id",
}
BATCH_JSON_COLUMNS = {
    "id": "id",
    "timestamp": "timestamp",
    "src_ip": "src_ip",
    "dest_ip": "dest_ip",
    "src_port": "src_port",
    "dest_port": "dest_port",
    "protocol": "protocol",
    "duration": "duration",
    "bytes": "total_bytes",
    "label": "prediction_label",
    "confidence": "confidence_score",
    "info": "info",
}


def shaped(logs: DataFrame, columns: dict[str, str]) -> DataFrame:
    def value(column: str):
        if column == "timestamp":
            return iso_text(F.col(column))
        if column == "info":
            return F.coalesce(column, F.lit(""))
        return F.col(column)

    return logs.select(*[value(c).alias(name) for name, c in columns.items()])


def newest_first(logs: DataFrame, limit: int | None) -> DataFrame:
    """All rows, or a page of them, in the order of the lists."""
    return logs.orderBy(F.col("timestamp").desc(), F.col("id").desc()) if limit is None else page(logs, limit)


def research_rows(
    logs: DataFrame, protocol: str | None = None, prediction_label: str | None = None, search_ip: str | None = None, limit: int | None = None
) -> DataFrame:
    """Filtered rows, newest first."""
    found = search(logs, protocol=protocol, prediction_label=prediction_label, search_ip=search_ip)
    return shaped(newest_first(found, limit), RESEARCH_COLUMNS)


def report_rows(logs: DataFrame, limit: int | None = None) -> DataFrame:
    """Logs, newest first."""
    return shaped(newest_first(logs, limit), REPORT_COLUMNS)


def batch_rows(logs: DataFrame, batch_id: int, columns: dict[str, str] = BATCH_COLUMNS) -> DataFrame:
    """All rows of a batch in order of id."""
    return shaped(logs.where(F.col("import_batch_id") == batch_id).orderBy("id"), columns)


def write_csv(rows: DataFrame, path: str) -> None:
    """CSV with header. Rows in a global order give files in that order."""
    rows.write.csv(path, header=True, escape='"', emptyValue="")


def write_json(rows: DataFrame, path: str) -> None:
    rows.write.json(path)

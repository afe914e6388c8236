"""Foreign records to canonical flows: header mapping, validation, capability report.

Mapping works on header names only (driver side, a few strings); the data is cleaned by one
``select``.
"""

from __future__ import annotations

import re
from collections.abc import Iterable, Mapping

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import values as V
from ..schemas import CANONICAL_FIELDS, FORMAT_HEADERS, HEADER_ALIASES


def clean_name(name: str) -> str:
    return re.sub("[^a-z0-9]", "", name.strip().lower())


def clean_name_column(name: Column) -> Column:
    return F.regexp_replace(F.lower(V.strip(name)), "[^a-z0-9]", "")


def auto_mapping(headers: Iterable[str], fmt: str | None = None) -> dict[str, str]:
    """Canonical field -> header. A later header with the same cleaned name replaces an earlier one."""
    headers = list(headers)
    by_name = {clean_name(h): h for h in headers}
    mapping = {}
    for field, aliases in HEADER_ALIASES.items():
        hits = [by_name[clean_name(a)] for a in aliases if clean_name(a) in by_name]
        if hits:
            mapping[field] = hits[0]
    for header, field in FORMAT_HEADERS.get(fmt or "", {}).items():
        if header in headers:
            mapping.setdefault(field, header)
    return mapping


def segment_size_headers(mapping: Mapping[str, str]) -> list[str]:
    """Mapped headers that hold segment sizes rather than bytes; the report flags them."""
    return [h for h in mapping.values() if clean_name(h) in ("fwdsegsizeavg", "bwdsegsizeavg")]


# Status and reason texts of the capability report.
_FULL, _PARTIAL, _NONE = "fully_supported", "partial", "unsupported"


def capability_rows(mapping: Mapping[str, str]) -> list[tuple[str, bool, str, str]]:
    def has(*fields: str) -> bool:
        return all(mapping.get(f) for f in fields)

    src, dest = has("src_ip"), has("dest_ip")
    volume = has("total_bytes") or has("src_bytes", "dest_bytes")
    packets = has("packet_count") or has("src_pkts", "dest_pkts")

    def choose(name: str, *options: tuple[bool, bool, str, str]) -> tuple[str, bool, str, str]:
        supported, status, reason = next(o[1:] for o in options if o[0])
        return name, supported, status, reason

    no_source = (True, False, _NONE, "Source IP is missing.")
    return [
        choose(
            "traffic_visualization",
            (has("timestamp") and src and dest, True, _FULL, "Timestamp, source, and destination endpoints are mapped."),
            (True, False, _NONE, "Missing timestamp or network endpoints."),
        ),
        choose(
            "ip_analytics",
            (src and dest, True, _FULL, "Source and destination IP addresses are mapped."),
            (True, False, _NONE, "Source or destination IP address is missing."),
        ),
        choose(
            "protocol_analytics",
            (has("protocol"), True, _FULL, "Protocol field is mapped."),
            (True, False, _NONE, "Protocol column is unmapped."),
        ),
        choose(
            "device_inventory",
            (src and volume, True, _FULL, "Source IP and flow byte volumes available for device tracking."),
            (src, True, _PARTIAL, "Source IP is available, but byte volumes are unmapped."),
            no_source,
        ),
        choose(
            "behaviour_profiling",
            (src and volume, True, _FULL, "Per-device telemetry available for Half-Space Trees baseline."),
            (src, False, _NONE, "Requires byte volumes and timing to model host profiles."),
            no_source,
        ),
        choose(
            "arf_classification",
            (volume and packets, True, _FULL, "All essential volumetric flow features (bytes and packet counts) are mapped."),
            (
                volume or packets,
                False,
                _PARTIAL,
                "Partial flow features present (either bytes or packets missing). In accordance with "
                "academic rigor, feature fabrication is disabled.",
            ),
            (
                True,
                False,
                _NONE,
                "Volumetric flow statistics (bytes and packet counts) are missing. Classification disabled.",
            ),
        ),
        choose(
            "ioc_correlation",
            (src or dest, True, _FULL, "Network IP endpoints are available for watchlist cross-referencing."),
            (True, False, _NONE, "No IP address columns available for watchlist lookup."),
        ),
        choose(
            "label_evaluation",
            (has("label"), True, _FULL, "Ground truth label column is mapped for supervised metric evaluation."),
            (True, False, _NONE, "Ground truth label is unmapped. Supervised evaluation disabled."),
        ),
    ]


# Captures always carry everything but labels.
CAPTURE_CAPABILITIES = [
    ("traffic_visualization", True, _FULL, "Full packet payload & headers present."),
    ("ip_analytics", True, _FULL, "All IP endpoints parsed natively."),
    ("protocol_analytics", True, _FULL, "L2-L7 protocols dissected."),
    ("device_inventory", True, _FULL, "Direct MAC and IP device tracking."),
    ("arf_classification", True, _FULL, "Native FlowFeatureExtractor generates full 7-feature vectors."),
    ("behaviour_profiling", True, _FULL, "Per-host flow statistics computed."),
    ("ioc_correlation", True, _FULL, "Full IP addresses cross-correlated."),
    ("label_evaluation", False, _NONE, "Raw PCAP does not contain supervisory labels."),
]


def capabilities(spark: SparkSession, mapping: Mapping[str, str] | None, fmt: str | None = None) -> DataFrame:
    """What a data set with this mapping can be used for, one row per capability."""
    rows = CAPTURE_CAPABILITIES if fmt == "pcap" else capability_rows(mapping or {})
    return spark.createDataFrame(rows, "capability string, supported boolean, status string, reason string")


def supports(mapping: Mapping[str, str], capability: str) -> bool:
    return next(row[1] for row in capability_rows(mapping) if row[0] == capability)


def normalize(
    df: DataFrame,
    mapping: Mapping[str, str],
    as_of: Column,
    *,
    fmt: str = "csv",
    batch_id: int | None = None,
    filename: str = "",
    keep: Iterable[str] = (),
) -> DataFrame:
    """Canonical flow columns with ``errors`` and ``warnings``.

    An invalid address is an error (the row is rejected by ``valid_rows``); a bad port or time is a
    warning and gets 0 or ``as_of``.
    """

    def raw(field: str) -> Column:
        header = mapping.get(field)
        return F.col(f"`{header}`").cast("string") if header else F.lit(None).cast("string")

    def message(bad: Column, *parts: Column | str) -> Column:
        return F.when(bad, F.concat(*[F.lit(p) if isinstance(p, str) else p for p in parts]))

    def listed(*messages: Column) -> Column:
        return F.filter(F.array(*messages), lambda m: m.isNotNull())

    # Step by step, so that a value used more than once is computed once: raw text, trimmed text and
    # number, checked value.
    names = ("src_ip", "dest_ip", "src_port", "dest_port", "protocol", "timestamp", "duration", "label", "info")
    counts = ("src_bytes", "dest_bytes", "total_bytes", "src_pkts", "dest_pkts", "packet_count")
    step = df.select(*keep, *[raw(f).alias(f"__raw_{f}") for f in (*names, *counts)])
    texts = ("src_ip", "dest_ip", "src_port", "dest_port", "timestamp")
    step = step.select(
        "*",
        *[V.strip(F.col(f"__raw_{f}")).alias(f"__t_{f}") for f in texts],
        *[V.to_number(F.col(f"__raw_{f}")).alias(f"__n_{f}") for f in ("timestamp", "duration", *counts)],
        *[V.to_number(F.col(f"__raw_{f}")).try_cast("int").alias(f"__n_{f}") for f in ("src_port", "dest_port")],
    )
    no_time = F.col("__raw_timestamp").isNull() | (F.col("__raw_timestamp") == "")
    step = step.select(
        "*",
        *[V.valid_ip(F.col(f"__t_{f}")).alias(f"__{f}") for f in ("src_ip", "dest_ip")],
        *[V.valid_port(F.col(f"__t_{f}"), F.col(f"__n_{f}")).alias(f"__{f}") for f in ("src_port", "dest_port")],
        V.protocol_name(F.col("__raw_protocol")).alias("__protocol"),
        F.when(no_time, as_of).otherwise(V.time_of(F.col("__t_timestamp"), F.col("__n_timestamp"))).alias("__ts"),
        V.at_least(F.col("__n_duration")).alias("__duration"),
        *[V.whole_of(F.col(f"__n_{f}")).alias(f"__{f}") for f in counts],
    )
    total = F.when(F.col("__total_bytes") > 0, F.col("__total_bytes")).otherwise(
        F.col("__src_bytes") + F.col("__dest_bytes")
    )
    packets = F.when(F.col("__packet_count") > 0, F.col("__packet_count")).otherwise(
        F.greatest(F.lit(1), F.col("__src_pkts") + F.col("__dest_pkts"))
    )
    step = step.select("*", total.alias("__total"), packets.alias("__packets"))
    total, packets = F.col("__total"), F.col("__packets")

    def shown(field: str) -> Column:
        return F.coalesce(F.col(f"__raw_{field}"), F.lit("None"))

    return step.select(
        *keep,
        F.coalesce("__ts", as_of).alias("timestamp"),
        F.col("__src_ip").alias("src_ip"),
        F.col("__dest_ip").alias("dest_ip"),
        F.coalesce("__src_port", F.lit(0)).alias("src_port"),
        F.coalesce("__dest_port", F.lit(0)).alias("dest_port"),
        F.col("__protocol").alias("protocol"),
        F.col("__duration").alias("duration"),
        F.col("__src_bytes").alias("src_bytes"),
        F.col("__dest_bytes").alias("dest_bytes"),
        total.alias("total_bytes"),
        F.col("__src_pkts").alias("src_pkts"),
        F.col("__dest_pkts").alias("dest_pkts"),
        packets.alias("packet_count"),
        (total / packets).alias("avg_pkt_size"),
        V.protocol_id(F.col("__protocol")).alias("proto_num"),
        F.lit(0.0).alias("splt_mean"),
        F.lit(0.0).alias("dplt_mean"),
        V.strip(F.col("__raw_label")).alias("ground_truth_label"),
        F.when(F.col("__raw_info") != "", V.strip(F.col("__raw_info"))).alias("info"),
        F.lit("import").alias("source"),
        F.lit(fmt).alias("source_format"),
        F.lit(batch_id).cast("long").alias("import_batch_id"),
        F.lit(filename).alias("original_filename"),
        F.lit("N/A").alias("connection_state"),
        listed(
            message(F.col("__src_ip").isNull(), "Invalid source IP: '", shown("src_ip"), "'"),
            message(F.col("__dest_ip").isNull(), "Invalid destination IP: '", shown("dest_ip"), "'"),
        ).alias("errors"),
        listed(
            message(F.col("__src_port").isNull(), "Malformed source port '", shown("src_port"), "' defaulted to 0"),
            message(
                F.col("__dest_port").isNull(), "Malformed destination port '", shown("dest_port"), "' defaulted to 0"
            ),
            message(F.col("__ts").isNull(), "Unparseable timestamp '", shown("timestamp"), "' defaulted to UTC now"),
        ).alias("warnings"),
    )


def valid_rows(df: DataFrame) -> DataFrame:
    return df.where(F.size("errors") == 0)


def rejected_rows(df: DataFrame) -> DataFrame:
    return df.where(F.size("errors") > 0)


def can_classify(df_supports: bool = True) -> Column:
    """A flow can be classified if its volume is known."""
    return F.lit(df_supports) & (F.col("total_bytes") >= 0) & (F.col("packet_count") >= 1)


def to_features(df: DataFrame, keep: Iterable[str] = ()) -> DataFrame:
    """Model inputs of imported flows."""
    return df.select(
        *keep,
        F.col("src_bytes").cast("double").alias("sbytes"),
        F.col("dest_bytes").cast("double").alias("dbytes"),
        "splt_mean",
        "dplt_mean",
        F.col("proto_num").alias("proto_id"),
        F.col("packet_count").cast("double").alias("packet_count"),
        "avg_pkt_size",
    )


def validation_counts(df: DataFrame, order: str | None = None, n: int | None = None) -> DataFrame:
    """Valid, invalid and warning rows among all rows, or among the first ``n`` rows by ``order``."""
    if n is not None:
        if order is None:
            raise ValueError("the first rows need an order")
        df = df.orderBy(order).limit(n)
    return df.agg(
        F.count(F.lit(1)).alias("sample_validated"),
        F.count_if(F.size("errors") == 0).alias("valid_count"),
        F.count_if(F.size("errors") > 0).alias("invalid_count"),
        F.count_if(F.size("warnings") > 0).alias("warning_count"),
    )


def rejections(df: DataFrame, order: str, n: int = 100) -> DataFrame:
    """The first ``n`` rejected rows with their errors (a report: 50 when validating, 100 in a run)."""
    return rejected_rows(df).orderBy(order).limit(n).select(order, "errors")


__all__ = [
    "CANONICAL_FIELDS",
    "auto_mapping",
    "capabilities",
    "normalize",
    "rejections",
    "to_features",
    "valid_rows",
    "validation_counts",
]

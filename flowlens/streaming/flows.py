"""Flows from a packet stream."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.flows import CONVERSATION, finish_flows, flow_measures, prepare_packets


def build_flows_stream(packets: DataFrame, timeout: float = 2.0, delay: str = "1 minute", decode: str = "full") -> DataFrame:
    """Flows of a packet stream, each emitted once the watermark has passed its end.

    Same measures as the batch form. Spark joins rows exactly one gap apart, flows end at a silence
    of exactly ``timeout``, so the gap is one microsecond shorter. Packets later than ``delay`` are
    dropped by the watermark.
    """
    gap = f"{round(timeout * 1e6) - 1} microseconds"
    ready = prepare_packets(packets.withWatermark("ts", delay), decode)
    sessions = ready.groupBy(F.session_window("ts", gap).alias("session"), *CONVERSATION).agg(
        F.min("ord.us").alias("first_us"),
        F.max("ord.us").alias("last_us"),
        *[over_packets.alias(name) for name, (over_packets, _) in flow_measures().items()],
    )
    return finish_flows(sessions)

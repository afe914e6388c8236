"""Bidirectional flows from packets.

Nothing here keeps a list of packets: gaps telescope, the TCP state depends only on the last
SYN/FIN/RST and on whether an ACK came after it. So every measure merges, and a flow is one
aggregate over (conversation, session) in batch as well as in a stream.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.payloads import application, http_application
from ..functions.values import flow_protocol_id, micros
from .ordering import gap_sessions

CONVERSATION = ["lo", "hi", "protocol"]


def prepare_packets(packets: DataFrame, decode: str = "full") -> DataFrame:
    """Packet columns the flow aggregate needs: endpoints in fixed order, side, state class, L7.

    ``decode``: ``full`` (with TLS names and DNS questions), ``http`` (JVM only) or ``none``.
    """
    here = F.struct(F.col("src_ip").alias("ip"), F.col("src_port").alias("port"))
    there = F.struct(F.col("dest_ip").alias("ip"), F.col("dest_port").alias("port"))
    flags = F.coalesce(F.col("tcp_flags"), F.lit(""))
    is_tcp = F.col("protocol") == "TCP"
    # Hard classes set the state at once; a bare ACK only moves it on.
    hard = (
        F.when(flags.contains("S"), F.when(flags.contains("A"), "SYN_RCVD").otherwise("SYN_SENT"))
        .when(flags.contains("F"), "FIN_WAIT")
        .when(flags.contains("R"), "RESET")
    )
    l7_args = [F.col(c) for c in ("protocol", "src_port", "dest_port", "payload")]
    if decode == "full":
        l7 = application(*l7_args)
    elif decode == "http":
        l7 = http_application(*l7_args)
    else:
        l7 = F.lit(None).cast("struct<protocol_l7:string,info:string>")
    return packets.select(
        "ts",
        "protocol",
        F.least(here, there).alias("lo"),
        F.greatest(here, there).alias("hi"),
        # Both ends equal: every packet counts as forward.
        F.when(here <= there, "lo").otherwise("hi").alias("side"),
        F.col("length").cast("long").alias("length"),
        F.struct(micros(F.col("ts")).alias("us"), F.col("pkt_id")).alias("ord"),
        F.when(is_tcp, hard).alias("hard"),
        (is_tcp & hard.isNull() & flags.contains("A")).alias("soft"),
        l7.alias("l7"),
        "source",
    )


def flow_measures() -> dict[str, tuple[Column, object]]:
    """Mergeable measures: name -> (over packets, over partial rows)."""

    def on_side(side: str, value: Column) -> Column:
        return F.when(F.col("side") == side, value)

    us = F.col("ord.us")
    first_side = F.min(F.struct("ord", "side"))
    measures: dict[str, tuple[Column, object]] = {
        "opening": (first_side, F.min),
        "packet_count": (F.count(F.lit(1)), F.sum),
        "last_hard": (F.max(F.when(F.col("hard").isNotNull(), F.struct("ord", "hard"))), F.max),
        "last_soft": (F.max(F.when(F.col("soft"), F.col("ord"))), F.max),
        "first_l7": (
            F.min(
                F.when(
                    F.col("l7").isNotNull(),
                    F.struct("ord", F.col("l7.protocol_l7").alias("protocol_l7"), F.col("l7.info").alias("info")),
                )
            ),
            F.min,
        ),
        "source": (F.min("source"), F.min),
    }
    for side in ("lo", "hi"):
        measures[f"{side}_bytes"] = (F.coalesce(F.sum(on_side(side, F.col("length"))), F.lit(0)), F.sum)
        measures[f"{side}_pkts"] = (F.count(on_side(side, us)), F.sum)
        measures[f"{side}_first"] = (F.min(on_side(side, us)), F.min)
        measures[f"{side}_last"] = (F.max(on_side(side, us)), F.max)
    return measures


def finish_flows(sessions: DataFrame) -> DataFrame:
    """Flow columns from aggregated measures (columns ``first_us`` and ``last_us`` bound the flow)."""
    forward_lo = F.col("opening.side") == "lo"

    def way(forward: bool, name: str) -> Column:
        lo, hi = F.col(f"lo_{name}"), F.col(f"hi_{name}")
        return F.when(forward_lo, lo).otherwise(hi) if forward else F.when(forward_lo, hi).otherwise(lo)

    def mean_gap(forward: bool) -> Column:
        n = way(forward, "pkts")
        span = way(forward, "last") - way(forward, "first")
        return F.when(n > 1, span / F.lit(1e6) / (n - 1)).otherwise(0.0)

    state, since = F.col("last_hard.hard"), F.col("last_hard.ord")
    acked = F.col("last_soft").isNotNull() & (since.isNull() | (F.col("last_soft") > since))
    tcp_state = (
        F.when(state == "RESET", "RESET")
        .when(state == "FIN_WAIT", F.when(acked, "CLOSED").otherwise("FIN_WAIT"))
        .when(acked, "ESTABLISHED")
        .otherwise(F.coalesce(state, F.lit("INIT")))
    )
    src = F.when(forward_lo, F.col("lo")).otherwise(F.col("hi"))
    dest = F.when(forward_lo, F.col("hi")).otherwise(F.col("lo"))
    total = F.col("lo_bytes") + F.col("hi_bytes")
    return sessions.select(
        src["ip"].alias("src_ip"),
        dest["ip"].alias("dest_ip"),
        src["port"].alias("src_port"),
        dest["port"].alias("dest_port"),
        "protocol",
        F.col("first_l7.protocol_l7").alias("protocol_l7"),
        F.col("first_l7.info").alias("info"),
        F.when(F.col("protocol") == "TCP", tcp_state).otherwise("STATELESS").alias("connection_state"),
        F.timestamp_micros("first_us").alias("start_time"),
        F.timestamp_micros("last_us").alias("last_seen"),
        F.greatest(F.lit(0.001), (F.col("last_us") - F.col("first_us")) / F.lit(1e6)).alias("duration"),
        way(True, "bytes").alias("sbytes"),
        way(False, "bytes").alias("dbytes"),
        mean_gap(True).alias("splt_mean"),
        mean_gap(False).alias("dplt_mean"),
        flow_protocol_id(F.col("protocol")).alias("proto_id"),
        "packet_count",
        (total / F.col("packet_count")).alias("avg_pkt_size"),
        total.alias("total_bytes"),
        "source",
    )


def build_flows(packets: DataFrame, timeout: float = 2.0, decode: str = "full") -> DataFrame:
    """Flows of a packet table. A silence of ``timeout`` seconds or more ends a flow."""
    ready = prepare_packets(packets, decode)
    sessions = gap_sessions(ready, CONVERSATION, "ts", round(timeout * 1e6), flow_measures())
    return finish_flows(
        sessions.withColumnRenamed("__first", "first_us").withColumnRenamed("__last", "last_us")
    )


def feature_vector(flows: DataFrame, keep: list[str]) -> DataFrame:
    """The seven model inputs as doubles, with the columns to keep."""
    from ..schemas import FEATURES

    return flows.select(*keep, *[F.col(f).cast("double").alias(f) for f in FEATURES])


def packet_rate(packets: DataFrame, seconds: int) -> DataFrame:
    """Packets and bytes per second over tumbling windows."""
    start = F.floor(micros(F.col("ts")) / F.lit(seconds * 1_000_000)) * F.lit(seconds * 1_000_000)
    return (
        packets.groupBy(start.alias("us"))
        .agg(F.count(F.lit(1)).alias("packets"), F.sum(F.col("length").cast("long")).alias("bytes"))
        .select(
            F.timestamp_micros("us").alias("window_start"),
            "packets",
            "bytes",
            (F.col("packets") / F.lit(float(seconds))).alias("packets_per_sec"),
            (F.col("bytes") / F.lit(float(seconds))).alias("bytes_per_sec"),
        )
    )

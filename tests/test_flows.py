import os
import random
from datetime import datetime, timedelta, timezone

import pytest
from pyspark.sql import functions as F

from flowlens.operators import flows as FL
from flowlens.operators.ordering import gap_sessions, in_parts, running_totals
from flowlens.schemas import PACKETS
from flowlens.sources.streams import stream_packets
from flowlens.streaming.flows import build_flows_stream
from flowlens.streaming.run import drain

START = datetime(2024, 1, 1, tzinfo=timezone.utc)


def at(seconds):
    return START + timedelta(microseconds=round(seconds * 1e6))


def packet(i, t, src="10.0.0.1", dest="10.0.0.2", sport=1000, dport=443, protocol="TCP", length=100, flags="A", payload=None):
    return (i, at(t), src, dest, sport, dport, protocol, length, flags, payload, "live")


def frame(spark, rows):
    return spark.createDataFrame(rows, PACKETS)


def walk(rows, timeout):
    """Flows packet by packet, the plain way."""
    open_, done = {}, []
    for i, ts, src, dest, sport, dport, protocol, length, flags, _, _ in sorted(rows, key=lambda r: (r[1], r[0])):
        key, back = (src, dest, sport, dport, protocol), (dest, src, dport, sport, protocol)
        for k in (key, back):
            if k in open_ and (ts - open_[k]["last"]).total_seconds() >= timeout:
                done.append(open_.pop(k))
        name = key if key in open_ else back if back in open_ else key
        flow = open_.setdefault(
            name,
            {"key": name, "first": ts, "last": ts, "s": 0, "d": 0, "n": 0, "state": "INIT" if protocol == "TCP" else "STATELESS", "gaps": {True: [], False: []}, "seen": {}},
        )
        forward = name == key
        flow["last"], flow["n"] = ts, flow["n"] + 1
        flow["s" if forward else "d"] += length
        if forward in flow["seen"]:
            flow["gaps"][forward].append((ts - flow["seen"][forward]).total_seconds())
        flow["seen"][forward] = ts
        if protocol == "TCP":
            if "S" in flags:
                flow["state"] = "SYN_RCVD" if "A" in flags else "SYN_SENT"
            elif "F" in flags:
                flow["state"] = "FIN_WAIT"
            elif "R" in flags:
                flow["state"] = "RESET"
            elif "A" in flags:
                moved = {"SYN_SENT": "ESTABLISHED", "SYN_RCVD": "ESTABLISHED", "INIT": "ESTABLISHED", "FIN_WAIT": "CLOSED"}
                flow["state"] = moved.get(flow["state"], flow["state"])
    return done + list(open_.values())


def expected(rows, timeout):
    out = []
    for f in walk(rows, timeout):
        mean = {k: sum(g) / len(g) if g else 0.0 for k, g in f["gaps"].items()}
        out.append((*f["key"], f["first"].replace(tzinfo=None), f["last"].replace(tzinfo=None), f["s"], f["d"], f["n"], f["state"], pytest.approx(mean[True]), pytest.approx(mean[False])))
    return sorted(out, key=lambda r: r[:10])


def actual(flows):
    names = (
        "src_ip dest_ip src_port dest_port protocol start_time last_seen sbytes dbytes packet_count connection_state "
        "splt_mean dplt_mean"
    ).split()
    return sorted((tuple(r[n] for n in names) for r in flows.collect()), key=lambda r: r[:10])


def random_packets(n, seed, hosts=4, span=60):
    rng = random.Random(seed)
    rows = []
    for i in range(n):
        a, b = rng.sample(range(hosts), 2)
        protocol = rng.choice(["TCP", "TCP", "TCP", "UDP", "ICMP"])
        port = {"TCP": 443, "UDP": 53, "ICMP": 0}[protocol]
        t = rng.random() * span if rng.random() < 0.9 else float(rng.randrange(span))
        flags = rng.choice(["S", "SA", "A", "PA", "FA", "R", "P", "A", "A"]) if protocol == "TCP" else None
        rows.append(packet(i, t, f"10.0.0.{a}", f"10.0.0.{b}", port, port, protocol, rng.randrange(40, 1500), flags))
    return rows


@pytest.mark.parametrize("seed", [1, 2])
def test_random_packets_equal_a_walk(spark, seed):
    rows = random_packets(3000, seed)
    assert actual(FL.build_flows(frame(spark, rows), decode="none")) == expected(rows, 2.0)


def test_gap_at_the_timeout(spark):
    times = [0, 1.999999, 3.999998, 5.999998, 8.0]  # the last two gaps are 2 s and more
    rows = [packet(i, t) for i, t in enumerate(times)]
    assert [r[9] for r in actual(FL.build_flows(frame(spark, rows)))] == [3, 1, 1]


def test_equal_ends_are_forward(spark):
    rows = [packet(i, i / 10, src="10.0.0.1", dest="10.0.0.1", sport=5, dport=5) for i in range(3)]
    flow = FL.build_flows(frame(spark, rows)).head()
    assert (flow.sbytes, flow.dbytes) == (300, 0)


@pytest.mark.parametrize(
    "flags, state",
    [("P", "INIT"), ("A", "ESTABLISHED"), ("S", "SYN_SENT"), ("S,SA", "SYN_RCVD"), ("S,SA,A", "ESTABLISHED"), ("A,FA", "FIN_WAIT"),
     ("FA,A", "CLOSED"), ("R,A", "RESET"), ("RA", "RESET"), ("FA,A,A", "CLOSED"), ("FA,S,A", "ESTABLISHED"), ("", "INIT")],
)
def test_tcp_state(spark, flags, state):
    rows = [packet(i, i / 10, flags=f) for i, f in enumerate(flags.split(","))]
    assert FL.build_flows(frame(spark, rows)).head().connection_state == state


def test_application_of_first_telling_packet(spark):
    get = b"GET /a HTTP/1.1\r\nHost: first.example\r\n\r\n"
    rows = [
        packet(0, 0.0, dport=80),
        packet(1, 0.1, dport=80, payload=get),
        packet(2, 0.2, dport=80, payload=get.replace(b"first", b"other")),
        packet(3, 0.0, sport=7, dport=443, payload=b"\x17\x03\x03"),
        packet(4, 0.0, sport=8, dport=80, payload=b"POST /x HTTP/1.0\r\n\r\n"),
    ]
    found = {r.src_port: (r.protocol_l7, r.info) for r in FL.build_flows(frame(spark, rows)).collect()}
    assert found == {
        1000: ("HTTP", "HTTP Host: first.example"),
        7: ("HTTPS", "HTTPS/TLS Session"),
        8: ("HTTP", "HTTP: POST /x HTTP/1.0"),
    }


def test_sessions_across_chunks(spark):
    """Chunks of two cells: nearly every session crosses chunk borders."""
    rng = random.Random(5)
    rows, t = [], 0.0
    for _ in range(500):
        t += rng.choice([0.1, 0.5, 0.99, 1.0, 1.5, 3.0])
        rows.append(("k", at(t)))
    df = spark.createDataFrame(rows, "key string, ts timestamp")
    small = gap_sessions(df, ["key"], "ts", 1_000_000, {"n": (F.count(F.lit(1)), F.sum)}, chunk_cells=2)
    want, last = [], None
    for _, ts in rows:
        if last is None or ts - last >= timedelta(seconds=1):
            want.append(0)
        want[-1] += 1
        last = ts
    assert [r.n for r in small.orderBy("__first").collect()] == want


def test_running_totals_across_chunks(spark):
    rng = random.Random(6)
    rows = [(rng.choice("ab"), at(rng.random() * 100), i, rng.randrange(5)) for i in range(400)]
    df = spark.createDataFrame(rows, "key string, ts timestamp, id int, v int")
    got = running_totals(df, ["key"], ["ts", "id"], {"s": F.col("v"), "n": F.lit(1)})
    sums, want = {}, {}
    for key, _, i, v in sorted(rows, key=lambda r: (r[1], r[2])):
        s, n = sums.get(key, (0, 0))
        sums[key] = want[i] = (s + v, n + 1)
    assert {r.id: (r.s, r.n) for r in got.collect()} == want


def test_running_totals_of_null_keys(spark):
    df = spark.createDataFrame([(None, at(i), i) for i in range(5)] + [("a", at(0), 9)], "key string, ts timestamp, id int")
    got = running_totals(df, ["key"], ["ts", "id"], {"n": F.lit(1)})
    assert {r.id: r.n for r in got.collect()} == {0: 1, 1: 2, 2: 3, 3: 4, 4: 5, 9: 1}


def test_hot_key_is_spread(spark):
    """One key with all rows: no part holds more than a bounded share of them."""
    rows = spark.range(40_000).select(F.lit("hot").alias("key"), (F.col("id") % 100).cast("timestamp").alias("ts"), "id")
    size = "spark.sql.adaptive.coalescePartitions.enabled"
    spark.conf.set(size, "false")  # else Spark joins small parts
    try:
        parts = in_parts(rows, ["key"], ["ts", "id"], "hot").groupBy("__part").count().collect()
    finally:
        spark.conf.set(size, "true")
    assert len(parts) == 4 and max(r["count"] for r in parts) < 20_000


def test_stream_equals_batch(spark, tmp_path):
    """Shuffled arrival in several files, within the watermark; a closing packet lets all flows end."""
    rows = random_packets(800, 3, span=40) + [packet(9999, 500, src="9.9.9.9", dest="9.9.9.8")]
    batch = [r for r in expected(rows, 2.0) if r[0] != "9.9.9.9"]
    by_time = sorted(rows, key=lambda r: r[1])
    for n in range(4):  # files in time order, rows inside in any order
        part = by_time[n * 200 : (n + 1) * 200] if n < 3 else by_time[600:]
        random.Random(n).shuffle(part)
        frame(spark, part).coalesce(1).write.parquet(f"{tmp_path}/in/part={n}")
    stream = stream_packets(spark, f"{tmp_path}/in/*", files_per_trigger=1)
    got = actual(drain(spark, build_flows_stream(stream, 2.0, "1 minute", "none"), "flows"))
    assert got == batch


def test_late_packets_are_dropped(spark, tmp_path):
    for n, rows in enumerate([[packet(0, 100)], [packet(1, 200)], [packet(2, 300)], [packet(3, 101), packet(4, 400)]]):
        folder = f"{tmp_path}/in/part={n}"
        frame(spark, rows).coalesce(1).write.parquet(folder)
        for name in os.listdir(folder):  # arrival order
            os.utime(f"{folder}/{name}", (1_700_000_000 + n, 1_700_000_000 + n))
    stream = stream_packets(spark, f"{tmp_path}/in/*", files_per_trigger=1)
    got = actual(drain(spark, build_flows_stream(stream, 2.0, "10 seconds", "none"), "late"))
    assert [r[9] for r in got] == [1, 1, 1]  # 100, 200 and 300; 101 came too late, 400 is still open


def test_hot_conversation_shrinks_before_the_shuffle(spark):
    """One conversation with nearly all packets: the first shuffle carries cells, not packets."""
    rows = spark.range(200_000).select(
        F.col("id").alias("pkt_id"), F.timestamp_micros(F.col("id") * 100).alias("ts"), F.lit("a").alias("src_ip"), F.lit("b").alias("dest_ip"),
        F.lit(1).alias("src_port"), F.lit(2).alias("dest_port"), F.lit("TCP").alias("protocol"), F.lit(10).alias("length"),
        F.lit("A").alias("tcp_flags"), F.lit(None).cast("binary").alias("payload"), F.lit("live").alias("source"),
    )
    flows = FL.build_flows(rows, decode="none")
    flow = flows.head()
    assert (flow.packet_count, flow.sbytes) == (200_000, 2_000_000)
    plan = flows._jdf.queryExecution().executedPlan().toString()
    first_exchange = plan.rindex("Exchange hashpartitioning")
    assert "partial_count" in plan[first_exchange:]


def test_packet_rate(spark):
    got = FL.packet_rate(frame(spark, [packet(0, 0.5), packet(1, 1.5), packet(2, 11)]), 10).orderBy("window_start").collect()
    assert [(r.packets, r.bytes, r.packets_per_sec, r.bytes_per_sec) for r in got] == [(2, 200, 0.2, 20.0), (1, 100, 0.1, 10.0)]

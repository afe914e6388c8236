import random
from datetime import datetime, timedelta, timezone

import pytest
from pyspark.sql import functions as F

from flowlens.functions import verdicts
from flowlens.operators import alerts as al
from flowlens.operators import arp
from flowlens.operators.ordering import in_parts
from flowlens.streaming import state
from flowlens.streaming.run import drain, late_rows, state_partitions, to_folder

START = datetime(2024, 1, 1, tzinfo=timezone.utc)
EVENT = (
    "id long, ts timestamp, threat_level string, alert_type string, device string, src_ip string, dest_ip string, "
    "protocol string, is_simulated boolean"
)
ACTION = "id long, ts timestamp, threat_level string, alert_type string, device string, action string"


def at(seconds):
    return START + timedelta(microseconds=round(seconds * 1e6))


def event(i, t, device="d", level="High", sim=False):
    return (i, at(t), level, "flow_classification", device, device, "x", "TCP", sim)


def close_with(spark, rows, schema, path):
    """A last file whose rows move the clock beyond all others."""
    spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(path)


def action(i, t, what, device="d", level="High"):
    return (i, at(t), level, "flow_classification", device, what)


def walk(events, actions):
    """Alerts event by event, the plain way."""
    line = [(e[1], 0, e[0], e) for e in events] + [(a[1], 1, a[0], a) for a in actions]
    open_, done = {}, []
    for ts, kind, ident, row in sorted(line, key=lambda x: x[:3]):
        key = row[2:5]
        alert = open_.get(key)
        if kind == 0 and alert is None:
            open_[key] = {"id": ident, "key": key, "first": ts, "last": ts, "n": 1, "status": "New", "sim": row[8]}
        elif kind == 0:
            alert["n"] += 1
            alert["last"] = ts
            alert["sim"] |= row[8]
            alert["status"] = "Active" if alert["status"] == "New" else alert["status"]
        elif alert is not None and row[5] == "acknowledge":
            alert["status"] = "Acknowledged"
        elif alert is not None:
            alert["status"] = "Resolved"
            done.append(open_.pop(key))
    rows = done + list(open_.values())
    return sorted((a["id"], *a["key"], a["first"].replace(tzinfo=None), a["last"].replace(tzinfo=None), a["n"], a["status"], a["sim"]) for a in rows)


def shown(df):
    names = "alert_id threat_level alert_type device alert_time last_seen count status is_simulated".split()
    return sorted(tuple(r[n] for n in names) for r in df.collect())


def random_line(seed, n=2000, span=600):
    rng = random.Random(seed)
    events, actions = [], []
    for i in range(n):
        t = rng.random() * span if rng.random() < 0.7 else rng.randrange(span) / 2  # many equal instants
        device, level = rng.choice("aaab"), rng.choice(["High", "High", "Low"])
        if rng.random() < 0.9:
            events.append(event(i, t, device, level, rng.random() < 0.05))
        else:
            actions.append(action(i, t, rng.choice(["acknowledge", "resolve"]), device, level))
    return events, actions


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_incidents_equal_a_walk(spark, seed):
    events, actions = random_line(seed)
    df = al.incidents(spark.createDataFrame(events, EVENT), spark.createDataFrame(actions, ACTION))
    assert shown(df) == walk(events, actions)


def test_incident_lifecycle(spark):
    events = [event(1, 0), event(2, 5), event(3, 20), event(4, 21), event(5, 0, "other")]
    actions = [action(10, 6, "acknowledge"), action(11, 10, "resolve"), action(12, 11, "resolve")]
    df = al.incidents(spark.createDataFrame(events, EVENT), spark.createDataFrame(actions, ACTION))
    assert {r.alert_id: (r.status, r["count"]) for r in df.collect()} == {1: ("Resolved", 2), 3: ("Active", 2), 5: ("New", 1)}
    open_ = {r.device: r.alert_id for r in al.open_alerts(df).collect()}
    assert open_ == {"d": 3, "other": 5}


def test_incident_stream_equals_batch(spark, tmp_path):
    events, actions = random_line(4, n=600)
    rows = state.timeline(spark.createDataFrame(events, EVENT), spark.createDataFrame(actions, ACTION))
    lines = rows.collect()
    random.Random(5).shuffle(lines)  # files overlap in time wholly
    schema = rows.schema
    for n in range(3):
        spark.createDataFrame(lines[n * 200 : (n + 1) * 200], schema).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
    close_with(spark, [(*lines[0][:2], "clock", 10**9, 10**17, *lines[0][5:])], schema, f"{tmp_path}/in")
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in")
    changes = drain(spark, state.incidents_stream(stream, "30 days"), "incidents").where("device <> 'clock'")
    assert shown(state.present_incidents(changes)) == walk(events, actions)


def test_alert_windows(spark):
    rows = [event(i, t) for i, t in enumerate([0, 29.999999, 59.999998, 89.999998, 200])]
    got = al.alert_windows(spark.createDataFrame(rows, EVENT), 30).orderBy("first_seen").collect()
    assert [r["count"] for r in got] == [3, 1, 1]


def greedy(rows, seconds):
    last, picks = {}, []
    for r in sorted(rows, key=lambda r: (r[1], r[0])):
        key = (r[5], r[6], r[7], r[2])
        if key not in last or (r[1] - last[key]).total_seconds() >= seconds:
            last[key] = r[1]
            picks.append(r[0])
    return sorted(picks)


@pytest.mark.parametrize("parts", [1, 7, 40])
def test_rate_limit_equals_greedy(spark, parts):
    rng = random.Random(parts)
    rows = [event(i, rng.random() * 300, rng.choice("aaaab")) for i in range(1500)]
    rows += [event(5000 + i, i * 0.5, "c") for i in range(200)]  # no pause anywhere: one long chain
    rows += [event(6000 + i, 400 + i * 2.0, "e") for i in range(20)]  # exactly the limit apart
    rows += [event(7000 + i, 500 + i // 3, "f") for i in range(60)]  # equal instants
    df = spark.createDataFrame(rows, EVENT)
    with state_partitions(spark, parts):
        got = sorted(r.id for r in al.rate_limit(df, 2.0).collect())
    assert got == greedy(rows, 2.0)


def test_rate_limit_splits_a_hot_key(spark):
    """A third of all events on one key: no task reads more than a few of its parts."""
    rng = random.Random(3)
    rows = [event(i, i * 0.01, "hot") for i in range(3000)] + [event(9000 + i, rng.random() * 900, f"k{i % 50}") for i in range(6000)]
    df = spark.createDataFrame(rows, EVENT)
    with state_partitions(spark, 30):
        out = al.rate_limit(df, 2.0)
        assert sorted(r.id for r in out.collect()) == greedy(rows, 2.0)
        # Small shuffles are coalesced by default; uncoalesced, the hot key lies in many parts of like size.
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
        try:
            assert sorted(r.id for r in al.rate_limit(df, 2.0).collect()) == greedy(rows, 2.0)
            cut = in_parts(df, al.NOTIFY_KEY, ["ts"], "hot").groupBy("__part").count()
            assert cut.agg(F.max("count")).head()[0] < 1200
        finally:
            spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")
    assert al.rate_limit(df.limit(0), 2.0).collect() == []


def test_rate_limit_keeps_null_keys(spark):
    df = spark.createDataFrame([(1, 5, "a", None), (2, 5, "a", None), (3, None, None, "x")], "id long, n long, src string, dest string")
    df = df.withColumn("ts", F.col("id").cast("timestamp"))
    got = al.rate_limit(df, 2.0, ["n", "src", "dest"])
    assert sorted((r.id, r.n, r.src, r.dest) for r in got.collect()) == [(1, 5, "a", None), (3, None, None, "x")]


def test_rate_limit_stream(spark, tmp_path):
    rng = random.Random(9)
    rows = [event(i, rng.random() * 100, rng.choice("ab")) for i in range(300)]
    schema = spark.createDataFrame(rows[:1], EVENT).schema
    for n in range(3):
        spark.createDataFrame(rows[n * 100 : (n + 1) * 100], EVENT).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
    close_with(spark, [event(9999, 10**6, "clock")], EVENT, f"{tmp_path}/in")
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in")
    sent = drain(spark, state.rate_limit_stream(stream, 2.0, delay="2 minutes"), "sent")
    assert sorted(r.id for r in sent.collect() if r.src_ip != "clock") == greedy(rows, 2.0)


def test_late_rows_are_dropped_and_counted_and_idle_keys_forgotten(spark, tmp_path):
    """A row later than the delay changes nothing; a key that was idle for an hour starts anew."""
    batches = [[event(1, 0.0, "a"), event(2, 100.0, "b")], [event(3, 200.0, "b")], [event(4, 1.0, "a"), event(5, 9000.0, "b")], [event(6, 9001.0, "a")]]
    for rows in [*batches, [event(7, 10**5, "clock")], [event(8, 10**6, "clock")]]:
        spark.createDataFrame(rows, EVENT).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
    schema = spark.createDataFrame(batches[0], EVENT).schema
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in")
    # The gap is longer than an hour, so only a forgotten key may send again.
    sent = state.rate_limit_stream(stream, 1e5, delay="10 seconds", idle_hours=1.0)
    running = to_folder(sent, f"{tmp_path}/out", f"{tmp_path}/checkpoint")
    running.awaitTermination()
    assert sum(n for _, n in late_rows(running)) == 1
    got = spark.read.parquet(f"{tmp_path}/out").where("src_ip <> 'clock'")
    assert sorted((r.src_ip, r.id) for r in got.collect()) == [("a", 1), ("a", 6), ("b", 2), ("b", 5)]


def test_arp_conflicts(spark):
    rows = [(1, at(0), 2, "10.0.0.1", "aa"), (2, at(1), 2, "10.0.0.1", "aa"), (3, at(2), 2, "10.0.0.1", "bb"), (4, at(3), 2, "10.0.0.1", "aa"),
            (5, at(0), 1, "10.0.0.2", "cc"), (6, at(1), 2, "10.0.0.2", "dd"), (7, at(4), 2, "10.0.0.1", "bb")]
    replies = spark.createDataFrame(rows, "id long, ts timestamp, op int, ip string, mac string")
    found = arp.arp_conflicts(replies)
    assert sorted((r.id, r.old_mac, r.new_mac) for r in found.collect()) == [(3, "aa", "bb"), (7, "aa", "bb")]
    log = arp.arp_logs(found).orderBy("id").head()
    assert log.info == "ARP Spoofing: IP 10.0.0.1 claimed by MAC bb (previously aa)" and log.total_bytes == 42


@pytest.mark.parametrize(
    "label, sbytes, splt, packets, size, threat",
    [
        ("Normal", 0, 0, 0, 0, "Normal Traffic"),
        ("Malicious", 15001, 0, 1, 1, "Potential DoS / Volumetric Flood"),
        ("Malicious", 1, 0, 101, 1, "Potential DoS / Volumetric Flood"),
        ("Malicious", 15000, 0, 100, 1001, "Anomalous Volume / Potential Exfiltration"),
        ("Malicious", 15000, 0, 100, 1000, "Anomalous Traffic Deviation"),
        ("Suspicious", 1000, 0.0049, 6, 1, "Possible Port Scan / Reconnaissance"),
        ("Suspicious", 499, 0.0, 2, 1, "Possible Port Probe"),
        ("Suspicious", 500, 0.005, 6, 1, "Unusual Flow Characteristic"),
    ],
)
def test_explanations(spark, label, sbytes, splt, packets, size, threat):
    df = spark.createDataFrame([(label, float(sbytes), float(splt), float(packets), float(size))], "l string, s double, t double, p double, z double")
    told = df.select(verdicts.explanation(*[F.col(c) for c in "lstpz"]).alias("x")).head().x
    assert told.threat_type == threat
    if threat.endswith("Flood"):
        assert f"({sbytes} bytes) over {packets} packets" in told.reason
    if threat.endswith("Reconnaissance"):
        assert "(0.004900s)" in told.reason


def test_notes_read_back(spark):
    df = spark.range(1).select(
        verdicts.note(F.lit(True), *[F.lit(x) for x in ("1.1.1.1", "2.2.2.2", "TCP", "Flood", "because", "act", "Host: h")]).alias("n")
    )
    note = df.head().n
    assert note == "[SIMULATION] [1.1.1.1 -> 2.2.2.2 | TCP] Diagnosis: Flood | Reason: because | Action: act | Context: Host: h"
    back = df.select(verdicts.parse_note(F.col("n")).alias("p")).head().p
    assert (back.threat_type, back.reason, back.action) == ("Flood", "because", "act")
    empty = spark.createDataFrame([(None,)], "n string").select(verdicts.parse_note(F.col("n")).alias("p")).head().p
    assert empty.threat_type == "Anomaly Intrusion Signature"


def test_levels_and_statuses(spark):
    def one(column):
        return spark.range(1).select(column.alias("x")).head().x

    lit = F.lit
    assert one(verdicts.live_level(lit("Malicious"), lit(0.9))) == "Critical"
    assert one(verdicts.live_level(lit("Suspicious"), lit(0.79))) == "Low"
    assert one(verdicts.live_level(lit("Normal"), lit(0.9))) is None
    assert one(verdicts.import_level(lit(True), lit("Malicious"))) == "High"
    assert one(verdicts.device_status(lit(False), lit(20))) == "Warming Up"
    assert one(verdicts.device_status(lit(True), lit(20))) == "Anomalous"
    assert one(verdicts.device_badge(lit(False), lit(21), lit(0.7))) == "Anomalous Spike"
    assert [one(verdicts.health_status(lit(h))) for h in (49, 50, 84, 85)] == ["Critical", "Warning", "Warning", "Optimal"]
    assert one(verdicts.provenance("import", lit(3))) == "import:3" and one(verdicts.provenance("live")) == "live"

"""Device anomaly, drift, watchlist, classifier."""

import random
from datetime import datetime, timedelta, timezone

import numpy as np
import pytest
from pyspark.sql import functions as F

from flowlens.operators import anomaly, devices, drift, evaluate, model, watchlist
from flowlens.schemas import FEATURES
from flowlens.streaming import state
from flowlens.streaming.run import drain

START = datetime(2024, 1, 1, tzinfo=timezone.utc)
FLOW = "id long, timestamp timestamp, src_ip string, total_bytes long, duration double, protocol string, packet_count long"


def random_flows(n=700, seed=1):
    rng = random.Random(seed)
    rows = []
    for i in range(n):
        odd = rng.random() < 0.05
        rows.append(
            (i, START + timedelta(seconds=rng.random() * 9e5), rng.choice(["10.0.0.1"] * 4 + ["10.0.0.2"]),
             rng.randrange(10**8) if odd else rng.randrange(2000), rng.random() * (4000 if odd else 60),
             rng.choice(["TCP", "UDP", "ICMP", "DNS"]), rng.randrange(60_000 if odd else 50))
        )
    return sorted(rows, key=lambda r: (r[1], r[0]))


def plain_scores(rows, forest, window=20):
    """Trees walked one by one, masses kept in dicts."""
    state_, out = {}, {}
    number = {"TCP": 6, "UDP": 17, "ICMP": 1}
    for i, ts, ip, size, duration, protocol, packets in rows:
        x = [min(size, 1e8) / 1e8, min(duration, 3600) / 3600, number.get(protocol, 0) / 255, ts.hour / 24, min(packets, 5e4) / 5e4]
        paths = []
        for t in range(len(forest.dims)):
            node, path = 1, [1]
            for _ in range(forest.height):
                node = 2 * node + int(x[forest.dims[t, node]] >= forest.cuts[t, node])
                path.append(node)
            paths.append(path)
        s = state_.setdefault(ip, {"n": 0, "now": {}, "ref": None})
        if s["ref"] is None:
            out[i] = 0.0
        else:
            total = 0
            for t, path in enumerate(paths):
                for depth, node in enumerate(path):
                    mass = s["ref"].get((t, node), 0)
                    total += mass * 2**depth
                    if mass < 0.1 * window:
                        break
            out[i] = 1 - total / (len(paths) * window * (2 ** (forest.height + 1) - 1))
        for t, path in enumerate(paths):
            for node in path:
                s["now"][t, node] = s["now"].get((t, node), 0) + 1
        s["n"] += 1
        if s["n"] % window == 0:
            s["ref"], s["now"] = s["now"], {}
    return out


def test_scores_equal_plain_trees(spark):
    rows = random_flows()
    got = anomaly.device_anomaly(spark.createDataFrame(rows, FLOW))
    want = plain_scores(rows, anomaly.build_forest())
    assert {r.id: r.score for r in got.collect()} == pytest.approx(want)
    assert got.where("is_anomalous and sample_no <= 20").count() == 0


def test_score_stream_equals_batch(spark, tmp_path):
    rows = random_flows(300, 2)
    schema = spark.createDataFrame(rows[:1], FLOW).schema
    mixed = random.Random(1).sample(rows, 300)  # files overlap in time
    mixed.append([START + timedelta(days=900) if isinstance(v, datetime) else "clock" if n == "src_ip" else v for n, v in zip(schema.names, rows[0])])
    for n in range(4):
        spark.createDataFrame(mixed[n * 100 : (n + 1) * 100], schema).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in")
    got = drain(spark, state.device_anomaly_stream(stream, delay="30 days"), "scores").where("src_ip <> 'clock'")
    assert {r.id: r.score for r in got.collect()} == pytest.approx(plain_scores(rows, anomaly.build_forest()))


def test_blocks_bound_a_busy_device(spark):
    """One device with all flows: no task gets more than two blocks of it at once."""
    rows = random_flows(2000, 3)
    df = spark.createDataFrame(rows, FLOW).withColumn("src_ip", F.lit("10.0.0.1"))
    assert anomaly.device_anomaly(df).count() == 2000


def test_device_summary(spark):
    rows = [(i, START + timedelta(seconds=i), "d", 100 + i, 1.0, "TCP" if i % 3 else "UDP", 1) for i in range(25)]
    summary = devices.device_summary(anomaly.device_anomaly(spark.createDataFrame(rows, FLOW))).head()
    assert (summary.sample_count, summary.total_bytes, summary.avg_bytes) == (25, 2800, 112.0)
    assert summary.protocols == {"TCP": 16, "UDP": 9} and summary.status in ("Normal", "Anomalous")
    stats = devices.profiler_stats(spark.createDataFrame(rows, FLOW), 0).head()
    assert (stats.active_devices, stats.total_evictions, stats.total_flows_evaluated) == (0, 1, 25)


def test_latest_profiles(spark):
    rows = [("a", START, 1, {"TCP": 1}), ("a", START + timedelta(1), 2, {"UDP": 2}), ("b", START, 3, {})]
    df = spark.createDataFrame(rows, "device_ip string, last_seen timestamp, sample_count long, protocols map<string,long>")
    assert {r.device_ip: (r.sample_count, r.protocols) for r in devices.latest_profiles(df).collect()} == {"a": (2, {"UDP": 2}), "b": (3, {})}


def drift_rows(spark):
    rng = np.random.default_rng(3)
    rows = []
    for i in range(4000):
        rate = 0.1 if i < 2000 else 0.6
        rows.append(("shift", START + timedelta(seconds=i), bool(rng.random() < rate)))
        rows.append(("steady", START + timedelta(seconds=i), bool(rng.random() < 0.3)))
    return spark.createDataFrame(rows, "stream string, ts timestamp, wrong boolean")


def test_drift_found_where_it_is(spark):
    cuts = drift.drift_points(drift_rows(spark), "stream", "ts", F.col("wrong"), block_us=32_000_000).collect()
    assert {r.stream for r in cuts} == {"shift"}
    first = min(r.timestamp for r in cuts) - START.replace(tzinfo=None)
    assert 2000 <= first.total_seconds() <= 2300
    history = drift.drift_history(spark.createDataFrame(cuts), 1).collect()
    assert len(history) == 1


def test_drift_stream_equals_batch(spark, tmp_path):
    rows = drift_rows(spark)
    batch = {(r.stream, r.timestamp, r.width) for r in drift.drift_points(rows, "stream", "ts", F.col("wrong"), block_us=32_000_000).collect()}
    mixed = random.Random(1).sample(rows.collect(), 8000)  # files overlap in time, so blocks do
    mixed.append(("clock", START + timedelta(days=900), False))
    for n in range(5):
        part = mixed[n * 2000 : (n + 1) * 2000]
        spark.createDataFrame(part, rows.schema).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
    stream = spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in")
    got = drain(spark, state.drift_stream(stream, "stream", "ts", F.col("wrong"), block_us=32_000_000, delay_seconds=86_400), "drift")
    assert {(r.stream, r.timestamp, r.width) for r in got.collect()} == batch


def test_window_keeps_few_buckets():
    window = drift.AdaptiveWindow()
    for i in range(10_000):
        window.add(10, i % 3)
    assert window.size == 100_000 and len(window.buckets) < 80


WATCH = [
    (1, "10.0.0.66", "ipv4", "a"), (2, "2001:db8::1", "ipv6", "b"), (3, "Evil.example", "domain", "c"), (4, "evil", "hostname", "d"),
    (5, "bad.example.org", "domain", "e"), (6, "10.0.0.66", "ipv4", "again"), (7, "", "domain", "empty"),
]


def test_watchlist(spark):
    flows = [
        (1, "10.0.0.66", "1.1.1.1", "x"), (2, "1.1.1.1", "2001:db8::1", "evil"), (3, "1.1.1.1", "2.2.2.2", "DNS Query: sub.EVIL.example"),
        (4, "1.1.1.1", "2.2.2.2", "devil"), (5, "1.1.1.1", "2.2.2.2", None), (6, "1.1.1.1", "2.2.2.2", ""), (7, "1.1.1.1", "2.2.2.2", "bad.example.or"),
        (8, "10.0.0.66", "2001:db8::1", None), (9, "3.3.3.3", "2.2.2.2", "BAD.example.orgs"),
    ]
    df = spark.createDataFrame([(*f, START) for f in flows], "id int, src_ip string, dest_ip string, info string, timestamp timestamp")
    entries = spark.createDataFrame(WATCH, "id long, value string, entry_type string, label string")
    got = watchlist.attach_entry(watchlist.match_watchlist(df, entries), entries)
    assert {r.id: (r.watch_id, r.watch_side, r.watch_label) for r in got.collect()} == {
        1: (6, "src", "again"), 2: (2, "dest", "b"), 3: (3, "info", "c"), 4: (4, "info", "d"), 5: (None, None, None),
        6: (None, None, None), 7: (None, None, None), 8: (6, "src", "again"), 9: (5, "info", "e"),
    }


def test_text_hits_equal_plain_search(spark):
    rng = random.Random(4)
    texts = list({"".join(rng.choice("aAb.") for _ in range(rng.randrange(0, 12))) for _ in range(300)})
    keys = sorted({"".join(rng.choice("ab.") for _ in range(rng.randrange(1, 6))) for _ in range(40)})
    rng.shuffle(keys)
    entries = spark.createDataFrame([(k, i, 100 + i) for i, k in enumerate(keys)], "key string, place int, entry_id int")
    got = watchlist.text_hits(spark.createDataFrame([(t,) for t in texts], "t string"), "t", entries)
    want = {}
    for t in texts:
        hits = [100 + i for i, k in enumerate(keys) if k in t.lower()]
        if hits:
            want[t] = min(hits)
    assert {r.t: r.entry_id for r in got.collect()} == want


def test_empty_watchlist(spark):
    df = spark.createDataFrame([(1, "1.1.1.1", "2.2.2.2", "x", START)], "id int, src_ip string, dest_ip string, info string, timestamp timestamp")
    entries = spark.createDataFrame([], "id long, value string, entry_type string, label string")
    assert watchlist.match_watchlist(df, entries).head().watch_id is None


def test_classifier_knows_its_classes(spark):
    fitted = model.train_baseline(spark)
    rows = [
        (500.0, 500.0, 0.05, 0.05, 1.0, 10.0, 70.0),
        (20000.0, 500.0, 0.005, 0.0, 1.0, 300.0, 1000.0),
        (64.0, 0.0, 0.001, 0.0, 1.0, 1.0, 64.0),
    ]
    out = model.classify(spark.createDataFrame(rows, list(FEATURES)), fitted).collect()
    assert [r.prediction_label for r in out] == ["Normal", "Malicious", "Suspicious"]
    assert all(0.5 < r.confidence_score <= 1.0 for r in out)


def test_label_rule(spark):
    rows = [(True, True, "Malicious", 0.7), (True, False, "Malicious", 0.7), (False, False, "Malicious", 0.7)]
    df = spark.createDataFrame(rows, "hit boolean, ok boolean, l string, c double")
    out = df.select(*model.label_rule(*[F.col(c) for c in ("hit", "ok", "l", "c")])).collect()
    assert [tuple(r) for r in out] == [("Malicious", 0.7), ("Suspicious", 0.9), ("Normal", 0.85)]


def test_metrics_without_rows(spark):
    empty = spark.createDataFrame([], "truth string, predicted string")
    assert evaluate.eval_metrics(empty).head().accuracy == 0.0
    assert evaluate.model_metrics(empty, F.lit(True)).head().rolling_accuracy == 1.0
    assert evaluate.confusion(empty).count() == 9

"""Stored tables, exports, imports and the live pipeline."""

import csv
import glob
import json
from datetime import date, datetime, timedelta, timezone

import pytest
from pyspark.sql import functions as F

from flowlens.operators import alerts as al
from flowlens.operators import model, normalize, search
from flowlens.operators.watchlist import newest_first
from flowlens.plans import importer, live
from flowlens.schemas import FEATURES, PACKETS, WATCHLIST
from flowlens.sinks import exports, tables
from flowlens.streaming import state

START = datetime(2024, 1, 1, tzinfo=timezone.utc)
LOG = (
    "id long, timestamp timestamp, src_ip string, dest_ip string, src_port int, dest_port int, protocol string, duration long, "
    "total_bytes long, prediction_label string, confidence_score double, info string, source string, connection_state string, "
    "import_batch_id long"
)


def log(i, day=0, batch=None, **other):
    row = {"src_ip": "10.0.0.1", "dest_ip": "10.0.0.2", "protocol": "TCP", "label": "Normal", "info": None} | other
    return (i, START + timedelta(days=day, seconds=i), row["src_ip"], row["dest_ip"], 1, 2, row["protocol"], 3, 100, row["label"], 0.9, row["info"], "live", "N/A", batch)


def logs(spark, *rows):
    return spark.createDataFrame(list(rows), LOG)


def as_of():
    return F.to_timestamp(F.lit("2024-01-31 00:00:00"))


def test_logs_append_delete_and_purge(spark):
    tables.append_logs(logs(spark, log(1), log(2, 1, 7), log(3, 2, 8)), "t_logs")
    tables.append_logs(logs(spark, log(4, 3, 7)), "t_logs")
    assert spark.table("t_logs").count() == 4
    tables.append(spark.createDataFrame([(1, 7), (2, None)], "id long, import_batch_id long"), "t_watch")
    tables.append(spark.createDataFrame([(7,), (8,)], "id long"), "t_batches")
    tables.delete_batch(spark, 7, "t_logs", "t_none", "t_watch", "t_batches")
    assert sorted(r.id for r in spark.table("t_logs").collect()) == [1, 3]
    assert [r.id for r in spark.table("t_watch").collect()] == [2]
    assert [r.id for r in spark.table("t_batches").collect()] == [8]
    assert tables.purge_before(spark, date(2024, 1, 2), "t_logs") == 1
    assert [r.id for r in spark.table("t_logs").collect()] == [3]


def test_batch_filter_reads_one_partition(spark):
    tables.append_logs(logs(spark, log(1, 0, 1), log(2, 0, 2)), "t_pruned")
    plan = spark.table("t_pruned").where("import_batch_id = 2")._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(import_batch_id" in plan


def test_watchlist_table(spark):
    feed = spark.createDataFrame([("1.2.3.4", "ipv4", 3), ("a.example", "domain", 4), ("a.example", "domain", 9)], "value string, entry_type string, line int")
    tables.add_to_watchlist(feed, "feed.txt", as_of(), name="t_list")
    tables.add_to_watchlist(feed.unionByName(spark.createDataFrame([("new.example", "domain", 1)], feed.schema)), "two.txt", as_of(), name="t_list")
    rows = {r.value: r for r in spark.table("t_list").collect()}
    assert sorted(rows) == ["1.2.3.4", "a.example", "new.example"]
    assert rows["a.example"].description == "Imported from feed.txt (line 4)" and rows["new.example"].source == "txt_import:two.txt"
    tables.remove_from_watchlist(spark, rows["1.2.3.4"].id, "t_list")
    assert spark.table("t_list").count() == 2
    assert newest_first(spark.table("t_list")).count() == 2
    assert set(WATCHLIST.fieldNames()) == set(spark.table("t_list").columns)


def test_epoch_written_twice_counts_once(spark, tmp_path):
    out = str(tmp_path / "out")
    tables.write_epoch(spark.range(3), out, 0)
    tables.write_epoch(spark.range(5), out, 1)
    tables.write_epoch(spark.range(5), out, 1)
    assert spark.read.parquet(out).count() == 8


def test_exports(spark, tmp_path):
    df = logs(spark, *[log(i, batch=5, info='say "x", y' if i == 2 else None) for i in range(4)])
    exports.write_csv(exports.batch_rows(df, 5), str(tmp_path / "csv"))
    lines = []
    for name in sorted(glob.glob(str(tmp_path / "csv/part-*"))):
        with open(name, newline="") as f:
            lines += list(csv.DictReader(f))
    assert [r["id"] for r in lines] == ["0", "1", "2", "3"]
    assert lines[2]["info"] == 'say "x", y' and lines[0]["info"] == "" and lines[1]["timestamp"] == "2024-01-01T00:00:01.000000"
    assert list(lines[0]) == list(exports.BATCH_COLUMNS)
    exports.write_json(exports.batch_rows(df, 5, exports.BATCH_JSON_COLUMNS), str(tmp_path / "json"))
    records = [json.loads(line) for name in glob.glob(str(tmp_path / "json/part-*")) for line in open(name)]
    assert len(records) == 4 and set(records[0]) == set(exports.BATCH_JSON_COLUMNS)
    assert [r.ID for r in exports.report_rows(df).collect()] == [3, 2, 1, 0]
    assert exports.research_rows(df, protocol="tcp", search_ip="10.0").count() == 4


def data_file(tmp_path):
    lines = ["src_ip,dst_ip,sport,dport,proto,ts,sbytes,dbytes,spkts,dpkts,label,host"]
    for i in range(30):
        size, packets, label = (500, 8, "BENIGN") if i % 3 else (30000, 250, "DDoS")
        host = "www.bad.example" if i == 1 else ""
        lines.append(f"10.0.0.{i % 4},10.0.0.9,{1000 + i},443,tcp,{1704067200 + i},{size},300,{packets},2,{label},{host}")
    lines.append("nowhere,10.0.0.9,1,2,tcp,soon,1,1,1,1,BENIGN,")
    lines.append("10.0.0.1,10.0.0.9,x,2,tcp,1704067300,100,100,5,5,Worms,")
    path = tmp_path / "data.csv"
    path.write_text("\n".join(lines) + "\n")
    return str(path)


def entries(spark):
    return spark.createDataFrame([(1, "bad.example", "domain", "l"), (2, "10.0.0.3", "ipv4", "m")], "id long, value string, entry_type string, label string")


@pytest.fixture(scope="module")
def fitted(spark):
    return model.train_baseline(spark)


def test_import_stores_what_it_counts(spark, tmp_path, fitted):
    done = importer.import_dataset(spark, data_file(tmp_path), entries(spark), as_of(), batch_id=11, mode="label_eval", classifier=fitted)
    summary = done.summary.head()
    assert (summary.record_count, summary.valid_count, summary.invalid_count, summary.warning_count) == (32, 31, 1, 1)
    assert summary.watchlist_matches == 8  # seven flows of 10.0.0.3 and one host
    stored = spark.table(tables.LOGS).where("import_batch_id = 11")
    assert stored.count() == 31 and stored.where("source = 'import:11'").count() == 31
    alerts = spark.table(tables.ALERTS).where("import_batch_id = 11")
    assert alerts.count() == summary.alerts_count
    assert alerts.where("alert_type = 'watchlist_match'").count() == 8  # also where the flow has a text of its own
    assert done.metrics.head().total_evaluated == 30
    assert {(r.truth, r.predicted): r.n for r in done.confusion.collect()}["Malicious", "Malicious"] >= 9
    assert done.rejections.head().errors == ["Invalid source IP: 'nowhere'"]
    assert spark.table(tables.BATCHES).where("id = 11").head().analysis_mode == "label_eval"
    assert search.recent_batches(spark.table(tables.BATCHES), 1).head().id == 11
    batch = spark.table(tables.BATCHES).where("id = 11").head()
    assert batch.filename == "data.csv" and batch.file_type == "csv" and batch.duplicate_of is None and len(batch.file_hash) == 64
    assert json.loads(batch.mapping_json)["src_ip"] == "src_ip" and json.loads(batch.capabilities_json)
    assert json.loads(batch.eval_metrics_json)["total_evaluated"] == 30 and batch.duration_sec >= 0
    assert batch.drift_count == 0 and spark.table(tables.METRICS).where("import_batch_id = 11").count() == 0
    importer.import_dataset(spark, data_file(tmp_path), entries(spark), as_of(), batch_id=12, mode="historical", classifier=fitted)
    again = spark.table(tables.BATCHES).where("id = 12").head()
    assert again.duplicate_of == 11 and again.eval_metrics_json is None
    assert spark.table(tables.LOGS).where("import_batch_id in (11, 12)").select("id").distinct().count() == 62
    tables.delete_batch(spark, 12)
    tables.delete_batch(spark, 11)
    assert spark.table(tables.LOGS).where("import_batch_id = 11").count() == 0


def test_analyze_only_stores_nothing(spark, tmp_path):
    path = data_file(tmp_path)
    mapping = normalize.auto_mapping(["src_ip", "dst_ip"])
    done = importer.import_dataset(spark, path, entries(spark), as_of(), batch_id=12, mapping=mapping, classifier=None)
    rows = done.logs.collect()
    # Without byte and packet columns the classifier is not asked: watchlist or normal.
    assert {(r.prediction_label, r.confidence_score) for r in rows} == {("Suspicious", 0.9), ("Normal", 0.85)}
    assert not spark.catalog.tableExists(tables.LOGS) or spark.table(tables.LOGS).where("import_batch_id = 12").count() == 0
    with pytest.raises(ValueError):
        importer.run_batch(done.logs, entries(spark), None, batch_id=1, mode="other")


def test_live_pipeline(spark, tmp_path, fitted):
    rows = []
    for i in range(300):  # a flood and a quiet client, then a packet that closes both
        rows.append((i, START + timedelta(milliseconds=i * 4), "10.0.0.3", "10.0.0.9", 5, 80, "TCP", 1000, "A", None, "sim:dos"))
    for i in range(10):
        rows.append((1000 + i, START + timedelta(milliseconds=i * 50), "10.0.0.1" if i % 2 else "10.0.0.2", "10.0.0.2" if i % 2 else "10.0.0.1", 7, 7, "TCP", 60, "A", None, "live"))
    rows.append((9999, START + timedelta(minutes=5), "9.9.9.9", "8.8.8.8", 1, 1, "UDP", 60, None, None, "live"))
    spark.createDataFrame(rows, PACKETS).coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(PACKETS).parquet(str(tmp_path / "in"))
    out = str(tmp_path / "out")
    live.run_stream(stream, fitted, entries(spark), out, availableNow=True).awaitTermination()
    stored = {r.src_ip: r for r in spark.read.parquet(f"{out}/logs").collect()}
    assert stored["10.0.0.3"].prediction_label == "Malicious" and stored["10.0.0.3"].watch_id == 2
    assert stored["10.0.0.2"].prediction_label == "Normal"
    event = spark.read.parquet(f"{out}/alert_events").where("src_ip = '10.0.0.3'").head()
    assert event.is_simulated and event.notes.startswith("[SIMULATION] [10.0.0.3 -> 10.0.0.9 | TCP] Diagnosis: ")


def test_import_of_captures_and_feeds(spark, tmp_path, fitted):
    from test_sources import FRAMES, pcap

    path = tmp_path / "office.pcap"
    path.write_bytes(pcap(FRAMES) + b"cut off")
    store = tables.Tables().prefixed("cap_")
    done = importer.import_dataset(spark, str(path), entries(spark), as_of(), batch_id=3, mode="historical", classifier=fitted, store=store)
    logs = spark.table(store.logs).collect()
    assert logs and {r.import_batch_id for r in logs} == {3} and {r.source for r in logs} == {"pcap:office.pcap"}
    assert done.summary.head().valid_count == len(logs) and done.summary.head().invalid_count == 1  # the broken end
    assert spark.table(store.batches).head().file_type == "pcap"
    feed = tmp_path / "feed.txt"
    feed.write_text("# feed\n10.9.8.7 and bad.example.org\n1.2.3.4.example.com\n")
    counts = [importer.import_dataset(spark, str(feed), entries(spark), as_of(), batch_id=4, store=store).head() for _ in range(2)]
    assert [(c.imported_count, c.total_found) for c in counts] == [(3, 3), (0, 3)]
    assert {r.value for r in spark.table(store.watchlist).collect()} == {"10.9.8.7", "bad.example.org", "1.2.3.4"}


def test_import_stores_drift(spark, tmp_path, fitted):
    """Labels that are right for half a day and then wrong: the events are stored and counted."""
    lines = ["src,dst,sport,dport,proto,ts,sbytes,dbytes,packets,class"]
    for i in range(6000):
        lines.append(f"10.1.0.1,10.1.0.2,5,443,tcp,{1_700_000_000 + i * 10},500,500,10,{'BENIGN' if i < 3000 else 'ddos'}")
    path = tmp_path / "shift.csv"
    path.write_text("\n".join(lines))
    store = tables.Tables().prefixed("drift_")
    importer.import_dataset(spark, str(path), entries(spark), as_of(), batch_id=21, mode="label_eval", classifier=fitted, store=store)
    events = spark.table(store.metrics).orderBy("timestamp").collect()
    assert events and {r.import_batch_id for r in events} == {21} and all(r.drift_detected for r in events)
    assert 30_000 <= events[0].timestamp.timestamp() - 1_700_000_000 <= 36_000
    assert spark.table(store.batches).head().drift_count == len(events)


def test_replace_fails_without_loss(spark, monkeypatch):
    """Neither a write that fails nor one that is not pointed to loses a row; the rows may come from the table itself."""
    spark.range(5).write.mode("overwrite").saveAsTable("t_replace")
    ids = lambda: sorted(r.id for r in spark.table("t_replace").collect())
    broken = spark.range(3).withColumn("id", F.when(F.col("id") < 2, F.col("id")).otherwise(F.raise_error(F.lit("lost")).cast("long")))
    with pytest.raises(Exception, match="lost"):
        tables.replace(broken, "t_replace")
    assert ids() == [0, 1, 2, 3, 4]
    with monkeypatch.context() as patch, pytest.raises(RuntimeError):
        patch.setattr(tables, "_point", lambda *_: (_ for _ in ()).throw(RuntimeError()))
        tables.replace(spark.range(1), "t_replace")
    assert ids() == [0, 1, 2, 3, 4]
    for least in (1, 2, 3):
        tables.replace(spark.table("t_replace").where(F.col("id") >= least), "t_replace")
        assert ids() == list(range(least, 5))
    tables.append(spark.range(9, 10), "t_replace")
    assert ids() == [3, 4, 9]
    root = spark.conf.get("spark.sql.warehouse.dir") + "/_snapshots/t_replace"
    assert len(tables._folders(spark, root)) == 2


def test_live_detectors_to_alerts(spark, tmp_path):
    """Flows, devices and ARP end in one table of alerts."""
    out, at = str(tmp_path / "out"), START
    odd = [(i, at + timedelta(minutes=i), "10.0.0.1", 90_000_000 if i in (30, 35) else 100, 3000.0 if i in (30, 35) else 1.0, "TCP", 5) for i in range(40)]
    schema = "id long, timestamp timestamp, src_ip string, total_bytes long, duration double, protocol string, packet_count long"
    odd.append((999, at + timedelta(days=30), "clock", 1, 1.0, "TCP", 5))  # moves the clock beyond all others
    spark.createDataFrame(odd, schema).write.parquet(str(tmp_path / "logs"))
    arp = [(i, at + timedelta(seconds=i), 2, "10.0.0.9", "aa" if i < 2 else "bb") for i in range(5)]
    arp += [(90 + i, at + timedelta(days=30 * (1 + i // 2)), 2, "clock", mac) for i, mac in enumerate(["aa", "bb", "cc"])]
    spark.createDataFrame(arp, "id long, ts timestamp, op int, ip string, mac string").write.parquet(str(tmp_path / "arp"))
    read = lambda name: spark.readStream.schema(spark.read.parquet(str(tmp_path / name)).schema).parquet(str(tmp_path / name))
    live.run_devices(read("logs"), out, availableNow=True).awaitTermination()
    live.run_arp(read("arp"), out, availableNow=True).awaitTermination()
    events = live.stored_events(spark, out, ("device_events", "arp_events"))
    for running in live.run_alerts(events, out, availableNow=True):
        running.awaitTermination()
    alerts = {r.alert_type: r for r in al.alert_rows(state.present_incidents(spark.read.parquet(f"{out}/alert_changes"))).collect()}
    assert alerts["arp_spoofing"]["count"] == 3 and alerts["arp_spoofing"].traffic_log_id == 4 and alerts["arp_spoofing"].status == "Active"
    assert alerts["device_behaviour"].traffic_log_id in (30, 35) and "Device Behaviour Anomaly" in alerts["device_behaviour"].notes
    assert tables.read_devices(spark, f"{out}/device_profiles").where("device_ip = '10.0.0.1'").head().sample_count == 40
    assert spark.read.parquet(f"{out}/notifications").count() >= 2


def test_refit_takes_over_once_two_classes_are_known(spark, tmp_path):
    base = model.baseline_rows(spark)
    calm = base.where("label = 'Normal'")
    # Here large flows are normal: the baseline calls them malicious, a refit learns better.
    large = base.where("label = 'Malicious'").withColumn("label", F.lit("Normal")).unionByName(base.where("label = 'Suspicious'"))
    for part in (calm, large, large):
        part.coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(base.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    out = str(tmp_path / "out")
    live.refit_stream(stream, out, availableNow=True).awaitTermination()
    told = spark.read.parquet(f"{out}/predictions").withColumn("right", F.col("label") == F.col("prediction_label"))
    share = {r.epoch: r.s for r in told.groupBy("epoch").agg(F.avg(F.col("right").cast("int")).alias("s")).collect()}
    assert share[1] < 0.8 and share[2] > 0.95
    assert set(FEATURES) <= set(told.columns)

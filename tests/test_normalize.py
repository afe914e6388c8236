from pyspark.sql import functions as F

from flowlens.operators import normalize as N
from flowlens.sources.files import ROW_ID


def test_mapping_takes_first_alias_and_last_header():
    assert N.auto_mapping(["Source IP", "DST", "proto", "Bytes", "ts"]) == {
        "src_ip": "Source IP", "dest_ip": "DST", "protocol": "proto", "total_bytes": "Bytes", "timestamp": "ts",
    }
    # Same cleaned name: the later header counts. First alias of the list counts over later ones.
    assert N.auto_mapping(["src_ip", "SRC-IP", "saddr"])["src_ip"] == "SRC-IP"
    assert N.auto_mapping(["saddr", "src"])["src_ip"] == "src"


def test_mapping_of_formats():
    zeek = N.auto_mapping(["ts", "id.orig_h", "id.resp_h", "conn_state", "orig_bytes"], "zeek")
    assert zeek["info"] == "conn_state" and zeek["src_ip"] == "id.orig_h" and zeek["src_bytes"] == "orig_bytes"
    assert "info" not in N.auto_mapping(["conn_state"])
    eve = N.auto_mapping(["flow.age", "flow.bytes_toserver", "alert.signature"], "eve")
    assert eve == {"duration": "flow.age", "src_bytes": "flow.bytes_toserver", "label": "alert.signature"}


def test_segment_sizes_are_flagged():
    mapping = N.auto_mapping(["Fwd Seg Size Avg", "dbytes"])
    assert N.segment_size_headers(mapping) == ["Fwd Seg Size Avg"]


def test_clean_name_column_matches_python(spark):
    names = [" Source IP ", "id.orig_h", "Ünï", "a-B_3"]
    df = spark.createDataFrame([(n,) for n in names], "n string")
    assert [r[0] for r in df.select(N.clean_name_column(F.col("n"))).collect()] == [N.clean_name(n) for n in names]


def test_capabilities(spark):
    def status(*fields):
        rows = N.capabilities(spark, {f: f for f in fields}).collect()
        return {r.capability: (r.supported, r.status) for r in rows}

    all_fields = status("timestamp", "src_ip", "dest_ip", "protocol", "src_bytes", "dest_bytes", "packet_count", "label")
    assert all(s for s, _ in all_fields.values()) and len(all_fields) == 8
    few = status("src_ip", "src_pkts", "dest_pkts")
    assert few["device_inventory"] == (True, "partial")
    assert few["behaviour_profiling"] == (False, "unsupported")
    assert few["arf_classification"] == (False, "partial")
    assert few["ioc_correlation"] == (True, "fully_supported")
    assert not status()["ioc_correlation"][0]
    capture = {r.capability: r.supported for r in N.capabilities(spark, None, "pcap").collect()}
    assert not capture.pop("label_evaluation") and all(capture.values())


RAW = [
    # src, dest, sport, proto, ts, sbytes, dbytes, bytes, packets
    ("10.0.0.5", "10.0.0.9", "40001", "tcp", "1700000000", "1000", "250", "0", "0"),
    ("999.1.1.1", "host", "80", "6", "", "1", "1", "", ""),
    ("10.0.0.5", "2001:db8::1", "70000", "", "soon", "", "NaN", "9999", "5"),
    (None, "10.0.0.1", None, None, None, None, None, None, None),
]
NAMES = ["Source IP", "Destination IP", "sport", "proto", "ts", "sbytes", "dbytes", "bytes", "packets"]


def normalized(spark):
    schema = ", ".join(f"`{n}` string" for n in NAMES)
    df = spark.createDataFrame(RAW, schema).withColumn(ROW_ID, F.monotonically_increasing_id())
    as_of = F.to_timestamp(F.lit("2024-01-31 00:00:00"))
    return N.normalize(df, N.auto_mapping(NAMES), as_of, batch_id=3, keep=[ROW_ID])


def test_records(spark):
    rows = normalized(spark).orderBy(ROW_ID).collect()
    good, bad, warned, empty = rows
    assert (good.total_bytes, good.packet_count, good.avg_pkt_size, good.proto_num) == (1250, 1, 1250.0, 1.0)
    assert good.timestamp.isoformat() == "2023-11-14T22:13:20" and good.errors == [] and good.warnings == []
    assert bad.errors == ["Invalid source IP: '999.1.1.1'", "Invalid destination IP: 'host'"]
    assert warned.errors == [] and (warned.src_port, warned.total_bytes, warned.packet_count) == (0, 9999, 5)
    assert warned.warnings == [
        "Malformed source port '70000' defaulted to 0",
        "Unparseable timestamp 'soon' defaulted to UTC now",
    ]
    assert warned.timestamp.isoformat() == "2024-01-31T00:00:00" and warned.protocol == "OTHER"
    assert empty.errors == ["Invalid source IP: 'None'"] and empty.warnings == []


def test_counts_and_rejections(spark):
    df = normalized(spark)
    assert df.transform(N.validation_counts).head().asDict() == {
        "sample_validated": 4, "valid_count": 2, "invalid_count": 2, "warning_count": 1,
    }
    assert N.validation_counts(df, ROW_ID, 1).head().sample_validated == 1
    assert len(N.rejections(df, ROW_ID, 1).collect()) == 1
    assert N.valid_rows(df).count() == 2 and N.rejected_rows(df).count() == 2


def test_features_need_no_shuffle(spark):
    plan = N.to_features(N.valid_rows(normalized(spark)))._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan

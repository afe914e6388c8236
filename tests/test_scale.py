"""Work that follows the rows and not the numbers of keys, files or repeats."""

import uuid
from datetime import datetime, timedelta, timezone
from types import SimpleNamespace

import pandas as pd
import pytest
from pyspark.sql import functions as F

from flowlens import adapters as A
from flowlens.operators import ordering
from flowlens.plans import file_queries, importer, io_queries, stream_queries
from flowlens.plans import pipeline_queries as P
from flowlens.sources.ranges import listed
from flowlens.streaming import state
from flowlens.streaming.run import drain

START = datetime(2024, 1, 1, tzinfo=timezone.utc)
EVENTS = "event_id long, ts timestamp, user_id long, event_type string, value double, props string"
KINDS = ["view", "click", "signup", "purchase", "error"]


def events(n, ident=lambda i: i, user=lambda i: i % 7):
    """Half of them over ten days, then the other half over the same days."""
    half = n // 2
    return [(ident(i), START + timedelta(seconds=(i % half) * 864_000 / half + i / 1e3), user(i), KINDS[i % 5], float(i % 90), f'{{"k": {i % 100}}}') for i in range(n)]


def folder(spark, path, rows, parts=2):
    """Events in files, each of which may hold all times."""
    df = spark.createDataFrame(spark.sparkContext.parallelize(rows, parts), EVENTS)
    df.write.parquet(f"{path}/events.parquet")
    return str(path)


class Handle:
    """A state store of one group that counts the trips to it."""

    def __init__(self):
        self.trips, self.timers, self.held = 0, [], {}

    def getListState(self, name, schema):
        def put(rows):
            self.trips += 1
            self.held[name] = [tuple(r) for r in rows]

        def get():
            self.trips += 1
            return iter(self.held.get(name, []))

        return SimpleNamespace(get=get, put=put, clear=lambda: put([]), appendValue=lambda row: put([*self.held.get(name, []), row]))

    getValueState = getListState

    def registerTimer(self, ms):
        self.timers.append(ms)


def test_keys_of_a_bucket_share_calls_and_trips():
    macs = state.FirstMac(state._names(state._CONFLICT))
    macs.keys, macs.arrow = [("ip", "string")], state._ARROW
    handle = Handle()
    macs.init(handle)
    frame = pd.DataFrame([(f"k{i % 3000}", 10**9 + i, str(i), "a" if i < 3000 else "b") for i in range(6000)], columns=["ip", "us", "id", "mac"])
    assert list(macs.handleInputRows((0,), iter([frame[3000:], frame[:3000]]), None)) == []
    out = list(macs.handleExpiredTimer((0,), SimpleNamespace(getCurrentWatermarkInMs=lambda: 1_000_004), None))
    found = pd.concat(out)
    assert len(found) == 1001 and set(found.ip) == {f"k{i}" for i in range(1001)}  # rows up to the watermark
    out = list(macs.handleExpiredTimer((0,), SimpleNamespace(getCurrentWatermarkInMs=lambda: 10**7), None))
    assert len(pd.concat(out)) == 1999 and handle.trips <= 12


def test_ids_next_to_nulls_stay_whole(spark, tmp_path):
    """Ids of live logs are beyond what floats tell apart."""
    ident = (1 << 62) + 5
    shape = "threat_level string, alert_type string, device string, id long, ts timestamp, is_simulated boolean, notes string, log_id long"
    rows = [("High", "t", d, i, START + timedelta(seconds=i), False, "n", log) for d, i, log in [("a", 1, ident), ("a", 2, None), ("b", 3, None), ("clock", 10**6, None)]]
    spark.createDataFrame(rows, shape).coalesce(1).write.parquet(f"{tmp_path}/in")
    stream = spark.readStream.schema(shape).parquet(f"{tmp_path}/in")
    got = drain(spark, state.incidents_stream(state.event_timeline(stream)), "ids")
    assert {r.device: r.log_id for r in state.present_incidents(got).collect() if r.device != "clock"} == {"a": ident, "b": None}


def test_parts_of_a_stream_are_one_batch_each(spark, tmp_path, monkeypatch):
    """Input files that hold all times, and a user of any number: nothing comes late and nobody is left out."""
    monkeypatch.setattr(stream_queries, "FILE_ROWS", 20, raising=False)
    path = folder(spark, tmp_path, events(400, user=lambda i: 9_999 if i % 40 == 3 else i % 7))
    scored = stream_queries.stream_device_anomaly(spark, path)
    assert sorted(r.id for r in scored.collect()) == list(range(400))
    flows = stream_queries.stream_flows(spark, path).count()
    closed = P.flows.build_flows(A.packets(spark, path), timeout=P._GAP, decode="http")
    last = A.packets(spark, path).agg(F.max(F.unix_micros("ts"))).head()[0]
    over = F.unix_micros("last_seen") + P._GAP * 1_000_000 - 1 <= (last // 1000 - stream_queries._DELAY_MS) * 1000
    assert flows == closed.where(over).count() > 0


@pytest.fixture
def counted(tmp_path):
    """Rows passed on, and how many rows were worked out so far."""
    seen = tmp_path / "seen"
    seen.mkdir()
    place = str(seen)

    def passing(batches):
        for batch in batches:
            with open(f"{place}/{uuid.uuid4().hex}", "w") as file:
                file.write(str(len(batch)))
            yield batch

    return lambda df: df.mapInPandas(passing, df.schema), lambda: sum(int(p.read_text()) for p in seen.iterdir())


def test_numbered_works_its_input_out_once(spark, counted):
    through, seen = counted
    rows = [(i * 37 % 1000, None if i % 100 == 0 else f"x{i % 10}") for i in range(1000)]
    got = ordering.numbered(through(spark.createDataFrame(rows, "a long, b string")), ["b", "a"]).collect()
    assert seen() == 1000
    want = sorted(rows, key=lambda r: (r[1] is not None, r[1] or "", r[0]))
    assert [(r.a, r.b) for r in sorted(got, key=lambda r: r.number)] == want and sorted(r.number for r in got) == list(range(1000))
    assert ordering.numbered(spark.createDataFrame([], "a long, b string"), ["b", "a"]).collect() == []


def test_stored_captures_make_their_alerts_once(spark, tmp_path, monkeypatch):
    calls = []
    made = importer.al.incidents
    monkeypatch.setattr(importer.al, "incidents", lambda *a: calls.append(1) or made(*a))
    path = folder(spark, tmp_path, events(100))
    none = spark.createDataFrame([], "source string, packets long, error string")
    entries = spark.createDataFrame([(1, "10.0.0.1", "ipv4", "x")], "id long, value string, entry_type string, label string")
    store = importer.tables.Tables().prefixed(f"once_{uuid.uuid4().hex[:8]}_")
    for mode in ("historical", "analyze_only"):
        done = importer.import_capture(
            spark, "", entries, batch_id=1, mode=mode, classifier=P.FOREST, timeout=P._GAP, packets=A.packets(spark, path), errors=none, store=store
        )
        assert done.logs.count() > 0 and done.alerts.count() > 0
    assert len(calls) == 2


def test_zeek_files_are_few_and_whole(spark, tmp_path, monkeypatch):
    """Record numbers with gaps: every record comes back, and no file is made per record."""
    path = folder(spark, tmp_path, events(300, ident=lambda i: 1000 * i + 7))
    monkeypatch.setattr(file_queries, "shared_dir", lambda spark, name: f"{tmp_path}/{name}")
    got = file_queries.read_zeek(spark, path).count()
    assert got == file_queries.valid_rows(P._normalized(spark, path)).count() > 0
    assert listed(spark, f"{tmp_path}/zeek").count() <= 65


def test_format_files_are_bounded(spark, tmp_path, monkeypatch):
    path = folder(spark, tmp_path, events(1000))
    monkeypatch.setattr(io_queries, "FILE_RECORDS", 100, raising=False)
    monkeypatch.setattr(io_queries, "shared_dir", lambda spark, name: f"{tmp_path}/{name}")
    got = {(r.kind, r.format) for r in io_queries.detect_formats(spark, path).collect()}
    assert got == {("a", "jsonl"), ("b", "csv"), ("c", "zeek"), ("d", "eve"), ("e", "txt_ioc"), ("f", "json")}
    assert [listed(spark, f"{tmp_path}/formats/{kind}").count() for kind in "abd"] == [10, 10, 10]

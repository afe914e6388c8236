import hashlib
import json
import random
import struct

import pytest
from pyspark.sql import functions as F

from flowlens.functions import payloads
from flowlens.operators.flows import build_flows
from flowlens.sources import captures, csv_ranges, files, indicators, ranges
from flowlens.sources.streams import replay

AS_OF = "2024-01-31 00:00:00"


def as_of():
    return F.to_timestamp(F.lit(AS_OF))


def put(folder, name, content):
    folder.mkdir(exist_ok=True)
    (folder / name).write_bytes(content if isinstance(content, bytes) else content.encode())
    return str(folder / name)


def rows(df):
    return [r.asDict() for r in df.orderBy(files.ROW_ID).drop(files.ROW_ID).collect()]


@pytest.mark.parametrize("sep", [",", ";", "\t"])
def test_csv(spark, tmp_path, sep):
    text = sep.join([" Source IP ", "dst", "note"]) + "\n" + sep.join(["10.0.0.1", "10.0.0.2", '"a""b"']) + "\n" + sep.join(["x", "", ""]) + "\n"
    df = files.read_csv(spark, put(tmp_path, "a.csv", text))
    assert rows(df) == [
        {"Source IP": "10.0.0.1", "dst": "10.0.0.2", "note": 'a"b'},
        {"Source IP": "x", "dst": "", "note": ""},
    ]


def test_csv_to_flows(spark, tmp_path):
    path = put(tmp_path, "a.csv", "src,dst,sport,proto,bytes\n10.0.0.1,10.0.0.2,80,tcp,7\nhost,10.0.0.2,80,tcp,7\n")
    flows = files.read_flows(spark, path, as_of()).collect()
    assert flows[0].total_bytes == 7 and flows[0].errors == [] and flows[0].original_filename == "a.csv"
    assert flows[1].errors == ["Invalid source IP: 'host'"]
    assert files.preview(files.read_csv(spark, path), 1).count() == 1
    assert files.record_counts(files.read_csv(spark, path)).head().records == 2


def test_jsonl_skips_what_is_no_object(spark, tmp_path):
    text = '{"src_ip": "10.0.0.1", "n": 1}\n{broken\n\n[{"src_ip": "x"}]\n5\n{"src_ip": "10.0.0.2", "other": {"a": 1}}\n'
    got = rows(files.read_jsonl(spark, put(tmp_path, "a.jsonl", text)))
    assert got == [
        {"n": "1", "other": None, "src_ip": "10.0.0.1"},
        {"n": None, "other": '{"a":1}', "src_ip": "10.0.0.2"},
    ]


@pytest.mark.parametrize(
    "doc, want",
    [
        ([{"a": 1}, 5, {"a": 2}], ["1", "2"]),
        ({"meta": 1, "records": [{"a": 3}]}, ["3"]),
        ({"data": [{"a": 5}], "flows": [{"a": 4}]}, ["4"]),
        ({"a": 6, "flows": "none"}, ["6"]),
        ({"flows": [], "a": 1}, []),
    ],
)
def test_json_documents(spark, tmp_path, doc, want):
    df = files.read_json(spark, put(tmp_path, "a.json", json.dumps(doc, indent=1)), keys=["a"])
    assert [r["a"] for r in rows(df)] == want


def test_broken_document_is_an_error(spark, tmp_path):
    with pytest.raises(Exception, match="malformed JSON document"):
        files.read_json(spark, put(tmp_path, "a.json", '{"flows": ['), keys=["a"]).collect()


def test_zeek_layouts_may_differ(spark, tmp_path):
    put(tmp_path / "z", "a.log", "#separator \\x09\n#fields\tts\tid.orig_h\tid.resp_h\n#types\ttime\n1700000000\t10.0.0.1\t-\n1700000001\t10.0.0.2\n")
    put(tmp_path / "z", "b.log", "#fields\tid.resp_h\tts\n10.0.0.9\t1700000002\n#close\n")
    got = sorted((r["ts"], r["id.orig_h"], r["id.resp_h"]) for r in rows(files.read_zeek(spark, str(tmp_path / "z"))))
    assert got == [("1700000000", "10.0.0.1", ""), ("1700000001", "10.0.0.2", ""), ("1700000002", None, "10.0.0.9")]


def test_eve(spark, tmp_path):
    event = {"timestamp": "2024-01-02T03:04:05Z", "event_type": "flow", "src_ip": "10.0.0.1", "dest_ip": "10.0.0.2", "proto": "UDP",
             "flow": {"bytes_toserver": 10, "bytes_toclient": 5, "age": 3}, "alert": {"signature": "DDoS", "deep": {"x": 1}}}
    path = put(tmp_path, "eve.json", json.dumps(event) + "\nnoise\n" + json.dumps({"event_type": "dns"}) + "\n")
    raw = files.read_eve(spark, path)
    assert "alert.deep.x" in raw.columns and raw.count() == 2
    flow = files.read_flows(spark, path, as_of()).orderBy(files.ROW_ID).head()
    assert (flow.total_bytes, flow.duration, flow.ground_truth_label, flow.source_format) == (15, 3.0, "DDoS", "eve")


def test_formats(spark, tmp_path):
    cases = {
        "a.pcap": ("pcap", b"x"), "b.PCAPNG": ("pcap", b"x"), "c.ndjson": ("jsonl", b"x"), "d.csv": ("csv", b"#fields"),
        "e.bin": ("pcap", b"\xd4\xc3\xb2\xa1rest"), "f.log": ("zeek", b"#separator x"), "g.json": ("eve", b'{"event_type":"flow"}'),
        "h.dat": ("jsonl", b'{"a":1}\n{"a":2}'), "i.dat": ("json", b'{"a":1}'), "j.dat": ("json", b" [1]"),
        "k.txt": ("txt_ioc", b"10.0.0.1"), "l.list": ("txt_ioc", b"x"), "m.json": ("json", b"x"), "n.tsv": ("zeek", b"x"),
        "o.dat": ("csv", b"a,b"), "p.dat": ("csv", b"\xff\xfe\x00"),
    }
    for name, (_, content) in cases.items():
        put(tmp_path / "f", name, content)
    got = {r.path.rsplit("/", 1)[-1]: r.format for r in files.detect_formats(spark, str(tmp_path / "f")).collect()}
    assert got == {name: fmt for name, (fmt, _) in cases.items()}
    with pytest.raises(ValueError, match="one format"):
        files.detect_format(spark, str(tmp_path / "f"))


def test_known_files(spark, tmp_path):
    put(tmp_path / "f", "a", "same")
    put(tmp_path / "f", "b", "other")
    batches = spark.createDataFrame([(4, hashlib.sha256(b"same").hexdigest()), (9, hashlib.sha256(b"same").hexdigest())], "id long, file_hash string")
    found = files.known_files(files.file_hashes(spark, str(tmp_path / "f")), batches).collect()
    assert [(r.path.rsplit("/", 1)[-1], r.batch_id) for r in found] == [("a", 4)]


def test_indicators(spark, tmp_path):
    text = "# feed 1.2.3.4\n\n10.0.0.66\n999.1.1.1 01.2.3.4\nbad.example.com, 10.0.0.66\nEvil.Example.org x.y9 a-b.co.uk-z\n_a.b.com éa.b.com\n"
    got = {r.value: (r.entry_type, r.line) for r in indicators.read_indicators(spark, put(tmp_path, "feed.txt", text)).collect()}
    assert got == {
        "10.0.0.66": ("ipv4", 3),
        "bad.example.com": ("domain", 5),
        "Evil.Example.org": ("domain", 6),
        "a-b.co.uk": ("domain", 6),
        "b.com": ("domain", 7),
    }


# --- captures -----------------------------------------------------------------------------------


def ip_packet(src, dest, protocol, body, fragment=0):
    head = struct.pack(">BBHHHBBH4s4s", 0x45, 0, 20 + len(body), 1, fragment, 64, protocol, 0, bytes(map(int, src.split("."))), bytes(map(int, dest.split("."))))
    return head + body


def tcp(sport, dport, flags, payload=b""):
    return struct.pack(">HHIIBBHHH", sport, dport, 0, 0, 5 << 4, flags, 0, 0, 0) + payload


def udp(sport, dport, payload=b""):
    return struct.pack(">HHHH", sport, dport, 8 + len(payload), 0) + payload


def ether(kind, body):
    return b"\x02" * 6 + b"\x04" * 6 + struct.pack(">H", kind) + body


def dns_query(name):
    labels = b"".join(bytes([len(p)]) + p.encode() for p in name.split("."))
    return struct.pack(">HHHHHH", 1, 0x100, 1, 0, 0, 0) + labels + b"\0\0\1\0\1"


def client_hello(name):
    server = struct.pack(">HBH", len(name) + 3, 0, len(name)) + name.encode()
    extensions = struct.pack(">HH", 10, 2) + b"\0\0" + struct.pack(">HH", 0, len(server)) + server
    body = b"\3\3" + b"r" * 32 + b"\4abcd" + b"\0\2\x13\1" + b"\1\0" + struct.pack(">H", len(extensions)) + extensions
    return b"\x16\3\1" + struct.pack(">H", len(body) + 4) + b"\1" + len(body).to_bytes(3, "big") + body


FRAMES = [
    ether(0x0800, ip_packet("10.0.0.1", "10.0.0.2", 6, tcp(1000, 443, 0x02))),
    ether(0x0800, ip_packet("10.0.0.2", "10.0.0.1", 6, tcp(443, 1000, 0x12))),
    ether(0x0800, ip_packet("10.0.0.1", "10.0.0.2", 6, tcp(1000, 443, 0x18, client_hello("secret.example")))),
    ether(0x0800, ip_packet("10.0.0.1", "10.0.0.3", 17, udp(5000, 53, dns_query("www.example.com")))),
    ether(0x0800, ip_packet("10.0.0.1", "10.0.0.4", 1, b"\x08\0\0\0")),
    ether(0x0806, struct.pack(">HHBBH", 1, 0x0800, 6, 4, 2) + b"\xaa\xbb\xcc\0\0\1" + bytes([10, 0, 0, 9]) + b"\0" * 10),
    ether(0x86DD, b"\x60" + b"\0" * 39),
    ether(0x8100, b"\0\1" + struct.pack(">H", 0x0800) + ip_packet("10.0.0.5", "10.0.0.6", 6, tcp(1, 2, 0x11), fragment=0x4000)),
    ether(0x0800, ip_packet("10.0.0.5", "10.0.0.6", 6, tcp(1, 2, 0x11), fragment=5)),
]


def pcap(frames, order="<", nano=False):
    out = struct.pack(order + "IHHiIII", 0xA1B23C4D if nano else 0xA1B2C3D4, 2, 4, 0, 0, 65535, 1)
    for i, f in enumerate(frames):
        out += struct.pack(order + "IIII", 1_700_000_000, i * (1000 if nano else 1), len(f), len(f)) + f
    return out


def pcapng(frames):
    def block(kind, body):
        body += b"\0" * (-len(body) % 4)
        return struct.pack("<II", kind, len(body) + 12) + body + struct.pack("<I", len(body) + 12)

    out = block(0x0A0D0D0A, struct.pack("<IHHq", 0x1A2B3C4D, 1, 0, -1)) + block(1, struct.pack("<HHI", 1, 0, 0))
    for i, f in enumerate(frames):
        ticks = 1_700_000_000_000_000 + i
        out += block(6, struct.pack("<IIIII", 0, ticks >> 32, ticks & 0xFFFFFFFF, len(f), len(f)) + f)
    return out


@pytest.mark.parametrize("content", [pcap(FRAMES), pcap(FRAMES, ">"), pcap(FRAMES, nano=True), pcapng(FRAMES), pcap(FRAMES) + b"cut off"])
def test_captures(spark, tmp_path, content):
    path = put(tmp_path / "c", "a.pcap", content)
    got = captures.read_captures(spark, path).orderBy("pkt_id").collect()
    assert [(r.protocol, r.src_port, r.dest_port, r.tcp_flags) for r in got] == [
        ("TCP", 1000, 443, "S"), ("TCP", 443, 1000, "SA"), ("TCP", 1000, 443, "PA"), ("UDP", 5000, 53, None), ("ICMP", 0, 0, None),
        ("TCP", 1, 2, "FA"), ("OTHER", 0, 0, None),
    ]
    assert got[0].ts.isoformat() == "2023-11-14T22:13:20" and got[1].ts.microsecond == 1
    assert got[0].length == len(FRAMES[0]) and got[0].source == "pcap:a.pcap"
    reply = captures.read_arp(spark, path).head()
    assert (reply.op, reply.ip, reply.mac) == (2, "10.0.0.9", "aa:bb:cc:00:00:01")


def test_capture_to_flows(spark, tmp_path):
    put(tmp_path / "c", "a.pcap", pcap(FRAMES))
    put(tmp_path / "c", "empty.pcap", b"no capture")
    flows = {r.dest_ip: r for r in build_flows(captures.read_captures(spark, str(tmp_path / "c"))).collect()}
    tls = flows["10.0.0.2"]
    assert (tls.packet_count, tls.connection_state, tls.protocol_l7, tls.info) == (3, "ESTABLISHED", "HTTPS", "HTTPS/TLS SNI: secret.example")
    assert flows["10.0.0.3"].info == "DNS Query: www.example.com" and flows["10.0.0.3"].connection_state == "STATELESS"


def test_capture_errors(spark, tmp_path):
    """What is not read is listed: no header, a broken record, packets without a time."""
    good = pcap(FRAMES)
    second = 24 + 16 + len(FRAMES[0])
    simple = struct.pack("<III", 3, 20, 4) + b"abcd" + struct.pack("<I", 20)
    old = struct.pack("<IIHHIIII", 2, 32 + 12, 0, 0, 0, 5, 12, 12) + b"x" * 12 + struct.pack("<I", 44)
    for name, content in {
        "good": good, "garbage": b"no capture", "broken": good[: second + 8] + b"\xff" * 4 + good[second + 12 :], "tail": good[:-3],
        "timeless": pcapng(FRAMES) + simple, "old": pcapng(FRAMES) + old, "homeless": pcapng([])[:28] + old,
    }.items():
        put(tmp_path / "c", f"{name}.pcap", content)
    got = {r.source[5:-5]: (r.packets, r.error.split(" at ")[0]) for r in captures.capture_errors(spark, str(tmp_path / "c")).collect()}
    assert got == {
        "garbage": (0, "not a capture: unknown header"), "broken": (1, "broken packet record"), "tail": (8, "broken packet record"),
        "timeless": (9, "1 packets without a time"), "homeless": (0, "1 packets of an unknown interface"),
    }


def long_capture(kind):
    """Packets whose payloads look like records, and one as long as many ranges."""
    rng = random.Random(7)
    fake = b"".join(struct.pack("<IIII", 1_700_000_000, i, 40, 40) + b"x" * 40 for i in range(20))
    block = lambda number, body: struct.pack("<II", number, len(body) + 12) + body + struct.pack("<I", len(body) + 12)
    bodies = [rng.randbytes(rng.randrange(300)) for _ in range(110)] + [fake, b"".join(block(6, b"y" * 28) for _ in range(20)), b"z" * 9000] * 2
    rng.shuffle(bodies)
    frames = [ether(0x0800, ip_packet("10.0.0.1", "10.0.0.2", 17, udp(i % 60000, 53, body))) for i, body in enumerate(bodies)]
    if kind == "sections":  # interfaces of two sections, and packets without a time or an interface
        simple = block(3, struct.pack("<I", 4) + b"abcd")
        homeless = block(6, struct.pack("<IIIII", 9, 0, 0, 4, 4) + b"abcd")
        raw = pcapng(frames[:60]) + simple + homeless
        return raw + pcapng([])[:28] + block(1, struct.pack("<HHI", 1, 0, 0)) + block(1, struct.pack("<HHI", 0, 0, 0)) + pcapng(frames[60:])[48:] + simple
    return {"pcap": pcap(frames), "big": pcap(frames, ">"), "nano": pcap(frames, nano=True), "ng": pcapng(frames), "cut": pcap(frames)[:-5], "broken": pcap(frames[:90]) + b"\xff" * 900}[kind]


@pytest.mark.parametrize("kind", ["pcap", "big", "nano", "ng", "sections", "cut", "broken"])
def test_captures_in_ranges(spark, tmp_path, kind):
    """Equal rows and errors, whether a capture is read whole, as one range or as many."""
    content = long_capture(kind)
    path = put(tmp_path / "c", "a.pcap", content)
    whole = spark.createDataFrame([(path, bytearray(content))], "path string, content binary")
    want = sorted(map(str, captures.packets_of(whole).collect()))
    errors = sorted(map(str, captures.errors_of(whole).collect()))
    assert len(want) > 80
    for size in (1 << 30, len(content) // 8 + 1):
        assert sorted(map(str, captures.read_captures(spark, path, size).collect())) == want
    assert sorted(map(str, captures.capture_errors(spark, path, size).collect())) == errors
    assert captures.capture_ranges(spark, path, size).count() > 4


def test_wrong_guesses_are_mended(spark, tmp_path):
    """Ranges that begin among false records, which the chain of true ones corrects."""
    content = long_capture("pcap")
    false = content.index(b"x" * 40) - 16
    path = put(tmp_path / "c", "a.pcap", content)
    view = ranges.view_of(content)
    assert captures.Capture(view).guess(false, false + 56) == false  # a guess that is wrong
    whole = spark.createDataFrame([(path, bytearray(content))], "path string, content binary")
    for size in (false, false + 56):
        assert sorted(map(str, captures.read_captures(spark, path, size).collect())) == sorted(map(str, captures.packets_of(whole).collect()))


def test_csv_line_break_in_quotes(spark, tmp_path):
    path = put(tmp_path, "a.csv", 'src,note\n1,"one\ntwo"\n2,three\n')
    assert rows(files.read_csv(spark, path)) == [{"src": "1", "note": "one\ntwo"}, {"src": "2", "note": "three"}]


def test_csv_in_ranges(spark, tmp_path):
    """Odd quotes, line breaks of both kinds, short, long and empty lines: the same rows in any ranges as in one read of Spark."""
    rng = random.Random(12)
    cells = ["a", "", '"b"', '"c\nd"', '"e""f"', '5" disk', '"g,h"', '"i\r\nj"', '"\n\n"', "é😀", '"k" l', '""']
    text = " Source IP ,note,,x\n" + "".join(",".join(rng.choice(cells) for _ in range(rng.choice([4, 4, 4, 2, 5]))) + rng.choice(["\n", "\n", "\n\n"]) for _ in range(150))
    path = put(tmp_path, "a.csv", text + 'last,"open\n end')
    want = spark.read.csv(path, header=True, quote='"', escape='"', multiLine=True).na.fill("")
    want = [tuple(r[i] for i in (0, 1, 3)) for r in want.collect()]
    for size in (40, 700, 1 << 30):
        got = files.read_csv(spark, path, size=size).orderBy(files.ROW_ID)
        assert got.columns == ["Source IP", "note", "x", files.ROW_ID]
        assert [tuple(r)[:3] for r in got.collect()] == want
    assert csv_ranges.read(spark, [path], ",", "place", 700).select(F.spark_partition_id()).distinct().count() > 3
    put(tmp_path / "two", "a.csv", "a,b\r\n1,2\r\n")
    put(tmp_path / "two", "b.csv", "a,b\r\n3,4")
    assert [(r["a"], r["b"]) for r in rows(files.read_csv(spark, str(tmp_path / "two")))] == [("1", "2"), ("3", "4")]
    put(tmp_path / "two", "c.csv", "b,a\n5,6\n")
    with pytest.raises(Exception, match="another header"):
        files.read_csv(spark, str(tmp_path / "two")).collect()


def test_zeek_layouts(spark, tmp_path):
    """Layouts differ between files and change inside one; lines above any header are no records."""
    put(tmp_path / "z", "a.log", "early\tline\n#fields a b\n1\t2\n#close\n#fields b c\n3\t-\n4\n")
    put(tmp_path / "z", "b.log", "#fields\tc\ta\n5\t6\n")
    got = files.read_zeek(spark, str(tmp_path / "z"))
    found = sorted((r.a or "", r.b or "", r.c or "", r.a is None, r.c is None) for r in got.collect())
    assert found == [("", "3", "", True, False), ("", "4", "", True, False), ("1", "2", "", False, True), ("6", "", "5", False, False)]
    assert got.select(files.ROW_ID).distinct().count() == 4


def test_payload_parsers_survive_any_bytes():
    whole = client_hello("a.example")
    assert payloads.server_name(whole) == "a.example"
    for n in range(len(whole)):
        assert payloads.server_name(whole[:n]) is None
    question = dns_query("a.example")
    assert payloads.query_name(question) == "a.example" and payloads.query_name(b"") is None
    assert payloads.query_name(question[:14]) is None


def test_replay(spark, tmp_path):
    spark.range(3).coalesce(1).write.parquet(str(tmp_path / "t"))
    stream = replay(spark, str(tmp_path / "t"), "office.csv")
    assert stream.isStreaming and "source" in stream.columns

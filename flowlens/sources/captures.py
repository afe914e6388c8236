"""Packet captures (classic pcap and pcapng) as packet rows.

A large capture is read in ranges of bytes by many tasks. Where the first record of a range begins is guessed by a chain of
plausible records and then proved: the records before the range have to end there. A range whose guess was wrong is
surveyed again from the proved place. What a file holds beyond readable packets is never dropped without a word:
`capture_errors` lists it.
"""

from __future__ import annotations

import socket
import struct
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import shared_dir
from .ranges import View, can_open, listed, open_file, spread, view_of

#: Bytes of a range, records in a row that must be plausible where a range begins, and the longest plausible record.
RANGE, CHAIN, LONGEST = 128 << 20, 12, 1 << 20
BATCH = 20_000
_PACKETS = (
    "pkt_id long, us long, src_ip string, dest_ip string, src_port int, dest_port int, protocol string, "
    "length int, tcp_flags string, payload binary, source string"
)
_ERRORS = "source string, packets long, timeless long, homeless long, broken string"
_ARP = "id long, us long, op int, ip string, mac string, source string"
_FLAGS = "FSRPAUEC"  # lowest bit first
ETHERNET, RAW_IP, NULL_LOOP, LINUX_COOKED = 1, 101, 0, 113  # link types


SECTION, INTERFACE, PACKETS, TIMELESS = 0x0A0D0D0A, 1, (2, 6), 3  # kinds of pcapng blocks


class Capture:
    """Records of a capture from some place on. After `frames`, ``at`` is where it stopped, ``broken`` whether there
    because no record can be read, ``packets`` the number of packet records, ``timeless`` and ``homeless`` of those left out."""

    def __init__(self, view: View):
        self.view = view
        self.at = self.packets = self.timeless = self.homeless = 0
        self.broken, self.order, self.links, self.section = False, "<", [], False
        first = view.get(0, 24)
        self.kind = "pcapng" if first[:4] == b"\x0a\x0d\x0d\x0a" else None
        magics = {0xA1B2C3D4: 1, 0xA1B23C4D: 1000}
        for order in "<>" if self.kind is None and len(first) == 24 else "":
            if (per_us := magics.get(struct.unpack_from(order + "I", first)[0])) is not None:
                self.kind, self.order, self.per_us = "pcap", order, per_us
                self.link = struct.unpack_from(order + "I", first, 20)[0] & 0xFFFF
        self.start = 24 if self.kind == "pcap" else 0

    def frames(self, at: int, stop: int) -> Iterator[tuple[int, int, int, bytes]]:
        """``(number, microseconds, link type, bytes)`` of the packets whose records begin from ``at`` to before ``stop``.

        A broken record ends the iteration, because nothing tells where the next one begins."""
        self.at = at
        return self._pcap(stop) if self.kind == "pcap" else self._pcapng(stop)

    def _pcap(self, stop: int) -> Iterator[tuple[int, int, int, bytes]]:
        head = struct.Struct(self.order + "IIII")
        while self.at < stop:
            data = self.view.get(self.at, 16)
            size = head.unpack(data)[2] if len(data) == 16 else 0
            if len(data) < 16 or self.at + 16 + size > self.view.size:
                self.broken = True
                return
            sec, part, *_ = head.unpack(data)
            self.packets += 1
            yield self.packets - 1, sec * 1_000_000 + part // self.per_us, self.link, self.view.get(self.at + 16, size)
            self.at += 16 + size

    def _pcapng(self, stop: int) -> Iterator[tuple[int, int, int, bytes]]:
        while self.at < stop:
            data = self.view.get(self.at, 12)
            if data[:4] == b"\x0a\x0d\x0d\x0a":  # section header tells the byte order
                self.order = "<" if data[8:12] == b"\x4d\x3c\x2b\x1a" else ">"
                self.links, self.section = [], True
            number, size = struct.unpack_from(self.order + "II", data) if len(data) == 12 else (0, 0)
            if size < 12 or self.at + size > self.view.size:
                self.broken = True
                return
            body = self.view.get(self.at + 8, size - 12)
            if number == INTERFACE:
                self.links.append((struct.unpack_from(self.order + "H", body)[0], _tick(body[8:], self.order)))
            elif number in PACKETS and len(body) >= 20:  # the old form has a shorter interface number
                self.packets += 1
                face, high, low, caught, _ = struct.unpack_from(self.order + ("IIIII" if number == 6 else "HxxIIII"), body)
                if face < len(self.links):
                    link, tick = self.links[face]
                    yield self.packets - 1, ((high << 32) + low) * 1_000_000 // tick, link, body[20 : 20 + caught]
                else:
                    self.homeless += 1
            elif number == TIMELESS:  # has no time, so it cannot belong to a flow
                self.packets += 1
                self.timeless += 1
            self.at += size

    def _next(self, at: int, order: str) -> int | None:
        """Where the record there ends, if it is plausible."""
        if self.kind == "pcap":
            data = self.view.get(at, 16)
            if len(data) < 16:
                return None
            _, part, size, whole = struct.unpack(order + "IIII", data)
            plausible = part < 1_000_000 * self.per_us and size <= min(whole, LONGEST) and whole <= LONGEST
            end = at + 16 + size
        else:
            data = self.view.get(at, 8)
            if len(data) < 8 or at % 4:
                return None
            _, size = struct.unpack(order + "II", data)
            end = at + size
            plausible = size >= 12 and size % 4 == 0 and size <= LONGEST and self.view.get(end - 4, 4) == data[4:]
        return end if plausible and end <= self.view.size else None

    def guess(self, low: int, high: int) -> int | None:
        """Where the first record from ``low`` to before ``high`` may begin; sets the byte order."""
        for at in range(low, high):
            for order in self.order if self.kind == "pcap" else "<>":
                end, left = at, CHAIN
                while left and end is not None and end < self.view.size:
                    end, left = self._next(end, order), left - 1
                if end is not None:
                    self.order = order
                    return at
        return None


def _tick(options: bytes, order: str) -> int:
    """Ticks per second of an interface (option 9), a microsecond by default."""
    at = 0
    while at + 4 <= len(options):
        code, size = struct.unpack_from(order + "HH", options, at)
        if code == 9 and size == 1:
            value = options[at + 4]
            return 1 << (value & 127) if value & 128 else 10**value
        if code == 0:
            break
        at += 4 + (size + 3) // 4 * 4
    return 1_000_000


def network_layer(link: int, frame: bytes) -> tuple[int, bytes]:
    """EtherType and bytes of the network layer."""
    if link == ETHERNET and len(frame) >= 14:
        kind, at = int.from_bytes(frame[12:14], "big"), 14
        while kind in (0x8100, 0x88A8) and at + 4 <= len(frame):  # VLAN tags
            kind, at = int.from_bytes(frame[at + 2 : at + 4], "big"), at + 4
        return kind, frame[at:]
    if link == LINUX_COOKED and len(frame) >= 16:
        return int.from_bytes(frame[14:16], "big"), frame[16:]
    if link == NULL_LOOP:
        return 0x0800, frame[4:]
    return 0x0800, frame


def ipv4(packet: bytes) -> tuple | None:
    """``(src, dest, sport, dport, protocol, flags, payload)`` of an IPv4 packet."""
    if len(packet) < 20 or packet[0] >> 4 != 4:
        return None
    head = (packet[0] & 15) * 4
    total = int.from_bytes(packet[2:4], "big") or len(packet)
    body = packet[head:total]
    src, dest = socket.inet_ntoa(packet[12:16]), socket.inet_ntoa(packet[16:20])
    number = packet[9]
    if int.from_bytes(packet[6:8], "big") & 0x1FFF:  # later fragments carry no ports
        return src, dest, 0, 0, "OTHER", None, None
    if number == 6 and len(body) >= 20:
        flags = "".join(c for i, c in enumerate(_FLAGS) if body[13] >> i & 1)
        return src, dest, *struct.unpack_from(">HH", body), "TCP", flags, body[(body[12] >> 4) * 4 :]
    if number == 17 and len(body) >= 8:
        return src, dest, *struct.unpack_from(">HH", body), "UDP", None, body[8:]
    return src, dest, 0, 0, "ICMP" if number == 1 else "OTHER", None, None


def _packet_rows(capture: Capture, at: int, stop: int, source: str) -> Iterator[tuple]:
    for i, us, link, frame in capture.frames(at, stop):
        kind, packet = network_layer(link, frame)
        found = ipv4(packet) if kind == 0x0800 else None
        if found:
            src, dest, sport, dport, protocol, flags, payload = found
            yield i, us, src, dest, sport, dport, protocol, len(frame), flags, payload, source


def _arp_rows(capture: Capture, at: int, stop: int, source: str) -> Iterator[tuple]:
    for i, us, link, frame in capture.frames(at, stop):
        kind, arp = network_layer(link, frame)
        if kind == 0x0806 and len(arp) >= 28 and arp[4] == 6 and arp[5] == 4:
            yield i, us, int.from_bytes(arp[6:8], "big"), socket.inet_ntoa(arp[14:18]), arp[8:14].hex(":"), source


def _left_out(capture: Capture, at: int, stop: int, source: str) -> Iterator[tuple]:
    """What is wrong in a range, and its readable packets."""
    for _ in capture.frames(at, stop):
        pass
    readable = capture.packets - capture.first - capture.timeless - capture.homeless
    kind = "packet record" if capture.kind == "pcap" else "block"
    broken = f"broken {kind} at byte {capture.at}" if capture.broken else "" if capture.kind else "not a capture: unknown header"
    yield source, readable, capture.timeless, capture.homeless, broken


def _source(path: str) -> str:
    return "pcap:" + path.rsplit("/", 1)[-1]


def _in_frames(rows: Iterator[tuple], columns: list[str]) -> Iterator[pd.DataFrame]:
    buffer = []
    for row in rows:
        buffer.append(row)
        if len(buffer) == BATCH:
            yield pd.DataFrame(buffer, columns=columns)
            buffer = []
    if buffer:
        yield pd.DataFrame(buffer, columns=columns)


def _decode_whole(rows, columns: list[str]):
    """Decode captures that lie whole in a column."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for path, content in zip(pdf["path"], pdf["content"]):
                capture = Capture(view_of(content))
                capture.first = 0
                stop = len(content) if capture.kind else 0
                yield from _in_frames(rows(capture, capture.start, stop, _source(path)), columns)

    return run


def _decode_ranges(rows, columns: list[str]):
    """Decode surveyed ranges of files."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for r in pdf.itertuples(index=False):
                capture = Capture(open_file(r.path, int(r.length)))
                capture.packets = capture.first = int(r.first)
                if r.order:
                    capture.order, capture.links = r.order, [(int(f["link"]), int(f["tick"])) for f in r.links]
                at = capture.start if r.part == 0 else int(r.start)
                yield from _in_frames(rows(capture, at, int(r.high) if capture.kind else 0, _source(r.path)), columns)

    return run


# --- ranges ------------------------------------------------------------------------------------

_FACES = "array<struct<link:bigint,tick:bigint>>"
_SURVEY = f"path string, length long, part long, low long, high long, start long, end long, n long, order string, section boolean, faces {_FACES}"
_PLAN = f"path string, length long, part long, high long, start long, first long, order string, links {_FACES}, again boolean"


def _survey(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Per range where its records begin (given, or guessed) and end (-1: broken), their number and the interfaces in it."""
    for pdf in batches:
        for r in pdf.itertuples(index=False):
            capture = Capture(open_file(r.path, int(r.length)))
            low, high = int(r.low), int(r.high)
            given = None if pd.isna(r.start) else int(r.start)
            if capture.kind is None:
                start = None
            elif r.part == 0:
                start = capture.start
            else:
                start = given if given is not None else capture.guess(low, high)
                if given is not None and capture.kind == "pcapng":  # for the byte order
                    capture.guess(given, given + 1)
            end = None
            if start is not None:
                for _ in capture.frames(start, high):
                    pass
                end = -1 if capture.broken else capture.at
            faces = [{"link": link, "tick": tick} for link, tick in capture.links]
            row = (r.path, r.length, r.part, low, high, start, end, capture.packets, capture.order, capture.section, faces)
            out = pd.DataFrame([row], columns=_names(_SURVEY))
            yield out.astype({"start": "Int64", "end": "Int64"})


def _prove(pdf: pd.DataFrame) -> pd.DataFrame:
    """The ranges of a file in order: the records of one have to begin where those before it end. ``again``: the first
    range for which they do not, to be surveyed from there."""
    out, place, first, links, order = [], None, 0, [], None
    for r in pdf.sort_values("part").itertuples(index=False):
        start = None if pd.isna(r.start) else int(r.start)
        if place is None:
            place = start  # the first range is right
        if place is None or place < 0 or place >= r.high:
            continue  # nothing begins here: no capture, broken before, or within a record from before
        again = start != place
        out.append((r.path, r.length, r.part, r.high, place, first, order or r.order, list(links), again))
        if again:
            break
        place, first, order = int(r.end), first + int(r.n), r.order
        links = list(r.faces) if r.section else links + list(r.faces)
    return pd.DataFrame(out, columns=_names(_PLAN))


def capture_ranges(spark: SparkSession, path: str, size: int = RANGE) -> DataFrame:
    """The captures below a path in ranges of up to ``size`` bytes, each with the place of its first record, the number of
    packets before it and the interfaces known there. Files of one range are not opened for it.

    A file has one row per ``size`` bytes here; these, without the bytes, are put in order per file.
    """
    files = listed(spark, path).where(F.lower("path").rlike(r"\.(pcap|pcapng|cap)$") & (F.col("length") > 0))
    cut = files.select("*", F.explode(F.sequence(F.lit(0), F.floor((F.col("length") - 1) / size))).alias("part"))
    cut = cut.select("path", "length", "part", (F.col("part") * size).alias("low"), F.least((F.col("part") + 1) * size, "length").alias("high"))
    none = F.lit(None).cast("long")
    single = cut.where(F.col("length") <= size).select("path", "length", "part", "high", none.alias("start"), F.lit(0).cast("long").alias("first"), F.lit(None).cast("string").alias("order"), F.array().cast(_FACES).alias("links"))
    many = cut.where(F.col("length") > size).withColumn("start", none)
    surveyed = _stored(spread(many).mapInPandas(_survey, _SURVEY), "capture-survey")
    while True:
        plan = _stored(surveyed.groupBy("path").applyInPandas(_prove, _PLAN), "capture-ranges")
        wrong = plan.where("again").select("path", "length", "part", "high", F.col("start").alias("low"), "start")
        if not wrong.limit(1).count():
            break
        better = spread(wrong.select("path", "length", "part", "low", "high", "start")).mapInPandas(_survey, _SURVEY)
        kept = surveyed.join(wrong.select("path", "part"), ["path", "part"], "left_anti")
        surveyed = _stored(kept.unionByName(better), "capture-survey")
    return single.unionByName(plan.drop("again"))


def _stored(df: DataFrame, name: str) -> DataFrame:
    path = shared_dir(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def capture_files(spark: SparkSession, path: str) -> DataFrame:
    """``(path, content)`` of the captures below a path, for file systems that tasks cannot open by themselves."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path)
    return files.where(F.lower("path").rlike(r"\.(pcap|pcapng|cap)$")).select("path", "content")


def _rows(spark: SparkSession, path: str, rows, schema: str, size: int) -> DataFrame:
    if not can_open(listed(spark, path)):
        return capture_files(spark, path).mapInPandas(_decode_whole(rows, _names(schema)), schema)
    return spread(capture_ranges(spark, path, size)).mapInPandas(_decode_ranges(rows, _names(schema)), schema)


def _timed(rows: DataFrame) -> DataFrame:
    return rows.withColumn("ts", F.timestamp_micros("us")).drop("us")


def _errors(parts: DataFrame) -> DataFrame:
    """What is wrong with a file from what is wrong with its ranges."""
    sums = parts.groupBy("source").agg(F.sum("packets").alias("packets"), F.sum("timeless").alias("t"), F.sum("homeless").alias("h"), F.max("broken").alias("b"))
    told = F.array(
        F.nullif("b", F.lit("")),
        F.when(F.col("t") > 0, F.concat(F.col("t").cast("string"), F.lit(" packets without a time"))),
        F.when(F.col("h") > 0, F.concat(F.col("h").cast("string"), F.lit(" packets of an unknown interface"))),
    )
    return sums.select("source", "packets", F.explode(F.array_compact(told)).alias("error"))


def packets_of(files: DataFrame) -> DataFrame:
    """IPv4 packets of captures ``(path, content)``, in the packet schema."""
    return _timed(files.mapInPandas(_decode_whole(_packet_rows, _names(_PACKETS)), _PACKETS))


def errors_of(files: DataFrame) -> DataFrame:
    """``(source, packets, error)``: what could not be read of captures, with the packets that could. Whole files give no row."""
    return _errors(files.mapInPandas(_decode_whole(_left_out, _names(_ERRORS)), _ERRORS))


def _names(schema: str) -> list[str]:
    return [part.split()[0] for part in schema.split(", ")]


def read_captures(spark: SparkSession, path: str, size: int = RANGE) -> DataFrame:
    """IPv4 packets of all captures below a path, in the packet schema; ``pkt_id`` numbers the packet records of a file.

    Files of any size are read in ranges of ``size`` bytes. Files that are no captures give no rows, a broken record ends
    its file; see `capture_errors`.
    """
    return _timed(_rows(spark, path, _packet_rows, _PACKETS, size))


def read_arp(spark: SparkSession, path: str, size: int = RANGE) -> DataFrame:
    """ARP messages of all captures below a path."""
    return _timed(_rows(spark, path, _arp_rows, _ARP, size))


def capture_errors(spark: SparkSession, path: str, size: int = RANGE) -> DataFrame:
    """What could not be read of the captures below a path."""
    return _errors(_rows(spark, path, _left_out, _ERRORS, size))

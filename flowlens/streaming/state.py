"""Keyed state in event time: alert incidents, ARP, notification limit, device anomaly, drift.

Rows wait until the watermark has passed them, and then go through the rule of their key in the order of their
times, whatever the micro-batches were. So a stream gives what the batch form gives, as long as no row is later than the
``delay``; later ones are dropped and counted by Spark (`run.late_rows`). What waits is bounded by the delay and not by the
size of a micro-batch; frames of rows are put away one by one. The end of the data within the delay is kept back until
later rows move the clock.

Keys share buckets (by their hash), and a bucket is what Spark groups by: a call and its trips to the state store then serve
all keys of the bucket that have rows, instead of one. Rows that wait and the states of the keys are kept as typed frames
(Arrow). With ``idle_hours`` a state is dropped when its key had no rows for that long in event time; this bounds the number
of devices and signatures kept. A task holds what waits in one bucket: `BUCKETS` is fixed when a stream first starts.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from ..functions import verdicts
from ..functions.values import micros
from ..operators import anomaly, drift
from ..operators.alerts import NOTIFY_KEY, SIGNATURE

HOUR_US = 3_600_000_000
DELAY = "1 minute"
#: Times beyond these (about the year 2255) count as these for the watermark, as pandas knows none far beyond.
LAST_US = 9_000_000_000_000_000
#: Rows per frame that is handed back to Spark, and states per frame that is kept.
FRAME = 10_000
#: The keys of a stream share so many groups.
BUCKETS = 1024
_ARROW = {
    "long": pa.int64(), "bigint": pa.int64(), "int": pa.int32(), "double": pa.float64(), "boolean": pa.bool_(), "string": pa.string(),
    "binary": pa.binary(), "array<binary>": pa.list_(pa.binary()), "array<long>": pa.list_(pa.int64()),
}
#: Kinds that travel as text, because pandas would make floats of whole numbers next to nulls.
_WHOLE = ("long", "bigint", "int")


def _fields(schema: str) -> list[tuple[str, str]]:
    return [tuple(part.split(" ", 1)) for part in schema.split(", ")]


def _names(schema: str) -> list[str]:
    return [name for name, _ in _fields(schema)]


def _packed(table: pa.Table) -> bytes:
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, table.schema) as writer:
        writer.write_table(table)
    return sink.getvalue().to_pybytes()


def _unpacked(frames) -> pa.Table:
    return pa.concat_tables([pa.ipc.open_stream(frame).read_all() for frame in frames])


class _Keyed(StatefulProcessor):
    """Rows of the keys of a bucket in event time. A subclass says what waits (``row``: ``us`` and the order first), what is
    kept per key (``kept``) and what the rows of a key do (``step``)."""

    row: str
    kept: str
    order: int = 2  # the first columns of a row that give its place
    keys: list[tuple[str, str]]  # set by `_run`: names and types
    arrow: dict[str, pa.DataType]  # set by `_run`: these types and those of the rows as Arrow has them

    def __init__(self, columns: list[str], idle_hours: float | None = None):
        self.columns, self.idle = columns, round(idle_hours * HOUR_US) if idle_hours else None

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.waiting = handle.getListState("waiting", "first_us long, rows binary")
        self.cells = handle.getListState("kept", "states binary")

    def start(self) -> dict:
        raise NotImplementedError

    def step(self, key: tuple, rows: list[tuple], state: dict) -> Iterator[tuple]:
        """What the rows, in order, give; changes the state."""
        raise NotImplementedError

    def _wake(self, us: int) -> None:
        self.handle.registerTimer(us // 1000 + 1)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        firsts = []
        for frame in rows:
            cells = {}
            for name, kind in [*self.keys, *_fields(self.row)]:
                text = kind in _WHOLE and not pd.api.types.is_numeric_dtype(frame[name])
                cell = pa.array(frame[name], type=pa.string() if text else self.arrow[kind], from_pandas=True)
                cells[name] = cell.cast(self.arrow[kind])
            firsts.append(pc.min(cells["us"]).as_py())
            self.waiting.appendValue((firsts[-1], _packed(pa.table(cells))))
        if firsts:
            self._wake(min(firsts))
        return iter(())

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        now = timerValues.getCurrentWatermarkInMs() * 1000
        due = self._due(now)
        if due is None and not self.idle:
            return
        states = self._states()
        out = []
        for name, rows in self._by_key(due):
            state = states.setdefault(name, {"last_us": None} | self.start())
            for stretch in self._awake(rows, state):
                for line in self.step(name, stretch, state):
                    out.append(line)
                    if len(out) == FRAME:
                        yield pd.DataFrame(out, columns=self.columns, dtype=object)
                        out = []
        if self.idle:  # rows that still wait are later than now, so they find a key that was idle for too long anew
            states = {name: state for name, state in states.items() if state["last_us"] + self.idle > now}
            if states:
                self._wake(min(state["last_us"] for state in states.values()) + self.idle)
        self._keep(states)
        if out:
            yield pd.DataFrame(out, columns=self.columns, dtype=object)

    def _due(self, now: int) -> pa.Table | None:
        """The rows that the watermark has passed, in order; the others wait on."""
        frames = [tuple(x) for x in self.waiting.get()]
        opened = [rows for first, rows in frames if first <= now]
        rest = [x for x in frames if x[0] > now]
        due = None
        if opened:
            table = _unpacked(opened)
            over = pc.less_equal(table["us"], now)
            due, later = table.filter(over), table.filter(pc.invert(over))
            if later.num_rows:
                rest.append((pc.min(later["us"]).as_py(), _packed(later)))
            self.waiting.put(rest) if rest else self.waiting.clear()
            places = [(name, "ascending") for name in _names(self.row)[: self.order]]
            due = due.take(pc.sort_indices(due, sort_keys=places, null_placement="at_start"))
        if rest:
            self._wake(min(first for first, _ in rest))
        return due

    def _by_key(self, due: pa.Table | None) -> Iterator[tuple[tuple, list[tuple]]]:
        of_key: dict[tuple, list[tuple]] = {}
        if due is not None:
            n = len(self.keys)
            for row in zip(*[column.to_pylist() for column in due.columns]):
                of_key.setdefault(row[:n], []).append(row[n:])
        yield from of_key.items()

    def _states(self) -> dict[tuple, dict]:
        frames = [x[0] for x in self.cells.get()]
        if not frames:
            return {}
        table = _unpacked(frames)
        keys, names = [f"key{i}" for i in range(len(self.keys))], ["last_us", *_names(self.kept)]
        told = [zip(*[table[name].to_pylist() for name in part]) for part in (keys, names)]
        return {key: dict(zip(names, cells)) for key, cells in zip(*told)}

    def _keep(self, states: dict[tuple, dict]) -> None:
        kinds = [(f"key{i}", kind) for i, (_, kind) in enumerate(self.keys)]
        shape = pa.schema([(name, self.arrow[kind]) for name, kind in [*kinds, ("last_us", "long"), *_fields(self.kept)]])
        lines = [dict(zip([name for name, _ in kinds], key)) | state for key, state in states.items()]
        frames = [(_packed(pa.Table.from_pylist(lines[i : i + FRAME], shape)),) for i in range(0, len(lines), FRAME)]
        self.cells.put(frames) if frames else self.cells.clear()

    def _awake(self, rows: list[tuple], state: dict) -> Iterator[list[tuple]]:
        """The rows in stretches between which the key was idle for too long; the state starts anew after such a pause."""
        times = [state["last_us"], *[r[0] for r in rows]]
        turns = [i for i in range(len(rows)) if self.idle and times[i] is not None and times[i + 1] - times[i] > self.idle]
        for a, b in zip([0, *turns], [*turns, len(rows)]):
            if a in turns:
                state |= self.start()
            if b > a:
                state["last_us"] = rows[b - 1][0]
                yield rows[a:b]

    def close(self) -> None:
        pass


def _run(df: DataFrame, keys: list[str], processor: _Keyed, schema: str, delay: str) -> DataFrame:
    """``us`` is the event time of the rows; rows without one take no part."""
    types = {key: df.schema[key].dataType for key in keys}
    processor.keys = [(key, kind.simpleString()) for key, kind in types.items()]
    processor.arrow = {kind.simpleString(): to_arrow_type(kind) for kind in types.values()} | _ARROW

    def exact(name: str, kind: str) -> Column:
        return F.col(name).cast("string" if kind in _WHOLE and name != "us" and df.schema[name].nullable else kind).alias(name)

    bucket = F.pmod(F.xxhash64(*keys), F.lit(BUCKETS)).alias("bucket__")
    within = F.timestamp_micros(F.least(F.greatest("us", F.lit(-LAST_US)), F.lit(LAST_US))).alias("ts__")
    cells = [exact(name, kind) for name, kind in [*processor.keys, *_fields(processor.row)]]
    timed = df.where("us is not null").select(bucket, *cells, within).withWatermark("ts__", delay)
    return timed.groupBy("bucket__").transformWithStateInPandas(processor, schema, "Append", "EventTime")


# --- alert incidents ----------------------------------------------------------------------------

_INCIDENT = (
    "threat_level string, alert_type string, device string, incident long, alert_id long, opened_us long, "
    "seen_us long, count long, status string, is_simulated boolean, notes string, log_id long, version long"
)


class Incidents(_Keyed):
    row = "us long, kind long, id long, action string, is_simulated boolean, notes string, log_id long"
    order = 3
    kept = "incident long, version long, alert_id long, first long, last long, n long, status string, sim boolean, note string, log long"

    def start(self):
        return dict.fromkeys(_names(self.kept)) | {"incident": 0, "version": 0}

    def step(self, key, rows, state):
        """``alert_id`` is null while no alert is open. Every alert that changed is given once."""
        changed = {}

        def change():
            body = [state[c] for c in ("alert_id", "first", "last", "n", "status", "sim", "note", "log")]
            changed[state["incident"]] = (*key, state["incident"], *body, state["version"])

        state["version"] += 1
        for us, kind, ident, action, sim, note, log in rows:
            if kind == 0 and state["alert_id"] is None:
                state |= {"alert_id": ident, "first": us, "last": us, "n": 1, "status": "New", "sim": bool(sim), "note": note, "log": log}
            elif kind == 0:
                state |= {"n": state["n"] + 1, "last": max(state["last"], us), "sim": state["sim"] or bool(sim)}
                state["log"] = state["log"] if log is None else log
                if state["status"] == "New":
                    state["status"] = "Active"
            elif action == "acknowledge" and state["alert_id"] is not None:
                state["status"] = "Acknowledged"
            elif action == "resolve":
                if state["alert_id"] is not None:
                    state["status"] = "Resolved"
                    change()
                state |= {"incident": state["incident"] + 1, "alert_id": None}
            if state["alert_id"] is not None:
                change()
        yield from changed.values()


def timeline(events: DataFrame, actions: DataFrame) -> DataFrame:
    """Events and actions of one stream, ready for ``incidents_stream``."""
    return event_timeline(events).unionByName(
        actions.select(
            *SIGNATURE, "id", micros(F.col("ts")).alias("us"), F.lit(1).cast("long").alias("kind"), "action", F.lit(False).alias("is_simulated"),
            F.lit(None).cast("string").alias("notes"), F.lit(None).cast("long").alias("log_id"),
        )
    )


def event_timeline(events: DataFrame) -> DataFrame:
    """The same without actions; ``notes`` and ``log_id`` of the events are kept if they have them."""

    def extra(name: str, kind: str):
        return F.col(name) if name in events.columns else F.lit(None).cast(kind).alias(name)

    return events.select(
        *SIGNATURE, "id", micros(F.col("ts")).alias("us"), F.lit(0).cast("long").alias("kind"), F.lit("").alias("action"), "is_simulated",
        extra("notes", "string"), extra("log_id", "long"),
    )


def incidents_stream(rows: DataFrame, delay: str = DELAY) -> DataFrame:
    """Changed alerts as the watermark goes on; the highest ``version`` of an incident is its present form.

    Signatures are kept for good, as alerts stay open until they are resolved and incidents are numbered on.
    """
    return _run(rows, SIGNATURE, Incidents(_names(_INCIDENT)), _INCIDENT, delay)


def present_incidents(changes: DataFrame) -> DataFrame:
    """The present form of every alert from the stored changes."""
    body = F.struct("alert_id", "opened_us", "seen_us", "count", "status", "is_simulated", "notes", "log_id")
    newest = changes.groupBy(*SIGNATURE, "incident").agg(F.max_by(body, "version").alias("a"))
    return newest.select(
        "a.alert_id",
        *SIGNATURE,
        "incident",
        F.timestamp_micros("a.opened_us").alias("alert_time"),
        F.timestamp_micros("a.seen_us").alias("last_seen"),
        "a.count",
        "a.status",
        (F.col("a.status") == "Resolved").alias("is_resolved"),
        "a.is_simulated",
        verdicts.simulated_note(F.col("a.is_simulated"), F.col("a.notes")).alias("notes"),
        "a.log_id",
        F.lit(None).cast("long").alias("device_id"),
    )


# --- ARP ----------------------------------------------------------------------------------------

_CONFLICT = "ip string, id long, us long, old_mac string, new_mac string"


class FirstMac(_Keyed):
    row, kept = "us long, id long, mac string", "mac string"

    def start(self):
        return {"mac": None}

    def step(self, key, rows, state):
        for us, ident, mac in rows:
            state["mac"] = state["mac"] or mac
            if mac != state["mac"]:
                yield (*key, ident, us, state["mac"], mac)


def arp_conflicts_stream(replies: DataFrame, delay: str = DELAY, idle_hours: float | None = None) -> DataFrame:
    """Replies whose MAC is not the first one seen for their address, as in the batch form."""
    answers = replies.where((F.col("op") == 2) & F.col("ip").isNotNull() & F.col("mac").isNotNull())
    rows = answers.select("ip", "id", micros(F.col("ts")).alias("us"), "mac")
    found = _run(rows, ["ip"], FirstMac(_names(_CONFLICT), idle_hours), _CONFLICT, delay)
    return found.select("id", F.timestamp_micros("us").alias("ts"), "ip", "old_mac", "new_mac")


# --- notification limit -------------------------------------------------------------------------


class NotificationLimit(_Keyed):
    row, kept = "us long, id long", "sent long"

    def __init__(self, columns, gap_us: int, idle_hours=None):
        super().__init__(columns, idle_hours)
        self.gap_us = gap_us

    def start(self):
        return {"sent": None}

    def step(self, key, rows, state):
        for us, ident in rows:
            if state["sent"] is None or us - state["sent"] >= self.gap_us:
                state["sent"] = us
                yield (*key, us, ident)


def rate_limit_stream(
    events: DataFrame, seconds: float = 2.0, keys: list[str] | None = None, delay: str = DELAY, idle_hours: float | None = None
) -> DataFrame:
    keys = keys or NOTIFY_KEY
    rows = events.select(*keys, micros(F.col("ts")).alias("us"), "id")
    types = {f.name: f.dataType.simpleString() for f in rows.schema}
    schema = ", ".join([*(f"{k} {types[k]}" for k in keys), "us long, id long"])
    return _run(rows, keys, NotificationLimit(_names(schema), round(seconds * 1e6), idle_hours), schema, delay)


# --- device anomaly -----------------------------------------------------------------------------

_SCORED = (
    "src_ip string, id long, us long, total_bytes long, duration double, protocol string, sample_no long, score double"
)


class DeviceScores(_Keyed):
    row = "us long, id long, total_bytes long, duration double, protocol string, leaf binary"
    kept = "n long, block array<binary>, reference array<binary>"

    def __init__(self, columns, forest: anomaly.Forest, idle_hours=None):
        super().__init__(columns, idle_hours)
        self.forest = forest

    def start(self):
        return {"n": 0, "block": [], "reference": []}

    def step(self, key, rows, state):
        """Block after block: a window of flows is scored against the window before it."""
        block, reference, at = [bytes(x) for x in state["block"]], [bytes(x) for x in state["reference"]], 0
        while at < len(rows):
            part = rows[at : at + self.forest.window - len(block)]
            leaves = [r[-1] for r in part]
            if reference:
                scores = self.forest.scores(anomaly.unpack(leaves), anomaly.unpack(reference))
            else:
                scores = np.zeros(len(part))
            for row, score in zip(part, scores):
                state["n"] += 1
                us, ident, *shown = row[:-1]
                yield (*key, ident, us, *shown, state["n"], float(score))
            block += leaves
            if len(block) == self.forest.window:
                reference, block = block, []
            at += len(part)
        state |= {"block": block, "reference": reference}


def device_anomaly_stream(
    flows: DataFrame, *, trees: int = 25, height: int = 8, window: int = 20, seed: int = 42,
    threshold: float = anomaly.THRESHOLD, delay: str = DELAY, idle_hours: float | None = None,
) -> DataFrame:
    """Same scores as the batch form, flow by flow."""
    forest = anomaly.build_forest(trees, height, window, seed)
    features = anomaly.device_features(*[F.col(c) for c in ("total_bytes", "duration", "protocol", "timestamp", "packet_count")])
    rows = flows.select(
        "src_ip",
        "id",
        micros(F.col("timestamp")).alias("us"),
        "total_bytes",
        F.col("duration").cast("double").alias("duration"),
        "protocol",
        anomaly.leaf_bytes(forest)(*features).alias("leaf"),
    )
    scored = _run(rows, ["src_ip"], DeviceScores(_names(_SCORED), forest, idle_hours), _SCORED, delay)
    return anomaly.judge(scored.withColumn("timestamp", F.timestamp_micros("us")), threshold, window)


# --- drift --------------------------------------------------------------------------------------


class DriftState(_Keyed):
    row = "us long, block long, n long, wrong long"
    kept = "levels array<long>, sizes array<long>, errors array<long>, seen long, wrong long"

    def __init__(self, columns, delta: float, idle_hours=None):
        super().__init__(columns, idle_hours)
        self.delta = delta

    def start(self):
        return {"levels": [], "sizes": [], "errors": [], "seen": 0, "wrong": 0}

    def step(self, key, rows, state):
        """The rows of a block come together, as the block is over when they are due."""
        window = drift.AdaptiveWindow(self.delta, buckets=[list(b) for b in zip(state["levels"], state["sizes"], state["errors"])])
        sums: dict[int, list[int]] = {}
        for _, block, n, wrong in rows:
            both = sums.setdefault(block, [0, 0])
            both[0], both[1] = both[0] + n, both[1] + wrong
        for block, (n, wrong) in sums.items():
            state["seen"], state["wrong"] = state["seen"] + n, state["wrong"] + wrong
            if window.add(n, wrong):
                yield (*key, block, state["seen"], 1 - state["wrong"] / state["seen"], window.size, window.errors / window.size)
        levels, sizes, errors = zip(*window.buckets) if window.buckets else ((), (), ())
        state |= {"levels": [int(x) for x in levels], "sizes": [int(x) for x in sizes], "errors": [int(x) for x in errors]}


def drift_stream(
    rows: DataFrame, key: str, ts: str, error, *, block_us: int = 300_000_000, delta: float = drift.DELTA, delay_seconds: float = 60.0,
    idle_hours: float | None = None,
) -> DataFrame:
    """Cuts of the adaptive window as blocks of time complete. Rows become sums per block before they are shuffled."""
    blocks = rows.select(key, F.floor(micros(F.col(ts)) / F.lit(block_us)).alias("block"), error.cast("int").alias("wrong"))
    key_type = blocks.schema[key].dataType.simpleString()

    def summed(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            yield batch.groupby([key, "block"], as_index=False, dropna=False)["wrong"].agg(["size", "sum"]).set_axis([key, "block", "n", "wrong"], axis=1)

    blocks = blocks.mapInPandas(summed, f"{key} {key_type}, block long, n long, wrong long")
    schema = f"{key} {key_type}, block long, samples_processed long, accuracy double, width long, estimation double"
    # The sums of a block bear the time of its end, which is up to a block ahead of their rows.
    blocks = blocks.withColumn("us", (F.col("block") + 1) * F.lit(block_us) - 1)
    delay = f"{round(delay_seconds * 1000) + block_us // 1000} milliseconds"
    found = _run(blocks, [key], DriftState(_names(schema), delta, idle_hours), schema, delay)
    return found.select(
        key,
        F.timestamp_micros((F.col("block") + 1) * F.lit(block_us)).alias("timestamp"),
        "samples_processed",
        "accuracy",
        "width",
        "estimation",
        F.lit(True).alias("drift_detected"),
    )

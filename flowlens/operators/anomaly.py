"""Per-device anomaly scores with half-space trees (Tan, Ting and Liu, IJCAI 2011).

Each device is scored against its own previous block of flows. The trees are fixed random half-space
splits, equal for all devices; a flow is reduced to one leaf number per tree, and everything else is
counting how deep two flows share a path. The published score adds the term of the node where the
walk stops; here the whole walk is added and divided by its maximum, so that the score is 0..1 and
high means odd.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import verdicts
from ..functions.values import device_protocol_id, round_places
from .ordering import running_totals

# Upper end of each feature's range; all start at 0.
FEATURE_LIMITS = {"bytes": 1e8, "duration": 3600.0, "proto_id": 255.0, "hour": 24.0, "pkt_count": 5e4}
THRESHOLD = 0.70


@dataclass(frozen=True)
class Forest:
    """Split dimension and split point of every inner node, in heap order (root 1)."""

    dims: np.ndarray
    cuts: np.ndarray
    height: int
    window: int

    def leaves(self, x: np.ndarray) -> np.ndarray:
        """Leaf number (0 .. 2^height - 1) per row and tree."""
        trees = np.arange(len(self.dims))
        rows = np.arange(len(x))[:, None]
        node = np.ones((len(x), len(trees)), dtype=np.int64)
        for _ in range(self.height):
            node = 2 * node + (x[rows, self.dims[trees, node]] >= self.cuts[trees, node])
        return (node - (1 << self.height)).astype(np.uint8)

    def scores(self, leaves: np.ndarray, reference: np.ndarray) -> np.ndarray:
        """Score of each row of ``leaves`` against the rows of the previous block."""
        differ = np.bitwise_xor(leaves[:, None, :], reference[None, :, :])
        shared = self.height - np.ceil(np.log2(np.arange(256) + 1)).astype(np.int64)
        depth = shared[differ]  # (rows, reference rows, trees)
        total = np.zeros(len(leaves), dtype=np.int64)
        walking = np.ones((len(leaves), leaves.shape[1]), dtype=bool)
        for d in range(self.height + 1):
            mass = (depth >= d).sum(axis=1)
            total += (np.where(walking, mass, 0) << d).sum(axis=1)
            walking &= mass >= 0.1 * self.window
        return 1.0 - total / (leaves.shape[1] * self.window * (2 ** (self.height + 1) - 1))


def build_forest(trees: int = 25, height: int = 8, window: int = 20, seed: int = 42) -> Forest:
    """Random trees: per tree a random work range around each feature, per node a random feature,
    split in the middle of what is left of its range."""
    if not 1 <= height <= 8:
        raise ValueError("height must be 1..8, a leaf number is stored in one byte")
    rng = np.random.default_rng(seed)
    n_dims, inner = len(FEATURE_LIMITS), 1 << height
    dims = np.zeros((trees, inner), dtype=np.int64)
    cuts = np.zeros((trees, inner))
    for t in range(trees):
        centre = rng.integers(0, 1025, n_dims) / 1024  # binary fractions: exact in every engine
        half = 2 * np.maximum(centre, 1 - centre)
        ranges = {1: np.stack([centre - half, centre + half])}
        for node in range(1, inner):
            low_high = ranges.pop(node)
            q = rng.integers(n_dims)
            cut = low_high[:, q].mean()
            dims[t, node], cuts[t, node] = q, cut
            left, right = low_high.copy(), low_high.copy()
            left[1, q] = right[0, q] = cut
            ranges[2 * node], ranges[2 * node + 1] = left, right
    return Forest(dims, cuts, height, window)


def device_features(
    total_bytes: Column, duration: Column, protocol: Column, timestamp: Column, packets: Column
) -> list[Column]:
    """The five features, clamped to their limits and scaled to 0..1."""
    limits = FEATURE_LIMITS
    return [
        (F.least(total_bytes.cast("double"), F.lit(limits["bytes"])) / F.lit(limits["bytes"])).alias("bytes"),
        (F.least(duration.cast("double"), F.lit(limits["duration"])) / F.lit(limits["duration"])).alias("duration"),
        (device_protocol_id(protocol) / F.lit(limits["proto_id"])).alias("proto_id"),
        (F.pmod(F.hour(timestamp), F.lit(24)).cast("double") / F.lit(limits["hour"])).alias("hour"),
        (F.least(packets.cast("double"), F.lit(limits["pkt_count"])) / F.lit(limits["pkt_count"])).alias("pkt_count"),
    ]


def leaf_bytes(forest: Forest):
    """Pandas function: five features to one byte per tree."""

    @F.pandas_udf(T.BinaryType())
    def leaves(a: pd.Series, b: pd.Series, c: pd.Series, d: pd.Series, e: pd.Series) -> pd.Series:
        x = np.column_stack([a, b, c, d, e]).astype(float)
        return pd.Series([row.tobytes() for row in forest.leaves(x)])

    return leaves


def unpack(leaves) -> np.ndarray:
    return np.stack([np.frombuffer(b, dtype=np.uint8) for b in leaves])


def device_anomaly(
    flows: DataFrame,
    *,
    trees: int = 25,
    height: int = 8,
    window: int = 20,
    threshold: float = THRESHOLD,
    seed: int = 42,
) -> DataFrame:
    """Score of every flow (columns id, timestamp, src_ip, total_bytes, duration, protocol,
    packet_count) against the device's previous ``window`` flows; the first block scores 0.

    A device's flows are numbered in parts of bounded size and cut into blocks of ``window``. A block goes
    out twice, as rows to score and as reference of the next block, so one shuffle by
    (device, block) brings together at most 2 x ``window`` rows, however busy the device is.
    """
    forest = build_forest(trees, height, window, seed)
    features = device_features(*[F.col(c) for c in ("total_bytes", "duration", "protocol", "timestamp", "packet_count")])
    marked = flows.select(
        "id", "timestamp", "src_ip", "total_bytes", "duration", "protocol", leaf_bytes(forest)(*features).alias("leaf")
    )
    numbered = running_totals(marked, ["src_ip"], ["timestamp", "id"], {"sample_no": F.lit(1)})
    block = F.floor((F.col("sample_no") - 1) / F.lit(window))
    row = F.struct("id", "timestamp", "total_bytes", "duration", "protocol", "sample_no", "leaf")
    blocks = (
        numbered.select("src_ip", "leaf", row.alias("row"), F.explode(F.array(block, -1 - block)).alias("part"))
        # part >= 0: rows of that block; part < 0: reference for block -part.
        .select(
            "src_ip",
            F.when(F.col("part") >= 0, F.col("part")).otherwise(-F.col("part")).alias("block"),
            F.when(F.col("part") >= 0, F.col("row")).alias("row"),
            F.when(F.col("part") < 0, F.col("leaf")).alias("reference"),
        )
        .groupBy("src_ip", "block")
        .agg(F.collect_list("row").alias("rows"), F.collect_list("reference").alias("reference"))
        .where(F.size("rows") > 0)
        .withColumn("leaves", F.col("rows.leaf"))
    )

    @F.pandas_udf("array<double>")
    def score(leaves: pd.Series, reference: pd.Series) -> pd.Series:
        return pd.Series(
            [
                forest.scores(unpack(rows), unpack(ref)) if len(ref) else np.zeros(len(rows))
                for rows, ref in zip(leaves, reference)
            ]
        )

    scored = blocks.select(
        "src_ip", F.explode(F.arrays_zip("rows", score("leaves", "reference").alias("score"))).alias("z")
    ).select("src_ip", "z.rows.*", F.col("z.score").alias("score"))
    return judge(scored, threshold, window)


def judge(scored: DataFrame, threshold: float = THRESHOLD, window: int = 20) -> DataFrame:
    """Anomaly flag, level and reason from the score."""
    odd = (F.col("sample_no") > window) & (F.col("score") >= threshold)
    reason = F.format_string(
        "Device %s showed anomalous flow behavior relative to its historical baseline (HST score: %.2f >= "
        f"threshold {threshold}). Payload: %dB, Protocol: %s, Duration: %.2fs.",
        F.col("src_ip"),
        round_places(F.col("score"), 2),
        F.col("total_bytes"),
        F.col("protocol"),
        round_places(F.col("duration").cast("double"), 2),
    )
    status = F.when(F.col("sample_no") <= window, "warming_up").when(odd, "anomalous").otherwise("normal")
    return scored.select(
        "id",
        "timestamp",
        "src_ip",
        "total_bytes",
        "duration",
        "protocol",
        "sample_no",
        "score",
        odd.alias("is_anomalous"),
        status.alias("status"),
        F.when(odd, verdicts.device_level(F.col("score"))).alias("threat_level"),
        F.when(odd, reason).alias("reason"),
    )


def device_events(scored: DataFrame) -> DataFrame:
    """Alert events of anomalous flows."""
    return scored.where("is_anomalous").select(
        "id",
        F.col("id").alias("log_id"),
        F.col("timestamp").alias("ts"),
        "threat_level",
        F.lit("device_behaviour").alias("alert_type"),
        F.col("src_ip").alias("device"),
        "src_ip",
        F.lit("Internal").alias("dest_ip"),
        "protocol",
        F.lit(False).alias("is_simulated"),
        F.lit("Device Behaviour Anomaly").alias("threat_type"),
        "reason",
        F.lit("Audit device connection history and inspect local host services.").alias("action"),
        F.lit(None).cast("string").alias("context"),
    )

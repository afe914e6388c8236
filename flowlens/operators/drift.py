"""Drift of an error stream: adaptive windowing (Bifet and Gavalda, SDM 2007) on time blocks.

The rows are summed per stream and block of time, a map-side aggregate. The test then sees one row
per block, so its input per stream grows with time and not with data.
"""

from __future__ import annotations

import math

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.values import iso_text, micros, round_places

DELTA = 0.002


def error_blocks(rows: DataFrame, key: str, ts: str, error: Column, block_us: int) -> DataFrame:
    """Errors and rows per stream and block of time."""
    return rows.groupBy(key, F.floor(micros(F.col(ts)) / F.lit(block_us)).alias("block")).agg(
        F.count(F.lit(1)).alias("n"), F.sum(error.cast("long")).alias("errors")
    )


class AdaptiveWindow:
    """Buckets ``[level, n, errors]``, oldest first; at most ``room`` buckets of a level."""

    def __init__(self, delta: float = DELTA, room: int = 5, least: int = 5, buckets: list | None = None):
        self.delta, self.room, self.least = delta, room, least
        self.buckets = buckets or []

    @property
    def size(self) -> int:
        return sum(b[1] for b in self.buckets)

    @property
    def errors(self) -> int:
        return sum(b[2] for b in self.buckets)

    def _cuts(self) -> bool:
        n, s = self.size, self.errors
        if n < 2 * self.least:
            return False
        mean = s / n
        spread, log = mean * (1 - mean), math.log(2 * math.log(n) / self.delta)
        n0 = s0 = 0
        for _, size, errors in self.buckets[:-1]:
            n0, s0 = n0 + size, s0 + errors
            n1, s1 = n - n0, s - s0
            if n0 < self.least or n1 < self.least:
                continue
            inverse = 1 / n0 + 1 / n1
            bound = math.sqrt(2 * inverse * spread * log) + 2 / 3 * inverse * log
            if abs(s0 / n0 - s1 / n1) > bound:
                return True
        return False

    def add(self, n: int, errors: int) -> bool:
        """Add a block; true if the window had to be shortened."""
        self.buckets.append([0, n, errors])
        level = 0
        while True:
            same = [i for i, b in enumerate(self.buckets) if b[0] == level]
            if len(same) <= self.room:
                break
            first, second = same[0], same[1]  # oldest two of the level are neighbours
            old, new = self.buckets[first], self.buckets.pop(second)
            self.buckets[first] = [level + 1, old[1] + new[1], old[2] + new[2]]
            level += 1
        drift = False
        while self._cuts():
            self.buckets.pop(0)
            drift = True
        return drift


def drift_points(
    rows: DataFrame, key: str, ts: str, error: Column, *, block_us: int = 300_000_000, delta: float = DELTA
) -> DataFrame:
    """One row per stream and block at which the window was cut, with the rolling accuracy."""
    blocks = error_blocks(rows, key, ts, error, block_us)
    key_type = blocks.schema[key].dataType.simpleString()

    def detect(pdf: pd.DataFrame) -> pd.DataFrame:
        window, seen, wrong, out = AdaptiveWindow(delta), 0, 0, []
        for block, n, errors in pdf.sort_values("block")[["block", "n", "errors"]].itertuples(index=False):
            seen, wrong = seen + int(n), wrong + int(errors)
            if window.add(int(n), int(errors)):
                out.append((pdf[key].iloc[0], block, seen, 1 - wrong / seen, window.size, window.errors / window.size))
        return pd.DataFrame(out, columns=[key, "block", "samples_processed", "accuracy", "width", "estimation"])

    found = blocks.groupBy(key).applyInPandas(
        detect,
        f"{key} {key_type}, block long, samples_processed long, accuracy double, width long, estimation double",
    )
    return found.select(
        key,
        F.timestamp_micros((F.col("block") + 1) * F.lit(block_us)).alias("timestamp"),
        "samples_processed",
        "accuracy",
        "width",
        "estimation",
        F.lit(True).alias("drift_detected"),
    )


def drift_history(metrics: DataFrame, n: int = 50) -> DataFrame:
    """The newest drift events as the report lists them."""
    order = [F.col("timestamp").desc()] + [F.col(c) for c in metrics.columns if c not in ("timestamp",)][:1]
    return (
        metrics.where("drift_detected")
        .orderBy(*order)
        .limit(n)
        .select(
            *[c for c in metrics.columns if c not in ("timestamp", "accuracy", "drift_detected")],
            F.substring(iso_text(F.col("timestamp")), 1, 19).alias("timestamp"),
            round_places(F.coalesce("accuracy", F.lit(0.0)), 4).alias("accuracy"),
            "drift_detected",
        )
    )

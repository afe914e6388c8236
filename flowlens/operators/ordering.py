"""Running totals and gap sessions that survive one key holding most of the rows.

A plain window puts all rows of a key into one task. Here the rows of a key are cut into parts first; only one
small row per part is ever ordered per key.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.values import micros
from ..session import shared_dir

HOUR = 3_600_000_000
DAY = 24 * HOUR


def in_parts(rows: DataFrame, keys: Sequence[str], order: Sequence[str], name: str) -> DataFrame:
    """The rows, stored once in the shared folder, with ``__part``: their place in a range partitioning by keys and order.

    Parts hold about equally many rows whatever the keys and times are, because the ranges are cut by sampled rows;
    the parts of a key follow each other in the order. Rows equal in keys and order stay in one part.
    """
    path = shared_dir(rows.sparkSession, name)
    ranged = rows.repartitionByRange(*[F.col(c) for c in (*keys, *order)]).withColumn("__part", F.spark_partition_id())
    ranged.write.parquet(path)
    return rows.sparkSession.read.schema(ranged.schema).parquet(path)


def same_keys(a: DataFrame, b: DataFrame, names: Sequence[str], how: str = "inner") -> DataFrame:
    """Join on columns of equal names, nulls being equal; the columns of ``a`` stay."""
    marked = b.withColumnsRenamed({n: f"__b_{n}" for n in names})
    rule = reduce(lambda x, y: x & y, [F.col(n).eqNullSafe(F.col(f"__b_{n}")) for n in names])
    return a.join(marked, rule, how).drop(*[f"__b_{n}" for n in names])


def running_totals(
    df: DataFrame,
    keys: Sequence[str],
    order: Sequence[str],
    totals: dict[str, Column],
    *,
    inclusive: bool = True,
) -> DataFrame:
    """Add, per key, the running sum of each expression in ``totals`` in the given order.

    The rows are stored in parts of bounded size (`in_parts`), so the input is read once. The sum over earlier parts
    comes from one row per (key, part); only rows of one part are sorted together. Null keys are keys.
    """
    columns = df.columns
    rows = in_parts(df.select("*", *[expr.cast("long").alias(f"__v_{n}") for n, expr in totals.items()]), keys, order, "totals")
    in_part = [*keys, "__part"]
    frame = Window.partitionBy(*in_part).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0 if inclusive else -1)
    per_part = rows.groupBy(*in_part).agg(*[F.sum(f"__v_{n}").alias(f"__s_{n}") for n in totals])
    before = Window.partitionBy(*keys).orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
    per_part = per_part.select(*in_part, *[F.coalesce(F.sum(f"__s_{n}").over(before), F.lit(0)).alias(f"__pre_{n}") for n in totals])
    rows = rows.select("*", *[F.coalesce(F.sum(f"__v_{n}").over(frame), F.lit(0)).alias(f"__in_{n}") for n in totals])
    return same_keys(rows, per_part, in_part).select(
        *columns,
        *[(F.col(f"__in_{n}") + F.col(f"__pre_{n}")).alias(n) for n in totals],
    )


def numbered(df: DataFrame, order: Sequence[str], name: str = "number") -> DataFrame:
    """Add a number from 0 without gaps, in the given order. The rows are stored, so their numbers stay when a task is redone.

    The ranges of the order are cut by sampled rows, so the input is held until it is stored: it is worked out once.
    """
    path = shared_dir(df.sparkSession, "numbered")
    df.persist()
    try:
        ranged = df.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("__place", F.monotonically_increasing_id())
        ranged.write.parquet(path)
    finally:
        df.unpersist()
    return dense_places(df.sparkSession.read.schema(ranged.schema).parquet(path), "__place", name).drop("__place")


def dense_places(df: DataFrame, place: str, name: str = "number") -> DataFrame:
    """Add a number from 0 made of ``place``, the part and the row in it (33 bits) of a read: parts follow each other.

    Only ``place`` is read for the sizes of the parts. There is one row per part of a read, so these are broadcast.
    """
    part, row = F.shiftrightunsigned(place, 33), F.col(place).bitwiseAND(F.lit((1 << 33) - 1))
    sizes = df.groupBy(part.alias("__read")).agg((F.max(row) + 1).alias("__size"))
    earlier = Window.partitionBy(F.lit(0)).orderBy("__read").rowsBetween(Window.unboundedPreceding, -1)
    firsts = sizes.select("__read", F.coalesce(F.sum("__size").over(earlier), F.lit(0)).alias("__first"))
    joined = df.withColumn("__read", part).join(F.broadcast(firsts), "__read", "left")
    return joined.withColumn(name, F.col("__first") + row).drop("__read", "__first")


def gap_sessions(
    df: DataFrame,
    keys: Sequence[str],
    ts: str,
    gap_us: int,
    measures: dict[str, tuple[Column, object]],
    *,
    chunk_cells: int = 4096,
) -> DataFrame:
    """One row per key and session; a gap ``>= gap_us`` between neighbours starts a new session.

    ``measures`` maps a name to (aggregate over raw rows, function of a name that merges partial
    values). Every measure has to be mergeable.

    1. Rows closer than the gap always share a session, so a time cell as wide as the gap collapses
       to one row. That is a plain hash aggregate with map-side combine: a hot key shrinks before
       the shuffle.
    2. Cells are strung together per (key, chunk of cells).
    3. Only the first and the last run of a chunk can go on in another chunk; those few rows are
       strung together per key, the others only per chunk.
    """
    us = micros(F.col(ts))
    names = list(measures)
    cells = (
        df.select("*", us.alias("__us"), F.floor(us / F.lit(gap_us)).alias("__cell"))
        .groupBy(*keys, "__cell")
        .agg(
            F.min("__us").alias("__first"),
            F.max("__us").alias("__last"),
            *[agg.alias(n) for n, (agg, _) in measures.items()],
        )
        .withColumn("__chunk", F.floor(F.col("__cell") / F.lit(chunk_cells)))
    )

    def string_together(parts: DataFrame, by: list[str]) -> DataFrame:
        w = Window.partitionBy(*by).orderBy("__first")
        opens = F.col("__first") - F.lag("__last").over(w) >= F.lit(gap_us)
        parts = parts.withColumn("__opens", F.coalesce(opens, F.lit(True)).cast("long"))
        return parts.withColumn("__run", F.sum("__opens").over(w))

    def merge(parts: DataFrame, by: list[str]) -> DataFrame:
        return parts.groupBy(*by, "__run").agg(
            F.min("__first").alias("__first"),
            F.max("__last").alias("__last"),
            *[again(n).alias(n) for n, (_, again) in measures.items()],
        )

    in_chunk = [*keys, "__chunk"]
    runs = merge(string_together(cells, in_chunk), in_chunk)
    last_run = F.max("__run").over(Window.partitionBy(*in_chunk))
    edge = (F.col("__run") == 1) | (F.col("__run") == last_run)
    # Edges of all chunks of a key meet in the null slot; inner runs stay among those of their chunk, where
    # they are a gap apart from each other and pass unchanged.
    shape = [*keys, "__first", "__last", *names]
    runs = runs.select(*shape, F.when(~edge, F.col("__chunk")).alias("__slot"))
    in_slot = [*keys, "__slot"]
    return merge(string_together(runs, in_slot), in_slot).select(*shape)

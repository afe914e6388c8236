"""Running streams to tables."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

from ..session import shared_dir
from ..sinks.tables import write_epoch


def to_folder(stream: DataFrame, out: str, checkpoint: str, available_now: bool = True, mode: str = "append", **trigger):
    """Write each micro-batch of a stream to a folder, one partition per epoch."""
    trigger = trigger or ({"availableNow": True} if available_now else {})
    writer = stream.writeStream.outputMode(mode).option("checkpointLocation", checkpoint)
    return writer.trigger(**trigger).foreachBatch(lambda df, epoch: write_epoch(df, out, epoch)).start()


@contextmanager
def state_partitions(spark: SparkSession, partitions: int | None) -> Iterator[None]:
    """Streams started inside have this many state stores (None: as the session says).

    Spark fixes the number of state partitions when a stream first starts.
    """
    key = "spark.sql.shuffle.partitions"
    before = spark.conf.get(key)
    if partitions is not None:
        spark.conf.set(key, str(partitions))
    try:
        yield
    finally:
        spark.conf.set(key, before)


def drain(spark: SparkSession, stream: DataFrame, name: str, partitions: int | None = None) -> DataFrame:
    """Run a stream over everything that is there now; its output as a table in the shared folder."""
    out = shared_dir(spark, name)
    with state_partitions(spark, partitions):
        to_folder(stream, f"{out}/data", f"{out}/checkpoint").awaitTermination()
    return spark.read.schema(stream.schema).option("recursiveFileLookup", True).parquet(f"{out}/data")


def late_rows(running: StreamingQuery) -> list[tuple[int, int]]:
    """Epochs of a stream in which rows came later than the watermark allows, and how many were dropped in each.

    Covers what Spark remembers of a running stream (``spark.sql.streaming.numRecentProgressUpdates`` epochs). Rows that are
    summed up before the state, as packets of a flow are, count as one.
    """
    found = []
    for progress in running.recentProgress:
        dropped = sum(op["numRowsDroppedByWatermark"] for op in progress["stateOperators"])
        if dropped:
            found.append((progress["batchId"], dropped))
    return found


def for_each_epoch(stream: DataFrame, checkpoint: str, work: Callable[[DataFrame, int], None], **trigger):
    return (
        stream.writeStream.outputMode("append")
        .option("checkpointLocation", checkpoint)
        .trigger(**(trigger or {"availableNow": True}))
        .foreachBatch(work)
        .start()
    )

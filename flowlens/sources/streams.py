"""Streams: packets arriving as files, and stored flows played back."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..schemas import PACKETS


def stream_table(
    spark: SparkSession, path: str, schema: T.StructType, glob: str | None = None, files_per_trigger: int | None = None
) -> DataFrame:
    """Parquet files of a folder as a stream."""
    reader = spark.readStream.schema(schema)
    if glob:
        reader = reader.option("pathGlobFilter", glob)
    if files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", files_per_trigger)
    return reader.parquet(path)


def stream_packets(spark: SparkSession, path: str, files_per_trigger: int | None = None) -> DataFrame:
    """Packet files written by capture jobs."""
    return stream_table(spark, path, PACKETS, files_per_trigger=files_per_trigger)


def replay(spark: SparkSession, path: str, name: str, schema: T.StructType | None = None, files_per_trigger: int | None = 1) -> DataFrame:
    """Stored flows as a stream, tagged ``replay:<name>``.

    The pace is the trigger's: ``processingTime`` for a steady one, ``availableNow`` for as fast as
    possible (``files_per_trigger=None`` takes all files at once).
    """
    schema = schema or spark.read.parquet(path).schema
    return stream_table(spark, path, schema, files_per_trigger=files_per_trigger).withColumn(
        "source", F.lit(f"replay:{name}")
    )

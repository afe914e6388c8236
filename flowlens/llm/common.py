"""Helpers shared by the operators: stored steps, distributed prefix sums, connected components."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import prepare, shared_dir

WHITE = r"[\x20\x09-\x0D]+"
#: Ranges of a hash key per shuffle partition, so that one hot key is spread evenly, and the most there may be.
RANGES_PER_PARTITION, MOST_RANGES = 4, 4096


def ready(spark: SparkSession) -> SparkSession:
    """Session settings. Arrow batches are bounded by bytes for all queries alike, because a row may hold a whole text."""
    return prepare(spark)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def stored(df: DataFrame, name: str) -> DataFrame:
    """Write a step to the shared folder and read it again: lost executors then cost no earlier step."""
    path = shared_dir(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def words(text: Column) -> Column:
    """Words of a text: stretches without ASCII white space."""
    return F.filter(F.split(F.coalesce(text, F.lit("")), WHITE), lambda w: w != "")


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is computed once, however often the body names it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def ranges(spark: SparkSession) -> int:
    return min(MOST_RANGES, RANGES_PER_PARTITION * partitions(spark))


def range_of(hex_key: str, count: int) -> Column:
    """Which of ``count`` equal ranges a hexadecimal hash falls in; keeps the order of the hashes."""
    return F.expr(f"cast((cast(conv(substring({hex_key}, 1, 8), 16, 10) as bigint) * {count}) div 4294967296 as int)")


def range_starts(rows: DataFrame, keys: list[str], hex_key: str, value: str, count: int) -> DataFrame:
    """Per key: ``parts``, its non-empty hash ranges in order with the sum of ``value`` in all earlier ranges, and
    ``total``. Rows are summed before each shuffle, so a key with a third of all rows sends ``count`` sums."""
    sums = rows.groupBy(*keys, range_of(hex_key, count).alias("_range")).agg(F.sum(value).alias("_sum"))
    parts = sums.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("_range", "_sum"))).alias("_parts"))
    start = (
        "transform(sequence(1, size(_parts)), i -> named_struct('_range', _parts[i - 1]._range, '_start',"
        " aggregate(slice(_parts, 1, i - 1), 0L, (a, p) -> a + p._sum)))"
    )
    total = "aggregate(_parts, 0L, (a, p) -> a + p._sum)"
    return parts.select(*keys, F.expr(start).alias("parts"), F.expr(total).alias("total"))


def prefix_sums(rows: DataFrame, starts: DataFrame, keys: list[str], hex_key: str, ties: list[str], value: str, count: int) -> DataFrame:
    """Add ``before``: the sum of ``value`` over the rows of the same keys with a smaller (hash, ties).

    ``starts`` comes from `range_starts` (columns joined to it per key are passed on). Only one hash range of
    a key is sorted at a time. Rows equal in hash and ties stand in any order, so they must be interchangeable.
    """
    offsets = starts.select(*[c for c in starts.columns if c != "parts"], F.inline("parts"))
    on = [*keys, "_range"]
    joined = rows.withColumn("_range", range_of(hex_key, count)).join(offsets, on)
    over = "partition by {} order by {} rows between unbounded preceding and current row".format(", ".join(on), ", ".join([hex_key, *ties]))
    before = F.expr(f"_start + sum({value}) over ({over}) - {value}")
    return joined.withColumn("before", before).drop("_range", "_start")


def components(edges: DataFrame, name: str) -> DataFrame:
    """Connected components of ``edges`` (a, b longs): node, component (smallest node).

    Alternating large-star and small-star steps; each step is stored in the shared folder. A hub's rows are
    reduced to a minimum before the shuffle. Loops and repeated edges do no harm; no edges, no rows.
    """
    pairs = edges.select("a", "b").where("a <> b")
    pairs = stored(pairs.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), name)
    while True:
        both = pairs.union(pairs.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
        # Large star: the larger neighbours of a node move to its smallest neighbour.
        large = both.where("b > a").join(low, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b")
        # Small star: the smaller neighbours, and the node, move to the smallest of them.
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(least, "a").where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
        pairs = stored(small.union(least.select("a", F.col("m").alias("b"))).distinct(), name)
        # Done when the pairs are stars: every child has one parent, and no parent is a child.
        ends = pairs.select("a", F.lit(1).alias("child"), F.lit(0).alias("parent"))
        ends = ends.union(pairs.select("b", F.lit(0), F.lit(1))).groupBy("a").agg(F.sum("child").alias("c"), F.max("parent").alias("p"))
        if not ends.where("c > 1 or c = 1 and p = 1").limit(1).count():
            break
    roots = pairs.select(F.col("b").alias("node")).distinct().withColumn("component", F.col("node"))
    return pairs.select(F.col("a").alias("node"), F.col("b").alias("component")).union(roots)

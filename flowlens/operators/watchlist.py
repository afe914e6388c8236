"""Watchlist matching: addresses by equality, domains anywhere inside the info text."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

def address_entries(watchlist: DataFrame) -> DataFrame:
    """One entry per address; of repeated values the last one counts."""
    return (
        watchlist.where(F.col("entry_type").isin("ipv4", "ipv6"))
        .groupBy(F.col("value").alias("key"))
        .agg(F.max("id").alias("entry_id"))
    )


def domain_entries(watchlist: DataFrame) -> DataFrame:
    """One entry per lower-cased domain: place in the list of the first, entry of the last."""
    return (
        watchlist.where(F.col("entry_type").isin("domain", "hostname") & (F.col("value") != ""))
        .groupBy(F.lower("value").alias("key"))
        .agg(F.min("id").alias("place"), F.max("id").alias("entry_id"))
    )


def text_hits(texts: DataFrame, column: str, entries: DataFrame) -> DataFrame:
    """``(column, entry_id)``: for each text the first entry whose key occurs in it.

    Substring search as two equality joins. Every stretch of the text as long as the shortest key is looked up among the
    beginnings of the keys; only where one begins, the stretches of the other key lengths are looked up among the keys.
    A key equals at most one entry, so a text yields no more rows than it has matches, whatever the list looks like.
    """
    sizes = entries.agg(F.array_sort(F.collect_set(F.length("key")))).scalar()  # distinct sizes only
    least = entries.agg(F.min(F.length("key"))).scalar()
    low = F.lower(F.col(column))
    last = F.length("__low") - F.col("__least") + 1
    starts = F.when(last >= 1, F.sequence(F.lit(1), last)).otherwise(F.array().cast("array<int>"))
    placed = texts.select(column, low.alias("__low"), least.alias("__least")).withColumn("__at", F.explode(starts))
    placed = placed.withColumn("__begin", F.substring("__low", F.col("__at"), F.col("__least")))
    begins = entries.select(F.substring("key", F.lit(1), least).alias("__begin")).distinct()
    hits = placed.select(column, "__at", "__begin").join(begins, "__begin", "left_semi").select(column, "__at", sizes.alias("__sizes"))
    parts = F.transform("__sizes", lambda n: F.substring(low, F.col("__at"), n))
    lookups = hits.select(column, F.explode(F.array_distinct(parts)).alias("key"))
    return (
        lookups.join(entries, "key")
        .groupBy(column)
        .agg(F.min(F.struct("place", "entry_id")).alias("hit"))
        .select(column, F.col("hit.entry_id").alias("entry_id"))
    )


def match_watchlist(flows: DataFrame, watchlist: DataFrame) -> DataFrame:
    """Flows with ``watch_id`` and ``watch_side`` (src, dest, info), null if nothing matches.

    The source address goes before the destination, addresses before domains; of several domains
    the first of the list counts.
    """
    ips = address_entries(watchlist)
    by_src = ips.select(F.col("key").alias("src_ip"), F.col("entry_id").alias("__src"))
    by_dest = ips.select(F.col("key").alias("dest_ip"), F.col("entry_id").alias("__dest"))
    joined = flows.join(by_src, "src_ip", "left").join(by_dest, "dest_ip", "left")

    # Each distinct text is searched once, however many flows carry it.
    texts = flows.where(F.col("info") != "").select("info").distinct()
    by_info = text_hits(texts, "info", domain_entries(watchlist))
    # Flows without a text must not meet in one task: spread them over keys that match nothing.
    spread = F.concat(F.lit("\u0000"), F.pmod(F.xxhash64("src_ip", "dest_ip", "timestamp"), F.lit(4096)).cast("string"))
    joined = joined.withColumn("__text", F.coalesce(F.nullif(F.col("info"), F.lit("")), spread))
    joined = joined.join(
        by_info.select(F.col("info").alias("__text"), F.col("entry_id").alias("__info")), "__text", "left"
    )
    side = (
        F.when(F.col("__src").isNotNull(), "src")
        .when(F.col("__dest").isNotNull(), "dest")
        .when(F.col("__info").isNotNull(), "info")
    )
    return joined.select(
        *flows.columns,
        F.coalesce("__src", "__dest", "__info").alias("watch_id"),
        side.alias("watch_side"),
    )


def attach_entry(matched: DataFrame, watchlist: DataFrame) -> DataFrame:
    """Value and label of the matched entry."""
    entries = watchlist.select(
        F.col("id").alias("__id"), F.col("value").alias("watch_value"), F.col("label").alias("watch_label")
    )
    # Rows without a hit get distinct negative keys, so they do not pile up on the null key.
    key = F.coalesce("watch_id", -1 - F.pmod(F.xxhash64("src_ip", "dest_ip", "timestamp"), F.lit(4096)))
    return (
        matched.withColumn("__key", key)
        .join(entries, F.col("__key") == F.col("__id"), "left")
        .drop("__key", "__id")
    )


def new_indicators(feed: DataFrame, watchlist: DataFrame | None = None) -> DataFrame:
    """Feed values that are not on the watchlist yet (if there is one), each once, first line kept."""
    once = feed.groupBy("value").agg(F.min(F.struct("line", "entry_type")).alias("first"))
    once = once.select("value", F.col("first.entry_type").alias("entry_type"), F.col("first.line").alias("line"))
    return once if watchlist is None else once.join(watchlist.select("value"), "value", "left_anti")


def watchlist_rows(new: DataFrame, feed_name: str, as_of: Column, label: str = "Imported Threat Feed") -> DataFrame:
    """Watchlist rows for new indicators; the id is a hash of the value, no counter needed."""
    return new.select(
        F.abs(F.xxhash64("value")).alias("id"),
        "value",
        "entry_type",
        F.lit(label).alias("label"),
        F.concat(F.lit(f"Imported from {feed_name} (line "), F.col("line").cast("string"), F.lit(")")).alias("description"),
        F.lit(f"txt_import:{feed_name}").alias("source"),
        F.lit(None).cast("long").alias("import_batch_id"),
        as_of.alias("created_at"),
    )


def newest_first(watchlist: DataFrame) -> DataFrame:
    return watchlist.orderBy(F.col("created_at").desc(), F.col("id").desc())

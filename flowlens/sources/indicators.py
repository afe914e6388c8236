"""Addresses and domains in threat-feed text."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.values import IPV4, strip

# What counts as an address and as a domain. (?U): word borders know all letters.
IPV4_TEXT = r"(?U)\b(?:[0-9]{1,3}\.){3}[0-9]{1,3}\b"
DOMAIN_TEXT = r"(?U)\b(?:[a-zA-Z0-9](?:[a-zA-Z0-9\-]{0,61}[a-zA-Z0-9])?\.)+[a-zA-Z]{2,}\b"


def indicators_of_lines(lines: DataFrame) -> DataFrame:
    """``(value, entry_type, feed, line)`` of feed lines ``(feed, line, text)``.

    Comment lines are skipped; each value counts once, at its first line.
    """
    text = strip(F.col("text"))
    lines = lines.select("feed", "line", text.alias("text")).where(
        # Every indicator has a dot between two letters or digits; this check is far cheaper.
        F.col("text").rlike(r"[a-zA-Z0-9]\.[a-zA-Z0-9]") & ~F.col("text").startswith("#")
    )

    def found(pattern: str, kind: str):
        values = F.regexp_extract_all("text", F.lit(pattern), F.lit(0))
        return F.transform(values, lambda v: F.struct(v.alias("value"), F.lit(kind).alias("entry_type")))

    hits = lines.select("feed", "line", F.inline(F.concat(found(IPV4_TEXT, "ipv4"), found(DOMAIN_TEXT, "domain"))))
    # A domain that begins with something like an address is left out, an address must be a real one.
    domain = ~F.col("value").rlike(f"^{IPV4_TEXT}")
    hits = hits.where(F.when(F.col("entry_type") == "domain", domain).otherwise(F.col("value").rlike(f"^{IPV4}$")))
    first = hits.groupBy("value").agg(F.min(F.struct("feed", "line", "entry_type")).alias("at"))
    return first.select("value", "at.entry_type", "at.feed", "at.line")


def extract_indicators(texts: DataFrame) -> DataFrame:
    """Indicators of whole texts ``(feed, text)``; lines are numbered from 1."""
    lines = texts.select("feed", F.posexplode(F.split("text", r"\r\n|\r|\n")).alias("at", "text"))
    return indicators_of_lines(lines.select("feed", (F.col("at") + 1).alias("line"), "text"))


def read_indicators(spark: SparkSession, path: str) -> DataFrame:
    """Indicators of feed files. A feed is read whole, one file per row, so its lines can be numbered."""
    files = spark.read.text(path, wholetext=True)
    return extract_indicators(files.select(F.input_file_name().alias("feed"), F.col("value").alias("text")))

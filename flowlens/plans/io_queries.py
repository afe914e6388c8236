"""Registered queries: feeds, format detection, hashes, replay, payload names and the care of stored tables."""

from __future__ import annotations

import datetime
import uuid

from pyspark.sql import functions as F

from .. import adapters as A
from ..functions import payloads
from ..functions.values import iso_text
from ..session import shared_dir
from ..sinks import tables
from ..sources import files, indicators, streams
from ..streaming.run import drain
from . import pipeline_queries as P
from .oracle_views import iso, with_views
from .registry import as_of, query

W = with_views

#: Records per file that is written.
FILE_RECORDS = 250_000


@query("read_feeds", f"WITH {P._IOC} SELECT value, entry_type FROM feed")
def read_feeds(spark, sf):
    """Feed files made of the documents."""
    path = shared_dir(spark, "feeds")
    docs = A.table(spark, sf, "documents").select((F.col("doc_id") % 16).alias("part"), "text")
    docs.repartition("part").write.partitionBy("part").text(path)
    return indicators.read_indicators(spark, path).select("value", "entry_type")


@query(
    "feed_to_watchlist",
    f"WITH {P._IOC} SELECT value, entry_type, 'txt_import:documents' AS source, {iso("TIMESTAMP '2024-01-31 00:00:00'")} AS created_at FROM feed",
)
def feed_to_watchlist(spark, sf):
    """The documents' indicators added to a new watchlist, twice: the second time nothing is new."""
    name = f"feed_{uuid.uuid4().hex[:8]}"
    found = P._indicators(spark, sf)
    for _ in range(2):
        tables.add_to_watchlist(found, "documents", as_of(), name=name)
    return spark.table(name).select("value", "entry_type", "source", iso_text(F.col("created_at")).alias("created_at"))


@query(
    "detect_formats",
    """WITH n AS (SELECT count(*) AS n FROM events) SELECT kind, format, n > 0 AS found FROM n,
  (VALUES ('a', 'jsonl'), ('b', 'csv'), ('c', 'zeek'), ('d', 'eve'), ('e', 'txt_ioc'), ('f', 'json')) v(kind, format)""",
)
def detect_formats(spark, sf):
    """Files of six kinds made of the raw records, told apart by name or content."""
    path = shared_dir(spark, "formats")
    records = A.raw_records(spark, sf)
    count = max(2, records.count() // FILE_RECORDS)
    raw = records.drop("row_id").repartition(count)
    raw.write.json(f"{path}/a")
    raw.write.csv(f"{path}/b", header=True)
    part = F.pmod(F.xxhash64("row_id"), F.lit(2 * count)).alias("part")
    lines = records.select(part, F.lit(1).alias("kind"), F.concat_ws("\t", "`Source IP`", "`Destination IP`", "sport").alias("value"))
    heads = lines.select("part", F.lit(0).alias("kind"), F.lit("#fields\tid.orig_h\tid.resp_h\tid.orig_p").alias("value")).distinct()
    lines = lines.union(heads).repartition("part").sortWithinPartitions("part", "kind")
    lines.select("part", "value").write.partitionBy("part").text(f"{path}/c")
    event = F.struct(F.lit("flow").alias("event_type"), F.col("Source IP").alias("src_ip"), F.struct("sbytes").alias("flow"))
    raw.select(F.to_json(event)).write.text(f"{path}/d")
    raw.select("Source IP").write.text(f"{path}/e")
    raw.agg(F.count("*").alias("n")).select(F.to_json(F.struct(F.lit("list").alias("kind"), "n"))).write.text(f"{path}/f")
    found = None
    for kind in "abcdef":
        part = files.detect_formats(spark, f"{path}/{kind}").select(F.lit(kind).alias("kind"), "format", F.lit(True).alias("found"))
        found = part if found is None else found.union(part)
    return found.distinct()


_FILES = """lines AS (SELECT event_id % 8 AS part, event_id, event_type || ' ' || user_id AS line FROM events),
  hashed AS (SELECT part, sha256(string_agg(line, chr(10) ORDER BY event_id) || chr(10)) AS file_hash,
    CAST(sum(strlen(line) + 1) AS BIGINT) AS length FROM lines GROUP BY part)"""


def _hashed(spark, sf):
    path = shared_dir(spark, "hashes")
    lines = A.table(spark, sf, "events").select((F.col("event_id") % 8).alias("part"), "event_id", F.concat_ws(" ", "event_type", "user_id").alias("value"))
    ordered = lines.repartition("part").sortWithinPartitions("part", "event_id")
    ordered.select("part", "value").write.partitionBy("part").text(path)
    found = files.file_hashes(spark, path)
    return found.withColumn("part", F.regexp_extract("path", "part=([0-9]+)/", 1).cast("long"))


@query("file_hashes", f"WITH {_FILES} SELECT part, length, file_hash FROM hashed")
def file_hashes(spark, sf):
    """Files of a known content and their hashes."""
    return _hashed(spark, sf).select("part", "length", "file_hash")


@query("known_files", f"WITH {_FILES} SELECT part, file_hash, 100 + part AS batch_id FROM hashed WHERE part % 2 = 0")
def known_files(spark, sf):
    """Files that earlier batches had: those of even number, in two batches each."""
    hashes = _hashed(spark, sf)
    even = hashes.where("part % 2 = 0")
    batches = even.select((F.col("part") + 100).alias("id"), "file_hash").union(even.select((F.col("part") + 200).alias("id"), "file_hash"))
    return files.known_files(hashes, batches).select("part", "file_hash", "batch_id")


@query("stream_replay", W("logs") + "SELECT id, src_ip, total_bytes, 'replay:office' AS source FROM logs")
def stream_replay(spark, sf):
    """Stored flows played back as a stream, under a source of their own."""
    path = shared_dir(spark, "replay")
    A.logs(spark, sf).write.parquet(path)
    out = drain(spark, streams.replay(spark, path, "office"), "replayed", spark.sparkContext.defaultParallelism)
    return out.select("id", "src_ip", "total_bytes", "source")


@query(
    "pruned_tables",
    W("logs") + f"""SELECT coalesce(import_batch_id, 0) AS import_batch_id, count(*) AS n, {iso("min(timestamp)")} AS first
FROM logs WHERE coalesce(import_batch_id, 0) <> 2 AND timestamp >= TIMESTAMP '2024-01-10 00:00:00' GROUP BY 1""",
)
def pruned_tables(spark, sf):
    """Stored logs after one batch was deleted and the days before the tenth were purged."""
    store = tables.Tables().prefixed(f"pruned_{uuid.uuid4().hex[:8]}_")
    tables.append_logs(A.logs(spark, sf), store.logs)
    tables.delete_batch(spark, 2, store.logs, store.alerts, store.watchlist, store.batches)
    tables.purge_before(spark, datetime.date(2024, 1, 10), store.logs)
    left = spark.table(store.logs).groupBy("import_batch_id").agg(F.count("*").alias("n"), F.min("timestamp").alias("first"))
    return left.select("import_batch_id", "n", iso_text(F.col("first")).alias("first"))


@query(
    "names_in_payloads",
    """WITH h AS (SELECT page_id, regexp_extract(url, '^[a-z]+://([^/?#]+)', 1) AS host FROM pages)
SELECT page_id, CASE WHEN page_id % 2 = 0 THEN 'DNS' ELSE 'HTTPS' END AS protocol_l7,
  CASE WHEN page_id % 2 = 0 THEN 'DNS Query: ' ELSE 'HTTPS/TLS SNI: ' END || host AS info FROM h""",
)
def names_in_payloads(spark, sf):
    """Hosts of the pages as DNS questions and TLS hellos, read back from the bytes."""
    host = F.regexp_extract("url", "^[a-z]+://([^/?#]+)", 1)
    size = lambda n, places: F.lpad(F.hex(n), 2 * places, "0")
    labels = F.transform(F.split(host, r"\."), lambda x: F.concat(size(F.octet_length(x), 1), F.hex(x)))
    question = F.concat(F.lit("123401000001000000000000"), F.array_join(labels, ""), F.lit("0000010001"))
    n = F.octet_length(host)
    name = F.concat(F.lit("0000"), size(n + 5, 2), size(n + 3, 2), F.lit("00"), size(n, 2), F.hex(host))
    body = F.concat(F.lit("0303" + "00" * 32 + "00" + "0002" + "1301" + "01" + "00"), size(n + 9, 2), name)
    length = F.length(body) / 2
    hello = F.concat(F.lit("160301"), size((length + 4).cast("long"), 2), F.lit("01"), size(length.cast("long"), 3), body)
    dns = F.col("page_id") % 2 == 0
    packets = A.table(spark, sf, "pages").select("page_id", F.unhex(F.when(dns, question).otherwise(hello)).alias("payload"))
    protocol, port = F.when(dns, "UDP").otherwise("TCP"), F.when(dns, 53).otherwise(443)
    l7 = payloads.application(protocol, F.lit(40000), port, F.col("payload"))
    return packets.select("page_id", l7.alias("l7")).select("page_id", "l7.*")

"""Foreign log files as DataFrames of string columns: CSV, JSON, JSON lines, Zeek, Suricata EVE.

The driver looks at names only (headers, keys); the rows stay in Spark.
"""

from __future__ import annotations

import re
from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.values import strip
from ..operators.normalize import auto_mapping, normalize
from ..schemas import CAPTURE_MAGIC, JSON_RECORD_KEYS
from . import csv_ranges, ranges

ROW_ID = "__row_id"  # place in the read order; grows with file and line, stable when a task is redone


def _numbered(df: DataFrame) -> DataFrame:
    return df.withColumn(ROW_ID, F.monotonically_increasing_id())


# --- format detection ---------------------------------------------------------------------------


def _by_name(name: Column) -> Column:
    """Format of files whose name decides."""
    return (
        F.when(name.rlike(r"\.(pcap|pcapng|cap)$"), "pcap")
        .when(name.rlike(r"\.(jsonl|ndjson)$"), "jsonl")
        .when(name.endswith(".csv"), "csv")
    )


def _by_content(name: Column, head: Column) -> Column:
    """Format of the others: first bytes, then weaker endings."""
    text = strip(F.decode(head, "ISO-8859-1"))
    lines = F.split(text, "\n")
    first, second = strip(lines[0]), strip(F.get(lines, F.lit(1)))
    quoted = text.contains('"flow"') | text.contains('"alert"') | text.contains('"dns"')
    object_lines = first.startswith("{") & first.endswith("}") & F.coalesce(second.startswith("{"), F.lit(False))
    return (
        F.when(F.hex(F.substring(head, 1, 4)).isin(*CAPTURE_MAGIC), "pcap")
        .when(text.startswith("#separator") | text.startswith("#fields"), "zeek")
        .when(text.contains("event_type") & quoted, "eve")
        .when(text.rlike(r"^[{\[]"), F.when(object_lines, "jsonl").otherwise("json"))
        .when(name.rlike(r"\.(txt|ioc|list)$"), "txt_ioc")
        .when(name.endswith(".json"), "json")
        .when(name.rlike(r"\.(tsv|log)$"), "zeek")
        .otherwise("csv")
    )


def detect_formats(spark: SparkSession, path: str) -> DataFrame:
    """``(path, length, format)`` per file. Only files whose name does not decide are opened, for their first 1024 bytes.

    Spark lists no empty files.
    """
    files = ranges.listed(spark, path)
    name = F.lower("path")
    named = files.select("path", "length", _by_name(name).alias("format")).where(F.col("format").isNotNull())
    others = files.where(_by_name(name).isNull())
    if ranges.can_open(files):
        opened = ranges.heads(others, 1024)
    else:
        whole = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path)
        opened = whole.where(_by_name(name).isNull()).withColumn("head", F.substring("content", 1, 1024))
    return named.unionByName(opened.select("path", "length", _by_content(name, F.col("head")).alias("format")))


def detect_format(spark: SparkSession, path: str) -> str:
    """The one format of the file (or of all files below a folder)."""
    found = [row.format for row in detect_formats(spark, path).select("format").distinct().collect()]
    if len(found) != 1:
        raise ValueError(f"{path}: expected files of one format, found {sorted(found)}")
    return found[0]


def file_hashes(spark: SparkSession, path: str) -> DataFrame:
    """SHA-256 per file of any size, to find files that were imported before."""
    files = ranges.listed(spark, path)
    if ranges.can_open(files):
        return ranges.hashes(files)
    whole = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path)
    return whole.select("path", "length", F.sha2("content", 256).alias("file_hash"))


def known_files(hashes: DataFrame, batches: DataFrame) -> DataFrame:
    """Files whose hash an earlier batch has, with the first such batch. Reports, does not block."""
    first = batches.groupBy("file_hash").agg(F.min("id").alias("batch_id"))
    return hashes.join(first, "file_hash")


# --- readers ------------------------------------------------------------------------------------


def delimiter(first_line: str) -> str:
    """``;`` or tab if the first line has more of them than commas."""
    for mark in (";", "\t"):
        if first_line.count(mark) > first_line.count(","):
            return mark
    return ","


def read_csv(
    spark: SparkSession, path: str | Sequence[str], sep: str | None = None, multiline: bool = True, size: int = csv_ranges.RANGE
) -> DataFrame:
    """CSV files of one layout, all columns strings, header names trimmed, nameless columns dropped.

    A quoted cell may hold line breaks; large files are read in ranges of ``size`` bytes all the same. ``multiline=False``
    leaves the splitting to Spark; it is only right for files without such cells.
    """
    paths = [path] if isinstance(path, str) else list(path)
    if sep is None:
        first = spark.read.text(paths).head(1)
        sep = delimiter(first[0].value) if first else ","
    if multiline and ranges.can_open(ranges.listed(spark, paths)):
        cells = csv_ranges.read(spark, paths, sep, ROW_ID, size)
        names = [c for c in cells.columns if c != ROW_ID]
        return cells.select(*[F.coalesce(F.col(f"`{c}`"), F.lit("")).alias(c.strip()) for c in names], ROW_ID)
    df = spark.read.csv(
        paths, header=True, sep=sep, quote='"', escape='"', inferSchema=False, enforceSchema=False, multiLine=multiline
    )
    # Spark reads an empty cell as null; to the rules it is an empty text.
    named = [F.coalesce(F.col(f"`{c}`"), F.lit("")).alias(c.strip()) for c in df.columns if c.strip() and not re.fullmatch(r"_c\d+", c)]
    return _numbered(df.select(*named))


def json_rows(lines: DataFrame, value: str = "value", keys: Sequence[str] | None = None) -> DataFrame:
    """JSON objects in a text column as string columns, one per key; everything else is skipped."""
    names = F.json_object_keys(value)
    objects = lines.where(names.isNotNull())
    if keys is None:
        # Distinct keys only: the same few names a schema inference would bring.
        keys = sorted(r.k for r in objects.select(F.explode(names).alias("k")).distinct().collect())
    schema = T.StructType([T.StructField(k, T.StringType()) for k in keys])
    others = [c for c in lines.columns if c != value]
    return objects.select(*others, F.from_json(value, schema).alias("__r")).select(*others, "__r.*")


def read_jsonl(spark: SparkSession, path: str | Sequence[str], keys: Sequence[str] | None = None) -> DataFrame:
    """One JSON object per line. Malformed lines and lines that are no object are skipped."""
    return json_rows(_numbered(spark.read.text(path)), keys=keys)


def document_records(docs: DataFrame, value: str = "value") -> DataFrame:
    """Records of JSON documents as JSON text: the list itself, the first list under a known key, or
    the document as one record."""
    listed = F.coalesce(
        F.when(F.json_array_length(value).isNotNull(), F.col(value)),
        *[
            F.when(F.json_array_length(inner).isNotNull(), inner)
            for inner in (F.get_json_object(value, f"$.{key}") for key in JSON_RECORD_KEYS)
        ],
    )
    records = F.coalesce(F.from_json(listed, "array<string>"), F.array(value))
    others = [c for c in docs.columns if c != value]
    return docs.select(*others, F.explode(records).alias(value))


def read_json(spark: SparkSession, path: str | Sequence[str], keys: Sequence[str] | None = None) -> DataFrame:
    """JSON documents, one file per row; a malformed document is an error."""
    docs = spark.read.option("recursiveFileLookup", True).text(path, wholetext=True)
    broken = F.raise_error(F.concat(F.lit("malformed JSON document "), F.input_file_name()))
    checked = docs.select(F.when(F.try_parse_json("value").isNotNull(), F.col("value")).otherwise(broken).alias("value"))
    return json_rows(_numbered(document_records(checked)), keys=keys)


def zeek_rows(lines: DataFrame, place: Column, file: Column, value: str = "value") -> DataFrame:
    """Data lines of Zeek logs as string columns, one per field name; ``-`` and missing values are empty.

    A line has the fields of the last ``#fields`` line above it in its file, so layouts may differ between files and
    change inside one. ``place`` orders the lines of a file. Lines before any header are skipped; a field that the
    layout of a line lacks is null.
    """
    others = [c for c in lines.columns if c != value]
    body = strip(F.col(value))
    placed = lines.select(*others, body.alias("__body"), place.alias("__place"), file.alias("__file")).where(F.col("__body") != "")
    fields = F.filter(F.split("__body", r"\s+"), lambda x: x != "")
    heads = placed.where(F.col("__body").startswith("#fields")).select("__file", "__place", F.slice(fields, 2, F.greatest(F.size(fields), F.lit(1))).alias("names"))
    names = sorted(r.n for r in heads.select(F.explode("names").alias("n")).distinct().collect())  # field names only
    if not names:
        raise ValueError("no #fields line")
    # A file has few layouts; the last one above a line is picked from them.
    layouts = heads.groupBy("__file").agg(F.array_sort(F.collect_list(F.struct(F.col("__place").alias("at"), "names"))).alias("__layouts"))
    above = F.filter("__layouts", lambda h: h["at"] < F.col("__place"))
    cells = placed.where(~F.col("__body").startswith("#")).join(layouts, "__file")
    cells = cells.select(*others, F.split("__body", "\t").alias("__v"), F.try_element_at(above, F.lit(-1))["names"].alias("__names"))
    cells = cells.where(F.col("__names").isNotNull())

    def cell(name: str) -> Column:
        at = F.array_position("__names", name)
        raw = F.get("__v", (at - 1).cast("int"))
        return F.when(at > 0, F.when(raw.isNull() | (raw == "-"), "").otherwise(raw))

    return cells.select(*others, *[cell(name).alias(name) for name in names])


def read_zeek(spark: SparkSession, path: str | Sequence[str]) -> DataFrame:
    """Zeek TSV logs of any layouts."""
    lines = spark.read.text(path).select("value", "_metadata.file_path", "_metadata.file_block_start")
    place = F.struct("file_block_start", F.col(ROW_ID))
    return zeek_rows(_numbered(lines), place, F.col("file_path")).drop("file_path", "file_block_start")


def flatten(df: DataFrame) -> DataFrame:
    """Struct columns as dotted columns, at any depth."""

    def leaves(schema: T.StructType, path: tuple[str, ...]):
        for field in schema.fields:
            here = (*path, field.name)
            if isinstance(field.dataType, T.StructType):
                yield from leaves(field.dataType, here)
            else:
                yield here

    columns = [
        F.col(".".join(f"`{p}`" for p in path)).alias(".".join(path)) for path in leaves(df.schema, ())
    ]
    return df.select(*columns)


def read_eve(spark: SparkSession, path: str | Sequence[str], schema: T.StructType | None = None) -> DataFrame:
    """Suricata EVE: one nested object per line, as dotted string columns.

    Without a schema one pass collects the keys; on a large archive pass the schema.
    """
    if schema is None:
        schema = spark.read.option("primitivesAsString", True).json(path).schema
        schema = T.StructType([f for f in schema.fields if f.name != "_corrupt_record"])
    lines = _numbered(spark.read.text(path)).where(F.json_object_keys("value").isNotNull())
    return flatten(lines.select(F.from_json("value", schema).alias("__r"), ROW_ID).select("__r.*", ROW_ID))


READERS = {"csv": read_csv, "json": read_json, "jsonl": read_jsonl, "zeek": read_zeek, "eve": read_eve}


def read_raw(spark: SparkSession, path: str, fmt: str | None = None) -> DataFrame:
    """Records of a file or folder of one format, with their place in the read order."""
    fmt = fmt or detect_format(spark, path)
    if fmt not in READERS:
        raise ValueError(f"{fmt} files hold no flow records; see sources.captures and sources.indicators")
    return READERS[fmt](spark, path)


def headers(raw: DataFrame) -> list[str]:
    return [c for c in raw.columns if c != ROW_ID]


def preview(raw: DataFrame, n: int = 50) -> DataFrame:
    """First rows, for a look at the data."""
    return raw.orderBy(ROW_ID).limit(n).drop(ROW_ID)


def record_counts(raw: DataFrame) -> DataFrame:
    return raw.agg(F.count(F.lit(1)).alias("records"))


def read_flows(
    spark: SparkSession,
    path: str,
    as_of: Column,
    *,
    fmt: str | None = None,
    mapping: Mapping[str, str] | None = None,
    batch_id: int | None = None,
) -> DataFrame:
    """Normalised flows of foreign files, with ``errors`` and ``warnings`` per row."""
    fmt = fmt or detect_format(spark, path)
    raw = read_raw(spark, path, fmt)
    mapping = mapping if mapping is not None else auto_mapping(headers(raw), fmt)
    return normalize(
        raw, mapping, as_of, fmt=fmt, batch_id=batch_id, filename=path.rstrip("/").rsplit("/", 1)[-1], keep=[ROW_ID]
    )

"""CSV files in ranges of bytes, with line breaks in quoted cells.

Whether a line break ends a record depends on all quotes before it. Ranges are cut after line breaks, where only two things can
be the case: a record begins, or a quoted cell goes on. Every range tells what follows for its end from either; strung
together per file this gives the truth at the start of each range, and then all ranges are read side by side, each its own
records, the last one to its end. Cells are taken apart by Spark.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import cache

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..session import shared_dir
from .ranges import View, listed, open_file, spread

#: Bytes of a range; records handed to Spark at once.
RANGE, BATCH = 64 << 20, 20_000
BOM = b"\xef\xbb\xbf"
_SURVEY = "path string, length long, part long, begin long, end long, outside boolean, inside boolean"


@cache
def _patterns(sep: str) -> tuple[re.Pattern, re.Pattern]:
    """A whole record with its line break, and the rest of a quoted cell with all that follows up to the end of the record.

    A cell that begins with a quote goes on to the quote that is not doubled, and from there to the next separator."""
    s = re.escape(sep.encode())
    rest = rb'(?:[^"]++|"")*+(?:"[^%b\n]*+|\Z)' % s
    cell = rb'(?:"%b|[^"%b\n][^%b\n]*+)?+' % (rest, s, s)
    more = rb"(?:%b%b)*+(?:\n|\Z)" % (s, cell)
    return re.compile(cell + more), re.compile(rest + more)


def after_break(view: View, at: int) -> int:
    """The place after the first line break from ``at`` on, or the end of the file."""
    while at < view.size:
        part = view.get(at, min(1 << 16, view.size - at))
        found = part.find(b"\n")
        if found >= 0:
            return at + found + 1
        at += len(part)
    return view.size


def records(view: View, begin: int, end: int, quoted: bool, sep: str) -> Iterator[tuple[int, bytes]]:
    """Place and bytes of the records that begin from ``begin`` to before ``end``. ``quoted``: a quoted cell goes on there."""
    record, rest = _patterns(sep)
    size, data = end - begin, view.get(begin, end - begin)
    at, held = begin, 0
    while at < end or quoted:
        found = (rest if quoted else record).match(data, held)
        if found.end() == len(data) and begin + len(data) < view.size:
            size *= 2  # the last record goes on behind the range: read more
            data = view.get(begin, size)
            continue
        if not quoted:
            yield at, data[held : found.end()]
        quoted = False
        at, held = begin + found.end(), found.end()
        if held >= len(data):
            break


def _ends_quoted(view: View, begin: int, end: int, quoted: bool, sep: str) -> bool:
    """Whether a quoted cell goes on at ``end``, which stands after a line break."""
    data = view.get(begin, end - begin)
    if b'"' not in data:
        return quoted
    record, rest = _patterns(sep)
    held = 0
    while held < len(data):
        found = (rest if quoted else record).match(data, held)
        held, quoted = found.end(), False
    # The last match ends here in any case: within a quoted cell, or as its line break ends it.
    return _open(data, found.start(), found.re is rest, sep)


def _open(data: bytes, start: int, quoted: bool, sep: str) -> bool:
    """Whether the record from ``start`` on ends within a quoted cell: with a quote behind the data it would end elsewhere."""
    record, rest = _patterns(sep)
    probe = data[start:] + b'""\n'
    # Inside a quoted cell the doubled quote is part of it and nothing ends; outside, the line break before has ended the record.
    return (rest if quoted else record).match(probe).end() == len(probe)


def _survey(sep: str):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            out = []
            for r in pdf.itertuples(index=False):
                view = open_file(r.path, int(r.length))
                begin = 0 if r.part == 0 else after_break(view, int(r.low))
                end = after_break(view, int(r.high)) if r.high < r.length else int(r.length)
                if begin >= end:
                    continue
                states = [False, False] if end == r.length else [_ends_quoted(view, begin, end, q, sep) for q in (False, True)]
                out.append((r.path, r.length, r.part, begin, end, *states))
            yield pd.DataFrame(out, columns=[c.split()[0] for c in _SURVEY.split(", ")])

    return run


def _string(pdf: pd.DataFrame) -> pd.DataFrame:
    """The truth at the start of each range of a file."""
    out, quoted = [], False
    for r in pdf.sort_values("part").itertuples(index=False):
        out.append((r.path, r.length, r.part, r.begin, r.end, quoted))
        quoted = bool(r.inside if quoted else r.outside)
    return pd.DataFrame(out, columns=["path", "length", "part", "begin", "end", "quoted"])


def _read(sep: str, header: bytes):
    """Place in the read order and text of the records; headers are checked and left out."""

    def batch(rows: list[tuple[int, bytes]]) -> pa.RecordBatch:
        texts = [x.decode("utf-8", "replace") for _, x in rows]
        return pa.RecordBatch.from_arrays([pa.array([p for p, _ in rows], pa.int64()), pa.array(texts, pa.string())], ["place", "value"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for given in batches:
            for r in given.to_pylist():
                rows, n, first = [], 0, r["part"] == 0
                for _, line in records(open_file(r["path"], r["length"]), r["begin"], r["end"], r["quoted"], sep):
                    line = line.removesuffix(b"\n").removesuffix(b"\r")
                    if not line:
                        continue
                    if first:
                        if line.removeprefix(BOM) != header:
                            raise ValueError(f"{r['path']} has another header")
                        first = False
                        continue
                    rows.append(((r["number"] << 33) + n, line))
                    n += 1
                    if len(rows) == BATCH:
                        yield batch(rows)
                        rows = []
                if rows:
                    yield batch(rows)

    return run


def header_of(path: str, sep: str) -> bytes:
    """The first record of a file that is not empty."""
    view = open_file(path)
    for _, line in records(view, 0, min(view.size, 1 << 16), False, sep):
        if line := line.removesuffix(b"\n").removesuffix(b"\r"):
            return line.removeprefix(BOM)
    return b""


def read(spark: SparkSession, paths: list[str], sep: str, place: str, size: int = RANGE) -> DataFrame:
    """The cells of CSV files of one header as string columns, and ``place``, which grows with file and line.

    Empty lines are skipped, missing cells are null. Files have one row per ``size`` bytes here, which are put in order per
    file; a task holds a range and the record that goes on behind it. A file without a record gives no rows.
    """
    files = listed(spark, paths).where("length > 0")
    first = files.agg(F.min("path")).first()[0]
    if first is None:
        raise ValueError("no CSV file has a header")
    header = header_of(first, sep)
    cut = files.select("*", F.explode(F.sequence(F.lit(0), F.floor((F.col("length") - 1) / size))).alias("part"))
    cut = cut.select("path", "length", "part", (F.col("part") * size).alias("low"), F.least((F.col("part") + 1) * size, "length").alias("high"))
    surveyed = spread(cut).mapInPandas(_survey(sep), _SURVEY)
    plan = surveyed.groupBy("path").applyInPandas(_string, "path string, length long, part long, begin long, end long, quoted boolean")
    plan = plan.withColumn("number", F.row_number().over(Window.partitionBy(F.lit(0)).orderBy("path", "part")).cast("long"))
    folder = shared_dir(spark, "csv-ranges")
    plan.write.parquet(folder)
    plan = spark.read.schema(plan.schema).parquet(folder)
    lines = spread(plan).mapInArrow(_read(sep, header), "place long, value string")
    options = {"sep": sep, "quote": '"', "escape": '"'}
    names = spark.createDataFrame([(header.decode("utf-8", "replace"),)], "value string")
    # At most so many columns; names that are not there are null.
    shape = ", ".join(f"c{i} string" for i in range(header.count(sep.encode()) + 1))
    told = list(names.select(F.from_csv("value", shape, options).alias("r")).first()["r"])
    lower = [(x or "").lower() for x in told]
    told = [f"{x}{i}" if x and lower.count(x.lower()) > 1 else x for i, x in enumerate(told)]  # as Spark names them apart
    cells = lines.select(F.from_csv("value", shape, options).alias("r"), "place")
    return cells.select(*[F.col(f"r.c{i}").alias(name) for i, name in enumerate(told) if name and name.strip()], F.col("place").alias(place))

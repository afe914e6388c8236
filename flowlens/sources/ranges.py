"""Bytes of files by place: tasks read ranges of a file block by block, so no file has to fit into one cell.

Spark lists the files; a task opens its file itself through Arrow's file systems. Paths of other systems are read whole by
Spark's binary reader, which goes up to 2 GiB.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable

from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Bytes that are read at once.
BLOCK = 4 << 20
#: File systems that tasks can open by themselves, and what Arrow calls them.
SCHEMES = {"file": "file", "s3": "s3", "s3a": "s3", "gs": "gs", "hdfs": "hdfs", "abfs": "abfs", "abfss": "abfss"}


class View:
    """Part of some bytes by place; ``read(at, size)`` gives up to ``size`` bytes."""

    def __init__(self, read: Callable[[int, int], bytes], size: int, block: int = BLOCK):
        self._read, self.size, self.block = read, size, block
        self._at, self._held = 0, b""

    def get(self, at: int, size: int) -> bytes:
        """The bytes there, fewer at the end of the file."""
        begin = at - self._at
        if begin < 0 or begin + size > len(self._held):
            self._at, self._held = at, self._read(at, max(size, self.block))
            begin = 0
        return self._held[begin : begin + size]


def view_of(data: bytes) -> View:
    return View(lambda at, size: data[at : at + size], len(data))


def open_file(path: str, size: int | None = None) -> View:
    """A file by its path as Spark names it."""
    scheme, _, rest = path.partition(":")
    if scheme == "file":
        system, name = fs.LocalFileSystem(), "/" + rest.lstrip("/")
    else:
        system, name = fs.FileSystem.from_uri(f"{SCHEMES[scheme]}:{rest}")
    handle = system.open_input_file(name)

    def read(at: int, n: int) -> bytes:
        handle.seek(at)
        return handle.read(n)

    return View(read, handle.size() if size is None else size)


def listed(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """``(path, length)`` of the files below a path; nothing is opened."""
    return spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path).select("path", "length")


def can_open(files: DataFrame) -> bool:
    """Whether tasks can open all these files by themselves."""
    return not files.where(~F.split("path", ":")[0].isin(*SCHEMES)).limit(1).count()


def spread(files: DataFrame) -> DataFrame:
    """The rows, each in a task of its own where there are not too many: a row stands for much work."""
    return files.repartition(min(10_000, max(1, files.count())))


def heads(files: DataFrame, size: int) -> DataFrame:
    """Add ``head``: the first bytes of each file."""

    @F.pandas_udf("binary")
    def first(paths):
        return paths.map(lambda path: open_file(path).get(0, size))

    return spread(files).withColumn("head", first("path"))


def hashes(files: DataFrame) -> DataFrame:
    """Add ``file_hash``, the SHA-256 of each file. The state of the hash goes from block to block."""

    def of(path: str) -> str:
        view, state, at = open_file(path), hashlib.sha256(), 0
        while part := view.get(at, BLOCK):
            state.update(part)
            at += len(part)
        return state.hexdigest()

    @F.pandas_udf("string")
    def digest(paths):
        return paths.map(of)

    return spread(files).withColumn("file_hash", digest("path"))

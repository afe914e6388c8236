"""Periodic runs of words by online dyadic square catching.

The words of a text are appended to a `Catcher`. Every completed block of b words, b a power of two, watches for a square
whose period q lies in b .. 2b - 1: the suffix of 2b words that an appended word completes is compared with the 2b words at
the block that stands q before it (of the blocks of b words just one is b to 2b - 1 words before). Equal stretches are a
square, or more, of period q. Neighbouring blocks that catch the same period merge into one stretch; at the end each
stretch grows word by word to both sides and is then a run.

Nothing is missed: a run of period q, b <= q < 2b, and length >= 4q holds a whole block within its first b words, and the 2b
words there come again q later inside the run. A block needs only its smallest catch: if q' < q both fit, then the text
there has a period that divides q (Fine and Wilf, as 2b > q), so q is not the smallest period of the run.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from .common import let, words
from .shingles import Shingler

#: A run repeats at least REPEATS times and has at least LEAST words.
REPEATS, LEAST = 4, 6
#: Words that are appended at once; this bounds the working memory beside the text itself.
STEP = 1 << 16

RUNS = pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())]))
U = np.uint64
BASE = 0x9E3779B97F4A7C15


class Catcher:
    """Runs among words (64-bit hashes) that are appended bit by bit; ``reset`` begins a new text."""

    def __init__(self, step: int = STEP):
        self.step = step
        self.powers = np.ones(1, dtype=U)
        self.reset()

    def reset(self) -> None:
        self.n = 0
        self.words = np.zeros(0, dtype=U)
        self.sums = np.zeros(1, dtype=U)  # of words times powers of BASE, up to each place
        self.caught: dict[int, int] = {}  # per block size: the last block that caught a square
        self.stretches: dict[int, list[list[int]]] = {}  # per block size: period, first and last block

    def _room(self, n: int) -> None:
        if n > len(self.powers):
            steps = np.full(max(n, 2 * len(self.powers)), BASE, dtype=U)
            steps[0] = 1
            self.powers = np.multiply.accumulate(steps)
        if n > len(self.words):
            more = max(n, 2 * len(self.words))
            self.words = np.concatenate((self.words[: self.n], np.zeros(more - self.n, dtype=U)))
            self.sums = np.concatenate((self.sums[: self.n + 1], np.zeros(more - self.n, dtype=U)))

    def append(self, words: np.ndarray) -> None:
        self._room(self.n + len(words))
        for at in range(0, len(words), self.step):
            self._append(words[at : at + self.step])

    def _append(self, words: np.ndarray) -> None:
        old, self.n = self.n, self.n + len(words)
        self.words[old : self.n] = words
        np.cumsum(words * self.powers[old : self.n], out=self.sums[old + 1 : self.n + 1])
        self.sums[old + 1 : self.n + 1] += self.sums[old]
        block = 1
        while REPEATS * block <= self.n:
            self._advance(block, old)
            block *= 2

    def _advance(self, block: int, old: int) -> None:
        """Compare the suffixes completed since ``old`` words with the blocks that watch them."""
        size = 2 * block
        # A level starts when the text is long enough for it, so its first suffixes may be older.
        first = block if REPEATS * block > old else max(block, old - size + 1)
        if first > self.n - size:
            return
        whole = self.sums[size : self.n + 1] - self.sums[: self.n + 1 - size]
        suffix = np.arange(first, self.n - size + 1)
        watcher = (suffix // block - 1) * block
        hits = suffix[whole[first:] == whole[watcher] * self.powers[suffix - watcher]]
        if not len(hits):
            return
        blocks = hits // block - 1
        fresh = blocks > self.caught.get(block, -1)
        fresh[1:] &= blocks[1:] != blocks[:-1]
        for place in np.flatnonzero(fresh).tolist():
            # Equal sums are checked word by word; if they were equal by chance, the block's next hit is taken.
            while place < len(hits) and not self._same(block * int(blocks[place]), int(hits[place]), size):
                place = place + 1 if place + 1 < len(hits) and blocks[place + 1] == blocks[place] else len(hits)
            if place < len(hits):
                self._catch(block, int(blocks[place]), int(hits[place]) - block * int(blocks[place]))

    def _same(self, a: int, b: int, size: int) -> bool:
        return bool((self.words[a : a + size] == self.words[b : b + size]).all())

    def _catch(self, block: int, number: int, period: int) -> None:
        self.caught[block] = number
        found = self.stretches.setdefault(block, [])
        if found and found[-1][0] == period and found[-1][2] == number - 1:
            found[-1][2] = number
        else:
            found.append([period, number, number])

    def runs(self) -> list[tuple[int, int, int]]:
        """Start, length and smallest period of every run so far, by start and period."""
        out = set()
        for block, found in self.stretches.items():
            for period, first, last in found:
                if self._primitive(first * block, period):
                    start = first * block - self._reach(first * block, period, -1)
                    end = last * block + 2 * block + period
                    end += self._reach(end, period, 1)
                    if end - start >= max(LEAST, REPEATS * period):
                        out.add((start, end - start, period))
        return sorted(out, key=lambda r: (r[0], r[2]))

    def _primitive(self, start: int, period: int) -> bool:
        """Whether the stretch repeats no part of its period."""
        left, p = period, 2
        while left > 1:
            if p * p > left:
                p = left
            if left % p == 0:
                part = period // p
                if self._same(start, start + part, period - part):
                    return False
                while left % p == 0:
                    left //= p
            p += 1
        return True

    def _reach(self, at: int, period: int, way: int) -> int:
        """How many words a stretch grows from its edge ``at`` (to the right: past its end)."""
        gone, look = 0, 16
        while True:
            if way > 0:
                look = min(look, self.n - at - gone)
                a, b = self.words[at + gone : at + gone + look], self.words[at + gone - period : at + gone - period + look]
            else:
                look = min(look, at - gone)
                low = at - gone - look
                a, b = self.words[low : low + look][::-1], self.words[low + period : low + period + look][::-1]
            if not look:
                return gone
            unlike = np.flatnonzero(a != b)
            if len(unlike):
                return gone + int(unlike[0])
            gone, look = gone + look, 2 * look


def collapse(docs: DataFrame, text: str = "text") -> DataFrame:
    """The rows with ``runs`` (array of start, length, period, in words) and ``collapsed``, the text without repeats.

    Words are stretches without ASCII white space. A run has its smallest period q, repeats it REPEATS times at least, has
    LEAST words at least, and no neighbouring word extends it. ``collapsed`` holds, joined by one space, the words that no
    run contains after its first q words. Null and empty texts have no runs and collapse to the empty text; texts of
    any length are read whole, in one task each, without a shuffle; repeated rows give repeated results; an empty
    table gives none; other columns are kept, those named like the added ones are replaced.
    """

    rows = docs.drop("runs", "collapsed")
    place = rows.columns.index(text)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hasher, catcher = Shingler(), Catcher()
        for batch in batches:
            found, left = [], []
            for value in batch.column(place).to_pylist():
                raw = (value or "").encode("utf-8", "surrogatepass")
                catcher.reset()
                catcher.append(hasher.words(raw)[2])
                runs, kept = catcher.runs(), raw.split()
                if runs:
                    # Runs overlap by less than two periods, so few words are marked twice.
                    stay = np.ones(len(kept), dtype=bool)
                    for start, length, period in runs:
                        stay[start + period : start + length] = False
                    kept = [kept[i] for i in np.flatnonzero(stay).tolist()]
                found.append([{"start": s, "length": n, "period": q} for s, n, q in runs])
                left.append(b" ".join(kept).decode("utf-8", "surrogatepass"))
            more = [pa.array(found, RUNS), pa.array(left, pa.string())]
            yield pa.RecordBatch.from_arrays([*batch.columns, *more], [*batch.schema.names, "runs", "collapsed"])

    more = StructType.fromDDL("runs array<struct<start: bigint, length: bigint, period: bigint>>, collapsed string")
    return rows.mapInArrow(work, StructType([*rows.schema.fields, *more.fields]))


def planted(doc_id: Column, text: Column) -> Column:
    """The contract's texts: in one document of ten the words from some place on repeat a few of them."""
    h = F.crc32(doc_id.cast("string"))
    g = F.floor(h / 10)

    def of(w: Column) -> Column:
        n = F.size(w).cast("long")
        a = g % F.nullif(n, F.lit(0))
        p = F.lit(1) + F.floor((n - a) / (F.lit(3) + g % 8))
        head = F.slice(w, F.lit(1), a.cast("int"))
        tail = F.transform(F.sequence(F.lit(0).cast("long"), n - a - 1), lambda i: F.get(w, (a + i % p).cast("int")))
        return F.when(n > 0, F.array_join(F.concat(head, tail), " "))

    return F.when(h % 10 == 0, F.coalesce(let(words(text), of), text)).otherwise(text)


def query(docs: DataFrame) -> DataFrame:
    """One row per document, in the columns of the contract: number of runs, the most repeated one, and digests.

    Of equally repeated runs the first start counts, then the smallest period. A null doc_id plants nothing.
    """
    rows = docs.select("doc_id", planted(F.col("doc_id"), F.col("text")).alias("text"))
    line = lambda r: F.concat_ws(",", *[r[k].cast("string") for k in ("start", "length", "period")])
    more = F.expr(
        "array_sort(runs, (a, b) -> case when a.length * b.period > b.length * a.period then -1"
        " when a.length * b.period < b.length * a.period then 1"
        " when (a.start, a.period) < (b.start, b.period) then -1 when (a.start, a.period) = (b.start, b.period) then 0 else 1 end)"
    )
    rows = collapse(rows).withColumn("best", F.get(more, F.lit(0)))
    return rows.select(
        "doc_id",
        F.size("runs").cast("long").alias("n_runs"),
        *[F.col(f"best.{k}").alias(k) for k in ("start", "length", "period")],
        F.expr("best.length * 1000 div best.period").alias("exponent_milli"),
        F.sha2(F.array_join(F.transform("runs", lambda r: F.concat(line(r), F.lit("\n"))), ""), 256).alias("runs_sha256"),
        F.sha2("collapsed", 256).alias("collapsed_sha256"),
    )

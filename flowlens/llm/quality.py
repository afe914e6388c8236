"""Quality classifier by positive-unlabelled learning with the non-negative risk estimator."""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .shingles import Shingler

#: Trusted positives and unlabelled texts that the model is fitted on (about, chosen by a hash of the id).
POSITIVES, UNLABELLED = 8_000, 16_000
#: The most different texts of one id that are learned from.
ROWS_PER_ID = 4
KNOTS = (0.05, 0.15, 0.3, 0.5, 0.7, 0.85, 0.95)
STEPS, RATE, DECAY = 500, 0.05, 1e-3

STOPS, CALLS = b".,;:'\"-()", b"!?"
SYMBOLS = b"#$%&*@^~<>{}[]\\/+=_`"


class Measures:
    """Numbers that describe the style of a text; none depends on its language, source or id."""

    def __init__(self):
        self.hasher = Shingler()
        kinds = {"letter": np.r_[65:91, 97:123, 128:256], "upper": np.r_[65:91], "digit": np.r_[48:58], "space": np.r_[32], "line": np.r_[10]}
        kinds |= {"stop": np.frombuffer(STOPS, np.uint8), "call": np.frombuffer(CALLS, np.uint8), "symbol": np.frombuffer(SYMBOLS, np.uint8), "bar": np.r_[124]}
        self.kinds = np.zeros((256, len(kinds)))
        for i, members in enumerate(kinds.values()):
            self.kinds[members, i] = 1
        self.odd = np.zeros(256, dtype=bool)
        self.odd[np.frombuffer(SYMBOLS + CALLS + b"|", np.uint8)] = True

    def of(self, text: str | None) -> np.ndarray:
        raw = (text or "").encode("utf-8", "surrogatepass")
        a = np.frombuffer(raw, dtype=np.uint8)
        shares = np.bincount(a, minlength=256) @ self.kinds / max(1, len(a))
        starts, ends, words = self.hasher.words(raw)
        n = len(words)
        if not n:
            return np.concatenate((shares, [math.log1p(len(a))], np.zeros(14)))
        lengths = ends - starts
        _, counts = np.unique(words, return_counts=True)
        again = lambda m: self.repeated(words, m)
        # The share of different words falls with length by itself, so it is compared in logarithms too.
        breaks = np.flatnonzero(a == 10)
        line = np.searchsorted(breaks, starts)
        first = np.flatnonzero(np.concatenate(([True], line[1:] != line[:-1])))
        sizes = np.diff(np.concatenate((first, [n])))
        whole = np.add.reduceat(words * np.arange(1, n + 1, dtype=np.uint64) - words * np.repeat(first, sizes).astype(np.uint64), first)
        _, lines = np.unique(whole, return_counts=True)
        more = [
            math.log1p(len(a)), lengths.mean(), lengths.std(), len(counts) / n, math.log1p(len(counts)) / math.log1p(n),
            counts.max() / n, (words[1:] == words[:-1]).mean() if n > 1 else 0.0, again(2), again(5), again(10),
            1 - len(lines) / len(first), math.log1p(sizes.mean()), self.odd[a[ends - 1]].mean(), (lengths == 1).mean(), shares[1] / max(shares[0], 1e-9),
        ]
        return np.concatenate((shares, more))

    @staticmethod
    def repeated(words: np.ndarray, m: int) -> float:
        """Share of the runs of m words that were there before."""
        if len(words) <= m:
            return 0.0
        runs = np.zeros(len(words) - m + 1, dtype=np.uint64)
        for i in range(m):
            runs = runs * np.uint64(0x100000001B3) + words[i : len(words) - m + 1 + i]
        return 1 - len(np.unique(runs)) / len(runs)


@dataclass
class Model:
    knots: np.ndarray
    scale: np.ndarray
    weights: np.ndarray
    prior: float

    def basis(self, x: np.ndarray) -> np.ndarray:
        """Piecewise linear functions of each measure with bends at the knots, within the range of the sample."""
        inside = np.clip(x, self.knots[0], self.knots[-1])
        hinges = [np.maximum(0.0, inside - k) for k in self.knots[:-1]]
        return np.concatenate([np.ones((len(x), 1)), np.concatenate(hinges, axis=1) / self.scale], axis=1)

    def score(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.basis(x) @ self.weights, -50, 50)))


def descend(positive: np.ndarray, unlabelled: np.ndarray, prior: float, guard: bool) -> np.ndarray:
    """Minimise prior * E_P[l(g)] + max(0, E_U[l(-g)] - prior * E_P[l(-g)]) with the logistic loss.

    While the second part is below zero, steps go against it alone, as the estimator prescribes. Without
    ``guard`` positives are only told apart from unlabelled rows (for the class prior).
    """
    w, m, v = (np.zeros(positive.shape[1]) for _ in range(3))
    sig = lambda z: 1 / (1 + np.exp(-np.clip(z, -50, 50)))
    soft = lambda z: np.logaddexp(0, z).mean()
    for t in range(1, STEPS + 1):
        gp, gu = positive @ w, unlabelled @ w
        up = positive.T @ (sig(gp) - 1) / len(positive)  # gradient of E_P[l(g)]
        down_u, down_p = unlabelled.T @ sig(gu) / len(unlabelled), positive.T @ sig(gp) / len(positive)
        if not guard:
            grad = up + down_u
        elif soft(gu) - prior * soft(gp) >= 0:
            grad = prior * up + down_u - prior * down_p
        else:
            grad = prior * down_p - down_u
        grad = grad + DECAY * np.concatenate(([0.0], w[1:]))
        m, v = 0.9 * m + 0.1 * grad, 0.999 * v + 0.001 * grad**2
        w = w - RATE * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-8)
    return w


def class_prior(positive: np.ndarray, unlabelled: np.ndarray) -> float:
    """Share of positives among the unlabelled: the least ratio of unlabelled to positive rows above a threshold.

    A classifier of positive against unlabelled rows is fitted on one half and read on the other; thresholds
    that leave few rows get a margin for chance.
    """
    w = descend(positive[::2], unlabelled[::2], 0.5, guard=False)
    p, u = np.sort(positive[1::2] @ w), np.sort(unlabelled[1::2] @ w)
    if not len(p) or not len(u):
        return 0.5
    cuts = np.quantile(p, np.linspace(0, 0.9, 181))
    above_p = 1 - np.searchsorted(p, cuts, side="left") / len(p)
    above_u = 1 - np.searchsorted(u, cuts, side="left") / len(u)
    margin = np.sqrt(np.log(20) / (2 * len(u))) + np.sqrt(np.log(20) / (2 * len(p)))
    best = np.argmin((above_u + margin) / np.maximum(above_p, 1e-9))
    return float(np.clip(above_u[best] / max(above_p[best], 1e-9), 0.05, 0.95))


def fit(positive: np.ndarray, unlabelled: np.ndarray) -> Model | None:
    """The model of these measures; None with fewer than four rows on a side."""
    if min(len(positive), len(unlabelled)) < 4:
        return None
    both = np.concatenate([positive, unlabelled])
    # Knots at quantiles of all rows and, for measures that most rows do not show, up to their end.
    knots = np.concatenate([both.min(axis=0)[None], np.quantile(both, KNOTS, axis=0), both.max(axis=0)[None]])
    model = Model(knots, np.ones(1), np.zeros(1), 0.5)
    model.scale = np.concatenate([np.maximum(0.0, np.clip(both, knots[0], knots[-1]) - k) for k in knots[:-1]], axis=1).std(axis=0) + 1e-6
    p, u = model.basis(positive), model.basis(unlabelled)
    model.prior = class_prior(p, u)
    model.weights = descend(p, u, model.prior, guard=True)
    return model


def held_out() -> Column:
    return F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 3 == 1, F.lit(False))


def sample(docs: DataFrame, labels: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """Measures of about POSITIVES trusted positives and UNLABELLED texts, neither of them held out.

    The shares go by id. Of an id at most ROWS_PER_ID different texts are taken, so what reaches the driver is bounded however
    often an id is repeated.
    """
    usable = ~held_out() & F.col("doc_id").isNotNull()
    good = labels.where(usable).groupBy("doc_id").agg(F.min("quality").alias("q")).where("q = 1").select("doc_id")
    place = F.pmod(F.xxhash64("doc_id"), F.lit(1 << 30))
    # Both shares come from whole counts, so the sample keeps its size on any corpus.
    good = good.where(place < int(min(1.0, POSITIVES / max(1, good.count())) * (1 << 30)))
    share = int(min(1.0, UNLABELLED / max(1, docs.count())) * (1 << 30))
    marked = docs.where(usable).select("doc_id", "text").join(F.broadcast(good.withColumn("good", F.lit(1))), "doc_id", "left")
    marked = marked.withColumn("any", F.pmod(F.xxhash64("doc_id", F.lit(1)), F.lit(1 << 30)) < share).where("good = 1 or any")

    def measures(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        of = Measures()
        for batch in batches:
            yield pd.DataFrame({"doc_id": batch["doc_id"], "fp": batch["fp"], "good": batch["good"] == 1, "any": batch["any"], "x": [of.of(t) for t in batch["text"]]})

    # An id may have many rows: each different text of it counts once, and the first ROWS_PER_ID of them by digest.
    marked = marked.withColumn("fp", F.md5(F.coalesce("text", F.lit(""))))
    firsts = marked.groupBy("doc_id", "fp").agg(F.count("*")).withColumn("place", F.row_number().over(Window.partitionBy("doc_id").orderBy("fp")))
    chosen = marked.join(firsts.where(F.col("place") <= ROWS_PER_ID).select("doc_id", "fp"), ["doc_id", "fp"], "left_semi")
    chosen = chosen.mapInPandas(measures, "doc_id long, fp string, good boolean, any boolean, x array<double>")
    rows = chosen.groupBy("doc_id", "fp").agg(*[F.first(c).alias(c) for c in ("good", "any", "x")]).collect()
    rows.sort(key=lambda r: (r["doc_id"], r["x"]))
    part = lambda name: np.array([r["x"] for r in rows if r[name]], dtype=float)
    return part("good"), part("any")


def scorer(docs: DataFrame, labels: DataFrame):
    """Column function: the score of a text, 0 to 1."""
    model = fit(*sample(docs, labels))

    def scores(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        of = Measures()
        for texts in batches:
            if model is None:
                yield pd.Series(0.5, index=texts.index)
            elif len(texts):
                yield pd.Series(model.score(np.stack([of.of(t) for t in texts])), index=texts.index)
            else:
                yield pd.Series([], dtype=float)

    return F.pandas_udf(scores, "double")


def classify(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """Add ``held_out``, ``score`` and ``predicted`` to the documents.

    Labels are read only where crc32(doc_id) mod 3 is not 1, and only their quality-1 rows (a document with
    both labels is not trusted). Null and empty texts are scored like others; a null doc_id is not held out and
    not learned from; without enough labelled rows every score is 0.5 and all are kept. Repeated rows get equal
    scores. Added columns replace those of the same name.
    """
    score = scorer(docs, labels)
    out = docs.withColumn("held_out", held_out()).withColumn("score", score("text"))
    return out.withColumn("predicted", (F.col("score") >= 0.5).cast("int"))


def query(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """One row per document, in the columns of the contract; odd rows as in `classify`."""
    return classify(docs.select("doc_id", "text"), labels).select("doc_id", "held_out", "score", "predicted")


def stage(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The documents that are not rejected, with their own columns, whatever their names.

    Null and empty texts are scored like others, repeated rows stay or go together, null ids are judged; too few labelled rows
    reject nothing, and an empty table gives an empty one.
    """
    score = scorer(docs, labels)
    rows = docs.select(F.struct("*").alias("_row"), score("text").alias("_score")).where("_score >= 0.5")
    return rows.select("_row.*")

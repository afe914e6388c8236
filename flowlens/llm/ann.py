"""Approximate nearest neighbours: a hierarchical k-means tree, best-bin-first, as many leaves as calibration asks for."""

from __future__ import annotations

import heapq
import math
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import stored
from .topk import merged

#: Vectors that the tree is built on (about) and most numbers in them, children of a node, vectors wanted in a leaf,
#: least sample in a leaf, queries that calibrate, and the share of their neighbours that must be found.
SAMPLE, SAMPLE_NUMBERS, FANOUT, LEAF, LEAST, CALIBRATE, RECALL = 20_000, 4_000_000, 8, 32, 4, 512, 0.94
#: Vectors of the leaves that go to one task together, queries in one product, rows of a product held at once.
PART, BLOCK, SLICE = 16384, 2048, 128


def usable(vectors: DataFrame) -> DataFrame:
    """vec_id and v (doubles) of the vectors that take part: not null, all components finite, not all zero."""
    fine = F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    v = F.transform("embedding", lambda x: x.cast("double"))
    return vectors.where("vec_id is not null").where(fine & F.exists("embedding", lambda x: x != 0)).select("vec_id", v.alias("v"))


def unit(m: np.ndarray) -> np.ndarray:
    m = m / np.abs(m).max(axis=1, keepdims=True)
    return m / np.sqrt((m * m).sum(axis=1, keepdims=True))


def matrix(column: pd.Series, dims: int) -> np.ndarray:
    return np.array(column.tolist(), dtype=np.float64).reshape(len(column), dims)


@dataclass
class Tree:
    """Nodes of the tree: centre, children; a node without children is a leaf, numbered by its place."""

    dims: int
    centres: list[np.ndarray] = field(default_factory=list)
    children: list[list[int]] = field(default_factory=list)
    matrix: np.ndarray | None = None  # all centres and their squared lengths, once the tree is built
    squares: np.ndarray | None = None

    @classmethod
    def build(cls, rows: np.ndarray, leaf: int, seed: int = 1) -> Tree:
        tree, rng = cls(rows.shape[1] if rows.size else 0), np.random.default_rng(seed)
        todo = [(tree._add(rows.mean(axis=0) if len(rows) else np.zeros(tree.dims)), np.arange(len(rows)))]
        while todo:
            node, members = todo.pop()
            if len(members) <= leaf:
                continue
            label = clusters(rows[members], min(FANOUT, max(2, len(members) // leaf)), rng)
            names = np.unique(label)
            if len(names) < 2:  # equal vectors cannot be told apart
                continue
            parts = [members[label == x] for x in names]
            tree.children[node] = [tree._add(rows[p].mean(axis=0)) for p in parts]
            todo += list(zip(tree.children[node], parts, strict=True))
        tree.matrix = np.stack(tree.centres)
        tree.squares = (tree.matrix * tree.matrix).sum(axis=1)
        return tree

    def _add(self, centre: np.ndarray) -> int:
        self.centres.append(centre)
        self.children.append([])
        return len(self.centres) - 1

    def leaf_of(self, rows: np.ndarray) -> np.ndarray:
        out, todo = np.zeros(len(rows), dtype=np.int64), [(0, np.arange(len(rows)))]
        while todo:
            node, members = todo.pop()
            below = self.children[node]
            if not below:
                out[members] = node
            elif len(members):
                closest = (self.squares[below] - 2 * rows[members] @ self.matrix[below].T).argmin(axis=1)
                todo += [(x, members[closest == i]) for i, x in enumerate(below)]
        return out

    def best_bins(self, row: np.ndarray) -> Iterator[int]:
        """Leaves, best bin first: of the nodes seen so far the one with the closest centre comes next."""
        apart = (self.squares - 2 * self.matrix @ row).tolist()  # squared distances up to a term that all share
        queue = [(0.0, 0)]
        while queue:
            _, node = heapq.heappop(queue)
            if not self.children[node]:
                yield node
            for x in self.children[node]:
                heapq.heappush(queue, (apart[x], x))


def clusters(rows: np.ndarray, k: int, rng: np.random.Generator, steps: int = 8) -> np.ndarray:
    centres = rows[rng.choice(len(rows), k, replace=False)]
    for _ in range(steps):
        label = ((centres * centres).sum(axis=1) - 2 * rows @ centres.T).argmin(axis=1)
        centres = np.stack([rows[label == i].mean(axis=0) if (label == i).any() else rows[rng.integers(len(rows))] for i in range(k)])
    return ((centres * centres).sum(axis=1) - 2 * rows @ centres.T).argmin(axis=1)


def nearest(rows: np.ndarray, ids: np.ndarray, m: np.ndarray, norms: np.ndarray, own: int, q: np.ndarray, close: np.ndarray, k: int):
    """Scores and ids of the k nearest of some rows to one query, given their approximate cosines; exact scores decide."""
    keep = np.flatnonzero(ids[rows] != own)
    if len(keep) > k:
        cut = np.partition(close[keep], len(keep) - k)[len(keep) - k]
        keep = keep[close[keep] >= cut - 1e-9]
    keep = rows[keep]
    exact = (m[keep] * q).sum(axis=1) / (norms[keep] * math.sqrt((q * q).sum()))
    order = np.lexsort((ids[keep], -exact))[:k]
    return exact[order], ids[keep][order]


def products(ask: pd.DataFrame, rows: pd.DataFrame, k: int) -> list[tuple[int, float, int]]:
    """query_id, score, vec_id of the k nearest rows of each query among the leaves that it opens (all rows without
    ``leaves``), for vectors of one length."""
    dims = len(ask["v"].iloc[0])
    m, ids = matrix(rows["v"], dims), rows["vec_id"].to_numpy()
    norms, units, found = np.sqrt((m * m).sum(axis=1)), unit(m), []
    names, leaf = np.unique(rows["leaf"].to_numpy(), return_inverse=True)
    if "leaves" in ask:  # queries that open the same leaves stand together
        ask = ask.iloc[np.argsort([x[0] for x in ask["leaves"]], kind="stable")]
    for at in range(0, len(ask), SLICE):
        part = ask.iloc[at : at + SLICE]
        q = matrix(part["v"], dims)
        opened = np.ones((len(part), len(names)), dtype=bool)
        if "leaves" in ask:
            opened = np.stack([np.isin(names, x) for x in part["leaves"]])
        columns = np.flatnonzero(opened.any(axis=0)[leaf])
        close = unit(q) @ units[columns].T
        for own, v, c, seen in zip(part["vec_id"].to_numpy(), q, close, opened[:, leaf[columns]], strict=True):
            scores, hits = nearest(columns[seen], ids, m, norms, own, v, c[seen], k)
            found += [(int(own), float(s), int(i)) for s, i in zip(scores, hits, strict=True)]
    return found


def search(queries: DataFrame, vectors: DataFrame, k: int = 5, recall: float = RECALL, sample: int = SAMPLE) -> DataFrame:
    """query_id, rank, vec_id, score: the k nearest vectors (largest cosine) found for each query.

    The tree is fitted on a bounded sample; every vector is put in the leaf that it descends to. A query opens
    leaves best bin first: as many as ``recall`` of the true neighbours of a few calibrating queries took, found by
    brute force over all vectors, and more until it has seen k others. Leaves go to tasks in bins of bounded size;
    a leaf of any size is dealt into several.
    Rows with the id of the query are its own. Repeated ids: each row is a candidate, one query (the smallest
    vector) is asked. Equal scores go to the smaller id. Vectors of another length than the sample's commonest
    share one leaf per length and are searched whole. No queries or candidates give no rows.
    """
    spark = vectors.sparkSession
    queries = queries.groupBy("vec_id").agg(F.min("v").alias("v"))
    total = vectors.count()
    lengths = vectors.groupBy(F.size("v").alias("dims")).count().orderBy(F.desc("count"), "dims").limit(1).collect()
    dims = lengths[0]["dims"] if lengths else 0
    rows = min(sample, max(1, SAMPLE_NUMBERS // max(1, dims)))
    place = F.pmod(F.xxhash64("vec_id"), F.lit(1 << 30))
    picked = vectors.where(F.size("v") == dims).where(place < math.ceil(min(1.0, rows / max(1, total)) * (1 << 30))).orderBy("vec_id", "v").limit(2 * rows)
    picked = picked.select("v").toPandas()["v"]
    leaf = max(LEAST, round(LEAF * len(picked) / max(1, total)))
    tree = Tree.build(unit(matrix(picked, dims)) if len(picked) else np.zeros((0, dims)), leaf)

    def leaves(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            fits = (batch["v"].map(len) == dims).to_numpy()
            out = -batch["v"].map(len).to_numpy().astype(np.int64)
            if fits.any():
                out[fits] = tree.leaf_of(unit(matrix(batch["v"][fits], dims)))
            yield batch.assign(leaf=out)

    index = stored(vectors.mapInPandas(leaves, "vec_id long, v array<double>, leaf long"), "ann-index")
    # A row per leaf, at most twice the sample in all.
    counts = {r["leaf"]: r["count"] for r in index.groupBy("leaf").count().collect()}
    visits = calibrated(queries.where(F.size("v") == dims), index.where(F.col("leaf") >= 0), tree, k, recall)

    # Neighbouring leaves share a bin up to PART vectors; a larger leaf has bins of its own, dealt by a hash of the id.
    bins, first, room = [], 0, 0
    for x in sorted(counts):
        if counts[x] > room:
            first, room = (bins[-1][1] + bins[-1][2] if bins else 0), PART
        bins.append((x, first, max(1, math.ceil(counts[x] / PART))))
        room = room - counts[x] if counts[x] <= PART else 0
    of = {x: (bin_, n) for x, bin_, n in bins}
    blocks = max(1, math.ceil(queries.count() / BLOCK))
    dealt = F.broadcast(spark.createDataFrame(bins or [(0, 0, 1)], "leaf long, first int, parts int"))
    block = F.pmod(F.xxhash64(F.lit(2), "vec_id"), F.lit(blocks)).cast("int")

    def opened(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for i, v in zip(batch["vec_id"], batch["v"], strict=True):
                wanted, seen = {}, 0
                leaves = tree.best_bins(unit(np.asarray(v, dtype=float)[None, :])[0]) if len(v) == dims else [-len(v)]
                for n, x in enumerate(leaves):
                    if n >= visits and seen > k:
                        break
                    seen += counts.get(x, 0)
                    for bin_ in range(of[x][0], of[x][0] + of[x][1]) if x in of else ():
                        wanted.setdefault(bin_, []).append(x)
                out += [(i, v, bin_, xs) for bin_, xs in wanted.items()]
            yield pd.DataFrame(out, columns=["vec_id", "v", "bin", "leaves"])

    asked = queries.mapInPandas(opened, "vec_id long, v array<double>, bin int, leaves array<long>")
    asked = asked.select("bin", block.alias("block"), "vec_id", "v", "leaves")
    shown = index.join(dealt, "leaf").withColumn("bin", F.col("first") + F.pmod(F.xxhash64(F.lit(1), "vec_id"), F.col("parts")).cast("int"))
    shown = shown.select("bin", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))).alias("block"), "vec_id", "v", "leaf")

    def one_bin(key, ask: pd.DataFrame, rows: pd.DataFrame) -> pd.DataFrame:
        found, ask_dims, row_dims = [], ask["v"].map(len), rows["v"].map(len)
        for n in set(ask_dims) & set(row_dims):
            found += products(ask[ask_dims == n], rows[row_dims == n], k)
        return pd.DataFrame(found, columns=["query_id", "score", "vec_id"]).assign(tile=int(key[0]))

    lists = asked.groupBy("bin", "block").cogroup(shown.groupBy("bin", "block")).applyInPandas(one_bin, "query_id long, score double, vec_id long, tile int")
    return merged(lists, 1 + max((bin_ + n for _, bin_, n in bins), default=0), k)


def calibrated(queries: DataFrame, index: DataFrame, tree: Tree, k: int, recall: float) -> int:
    """How many leaves a query must open: the least number that holds ``recall`` of the true neighbours of at most
    CALIBRATE queries (by a hash of the id), which are searched in all vectors."""
    few = queries.orderBy(F.xxhash64("vec_id"), "vec_id").limit(CALIBRATE).toPandas()
    if few.empty:
        return 1

    def brute(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        def lists(rows: pd.DataFrame) -> pd.DataFrame:
            at = dict(zip(rows["vec_id"], rows["leaf"], strict=True))
            return pd.DataFrame([(q, s, i, at[i]) for q, s, i in products(few, rows, k)], columns=["query_id", "score", "vec_id", "leaf"])

        held, n = [], 0
        for batch in batches:
            held.append(batch)
            n += len(batch)
            if n >= PART:
                yield lists(pd.concat(held, ignore_index=True))
                held, n = [], 0
        if n:
            yield lists(pd.concat(held, ignore_index=True))

    best = index.mapInPandas(brute, "query_id long, score double, vec_id long, leaf long")
    top = best.groupBy("query_id").agg(F.slice(F.sort_array(F.collect_list(F.struct("score", "vec_id", "leaf")), asc=False), 1, k).alias("top"))
    wanted = {r["query_id"]: [x["leaf"] for x in r["top"]] for r in top.collect()}
    steps = []
    for query, v in zip(few["vec_id"], few["v"], strict=True):
        order = {x: i + 1 for i, x in enumerate(tree.best_bins(unit(np.asarray(v, dtype=float)[None, :])[0]))}
        steps += [order[x] for x in wanted.get(query, [])]
    return int(np.sort(steps)[math.ceil(recall * len(steps)) - 1]) if steps else 1


def query(embeddings: DataFrame) -> DataFrame:
    """The five nearest found of every query of the contract (vec_id divisible by 50); odd rows as in `usable` and `search`."""
    vectors = usable(embeddings)
    return search(vectors.where("vec_id % 50 = 0"), vectors)

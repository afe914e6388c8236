"""Exact top-k search: tiled matrix products, partial selection per tile, tree merging of the lists."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Vectors per tile, queries per block, rows of a product held at once, lists merged per step.
TILE, BLOCK, SLICE, FAN = 16384, 2048, 128, 16
LEAST, MOST = -(2**63), 2**63 - 1
#: Whole numbers up to here are exact in double precision.
EXACT = 2**53
#: Components whose products of 21-bit parts are summed exactly in double precision.
LIMB_DIMS = 1024


def whole(vectors: DataFrame, scale: int = 256) -> DataFrame:
    """vec_id and ``v``, the components as floor(scale * x); vectors that are null or hold null or non-finite
    components are left out. Components beyond the range of long stop at its ends; an empty vector stays."""
    scaled = F.transform("embedding", lambda x: F.floor(x.cast("double") * scale))
    usable = F.col("embedding").isNotNull() & F.forall(
        "embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf")))
    )
    return vectors.where("vec_id is not null").where(usable).select("vec_id", scaled.alias("v"))


def _limbs(m: np.ndarray) -> list[np.ndarray]:
    """Three parts of 21 bits, lowest first, each with the sign of the number."""
    size, sign = np.abs(m).astype(np.uint64), np.sign(m).astype(np.float64)
    return [((size >> np.uint64(21 * i)) & np.uint64((1 << 22) - 1 if i == 2 else (1 << 21) - 1)).astype(np.float64) * sign for i in range(3)]


def product(queries: np.ndarray, shard: np.ndarray) -> np.ndarray:
    """Integer inner products, stopping at the ends of long; in double precision while that is exact.

    Larger numbers are multiplied in parts of 21 bits, whose products are exact for LIMB_DIMS components at once. Their sums
    are put together in wrapping 64-bit numbers, and one by one only where the result may lie beyond these.
    """
    top = [float(np.abs(m.astype(np.float64)).max(initial=0)) for m in (queries, shard)]
    if queries.shape[1] * top[0] * top[1] < EXACT:
        return (queries.astype(np.float64) @ shard.astype(np.float64).T).astype(np.int64)
    sums = [np.zeros((len(queries), len(shard)), dtype=np.int64) for _ in range(5)]
    for at in range(0, queries.shape[1], LIMB_DIMS):
        parts = [[(i, x) for i, x in enumerate(_limbs(m[:, at : at + LIMB_DIMS])) if x.any()] for m in (queries, shard)]
        for i, x in parts[0]:
            for j, y in parts[1]:
                sums[i + j] += (x @ y.T).astype(np.int64)
    out = np.zeros(sums[0].shape, dtype=np.uint64)
    for i in range(4):
        out += sums[i].astype(np.uint64) << np.uint64(21 * i)
    out = out.astype(np.int64)
    most = np.abs(queries.astype(np.float64)) @ np.abs(shard.astype(np.float64)).T
    for i, j in np.argwhere(most >= 2.0**62).tolist():
        out[i, j] = max(LEAST, min(MOST, sum(int(x[i, j]) << (21 * n) for n, x in enumerate(sums))))
    return out


def best(scores: np.ndarray, ids: np.ndarray, own: int, k: int) -> tuple[np.ndarray, np.ndarray]:
    """The k highest scores of one query in one tile, ties to the smaller id: partial selection, then a short sort."""
    keep = np.flatnonzero(ids != own)
    if len(keep) > k:
        cut = np.partition(scores[keep], len(keep) - k)[len(keep) - k]
        keep = keep[scores[keep] >= cut]
    order = keep[np.lexsort((ids[keep], ~scores[keep]))][:k]
    return scores[order], ids[order]


def search(queries: DataFrame, vectors: DataFrame, k: int = 5, tile: int = TILE, block: int = BLOCK) -> DataFrame:
    """query_id, rank, vec_id, score: the k highest inner products of every query (vec_id, v) with all vectors.

    Vectors are dealt into tiles by a hash of id and vector and queries into blocks by a hash of the id; each pair of a
    tile and a block is one matrix product in one task of bounded size. Equal rows (id and vector) have equal scores, so
    no list can hold more than k of them, and k of them are dealt. Every tile keeps k candidates per query, and the lists are
    merged 16 at a time. Rows with the id of the query are its own and no candidates, vectors of another length
    have no product with it. Repeated ids: each row is a candidate, one query (the smallest vector) is asked.
    Equal scores go to the smaller id. No queries or no candidates give no rows.
    """
    spark = vectors.sparkSession
    queries = queries.groupBy("vec_id").agg(F.min("v").alias("v"))
    copies = vectors.groupBy("vec_id", "v").agg(F.count("*").alias("n"))
    vectors = copies.select("vec_id", "v", F.explode(F.sequence(F.lit(1), F.least("n", F.lit(k)).cast("int"))).alias("copy"))
    tiles = max(1, math.ceil(vectors.count() / tile))
    blocks = max(1, math.ceil(queries.count() / block))
    dealt = lambda n, *by: F.pmod(F.xxhash64(*by), F.lit(n)).cast("int")
    shards = vectors.select(dealt(tiles, F.lit(1), "vec_id", "v", "copy").alias("tile"), F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))).alias("block"), "vec_id", "v")
    asked = queries.select(F.explode(F.sequence(F.lit(0), F.lit(tiles - 1))).alias("tile"), dealt(blocks, F.lit(2), "vec_id").alias("block"), "vec_id", "v")

    def one_tile(key, ask: pd.DataFrame, rows: pd.DataFrame) -> pd.DataFrame:
        found = []
        ask_dims, row_dims = ask["v"].map(len).to_numpy(), rows["v"].map(len).to_numpy()
        for dims in np.unique(ask_dims):
            q, r = ask[ask_dims == dims], rows[row_dims == dims]
            if not len(q) or not len(r):
                continue
            ids = r["vec_id"].to_numpy()
            shard = np.array(r["v"].tolist(), dtype=np.int64).reshape(len(r), dims)
            for at in range(0, len(q), SLICE):
                part = q.iloc[at : at + SLICE]
                scores = product(np.array(part["v"].tolist(), dtype=np.int64).reshape(len(part), dims), shard)
                for own, line in zip(part["vec_id"].to_numpy(), scores, strict=True):
                    s, i = best(line, ids, own, k)
                    found += [(own, int(key[0]), int(x), int(y)) for x, y in zip(s, i, strict=True)]
        return pd.DataFrame(found, columns=["query_id", "tile", "score", "vec_id"])

    lists = asked.groupBy("tile", "block").cogroup(shards.groupBy("tile", "block")).applyInPandas(one_tile, "query_id long, tile int, score long, vec_id long")
    return merged(lists, tiles, k)


def merged(lists: DataFrame, tiles: int, k: int) -> DataFrame:
    """Merge the candidates (query_id, tile, score, vec_id) of every query as a tree, FAN tiles a step."""
    better = "(a, b) -> case when a.score > b.score then -1 when a.score < b.score then 1 when a.vec_id < b.vec_id then -1 when a.vec_id > b.vec_id then 1 else 0 end"
    short = lambda c: F.expr(f"slice(array_sort({c}, {better}), 1, {k})")
    tops = lists.groupBy("query_id", "tile").agg(F.collect_list(F.struct("score", "vec_id")).alias("top"))
    while tiles > 1:
        tops = tops.groupBy("query_id", F.expr(f"tile div {FAN}").cast("int").alias("tile")).agg(F.flatten(F.collect_list("top")).alias("all"))
        tops = tops.select("query_id", "tile", short("all").alias("top"))
        tiles = math.ceil(tiles / FAN)
    ranked = tops.select("query_id", F.posexplode(short("top")).alias("at", "hit"))
    return ranked.select("query_id", (F.col("at") + 1).cast("int").alias("rank"), "hit.vec_id", "hit.score")


def query(embeddings: DataFrame) -> DataFrame:
    """The five highest scores of every query of the contract (vec_id divisible by 50); odd rows as in `whole` and `search`."""
    vectors = whole(embeddings)
    return search(vectors.where("vec_id % 50 = 0"), vectors)


SQL = """
with v as (
    select vec_id, list_transform(embedding, lambda x: floor(256 * x::double)::bigint) as v from embeddings
    where vec_id is not null and embedding is not null and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0
), s as (
    select q.vec_id as query_id, c.vec_id, list_sum(list_transform(list_zip(q.v, c.v), lambda p: p[1] * p[2]))::bigint as score
    from v as q join v as c on c.vec_id <> q.vec_id where q.vec_id % 50 = 0
)
select query_id, row_number() over (partition by query_id order by score desc, vec_id)::int as rank, vec_id, score
from s qualify row_number() over (partition by query_id order by score desc, vec_id) <= 5
"""

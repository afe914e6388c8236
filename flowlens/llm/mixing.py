"""Mixing sources to target weights: hash-random order, distributed prefix sums, exact cuts, repeated epochs."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import prefix_sums, range_starts, ranges, stored, words

#: Weights of the sources in code point order (repeating), and the most epochs of a source.
WEIGHTS, EPOCHS = (5, 2, 1), 3


def sized(docs: DataFrame) -> DataFrame:
    """Add what the mix needs: ``size`` in words, ``_source`` (never null) and the hash-random key ``_key``."""
    out = docs.withColumn("size", F.size(words(F.col("text"))).cast("long"))
    out = out.withColumn("_source", F.coalesce(F.concat(F.lit("="), "source"), F.lit("")))
    return out.withColumn("_key", F.md5(F.concat_ws(":", F.col("doc_id").cast("string"), F.col("size").cast("string"))))


def targets(sources: DataFrame, weights: tuple[int, ...] = WEIGHTS, epochs: int = EPOCHS) -> DataFrame:
    """Per source (``_source``, ``total``): ``target`` words (double) and the whole-number ``budget``.

    Weights go round the sources in code point order, null last. A target stops at ``epochs`` times its source;
    the excess is shared among the others by weight. In order of limit / weight the sources at their limit come
    first, so the level of the rest is the first one that its own source can reach. One row per source.
    """
    by_name = Window.orderBy(F.col("_source") == "", "_source")
    level_order = Window.orderBy("_reach", "_rank").rowsBetween(Window.unboundedPreceding, -1)
    everything = Window.partitionBy()
    out = sources.withColumn("_rank", F.row_number().over(by_name))
    out = out.withColumn("_weight", F.element_at(F.lit(list(weights)), (F.col("_rank") - 1) % len(weights) + 1).cast("long"))
    out = out.withColumn("_limit", F.col("total") * F.lit(epochs)).withColumn("_reach", F.expr("cast(_limit as double) / _weight"))
    left = F.sum("total").over(everything) - F.coalesce(F.sum("_limit").over(level_order), F.lit(0))
    weight = F.sum("_weight").over(everything) - F.coalesce(F.sum("_weight").over(level_order), F.lit(0))
    out = out.withColumn("_level", left.cast("double") / weight)
    out = out.withColumn("_first", F.min(F.when(F.col("_level") <= F.col("_reach"), F.struct("_reach", "_rank", "_level"))).over(everything))
    full = F.col("_first").isNull() | (F.struct("_reach", "_rank") < F.struct("_first._reach", "_first._rank"))
    out = out.withColumn("target", F.when(full, F.col("_limit").cast("double")).otherwise(F.col("_first._level") * F.col("_weight")))
    out = out.withColumn("budget", F.least(F.round("target").cast("long"), "_limit"))
    return out.drop("_rank", "_weight", "_limit", "_reach", "_level", "_first")


def mix(rows: DataFrame, sizes: DataFrame | None = None, weights: tuple[int, ...] = WEIGHTS, epochs: int = EPOCHS) -> DataFrame:
    """Add ``source_size``, ``target`` and ``taken`` to rows of `sized`; ``sizes`` may be a stored narrow copy of them.

    Documents of a source stand in the order of a hash of (doc_id, size), split into hash ranges so that a hot
    source is sorted in many tasks. A budget of e whole epochs and r words more takes e times each document,
    and once more the documents before the r-th word; the document at the cut gives just the words up to it.

    Null or empty texts have size 0 and are taken 0 times; a null source is a source; repeated rows count each;
    an empty table gives an empty result. Columns named like the added ones are replaced.
    """
    sizes = rows if sizes is None else sizes
    count = ranges(rows.sparkSession)
    starts = range_starts(sizes, ["_source"], "_key", "size", count)
    plan = targets(starts.select("_source", "total"), weights, epochs).select("_source", "target", "budget")
    starts = starts.join(plan, "_source")
    rows = rows.drop("source_size", "target", "taken", "before", "total", "budget")
    summed = prefix_sums(rows, starts, ["_source"], "_key", ["size"], "size", count)
    taken = "(budget div total) * size + least(size, greatest(0L, budget % total - before))"
    return (
        summed.withColumn("taken", F.expr(f"case when total > 0 then {taken} else 0L end"))
        .withColumnRenamed("total", "source_size")
        .drop("before", "budget", "_source", "_key")
    )


def query(docs: DataFrame) -> DataFrame:
    """One row per document, in the columns of the contract."""
    narrow = stored(sized(docs.select("doc_id", "source", "text")).drop("text"), "mix-sizes")
    return mix(narrow).select("doc_id", "size", "source_size", "target", "taken", "source")


def stage(docs: DataFrame) -> DataFrame:
    """The mixed documents: a row for each epoch in which any word of the document is taken; texts stay whole.

    Documents without words (null, empty) are taken in no epoch, so they are not in the mix. Null sources are a source, repeated
    rows count each, own columns stay whatever their names; an empty table gives an empty one.
    """
    rows = sized(docs.select(F.struct("*").alias("_row"), "doc_id", "source", "text")).drop("text")
    rows = mix(rows, stored(rows.select("size", "_source", "_key"), "mix-sizes"))
    copies = rows.where("taken > 0").withColumn("_copy", F.explode(F.expr("sequence(1, cast(ceil(taken / size) as int))")))
    return copies.select("_row.*")


SQL = r"""
with d as (
    select doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::bigint as size from documents
), s as (
    select source, sum(size)::bigint as total, row_number() over (order by source nulls last) as k from d group by source
), w as (
    select *, case (k - 1) % 3 when 0 then 5 when 1 then 2 else 1 end as weight, 3 * total as lim from s
), r as (
    select *, lim::double / weight as reach from w
), c as (
    select *, row_number() over (order by reach, k) as p,
        sum(total) over () - coalesce(sum(lim) over (order by reach, k rows between unbounded preceding and 1 preceding), 0) as l,
        sum(weight) over () - coalesce(sum(weight) over (order by reach, k rows between unbounded preceding and 1 preceding), 0) as v
    from r
), f as (
    select *, min(case when l::double / v <= reach then p end) over () as first_p, l::double / v as level from c
), t as (
    select *, case when p < first_p then lim::double else (select level from f as g where g.p = f.first_p) * weight end as target from f
), o as (
    select d.doc_id, d.source, d.size, t.total, t.target, least(round(t.target)::bigint, t.lim::bigint) as budget,
        sum(d.size) over (partition by t.k order by md5(concat_ws(':', d.doc_id::varchar, d.size::varchar)), d.size
            rows between unbounded preceding and current row) - d.size as before
    from d join t on d.source is not distinct from t.source
)
select doc_id, size, total as source_size, target, source,
    case when total > 0 then (budget // total) * size + least(size, greatest(0, budget % total - before)) else 0 end::bigint as taken
from o
"""

"""Document fingerprints as threshold-scaled sketches of word shingles.

Every shingle whose hash lies below a fixed fraction of all hashes is kept, however long the text. Sketches of any two
texts are therefore comparable and can be merged, and the share of the smaller text within the larger one can be told
as well as the likeness of texts of equal length. The smallest hash stays in any case, so a text of few words has a sketch, too.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import let, range_of, ranges, stored, words

#: Words of a shingle, and the fraction of the shingle hashes that is kept.
SHINGLE, FRACTION = 5, 1 / 8
#: Hexadecimal digits of a hash in a fingerprint.
DIGITS = 12


def below(fraction: float) -> str:
    """The first hash that is not kept, as digits; hashes are compared as texts."""
    return format(min(int(fraction * 16**DIGITS), 16**DIGITS - 1), f"0{DIGITS}x")


def retained(hashes: Column, fraction: float) -> Column:
    """Of hashes in ascending order: those below the threshold, else the first."""
    kept = F.filter(hashes, lambda h: h < F.lit(below(fraction)))
    return let(kept, lambda k: F.when(F.size(k) > 0, k).otherwise(F.slice(hashes, 1, 1)))


def fingerprint(text: Column, fraction: float = FRACTION, shingle: int = SHINGLE) -> Column:
    """The kept hashes of a text's shingles, ascending, each once, joined by commas; empty without words.

    A text of fewer words than a shingle is one shingle. Hashes are the first digits of the md5 of the shingle's words
    joined by one space. Null is the empty text. Work and size grow with the text only.
    """

    def of(w: Column) -> Column:
        one = lambda i: F.substring(F.md5(F.array_join(F.slice(w, i, F.lit(shingle)), " ")), 1, DIGITS)
        hashes = F.transform(F.sequence(F.lit(1), F.greatest(F.size(w) - (shingle - 1), F.lit(1))), one)
        return F.when(F.size(w) > 0, F.array_join(let(hashes, chosen), ",")).otherwise("")

    def chosen(hashes: Column) -> Column:
        # Only what is kept is put in order: a sort of all shingles would be most of the work.
        kept = F.array_sort(F.array_distinct(F.filter(hashes, lambda h: h < F.lit(below(fraction)))))
        return let(kept, lambda k: F.when(F.size(k) > 0, k).otherwise(F.array(F.array_min(hashes))))

    return let(words(text), of)


def _hashes(fp: Column) -> Column:
    return F.filter(F.split(fp, ","), lambda h: h != "")


def merged(a: Column, b: Column, fraction: float = FRACTION) -> Column:
    """The fingerprint of the union of both shingle sets."""
    return F.array_join(let(F.array_sort(F.array_union(_hashes(a), _hashes(b))), lambda h: retained(h, fraction)), ",")


def _share(both: Column, of: Column, fraction: float) -> Column:
    """Share of the hashes ``of`` that are in ``both``; where none lies below the threshold, the smallest one decides."""
    kept = lambda x: F.size(F.filter(x, lambda h: h < F.lit(below(fraction))))
    few = F.coalesce(F.array_contains(both, F.array_min(of)), F.lit(True)).cast("double")
    return let(kept(of), lambda n: F.when(n > 0, kept(both) / n).otherwise(few))


def likeness(a: Column, b: Column, fraction: float = FRACTION) -> Column:
    """Estimated share of the shingles of either text that both have (0 to 1), from two fingerprints.

    Two texts without words are alike. Where neither has a hash below the threshold, their smallest hashes are compared.
    """
    return let(_hashes(a), lambda x: let(_hashes(b), lambda y: _share(F.array_intersect(x, y), F.array_union(x, y), fraction)))


def containment(a: Column, b: Column, fraction: float = FRACTION) -> Column:
    """Estimated share of the shingles of ``a`` that ``b`` has (0 to 1), however unequal their lengths.

    A text without words lies in every text. Where ``a`` has no hash below the threshold, only an equal smallest hash counts.
    """
    return let(_hashes(a), lambda x: let(_hashes(b), lambda y: _share(F.array_intersect(x, y), x, fraction)))


def ordered_parts(docs: DataFrame) -> tuple[DataFrame, Column]:
    """Narrow keys (stored: doc_id, dg, the md5 of the text) and an expression of both: the part of a row.

    Parts follow descending doc_id, nulls last, then dg, and hold about equally many rows: doc_ids are cut at quantiles.
    An id that is a cut itself, and null, are parts of their own that are cut again by ranges of dg, so one id may
    hold any share of the rows. The quantiles are as many numbers as there are ranges (`common.ranges`); parts are three
    times as many at most.
    """
    keys = stored(docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.md5(F.coalesce("text", F.lit(""))).alias("dg")), "fingerprint-keys")
    count = ranges(docs.sparkSession)
    shares = F.lit([i / count for i in range(count + 1)])
    found = keys.agg(F.percentile_approx("doc_id", shares, max(10_000, 16 * count)).alias("q")).first()["q"] or [0]
    cuts = sorted(set(found))
    step = max(1, int(len(cuts) ** 0.5))
    doc_id = F.col("doc_id").cast("long")
    # The cuts at or below an id are counted in two strides.
    at = F.size(F.filter(F.lit(cuts[step::step]), lambda c: c <= doc_id)) * step
    near = F.slice(F.lit(cuts), at + 1, F.lit(step))
    at = at + F.size(F.filter(near, lambda c: c <= doc_id))
    alone = F.coalesce(F.array_contains(near, doc_id), F.lit(True))
    # An id that is a cut n times holds about n of `count` parts of the rows.
    times = F.when(doc_id.isNull(), count).otherwise(F.get(F.lit([found.count(c) for c in cuts]), at - 1))
    fine = F.floor(range_of("dg", 1 << 20).cast("long") * times / (1 << 20)).cast("int")
    part = F.struct(at.alias("cut"), alone.alias("alone"), F.when(alone, fine).otherwise(0).alias("range"))
    return keys, part


def with_next(docs: DataFrame) -> DataFrame:
    """doc_id, ``text`` (null: empty), ``fp`` and the next document's ``next_text`` and ``next_fp``.

    The next document is the one before in doc_id (nulls last), among rows of one doc_id by the md5 of the text; the
    last row's next is the first row. Each text is shuffled once, with its fingerprint; the first row of every part
    is fetched by a join for the last row of the part before it.
    """
    keys, part = ordered_parts(docs)
    order = [F.col("doc_id").desc_nulls_last(), F.col("dg")]
    # ~id falls as the id rises.
    place = F.struct(F.col("doc_id").isNull(), F.bitwise_not("doc_id"), F.col("dg"))
    firsts = keys.groupBy(part.alias("part")).agg(F.min(F.struct(place.alias("place"), "doc_id", "dg")).alias("head"))
    # As many rows as there are parts; the part before the first one is the last one.
    line = Window.partitionBy(F.lit(0)).orderBy("head.place")
    before = F.coalesce(F.lag("part").over(line), F.last("part").over(line.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)))
    firsts = firsts.select(before.alias("part"), F.col("head.doc_id").alias("_id"), F.col("head.dg").alias("_dg"))

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    rows = rows.withColumn("dg", F.md5("text"))
    # A row per part, so never more than some thousands.
    firsts = F.broadcast(firsts)
    heads = rows.join(firsts, rows["doc_id"].eqNullSafe(firsts["_id"]) & (rows["dg"] == firsts["_dg"]))
    heads = heads.groupBy("part").agg(F.first("text").alias("text"))
    heads = heads.select(F.col("part").alias("_part"), F.col("text").alias("_text"), fingerprint(F.col("text")).alias("_fp"))

    inside = Window.partitionBy("part").orderBy(*order)
    rows = rows.withColumn("part", part).withColumn("fp", fingerprint(F.col("text")))
    rows = rows.withColumn("next_text", F.lead("text").over(inside)).withColumn("next_fp", F.lead("fp").over(inside))
    rows = rows.join(heads, rows["part"] == heads["_part"], "left")
    return rows.select("doc_id", "text", "fp", F.coalesce("next_text", "_text").alias("next_text"), F.coalesce("next_fp", "_fp").alias("next_fp"))


def query(docs: DataFrame) -> DataFrame:
    """One row per document, in the columns of the contract.

    Null and empty texts have the empty fingerprint and are like each other only; a text of one code point is not
    edited; repeated rows each have a row; a table of one row is its own next document; an empty table gives none; other
    columns are not read.
    """
    rows = with_next(docs)
    n = F.length("text")
    half = F.floor(n / 2).cast("int")
    edited = F.concat(F.substring("text", F.lit(1), n - half), F.substring("next_text", F.lit(1), half))
    rows = rows.select("*", n.cast("long").alias("n_chars"), edited.alias("edited"))
    rows = rows.select("*", fingerprint(F.col("edited")).alias("edited_fingerprint"))
    return rows.select(
        "doc_id",
        "n_chars",
        F.sha2("edited", 256).alias("edited_sha256"),
        F.col("fp").alias("fingerprint"),
        "edited_fingerprint",
        likeness(F.col("fp"), F.col("edited_fingerprint")).alias("near_edited"),
        likeness(F.col("fp"), F.col("next_fp")).alias("near_next"),
    )


def _sql() -> str:
    words = r"list_filter(regexp_split_to_array({}, '[\x20\x09-\x0D]+'), lambda x: x <> '')"
    hashes = (
        "list_transform(range(1, greatest(len(w) - {k}, 1) + 1), lambda i: substr(md5(array_to_string(w[i:i + {k}], ' ')), 1, {d}))"
    ).format(k=SHINGLE - 1, d=DIGITS)
    limit = below(FRACTION)
    alike = (
        "case when len(list_filter(list_distinct(list_concat({a}, {b})), lambda h: h < '{t}')) > 0"
        " then len(list_filter(list_intersect({a}, {b}), lambda h: h < '{t}'))::double / len(list_filter(list_distinct(list_concat({a}, {b})), lambda h: h < '{t}'))"
        " when len({a}) + len({b}) = 0 then 1.0"
        " else case when len({a}) > 0 and len({b}) > 0 and list_min({a}) = list_min({b}) then 1.0 else 0.0 end end"
    )
    return f"""
with d as (
    select doc_id, coalesce(text, '') as text, row_number() over (order by doc_id desc nulls last, md5(coalesce(text, ''))) as k from documents
), n as (
    select d.*, coalesce(e.text, f.text) as next_text, length(d.text) // 2 as half
    from d left join d as e on e.k = d.k + 1 left join d as f on f.k = 1
), t as (
    select *, substr(text, 1, length(text) - half) || substr(next_text, 1, half) as edited from n
), s as (
    select k, 'a' as part, text as v from t union all select k, 'b', edited from t union all select k, 'c', next_text from t
), h as (
    select k, part, case when len(w) = 0 then [] else list_sort(list_distinct({hashes})) end as h from (select k, part, {words.format("v")} as w from s)
), g as (
    select k, part, case when len(list_filter(h, lambda x: x < '{limit}')) > 0 then list_filter(h, lambda x: x < '{limit}') else h[1:1] end as h from h
), p as (
    select k, max(h) filter (part = 'a') as a, max(h) filter (part = 'b') as b, max(h) filter (part = 'c') as c from g group by k
)
select doc_id, length(text)::bigint as n_chars, sha256(edited) as edited_sha256, array_to_string(a, ',') as fingerprint,
    array_to_string(b, ',') as edited_fingerprint, {alike.format(a="a", b="b", t=limit)} as near_edited, {alike.format(a="a", b="c", t=limit)} as near_next
from t join p using (k)
"""


SQL = _sql()

"""The prefix trie of conversations by whole-sequence collapse.

Conversations with the same turns are one weighted sequence with the list of its conversations. Only sequences
are cut into prefixes afterwards, one of each, whatever their weight. A prefix is known by its length and by sums of digests
of (place, turn), so sums over any parts of a conversation give the sum of the whole, and a conversation that
holds a third of all turns is split like any other.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..operators.ordering import in_parts
from .common import stored, words

#: A conversation c begins with the first turns of conversation c - c % GROUP, fewer than HEADS of them.
GROUP, HEADS = 20, 4
#: Sums of a prefix: 32 bits of a digest each, so a sum of 2**31 turns holds.
SUMS = ("_s0", "_s1", "_s2", "_s3")


def _turns(conversations: DataFrame) -> DataFrame:
    """conv_id, place (from 0), dg (digest of role and text), words, _part: stored narrow turns in their order."""
    role, text = F.coalesce("role", F.lit("")), F.coalesce("text", F.lit(""))
    # The length of the role keeps (role, text) apart from other cuts of the same characters.
    digest = F.md5(F.concat(F.length(role).cast("string"), F.lit(":"), role, text))
    rows = conversations.where("conv_id is not null").select(
        F.col("conv_id").cast("long").alias("conv_id"), "turn", digest.alias("dg"), F.size(words(text)).cast("long").alias("words")
    )
    rows = in_parts(rows, ["conv_id"], ["turn", "dg"], "trie-turns").withColumnRenamed("__part", "_part")
    return _running(rows, ["conv_id"], ["turn", "dg"], {"_n": F.lit(1)}).withColumnRenamed("_n", "place").drop("turn")


def _running(rows: DataFrame, keys: list[str], order: list[str], values: dict[str, Column]) -> DataFrame:
    """Add the sums of ``values`` over the earlier rows of the keys. ``_part`` cuts the rows of a key in order."""
    by = [*keys, "_part"]
    inside = Window.partitionBy(*by).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    earlier = Window.partitionBy(*keys).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    parts = rows.groupBy(*by).agg(*[F.sum(v).alias(n) for n, v in values.items()])
    parts = parts.select(*by, *[F.coalesce(F.sum(n).over(earlier), F.lit(0)).alias(f"_before{n}") for n in values])
    out = rows.select("*", *[F.coalesce(F.sum(v).over(inside), F.lit(0)).alias(n) for n, v in values.items()]).join(parts, by)
    return out.select(*rows.columns, *[(F.col(n) + F.col(f"_before{n}")).alias(n) for n in values])


def rebuilt(conversations: DataFrame) -> tuple[DataFrame, DataFrame]:
    """All conversations (conv_id) and their rebuilt turns (conv_id, place, dg, words, _part), stored.

    Turns stand in the order of turn, nulls first, then of a digest of role and text. Conversation c has the first h
    turns of conversation c - c % 20, then its own turns after its first h, where h = crc32(c) % 4.
    """
    turns = stored(_turns(conversations), "trie-places")
    sizes = turns.groupBy("conv_id").agg(F.count("*").alias("n"))
    own = F.pmod(F.crc32(F.col("conv_id").cast("string")), F.lit(HEADS))
    base = sizes.select(F.col("conv_id").alias("_base"), F.least("n", F.lit(HEADS - 1)).alias("_n"))
    convs = sizes.select("conv_id", own.alias("h"), (F.col("conv_id") - F.col("conv_id") % GROUP).alias("_base")).join(base, "_base", "left")
    convs = convs.select("conv_id", "h", "_base", F.least("h", F.coalesce("_n", F.lit(0))).alias("taken"))
    convs = stored(convs, "trie-conversations")
    # At most three turns of a conversation are lent, to fewer than forty others.
    lent = turns.where(F.col("place") < HEADS - 1).select(F.col("conv_id").alias("_base"), "place", "dg", "words")
    heads = lent.join(convs, "_base").where("place < taken").select("conv_id", "place", "dg", "words", F.lit(-1).alias("_part"))
    rest = turns.join(convs.select("conv_id", "h", "taken"), "conv_id").where("place >= h")
    rest = rest.select("conv_id", (F.col("place") - F.col("h") + F.col("taken")).alias("place"), "dg", "words", "_part")
    return convs.select("conv_id"), stored(heads.unionByName(rest), "trie-rebuilt")


def _lanes() -> dict[str, Column]:
    digest = F.md5(F.concat_ws(":", F.col("place").cast("string"), "dg"))
    return {n: F.conv(F.substring(digest, 8 * i + 1, 8), 16, 10).cast("long") for i, n in enumerate(SUMS)}


def _key(*sums: Column) -> list[Column]:
    """Two 64-bit hashes of the four sums."""
    return [F.xxhash64(*sums), F.xxhash64(F.lit(1), *sums[::-1])]


def _end_lists(ended: DataFrame) -> DataFrame:
    """Per sequence (k0, k1) the SHA-256 of its conv_ids, ascending, with commas between them.

    The ids are ordered in parts of bounded size, which become pieces of text; the pieces of a sequence then pass
    one after the other through the digest, so a sequence of any weight needs the memory of one piece.
    """
    parts = in_parts(ended, ["k0", "k1"], ["conv_id"], "trie-ends")
    ids = F.array_join(F.transform(F.array_sort(F.collect_list("conv_id")), lambda c: c.cast("string")), ",")
    pieces = parts.groupBy("k0", "k1", "__part").agg(ids.alias("piece"))
    pieces = pieces.repartition("k0", "k1").sortWithinPartitions("k0", "k1", "__part")

    def digests(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        key, state = None, None
        for batch in batches:
            done = []
            for k0, k1, piece in zip(batch["k0"], batch["k1"], batch["piece"], strict=True):
                if (k0, k1) == key:
                    state.update(b",")
                else:
                    if key is not None:
                        done.append((*key, state.hexdigest()))
                    key, state = (k0, k1), hashlib.sha256()
                state.update(piece.encode())
            yield pd.DataFrame(done, columns=["k0", "k1", "ends_sha256"])
        if key is not None:
            yield pd.DataFrame([(*key, state.hexdigest())], columns=["k0", "k1", "ends_sha256"])

    return pieces.select("k0", "k1", "piece").mapInPandas(digests, "k0 long, k1 long, ends_sha256 string")


def trie(convs: DataFrame, turns: DataFrame) -> DataFrame:
    """One row per node: conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256.

    ``convs`` holds every conv_id once, also of conversations without turns; ``turns`` has place (from 0), dg, words
    and _part. A node is a distinct beginning of a conversation; the root is the empty one. No conversations, no nodes.
    """
    # Whole sequences: sums per conversation, added up before the shuffle, then equal ones together.
    whole = turns.groupBy("conv_id").agg(F.count("*").alias("n"), *[F.sum(v).alias(n) for n, v in _lanes().items()])
    whole = convs.join(whole, "conv_id", "left").na.fill(0)
    k0, k1 = _key(*map(F.col, SUMS))
    ended = stored(whole.select("conv_id", F.col("n").alias("depth"), k0.alias("k0"), k1.alias("k1")), "trie-whole")
    sequences = ended.groupBy("k0", "k1", "depth").agg(F.min("conv_id").alias("conv_id"), F.count("*").alias("weight"))
    sequences = stored(sequences.join(_end_lists(ended.select("k0", "k1", "conv_id")), ["k0", "k1"]), "trie-sequences")

    # Every prefix of every sequence, the empty one first: at, its key; up, the key of the prefix one turn shorter.
    lanes = _lanes()
    rows = turns.join(sequences.select("conv_id"), "conv_id", "left_semi")
    rows = _running(rows, ["conv_id"], ["place"], lanes | {"_words": F.col("words")})
    up, at = _key(*map(F.col, SUMS)), _key(*[F.col(n) + v for n, v in lanes.items()])
    prefixes = rows.select(
        "conv_id", (F.col("place") + 1).alias("depth"), at[0].alias("k0"), at[1].alias("k1"), up[0].alias("u0"), up[1].alias("u1"),
        "words", F.col("_words").alias("words_before"),
    )
    zero = _key(*[F.lit(0).cast("long")] * len(SUMS))
    none = F.lit(0).cast("long")
    root = sequences.select(
        "conv_id", none.alias("depth"), zero[0].alias("k0"), zero[1].alias("k1"), F.lit(None).cast("long").alias("u0"),
        F.lit(None).cast("long").alias("u1"), none.alias("words"), none.alias("words_before"),
    )
    prefixes = stored(prefixes.unionByName(root), "trie-prefixes")

    # A sequence that is a proper prefix of another one is no leaf.
    node = ["k0", "k1", "depth"]
    ends = sequences.select("conv_id", "weight", F.col("depth").alias("length"))
    inner = prefixes.join(ends, "conv_id").where("depth < length").select(*node).distinct()
    leaves = sequences.join(inner, node, "left_anti").select("conv_id", F.lit(1).cast("long").alias("leaf"))
    totals = prefixes.groupBy("conv_id").agg(F.sum("words").alias("total"))
    facts = ends.join(totals, "conv_id").join(leaves, "conv_id", "left").na.fill(0, ["leaf"])

    # Weighted prefixes. Words that the conversations of a node hold from its last turn on: a sum over sequences.
    held = F.col("weight") * (F.col("total") - F.col("words_before"))
    nodes = prefixes.join(facts, "conv_id").groupBy(*node).agg(
        F.min("conv_id").alias("conv_id"), F.sum("weight").alias("n_convs"), F.sum("leaf").alias("n_leaves"), F.sum(held).alias("held"),
        F.max("words").alias("words"), F.max("words_before").alias("words_before"), F.max("u0").alias("u0"), F.max("u1").alias("u1"),
    )
    nodes = stored(nodes, "trie-nodes")

    # Words that are held once: each node counts for the sequence of its smallest conversation, whose nodes are the
    # last ones of its way. Below a node lie all of them, for its own smallest conversation those from the node on.
    owned = nodes.groupBy("conv_id").agg(F.sum("words").alias("owned"))
    below = prefixes.join(owned, "conv_id").groupBy(*node).agg(F.sum("owned").alias("below"))
    ways = owned.join(totals, "conv_id")
    children = nodes.where("depth > 0").groupBy(F.col("u0").alias("k0"), F.col("u1").alias("k1"), (F.col("depth") - 1).alias("depth"))
    children = children.agg(F.count("*").alias("n_children"))
    # The parent has the same smallest conversation, but for the first node of each sequence's own.
    first = nodes.where("depth > 0").groupBy("conv_id").agg(F.min(F.struct("depth", "u0", "u1")).alias("f"))
    first = first.select("conv_id", "f.depth", F.col("f.u0").alias("u0"), F.col("f.u1").alias("u1"))
    parent = nodes.select(F.col("k0").alias("u0"), F.col("k1").alias("u1"), (F.col("depth") + 1).alias("depth"), F.col("conv_id").alias("parent"))
    first = first.join(parent, ["u0", "u1", "depth"]).select("conv_id", "depth", "parent")

    out = nodes.join(below, node).join(ways, "conv_id").join(children, node, "left").join(first, ["conv_id", "depth"], "left")
    out = out.join(sequences.select(*node, "ends_sha256"), node, "left")
    once = F.col("below") - F.col("owned") + F.col("total") - F.col("words_before")
    return out.select(
        "conv_id",
        "depth",
        F.when(F.col("depth") > 0, F.coalesce("parent", "conv_id")).alias("parent_conv_id"),
        "n_convs",
        F.coalesce("n_children", none).alias("n_children"),
        "n_leaves",
        (F.col("held") - once).alias("saved_tokens"),
        F.coalesce("ends_sha256", F.sha2(F.lit(""), 256)).alias("ends_sha256"),
    )


def query(conversations: DataFrame) -> DataFrame:
    """The trie of the rebuilt conversations, in the columns of the contract.

    Null roles and texts are empty; turns of equal number follow a digest of role and text; repeated rows are turns of
    their own; rows without conv_id take no part; an empty table gives no nodes; other columns are not read.
    """
    return trie(*rebuilt(conversations.select("conv_id", "turn", "role", "text")))


SQL = r"""
with t as (
    select conv_id, coalesce(role, '') as role, coalesce(text, '') as text,
        row_number() over (partition by conv_id order by turn nulls first, md5(length(coalesce(role, '')) || ':' || coalesce(role, '') || coalesce(text, ''))) - 1 as place
    from conversations where conv_id is not null
), c as (
    select conv_id, count(*) as n, xor(4294967295, list_reduce(
        list_prepend(4294967295::bigint, list_transform(string_split(conv_id::varchar, ''), lambda x: ascii(x)::bigint)),
        lambda crc, b: list_reduce([xor(crc, b), 0, 0, 0, 0, 0, 0, 0, 0]::bigint[],
            lambda v, z: case when v % 2 = 1 then xor(v >> 1, 3988292384::bigint) else v >> 1 end))) % 4 as h
    from t group by conv_id
), k as (
    select c.conv_id, c.h, c.conv_id - c.conv_id % 20 as base, least(c.h, coalesce(b.n, 0)) as taken
    from c left join c as b on b.conv_id = c.conv_id - c.conv_id % 20
), r as (
    select k.conv_id, t.place, t.role, t.text from k join t on t.conv_id = k.base and t.place < k.taken
    union all
    select k.conv_id, t.place - k.h + k.taken, t.role, t.text from k join t on t.conv_id = k.conv_id and t.place >= k.h
), d as (
    select conv_id, place, len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')) as words, length(role) || ':' || length(text) || ':' || role || text as turn from r
), p as (
    select conv_id, place + 1 as depth, words, md5(array_to_string(list(md5(turn)) over w, '')) as node,
        case when place = 0 then 'root' else md5(array_to_string(list(md5(turn)) over (partition by conv_id order by place rows between unbounded preceding and 1 preceding), '')) end as up
    from d window w as (partition by conv_id order by place rows between unbounded preceding and current row)
    union all
    select conv_id, 0, 0, 'root', null from c
), n as (
    select node, depth, min(conv_id) as conv_id, max(up) as up, count(*) as n_convs, max(words) as words from p group by node, depth
), m as (
    select n.*, (select count(*) from n as x where x.up = n.node) as n_children from n
), s as (
    select p.node, sum((m.n_convs - 1) * m.words) as saved_tokens, count(*) filter (m.n_children = 0) as n_leaves
    from m join p on p.conv_id = m.conv_id and p.depth <= m.depth group by p.node
), e as (
    select node, string_agg(conv_id::varchar, ',' order by conv_id) as ends
    from (select *, max(depth) over (partition by conv_id) as last from p) where depth = last group by node
)
select m.conv_id, m.depth::bigint as depth, u.conv_id as parent_conv_id, m.n_convs::bigint as n_convs, m.n_children::bigint as n_children,
    s.n_leaves::bigint as n_leaves, s.saved_tokens::bigint as saved_tokens, sha256(coalesce(e.ends, '')) as ends_sha256
from m join s using (node) left join e using (node) left join n as u on u.node = m.up
"""

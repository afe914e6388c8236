"""N-gram Jaccard join as a T-occurrence search with DivideSkip.

A document is the set of its word shingles. Two sets link when ``den * intersection >= num * union``, so a partner
must occur in at least T = ceil(num / den * n) of the n inverted lists of a document. DivideSkip sets the T - 1
longest of these lists aside: a partner occurs in one of the remaining short lists. The steps are

1. equal sets become one class (a hot group of copies is one row from here on);
2. lists are taken as long by how often the shingle and its words occur in a bounded sample; any fixed order of the
   lists gives the same pairs. Each class enters its n - T + 1 shortest lists (the inverted index, dealt by shingle);
3. in each list, members whose sketches allow a link are gathered by asking one member after the other, never all
   pairs: members joined already are not asked again. What hangs together is a block;
4. in each block the search runs on whole sets: short lists are merged, long lists are probed by binary search,
   and documents reaching the overlap are linked.

Lists and blocks of any size are dealt into bounded parts. Each part also holds one fixed member (the anchor), and
members that are not in the largest component of their list or block afterwards ask all of its parts.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import components, stored
from .shingles import Shingler, looked_up, signature, sketch

#: Documents sampled for frequent shingles and words, from how many occurrences one is frequent, most frequent ones kept.
SAMPLE, FREQUENT, MOST_FREQUENT = 8_000, 4, 50_000
#: Members of a part of a list; documents and shingles of a part of a block.
LIST_PART, BLOCK_DOCS, BLOCK_SHINGLES = 512, 2048, 1_000_000
#: Binary probes made at once.
PROBES = 1_000_000


def frequent(docs: DataFrame, size: int, sample: int = SAMPLE) -> tuple[tuple[np.ndarray, np.ndarray], ...]:
    """Frequent words and shingles of about ``sample`` documents, sorted, with weights from their counts. Only sets an order."""
    share = min(1.0, sample / max(1, docs.count()))
    picked = docs.where(F.pmod(F.xxhash64("doc_id"), F.lit(1 << 30)) <= int(share * (1 << 30))).select("text")

    def tokens(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        hasher = Shingler(size)
        for batch in batches:
            words = [hasher.lowered(t) for t in batch["text"]]
            for kind, found in (("word", words), ("shingle", [np.unique(hasher.rolled(w)) for w in words])):
                names, counts = np.unique(np.concatenate([np.zeros(0, np.uint64), *found]), return_counts=True)
                yield pd.DataFrame({"kind": kind, "token": names.view(np.int64), "n": counts})

    counted = picked.mapInPandas(tokens, "kind string, token long, n long").groupBy("kind", "token").agg(F.sum("n").alias("n"))
    out = []
    for kind in ("word", "shingle"):
        rows = counted.where((F.col("kind") == kind) & (F.col("n") >= FREQUENT)).orderBy(F.desc("n"), "token").limit(MOST_FREQUENT).collect()
        found = np.array([r["token"] for r in rows], dtype=np.int64).view(np.uint64)
        order, n = np.argsort(found), np.array([r["n"] for r in rows], dtype=np.int64)
        out.append((found[order], np.round(4 * np.log2(n + 1)).astype(np.int64)[order]))
    return tuple(out)


def sets(docs: DataFrame, size: int, num: int, den: int, sample: int) -> DataFrame:
    """doc_id, fp and per text: n (size of the set), sig, tokens (its short lists) and sketch; null where n is 0."""
    held = docs.sparkSession.sparkContext.broadcast(frequent(docs, size, sample))
    load = 16 if 10 * num >= 9 * den else 8

    def of(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        hasher = Shingler(size)
        words, known = held.value
        for batch in batches:
            out = []
            for text in batch["text"]:
                s, weight = hasher.weighed(text, *words)
                if not len(s):
                    out.append((0, None, None, None))
                    continue
                short = len(s) - -(-num * len(s) // den) + 1
                # Shingles known as frequent come last, and of the others those of frequent words.
                order = np.argsort((looked_up(s, *known) << 16) + weight, kind="stable")
                out.append((len(s), signature(s), s[order[:short]].view(np.int64), sketch(s, load).tobytes()))
            columns = pd.DataFrame(out, columns=["n", "sig", "tokens", "sketch"], dtype=object)
            yield pd.DataFrame({"doc_id": batch["doc_id"], "fp": batch["fp"], "n": columns["n"].astype("int64"), **{c: columns[c] for c in ("sig", "tokens", "sketch")}})

    return docs.mapInPandas(of, "doc_id long, fp long, n long, sig binary, tokens array<long>, sketch binary")


class Forest:
    """Union-find over the ids that one task meets."""

    def __init__(self):
        self.parent: dict[int, int] = {}

    def find(self, x: int) -> int:
        root = x
        while (up := self.parent.get(root, root)) != root:
            root = up
        while x != root:
            self.parent[x], x = root, self.parent.get(x, x)
        return root

    def join(self, a: int, b: int) -> bool:
        a, b = self.find(a), self.find(b)
        self.parent[max(a, b)] = min(a, b)
        return a != b


Near = Callable[[int, np.ndarray], np.ndarray]


def gather(ids: np.ndarray, near: Near, forest: Forest, asks: np.ndarray | None = None) -> list[tuple[int, int]]:
    """Pairs that join the members of one part: ``near(i, others)`` names the others linked with member i.

    Without ``asks`` members ask in turn, the largest component so far excepted: of two members in different
    components at the end, one is outside the largest and has asked. With it just those members ask.
    """
    label = np.array([forest.find(x) for x in ids])
    asked, found = np.zeros(len(ids), dtype=bool), []
    todo = [0] if asks is None else list(np.flatnonzero(asks))
    while todo:
        i = todo.pop(0)
        asked[i] = True
        others = np.flatnonzero((label != label[i]) & ~asked)
        for j in near(i, others) if len(others) else ():
            if label[i] != label[j]:
                forest.join(int(ids[i]), int(ids[j]))
                found.append((int(ids[i]), int(ids[j])))
                label[label == label[j]] = label[i]
        if asks is None:
            names, counts = np.unique(label, return_counts=True)
            rest = np.flatnonzero((label != names[np.argmax(counts)]) & ~asked)
            todo = [int(rest[0])] if len(rest) else []
    return found


def by_sketch(n: np.ndarray, marks: list[bytes], num: int, den: int) -> Near:
    """Members that may link by their sizes and sketches; never misses a link."""
    sketches = [np.frombuffer(m, np.uint8).astype(np.int16) for m in marks]
    widths = np.array([len(m) for m in marks])

    def near(i: int, others: np.ndarray) -> np.ndarray:
        others = others[den * np.minimum(n[i], n[others]) >= num * np.maximum(n[i], n[others])]
        out = []
        for w in np.unique(widths[others]) if len(others) > 1 else widths[others]:
            them = others[widths[others] == w]
            width = min(w, widths[i])
            mine = sketches[i].reshape(width, -1).sum(axis=1)
            apart = np.abs(np.stack([sketches[j] for j in them]).reshape(len(them), width, -1).sum(axis=2) - mine).sum(axis=1)
            out.append(them[apart * (den + num) <= (n[i] + n[them]) * (den - num)])
        return np.concatenate(out) if out else others

    return near


def by_overlap(n: np.ndarray, shingle_sets: list[bytes], num: int, den: int) -> Near:
    """Members whose sets link, by DivideSkip over the inverted lists of this part."""
    tokens = np.concatenate([np.frombuffer(s, np.uint64) for s in shingle_sets])
    members = np.repeat(np.arange(len(n)), n)
    names, ranks = np.unique(tokens, return_inverse=True)
    own = np.split(ranks, np.cumsum(n)[:-1])
    index = np.sort(ranks.astype(np.int64) * len(n) + members)  # all lists one after the other, each in order
    ends = np.searchsorted(index, np.arange(1, len(names) + 1) * len(n))
    starts = np.concatenate(([0], ends[:-1]))

    def near(i: int, others: np.ndarray) -> np.ndarray:
        others = others[(den * np.minimum(n[i], n[others]) >= num * np.maximum(n[i], n[others]))]
        if not len(others):
            return others
        lists = own[i][np.argsort((ends - starts)[own[i]], kind="stable")]
        least = -(-num * n[i] // den)  # T: no partner shares fewer shingles
        aside = least - 1
        short, long = lists[: len(lists) - aside], lists[len(lists) - aside :]
        runs = [index[starts[t] : ends[t]] - t * len(n) for t in short]
        merged = np.bincount(np.concatenate(runs), minlength=len(n))[others]
        others, merged = others[merged > 0], merged[merged > 0]
        if not len(others):
            return others
        overlap = merged.copy()
        step = max(1, PROBES // max(1, len(long)))
        for a in range(0, len(others), step):
            probes = long[None, :] * len(n) + others[a : a + step, None]
            at = np.minimum(np.searchsorted(index, probes), len(index) - 1)
            overlap[a : a + step] += (index[at] == probes).sum(axis=1)
        return others[overlap * (den + num) >= num * (n[i] + n[others])]

    return near


def search(rows: DataFrame, kind: Callable[[np.ndarray, list[bytes], int, int], Near], num: int, den: int) -> DataFrame:
    """Linked pairs (a, b) that join the members of each part; rows: key, part, id, n, data, ask.

    The rows of a part stand together after one shuffle. ``ask`` null: all members ask in turn.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        forest, rest = Forest(), None

        def part(ids: np.ndarray, n: np.ndarray, data: np.ndarray, ask: np.ndarray) -> list[tuple[int, int]]:
            roots = {forest.find(x) for x in ids.tolist()}
            if len(roots) < 2:
                return []
            if len(set(ids.tolist())) < len(ids):
                first = np.sort(np.unique(ids, return_index=True)[1])
                ids, n, data, ask = ids[first], n[first], data[first], ask[first]
            return gather(ids, kind(n, data.tolist(), num, den), forest, None if (ask < 0).all() else ask > 0)

        def pairs(rows: pd.DataFrame) -> pd.DataFrame:
            keys, parts, *columns = (rows[c].to_numpy() for c in ("key", "part", "id", "n", "data", "ask"))
            cuts = np.flatnonzero((keys[1:] != keys[:-1]) | (parts[1:] != parts[:-1])) + 1
            found = []
            for a, b in zip([0, *cuts.tolist()], [*cuts.tolist(), len(rows)], strict=True):
                if b - a > 1:
                    found += part(*[c[a:b] for c in columns])
            return pd.DataFrame(found, columns=["a", "b"], dtype="int64")

        for batch in batches:
            rest = batch if rest is None else pd.concat([rest, batch], ignore_index=True)
            keys, parts = rest["key"].to_numpy(), rest["part"].to_numpy()
            done = np.flatnonzero((keys != keys[-1]) | (parts != parts[-1])) if len(rest) else []
            if len(done):
                yield pairs(rest.iloc[: done[-1] + 1])
                rest = rest.iloc[done[-1] + 1 :]
        if rest is not None and len(rest):
            yield pairs(rest)

    order = rows.select("key", "part", "id", "n", "data", "ask").repartition("key", "part")
    return order.sortWithinPartitions("key", "part", F.desc("ask"), "id").mapInPandas(run, "a long, b long")


def dealt(members: DataFrame) -> DataFrame:
    """Add ``part`` to key, id, parts, anchor: by a hash of the id; the anchor of a key stands in every part."""
    everywhere = F.sequence(F.lit(0), (F.col("parts") - 1).cast("int"))
    part = F.array(F.pmod(F.xxhash64("id"), F.col("parts")).cast("int"))
    return members.withColumn("part", F.explode(F.when(F.col("id") == F.col("anchor"), everywhere).otherwise(part)))


def linked(members: DataFrame, data: DataFrame, kind, num: int, den: int, name: str) -> DataFrame:
    """Pairs that join what links within each key. members (stored): key, id, parts, anchor; data: id, n, data."""
    once = dealt(members).drop("parts", "anchor").join(data, "id").withColumn("ask", F.lit(-1))
    pairs = stored(search(once, kind, num, den), name)
    large = members.where("parts > 1")
    if not large.limit(1).count():
        return pairs
    found = components(pairs, name).withColumnRenamed("node", "id")
    large = large.join(found, "id", "left").withColumn("component", F.coalesce("component", "id"))
    counts = large.groupBy("key", "component").count()
    most = counts.groupBy("key").agg(F.max_by("component", F.struct("count", "component")).alias("most"))
    outside = large.join(most, "key").where("component <> most")
    asking = outside.select("key", F.explode(F.sequence(F.lit(0), (F.col("parts") - 1).cast("int"))).alias("part"), "id", F.lit(1).alias("ask"))
    asking = stored(asking, name)
    if not asking.limit(1).count():
        return pairs
    # Only parts that somebody asks are read again.
    parts = asking.select("key", "part").distinct()
    shown = dealt(members.where("parts > 1")).select("key", "part", "id", F.lit(0).alias("ask")).join(parts, ["key", "part"], "left_semi")
    again = search(asking.union(shown).join(data, "id"), kind, num, den)
    return stored(pairs.union(again), name)


def classes(docs: DataFrame, size: int = 3, num: int = 90, den: int = 100, sample: int = SAMPLE) -> DataFrame:
    """doc_id, fp (fingerprint of the text), n_shingles, component_id and component (a number of the class) per row.

    component_id is the smallest doc_id that links reach, the document itself included. Null and empty texts and
    texts of white space have no shingles, link with nothing and have their own doc_id. Rows with equal texts are
    in one class, also repeated ones; rows with a null doc_id take part and count last. An empty table gives none.
    """
    source = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("fp"), "text")
    rows = stored(sets(source, size, num, den, sample), "jaccard-sets")
    filled = rows.where("n > 0")
    one = filled.groupBy("sig").agg(F.min("doc_id").alias("doc_id"), F.first("n").alias("n"), F.first("tokens").alias("tokens"), F.first("sketch").alias("sketch"))
    one = stored(one.withColumn("id", F.monotonically_increasing_id()), "jaccard-classes")

    per_list = Window.partitionBy("key")
    lists = one.select(F.explode("tokens").alias("key"), "id")
    lists = lists.withColumn("members", F.count("*").over(per_list)).withColumn("anchor", F.min("id").over(per_list)).where("members > 1")
    lists = lists.withColumn("parts", F.ceil(F.col("members") / LIST_PART)).drop("members")
    maybe = linked(stored(lists, "jaccard-lists"), one.select("id", "n", F.col("sketch").alias("data")), by_sketch, num, den, "jaccard-maybe")

    blocks = components(maybe, "jaccard-blocks").select(F.col("node").alias("id"), F.col("component").alias("key"))
    blocks = stored(blocks.join(one.select("id", "doc_id", "sig", "n"), "id"), "jaccard-blocks")
    weights = blocks.groupBy("key").agg(F.min("id").alias("anchor"), F.ceil(F.greatest(F.count("*") / BLOCK_DOCS, F.sum("n") / BLOCK_SHINGLES)).alias("parts"))
    members = stored(blocks.select("key", "id").join(weights, "key"), "jaccard-blocks")

    def whole(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        hasher = Shingler(size)
        for batch in batches:
            found = []
            for i, sig, text in zip(batch["id"], batch["sig"], batch["text"], strict=True):
                s = hasher.shingles(text)
                if len(s) and signature(s) == sig:  # another text of the same doc_id is not the one of this class
                    found.append((i, len(s), s.tobytes()))
            yield pd.DataFrame(found, columns=["id", "n", "data"])

    # The members of blocks grow with the corpus: both sides are shuffled at any size.
    wanted = blocks.select("id", F.col("doc_id").alias("d"), "sig").hint("merge")
    texts = source.select("doc_id", "text").join(wanted, F.col("doc_id").eqNullSafe(F.col("d")))
    whole_sets = texts.select("id", "sig", "text").mapInPandas(whole, "id long, n long, data binary").dropDuplicates(["id"])
    pairs = linked(members, whole_sets, by_overlap, num, den, "jaccard-links")

    found = components(pairs, "jaccard-components").withColumnRenamed("node", "id")
    reached = found.join(one.select("id", "doc_id"), "id")
    smallest = reached.groupBy("component").agg(F.min("doc_id").alias("component_id"))
    reached = reached.select("id", "component").join(smallest, "component")
    named = one.select("sig", "id", "doc_id").join(reached, "id", "left")
    named = named.select("sig", F.coalesce("component", "id").alias("component"), F.coalesce("component_id", "doc_id").alias("component_id"))
    out = rows.select("doc_id", "fp", "n", "sig").join(named, "sig", "left")
    own = F.when(F.col("n") > 0, F.col("component_id")).otherwise(F.col("doc_id"))
    return out.select("doc_id", "fp", F.col("n").alias("n_shingles"), own.alias("component_id"), "component")


def query(docs: DataFrame) -> DataFrame:
    """One row per document, in the columns of the contract; odd rows as in `classes`."""
    return classes(docs).select("doc_id", "n_shingles", "component_id")


def one_of_each(docs: DataFrame, size: int = 5, num: int = 80, den: int = 100) -> DataFrame:
    """The documents without near copies: of each class the row with the smallest doc_id stays, with all its columns.
    Documents without shingles all stay."""
    found = classes(docs, size, num, den).where("n_shingles > 0")
    stay = found.groupBy("component").agg(F.min_by(F.struct("doc_id", "fp"), F.struct(F.col("doc_id").isNull(), "doc_id", "fp")).alias("k"))
    stay = stored(stay.select(F.col("k.doc_id").alias("_d"), F.col("k.fp").alias("_f")), "jaccard-stay")
    marked = docs.select(F.struct("*").alias("_row"), F.col("doc_id").cast("long").alias("_doc"), F.xxhash64("text").alias("_fp"), "text")
    wordless = marked.where(F.coalesce(F.regexp_replace("text", r"[\x20\x09-\x0D]+", ""), F.lit("")) == "")
    rest = marked.where(F.regexp_replace("text", r"[\x20\x09-\x0D]+", "") != "")
    kept = rest.join(stay, F.col("_doc").eqNullSafe(F.col("_d")) & (F.col("_fp") == F.col("_f")))
    kept = kept.withColumn("_n", F.row_number().over(Window.partitionBy("_doc", "_fp").orderBy(F.lit(1)))).where("_n = 1")
    return kept.select("_row").union(wordless.select("_row")).select("_row.*")



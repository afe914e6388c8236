"""Prefix trie, fingerprints and periodic runs against plain Python."""

import hashlib
import random
import re
import zlib
from fractions import Fraction

import numpy as np
from pyspark.sql import functions as F

from flowlens.llm import fingerprints, runs, tries

SPLIT = re.compile(r"[^\x20\x09-\x0D]+")


def crc(x):
    return zlib.crc32(str(x).encode())


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


# --- prefix trie -------------------------------------------------------------------------------------------------


def plain_trie(rows):
    convs = {}
    for c, turn, role, text in rows:
        if c is not None:
            role, text = role or "", text or ""
            tie = hashlib.md5(f"{len(role)}:{role}{text}".encode()).hexdigest()
            convs.setdefault(c, []).append((turn is not None, turn or 0, tie, (role, text)))
    convs = {c: [t[-1] for t in sorted(ts)] for c, ts in convs.items()}
    whole = {}
    for c, turns in convs.items():
        h = crc(c) % 4
        base = c - (c % 20 if c >= 0 else -(-c % 20))
        whole[c] = tuple(convs.get(base, [])[:h] + turns[h:])
    members = {}
    for c, turns in whole.items():
        for d in range(len(turns) + 1):
            members.setdefault(turns[:d], []).append(c)
    out = set()
    for node, who in members.items():
        below = [n for n in members if n[: len(node)] == node]
        children = lambda x: [n for n in members if len(n) == len(x) + 1 and n[:-1] == x]
        saved = sum((len(members[n]) - 1) * (len(SPLIT.findall(n[-1][1])) if n else 0) for n in below)
        ends = ",".join(str(c) for c in sorted(c for c in who if len(whole[c]) == len(node)))
        parent = min(members[node[:-1]]) if node else None
        leaves = sum(not children(n) for n in below)
        out.add((min(who), len(node), parent, len(who), len(children(node)), leaves, saved, sha(ends)))
    return out


SCHEMA = "conv_id long, turn long, role string, text string, depth int"


def got_trie(spark, rows):
    df = spark.createDataFrame([(*r, 7) for r in rows], SCHEMA)
    return [tuple(r) for r in tries.query(df).collect()]


def test_trie_of_random_conversations(spark):
    rng = random.Random(4)
    rows = []
    for c in [*range(0, 70), -3, -20, 1000, 2001]:
        if c % 7 != 5:
            for turn in range(rng.randrange(1, 6)):
                rows.append((c, rng.choice([turn, turn, None, 3]), rng.choice(["user", None]), rng.choice(["a b", "", None, "c", "a  b c"])))
    rows += rows[:20]  # repeated rows are turns of their own
    rows += [(None, 0, "user", "x"), (None, 1, "user", "y")]
    got = got_trie(spark, rows)
    assert len(got) == len(set(got)) and set(got) == plain_trie(rows)


def test_trie_with_hot_conversation_and_hot_copies(spark):
    rows = [(40, i, "user", f"w{i % 3} x") for i in range(400)]  # a third of all turns
    rows += [(100 + c, i, "user", f"same {i}") for c in range(150) for i in range(3)]
    rows += [(1000 + c, 0, "assistant", f"only {c}") for c in range(60)]
    got = got_trie(spark, rows)
    assert set(got) == plain_trie(rows) and len(got) == len(set(got))


def test_trie_of_turnless_conversations_and_of_none(spark):
    lone = next(c for c in range(21, 40) if crc(c) % 4 > 1)  # its base is absent, and it has one turn only
    assert got_trie(spark, [(lone, 0, "user", "gone")]) == [(lone, 0, None, 1, 0, 1, 0, sha(str(lone)))]
    assert got_trie(spark, []) == []


# --- fingerprints ------------------------------------------------------------------------------------------------


def plain_sketch(text):
    w = SPLIT.findall(text)
    if not w:
        return []
    hashes = {hashlib.md5(" ".join(w[i : i + 5]).encode()).hexdigest()[:12] for i in range(max(1, len(w) - 4))}
    return sorted(h for h in hashes if h < "200000000000") or [min(hashes)]


def plain_likeness(a, b):
    union = [h for h in {*a, *b} if h < "200000000000"]
    if union:
        return sum(h in a and h in b for h in union) / len(union)
    return float(a == b)


def test_fingerprints_against_plain_python(spark):
    rng = random.Random(6)
    word = lambda: rng.choice(["é", "ab", "c", "😀x", "d" * 30]) + str(rng.randrange(40))
    texts = [" ".join(word() for _ in range(rng.choice([0, 1, 3, 5, 9, 60, 400]))) for _ in range(60)]
    rows = [(i * 3, t, 1) for i, t in enumerate(texts)]
    rows += [(6, "again " * 9, 1), (6, "again " * 9, 1), (6, None, 1), (None, "no id", 1), (None, "no id, too", 1), (500, "\n\t ", 1), (501, "x", 1)]
    rows += [(77, f"hot {i} " * 20, 1) for i in range(40)]  # one id with a third of all rows
    got = fingerprints.query(spark.createDataFrame(rows, "doc_id long, text string, part int")).collect()
    order = sorted(((i, t or "") for i, t, _ in rows), key=lambda r: (r[0] is None, -(r[0] or 0), hashlib.md5(r[1].encode()).hexdigest()))
    want = []
    for k, (i, t) in enumerate(order):
        after = order[(k + 1) % len(order)][1]
        half = len(t) // 2
        edited = t[: len(t) - half] + after[:half]
        a, b, c = map(plain_sketch, (t, edited, after))
        want.append((i, len(t), sha(edited), ",".join(a), ",".join(b), plain_likeness(a, b), plain_likeness(a, c)))
    key = lambda r: tuple(str(x) for x in r)
    assert sorted(map(tuple, got), key=key) == sorted(want, key=key)


def test_fingerprints_of_few_rows(spark):
    kind = "doc_id long, text string"
    assert fingerprints.query(spark.createDataFrame([], kind)).collect() == []
    row = fingerprints.query(spark.createDataFrame([(5, "one two three")], kind)).first()
    assert row.near_next == 1.0 and row.edited_sha256 == sha("one two" + "one tw")
    assert fingerprints.query(spark.createDataFrame([(5, None)], kind)).first().near_edited == 1.0


def test_containment_and_merging(spark):
    rng = random.Random(8)
    big = [str(rng.randrange(10**9)) for _ in range(6000)]
    part, other = big[1000:1800], [str(rng.randrange(10**9)) for _ in range(900)]
    fp = lambda c: fingerprints.fingerprint(F.col(c))
    df = spark.createDataFrame([(" ".join(big), " ".join(part), " ".join(other), "")], "a string, b string, c string, d string")
    df = df.select(*[fp(c).alias(c) for c in "abcd"]).withColumn("m", fingerprints.merged(F.col("b"), F.col("c")))
    of = lambda x, y: fingerprints.containment(F.col(x), F.col(y))
    row = df.select(of("b", "a"), of("c", "a"), of("m", "a"), of("d", "a"), of("a", "d"), of("b", "m"), of("c", "m"), "m", "b", "c").first()
    assert row[0] == 1.0 and row[1] == 0.0 and 0.35 < row[2] < 0.6 and list(row[3:7]) == [1.0, 0.0, 1.0, 1.0]
    assert row.m.split(",") == sorted({*row.b.split(","), *row.c.split(",")})


# --- periodic runs -----------------------------------------------------------------------------------------------


def plain_runs(w):
    out = []
    for q in range(1, len(w) // 4 + 1):
        i = 0
        while i < len(w) - q:
            j = i
            while j < len(w) - q and w[j] == w[j + q]:
                j += 1
            part = w[i : j + q]
            if j > i and len(part) >= max(6, 4 * q) and not any(part[p:] == part[:-p] for p in range(1, q)):
                out.append((i, len(part), q))
            i = j + 1
    return sorted(out, key=lambda r: (r[0], r[2]))


def made(rng):
    w = []
    for _ in range(rng.randrange(8)):
        part = [rng.choice("abc") for _ in range(rng.randrange(1, 8))]
        w += part * rng.choice([1, 1, 4, 5, 9]) + part[: rng.randrange(3)]
    return w


def test_catcher_finds_all_runs_however_words_arrive():
    rng = random.Random(9)
    whole, bits = runs.Catcher(), runs.Catcher(step=5)
    for _ in range(1500):
        w = made(rng)
        hashes = np.array([ord(x) for x in w], dtype=np.uint64) * np.uint64(0xFF51AFD7ED558CCD)
        for catcher in (whole, bits):
            catcher.reset()
        whole.append(hashes)
        for at in range(0, len(w), 17):
            bits.append(hashes[at : at + 17])
        assert whole.runs() == bits.runs() == plain_runs(w), w


def test_equal_sums_by_chance_lose_no_run():
    class Blunt(runs.Catcher):
        """All sums are equal, so that only the words themselves can tell."""

        def _append(self, words):
            self.words[self.n : self.n + len(words)] = words
            self.sums[:] = 0
            old, self.n = self.n, self.n + len(words)
            for level in range(5):
                if 4 << level <= self.n:
                    self._advance(1 << level, old)

    rng = random.Random(10)
    catcher = Blunt()
    for _ in range(300):
        w = made(rng)[:100]
        catcher.reset()
        catcher.append(np.array([ord(x) for x in w], dtype=np.uint64))
        assert catcher.runs() == [r for r in plain_runs(w) if r[2] < 32]


def test_periodic_runs_query(spark):
    rng = random.Random(11)
    rows = [(i, "  ".join(made(rng)) + rng.choice(["", " ", "\n"])) for i in range(150)]
    rows += [(200, None), (201, ""), (202, " \t"), (None, "a " * 9), (None, "a " * 9), (203, "é ü " * 3000), (204, "x")]
    df = spark.createDataFrame([(i, t, "r") for i, t in rows], "doc_id long, text string, runs string")
    got = sorted((tuple(r) for r in runs.query(df).collect()), key=str)
    want = []
    for i, t in rows:
        w = SPLIT.findall(t or "")
        h = 1 if i is None else crc(i)
        if h % 10 == 0 and w:
            g = h // 10
            a = g % len(w)
            p = 1 + (len(w) - a) // (3 + g % 8)
            w = w[:a] + [w[a + (k - a) % p] for k in range(a, len(w))]
        found = plain_runs(w) if len(w) < 1000 else [(0, len(w), 2)]
        gone = {k for s, n, q in found for k in range(s + q, s + n)}
        best = max(found, key=lambda r: (Fraction(r[1], r[2]), -r[0], -r[2]), default=None)
        digest = "".join(f"{s},{n},{q}\n" for s, n, q in found)
        kept = " ".join(x for k, x in enumerate(w) if k not in gone)
        want.append((i, len(found), *(best or (None,) * 3), 1000 * best[1] // best[2] if best else None, sha(digest), sha(kept)))
    assert got == sorted(want, key=str)


def test_collapse_keeps_columns(spark):
    df = spark.createDataFrame([(1, "a b a b a b a b c", None)], "collapsed int, text string, at timestamp")
    row = runs.collapse(df).first()
    assert row.collapsed == "a b c" and row["at"] is None and row.runs[0].asDict() == {"start": 0, "length": 8, "period": 2}
    assert runs.collapse(df.limit(0)).collect() == []

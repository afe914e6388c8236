"""Operators on documents: odd tables, brute-force versions, round trips, held-out accuracy."""

import hashlib
import re
import textwrap
import zlib

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from flowlens.llm import bpe, jaccard, licences, mixing, quality, sharding
from flowlens.llm.catalog import tokenizer_path
from flowlens.llm.common import ready

SMALL = "/root/testdata/sf0.01"
WORDS = re.compile(r"[^\x20\x09-\x0D]+")
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, size long, score string, id long, key string, total long, _row string"
LONG = " ".join(f"word{i % 997}x{i % 31}" for i in range(40_000))
PASSAGE = " ".join(f"shared{i}" for i in range(300))
TEXTS = [
    None, "", "   \t\n", "one", "one two", "Same text here", "Same text here", "same TEXT here", LONG, LONG + " end", "x" * 60_000,
    PASSAGE + " tail one", "head two " + PASSAGE, PASSAGE, "Café <|endoftext|> it's 123  　x\x1cy ȩ́ ﬁ ẞ İ 𝒳 👩‍👩‍👧",
    "a­b﻿c  d", "word " * 3000, "The END.\nReleased under the MIT License.",
]


def odd_rows():
    rows = [(i, t, "en", ["a", "b", None, "", "ä"][i % 5], None, 5, "s", 1, "k", 2, "r") for i, t in enumerate(TEXTS)]
    rows += [(None, "no id", None, None, None, None, None, None, None, None, None)] * 2
    return rows + [rows[5], rows[8], (3, "another text of a repeated id", "en", "a", 1, 1, "s", 1, "k", 2, "r")]


@pytest.fixture(scope="module")
def odd(spark):
    ready(spark)
    return spark.createDataFrame(odd_rows(), SCHEMA)


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="module")
def docs(spark):
    ready(spark)
    return spark.read.parquet(f"{SMALL}/documents.parquet")


@pytest.fixture(scope="module")
def labels(spark):
    return spark.read.parquet(f"{SMALL}/labels.parquet")


# --- quality -------------------------------------------------------------------------------------


def test_quality_held_out(docs, labels):
    got = {r.doc_id: r for r in quality.query(docs, labels).collect()}
    assert len(got) == docs.count() and all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.5) for r in got.values())
    assert all(r.held_out == (zlib.crc32(str(i).encode()) % 3 == 1) for i, r in got.items())
    held = [(got[r.doc_id], r.quality) for r in labels.collect() if r.doc_id in got and got[r.doc_id].held_out]
    assert np.mean([r.predicted == q for r, q in held]) > 0.97


def test_quality_ignores_held_out_labels(docs, labels):
    turned = labels.withColumn("quality", F.when(quality.held_out(), 1 - F.col("quality")).otherwise(F.col("quality")))
    a, b = (sorted((r.doc_id, r.score) for r in quality.query(docs, x).collect()) for x in (labels, turned))
    assert a == b


def test_quality_odd_rows(odd, none, docs, labels):
    got = quality.classify(odd, labels.limit(0)).collect()
    assert len(got) == odd.count() and all(r.score is not None and r.predicted in (0, 1) for r in got)
    assert {r.score for r in got} == {0.5}  # nothing to learn from
    both = docs.select("doc_id", "text").unionByName(odd.select((F.col("doc_id") + 10**6).alias("doc_id"), "text"))
    scored = quality.query(both, labels).where("doc_id is null or doc_id >= 1000000").collect()
    assert len(scored) == odd.count() and all(0 <= r.score <= 1 for r in scored)
    assert quality.query(none, labels).collect() == [] and quality.query(docs, labels.limit(0)).where("predicted = 0").count() == 0
    assert quality.stage(odd, labels).columns == odd.columns


# --- mixing --------------------------------------------------------------------------------------


def shares(sizes: dict, weights: dict, limit=3) -> dict:
    """Reshare the excess round after round."""
    left, open_, out = float(sum(sizes.values())), set(sizes), {}
    while open_:
        total = sum(weights[s] for s in open_)
        over = [s for s in open_ if left * weights[s] / total > limit * sizes[s]]
        if not over:
            return out | {s: left * weights[s] / total for s in open_}
        for s in over:
            out[s] = limit * sizes[s]
        left -= sum(out[s] for s in over)
        open_ -= set(over)
    return out


@pytest.mark.parametrize("which", ["odd", "docs"])
def test_mix(which, request):
    df = request.getfixturevalue(which)
    got = mixing.query(df).collect()
    assert sorted(map(str, got)) == sorted(map(str, mixing.query(df.repartition(3)).collect()))
    rows = df.select("source", "text").collect()
    names = sorted({r.source for r in rows}, key=lambda s: (s is None, (s or "").encode()))
    sizes = {s: sum(len(WORDS.findall(r.text or "")) for r in rows if r.source == s) for s in names}
    want = shares(sizes, {s: (5, 2, 1)[i % 3] for i, s in enumerate(names)})
    assert len(got) == len(rows)
    for s in names:
        own = [r for r in got if r.source == s]
        assert all(r.source_size == sizes[s] and r.target == pytest.approx(want[s]) and 0 <= r.taken <= 3 * r.size for r in own)
        assert abs(sum(r.taken for r in own) - want[s]) <= 1


def test_mix_nothing(none):
    assert mixing.query(none).collect() == []


def test_mix_stage(odd):
    got = mixing.stage(odd)
    assert got.columns == odd.columns and got.where("text is null or text = ''").count() == 0
    taken = {}
    for r in mixing.query(odd).collect():
        taken[r.doc_id] = taken.get(r.doc_id, 0) + (-(-r.taken // r.size) if r.size else 0)
    seen = {}
    for r in got.collect():
        seen[r.doc_id] = seen.get(r.doc_id, 0) + 1
    assert seen == {k: v for k, v in taken.items() if v}


# --- sharding ------------------------------------------------------------------------------------


@pytest.mark.parametrize("which", ["odd", "docs"])
def test_shards(which, request):
    df = request.getfixturevalue(which)
    got, rows = sharding.shard(df).collect(), df.collect()
    assert len(got) == len(rows) and {r.law for r in got} == {"rows"} and {r.grown_shard for r in got} == {None}
    want = sorted((str(r.doc_id), len((r.text or "").encode()) + 16, zlib.crc32((r.text or "").encode())) for r in rows)
    assert sorted((str(r.doc_id), r.size, r.text_crc32) for r in got) == want
    slots = {}
    for r in got:
        slots.setdefault(r.shard, []).append(r.slot)
    counts = [len(slots.get(s, [])) for s in range(40)]
    assert set(slots) <= set(range(40)) and max(counts) - min(counts) <= 1
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())


def test_shards_keep_copies_together(spark):
    rows = [(i, f"text {i // 7 if i < 700 else i}") for i in range(2000)] + [(10_000 + i, "hot") for i in range(1000)]
    got = {r.doc_id: r.shard for r in sharding.shard(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    groups = {}
    for i, text in rows:
        groups.setdefault(text, []).append(got[i])
    small = [g for t, g in groups.items() if len(g) == 7]
    assert sum(len(set(g)) == 1 for g in small) >= 0.95 * len(small)
    assert len(set(groups["hot"])) <= 20  # a third of all rows: no less than 14 shards hold them
    assert sharding.shard(spark.createDataFrame([], "doc_id long, text string")).collect() == []


def test_shards_go_on_while_cut_links_fall(spark, caplog):
    """Few unlinked documents: more rounds than eight still join copies."""
    caplog.set_level("INFO", sharding.__name__)
    rows = [(i, f"text {i // 7}") for i in range(1400)] + [(10_000 + i, "hot") for i in range(700)] + [(20_000 + i, f"one {i}") for i in range(20)]
    left = {}
    for rounds in (8, None):
        placed = sharding.shard(spark.createDataFrame(rows, "doc_id long, text string"), 40, rounds).collect()
        text, cells = dict(rows), {}
        for r in placed:
            cells[text[r.doc_id], r.shard] = cells.get((text[r.doc_id], r.shard), 0) + 1
        left[rounds] = (200 * 49 + 700**2 - sum(n * n for (t, _), n in cells.items() if not t.startswith("one"))) // 2
    assert [int(r.args[1]) for r in caplog.records] == list(left.values()) and left[None] < left[8]


# --- BPE -----------------------------------------------------------------------------------------


@pytest.fixture(scope="module")
def library():
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(tokenizer_path())
    t.no_truncation()
    t.no_padding()
    return t


def digests(library, text):
    ids = library.encode(text or "", add_special_tokens=False).ids
    decoded = library.decode(ids, skip_special_tokens=False)
    return len(ids), hashlib.sha256(np.array(ids, dtype="<u4").tobytes()).hexdigest(), hashlib.sha256(decoded.encode()).hexdigest()


def test_bpe_equals_the_library(odd, none, library):
    got = bpe.encode(odd, tokenizer_path()).collect()
    want = sorted((str(r.doc_id), *digests(library, r.text)) for r in odd.collect())
    assert sorted((str(r.doc_id), r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in got) == want
    assert bpe.encode(none, tokenizer_path()).collect() == []


def test_bpe_chunks(library):
    encoder = bpe.Encoder(open(tokenizer_path(), encoding="utf-8").read())
    texts = [t.encode() for t in TEXTS if t] + [b"", ("né́ " * 5000).encode()]
    for bits in (3, 6, 10):
        for text, chunks in zip(texts, bpe.cuts(texts, bits), strict=True):
            assert b"".join(chunks) == text
            [c.decode() for c in chunks]  # no character is cut
            for every in (1, 2):  # all chunks from the table, or every other one
                whole = bpe.Assembly(encoder)
                for i, c in enumerate(chunks):
                    whole.add_packed(bpe.packed(c, encoder)) if i % every == 0 else whole.add_text(c)
                assert whole.result() == digests(library, text.decode())


def test_bpe_reuses_passages():
    a, b = ((x + " " + PASSAGE * 20 + " " + x).encode() for x in ("first beginning", "second one"))
    one, two = bpe.cuts([a, b], 7)
    assert len(set(one) & set(two)) > 0.8 * len(set(one))


def test_bpe_refuses_other_tokenizers(spark, tmp_path):
    import json

    import public_tokenizers

    docs = spark.createDataFrame([(1, "a b")], "doc_id long, text string")
    with pytest.raises(ValueError, match="word by word"):
        bpe.encode(docs, str(public_tokenizers.path("byte_bpe_50k.json")))
    told = json.loads(open(tokenizer_path(), encoding="utf-8").read())
    for change in ({"decoder": {"type": "ByteLevel", "add_prefix_space": True, "trim_offsets": True, "use_regex": True}}, {"pre_tokenizer": None}):
        (tmp_path / "t.json").write_text(json.dumps(told | change))
        with pytest.raises(ValueError, match="word by word"):
            bpe.encode(docs, str(tmp_path / "t.json"))


def test_bpe_words_are_forgotten_and_learned_again():
    definition = open(tokenizer_path(), encoding="utf-8").read()
    whole, small = bpe.Encoder(definition), bpe.Encoder(definition, remembered=3)
    words = "Straße, don't İstanbul x1y2 (a) naïve! <|endoftext|> ... A b c; Été. ÿ× «q»".split()
    raw = [w.encode() for w in words]
    for at in range(len(raw)):
        part = raw[at : at + 4]
        assert small.words(part) == whole.words(part)
    for word in words:
        ids = whole.tokenizer.encode(word, add_special_tokens=False).ids
        assert whole.known[word.encode()] == (np.array(ids, dtype="<u4").tobytes(), whole.tokenizer.decode(ids, skip_special_tokens=False))


# --- licences ------------------------------------------------------------------------------------


def test_licences(spark, odd, none):
    mit = licences.PERMIT.upper().replace("LICENSE", "licence").replace("COPYRIGHT HOLDERS", "copyright owners").replace(" ", "  \n ", 9)
    rows = [(1, "The MIT License (MIT)\n\nCopyright (c) 2024 Somebody\n\n" + mit), (2, "Copyright 2020 X\nISC licence\n" + licences.KNOWN[4][1])]
    rows += [(3, licences.PERMIT + " more"), (4, None), (5, ""), (6, "Copyright (c) 1999 A"), (7, "text\nALL RIGHTS RESERVED!\nLicensed under CC-BY NC 4.0")]
    got = {r.doc_id: r for r in licences.scan(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert [got[i].licence for i in range(1, 8)] == ["MIT", "ISC", None, None, None, None, None]
    assert got[4].digest == got[5].digest == got[6].digest == hashlib.md5(b"").hexdigest()
    assert got[7].notice == "all-rights-reserved" and got[7].n_notices == 2
    assert licences.scan(odd).count() == odd.count() and licences.scan(none).collect() == []


def wrapped(text, width):
    """The text with other line breaks; paragraphs with a copyright line keep theirs."""
    paragraphs = re.split(r"\n\s*\n", text)
    own = re.compile(r"(?im)^\W*(copyright|\(c\)|©|portions)")
    return "\n\n".join(p if own.search(p) else "\n".join(textwrap.wrap(p, width, break_long_words=False)) for p in paragraphs)


def test_line_breaks_do_not_matter_and_sql_agrees(spark, tmp_path):
    texts = sorted(set(licences.whole_texts()))
    plain = [x for x in texts if not x[0].startswith("BSD")] + [x for x in texts if x[0].startswith("BSD")][::9]
    rows = [(1000 * i + width, name, wrapped(text, width)) for i, (name, text) in enumerate(plain) for width in range(60, 101, 4)]
    rows += [(-1 - i, None, head) for i, head in enumerate(["Copyright (c) Some Firm Inc.", "Copyright holders and contributors", "© X", None, ""])]
    df = spark.createDataFrame(rows, "doc_id long, name string, text string").repartition(8)
    got = {r.doc_id: r for r in licences.scan(df).collect()}
    assert [(i, got[i].licence) for i, name, _ in rows if got[i].licence != name] == []
    df.write.parquet(str(tmp_path / "d"))
    duck = duckdb.connect()
    duck.execute(f"create view documents as select * from '{tmp_path}/d/*.parquet'")
    cursor = duck.execute(licences.SQL)
    names = [d[0] for d in cursor.description]
    assert sorted(map(str, cursor.fetchall())) == sorted(str(tuple(r[n] for n in names)) for r in got.values())


def test_whole_licences_and_copyright_lines(spark):
    texts = dict(licences.whole_texts()[::-1])
    names = ["Apache-2.0", "BSD-2-Clause", "BSD-3-Clause", "CC-BY-SA-4.0", "CC0-1.0", "GPL-2.0", "GPL-3.0", "LGPL-2.1", "LGPL-3.0", "MPL-2.0", "Unlicense"]
    assert set(names) <= set(texts)
    rows = [(i, texts[n].upper().replace("COPYRIGHT [YYYY] [NAME OF COPYRIGHT OWNER]", "Copyright 2020 Somebody")) for i, n in enumerate(names)]
    heads = ["Copyright (c) Microsoft Corporation", "Copyright (c) [year] [fullname]", "Copyright <YEAR> <HOLDER>", "Portions Copyright 2020 X", "Copyright The Kubernetes Authors", "Copyright (c) 2020 X"]
    rows += [(100 + i, f"MIT License\n\n{head}\n\n{licences.PERMIT}") for i, head in enumerate(heads)]
    rows += [(200, "copyright notice and the rest"), (201, "copyright holders and contributors"), (202, "BSD 3-Clause License\n\nCopyright (c) 2020, X Inc.\nAll rights reserved.\n\n" + texts["BSD-3-Clause"].strip())]
    got = {r.doc_id: r for r in licences.scan(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert [got[i].licence for i in range(len(names))] == names
    assert {got[100 + i].licence for i in range(len(heads))} == {"MIT"}
    assert got[200].digest == hashlib.md5(b"copyright notice and the rest").hexdigest()
    assert got[201].digest == hashlib.md5(b"copyright holders and contributors").hexdigest() and got[202].licence == "BSD-3-Clause"


# --- near copies ---------------------------------------------------------------------------------


def brute(rows, size, num, den):
    """Component and set size of every row, by all pairs."""
    sets = []
    for _, text in rows:
        words = WORDS.findall((text or "").translate({c: c + 32 for c in range(65, 91)}))
        sets.append(frozenset(tuple(words[i : i + size]) for i in range(max(1, len(words) - size + 1))) if words else frozenset())
    parent = list(range(len(rows)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i, a in enumerate(sets):
        for j, b in enumerate(sets[:i]):
            if a and b and num * max(len(a), len(b)) <= den * min(len(a), len(b)) and den * len(a & b) >= num * len(a | b):
                parent[find(i)] = find(j)
    groups = {}
    for i in range(len(rows)):
        groups.setdefault(find(i), []).append(i)
    least = {}
    for members in groups.values():
        ids = [rows[i][0] for i in members if rows[i][0] is not None]
        least |= dict.fromkeys(members, min(ids) if ids else None)
    return groups, [(rows[i][0], len(sets[i]), least[i]) for i in range(len(rows))]


def near_copies(n=60):
    rng, rows = np.random.default_rng(3), []
    for g in range(6):
        base = [f"w{x}" for x in rng.integers(0, 4000, 200)]
        for _ in range(n if g == 0 else 6):
            words = list(base)
            for at in rng.integers(0, 200, rng.integers(0, 9)):
                words[at] = f"v{rng.integers(0, 10**6)}"
            rows.append(" ".join(words))
    chain = [f"c{i}" for i in range(400)]
    rows += [" ".join(chain[i * 5 : i * 5 + 200]) for i in range(20)]  # each near the next, the ends far apart
    return [(int(i), t) for i, t in zip(rng.permutation(len(rows)), rows, strict=True)]


@pytest.mark.parametrize(("size", "num", "parts"), [(3, 90, None), (5, 80, None), (3, 80, 4)])
def test_near_copies(spark, monkeypatch, size, num, parts):
    """Also with parts so small that lists and blocks are split."""
    if parts:
        monkeypatch.setattr(jaccard, "LIST_PART", parts)
        monkeypatch.setattr(jaccard, "BLOCK_DOCS", parts)
    rows = near_copies() + [(r[0] if r[0] is None else r[0] + 1000, r[1]) for r in odd_rows()]
    got = jaccard.classes(spark.createDataFrame(rows, "doc_id long, text string"), size, num, 100).collect()
    _, want = brute(rows, size, num, 100)
    assert sorted(map(str, ((r.doc_id, r.n_shingles, r.component_id) for r in got))) == sorted(map(str, want))


def test_near_copies_of_nothing(none):
    assert jaccard.query(none).collect() == [] and jaccard.one_of_each(none).collect() == []


def test_one_of_each(odd):
    kept = jaccard.one_of_each(odd)
    groups, want = brute([(r.doc_id, r.text) for r in odd.collect()], 5, 80, 100)
    assert kept.columns == odd.columns
    wordless = sum(1 for _, n, _ in want if n == 0)
    assert kept.count() == wordless + sum(1 for members in groups.values() if want[members[0]][1] > 0)
    ids = {r.doc_id for r in kept.collect()}
    assert {least for _, n, least in want if n > 0} <= ids

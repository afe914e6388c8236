"""Operators on pages and embeddings, and the pipeline: odd tables, brute-force versions, recall, accuracy."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from flowlens.llm import ann, catalog, html, topk, urls
from flowlens.llm.common import ready

SMALL = "/root/testdata/sf0.01"
VECTORS = "vec_id long, embedding array<float>, label int, v string, score double, leaf string, tile int"


# --- HTML ----------------------------------------------------------------------------------------

PAGES = [
    (None, ""),
    ("", ""),
    ("no markup &amp; &lt;b&gt;\n here &eacute;", "no markup & <b> here é"),
    ("<nav>Home</nav><article><h1>T</h1><p>One <b>two</b>three<br>four&nbsp;five<p>six</article><footer>f</footer>", "T One twothree four five six"),
    ("<header><h1>Site</h1></header><main><article><header><h1>T</h1></header>x<aside>side</aside>y</article></main>", "T x y"),
    ("<article><p>a<script>var t='</p>';if(a<b){}</script><style>p{}</style><!-- <p>no --><p>b</article>", "a b"),
    ("<article><p>a</p><div class='ad'>buy<div>more</div></div><p>b</p><section id=comments><article class='comment'>c</article></section></article>", "a b"),
    ("<article><p>a</p><form><p>name <input value='>'></p></form><div class=\"cookie-notice\">we</div><p title='x > y'>b < c</p>", "a b < c"),
    ("<nav>never closed <article><p>hi</p></article>", "hi"),
    ("<article><ul><li>one<li>two</ul><table><tr><td>3<td>4</table></article", "one two 3 4"),
    ("<div class=menu><a href=x>Home</a></div><div>" + "word " * 60 + "</div><div>short</div><div>© 2024 Someone</div>", " ".join(["word"] * 60 + ["short"])),
    ("<p>" + "long " * 30_000 + "</p>", " ".join(["long"] * 30_000)),
    ("<article>" + "<p>x</p>" * 5_000 + "</article>", " ".join(["x"] * 5_000)),
]


def test_html(spark):
    ready(spark)
    rows = [(i, "u", page, "clash") for i, (page, _) in enumerate(PAGES)]
    got = html.extract(spark.createDataFrame(rows + rows[:4], "page_id long, url string, html string, text string")).collect()
    assert len(got) == len(rows) + 4
    for r in got:
        assert r.text == PAGES[r.page_id][1] and r.n_chars == len(r.text), r.page_id
    assert html.extract(spark.createDataFrame([], "page_id long, url string, html string")).collect() == []


@pytest.mark.parametrize(
    "page, text",
    [
        ('<article><p>a <i aria-hidden="true"></i> b</p><p>c</p></article>', "a b c"),
        ('<article><p>a <a class="share" href=x>Share</a> b</p><p>c</p></article>', "a b c"),
        ('<article><p>a <span class="ad">buy <span>more</span> now</span> b</p><p>c</p></article>', "a b c"),
        ('<article><p>a<span class="comments-link">3 comments</span>b</p><p>c</p></article><p>d</p>', "ab c"),
        ('<article><p>a <a class="share"><div>Share <p>it</div></a> b</p><p>c</p></article>', "a b c"),
        ('<article><p>a <span class="ad">buy</p><p>b <span>c</span></p></article>', "a b c"),
        ('<article><p>a <span class="ad">buy<p>b</article>', "a b"),
        ('<article><p>a</p><div class="ad">buy<p>more</article>' + "<article><p>b</p></article>", "a b"),
        ('<span class="ad">buy <article><p>a</p></article>', "a"),
        ("<div>" + "word " * 60 + '<i aria-hidden="true"></i> on</div><div>end</div>', " ".join(["word"] * 60 + ["on", "end"])),
    ],
)
def test_html_cut_inline_elements(page, text):
    assert html.main_text(page) == text


LONG, WORDS = "<p>" + "word " * 40 + "</p>", " ".join(["word"] * 40)


@pytest.mark.parametrize(
    "page, text",
    [
        *((f"<article><p>a</p><{tag}><p>b</p></{tag.split()[0]}><p>c</p></article>", "a b c") for tag in (
            'section id="discussion"', 'section id="related-work"', 'div class="side-effects"', 'section id="search-algorithms"', 'p class="notice-period"', 'h2 id="comments"')),
        *((f"<article><p>a</p><{tag}><p>b</p></{tag.split()[0]}><p>c</p></article>", "a c") for tag in (
            'div class="related-posts"', 'div id="sidebar-right"', 'div class="search-form"', 'div class="ad-300x250"', "div class='x share'", 'div class="cookie-notice"')),
        (f'{LONG}<section id="discussion">{LONG}<p>b</p></section>{LONG}', f"{WORDS} {WORDS} b {WORDS}"),
        (f'{LONG}<div class="notice-strip">closed on Monday</div>', WORDS),
        (f"{LONG}<p>Bake each cookie for ten minutes.</p><p><a href=x>All of it</a></p><p>Copyright law</p>{LONG}", f"{WORDS} Bake each cookie for ten minutes. All of it Copyright law {WORDS}"),
        (f"{LONG}<p>Bake each cookie for ten minutes.</p><p>Cool the cookies.</p><p>Serve.</p><p>Copyright 2024 X</p><p>Log in</p>", f"{WORDS} Bake each cookie for ten minutes. Cool the cookies. Serve."),
        (f'<form action=x><input type=hidden value="{"v" * 999}"><nav>menu</nav><div>{LONG}<p>b</p></div></form>', f"{WORDS} b"),
        (f"<article><form>{LONG}<p>b</p></form></article>", f"{WORDS} b"),
        (f"{LONG}<form><p>Your name</p></form><p>b</p>", f"{WORDS} b"),
    ],
)
def test_html_loose_words_take_no_text(page, text):
    assert html.main_text(page) == text


P, Q = (f"The river ran high that {x}, and the people of the town walked down to the bridge in the evening to look at it." for x in ("spring", "fall"))


@pytest.mark.parametrize(
    "page, text",
    [
        (f'<article><p>{P}</p><p>icon <svg class="i"/> after</p><p>{Q}</p></article>', f"{P} icon after {Q}"),
        (f"<article><p>{P}</p><p>a <math/> b c</p></article>", f"{P} a b c"),
        (f"<article><!--><p>{P}</p></article>", P),
        (f"<article><!---><p>{P}</p><!-- gone --></article>", P),
        (f'<article><p>{P}</p><object data="a"><p>{Q}</p></article>', f"{P} {Q}"),
        (f"<article><p>{P}</p><p>x <math><mi>x</mi><mo>=</mo><mn>2</mn></math> holds</p></article>", f"{P} x x=2 holds"),
        (f"<nav><a>x</a><div><p>{P}</p><p>{Q}</p></div>", f"{P} {Q}"),
        (f"<nav><a>menu</a></nav><nav><a>x</a><div><p>{P}</p><p>{Q}</p></div>", f"{P} {Q}"),
        (f"<article><p>{P}</p><svg><text>no</text></svg><select><option>no</select><p>{Q}</p></article>", f"{P} {Q}"),
        (f"<article><p>{P}</p><select><option>ten<p>{Q}</p></article>", f"{P} ten {Q}"),
    ],
)
def test_html_loses_no_text_after_odd_markup(page, text):
    assert html.main_text(page) == text


CARD = '<article class="card"><h3><a href=x>Another story</a></h3><p>Short line.</p></article>'


@pytest.mark.parametrize(
    "page, text",
    [
        ("<div>" + "<p>" + "main " * 30 + "</p>" + "</div><div>" + CARD * 3 + "</div>", " ".join(["main"] * 30)),
        (CARD * 2 + "<div><p>" + "main " * 30 + "</p><p>end</p></div>", " ".join(["main"] * 30 + ["end"])),
        ("<p>" + "intro " * 40 + "</p><article><p>" + "main " * 60 + "</p></article><p>tags</p>", " ".join(["intro"] * 40 + ["main"] * 60)),
        ("<div>tagline of the site</div><article><p>hi</p></article><div>tags: x</div>", "hi"),
        ("<article><p>" + "one " * 40 + "</p></article><div>" + "two " * 90 + "</div><div>three</div>", " ".join(["one"] * 40 + ["two"] * 90 + ["three"])),
    ],
)
def test_html_window_sums_decide_on_pages_with_articles(page, text):
    assert html.main_text(page) == text


def test_html_articles(spark):
    """The article of every test page, cut out by its tags."""
    import html as references
    import re

    pages = spark.read.parquet(f"{SMALL}/pages.parquet")
    got = {r.page_id: r.text for r in html.extract(pages).collect()}
    for r in pages.collect():
        body = re.search("(?s)<article>(.*?)(</article>|$)", r.html)[1]
        assert got[r.page_id] == " ".join(references.unescape(re.sub("<[^>]*>", "", re.sub("</?(p|h1|br)>", " ", body))).split())


def test_line_blocks():
    assert html.kept([0, 0, 5, 90, 0, 3, 0, 0, 0, 2, 0], 3, 86) == [False, False, True, True, True, True, False, False, False, False, False]
    assert html.kept([1, 0, 0, 0, 4], 3, 86) == [False] * 4 + [True]
    assert html.kept([], 3, 86) == []


def test_products_of_huge_components_are_exact_and_fast():
    import time

    import numpy as np

    rng = np.random.default_rng(5)
    for _ in range(60):
        bits = rng.integers(1, 64)
        q, r = (rng.integers(-(2 ** (bits - 1)), 2 ** (bits - 1) - 1, (5, 7), dtype=np.int64, endpoint=True) for _ in range(2))
        q[0, 0], r[1, 1], r[2] = -(2**63), 2**63 - 1, -(2**63)
        want = [[max(-(2**63), min(2**63 - 1, sum(x * y for x, y in zip(a, b, strict=True)))) for b in r.tolist()] for a in q.tolist()]
        assert topk.product(q, r).tolist() == want
    wide = rng.integers(-(2**40), 2**40, (2, 3000))
    assert topk.product(wide, wide).tolist() == [[max(-(2**63), min(2**63 - 1, sum(x * y for x, y in zip(a, b, strict=True)))) for b in wide.tolist()] for a in wide.tolist()]
    q, r = rng.integers(-128, 128, (64, 64)), rng.integers(-128, 128, (2048, 64))
    q[3, 3] = 2**50
    start = time.thread_time()  # a loop over all components takes about a second
    got = topk.product(q, r)
    assert time.thread_time() - start < 0.3
    assert got[5].tolist() == (q[5] @ r.T).tolist()


# --- URLs ----------------------------------------------------------------------------------------


def plain(url):
    if url is None or "://" not in url:
        return "", ""
    rest = url.split("://", 1)[1]
    host = rest
    for mark in "/?#":
        host = host.split(mark)[0]
    path = rest[len(host) :].split("?")[0].split("#")[0]
    return host.translate({c: c + 32 for c in range(65, 91)}), path


def ruled(host, path):
    fits = [(len(h + p), h + p, v) for v, h, p in urls.RULES if (host == h or host.endswith("." + h)) and path.startswith(p)]
    return max(fits)[1:] if fits else (None, None)


def test_urls(spark):
    texts = [None, "", "nothing", "://", "http://", "HTTP://ExAmple.ORG/en/1?x#y", "https://a.example.org/es/", "https://example.org/es", "x://org", "x://org/",
             "http://myexample.org/es/", "http://b.com/fr/a?b", "ftp://com/de/", "http://É.com/de/#", "a://b://c/d", "http://h?q/fr/", "http://h#/de/", "http://a.net/en/5\nx"]
    rows = [(i, t, "clash") for i, t in enumerate(texts)] + [(3, texts[3], None)]
    frame = spark.createDataFrame(rows, "page_id long, url string, host string")
    pages = spark.read.parquet(f"{SMALL}/pages.parquet")
    got = urls.judge(frame.select("page_id", "url").unionByName(pages.select((F.col("page_id") + 1000).alias("page_id"), "url"))).collect()
    names = {r.page_id + 1000: r.url for r in pages.collect()} | dict(enumerate(texts))
    assert len(got) == len(rows) + pages.count()
    for r in got:
        assert (r.host, r.path) == plain(names[r.page_id])
        rule, verdict = ruled(r.host, r.path)
        assert r.rule == rule and r.verdict == (verdict or ("block" if r.score >= 0.5 else "allow"))
    assert urls.judge(frame).count() == len(rows)
    assert {r.verdict for r in urls.judge(frame.where("page_id in (0, 2)")).collect()} == {"allow"}
    assert urls.judge(frame.limit(0)).collect() == []


def test_url_model_learns(spark):
    """Held-out URLs of hosts that a small labelled table names by pattern."""
    rows = [(f"https://{w}{i}.example.net/{p}/{i}", y) for i in range(150) for w, p, y in (("casino", "win", 1), ("news", "story", 0), ("cheap-pills", "buy", 1), ("school", "course", 0))]
    frame = spark.createDataFrame(rows[:400], "url string, label int")
    test = spark.createDataFrame([(i, u) for i, (u, _) in enumerate(rows[400:])], "page_id long, url string")
    got = {r.page_id: r.verdict == "block" for r in urls.judge(test, frame, rules=()).collect()}
    assert np.mean([got[i] == bool(y) for i, (_, y) in enumerate(rows[400:])]) > 0.97


# --- vectors -------------------------------------------------------------------------------------


def vectors(spark):
    rng = np.random.default_rng(4)
    rows = [[i, [float(x) for x in rng.normal(size=6)]] for i in range(400)]
    rows += [[1000 + i, [0.25] * 6] for i in range(150)] + [[50, [0.25] * 6]]  # ties, a query among them; a repeated id
    rows += [[2000, None], [2050, [float("nan")] * 6], [2100, [float("inf"), 1.0, 1.0, 1.0, 1.0, 1.0]], [2150, [None, 1.0, 1.0, 1.0, 1.0, 1.0]], [None, [1.0] * 6]]
    rows += [[2200, [0.0] * 6], [2250, [3e38] * 6], [2300, [-3e38] * 6], [2350, [1.0, 2.0]], [2351, [2.0, 1.0]], [2352, []], [2400, []]]
    return spark.createDataFrame([(*r, 1, "a", 0.5, "b", 2) for r in rows], VECTORS)


def fine(v):
    return v is not None and all(x is not None and math.isfinite(x) for x in v)


def test_topk_equals_brute_force(spark):
    frame = vectors(spark)
    rows = [(r.vec_id, [min(max(math.floor(256 * x), topk.LEAST), topk.MOST) for x in r.embedding]) for r in frame.collect() if r.vec_id is not None and fine(r.embedding)]
    want = set()
    for q, v in {r[0]: min(x[1] for x in rows if x[0] == r[0]) for r in rows if r[0] % 50 == 0}.items():
        scores = [(-max(topk.LEAST, min(topk.MOST, sum(a * b for a, b in zip(v, w)))), i) for i, w in rows if i != q and len(w) == len(v)]
        want |= {(q, n + 1, i, -s) for n, (s, i) in enumerate(sorted(scores)[:5])}
    asked = topk.whole(frame)
    for tile, block in ((10_000, 10_000), (40, 3)):
        got = topk.search(asked.where("vec_id % 50 = 0"), asked, 5, tile, block).collect()
        assert {(r.query_id, r.rank, r.vec_id, r.score) for r in got} == want and len(got) == len(want)
    assert topk.query(frame.limit(0)).collect() == []


def test_topk_deals_rows_of_one_id(spark, monkeypatch):
    """A third of the rows under one id, half of them equal: tiles stay bounded and each row is a candidate."""
    rng = np.random.default_rng(5)
    rows = [(i, [int(x) for x in rng.integers(-99, 99, 4)]) for i in range(400)] + [(7, [int(x) for x in rng.integers(-99, 99, 4)]) for _ in range(100)] + [(7, [5, 5, 5, 5])] * 100
    frame = spark.createDataFrame(rows, "vec_id long, v array<long>")
    asked, sizes = frame.where("vec_id % 50 = 0"), []
    kind = type(frame.groupBy("vec_id"))
    grouped = kind.cogroup

    def counted(self, other):
        sizes.extend(r["count"] for r in other.count().collect())
        return grouped(self, other)

    monkeypatch.setattr(kind, "cogroup", counted)
    got = {(r.query_id, r.rank, r.vec_id, r.score) for r in topk.search(asked, frame, 5, 50, 1000).collect()}
    want = set()
    for q, v in {i: v for i, v in rows if i % 50 == 0}.items():
        scores = sorted((-sum(a * b for a, b in zip(v, w)), i) for i, w in rows if i != q)[:5]
        want |= {(q, n + 1, i, -s) for n, (s, i) in enumerate(scores)}
    assert got == want and max(sizes) < 100, sizes


def nearest(rows, k=5):
    out = {}
    for q, v in {r[0]: min(x[1] for x in rows if x[0] == r[0]) for r in rows if r[0] % 50 == 0}.items():
        v = np.array(v)
        scores = [(-(v @ np.array(w)) / (math.hypot(*v) * math.hypot(*w)), i) for i, w in rows if i != q and len(w) == len(v)]
        out[q] = sorted((round(s, 12), i) for s, i in scores)[:k]
    return out


@pytest.mark.parametrize("part", [None, 20])
def test_ann_finds_the_nearest(spark, monkeypatch, part):
    if part:
        monkeypatch.setattr(ann, "PART", part)
        monkeypatch.setattr(ann, "BLOCK", 3)
    frame = vectors(spark)
    rows = [(r.vec_id, r.embedding) for r in frame.collect() if r.vec_id is not None and fine(r.embedding) and any(r.embedding)]
    want, got = nearest(rows), {}
    for r in ann.query(frame).collect():
        got.setdefault(r.query_id, []).append((r.rank, r.vec_id, r.score))
    assert {q for q, w in want.items() if w} == set(got)
    hits = 0
    for q, found in got.items():
        found.sort()
        assert [r for r, _, _ in found] == list(range(1, len(want[q]) + 1))
        keys = [(round(-s, 12), i) for _, i, s in found]
        assert keys == sorted(keys)
        hits += len(set(i for _, i, _ in found) & {i for _, i in want[q]})
    assert hits >= 0.9 * sum(map(len, want.values()))
    assert ann.query(frame.limit(0)).collect() == []


def test_ann_recall(spark):
    ready(spark)
    frame = spark.read.parquet("/root/testdata/sf0.1/embeddings.parquet")
    rows = frame.orderBy("vec_id").collect()
    m = np.array([r.embedding for r in rows], dtype=float)
    m /= np.linalg.norm(m, axis=1, keepdims=True)
    hits = total = 0
    found = {}
    for r in ann.query(frame).collect():
        found.setdefault(r.query_id, set()).add(r.vec_id)
    for i, r in enumerate(rows):
        if r.vec_id % 50 == 0:
            s = m @ m[i]
            s[i] = -9
            hits, total = hits + len(found[r.vec_id] & {rows[j].vec_id for j in np.argsort(-s)[:5]}), total + 5
    assert hits / total >= 0.9


# --- pipeline ------------------------------------------------------------------------------------


def test_pipeline_of_odd_tables(spark, tmp_path):
    """Nulls in any column, empty and very long texts, repeated rows, columns named like those of the stages; no rows at all."""
    kind = "doc_id long, text string, lang string, source string, n_chars long, score int, size string, _key string, fp int"
    text = lambda i: " ".join(f"w{i * j % 97}x{j}" for j in range(12))
    rows = [(i, text(i), "en", "ab"[i % 2], 1, 1, "s", "k", 2) for i in range(12)]
    rows += [(20, text(3), None, None, None, None, None, None, None), (21, None, "en", "a", 0, 1, "s", "k", 2), (22, " ", "en", "a", 0, 1, "s", "k", 2)]
    rows += [(None, text(50), "en", None, 1, 1, "s", "k", 2), rows[1], rows[1], (23, "long " * 30_000, "en", "b", 1, 1, "s", "k", 2)]
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    spark.createDataFrame(rows, kind).write.parquet(str(tmp_path / "documents.parquet"))
    got = corpus_pipeline.run(spark, str(tmp_path)).collect()
    # Without labels nothing is rejected; copies and what has no words are gone, and what the budgets of the sources cut off.
    assert {r.doc_id for r in got} <= {*range(12), None, 23} and len({r.doc_id for r in got}) >= 5
    docs = spark.createDataFrame([], kind)
    for _, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, str(tmp_path))
        assert docs.columns == [c.split()[0] for c in kind.split(", ")] and docs.collect() == []
    assert corpus_pipeline.STAGES[-1][1](spark, docs, str(tmp_path)).collect() == []


def test_pipeline(spark):
    """Every stage on all that the one before kept; run() is the stages one after the other."""
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    columns, kept = docs.columns, [docs.count()]
    for _, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, SMALL)
        assert docs.columns == columns
        path = docs.sparkSession.conf.get("spark.checkpoint.dir") + f"/test-{len(kept)}-{id(docs)}"
        docs.write.parquet(path)
        docs = spark.read.parquet(path)
        kept.append(docs.count())
    assert kept[0] > kept[1] > kept[2] and docs.select("doc_id").distinct().count() < kept[2]
    last = corpus_pipeline.STAGES[-1][1](spark, docs, SMALL).collect()
    assert len(last) == kept[3] and {r.doc_id for r in last} == {r.doc_id for r in docs.select("doc_id").collect()}
    assert sorted(map(str, corpus_pipeline.run(spark, SMALL).collect())) == sorted(map(str, last))


def test_names():
    names = list(catalog.queries())
    assert [n.split("_")[0] for n in names] == [f"op{i}" for i in range(1, 14)] and set(catalog.oracle_sql()) < set(names)

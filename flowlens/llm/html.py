"""Main text of web pages by the line-block distribution: markup is stripped to lines, lengths are summed over
sliding windows of lines, and the text between a surge and the next dive is kept."""

from __future__ import annotations

import html as references
import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Lines per window, and the least sum at which text surges.
WINDOW, SURGE = 3, 86

#: Elements whose content is never text of a page. The first are read up to their end tag or the end of the page; the
#: others only where their end tag follows, and an empty one (``<svg/>``) ends itself.
RAW = "script|style|title|textarea|noscript|iframe|xmp|noembed|noframes"
FOREIGN = "svg|select|template|annotation|annotation-xml"
TOKEN = re.compile(
    rf"<!--(?:-?>|.*?(?:--!?>|\Z))|<({RAW})(?=[\s/>])[^>]*(?:>.*?(?:</\1(?=[\s/>])[^>]*>?|\Z)|\Z)"
    rf"|<(?:{FOREIGN})(?=[\s/])[^>]*/>|<({FOREIGN})(?=[\s/>])[^>]*>.*?</\2(?=[\s/>])[^>]*>?|<[!?][^>]*>?"
    r"|<(/?)([a-z][^\s/>]*)((?:\"[^\"]*\"|'[^']*'|[^>\"'])*+>|[^>]*>?)",
    re.S | re.I,
)
INLINE = frozenset(
    "a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark meter nobr output q rp rt ruby s"
    " samp small span strike strong sub sup time tt u var wbr img object option optgroup svg"
    # Formulas: their parts are words of the line.
    " math merror mfrac mi mn mo mover mpadded mphantom mroot mrow ms mspace msqrt mstyle msub msubsup msup mtable mtd mtext mtr"
    " munder munderover semantics".split()
)
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
CUT = frozenset("nav footer aside form menu dialog button fieldset".split())
CUT_ROLES = frozenset("navigation banner contentinfo complementary search form dialog alert alertdialog menu menubar".split())
CUT_NAMES = frozenset(
    "ad ads adv advert adverts advertisement advertising sponsor sponsored promo promotion banner cookie cookies consent gdpr"
    " notice notices alert popup modal overlay newsletter subscribe subscription sidebar side widget widgets related"
    " recommended recommendations share sharing social comment comments commentlist disqus reply replies respond"
    " discussion menu nav navbar navigation breadcrumb breadcrumbs footer header masthead topbar toolbar pagination pager"
    " login signin signup search skip".split()
)
#: Names that headings, notes and figures of a text bear too: alone they cut nothing; the second line as ids.
VAGUE = frozenset("alert cookie cookies discussion header notice notices promotion replies reply respond search side subscription".split())
VAGUE_IDS = VAGUE | frozenset(
    "advertising banner login menu navigation overlay pagination sharing signin signup social sponsor subscribe widget widgets".split()
)
#: What a clear compound of a cut name may hold besides; with one of the controls a vague name is clear, too.
CONTROLS = frozenset("bar btn button buttons form toggle".split())
FRAME = CONTROLS | frozenset(
    "area article articles block body bottom box center column container content count group holder icon icons inner label"
    " left link links list main module outer page panel post posts right section site slot title tools top unit wrap"
    " wrapper x zone".split()
)
#: Words that a class of the article itself may hold.
KEEP_NAMES = frozenset("article content post entry story body main text".split())
ATTRIBUTE = re.compile(r"([a-z-]+)\s*=\s*(\"[^\"]*\"|'[^']*'|[^\s\"'>]+)", re.I)
FILLER = re.compile(r"copyright|cookie|subscribe|sign up|log in|privacy policy|terms of", re.I)
RIGHTS = re.compile(r"©|\(c\) ?\d{4}|^copyright (?:\d|by )|all rights reserved", re.I)
SENTENCE = re.compile(r"[.!?…。！？][\"'”’»)]*$")
#: Elements whose end tag may be missing, and elements that begin after them.
LOOSE_ENDS = ("p", "li", "dt", "dd")
BEGINS = ("p", "div", "section", "article", "ul", "li", "dt", "dd", "h1", "h2", "h3")


def lines(page: str) -> Iterator[tuple[str, int, bool, int, bool]]:
    """Blocks of a page in order: text, characters inside links, whether cut as boilerplate, in which article (0: none),
    whether in an element that is vaguely named as boilerplate.

    A cut element ends with its end tag; inside an article it ends at the latest with the article, elsewhere one without
    an end tag of its own is not cut at all. One that an article begins in is given up there. A cut inline element takes its text out of the line and does not break
    it; without an end tag it ends with the block that holds it, or before the next block if no such end tag follows.
    """
    text: list[str] = []
    linked = in_link = article = articles = 0
    cut, depth, cut_inside, held = "", 0, False, 0
    hidden, deep, hidden_inside, holder = "", 0, False, ""
    vague, vague_depth = "", 0
    form_at, all_chars = re.compile(r"</?form(?=[\s/>])", re.I), -1
    inner: list[str] = []
    last: dict[str, int] = {}
    closed: dict[str, set[int]] = {}
    at = 0

    def ends_later(name: str) -> bool:
        if name not in last:
            last[name] = max((e.start() for e in re.finditer(rf"</{name}(?=[\s/>])", page, re.I)), default=-1)
        return last[name] >= at

    def closes(name: str, start: int) -> bool:
        """Whether the element that begins there has an end tag of its own, or needs none."""
        if name in LOOSE_ENDS:
            return True
        if name not in closed:
            opened: list[int] = []
            closed[name] = set()
            for tag in re.finditer(rf"<(/?){re.escape(name)}(?=[\s/>])", page, re.I):
                if not tag[1]:
                    opened.append(tag.start())
                elif opened:
                    closed[name].add(opened.pop())
        return start in closed[name]

    def shown(name: str, end: bool, attributes: str) -> bool:
        """Whether a block tag ends the hidden inline element around it."""
        if end:
            while inner:
                if inner.pop() == name:
                    return False
            return True
        if not ends_later(hidden) or name in ("article", "main") and not hidden_inside and not named_cut(attributes):
            return True
        if not inner and holder == name and name in ("p", "li", "dt", "dd", "td", "th", "tr"):
            return True
        if not attributes.endswith("/>"):
            inner.append(name)
        return False

    def is_page() -> bool:
        """Whether the form that begins here holds more than half of the characters of the page."""
        nonlocal all_chars
        if all_chars < 0:
            all_chars = len("".join(TOKEN.sub("", page).split()))
        close = form_at.search(page, at)
        return 2 * len("".join(TOKEN.sub("", page[at : close.start() if close else len(page)]).split())) > all_chars

    def block() -> tuple[str, int, bool, int, bool] | None:
        nonlocal linked
        whole = " ".join(references.unescape("".join(text)).split())
        chars, linked = linked, 0
        text.clear()
        return (whole, chars, bool(cut), articles if article else 0, bool(vague)) if whole else None

    for m in TOKEN.finditer(page):
        if m.start() > at and not hidden:
            piece = page[at : m.start()]
            text.append(piece)
            if in_link:
                linked += len(piece.strip())
        at = m.end()
        name = (m[4] or "").lower()
        if not name:
            continue
        end, attributes = m[3] == "/", m[5] or ""
        if name == "a":
            in_link = 0 if end else 1
        if name in INLINE:
            if hidden:
                deep += (-1 if end else 1) if name == hidden and name not in VOID else 0
                hidden = hidden if deep > 0 else ""
            elif not (cut or end or name in VOID or attributes.endswith("/>")) and cut_by(name, attributes, article):
                hidden, deep, hidden_inside = name, 1, article > 0
                inner.clear()
            continue
        if name == "br":
            text.append(" ")
            continue
        if name in VOID:
            continue
        if hidden:
            if not shown(name, end, attributes):
                continue
            in_link = 0 if hidden == "a" else in_link
            hidden = ""
        holder = "" if end else name
        if line := block():
            yield line
        holds = name in ("article", "main")
        if cut and holds and not end and not cut_inside and not named_cut(attributes):
            cut, depth = "", 0
        if cut and cut_inside and holds and name != cut:
            held += -1 if end else 1
            if held < 0:
                cut = ""
        if cut:
            if name == cut:
                depth += -1 if end else 1
            elif cut in LOOSE_ENDS and not end and name in BEGINS:
                depth = 0
            if depth <= 0:
                cut = ""
            else:
                continue
        opens = not end and not attributes.endswith("/>")
        if vague and (name == vague or vague in LOOSE_ENDS and opens and name in BEGINS):
            vague_depth += -1 if end or vague in LOOSE_ENDS else 1
            vague = vague if vague_depth > 0 else ""
        if opens and not vague and not holds and named_vaguely(name, attributes):
            vague, vague_depth = name, 1
        if opens and cut_by(name, attributes, article) and (article or closes(name, m.start())) and not (name == "form" and not named_cut(attributes) and is_page()):
            cut, depth, cut_inside, held = name, 1, article > 0, 0
        elif holds:
            articles += not end and not article
            article = max(0, article - 1) if end else article + 1
    if not hidden:
        text.append(page[at:])
    if line := block():
        yield line


def named_cut(attributes: str, ids: bool = True) -> bool:
    """Whether a role, a whole class or id, or a clear compound names boilerplate."""
    if "=" not in attributes:
        return False
    for key, value in ATTRIBUTE.findall(attributes):
        key, value = key.lower(), value.strip("\"'").lower()
        if key == "role" and value in CUT_ROLES or key == "aria-hidden" and value == "true":
            return True
        if key == "class" or key == "id" and ids:
            for name in value.split():
                parts = set(re.split(r"[^a-z]+", name)) - {""}
                names = parts & CUT_NAMES
                if not names or not parts <= CUT_NAMES | FRAME:
                    continue
                if len(parts) == 1:
                    clear = not names <= (VAGUE if key == "class" else VAGUE_IDS)
                else:
                    clear = not names <= VAGUE or len(names) > 1 or not parts.isdisjoint(CONTROLS)
                if clear and not own_class(key, value):
                    return True
    return False


def own_class(key: str, value: str) -> bool:
    """Whether a class is one of the article itself."""
    parts = set(re.split(r"[^a-z]+", value))
    return key == "class" and bool(parts & KEEP_NAMES) and not parts & {"comment", "comments", "ad", "ads", "related"}


def named_vaguely(name: str, attributes: str) -> bool:
    """Whether any part of a class or id is a name of boilerplate: its lines weigh less."""
    if "=" not in attributes or name in ("html", "body"):
        return False
    for key, value in ATTRIBUTE.findall(attributes):
        key, value = key.lower(), value.strip("\"'").lower()
        if key in ("class", "id") and not CUT_NAMES.isdisjoint(re.split(r"[^a-z]+", value)) and not own_class(key, value):
            return True
    return False


def cut_by(name: str, attributes: str, article: int) -> bool:
    """Whether an element is a menu, footer, sidebar, notice, advert, form or comment. A header inside the
    article holds its title and stays; the id of a heading is its anchor."""
    if name in CUT or name == "header" and not article:
        return True
    return name not in ("html", "body") and named_cut(attributes, name not in ("h1", "h2", "h3", "h4", "h5", "h6"))


def sums(weights: list[int], window: int) -> list[int]:
    """Sum of the window that begins at each line."""
    out, total = [0] * len(weights), 0
    for i in range(len(weights) - 1, -1, -1):
        total += weights[i] - (weights[i + window] if i + window < len(weights) else 0)
        out[i] = total
    return out


def weigh(found: list[tuple[str, int, bool, int, bool]], window: int, surge: int) -> list[int]:
    """Weights of the lines: characters outside links. Cut lines weigh nothing; of short lines with filler words,
    sentences weigh half and others nothing; lines in vaguely named elements outside articles weigh ``surge`` less.

    The article tag is one more weight. Where the largest article holds at least as much text as all lines outside, or
    nothing outside surges, lines of articles weigh ``surge`` more and lines outside ``surge`` less. Elsewhere articles
    that do not reach the surge (teasers) weigh ``surge`` less.
    """
    own = [0 if cut else max(0, len(t) - n) for t, n, cut, *_ in found]
    plain = []
    mass: dict[int, int] = {}
    for (t, _, cut, article, vague), w in zip(found, own, strict=True):
        if article and not cut:
            mass[article] = mass.get(article, 0) + max(1, w)
        if len(t) < surge and RIGHTS.search(t):
            w = 0
        elif len(t) < surge and FILLER.search(t):
            w = w // 2 if SENTENCE.search(t) else 0
        plain.append(max(0, w - surge) if vague and not article else w)
    outside = [0 if article else w for (*_, article, _), w in zip(found, plain, strict=True)]
    largest = max(mass.values(), default=0)
    named = largest > 0 and (largest >= sum(outside) or max(sums(outside, window)) < surge)
    weights = []
    for (_, _, cut, article, _), w, p in zip(found, own, plain, strict=True):
        if cut:
            weights.append(0)
        elif named:
            weights.append(w + surge if article else max(0, p - surge))
        else:
            weights.append(max(0, p - surge) if article and mass[article] < surge else p)
    return weights


def kept(weights: list[int], window: int, surge: int) -> list[bool]:
    """Which lines lie between a surge (the window that begins there reaches ``surge``, or the largest sum of a
    page that stays below it) and the next dive (a window of 0)."""
    ahead = sums(weights, window)
    surge = min(surge, max(ahead, default=0)) or 1
    inside, out = False, []
    for w, s in zip(weights, ahead, strict=True):
        if inside and s == 0:
            inside = False
        elif not inside and w > 0 and s >= surge:
            inside = True
        out.append(inside)
    return out


def main_text(page: str | None, window: int = WINDOW, surge: int = SURGE) -> str:
    """The main text of one page: the lines between a surge and the next dive that are not cut; empty if there is
    none."""
    found = list(lines(page or ""))
    weights = weigh(found, window, surge)
    keep = kept(weights, window, surge)
    return " ".join(t for (t, _, cut, *_), k in zip(found, keep, strict=True) if k and not cut)


def extract(pages: DataFrame, window: int = WINDOW, surge: int = SURGE) -> DataFrame:
    """page_id, url, text, n_chars of every page.

    Null or empty html gives an empty text; broken markup, missing end tags and very long pages are read to their
    end; repeated rows give repeated results; an empty table gives none; other columns are not read.
    """

    def texts(html: pd.Series) -> pd.Series:
        return html.map(lambda page: main_text(page, window, surge))

    text = F.pandas_udf(texts, "string")(F.col("html"))
    return pages.select("page_id", "url", text.alias("text")).withColumn("n_chars", F.length("text").cast("long"))

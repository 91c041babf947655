"""Main text of web pages by the maximum-scoring subsequence of words and tags.

A page is a sequence of words and tags. A word scores positive, a tag negative,
with weights learned from pages whose markup labels the article (a tag with a
class that names an outside part has a weight of its own); a linear scan finds
the contiguous region of the largest score. Elements that are never part of
an article (scripts, forms, menus, footers, notices, adverts, comments ...) are
left out by their names, roles and classes, inside the region as well. A class or
id says so only if each of its parts does or is neutral: ``cookie-box`` does,
``related-work`` and ``has-sidebar`` don't. Headings stay. An element that holds
the page's article, or without any most of its words, is a wrapper and stays;
words that also name parts of a text leave nothing out of an article. An article
that the page names (its <article> with the most words) is never cut: the tags inside it
cost nothing, so that its tables, leads and captions stay whatever the weights. Its own class
says what it is about, and leaves it out only if the page has another one.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache
from html import unescape
from math import log

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import drawn

#: About the most labelled pages that the weights are fitted on.
TRAIN_PAGES = 2000
_TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*(?:>|\Z)"
    r"|<(?:svg|math)(?:\s[^>]*)?/>"
    r"|<(script|style|noscript|template|svg|math|textarea|select|iframe|object|title)\b[^>]*>.*?(?:</\1\s*>|\Z)"
    r"""|<(/?)([a-zA-Z][a-zA-Z0-9:-]*)((?:"[^"]*"|'[^']*'|[^'">])*)(?:>|\Z)""",
    re.S | re.I,
)
_ATTRIBUTE = re.compile(r"""(?:^|\s)(class|id|role|hidden|aria-hidden|aria-label|style|itemprop)\s*(?:=\s*("[^"]*"|'[^']*'|[^\s"'>]+))?""", re.I)
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
INLINE = frozenset("a abbr acronym b bdi bdo big br cite code data del dfn em font i img ins kbd label mark q rp rt ruby s samp small span strike strong sub sup time tt u var wbr".split())
CONTENT = frozenset("p h1 h2 h3 h4 h5 h6 li ul ol dl dt dd blockquote pre table thead tbody tfoot tr td th caption figure figcaption hr details summary".split())
#: Elements, roles and parts of classes and ids of what an article leaves out.
OUTSIDE = frozenset("nav footer aside form button head menu dialog fieldset input option audio video canvas map".split())
ROLES = frozenset("navigation banner contentinfo complementary search dialog alert alertdialog menu menubar form toolbar".split())
#: These hold what readers, shops and lawyers add, however much of it a page has.
ADDED = frozenset("ad ads adv advert adverts advertisement advertisements advertising adsense sponsor sponsored sponsors cookie cookies consent gdpr newsletter comment comments commentlist disqus respond reply replies".split())
#: Inside an article these name parts of its text as well.
AMBIGUOUS = frozenset("notice notices alert alerts legal side search tags discussion foot copyright overlay skip toc banner reply replies respond related".split())
OUT = ADDED | AMBIGUOUS | frozenset("promo promos promotion promotions popup modal subscribe subscription paywall sidebar aside widget widgets recommended recommendations menu nav navbar navigation breadcrumb breadcrumbs pagination pager share sharing social footer masthead topbar login signup hidden toolbar".split())
#: Parts that only say how an element is built or where it stands.
NEUTRAL = frozenset("box block blocks wrapper wrap container area list section bar links link buttons button icons icon form item items inner outer left right top bottom main site page global primary secondary post posts article articles story stories entry module panel region holder message messages group row col column slot unit reader readers user more area thread dropdown toggle mobile desktop sticky fixed js el lg md sm xs wp".split())
MODIFIERS = frozenset("with without has no is show hide not".split())
_WHOLE = frozenset("sr-only visually-hidden screen-reader-text".split())
#: "Related" leaves something out of an article only beside these.
_SHELF = frozenset("posts articles stories links items content".split())
#: The token in place of a left-out element; it may stand inside articles, so its weight is not learned.
LEFT_OUT = "left-out"
_HIDDEN = re.compile(r"display\s*:\s*none|visibility\s*:\s*hidden", re.I)
_PARTS = re.compile(r"[A-Z]?[a-z]+|[A-Z]+(?![a-z])|[0-9]+")
_KEEP = frozenset("main body html h1 h2 h3 h4 h5 h6".split())
#: An open element is closed by these (what HTML lets authors leave out).
_CLOSES = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
_BLOCK_CLOSES_P = frozenset("address article aside blockquote details div dl fieldset figure footer form h1 h2 h3 h4 h5 h6 header hr main nav ol p pre section table ul".split())


@lru_cache(maxsize=100_000)
def _named_out(token: str) -> tuple[frozenset, bool]:
    """Of a class or id: its parts that name what is left out, if the others are neutral; and whether it is a shelf of related texts."""
    if token.lower() in _WHOLE:
        return frozenset(["hidden"]), False
    parts = [p.lower() for p in _PARTS.findall(token)]
    if parts and parts[0] in MODIFIERS:
        return frozenset(), False
    out = frozenset(p for p in parts if p in OUT)
    if not all(p in OUT or p in NEUTRAL or p in _SHELF or p.isdigit() for p in parts):
        return frozenset(), False
    return out, "related" in out and any(p in _SHELF for p in parts)


def _left_out(name: str, attributes: str, inside: bool) -> tuple[str, str]:
    """Why an element may be left out ('' if it isn't, 'element', 'class', 'added'), and the part of its class or id that says so."""
    why, part = "", ""
    if name in OUTSIDE or name == "header" and not inside:
        why = "element"
    if not attributes or name in _KEEP:
        return why, part
    for key, value in _ATTRIBUTE.findall(attributes):
        key, value = key.lower(), value.strip("\"'")
        if key == "hidden" or key == "aria-hidden" and value.lower() == "true" or key == "style" and _HIDDEN.search(value):
            return "element", part
        if key == "role" and value.lower() in ROLES:
            why = why or "element"
        elif key in ("class", "id"):
            for token in value.split():
                named, shelf = _named_out(token)
                for p in sorted(named):
                    part = part or p
                    if inside and p in AMBIGUOUS and not shelf:
                        continue
                    why = "added" if p in ADDED else why or "class"
    return why, part


class Page:
    """A page's texts and tags in order, and what its elements hold.

    ``events``: (kind, value, in article); kind 't' is a text, 'b' a tag that ends
    a block, 'i' an inline one; end tags have a leading slash. ``elements``:
    [name, why it may be left out, first event, event behind its end, words].
    """

    def __init__(self, html: str):
        self.events: list[tuple[str, str, bool]] = []
        self.elements: list[list] = []
        stack: list[int] = []
        is_open: Counter = Counter()  # open elements by name
        words, at = 0, 0
        add, elements = self.events.append, self.elements

        def close(name: str) -> None:
            while True:
                e = elements[stack.pop()]
                e[3], e[4] = len(self.events), words - e[4]
                is_open[e[0]] -= 1
                if e[0] == name:
                    return

        def text(raw: str) -> int:
            raw = unescape(raw).replace("\xa0", " ")
            if raw:
                add(("t", raw, is_open["article"] + is_open["main"] > 0))
            return len(raw.split())

        for m in _TOKEN.finditer(html):
            if m.start() > at:
                words += text(html[at : m.start()])
            at, name = m.end(), m[3]
            if name is None:
                continue
            name = name.lower()
            kind = "i" if name in INLINE else "b"
            if m[2]:
                if is_open[name]:
                    add((kind, "/" + name, is_open["article"] + is_open["main"] > (name in ("article", "main"))))
                    close(name)
                continue
            if name in _BLOCK_CLOSES_P and is_open["p"]:
                close("p")
            elif name in _CLOSES and stack and elements[stack[-1]][0] in _CLOSES[name]:
                close(elements[stack[-1]][0])
            inside = is_open["article"] + is_open["main"] > 0
            why, part = _left_out(name, m[4], inside)
            if name in VOID or m[4].endswith("/") and name not in _BLOCK_CLOSES_P and name not in INLINE:
                if not why:
                    add((kind, name, inside))
                continue
            stack.append(len(elements))
            elements.append([name, why, len(self.events), 0, words])
            is_open[name] += 1
            add((kind, f"{name}.{part}" if part else name, inside))  # the article's own edges are outside
        if at < len(html):
            words += text(re.sub(r"<[a-zA-Z/!][^>]*\Z", "", html[at:]))
        self.words = words
        while stack:
            close(elements[stack[-1]][0])

    def _article(self) -> list | None:
        """The article or main with the most words that readers and shops did not add; of a page that has none but such, the largest that lies in no other such element."""
        article, added = None, 0
        for e in self.elements:
            if e[1] == "added":
                added = max(added, e[3])
            elif e[0] in ("article", "main") and e[2] >= added and (article is None or e[4] > article[4]) and e[4]:
                article = e
        added = 0
        for e in self.elements if article is None else ():
            if e[0] == "article" and e[2] >= added and e[4] and (article is None or e[4] > article[4]):
                article = e
            if e[1] == "added":
                added = max(added, e[3])
        return article

    def kept(self) -> Iterator[tuple[tuple[str, str, bool], bool]]:
        """The events without those of left-out elements, each of which gives one LEFT_OUT; and whether they lie in the named article."""
        article = self._article()
        named = article
        if article and article[0] == "main":  # the <article> in it, if that is most of it
            within = [e for e in self.elements if e[0] == "article" and article[2] <= e[2] and e[3] <= article[3] and e[1] != "added" and 2 * e[4] > article[4]]
            named = max(within, key=lambda e: e[4], default=None)
        skipped: dict[int, int] = {}
        behind = 0
        for e in self.elements:
            _, why, first, end, words = e
            if not why or first < behind:
                continue
            holds = article and first <= article[2] and article[3] <= end
            if holds or not article and why != "added" and 2 * words > self.words:
                continue
            skipped[first] = behind = max(end, first + 1)
        at = 0
        while at < len(self.events):
            inside = named is not None and named[2] <= at < named[3]
            if at in skipped:
                yield ("b", LEFT_OUT, self.events[at][2]), inside
                at = skipped[at]
                continue
            yield self.events[at], inside
            at += 1

    def tokens(self) -> Iterator[tuple[str, str, bool]]:
        """The events of ``kept``."""
        return (event for event, _ in self.kept())


class Weights:
    """Scores of words and tags."""

    def __init__(self, inside: dict[str, int], outside: dict[str, int]):
        """Counts of words ('') and tags inside and outside the labelled articles."""
        total_in, total_out = sum(inside.values()) + 2, sum(outside.values()) + 2
        ratio = lambda k: log((inside.get(k, 0) + 0.5) / total_in) - log((outside.get(k, 0) + 0.5) / total_out)
        self.word = max(0.5, min(1.5, 1 + 0.25 * ratio("")))
        self.tags = {k: -min(12.0, max(0.25, 2 - 2 * ratio(k))) for k in {*inside, *outside} - {"", LEFT_OUT}} | {LEFT_OUT: -0.5}

    def tag(self, name: str) -> float:
        """A tag that no labelled page shows counts little if articles are made of it, more if it divides pages."""
        if "." in name and name not in self.tags:  # a class that names an outside part
            return self.tag(name.partition(".")[0]) - 2.0
        plain = name.removeprefix("/")
        return self.tags.get(name, -0.25 if plain in INLINE or plain in CONTENT else -2.0)


def main_text(html: str | None, weights: Weights) -> str:
    if not html:
        return ""
    found, best, best_at, score, start = [], 0.0, (0, 0), 0.0, 0
    for k, ((kind, value, _), named) in enumerate(Page(html).kept()):
        found.append((kind, value))
        own = len(value.split()) * weights.word if kind == "t" else weights.tag(value)
        score += max(0.0, own) if named else own
        if score < 0 or score == 0 and not named:
            score, start = 0.0, k + 1
        elif score > best or score == best > 0 and start == best_at[0]:  # of equal ones the longer
            best, best_at = score, (start, k + 1)
    blocks, block = [], []
    for kind, value in [*found[best_at[0] : best_at[1]], ("b", "")]:
        if kind == "t":
            block.append(value)
        elif kind == "b":
            if line := " ".join("".join(block).split()):
                blocks.append(line)
            block = []
        elif value in ("br", "/br", "img"):
            block.append(" ")
    return "\n".join(blocks)


def learned_weights(pages: DataFrame, train_pages: int = TRAIN_PAGES) -> Weights:
    """Weights from pages that hold an <article> or <main>, about ``train_pages`` of them at most, drawn by hash of page_id."""
    labelled = pages.where(F.col("html").rlike("(?i)<(?:article|main)[ >]")).select("page_id", "html")
    sample = drawn(labelled, train_pages, "page_id")

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        sums: Counter = Counter()
        for batch in batches:
            for html in batch["html"]:
                for kind, value, inside in Page(html).tokens() if html else ():
                    if kind == "t":
                        sums["", inside] += len(value.split())
                    else:
                        sums[value, inside] += 1
        yield pd.DataFrame([(k, i, n) for (k, i), n in sums.items()], columns=["token", "inside", "n"])

    counted = sample.select("html").mapInPandas(count, "token string, inside boolean, n long")
    # As many names as the sampled pages use more than once; the others weigh like tags that no page shows.
    names = counted.groupBy("token", "inside").agg(F.sum("n").alias("n")).where("n > 1").collect()
    return Weights({r["token"]: r["n"] for r in names if r["inside"]}, {r["token"]: r["n"] for r in names if not r["inside"]})


def extracted(pages: DataFrame, train_pages: int = TRAIN_PAGES) -> DataFrame:
    """(page_id, url, html) -> page_id, url, text, n_chars; one row per row.

    Null, empty and textless pages give an empty text. Cut-off pages are read to
    their end. Where two regions score the same, the first wins, and of those that
    begin together the longest. Repeated rows
    are each extracted; other columns are ignored; an empty table gives no rows.
    """
    shared = pages.sparkSession.sparkContext.broadcast(learned_weights(pages, train_pages))

    @F.pandas_udf("string")
    def text(html: pd.Series) -> pd.Series:
        return pd.Series([main_text(h, shared.value) for h in html], dtype=object)

    out = pages.select("page_id", "url", text("html").alias("text"))
    return out.select("*", F.length("text").cast("long").alias("n_chars"))

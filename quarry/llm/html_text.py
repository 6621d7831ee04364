"""HTML main text with site template removal (operator 3).

One pass reads each whole page into its elements, drops those that their markup names as boilerplate
(menus, headers, footers, sidebars, notices, adverts, forms, scripts, styles, reader comments), cuts the
rest into text blocks, and hashes the page's element subtrees.  Spark counts the hashes per host, each once a
page; a subtree that recurs on at least ``MIN_PAGES`` pages is site template, whatever the size of its
host, and the text under it is deleted from all pages of the host.  From 100 to 200 pages of a host the bar
grows to ``MOST_PAGES``, so that a few copies of a page among many do not delete it.

Text of an article (``article``, ``main``, or an element marked as the article's body) is the
author's even where it recurs: there only containers (lists, sections, tables, divisions) count as
subtrees, not paragraphs, headings, quotes or code.  A page without such an element is its whole
body, there all block elements count, and lists of links go.

What is dropped is decided when the page's elements are known.  An element around a ``main`` is never
dropped.  A form, or an element with a boilerplate word somewhere in its names (``content-sidebar-wrap``),
is a layout wrapper where it holds an article or, on pages without one, most of the text.  An element
that is boilerplate by its tag or by a whole name (``aside``, ``related``) goes with the articles in it
(teasers) only where the page has its article elsewhere.  In an article, ids and parts of names say
nothing: headings and sections are named after their own words there.

The page rows are written once and only pages that have text under a counted subtree meet the
template table; the HTML itself is never shuffled.

Defined results: null or empty html gives an empty text; a page whose url is null or has no host
keeps what its markup leaves; null page_ids and repeated rows are rows like others; extra columns are ignored; broken
markup is read to its end as browsers do (unclosed elements end with their parent).
"""

from __future__ import annotations

import html as htmllib
import re
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry.llm.common import table, written

#: Pages on which a subtree is template: 5 % of its host's, between these bounds.
MIN_PAGES, MOST_PAGES = 5, 10
#: Links' share of a list's or division's text beyond which it is a menu, on pages without article.
LINK_SHARE = 0.6

VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Elements whose content is no text of the page.
DROPPED = frozenset("head nav footer aside form iframe object svg canvas button select dialog menu noscript template "
                    "datalist audio video map applet frameset annotation annotation-xml".split())
#: Those that browsers show nothing of, or not as part of the page: an article in them is none.
UNSEEN = frozenset("head iframe object svg canvas button select template datalist audio video applet annotation "
                   "annotation-xml".split())
#: Start tags that leave an open head open.
IN_HEAD = frozenset("base basefont bgsound head html link meta noscript script style template title".split())
RAW = "script|style|textarea|title|xmp|noembed|noframes|plaintext"
BLOCKS = frozenset("address article aside blockquote body caption center dd details dialog dir div dl dt fieldset "
                   "figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol "
                   "p pre search section summary table tbody td tfoot th thead tr ul".split())
#: Blocks that are text themselves: they are the author's inside an article.
TEXTUAL = frozenset("p h1 h2 h3 h4 h5 h6 blockquote pre li dt dd td th tr figcaption caption hr".split())
#: Start tags that end an open element of the first set, up to the nearest of the second.
ENDS_P = BLOCKS - {"td", "th", "tr", "caption", "body", "html", "tbody", "thead", "tfoot", "li", "dt", "dd", "legend",
                   "summary"}
CLOSES = {"li": ({"li"}, {"ul", "ol", "menu"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}),
          "tr": ({"tr", "td", "th"}, {"table"}), "td": ({"td", "th"}, {"tr", "table"}),
          "th": ({"td", "th"}, {"tr", "table"}), "tbody": ({"tbody", "thead", "tfoot", "tr", "td", "th"}, {"table"})}
#: Words of class, id and role values that name boilerplate.
BOILERPLATE = frozenset(
    "ad ads advert adverts advertisement advertising adsense adslot banner sponsor sponsored promo promotion nav navbar "
    "navigation navi menu submenu breadcrumb breadcrumbs sidebar aside footer masthead topbar toolbar cookie cookies "
    "consent gdpr notice popup modal overlay newsletter subscribe signup login search social share sharing related "
    "recommended recommendations pagination pager comment comments reply replies disqus respond widget widgets "
    "complementary contentinfo dialog alert skip".split())
#: Words beside which a boilerplate word still makes a whole name ("share-buttons", "comments-area").
NEUTRAL = frozenset("area bar box button buttons container inner link links list posts slot wrap wrapper".split())
#: Words of readers' comments, those beside them in ids, and those by which an article's name only tells whether it has any.
COMMENTS = frozenset("comment comments reply replies".split())
COMMENT_PARTS = frozenset("body content div item".split())
STATES = frozenset("allow closed count disabled enabled has no off on open with without".split())
_TAG = re.compile(
    rf"""<!--.*?(?:-->|\Z)|<({RAW})\b[^>]*>.*?(?:</\1\s*>|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:[^>"']++|"[^"]*+"|'[^']*+')*+)>"""
    r"""|<(/?)([a-zA-Z][^\s/>]*)([^>]*+)(?:>|\Z)|<[!?/][^>]*+(?:>|\Z)""", re.S | re.I)
_ATTRIBUTE = re.compile(r"""\b(class|id|role|itemprop|hidden|aria-hidden)\b(?:\s*=\s*("[^"]*"|'[^']*'|[^\s"'>]+))?""", re.I)
_NAME_WORDS = re.compile(r"[A-Z]?[a-z]+|[A-Z]+(?![a-z])")


@dataclass(slots=True)
class Element:
    tag: str
    start: int
    parent: int
    body: bool = False      # main, article, or marked as the article's body
    hidden: bool = False
    named: bool = False     # a class or role name says nothing but boilerplate ("related"),
    nearly: bool = False    # or does beside neutral words ("related-posts"),
    id_named: bool = False  # or the id says nothing else,
    worded: bool = False    # or a word of class, id or role is boilerplate
    readers: bool = False   # in or at readers' comments
    unseen: bool = False    # in or at an element whose content is no text of the page
    main: bool = False      # is or holds a main
    article: bool = False   # is or holds another article
    chars: int = 0
    # as decided
    dropped: bool = False
    top: bool = False       # is the article or its body
    inside: bool = False    # in or at the article
    own: int | None = None  # number of its subtree, if that is counted


def _words(names: str) -> set[str]:
    return {w.lower() for w in _NAME_WORDS.findall(names)}


def _mark(e: Element, attributes: str) -> None:
    """What the names of an element say of it."""
    for name, value in _ATTRIBUTE.findall(attributes):
        name, value = name.lower(), value.strip("\"'")
        if name == "hidden" or name == "aria-hidden" and value.lower() == "true":
            e.hidden = True
        elif name == "itemprop":
            e.body |= "articlebody" in value.lower().split()
        elif name in ("class", "id", "role"):
            e.body |= name == "role" and value.lower() in ("main", "article")
            if not _words(value) & BOILERPLATE:
                continue
            e.worded = True
            for words in map(_words, value.split()):
                if not words & BOILERPLATE:
                    continue
                if name == "id":
                    e.id_named |= words <= BOILERPLATE
                    e.readers |= bool(words & COMMENTS) and words <= COMMENTS | COMMENT_PARTS and e.tag == "article"
                else:
                    e.named |= words <= BOILERPLATE
                    e.nearly |= words <= BOILERPLATE | NEUTRAL
                    e.readers |= bool(words & COMMENTS) and (words <= BOILERPLATE | NEUTRAL or e.tag == "article"
                                                             and not words & STATES)


def _elements(page: str) -> tuple[list[Element], list[tuple]]:
    """The page's elements in order, and what happens at them: ("open", element), ("close", element,
    position), ("text", string), and ("end",) where a text block ends."""
    elements = [Element("#page", 0, 0)]
    events: list[tuple] = []
    stack = [0]
    tags = ["#page"]

    def close(until: int, at: int) -> None:
        while len(stack) > until:
            events.append(("close", stack.pop(), at))
            tags.pop()

    def last(of: frozenset | set | tuple) -> int:
        return next((k for k in range(len(tags) - 1, 0, -1) if tags[k] in of), 0)

    def add(raw: str) -> None:
        if raw:
            if tags[-1] == "head" and not raw.isspace():
                close(len(stack) - 1, at)
            e = elements[stack[-1]]
            e.chars += len(raw) - raw.count(" ")
            events.append(("text", raw))

    at = 0
    for m in _TAG.finditer(page):
        add(page[at:m.start()])
        at = m.end()
        raw, slash, tag, attributes = m[1], m[2], m[3], m[4]
        if tag is None and m[6]:
            slash, tag, attributes = m[5], m[6], m[7]
            if not m[0].endswith(">"):
                break
        if raw or not tag:
            continue
        tag = tag.lower()
        if slash:
            if tag == "a":
                events.append(("unlink",))
            where = last((tag,))
            if where and (tag in BLOCKS or not any(t in BLOCKS for t in tags[where + 1:])):
                close(where, m.end())
            elif tag in BLOCKS and not where:
                events.append(("end",))
            continue
        # the head ends where something of the body begins; a second one is ignored
        if tag == "body" and "head" in tags:
            close(tags.index("head"), m.start())
        elif tags[-1] == "head" and tag not in IN_HEAD:
            close(len(stack) - 1, m.start())
        if tag == "head" and ("head" in tags or "body" in tags):
            continue
        if tag == "br":
            add(" ")
            continue
        if tag in CLOSES:
            ends, stop = CLOSES[tag]
            where = last(ends | stop)
            if where and tags[where] not in stop:
                close(where, m.start())
        elif tag in ENDS_P:
            where = last(("p", "table", "td", "th"))
            if where and tags[where] == "p":
                close(where, m.start())
        if tag in BLOCKS:
            events.append(("end",))
        if tag in VOID:
            continue
        parent = stack[-1]
        e = Element(tag, m.start(), parent, tag in ("article", "main"))
        if attributes:
            _mark(e, attributes)
        e.unseen = elements[parent].unseen or tag in UNSEEN
        e.readers |= elements[parent].readers
        e.body = e.body and not e.unseen and not e.hidden and (tag == "main" or not e.readers)
        if tag == "a":
            events.append(("link",))
        stack.append(len(elements))
        tags.append(tag)
        events.append(("open", len(elements)))
        elements.append(e)
    else:
        add(page[at:])
    close(1, len(page))
    return elements, events


def _strict(e: Element, inside: bool) -> bool:
    """Boilerplate by its tag or a whole name."""
    return (e.tag in DROPPED and e.tag != "form" or e.hidden or e.tag == "header" and not inside
            or not e.body and (e.named or e.tag == "article" and e.readers or e.id_named and not inside))


def _decide(elements: list[Element]) -> bool:
    """Sets what is dropped and what is in the article; whether the page has one."""
    outer = ("html", "body")
    for e in reversed(elements[1:]):
        e.main |= e.body and e.tag == "main"
        e.article |= e.body and e.tag != "main"
        up = elements[e.parent]
        up.main |= e.main
        up.article |= e.article
    page = elements[0]
    # whether an article is in nothing that is boilerplate by tag or name
    free, sure, strict = False, [False], [False]
    for e in elements[1:]:
        up = elements[e.parent]
        e.inside = up.inside or e.body
        own = e.tag not in outer and not e.main and _strict(e, up.inside)
        strict.append(strict[e.parent] or own)
        sure.append(sure[e.parent] or own or e.nearly and not e.body and not e.main and e.tag not in outer)
        free |= e.body and e.tag != "main" and not sure[-1]
    # characters of what is not boilerplate by tag or whole name
    for k in range(len(elements) - 1, 0, -1):
        if strict[k]:
            elements[k].chars = 0
        elements[elements[k].parent].chars += elements[k].chars
    has_article = False
    for e in elements[1:]:
        up = elements[e.parent]
        e.dropped, e.inside = up.dropped, up.inside
        if up.dropped or e.tag in outer:
            continue
        only = e.main or e.article and not free and (up.inside or not page.main)
        most = 2 * e.chars > page.chars and (e.tag == "form" or not (page.main or page.article))
        if _strict(e, up.inside):
            e.dropped = e.unseen or not only
        elif e.nearly and not e.body:
            e.dropped = not (only or most)
        elif e.tag == "form" or e.worded and not up.inside and not e.body:
            e.dropped = not (e.main or e.article or most)
        e.top = e.body and not e.dropped
        e.inside |= e.top
        has_article |= e.top
    return has_article


def parse(page: str) -> tuple[list[tuple[str, list[int], bool, bool]], list[int], bool]:
    """(blocks, subtree hashes, has article): a block is its text, the numbers of the counted
    subtrees around it, whether it is in the article, and whether it is mostly links."""
    from xxhash import xxh64_intdigest

    elements, events = _elements(page)
    has_article = _decide(elements)
    stack = [elements[0]]
    blocks: list[list] = []
    spans: list[list[int]] = []
    parts: list[str] = []
    linked = False
    link_chars = 0

    def end_block() -> None:
        nonlocal link_chars
        if parts:
            text = " ".join("".join(parts).split())
            if text:
                under = [e.own for e in stack if e.own is not None]
                chars = sum(map(len, parts))
                blocks.append([text, under, stack[-1].inside, link_chars > LINK_SHARE * chars])
            parts.clear()
        link_chars = 0

    for event in events:
        kind = event[0]
        if kind == "text":
            if not stack[-1].dropped:
                text = htmllib.unescape(event[1]) if "&" in event[1] else event[1]
                parts.append(text)
                if linked:
                    link_chars += len(text)
        elif kind == "open":
            e = elements[event[1]]
            # subtrees: block elements, in the article only containers, never the article itself
            if e.tag in BLOCKS and e.tag not in ("html", "body") and not e.top and not (stack[-1].inside and e.tag in TEXTUAL):
                e.own = len(spans)
                spans.append([e.start, len(page)])
            stack.append(e)
        elif kind == "close":
            e = stack[-1]
            if e.tag in BLOCKS:
                end_block()
            if e.own is not None:
                spans[e.own][1] = event[2]
            stack.pop()
        elif kind == "end":
            end_block()
        else:
            linked = kind == "link"
    end_block()
    hashes = [xxh64_intdigest(page[a:b].encode()) - (1 << 63) for a, b in spans]
    return [(t, [hashes[k] for k in under], inside, menu) for t, under, inside, menu in blocks], hashes, has_article


def page_rows(pages: DataFrame) -> DataFrame:
    """(row, page_id, url, host, content, blocks, hashes): a hash of the html, blocks of the article, or of a page without one all
    but its menus; ``under`` are the counted subtrees around a block."""
    block = pa.struct([("text", pa.string()), ("under", pa.list_(pa.int64()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts, hashes = [], []
            for page in batch.column(3):
                blocks, own, article = parse(page.as_py() or "")
                texts.append([{"text": t, "under": sorted(set(under))} for t, under, inside, menu in blocks
                              if (inside if article else not menu)])
                hashes.append(sorted(set(own)))
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[:3], batch.column(4), pa.array(texts, pa.list_(block)),
                 pa.array(hashes, pa.list_(pa.int64()))],
                names=["page_id", "url", "host", "content", "blocks", "hashes"])

    host = F.lower(F.regexp_extract(F.coalesce("url", F.lit("")), r"^[a-zA-Z][a-zA-Z0-9+.\-]*://([^/?#]*)", 1))
    kind = pages.schema["page_id"].dataType.simpleString()
    return pages.select("page_id", "url", host.alias("host"), "html", F.xxhash64("html").alias("content")).mapInArrow(
        run, f"page_id {kind}, url string, host string, content long, blocks array<struct<text:string,under:array<bigint>>>, "
             "hashes array<bigint>").withColumn("row", F.monotonically_increasing_id())


def templates(rows: DataFrame) -> DataFrame:
    """(host, hash) of the subtrees that recur across many pages of the host; equal pages are one."""
    own = rows.where(F.col("host") != "").groupBy("host", "content").agg(F.first("hashes").alias("hashes"))
    pages = own.groupBy("host").agg(F.count("*").alias("pages"))
    counts = own.select("host", F.explode("hashes").alias("hash")).groupBy("host", "hash").agg(
        F.count("*").alias("n")).where(F.col("n") >= MIN_PAGES)
    return counts.join(pages, "host").where(F.col("n") >= F.least(0.05 * F.col("pages"), F.lit(MOST_PAGES))).select(
        "host", "hash")


def main_texts(pages: DataFrame) -> DataFrame:
    """(page_id, url, text, n_chars) of every row."""
    rows = written(page_rows(pages), "pages")
    under = F.array_distinct(F.flatten(F.transform("blocks", lambda b: b.under)))
    touched = F.exists("blocks", lambda b: F.size(b.under) > 0)
    gone = (rows.where(touched).select("row", "host", F.explode(under).alias("hash"))
            .join(templates(rows).hint("merge"), ["host", "hash"]).groupBy("row").agg(F.collect_set("hash").alias("gone")))
    done = rows.where(~F.coalesce(touched, F.lit(False))).select("page_id", "url", "blocks")
    cut = rows.where(touched).select("row", "page_id", "url", "blocks").join(gone, "row", "left").select(
        "page_id", "url", F.when(F.col("gone").isNull(), F.col("blocks")).otherwise(
            F.filter("blocks", lambda b: ~F.arrays_overlap(b.under, F.col("gone")))).alias("blocks"))
    text = F.array_join(F.transform("blocks", lambda b: b.text), "\n")
    return done.unionByName(cut).select("page_id", "url", F.coalesce(text, F.lit("")).alias("text")).withColumn(
        "n_chars", F.char_length("text").cast("long"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return main_texts(table(spark, sf_dir, "pages"))

"""Main text of web pages: site template removal by subtree hashes, then structure and names for what differs between pages.

Every page is parsed in time linear in its length into elements and blocks of text.

1. Site templates: the subtree of each block element of the whole page, menus, headers and footers among them, is hashed over
   its tag, text and children, and the pages of a host that hold a hash are counted in Spark. Subtrees that at least
   LEAST_PAGES different pages and the share LEAST_SHARE of the host's different pages hold are deleted. Paragraphs, headings
   and the like within an article or main element are its own words, however many pages quote them, and are never taken for a
   template; other elements inside, and all elements where there is neither, can be.
2. What no count can find, as it changes from page to page (adverts, comments, the menu that marks its page) or as the host has
   too few pages, goes by structure: navigation, page headers, footers, sidebars, forms, scripts, styles, hidden parts, and
   elements whose class, id or role names an advert, a notice, comments and the like.
3. What remains of all article elements is the text; of main elements where there is no article; else of the body.

Hashes are counted with map-side sums, so a host with a third of all pages is no hot task. What comes back are templates by
host, few as each takes a share of the host's pages; they are broadcast where their size is small, and else joined by host.

Cases: null or empty html, or a page without an article's text, gives an empty string; null urls make one host without a name;
repeated rows and pages of equal html count as one page and get equal texts; tags that are never closed end with the page; a
page_id that is null or repeated is carried along.
"""

from __future__ import annotations

import re
from collections.abc import Container, Iterator
from html import unescape

import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import cut, map_rows, table

LEAST_PAGES, LEAST_SHARE = 8, 0.25

# Names of HTML elements by what they mean here.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style title textarea noscript iframe xmp noembed noframes template".split())
DROPPED = frozenset("nav footer aside form menu dialog select button svg object canvas audio video map head datalist".split())
BLOCKS = frozenset(
    "address article aside blockquote body center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr html li main menu nav ol p pre section summary table tbody td tfoot th thead tr ul caption option".split()
)
PROSE = frozenset("p h1 h2 h3 h4 h5 h6 li dt dd blockquote pre td th tr caption figcaption ul ol dl table tbody thead tfoot article main section figure".split())
ENDS_P = BLOCKS - frozenset("body html tbody thead tfoot tr td th caption option li dd dt".split())
CLOSES = {  # a start tag: the open elements that it ends, and those beyond which it doesn't reach
    "li": (("li",), ("ul", "ol", "menu")),
    "dt": (("dt", "dd"), ("dl",)),
    "dd": (("dt", "dd"), ("dl",)),
    "tr": (("td", "th", "tr"), ("table",)),
    "td": (("td", "th"), ("tr", "table")),
    "th": (("td", "th"), ("tr", "table")),
    "option": (("option",), ("select",)),
}
ROLES = frozenset("navigation banner contentinfo complementary search form dialog alertdialog menu menubar toolbar".split())
NAMES = frozenset(
    "ad ads advert adverts advertisement advertising adsense banner sponsor sponsored promo promotion cookie cookies consent gdpr notice notices popup modal overlay newsletter subscribe signup paywall nav navbar navigation menu breadcrumb breadcrumbs sidebar widget footer masthead topbar toolbar social share sharing related recommended comment comments reply replies disqus respond pagination pager search login hidden".split()
)
#: Of these, the ones that tell of an article element that it isn't the page's own.
ARTICLE_NAMES = frozenset("comment comments reply replies ad advert promo related teaser teasers".split())
MODIFIERS = frozenset(("has", "with", "without", "no", "not", "is", "js"))
PAGE_HEADS = frozenset(("header", "masthead"))

TOKEN = re.compile(r"<!--(?:.*?-->|.*)|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']++|\"[^\"]*\"|'[^']*')*+)(?:>|$)|<[a-zA-Z/!?][^>]*+(?:>|$)", re.S)
ATTRIBUTE = re.compile(r"([a-zA-Z_:][\w:.-]*)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?")
WORD = re.compile(r"[a-z0-9]+")
HOST = r"^[a-zA-Z][a-zA-Z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)"
#: Bytes of templates up to which they are broadcast.
BROADCAST_BYTES = 32 << 20



class Page:
    """The block elements of a page as nodes (the page itself is node 0, parents come first), and its blocks of text.

    Inline elements neither begin nor end a block and are passed over, unless they are skipped with what is in them.
    """

    def __init__(self, html: str):
        self.parent, self.tag, self.inside, self.digest, self.named = [0], [""], [False], [0], [False]
        self.blocks: list[tuple[str, int]] = []
        self._stack: list[tuple[str, int, bool]] = [("", 0, False)]  # tag, node, skipped
        self._open: dict[str, int] = {}
        self._parts: list[list[str]] = [[]]  # of each node, what its digest is made of
        self._buffer: list[str] = []
        self._read(html)

    def _read(self, html: str) -> None:
        at, n, stack = 0, len(html), self._stack
        while at < n:
            m = TOKEN.search(html, at)
            end = m.start() if m else n
            if end > at and not stack[-1][2]:
                text = html[at:end]
                self._buffer.append(unescape(text) if "&" in text else text)
            if m is None:
                break
            at = m.end()
            if m[2] is None:
                continue
            tag = m[2].lower()
            if m[1]:
                self._end(tag)
            elif tag in RAW:
                at = self._skip_raw(html, tag, at)
            elif tag in VOID:
                if tag == "hr":
                    self._end_block()
                elif tag == "br" and not stack[-1][2]:
                    self._buffer.append(" ")
            else:
                self._start(tag, m[3])
        while len(stack) > 1:
            self._close()
        self._end_block()

    @staticmethod
    def _skip_raw(html: str, tag: str, at: int) -> int:
        m = re.compile(rf"</{tag}(?=[\s/>])[^>]*+>?", re.I).search(html, at)
        return m.end() if m else len(html)

    def _start(self, tag: str, attributes: str) -> None:
        stack, open_tags = self._stack, self._open
        if tag in ENDS_P and open_tags.get("p"):
            self._end("p")
        elif tag in CLOSES:
            closed, bounds = CLOSES[tag]
            while stack[-1][0] and self._closes_sibling(closed, bounds):
                pass
        _, node, skipped = stack[-1]
        block = tag in BLOCKS
        if block:
            self._end_block()
        if not skipped:
            inside = self.inside[node]
            named = tag in DROPPED or (tag == "header" and not inside) or ("=" in attributes or "hidden" in attributes) and unwanted(tag, attributes, inside)
            if block:
                self.parent.append(node)
                self.named.append(named or self.named[node])
                node = len(self.tag)
                self.tag.append(tag)
                self.inside.append(inside or tag in ("article", "main"))
                self.digest.append(0)
                self._parts.append([])
            elif not named:
                return  # inline
            skipped = named and not block
        stack.append((tag, node, skipped))
        open_tags[tag] = open_tags.get(tag, 0) + 1

    def _closes_sibling(self, closed: tuple[str, ...], bounds: tuple[str, ...]) -> bool:
        """Closes the nearest open element of these, if it is nearer than the bounds."""
        if not any(self._open.get(t) for t in closed):
            return False
        for tag, _, _ in reversed(self._stack):
            if tag in bounds:
                return False
            if tag in closed:
                self._end(tag)
                return True
        return False

    def _end(self, tag: str) -> None:
        if tag == "br" and not self._stack[-1][2]:
            self._buffer.append(" ")
        if self._open.get(tag):
            while self._stack[-1][0] != tag:
                self._close()
            self._close()

    def _close(self) -> None:
        tag, node, skipped = self._stack[-1]
        if tag in BLOCKS and not skipped:
            self._end_block()
            if parts := self._parts[node]:
                h = xxhash.xxh3_64_intdigest(f"{tag}\x1e" + "\x1f".join(parts)) >> 1 or 1
                self._parts[self.parent[node]].append(f"\x1d{h}")
                parts.clear()
                if tag not in ("html", "body", "article", "main") and not (self.inside[node] and tag in PROSE):
                    self.digest[node] = h
        self._stack.pop()
        self._open[tag] -= 1

    def _end_block(self) -> None:
        text = " ".join("".join(self._buffer).split())
        self._buffer.clear()
        if text:
            node = self._stack[-1][1]
            self.blocks.append((text, node))
            self._parts[node].append(text)

    def main(self, templates: Container[int] = ()) -> list[tuple[str, int]]:
        """The blocks of the articles; without any, those of the mains; without any, all. Blocks in an element whose digest is
        among the templates, or that names drop, take no part."""
        gone, region = list(self.named), [0] * len(self.tag)
        for node in range(1, len(self.tag)):
            up = self.parent[node]
            gone[node] = gone[node] or gone[up] or self.digest[node] in templates
            region[node] = 2 if self.tag[node] == "article" else max(region[up], int(self.tag[node] == "main"))
        blocks = [(t, k) for t, k in self.blocks if not gone[k]]
        best = max((region[k] for _, k in blocks), default=0)
        return [(t, k) for t, k in blocks if region[k] == best]


def unwanted(tag: str, attributes: str, inside: bool) -> bool:
    for m in ATTRIBUTE.finditer(attributes):
        name, value = m[1].lower(), (m[2] or m[3] or m[4] or "").lower()
        if name == "hidden" or name == "aria-hidden" and value == "true" or name == "style" and "none" in value and re.search(r"display\s*:\s*none", value):
            return True
        if name == "role" and value in ROLES and tag not in ("main", "body", "html"):
            return True
        if name in ("class", "id") and tag not in ("main", "body", "html"):
            # Each class by its words; has-sidebar and the like tell of other elements.
            parts = [WORD.findall(c) for c in value.split()]
            words = {w for c in parts if c and c[0] not in MODIFIERS for w in c}
            if tag == "article":
                words &= ARTICLE_NAMES
            if words & (ARTICLE_NAMES if tag == "article" else NAMES) or not inside and words & PAGE_HEADS:
                return True
    return False


def _subtrees(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of rows (host, key, html): the host, the key and the distinct digests of the page."""
    for batch in batches:
        for lo in range(0, batch.num_rows, 256):
            part = batch.slice(lo, 256)
            held = [sorted(set(Page(html or "").digest) - {0}) for html in part.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(held, pa.list_(pa.int64()))], names=["host", "key", "digests"])


def _texts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of rows (id, url, html, templates): the text without the templates."""
    for batch in batches:
        for lo in range(0, batch.num_rows, 256):
            part = batch.slice(lo, 256)
            out = ["\n".join(t for t, _ in Page(html or "").main(frozenset(found or ()))) for html, found in zip(part.column(2).to_pylist(), part.column(3).to_pylist())]
            yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(out, pa.string()), pa.array(map(len, out), pa.int64())], names=["id", "url", "text", "n_chars"])


def host_of(url: Column) -> Column:
    return F.lower(F.regexp_extract(F.coalesce(url, F.lit("")), HOST, 1))


def site_templates(pages: DataFrame, least_pages: int = LEAST_PAGES, least_share: float = LEAST_SHARE) -> DataFrame:
    """(host, templates): of rows (host, html), the digests that enough of a host's different pages hold."""
    keyed = pages.select("host", F.xxhash64(F.coalesce("html", F.lit(""))).alias("key"), "html")
    each = map_rows(keyed, _subtrees, "host string, key long, digests array<bigint>").dropDuplicates(["host", "key"])
    pages_of = each.groupBy("host").agg(F.count("*").alias("n_pages"))
    counted = each.select("host", F.explode("digests").alias("digest")).groupBy("host", "digest").agg(F.count("*").alias("n")).filter(F.col("n") >= least_pages)
    found = counted.join(pages_of, "host").filter(F.col("n") >= least_share * F.col("n_pages"))
    # A page holds so many digests, and a template a share of the pages: so an array is at most 1 / least_share pages long.
    return found.groupBy("host").agg(F.collect_list("digest").alias("templates"))


def main_text(df: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", least_pages: int = LEAST_PAGES, least_share: float = LEAST_SHARE) -> DataFrame:
    """id_col, url_col, text (blocks joined by line ends) and n_chars of every row."""
    pages = df.select(F.col(id_col).alias("id"), F.col(url_col).alias("url"), F.col(html_col).alias("html")).withColumn("host", host_of(F.col("url")))
    kind = pages.schema["id"].dataType.simpleString()
    templates = cut(site_templates(pages, least_pages, least_share))
    size = templates.agg(F.sum(F.length("host") + 8 * F.size("templates") + 32).alias("n")).first().n or 0
    joined = pages.join(F.broadcast(templates) if size <= BROADCAST_BYTES else templates, "host", "left")
    out = map_rows(joined.select("id", "url", "html", "templates"), _texts, f"id {kind}, url string, text string, n_chars long")
    return out.withColumnRenamed("id", id_col).withColumnRenamed("url", url_col)


def op3_html(spark, sf_dir):
    """The main text of every page."""
    return main_text(table(spark, sf_dir, "pages"))

"""Main text of web pages by tree scoring.

The markup becomes a tree (unclosed and stray tags are forgiven). Menus,
headers, footers, sidebars, notices, adverts, forms, scripts, styles and reader
comments are left out by their element, role, class or id. A name marks an element
by any of its words, unless another says that something is not there or open; but
never one that holds an article or, on a page without one, most of the text, and by
another word than its last none that holds most of the article it lies in. Every
block that holds text passes points, for its length and its commas, to its ancestors: all
of them to the parent, half to the grandparent, fewer further up. A container's
points are discounted by its link density. The best container is kept, widened
to the article or main element it lies in, and so are its siblings that have a
fifth of its points, or a container within that does, or are long paragraphs, all
with few links.

Blocks are joined in page order by one space. Character references are decoded;
white space inside a block, a line break included, becomes one space. Null and
empty pages have an empty text. Nothing is capped; the tree is kept in flat
lists, so depth does not matter.
"""

from __future__ import annotations

import html
import re

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from millrace.llm.common import with_columns_from

_TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)"
    r"|<[!?][^>]*(?:>|\Z)"
    r"|<(/?)([a-zA-Z][a-zA-Z0-9:-]*+)((?>[^>\"']++|\"[^\"<]*+\"|'[^'<]*+'|[\"'])*+)(?:>|\Z)",
    re.S,
)
_ATTRIBUTE = re.compile(r"\b(class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>\"']+))", re.I)
_PART = re.compile(r"[A-Za-z]+")
# Says of a part that it is or is not there, rather than naming the element.
_STATES = frozenset("no not has have with without open closed hide show enabled disabled".split())
# What belongs to the text even if it is short and lies between kept siblings.
_BETWEEN = frozenset("h1 h2 h3 h4 h5 h6 hgroup ul ol dl table pre blockquote figure p section".split())
# Of all text of a page that is not dropped by element; of that of an article.
_MOST = 0.5
_ARTICLES_MOST = 0.8

_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
_RAW = frozenset("script style title textarea noscript iframe xmp".split())
_BLOCK = frozenset(
    "address article aside blockquote body center dd details dialog dir div dl dt fieldset "
    "figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr html li main menu nav ol p "
    "pre section summary table tbody td tfoot th thead tr ul".split()
)
_DROPPED = frozenset(
    "aside button canvas dialog footer form head iframe input menu nav noscript object option "
    "script select style svg template textarea title".split()
)
# Where one of these opens, an open element of the others ends.
_ENDS = {
    "li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"},
    "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"},
}
_SCOPE = frozenset("table ul ol dl article section div body html main td th".split())
# Words in a class, id or role that mark what is not the article.
_MARKED = frozenset(
    "ad ads adsbygoogle advert adverts advertisement advertising alert banner breadcrumb breadcrumbs "
    "comment comments complementary consent contentinfo cookie cookies disqus footer form header "
    "masthead menu menubar modal nav navbar navigation newsletter notice notices popup promo "
    "promoted related replies respond search share sharing sidebar signup social sponsor "
    "sponsored subscribe toolbar widget".split()
)
_NEVER_MARKED = frozenset("html body main article p h1 h2 h3".split())
_ARTICLE = frozenset(("article", "main"))


class _Page:
    """The tree in lists: a node's number is smaller than those of its children."""

    def __init__(self) -> None:
        self.tag = ["html"]
        self.parent = [-1]
        self.dropped = [False]
        self.marked = [0]
        self.link = [False]
        self.block = [0]
        self.texts: list[tuple[int, str]] = []
        self.open = [0]

    def start(self, tag: str, attributes: str) -> None:
        if tag in ("html", "body") and tag in [self.tag[n] for n in self.open[1:]]:
            return
        if tag in _BLOCK:
            self._close_until({"p"}, _SCOPE)
            if tag in _ENDS:
                self._close_until(_ENDS[tag], _SCOPE - _ENDS[tag])
        parent = self.open[-1]
        self.tag.append(tag)
        self.parent.append(parent)
        self.dropped.append(self.dropped[parent] or self._is_dropped(tag))
        self.marked.append(_marked(attributes) if attributes and tag not in _NEVER_MARKED else 0)
        self.link.append(self.link[parent] or tag == "a")
        self.block.append(len(self.tag) - 1 if tag in _BLOCK else self.block[parent])
        if tag in _VOID:
            self.texts.append((parent, " "))
        else:
            self.open.append(len(self.tag) - 1)
            if tag in _BLOCK:
                self.texts.append((len(self.tag) - 1, " "))

    def _is_dropped(self, tag: str) -> bool:
        if tag == "header":
            return not any(self.tag[n] in _ARTICLE for n in self.open)
        return tag in _DROPPED

    def drop_marked(self) -> None:
        """Drop the marked elements, but for those that hold an article or most of the text.

        If nothing would be left, none goes.
        """
        n = len(self.tag)
        size, article = [0] * n, [t in _ARTICLE for t in self.tag]
        within = [0] * n  # the article that a node lies in
        for node in range(1, n):
            up = self.parent[node]
            within[node] = up if self.tag[up] in _ARTICLE else within[up]
        for node, text in self.texts:
            if not self.dropped[node]:
                size[node] += len(text.strip())
        for node in range(n - 1, 0, -1):
            size[self.parent[node]] += size[node]
            if article[node] and size[node] and not self.dropped[node]:
                article[self.parent[node]] = True
        # A page that has an article may well have a longer advert beside it.
        least = size[0] if article[0] else _MOST * size[0]
        dropped, left = list(self.dropped), False
        for node in range(1, n):
            most = least
            if self.marked[node] == 1 and within[node]:
                most = _ARTICLES_MOST * size[within[node]]
            dropped[node] = dropped[node] or dropped[self.parent[node]] or bool(
                self.marked[node] and not (article[node] and size[node]) and size[node] <= most)
        for node, text in self.texts:
            left = left or not dropped[node] and bool(text.strip())
        if left:
            self.dropped = dropped

    def _close_until(self, tags: set[str], scope: frozenset[str]) -> None:
        for at in range(len(self.open) - 1, 0, -1):
            tag = self.tag[self.open[at]]
            if tag in tags:
                del self.open[at:]
                return
            if tag in scope:
                return

    def end(self, tag: str) -> None:
        if tag in _BLOCK or tag in _VOID:
            self.texts.append((self.open[-1], " "))
        for at in range(len(self.open) - 1, 0, -1):
            if self.tag[self.open[at]] == tag:
                del self.open[at:]
                return
            # A stray inline or p end tag closes no container.
            if tag not in _SCOPE and self.tag[self.open[at]] in _SCOPE:
                return


def _marked(attributes: str) -> int:
    """2 if a class, id or role is a marked word or ends in one, 1 if one is in it, else 0."""
    found = 0
    for attribute in _ATTRIBUTE.finditer(attributes):
        for name in (attribute[2] or attribute[3] or attribute[4] or "").split():
            parts = [p.lower() for p in _PART.findall(name)]
            if _MARKED.intersection(parts) and not _STATES.intersection(parts):
                found = max(found, 2 if parts[-1] in _MARKED else 1)
    return found


def _parse(source: str) -> _Page:
    page, at = _Page(), 0
    while True:
        found = _TOKEN.search(source, at)
        if found is None:
            page.texts.append((page.open[-1], html.unescape(source[at:])))
            return page
        if found.start() > at:
            page.texts.append((page.open[-1], html.unescape(source[at : found.start()])))
        at = found.end()
        name = found[2]
        if not name:
            continue
        tag = name.lower()
        if found[1]:
            page.end(tag)
        elif tag in _RAW:
            close = re.compile(rf"</{tag}\b[^>]*(?:>|\Z)", re.I).search(source, at)
            at = close.end() if close else len(source)
        else:
            page.start(tag, found[3] or "")


def extract(source: str | None) -> str:
    """The main text of one page."""
    if not source:
        return ""
    page = _parse(source)
    page.drop_marked()
    n = len(page.tag)
    size, linked, commas = [0] * n, [0] * n, [0] * n
    for node, text in page.texts:
        if page.dropped[node]:
            continue
        held = len(text.strip())
        if held:
            block = page.block[node]
            size[block] += held
            commas[block] += text.count(",") + text.count("，") + text.count("、")
            if page.link[node]:
                linked[block] += held
    points = [0.0] * n
    for block in range(n):
        if not size[block]:
            continue
        worth = (1 + commas[block] + size[block] / 100) * (1 - linked[block] / size[block])
        level, up = 0, page.parent[block] if block else 0
        while up >= 0:
            points[up] += worth if level == 0 else worth / 2 if level == 1 else worth / (3 * level)
            level, up = level + 1, page.parent[up]
    last = list(range(n))
    for node in range(n - 1, 0, -1):
        up = page.parent[node]
        size[up] += size[node]
        linked[up] += linked[node]
        last[up] = max(last[up], last[node])
    if not size[0]:
        return ""

    def density(node: int) -> float:
        return linked[node] / size[node] if size[node] else 0.0

    score = [p * (1 - density(i)) for i, p in enumerate(points)]
    strongest = list(score)
    for node in range(n - 1, 0, -1):
        if not page.dropped[node]:
            strongest[page.parent[node]] = max(strongest[page.parent[node]], strongest[node])
    best = max((i for i in range(n) if not page.dropped[i] and size[i]),
               key=lambda i: (score[i], -i))
    up = best
    while up >= 0:
        if page.tag[up] in _ARTICLE:
            best = up
            break
        up = page.parent[up]
    kept = [
        i for i in range(n)
        if i == best or page.parent[i] == page.parent[best] and not page.dropped[i] and (
            score[best] > 0 and strongest[i] >= max(1.0, score[best] / 5) and density(i) < 0.5
            or page.tag[i] == "p" and size[i] > 80 and density(i) < 0.25
        )
    ]
    # The short parts between kept ones, those that follow the last without a break
    # and hold few links, and the headings above the first.
    chosen, siblings = set(kept), [
        i for i in range(n) if i and page.parent[i] == page.parent[best] and not page.dropped[i]]
    places = [k for k, i in enumerate(siblings) if i in chosen]
    if places:
        kept += [i for i in siblings[places[0] : places[-1]]
                 if i not in chosen and page.tag[i] in _BETWEEN and size[i] and density(i) < 0.5]
        for i in siblings[places[-1] + 1 :]:
            if page.tag[i] not in _BETWEEN or density(i) >= 0.25:
                break
            kept.append(i)
        for i in reversed(siblings[: places[0]]):
            if page.tag[i] not in ("h1", "h2", "h3", "h4", "h5", "h6", "hgroup"):
                break
            kept.append(i)
    inside = [False] * n
    for i in kept:
        inside[i : last[i] + 1] = [True] * (last[i] + 1 - i)
    words = "".join(
        [t for node, t in page.texts if inside[node] and not page.dropped[node]]).split()
    return " ".join(words)


def with_main_text(pages: DataFrame, source: str = "html", name: str = "text") -> DataFrame:
    """Add the main text of each page."""

    def make():
        return lambda column: [pa.array([extract(v) for v in column.to_pylist()], pa.string())]

    return with_columns_from(pages, source, [T.StructField(name, T.StringType())], make)


def main_text(pages: DataFrame) -> DataFrame:
    """Per row: page_id, url, text, n_chars (code points)."""
    found = with_main_text(pages.select("page_id", "url", "html"))
    return found.select("page_id", "url", "text", F.length("text").cast("long").alias("n_chars"))

"""Main text of web pages by line-block distribution.

Markup is stripped to text blocks, one line for each; the text lengths of every window of a few
lines form a distribution in which the article is a plateau. It begins at a surge (a window
over the threshold after lines without text of their own) and ends at a dive. Lines between are
kept. Elements and names of classes only weigh the lengths: links and what is in navigation, headers
and footers count for nothing, lines named as notices and the like for little. A line inside the
article that weighs under half of what most of the plateau weighs is a dive of its own.
"""

from __future__ import annotations

import html as entities
import re
from bisect import bisect_right
from typing import NamedTuple

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quoin.llm.exchange import small_batches

WINDOW = 3
#: A surge needs this share of the largest window; short articles are judged by their own largest.
SURGE = 0.15

# Elements by their role.
HIDDEN = frozenset("script style noscript template svg math head iframe object canvas select option textarea button form input label datalist audio video".split())
ASIDE = frozenset("nav header footer aside menu dialog".split())
INLINE = frozenset("a abbr acronym b bdi bdo big cite code del dfn em font i ins kbd mark q s samp small span strike strong sub sup time tt u var wbr".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Words of class and id names that mark what is beside the article, alone or with words of place and form.
_BESIDE = "ads? advert advertisement advertising banner breadcrumbs? comments? cookies? consent disqus footer header masthead menu nav navbar navigation newsletter notice outbrain pager pagination popup popular promo promotion recommendations? recommended related replies share sharing sidebar social sponsor sponsored subscribe taboola teaser toolbar trending widget widgets"
_FORM = "area bar block body bottom box container form global group inner item items left link links list main outer page panel primary right secondary section signup site slot thread top unit wrap wrapper"
_PART = "|".join(_FORM.split() + _BESIDE.split())
BESIDE = re.compile(rf"(?:(?:{_PART})[_-]+)*(?:{'|'.join(_BESIDE.split())})(?:[_-]+(?:{_PART}|\d+))*", re.I)
#: Headings after which readers have the word.
READERS = re.compile(r"(?:\d+\s+)?(?:readers?\W*s?\s+|user\s+|leser)?(?:comments?|responses|replies|discussion|kommentare?|commentaires?|comentarios?)(?:\s*\(?\d+\)?)?\s*:?", re.I)
HEADS = frozenset("h1 h2 h3 h4 h5 h6 dt legend summary caption".split())
LEAVES = HEADS | frozenset("p li pre blockquote td th dd figcaption address".split())

#: What a line's length counts for: beside the article by its names, for each element so named around it; outside
#: the article element where there is one; and under a heading of readers' comments.
NAMED, OUTSIDE, READ = 0.1, 0.1, 0.01

_TAG = re.compile(r"<(/?)([A-Za-z][A-Za-z0-9:-]*+)((?:[^<>\"']|\"[^\"]*+\"|'[^']*+')*+)>")
_NAMES = re.compile(r"(?:^|\s)(?:class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+))", re.I)
_UNSEEN = re.compile(r"\shidden(?=[\s=]|$)|aria-hidden\s*=\s*[\"']?true|display\s*:\s*none", re.I)
_RAW = {t: re.compile(rf"</{t}\s*>", re.I) for t in ("script", "style", "textarea", "title", "noscript", "template", "iframe")}
_SPACE = re.compile(r"\s+")


class Line(NamedTuple):
    """A block's text, its characters that are links, its weight, the element whose child it is (or that
    holds it, if that is no paragraph or the like), the innermost block around it and that one's tag, and
    the innermost element around it whose names put it beside the article, or 0.
    Elements are numbered in page order from 1; 0 is the page."""

    text: str
    linked: int
    weight: float
    home: int
    leaf: int
    tag: str
    named: int


class _Open(NamedTuple):
    tag: str
    number: int
    hidden: bool
    aside: bool
    named: bool


class Page:
    """The lines of a page, and each element's last descendant. One pass; work goes with the page's length."""

    def __init__(self, page: str):
        self.lines: list[Line] = []
        self.last: list[int] = [0]
        self.tags: list[str] = [""]
        self.parents: list[int] = [0]
        self.article: list[int] = [0]  # the innermost article around each element, or itself
        self._stack: list[_Open] = []
        self._at: dict[str, list[int]] = {}  # where on the stack each tag stands
        self._blocks: list[int] = []  # where on it block elements stand
        self._hidden = self._aside = self._link = 0
        self._named: list[int] = []
        self._parts: list[tuple[str, bool]] = []
        self._articles: list[int] = []  # outermost article elements, in page order; none holds another
        self._read(page)
        self.last[0] = len(self.last) - 1
        if self._articles:
            self.lines = [x._replace(weight=x.weight * OUTSIDE) if not self._inside(x.leaf) else x for x in self.lines]
        self._hear_readers()

    def _inside(self, number: int) -> bool:
        i = bisect_right(self._articles, number)
        return i > 0 and self.covers(self._articles[i - 1], number)

    def covers(self, element: int, number: int) -> bool:
        return element <= number <= self.last[element]

    def _end_block(self) -> None:
        if not self._parts:
            return
        raw = "".join(x for x, _ in self._parts)
        linked = sum(len(x) for x, link in self._parts if link)
        self._parts.clear()
        text = _SPACE.sub(" ", entities.unescape(raw)).strip()
        if not text:
            return
        leaf = self._stack[self._blocks[-1]] if self._blocks else None
        home = leaf.number if leaf else 0
        if leaf and leaf.tag in LEAVES:
            home = self._stack[self._blocks[-2]].number if len(self._blocks) > 1 else 0
        weight = 0.0 if self._aside else max(NAMED ** len(self._named), 1e-9)
        self.lines.append(Line(text, min(linked, len(text)), weight, home, leaf.number if leaf else 0, leaf.tag if leaf else "", self._named[-1] if self._named else 0))

    def _leave(self) -> None:
        x = self._stack.pop()
        self._at[x.tag].pop()
        if x.tag not in INLINE:
            self._blocks.pop()
        self._hidden -= x.hidden
        self._aside -= x.aside
        if x.named:
            self._named.pop()
        self._link -= x.tag == "a"
        self.last[x.number] = len(self.last) - 1

    def _enter(self, tag: str, attributes: str) -> None:
        names = [n for x in _NAMES.findall(attributes) for n in (x[0] or x[1] or x[2]).split()] if "=" in attributes else []
        in_article = bool(self._at.get("article") or self._at.get("main"))
        number = len(self.last)
        self.last.append(number)
        self.tags.append(tag)
        self.parents.append(self._stack[-1].number if self._stack else 0)
        self.article.append(number if tag == "article" else self.article[self.parents[-1]])
        if tag in ("article", "main") and not in_article:
            self._articles.append(number)
        x = _Open(
            tag, number, tag in HIDDEN or bool(attributes and _UNSEEN.search(" " + attributes)),
            tag in ASIDE and not (tag == "header" and in_article),
            tag not in ("html", "body", "article", "main") and any(BESIDE.fullmatch(n) for n in names),
        )
        self._hidden += x.hidden
        self._aside += x.aside
        if x.named:
            self._named.append(number)
        self._link += tag == "a"
        self._at.setdefault(tag, []).append(len(self._stack))
        if tag not in INLINE:
            self._blocks.append(len(self._stack))
        self._stack.append(x)

    def _close(self, tag: str) -> None:
        where = self._at.get(tag)
        if not where or tag in INLINE and self._blocks and self._blocks[-1] > where[-1]:
            return
        depth = where[-1]
        while len(self._stack) > depth:
            self._leave()

    def _text(self, text: str) -> None:
        if text and not self._hidden:
            self._parts.append((text, self._link > 0))

    def _read(self, page: str) -> None:
        at, end = 0, page.rfind(">")
        while True:
            i = page.find("<", at)
            if i < 0 or i > end and not page.startswith("<!--", i):
                self._text(page[at:])
                break
            self._text(page[at:i])
            if page.startswith(("<!", "<?"), i):
                close = "-->" if page.startswith("<!--", i) else "]]>" if page.startswith("<![CDATA[", i) else ">"
                j = page.find(close, i + 2)
                at = j + len(close) if j >= 0 else len(page)
                continue
            m = _TAG.match(page, i)
            if not m:
                self._text("<")
                at = i + 1
                continue
            at = m.end()
            at = self._tag(page, at, m[1], m[2].lower(), m[3])
        self._end_block()
        while self._stack:
            self._leave()

    def _tag(self, page: str, at: int, closing: str, tag: str, attributes: str) -> int:
        if closing:
            if tag not in INLINE:
                self._end_block()
            self._close(tag)
            return at
        if tag == "br":
            self._text(" ")
        elif tag not in INLINE and tag not in ("img", "input"):
            self._end_block()
        alone = attributes.rstrip().endswith("/")
        if tag in _RAW and not alone:
            close = _RAW[tag].search(page, at)
            return close.end() if close else len(page)
        if tag in VOID or alone:
            return at
        if tag == "p":  # an open paragraph ends where the next begins
            while self._blocks and self._stack[self._blocks[-1]].tag == "p":
                self._close("p")
        self._enter(tag, attributes)
        return at

    def _hear_readers(self) -> None:
        """What stands after a heading of readers' comments, in the element of that heading, counts as named."""
        since, until = 0, -1
        for i, x in enumerate(self.lines):
            if x.leaf <= until and x.leaf >= since:
                self.lines[i] = x._replace(weight=min(x.weight, READ))
            elif x.tag in HEADS and len(x.text) <= 60 and READERS.fullmatch(x.text):
                since, until = x.leaf, self.last[x.home]
                self.lines[i] = x._replace(weight=min(x.weight, READ))


def plateau(sizes: list[float], window: int = WINDOW, surge: float = SURGE) -> tuple[int, int]:
    """First and last + 1 of the lines from the surge before the largest window to the dive after it."""
    n = len(sizes)
    if not any(sizes):
        return 0, 0
    block = [sum(sizes[i : i + window]) for i in range(n)]
    top = max(range(n), key=lambda i: block[i])
    bar = surge * block[top] / window
    lo = hi = max(range(top, min(n, top + window)), key=lambda i: sizes[i])
    # a dive is a whole window of lines that add up to less than the bar
    while lo and sum(sizes[max(0, lo - window) : lo]) >= bar:
        lo -= 1
    while hi + 1 < n and sum(sizes[hi + 1 : hi + 1 + window]) >= bar:
        hi += 1
    while not sizes[lo]:
        lo += 1
    while not sizes[hi]:
        hi -= 1
    return lo, hi + 1


def _homes(found: Page, lines: list[Line], sizes: list[float]) -> tuple[int, list[tuple[int, int]]]:
    """The element that holds most of these lines' text; and first and last element of all that hold some, and of
    articles next to one of these, as disjoint ranges in page order, but for the page's body."""
    shares: dict[int, float] = {}
    for x, size in zip(lines, sizes, strict=True):
        if size:
            shares[x.home] = shares.get(x.home, 0) + size
    whole = {h for h in shares if found.tags[h] not in ("", "html", "body")}
    beside = {found.parents[found.article[h]] for h in whole if found.article[h]}
    if beside:
        whole |= {n for n, tag in enumerate(found.tags) if tag == "article" and found.parents[n] in beside}
    ranges: list[tuple[int, int]] = []
    for h in sorted(whole):
        if not ranges or h > ranges[-1][1]:
            ranges.append((h, found.last[h]))
    return max(shares, key=lambda h: (shares[h], -h)), ranges


def edges(found: Page, sizes: list[float]) -> tuple[int, int, float]:
    """First and last + 1 of the article's lines, and what most of their text weighs. A short first or last paragraph is
    no dive: from the plateau's ends the edges move on over lines of the elements that the plateau is the text of,
    past lines that weigh little; then back over lists of links. An article that is itself under a name (all of the
    page, or its class is an odd one) ends where the element of that name does."""
    lines = found.lines
    lo, hi = plateau(sizes)
    if lo == hi:
        return lo, hi, 0.0
    heavy, around = _weight(lines[lo:hi], sizes[lo:hi])
    while not found.covers(around, lines[lo].leaf):
        lo += 1
    while not found.covers(around, lines[hi - 1].leaf):
        hi -= 1
    most, ranges = _homes(found, lines[lo:hi], [s if 2 * x.weight >= heavy else 0.0 for x, s in zip(lines[lo:hi], sizes[lo:hi], strict=True)])
    starts = [a for a, _ in ranges]

    def at_home(x: Line) -> bool:
        i = bisect_right(starts, x.leaf)
        return found.covers(around, x.leaf) and (x.home == most or i > 0 and x.leaf <= ranges[i - 1][1])

    def links(x: Line) -> bool:
        return 2 * x.linked > len(x.text) and x.tag not in HEADS and x.tag != "p"

    def move(edge: int, ahead: range) -> int:
        for i in ahead:
            if at_home(lines[i]):
                edge = i
            elif 2 * lines[i].weight >= heavy:
                break
        return edge

    first, last = move(lo, range(lo - 1, -1, -1)), move(hi - 1, range(hi, len(lines)))
    while first < lo and (links(lines[first]) or 2 * lines[first].weight < heavy):
        first += 1
    while last >= hi and (links(lines[last]) or 2 * lines[last].weight < heavy):
        last -= 1
    return first, last + 1, heavy


def _weight(lines: list[Line], sizes: list[float]) -> tuple[float, int]:
    """The weight that most of these lines' text has, and the element whose names set it, or 0."""
    by: dict[tuple[float, int], float] = {}
    for x, size in zip(lines, sizes, strict=True):
        by[x.weight, x.named] = by.get((x.weight, x.named), 0) + size
    return max(by, key=lambda k: (by[k], k))


def main_text(page: str | None) -> str:
    """The article's blocks, one on a line; empty where there is none.

    Surge and dive of the weighted lengths decide, see `plateau` and `edges`; of the lines between, those go that weigh
    under half of what most of the plateau's text weighs. So names of classes tell lines apart but drop no page as a
    whole, and a block inside the article that is mostly a link stays."""
    found = Page(page or "")
    sizes = [(len(x.text) - x.linked) * x.weight for x in found.lines]
    lo, hi, heavy = edges(found, sizes)
    return "\n".join(x.text for x in found.lines[lo:hi] if 2 * x.weight >= heavy)


def extract(pages: DataFrame, html: str = "html", into: str = "text") -> DataFrame:
    """Add the main text of each page's html as the column `into` (in place of one of that name).

    Null and empty pages, and pages without text, give an empty text; repeated rows each get theirs; no
    rows give no rows; other columns stay. A page is read in one pass. No shuffle."""

    small_batches(pages.sparkSession, 500)

    @F.pandas_udf("string")
    def run(column):
        return column.map(main_text)

    return pages.withColumn(into, run(F.col(html)))

"""Main text of web pages from standard-library parser events and text-to-tag ratios.

The parser's events become lines, one per block. A line has its text, the number of tags in it, and the element it lies
in. The ratios of characters to tags, raised inside a marked article, are smoothed by a Gaussian over neighbouring
lines and parted into two clusters at the threshold that separates them best. The upper cluster chooses the content
region: the innermost container that holds nearly all of its text. Of a region all lines stay that are in the cluster,
between lines of it, or the region's own blocks, so short paragraphs and titles stay with the long ones, and lists of
links don't. Lines inside boilerplate elements never count. A class or id that hints at boilerplate doesn't count on a
container of most of the page's text, if that has a title, an article or (unless it is named as comments) several blocks.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from html.parser import HTMLParser

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr"}
BLOCK = {"address", "article", "aside", "blockquote", "body", "caption", "center", "dd", "details", "dialog", "div", "dl", "dt", "fieldset", "figcaption", "figure", "footer", "form", "h1", "h2", "h3", "h4", "h5", "h6", "header", "hr", "html", "legend", "li", "main", "menu", "nav", "ol", "p", "pre", "section", "summary", "table", "tbody", "tfoot", "thead", "tr", "ul"}
HEADINGS = {"h1", "h2", "h3", "h4", "h5", "h6"}
HIDDEN = {"script", "style", "noscript", "template", "head", "title", "iframe", "object", "svg", "canvas", "audio", "video", "math"}
BOILERPLATE = HIDDEN | {"nav", "header", "footer", "aside", "form", "button", "select", "textarea", "input", "dialog", "menu"}
ROLES = {"navigation", "banner", "complementary", "contentinfo", "search", "form", "dialog", "alertdialog", "alert", "menu", "menubar", "toolbar"}
HINT = re.compile(
    r"(?:^|[\s_-])(?:ads?|adverts?|advertisements?|adsense|adbox|banners?|sponsor(?:ed|s)?|promos?|promotions?|cookies?|consent|gdpr|notices?|notifications?|alerts?|comments?|commentlist|disqus|repl(?:y|ies)|responses"
    r"|sidebars?|side-bar|menus?|nav|navbar|navigation|breadcrumbs?|share|sharing|social|related|recommend(?:ed|ations)?|subscribe|subscription|newsletter|signup|login|popups?|modal|overlay|footer|header|masthead|widgets?|toolbar|pagination|pager|search|skip|disclaimer|copyright|paywall)(?=$|[\s_-])",
    re.IGNORECASE,
)
#: Elements of running text: a name hints only if it is nothing but a hint ("ad", not "share-price").
TEXT_LEVEL = {"p", "span", "a", "b", "i", "em", "strong", "li", "td", "th", "tr", "dd", "dt", "pre", "blockquote", "figure", "figcaption"} | HEADINGS
INLINE = {"span", "a", "b", "i", "em", "strong", "small", "u", "code", "font", "mark", "cite", "q", "sub", "sup"}
#: Elements that put blocks in order but part nothing off.
FLOW = TEXT_LEVEL | INLINE | {"ul", "ol", "dl", "table", "tbody", "thead", "tfoot", "caption", "header", "hgroup", "center", "summary", "details"}
#: Names of what a container has or lacks, not of what it is: no-sidebar, has-header, comments-open.
STATE = re.compile(r"(?:no|has|with|without)[_-]|.*[_-](?:open|closed|enabled|disabled)$", re.IGNORECASE)
TALK = re.compile(r"comment|repl(?:y|ies)|responses|disqus", re.IGNORECASE)
CLOSED_BY = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
#: Hints that are also words of running text: followed by another word they name that ("related-work"), unless it is a word for a part of a page.
WEAK = re.compile(r"(?:^|.*[\s_-])(?:related|shar(?:e|ing)|social|search|alerts?|notices?|promotions?|header|responses|repl(?:y|ies)|skip|recommend(?:ed|ations)?)[_-]([a-z]{3,})$", re.IGNORECASE)
PARTS = {"area", "articles", "bar", "block", "body", "box", "btn", "button", "buttons", "column", "container", "content", "entries", "form", "grid", "group", "icon", "icons", "inner", "input", "item", "items", "links", "link", "list", "media", "message", "news", "outer", "panel", "posts", "reading", "row", "section", "sites", "slot", "stories", "text", "title", "tools", "topics", "videos", "wrap", "wrapper"}
SIGMA = 1.0
COVERS = 0.9  # share of the upper cluster's characters that the content region holds
MARKED = 1.0  # what a marked article adds to the logarithm of a line's ratio


def _is_hint(name: str) -> bool:
    """Whether a name has a hint that names the element, and not a word of its subject."""
    weak = WEAK.match(name)
    return bool(HINT.search(name)) and not (weak and weak[1].lower() not in PARTS and not HINT.search(weak[1]) and len(HINT.findall(name)) == 1)


def _hints(tag: str, attrs: dict[str, str | None]) -> bool:
    names = [name for k in ("class", "id") for name in (attrs.get(k) or "").split()]
    return any((HINT.fullmatch(name) if tag in TEXT_LEVEL else _is_hint(name)) and not STATE.match(name) for name in names)


class _Lines(HTMLParser):
    """Parser events to lines ``[text, tags, link characters, boilerplate, in article, number of the element]``."""

    def __init__(self, spared: frozenset[int] = frozenset()) -> None:
        super().__init__(convert_charrefs=True)
        self.spared = spared  # numbers of start tags whose hints don't count
        self.number = self.plain = self.plain_lines = self.marks = self.hard = 0
        # By number; at the start the counts so far, in the end unlinked characters, lines, whether named as talk, whether it has a title or an article.
        self.hinted: dict[int, tuple] = {}
        self.open: Counter[str] = Counter()  # tags on the stack, so that what is not open is not looked for
        self.stack: list[tuple[str, bool, bool, bool, int]] = []  # tag, starts boilerplate, an article, boilerplate by its element, number if hinted
        self.lines: list[tuple[str, int, int, bool, bool, int]] = []
        self.parents: dict[int, int] = {}  # of every element that holds others, by number; 0 is the page
        self.names: dict[int, str] = {0: "page"}
        self.path: list[int] = [0]  # numbers of the stack
        self.marked: set[int] = set()  # elements that the page marks as its article
        self.text: list[str] = []
        self.tags = self.links = self.off = self.article = self.anchors = 0
        self.header_in_article = 0

    def flush(self) -> None:
        text = " ".join("".join(self.text).split())
        if text:
            if not self.hard:
                size = max(0, len(text) - self.links)
                self.plain += size
                self.plain_lines += 1
            self.lines.append((text, self.tags, self.links, self.off > 0, self.article > 0, self.path[-1]))
        self.text, self.tags, self.links = [], 0, 0

    def _pop(self, upto: int) -> None:
        while len(self.stack) > upto:
            tag, off, article, hard, number = self.stack.pop()
            self.path.pop()
            self.open[tag] -= 1
            if number:  # what came since its start is inside it
                size, lines, marks, talk = self.hinted[number]
                self.hinted[number] = (self.plain - size, self.plain_lines - lines, talk, self.marks > marks)
            self.hard -= hard
            self.off -= off
            self.article -= article
            self.anchors -= tag == "a"

    def handle_starttag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        if tag in BLOCK:
            self.flush()
            for i in range(len(self.stack) - 1, -1, -1) if self.open["p"] else ():  # a block ends an open paragraph
                if self.stack[i][0] == "p":
                    self._pop(i)
                    break
                if self.stack[i][0] in BLOCK:
                    break
        if tag in CLOSED_BY and any(self.open[x] for x in CLOSED_BY[tag]):
            for i in range(len(self.stack) - 1, -1, -1):
                if self.stack[i][0] in CLOSED_BY[tag]:
                    self._pop(i)
                    break
                if self.stack[i][0] in {"ul", "ol", "dl", "table", "tbody", "thead", "select"}:
                    break
        self.tags += 1
        self.number += 1
        if tag in VOID:
            self.text.append(" " if tag in {"br", "hr", "wbr"} else "")
            return
        if tag in {"td", "th"}:
            self.text.append(" ")
        a = dict(attrs)
        off = tag in BOILERPLATE or (a.get("role") or "").lower() in ROLES or "hidden" in a or (a.get("aria-hidden") or "").lower() == "true"
        hard, hinted = off, tag not in {"body", "html", "main"} and not off and _hints(tag, a)
        if hinted:
            self.hinted[self.number] = (self.plain, self.plain_lines, self.marks, bool(TALK.search(f"{a.get('class')} {a.get('id')}")))
            off = self.number not in self.spared
        if self.article and tag == "header" and not HINT.search(a.get("class") or ""):
            off = hard = False  # an article's own header holds its title and lead; the rest of it is dropped below
            self.header_in_article += 1
        marks = tag in {"article", "main"} or (a.get("role") or "").lower() in {"main", "article"} or (a.get("itemprop") or "").lower() == "articlebody"
        article = marks and not off
        number = self.number if hinted else 0
        self.marks += marks or tag == "h1"
        self.stack.append((tag, off, article, hard, number))
        self.parents[self.number], self.names[self.number] = self.path[-1], tag
        self.path.append(self.number)
        if article:
            self.marked.add(self.number)
        self.open[tag] += 1
        self.hard += hard
        self.off += off
        self.article += article
        self.anchors += tag == "a"

    def handle_startendtag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        self.handle_starttag(tag, attrs)
        if tag in HIDDEN:
            self.handle_endtag(tag)

    def parse_html_declaration(self, i: int) -> int:
        """A marked section (``<![``) is no text, however it goes on; the library knows only some of its forms."""
        if not self.rawdata.startswith("<![", i):
            return super().parse_html_declaration(i)
        end = self.rawdata.find(">", i)
        return end + 1 if end >= 0 else len(self.rawdata)

    def handle_endtag(self, tag: str) -> None:
        self.tags += 1
        for i in range(len(self.stack) - 1, -1, -1) if self.open[tag] else ():
            if self.stack[i][0] == tag:
                if tag in BLOCK or any(x[0] in BLOCK for x in self.stack[i:]):
                    self.flush()
                self._pop(i)
                return
            if self.stack[i][0] in {"article", "main", "body", "table", "nav", "footer", "aside", "form"} and tag not in {"article", "main", "body", "html", "table", "nav", "footer", "aside", "form", "div", "section"}:
                return
        if tag in {"p", "br"}:
            self.text.append(" ")

    def handle_data(self, data: str) -> None:
        if any(x[0] in HIDDEN for x in self.stack[-2:]):
            return
        if self.header_in_article and any(x[0] == "header" for x in self.stack) and self.article and not any(x[0] == "p" or x[0] in HEADINGS for x in self.stack):
            return
        self.text.append(data)
        if self.anchors:
            self.links += len(data.strip())


def threshold(values: np.ndarray) -> float:
    """Cut that maximises the variance between the two clusters; below all values if they are one cluster."""
    v = np.sort(values)
    if len(v) < 2 or v[0] == v[-1]:
        return -np.inf
    n, total = np.arange(1, len(v)), np.cumsum(v)
    low, high = total[:-1] / n, (total[-1] - total[:-1]) / (len(v) - n)
    between = n * (len(v) - n) * (high - low) ** 2
    return float(v[int(np.argmax(between)) + 1])


def smoothed(ratios: np.ndarray, sigma: float = SIGMA) -> np.ndarray:
    """Gaussian mean over neighbouring lines, weights renewed at the ends."""
    reach = int(3 * sigma) + 1
    kernel = np.exp(-0.5 * (np.arange(-reach, reach + 1) / sigma) ** 2)
    return np.convolve(ratios, kernel)[reach:-reach] / np.convolve(np.ones(len(ratios)), kernel)[reach:-reach]


def _parsed(html: str) -> _Lines:
    """The page's lines; read again where containers of most of its text were named like boilerplate."""
    spared: frozenset[int] = frozenset()
    while True:
        parser = _Lines(spared)
        parser.feed(html)
        parser.close()
        parser.flush()
        parser._pop(0)
        most = {k for k, (size, n, talk, titled) in parser.hinted.items() if 2 * size > parser.plain and (titled or n > 2 and not talk)}
        if most <= spared:
            return parser
        spared |= most


def region_of(page: _Lines, usable: list[int], chosen: list[int]) -> tuple[int, set[int]]:
    """The innermost container of nearly all chosen characters, and all elements inside it.

    A container holds two usable lines or more and is no element of running text, so it is a part of the page and not
    one of its paragraphs. Elements are numbered in page order, so children come after their parents.
    """
    size, lines = dict.fromkeys(page.names, 0), dict.fromkeys(page.names, 0)
    for i in usable:
        lines[page.lines[i][5]] += 1
    for i in chosen:
        size[page.lines[i][5]] += len(page.lines[i][0])
    children: dict[int, list[int]] = {}
    for number in sorted(page.parents, reverse=True):
        up = page.parents[number]
        size[up] += size[number]
        lines[up] += lines[number]
        children.setdefault(up, []).append(number)
    at, least = 0, COVERS * size[0]
    while True:
        inner = [c for c in children.get(at, ()) if size[c] >= least and lines[c] > 1 and page.names[c] not in TEXT_LEVEL]
        if not inner:
            break
        at = inner[0]
    inside, todo = {at}, [at]
    while todo:
        new = children.get(todo.pop(), [])
        inside.update(new)
        todo += new
    return at, inside


def content_lines(page: _Lines) -> list[int]:
    """Numbers of the lines of the main text: ratios, smoothing, clusters, and the region that these choose."""
    lines = page.lines
    usable = [i for i, line in enumerate(lines) if not line[3]]
    if not usable:
        return []
    ratio = np.array([0.0 if off else np.log1p((len(t) - link) / (1 + tags)) + MARKED * marked for t, tags, link, off, marked, _ in lines])
    smooth = smoothed(ratio)
    cut = threshold(smooth[usable])
    plain = {i for i in usable if 2 * lines[i][2] <= len(lines[i][0])}
    chosen = [i for i in usable if smooth[i] >= cut and i in plain]
    if not chosen:
        return []
    region, inside = region_of(page, usable, chosen)
    mine = [i for i in chosen if lines[i][5] in inside]
    # Blocks of the region itself belong to it, in lists and tables too, and in any part of it where the page marks it as
    # an article; those of the whole page may be anything.
    own: dict[int, bool] = {n: n == region and page.names[n] not in {"page", "html", "body"} for n in (0, region)}

    marked = region in page.marked

    def part_of(n: int) -> bool:
        seen = []
        while n not in own:
            if not marked and page.names[n] not in FLOW:
                own[n] = False
                break
            seen.append(n)
            n = page.parents[n]
        own.update(dict.fromkeys(seen, own[n]))
        return own[n]

    inner = [i for i in usable if i in plain and lines[i][5] in inside]
    # Smoothing lowers the first and last lines of a region, so its ends grow by lines whose own ratio is in the cluster.
    order = {i: k for k, i in enumerate(inner)}
    first, last = order[mine[0]], order[mine[-1]]
    while first and ratio[inner[first - 1]] >= cut:
        first -= 1
    while last + 1 < len(inner) and ratio[inner[last + 1]] >= cut:
        last += 1
    kept = [i for k, i in enumerate(inner) if first <= k <= last or part_of(lines[i][5])]
    # Titles right before the region belong to it.
    at = usable.index(kept[0])
    while at and page.names[lines[usable[at - 1]][5]] in HEADINGS and usable[at - 1] in plain:
        at -= 1
        kept.insert(0, usable[at])
    return kept


def main_text(html: str | None) -> str:
    """Blocks of the main text, in page order, joined by an empty line."""
    if not html:
        return ""
    page = _parsed(html)
    return "\n\n".join(page.lines[i][0] for i in content_lines(page))


def extract(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """``page_id, url, text, n_chars`` for every page, from its whole html.

    Null or empty html, or a page without content: an empty text. Null and repeated ids are rows like others.
    Empty input gives an empty result. Other columns are not read.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = [main_text(x.as_py()) for x in b.column(2)]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], ["id", "url", "text", "n_chars"])

    kinds = dict(pages.select(id_col, url_col).dtypes)
    rows = pages.select(F.col(id_col).alias("id"), F.col(url_col).alias("url"), F.col(html_col).alias("html"))
    return rows.mapInArrow(run, f"id {kinds[id_col]}, url {kinds[url_col]}, text string, n_chars long").withColumnsRenamed({"id": id_col, "url": url_col})

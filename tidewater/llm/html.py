"""Main text of web pages by text-to-tag ratios of lines, from parser events.

A page is read once with the standard library's event parser. Block tags cut it into
lines; each has the length of its text and the number of tags in it. The lines' ratios
are smoothed over their neighbours by a Gaussian and split into two clusters; the
upper one is content. The content lines choose the regions that are kept:

- Elements that a page calls its article or main part, if they hold at least half of
  the content: all their lines, however short.
- Else the smallest element around all content lines, widened to its parent as long as
  what comes in isn't mostly links, short of the body; beside it the headline before it
  and whatever other lines are content.

Furniture (menus, headers, footers, sidebars, notices, adverts, forms, comments) by
tag, role, class or id is left out of the regions. A form, or an element that is
furniture by its class, role or id only, is kept as a wrapper if it holds over half of
the content together with an article, a headline or three paragraphs.

Elements are numbered with a link to their parent, and open ones are found by tag, so
the work grows with the page's size however deep its elements are nested.
"""

from __future__ import annotations

import re
from collections import defaultdict
from collections.abc import Iterator
from html.parser import HTMLParser

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

#: Tags that begin and end a block of text.
BLOCKS = frozenset(
    "address article aside blockquote body caption center dd details dialog div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol optgroup option p pre search section summary table tbody td tfoot th thead title tr ul".split()
)
#: Tags without content.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Tags that may stand in the head; any other one ends it.
HEAD = frozenset("base head link meta noscript script style template title".split())
#: Block tags that end an open paragraph.
ENDS_P = frozenset("address article aside blockquote center details dialog div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr main menu nav ol p pre search section table ul".split())
#: Elements whose text isn't shown, or stands in a control.
UNSEEN = frozenset("audio button canvas datalist embed head iframe input noscript object optgroup option script select style svg template textarea title video".split())
#: Furniture by its tag; so is a header outside of articles.
FURNITURE = frozenset("aside dialog footer menu nav search".split())
#: Roles of furniture.
ROLES = frozenset("alert alertdialog banner complementary contentinfo dialog form menu menubar navigation search toolbar".split())
#: Words in a class or id that mark furniture.
MARKS = frozenset(
    "ad ads adsense advert advertisement advertising adverts alert banner banners breadcrumb breadcrumbs cookie cookies footer header masthead menu menus modal nav navbar navigation newsletter notice notices pagination popup promo promoted promotion recommended related share sharing sidebar sidebars signup social sponsor sponsored subscribe subscription toolbar widget widgets".split()
)
#: Of these words the ones that mark an article element too.
ADVERTS = frozenset("ad ads adsense advert advertisement advertising adverts promo promoted sponsor sponsored".split())
#: Words in a class or id that mark readers' comments.
COMMENTS = frozenset("comment comments disqus respond".split())
#: Words before -header that mean the site's header, not a headline.
SITE = frozenset("app global main nav site top web".split())
#: Elements that a page marks as its content.
WHOLE = frozenset("article main".split())
HEADLINES = frozenset("h1 h2 h3".split())
#: An opening tag of these ends an open one of the named tags.
CLOSES = {"li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr", "td", "th"), "td": ("td", "th"), "th": ("td", "th")}
#: Elements that an implied end doesn't reach across, and those that a stray end tag doesn't.
WALLS = ("article", "body", "div", "main", "section", "td", "ul", "ol", "dl", "table")
STRAY = ("article", "main", "body", "table")
#: Elements that hold regions of a page.
REGIONS = frozenset("article body div html main section td".split())
#: The smoothing's standard deviation in lines, and how far apart the means of two
#: clusters are at least, as logarithms of ratios; nearer ones are one cluster.
SIGMA, APART = 1.0, 0.7
_SPACE, _WORD = re.compile(r"\s+"), re.compile(r"(?:(?:has|no|with|without)[-_])?[a-z]+")
_BEGIN = re.compile(r"<[A-Za-z/!?]")
_HEADER = re.compile(r"(?:^|[\s_-])([a-z]+)[-_]+header(?![a-z])")
_NOT_SHOWN = re.compile(r"display\s*:\s*none|visibility\s*:\s*hidden")
#: Kinds of elements: ordinary, not shown, comments, furniture by tag, by other marks, form.
PLAIN, NEVER, COMMENT, BY_TAG, BY_MARK, FORM = range(6)


def _kind(tag: str, attrs: list[tuple[str, str | None]], in_article: bool) -> tuple[int, bool]:
    """The kind of an element, and whether a headline inside makes it an ordinary one."""
    if tag in UNSEEN:
        return NEVER, False
    if tag in ("html", "body", "main"):
        return PLAIN, False
    # Of attributes given twice the first one counts.
    values = {k: (v or "").lower() for k, v in reversed(attrs)}
    named = " ".join(filter(None, (values.get("class"), values.get("id"))))
    words = set(_WORD.findall(named))
    if words & COMMENTS or values.get("role") == "comment" or values.get("itemtype", "").endswith("comment"):
        return COMMENT, False
    if tag == "article":
        return (BY_MARK if words & ADVERTS else PLAIN), False
    if tag in FURNITURE or (tag == "header" and not in_article and not _HEADER.search(named)):
        return BY_TAG, False
    if tag == "form":
        return FORM, False
    if values.get("role") in ROLES or "hidden" in values or values.get("aria-hidden") == "true" or _NOT_SHOWN.search(values.get("style", "")):
        return BY_MARK, False
    marked = words & MARKS
    if not marked:
        return PLAIN, False
    before = set(_HEADER.findall(named))
    return BY_MARK, marked == {"header"} and (tag == "header" or bool(before)) and not before & SITE


class _Page(HTMLParser):
    """The elements of a page, numbered in order with their parents, and its lines."""

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.parent, self.tag, self.kind, self.titled, self.ended = [0], [""], [PLAIN], [False], [True]
        self.open = [0]
        self.where: dict[str, list[int]] = defaultdict(list)  # depths of open elements by tag
        #: (number of tags, pieces of text: element, text, whether in a link)
        self.lines: list[tuple[int, list[tuple[int, str, bool]]]] = []
        self.pieces: list[tuple[int, str, bool]] = []
        self.tags, self.link = 0, False  # a link counts to the end of its line only
        self.endless = False  # whether a comment was met that never ends

    def read(self, html: str) -> None:
        # Behind the last > no tag is complete: the page's text ends where one begins.
        last = html.rfind(">") + 1
        self.feed(html[:last] + _BEGIN.split(html[last:], maxsplit=1)[0])
        self.close()
        self._cut()

    def parse_comment(self, i: int, report: int = 1) -> int:
        """A comment that never ends is taken to end at the next >."""
        if self.rawdata.startswith((">", "->"), i + 4):
            return self.rawdata.find(">", i) + 1
        end = -1 if self.endless else self.rawdata.find("-->", i + 4)
        self.endless = end < 0
        return self.parse_marked_section(i) if end < 0 else end + 3

    def parse_marked_section(self, i: int, report: int = 1) -> int:
        """A marked section that HTML doesn't know ends at the next >."""
        end = self.rawdata.find(">", i)
        return end + 1 if end >= 0 else -1

    def parse_html_declaration(self, i: int) -> int:
        if self.rawdata.startswith("<![", i):
            return self.parse_marked_section(i)
        try:
            return super().parse_html_declaration(i)
        except AssertionError:  # a declaration that the parser can't read is a comment
            return self.parse_marked_section(i)

    def _cut(self) -> None:
        if self.pieces:
            self.lines.append((self.tags, self.pieces))
            self.pieces, self.tags = [], 0
        self.link = False

    def _depth(self, tags: tuple[str, ...]) -> int:
        return max([self.where[t][-1] for t in tags if self.where[t]], default=0)

    def _close(self, depth: int) -> None:
        while len(self.open) > depth:
            self.where[self.tag[self.open.pop()]].pop()

    def _begin(self, tag: str) -> None:
        self.tags += 1
        if tag in BLOCKS:
            self._cut()
        elif tag == "br":
            self.pieces.append((self.open[-1], " ", False))

    def handle_starttag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        self._begin(tag)
        if tag not in HEAD and (at := self._depth(("head",))):
            self._close(at)
        if tag in BLOCKS and tag not in ("option", "optgroup", "title") and (at := self._depth(("svg", "select"))):
            self._close(at)
        ends = CLOSES.get(tag, ()) + (("p",) if tag in ENDS_P or tag in CLOSES else ())
        if ends and (at := self._depth(ends)) and at >= self._depth(WALLS):
            self._close(at)
        if tag in VOID:
            return
        kind, titled = _kind(tag, attrs, bool(self.where["article"] or self.where["main"]))
        self.parent.append(self.open[-1])
        self.tag.append(tag)
        self.kind.append(kind)
        self.titled.append(titled)
        self.ended.append(False)
        self.where[tag].append(len(self.open))
        self.open.append(len(self.parent) - 1)
        self.link = self.link or tag == "a"

    def handle_startendtag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        self._begin(tag)

    def handle_endtag(self, tag: str) -> None:
        self.tags += 1
        if tag in BLOCKS:
            self._cut()
        elif tag == "a":
            self.link = False
        if not self.where[tag]:
            return
        at = self.where[tag][-1]
        if tag in ("html", "body", "main", "article") or at >= self._depth(STRAY):
            self.ended[self.open[at]] = True
            self._close(at)

    def handle_data(self, data: str) -> None:
        self.pieces.append((self.open[-1], data, self.link))


def content_lines(ratios: np.ndarray) -> np.ndarray:
    """Which lines are content: smoothed ratios in the upper of two clusters."""
    reach = int(3 * SIGMA)
    kernel = np.exp(-0.5 * (np.arange(-reach, reach + 1) / SIGMA) ** 2)
    weight = np.convolve(np.ones(len(ratios)), kernel)[reach : reach + len(ratios)]
    smooth = np.log1p(np.convolve(ratios, kernel)[reach : reach + len(ratios)] / weight)
    low, high = smooth.min(), smooth.max()
    for _ in range(50):
        upper = smooth > (low + high) / 2
        if not upper.any() or upper.all():
            return np.ones(len(ratios), dtype=bool)
        near = smooth[~upper].mean(), smooth[upper].mean()
        if near == (low, high):
            break
        low, high = near
    return upper if high - low > APART else np.ones(len(ratios), dtype=bool)


#: A line: element of its first piece, text, number of tags, characters in links.
Line = tuple[int, str, int, int]


def _shown(page: _Page, hidden: list[bool]) -> list[Line]:
    """The lines with the text outside of hidden elements, white space as one space."""
    found, tags = [], 0
    for number, pieces in page.lines:
        tags += number
        seen = [p for p in pieces if not hidden[p[0]]]
        text = _SPACE.sub(" ", "".join([t for _, t, _ in seen])).strip()
        if text:
            at = next(n for n, t, _ in seen if not t.isspace())
            found.append((at, text, tags, sum(len(_SPACE.sub(" ", t.strip())) for _, t, linked in seen if linked)))
            tags = 0
    return found


def _content(lines: list[Line]) -> np.ndarray:
    return content_lines(np.array([len(t) / max(n, 1) for _, t, n, _ in lines]))


def _sums(page: _Page, values: list[tuple[int, int]]) -> list[int]:
    """For every element the sum of the values on it and inside it."""
    total = [0] * len(page.parent)
    for node, value in values:
        total[node] += value
    for node in range(len(total) - 1, 0, -1):
        total[page.parent[node]] += total[node]
    return total


def _under(page: _Page, kinds: tuple[int, ...]) -> list[bool]:
    inside = [False] * len(page.parent)
    for node in range(1, len(inside)):
        inside[node] = inside[page.parent[node]] or page.kind[node] in kinds
    return inside


def _hidden(page: _Page) -> list[bool]:
    """Which elements are furniture or lie in it."""
    lines = _shown(page, _under(page, (NEVER,)))
    firm = _under(page, (NEVER, COMMENT, BY_TAG))
    content = _content(lines) if lines else ()
    mass = _sums(page, [(at, len(text)) for (at, text, *_), c in zip(lines, content, strict=True) if c and not firm[at]])
    heads = _sums(page, [(n, 1) for n, t in enumerate(page.tag) if t in HEADLINES])
    wholes = _sums(page, [(n, 1) for n, t in enumerate(page.tag) if t in WHOLE])
    paragraphs = _sums(page, [(n, 1) for n, t in enumerate(page.tag) if t == "p"])
    hidden, open_end = [False] * len(mass), [False] * len(mass)
    for node in range(1, len(mass)):
        kind, up = page.kind[node], page.parent[node]
        if (page.titled[node] and heads[node]) or (kind in (BY_MARK, FORM) and 2 * mass[node] > mass[0] and (heads[node] or wholes[node] or paragraphs[node] > 2)):
            kind = PLAIN
        # Furniture by tag that was never ended ends at the page's content.
        runs_on = kind == BY_TAG and not page.ended[node]
        open_end[node] = (open_end[up] and page.tag[node] not in ("article", "main", "body")) or runs_on
        hidden[node] = hidden[up] or (kind != PLAIN and not runs_on)
    return [h or o for h, o in zip(hidden, open_end, strict=True)]


def _around(page: _Page, nodes: list[int]) -> int:
    """The innermost element around all of the elements."""
    common = nodes[0]
    path = {common: 0}
    while common:
        common = page.parent[common]
        path[common] = len(path)
    highest, seen = 0, set()
    names = list(path)
    for node in nodes[1:]:
        # Every element is walked over once: the way up ends at a known one.
        while node not in path and node not in seen:
            seen.add(node)
            node = page.parent[node]
        highest = max(highest, path.get(node, 0))
    return names[highest]


def main_text(html: str | None) -> str:
    """The article's blocks in page order, joined by newlines; empty if there are none."""
    page = _Page()
    page.read(html or "")
    lines = _shown(page, _hidden(page))
    if not lines:
        return ""
    content = _content(lines)
    links = [2 * linked > len(text) for _, text, _, linked in lines]
    whole = [0] * len(page.parent)  # the outermost article or main around each element
    for node in range(1, len(whole)):
        whole[node] = whole[page.parent[node]] or (node if page.tag[node] in WHOLE else 0)
    sizes = [len(text) for _, text, *_ in lines]
    marked = sum(s for s, (at, *_), c in zip(sizes, lines, content, strict=True) if c and whole[at])
    if marked and 2 * marked >= sum(s for s, c in zip(sizes, content, strict=True) if c):
        chosen = {whole[at] for (at, *_), c in zip(lines, content, strict=True) if c} - {0}
        return "\n".join(text for (at, text, *_), many in zip(lines, links, strict=True) if whole[at] in chosen or (whole[at] and not many))
    core = [i for i, c in enumerate(content) if c and not links[i]] or [i for i, c in enumerate(content) if c]
    region = _around(page, [lines[i][0] for i in core])
    while region and page.tag[region] not in REGIONS:
        region = page.parent[region]
    total, linked = _sums(page, [(at, len(t)) for at, t, *_ in lines]), _sums(page, [(at, n) for at, _, _, n in lines])
    while region and page.tag[page.parent[region]] not in ("", "body", "html"):
        up = page.parent[region]
        if 2 * (linked[up] - linked[region]) > total[up] - total[region]:
            break
        region = up
    inside = [False] * len(page.parent)
    for node in range(len(inside)):
        inside[node] = node == region or (node > 0 and inside[page.parent[node]])
    first = min(core)
    kept = []
    for i, (at, text, *_) in enumerate(lines):
        headline = i < first and page.tag[at] == "h1"
        if inside[at] or headline or (content[i] and not links[i]):
            kept.append(text)
    return "\n".join(kept)


def extract(pages: DataFrame, html_col: str = "html") -> DataFrame:
    """All columns but the markup, and text: the main text of every page.

    Null and empty markup give an empty text. Whole pages are read, whatever their
    length and depth; malformed markup and unclosed elements are read as the parser
    sees them, and declarations that it can't read are passed over. Repeated rows give
    equal rows; an empty table gives none. A column that is named text is replaced.
    """
    kept = [c for c in pages.columns if c not in (html_col, "text")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = pa.array([main_text(x.as_py()) for x in batch.column(len(kept))], pa.string())
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(kept)], texts], names=[*kept, "text"])

    fields = [pages.schema[c] for c in kept]
    schema = ", ".join([*[f"`{f.name}` {f.dataType.simpleString()}" for f in fields], "text string"])
    return pages.select(*[f"`{c}`" for c in kept], f"`{html_col}`").mapInArrow(run, schema)

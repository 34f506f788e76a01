"""Main text of web pages.

The standard library's parser streams events; they build lines (blocks of text with
the sizes of their text, links and tags) and the tree of elements. The text-to-tag ratio per
line, links not counted, is smoothed with a Gaussian, and two-means clustering of the
smoothed ratios sets the threshold; lines above it are the content regions.

The regions decide: the article is the innermost container that holds nearly all of
their text (an <article> or <main> that holds most of it goes before, with the headline in
front of it and the sections and paragraphs beside it in <main> that hold regions), so what
stands outside goes, whatever it is called. Inside, blocks without a region whose text is
mostly links go, and on a page whose article is the body itself, what stands before the
first and after the last region unless it is a paragraph or heading. Short lines of the
article stay. Names, roles and tags of menus, forms, adverts and the like are hints: their
text counts as nothing in the ratio, and they go from inside the article too. So do
elements that are not displayed, and a titled list of comments at the end of the page.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from html.parser import HTMLParser
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Fixed values of the HTML standard: elements without content, elements that start a block.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
BLOCK = frozenset(
    "address article aside blockquote body center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6"
    " header hgroup hr html legend li main menu nav noscript ol optgroup option p pre search section summary table tbody td tfoot th thead title tr ul".split()
)
#: Elements whose text is never main text.
DROPPED = frozenset(
    "head title script style template noscript nav header footer aside button select option textarea input label dialog menu svg math canvas object iframe embed audio video map search".split()
)
#: Elements that never hold text of the page.
TEXTLESS = frozenset("head title script style template svg math canvas object iframe embed audio video map".split())
#: Elements that are dropped like named ones: not if the article stands inside.
FORMS = frozenset(("form", "fieldset"))
#: Elements that can be the article; a cell only where it holds further blocks, as in tables made for layout.
_CONTAINERS = frozenset("html body div article main center".split())
_CELLS = frozenset(("td", "th"))
_PARAGRAPH_ENDS = BLOCK - {"body", "html"}
#: Parts of names, between hyphens, that tell a region which is not the article. Strong ones do so inside an article too.
_STRONG = re.compile(
    r"ads?|advert\w*|ad(?:box|slot|unit)\w*|sponsor\w*|comments?|comment(?:list|form|area|section|thread)s?|disqus|nav|nav(?:bar|box|list|menu|igation)s?|(?:top|left|right|main|side|sub|foot|site|page)nav|breadcrumbs?|pagination|pager|cookies?|cookie(?:bar|banner|notice|consent)|newsletter|share|sharing",
    re.I,
)
_WEAK = re.compile(
    r"banner\w*|promo\w*|consent|notices?|alert|modal|popup|overlay|subscri\w*|discussion|feedback|respond|responses?|replies|reply|copyright|gdpr|paywall|toast|comment\w*|cookie\w*|\w+nav|(?:top|bottom|status|info)bar|menu\w*|sidebar\w*|side|aside|widget\w*|footer\w*|foot|header|masthead|toolbar|social|related|recommend\w*|login|signup|search",
    re.I,
)
#: Parts that turn a name into a statement about the layout or state of what bears it.
_MODIFIERS = frozenset("has no not with without is bg color colour".split())
_STATES = frozenset("open opened closed enabled disabled active inactive on off count collapsed expanded free allowed".split())
_HEADS = frozenset("entry post article story content section".split())
_TITLES = frozenset("h1 h2 h3 h4 h5 h6".split())
_NO, _WEAKLY, _STRONGLY, _SURELY = range(4)
_ROLES = frozenset("navigation banner contentinfo complementary search form alert dialog menu menubar toolbar".split())
#: A style that hides an element.
_HIDDEN = re.compile(r"(?:^|;)\s*(?:display\s*:\s*none|visibility\s*:\s*hidden)\b", re.I)
#: A title over what readers wrote.
_COMMENTS = re.compile(r"(?:\d+ |reader |readers' |user )*comments?(?: ?\(\d+\))?:?", re.I)
_LISTS = frozenset(("ol", "ul", "dl"))
_WHITE = re.compile(r"[\s\xa0]+")


def _named(value: str) -> int:
    """How surely a class or id names a region that is not the article; every name in it is looked at as a whole."""
    found = _NO
    for name in value.split():
        parts = [x for x in re.split(r"[-_]+", name.lower()) if x]
        if not parts or parts[-1] in _STATES or not _MODIFIERS.isdisjoint(parts) or (parts[-1] == "header" and parts[0] in _HEADS):
            continue
        if any(_STRONG.fullmatch(x) for x in parts):
            return _STRONGLY
        if any(_WEAK.fullmatch(x) for x in parts):
            found = _WEAKLY
    return found


class Line(NamedTuple):
    text: str
    tags: int  # characters of tags before and in it
    links: int  # characters of link text
    element: int  # innermost open element, -1 outside all


class _Lines(HTMLParser):
    """Collects lines and elements; an element is its name, parent and grade, so memory follows the page's size however deep it nests."""

    CDATA_CONTENT_ELEMENTS = ("script", "style")

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.lines: list[Line] = []
        self.stack: list[tuple[str, int, bool]] = []  # name, element, below a graded one
        self.open: Counter[str] = Counter()  # how many elements of a name are open
        self.names: list[str] = []  # of each element
        self.parents: list[int] = []  # of each element, always a lower number
        self.grades: list[int] = []  # of each element: how surely it is not the article
        self.text: list[str] = []
        self.tags = self.links = 0

    def cut(self) -> None:
        """End the current line."""
        text = _WHITE.sub(" ", "".join(self.text)).strip()
        self.text.clear()
        if text:
            self.lines.append(Line(text, self.tags, min(self.links, len(text)), self.stack[-1][1] if self.stack else -1))
            self.tags = 0
        self.links = 0

    def handle_starttag(self, tag: str, attrs: list) -> None:
        self.tags += len(tag) + 2 + sum(len(k) + len(v or "") + 4 for k, v in attrs)
        if tag in BLOCK:
            self.cut()
        elif tag == "br":
            self.text.append(" ")
        if tag in VOID:
            return
        if tag in _PARAGRAPH_ENDS or tag in ("li", "dt", "dd", "tr", "td", "th", "option"):
            self._close_implied(tag)
        grade = self._grade(tag, attrs)
        parent = bool(self.stack) and self.stack[-1][2]
        if grade > _NO and not parent:
            self.cut()
        self.parents.append(self.stack[-1][1] if self.stack else -1)
        self.stack.append((tag, len(self.names), parent or grade > _NO))
        self.open[tag] += 1
        self.names.append(tag)
        self.grades.append(grade)

    def _close(self, at: int) -> None:
        for name, _, _ in self.stack[at:]:
            self.open[name] -= 1
        del self.stack[at:]

    def _grade(self, tag: str, attrs: list) -> int:
        inside = self.open["article"] > 0
        grade = _WEAKLY if tag in FORMS else _SURELY if tag in DROPPED and not (tag == "header" and inside) else _NO
        for k, v in attrs:
            if k == "hidden" or (k == "aria-hidden" and v == "true"):
                return _SURELY
            if k == "style" and v and _HIDDEN.search(v):
                grade = max(grade, _STRONGLY)  # a page may hide its text until a script runs
            if k == "role" and v in _ROLES:
                grade = max(grade, _WEAKLY)
            elif v and (k == "class" or (k == "id" and tag not in _TITLES)) and tag not in ("html", "body", "article", "main"):
                named = _named(v)
                grade = max(grade, named if named == _STRONGLY or not (inside or tag in _TITLES) else _NO)
        return grade

    def _close_implied(self, tag: str) -> None:
        """A new block ends an open paragraph; a new item ends an open item of its list."""
        ends = {"li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr", "td", "th"), "td": ("td", "th"), "th": ("td", "th"), "option": ("option",)}.get(tag, ())
        if not any(self.open[name] for name in ("p", *ends)):
            return
        stop = ("ul", "ol", "dl", "table", "select", "div", "article", "section", "main", "body", "td", "th", "nav", "aside", "footer", "header", "form", "blockquote")
        for at in range(len(self.stack) - 1, -1, -1):
            name = self.stack[at][0]
            if name == "p" or name in ends:
                self._close(at)
                return
            if name in stop:
                return

    def handle_startendtag(self, tag: str, attrs: list) -> None:
        self.handle_starttag(tag, attrs)
        if tag not in VOID:
            self.handle_endtag(tag)

    def handle_endtag(self, tag: str) -> None:
        self.tags += len(tag) + 3
        if tag in BLOCK:
            self.cut()
        if not self.open[tag]:
            return
        at = next(k for k in range(len(self.stack) - 1, -1, -1) if self.stack[k][0] == tag)
        outside = at > 0 and self.stack[at - 1][2]
        if self.stack[-1][2] != outside or any(x[0] in BLOCK for x in self.stack[at:]):
            self.cut()
        self._close(at)

    def handle_data(self, data: str) -> None:
        if data:
            self.text.append(data)
            if self.open["a"]:
                self.links += len(data)

    # --- sums and marks over the tree; a parent's number is lower than its children's

    def sums(self, amounts: list[float]) -> list[float]:
        """Of each element: the amounts of the lines inside."""
        total = [0.0] * len(self.names)
        for line, amount in zip(self.lines, amounts):
            if line.element >= 0:
                total[line.element] += amount
        for e in range(len(total) - 1, -1, -1):
            if self.parents[e] >= 0:
                total[self.parents[e]] += total[e]
        return total

    def below(self, marks: list[bool]) -> list[bool]:
        """Of each element: whether it or one around it is marked."""
        out = marks[:]
        for e, parent in enumerate(self.parents):
            out[e] = out[e] or (parent >= 0 and out[parent])
        return out

    def around(self, e: int) -> set[int]:
        """The element and all around it."""
        out = set()
        while e >= 0:
            out.add(e)
            e = self.parents[e]
        return out

    def block_element(self, e: int) -> int:
        """The nearest block around a line, -1 outside all."""
        while e >= 0 and self.names[e] not in BLOCK:
            e = self.parents[e]
        return e

    def block_of(self, e: int) -> str:
        """Name of the nearest block around a line."""
        e = self.block_element(e)
        return self.names[e] if e >= 0 else "body"


def smoothed(ratio: np.ndarray, sigma: float) -> np.ndarray:
    """Gaussian smoothing along the page; the kernel is normalised at both ends."""
    radius = max(1, int(3 * sigma))
    kernel = np.exp(-0.5 * (np.arange(-radius, radius + 1) / sigma) ** 2)
    return np.convolve(ratio, kernel)[radius:-radius] / np.convolve(np.ones(len(ratio)), kernel)[radius:-radius]


def threshold(values: np.ndarray) -> float:
    """Midpoint of the two means of the values; the least value where they do not part."""
    low, high = float(values.min()), float(values.max())
    if high - low < 1e-9:
        return low
    for _ in range(20):
        upper = values > (low + high) / 2
        new = float(values[~upper].mean()), float(values[upper].mean())
        if new == (low, high):
            break
        low, high = new
    return (low + high) / 2


def _hinted(page: _Lines) -> list[bool]:
    """Whether names, roles or tags say of each line that it is not the article.

    A name, role or form does not drop what holds the largest article or main of the page
    (with half of the text, if a strong name stands around an article), nor, on a page
    without one, most of the text (three quarters, if the name is a strong one).
    """
    lines, names, grades = page.lines, page.names, page.grades
    surely = page.below([g == _SURELY for g in grades])
    size = [0.0 if x.element >= 0 and surely[x.element] else float(len(x.text)) for x in lines]
    total = sum(size)
    held = page.sums(size)
    # Teasers beside a text without an article are no articles of their own.
    articles = [e for e, name in enumerate(names) if held[e] and (name == "main" or (name == "article" and held[e] >= 0.05 * total))]
    largest = max(articles, key=lambda e: (held[e], e), default=None)
    holding = page.around(largest) - {largest} if largest is not None else set()
    drops = [False] * len(names)
    # What stands around a region is settled before the region.
    for e, grade in enumerate(grades):
        parent = page.parents[e]
        if parent >= 0 and drops[parent]:
            drops[e] = True
        elif grade:
            share, strong = held[e] / total if total else 0.0, grade == _STRONGLY
            if grade == _SURELY:
                keep = False
            elif largest is None:
                keep = share >= (0.75 if strong else 0.5)
            else:
                keep = e in holding and (not strong or share >= 0.5 or names[largest] == "main")
            drops[e] = not keep
    out = [x.element >= 0 and drops[x.element] for x in lines]
    comments = page.below(_comments(page, held, total))
    told = [x.element >= 0 and comments[x.element] for x in lines]
    if any(told):
        last = max(i for i, x in enumerate(told) if x)
        # Where the article goes on, the title is one of its own.
        if all(out[i] or page.block_of(lines[i].element) not in _GOES_ON for i in range(last + 1, len(lines))):
            out = [a or b for a, b in zip(out, told)]
    return out


#: Blocks that show that the article goes on.
_GOES_ON = _TITLES | {"p", "pre", "blockquote"}


def _comments(page: _Lines, held: list[float], total: float) -> list[bool]:
    """The last title that announces comments with the list right after it, or, where the title begins a section, the section, if it holds less than half of the text."""
    marks = [False] * len(page.names)
    titles = [page.block_element(x.element) for x in page.lines if _COMMENTS.fullmatch(x.text)]
    titles = [e for e in titles if e >= 0 and page.names[e] in _TITLES and page.names[e] != "h1"]
    if not titles:
        return marks
    title = max(titles)
    parent = page.parents[title]
    siblings = [e for e, up in enumerate(page.parents) if up == parent]
    after = siblings[siblings.index(title) + 1 :]
    if siblings[0] == title and parent >= 0 and page.names[parent] in ("section", "div") and held[parent] < 0.5 * total:
        marks[parent] = True
    elif after and page.names[after[0]] in _LISTS and held[after[0]] < 0.5 * total:
        marks[title] = marks[after[0]] = True
    return marks


#: The article holds this share of the regions' text; an <article> or <main> may hold less.
MOST, MARKED = 0.9, 0.6
#: A block without a region goes where links have this share of its text.
LINKED = 0.5
_LINK_BLOCKS = frozenset("div ul ol dl table section center".split())
_FLAT = frozenset(("body", "html"))
_STAY = frozenset("p pre blockquote figcaption li dt dd td th".split()) | _TITLES


def main_text(html: str, sigma: float = 1.0, hints: bool = True, clustering: bool = True) -> list[str]:
    """Blocks of the main text in page order.

    For comparisons, `hints` off ignores what names, roles and tags say (but for
    elements that never hold text), and `clustering` off takes every line for content.
    """
    page = _Lines()
    page.feed(html)
    page.close()
    page.cut()
    lines, names = page.lines, page.names
    never = page.below([name in TEXTLESS for name in names])
    drops = _hinted(page) if hints else [x.element >= 0 and never[x.element] for x in lines]
    open_ = [i for i, x in enumerate(drops) if not x]
    if not open_:
        return []
    sizes = [0.0 if drop else float(len(x.text)) for x, drop in zip(lines, drops)]
    plain = np.array([0.0 if drop else float(len(x.text) - x.links) for x, drop in zip(lines, drops)])
    smooth = smoothed(np.log1p(plain / np.array([max(1, x.tags) for x in lines])), sigma)
    regions = (smooth >= threshold(smooth)) if clustering else np.ones(len(lines), bool)
    found = page.sums([size if region else 0.0 for size, region in zip(sizes, regions)])
    total = sum(size for size, region in zip(sizes, regions) if region)
    articles = [e for e, w in enumerate(found) if hints and names[e] in ("article", "main") and total and w >= MARKED * total]
    if articles:
        holder = max(articles)
        inside = page.below([e == holder for e in range(len(names))])
        kept = {i for i in open_ if lines[i].element >= 0 and inside[lines[i].element]}
        kept |= _beside(page, holder, regions, sizes)
        kept |= _headline(page, open_, kept)
        return [lines[i].text for i in sorted(kept)]
    holder = _container(page, found, total)
    inside = page.below([holder is None or e == holder for e in range(len(names))])
    kept = [i for i in open_ if holder is None or (lines[i].element >= 0 and inside[lines[i].element])]
    kept = _without_links(page, kept, regions, sizes, holder)
    if holder is None or names[holder] in _FLAT:
        kept = _between(page, kept, regions)
    heads = page.below([name == "h1" for name in names])
    heads = [i for i in open_ if lines[i].element >= 0 and heads[lines[i].element]]
    if kept and not set(kept).intersection(heads):
        kept = sorted({*kept, *(i for i in heads if i < kept[0])})
    return [lines[i].text for i in kept]


def _beside(page: _Lines, holder: int, regions: np.ndarray, sizes: list[float]) -> set[int]:
    """Lines of the sections and paragraphs beside an <article> in <main> that are regions for the most part, hold no further article and are not mostly links."""
    main = page.parents[holder]
    if page.names[holder] != "article" or main < 0 or page.names[main] != "main":
        return set()
    text = page.sums(sizes)
    found = page.sums([s if r else 0.0 for s, r in zip(sizes, regions)])
    links = page.sums([float(min(x.links, s)) for x, s in zip(page.lines, sizes)])
    articles = [name == "article" for name in page.names]
    for e in range(len(articles) - 1, -1, -1):
        if articles[e] and page.parents[e] >= 0:
            articles[page.parents[e]] = True
    own = page.below([
        page.parents[e] == main and page.names[e] in _BESIDE and not articles[e] and found[e] > 0.5 * text[e] and links[e] < LINKED * text[e]
        for e in range(len(page.names))
    ])
    return {i for i, x in enumerate(page.lines) if sizes[i] and x.element >= 0 and own[x.element]}


#: What stands beside an article as a part of it.
_BESIDE = frozenset("section p pre blockquote".split())


def _headline(page: _Lines, open_: list[int], kept: set[int]) -> set[int]:
    """Lines of the last <h1> before the article, if it has none of its own and the headline is not a link."""
    heads = page.below([name == "h1" for name in page.names])
    heads = [i for i in open_ if page.lines[i].element >= 0 and heads[page.lines[i].element]]
    if not kept or kept.intersection(heads):
        return set()
    heads = [i for i in heads if i < min(kept) and page.lines[i].links < LINKED * len(page.lines[i].text)]
    return {i for i in heads if page.block_element(page.lines[i].element) == page.block_element(page.lines[heads[-1]].element)}


def _container(page: _Lines, found: list[float], total: float) -> int | None:
    """The innermost container with MOST of the regions' text; None where no element holds it."""
    blocks = [0] * len(page.names)  # blocks inside each element
    for e in range(len(blocks) - 1, -1, -1):
        if page.parents[e] >= 0:
            blocks[page.parents[e]] += blocks[e] + (page.names[e] in BLOCK)
    for e in range(len(found) - 1, -1, -1):
        if total and found[e] >= MOST * total and (page.names[e] in _CONTAINERS or (page.names[e] in _CELLS and blocks[e])):
            return e
    return None


def _without_links(page: _Lines, kept: list[int], regions: np.ndarray, sizes: list[float], holder: int | None) -> list[int]:
    """Without the blocks inside the holder that have no region and whose text is mostly links."""
    count = page.sums([float(r) for r in regions])
    links, text = page.sums([float(min(x.links, s)) for x, s in zip(page.lines, sizes)]), page.sums(sizes)
    around = page.around(holder) if holder is not None else set()
    menu = [e not in around and name in _LINK_BLOCKS and not count[e] and text[e] > 0 and links[e] >= LINKED * text[e] for e, name in enumerate(page.names)]
    menu = page.below(menu)
    return [i for i in kept if page.lines[i].element < 0 or not menu[page.lines[i].element]]


def _between(page: _Lines, kept: list[int], regions: np.ndarray) -> list[int]:
    """From the first to the last region, and the paragraphs and headings around."""
    at = [i for i in kept if regions[i]]
    if not at:
        return kept
    return [i for i in kept if at[0] <= i <= at[-1] or (page.block_of(page.lines[i].element) in _STAY and page.lines[i].links < LINKED * len(page.lines[i].text))]


def _extracted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        texts = ["\n\n".join(main_text(html.as_py() or "")) for html in batch.column(2)]  # one page at a time
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(texts, pa.string())], ["page_id", "url", "text"])


def extract(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """page_id, url, text and n_chars (code points) of every page.

    Blocks are joined by two line feeds; white space inside a block is one blank;
    character references are decoded. Whole pages, no shuffle; only the three
    columns are read. Null or empty html, or a page without main text: empty
    text. Repeated rows give repeated results. Empty table: no rows.
    """
    rows = pages.select(F.col(id_col).alias("page_id"), F.col(url_col).alias("url"), F.col(html_col).cast("string").alias("html"))
    kinds = {f.name: f.dataType.simpleString() for f in rows.schema.fields}
    out = rows.mapInArrow(_extracted, f"page_id {kinds['page_id']}, url {kinds['url']}, text string")
    return out.withColumn("n_chars", F.length("text").cast("long"))

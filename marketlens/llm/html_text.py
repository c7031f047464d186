"""Main-text extraction from HTML by text-to-tag ratios.

The standard library's streaming parser turns a page into block lines. Each line
has its text-to-tag ratio; the ratios are smoothed with a Gaussian kernel, and lines
at or above the threshold (one standard deviation, at most the mean) form the content
cluster. Structural boilerplate (menus, headers, footers, sidebars, notices, adverts,
forms, scripts, styles, reader comments) is never in it, nor is a line below the
threshold whose text is mostly links, outside an article. What is left falls into
segments of neighbouring lines; every segment that holds a line of the cluster is a
content region and kept whole, short lines included, and so is whatever else lies in
the lowest container around all of the cluster.

Boilerplate is told by element, or by a whole token of class, id or role. A token of
two words counts by its last or its first one, but for states ("has-sidebar",
"no-comments") and an article's own header. A mark on an element that holds an article
or main, or on all of the cluster, is a wrapper's and ignored.

Defined cases: a null or empty page, or one without text, gives the empty string;
unclosed and crossed tags close with their nearest enclosing element; text is never
cut; a page takes time in proportion to its length, however deep its elements nest;
repeated rows are extracted each; extra columns never reach the operator, and without
rows there is no result.
"""

from __future__ import annotations

import math
import re
from html.parser import HTMLParser

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.types import StringType, StructField, StructType

from marketlens.llm.common import quoted

# Element names of the HTML standard.
BLOCKS = frozenset(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure "
    "footer form h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol optgroup option p pre section "
    "summary table tbody td tfoot th thead title tr ul".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
CONTAINERS = frozenset("article main section div body td".split())
BOILERPLATE = frozenset(
    "aside button canvas datalist dialog footer form head iframe input menu nav noscript object script select style "
    "svg template textarea title".split())
CLOSES_P = BLOCKS - {"html", "body"}
# Words that mark boilerplate in class, id and role attributes.
MARKS = frozenset(
    "ad ads advert adverts advertisement advertising banner breadcrumb breadcrumbs comment comments complementary "
    "consent contentinfo cookie cookies copyright disclaimer disqus footer gdpr header masthead menu menubar modal nav "
    "navbar navigation newsletter notice notification pager pagination popup promo promoted promotion related reply "
    "replies respond share sharing sidebar signup social sponsor sponsored subscribe toolbar widget".split())
# Words that say what a page or an element is like, not what it is; an article's own parts.
STATES = frozenset("has no not with without is hide show".split())
OWN = frozenset("article content entry page post section story".split())
#: As the first word of two these say too little ("related-work", "header-image", "notice-period").
LAST_ONLY = frozenset("copyright disclaimer header notice promotion related reply respond share social".split())
_PARTS = re.compile(r"[^a-z0-9]+")
_SPACE = re.compile(r"\s+")
MARK_KEYS = ("class", "id", "role")


def marks(token: str) -> bool:
    """Whether one token of a class, id or role names boilerplate."""
    if token in MARKS or token == "side-bar":
        return True
    parts = [x for x in _PARTS.split(token) if x]
    if len(parts) < 2 or parts[0] in STATES:
        return bool(parts) and len(parts) == 1 and parts[0] in MARKS
    if parts[-1] in ("header", "masthead") and parts[0] in OWN:
        return False
    return parts[-1] in MARKS or (parts[0] in MARKS and parts[0] not in LAST_ONLY)


def _marked(attrs) -> bool:
    return any(key in MARK_KEYS and value and any(map(marks, value.lower().split())) for key, value in attrs)


def _hidden(attrs) -> bool:
    return any(key == "hidden" or (key == "aria-hidden" and value == "true") for key, value in attrs)


class Line:
    __slots__ = ("text", "tags", "container", "mark", "hard", "links", "inside")

    def __init__(self, text, tags, container, mark, hard, links, inside):
        self.text, self.tags, self.container, self.mark, self.hard = text, tags, container, mark, hard
        self.links, self.inside = links, inside


class _Element:
    """``mute``: inside a script or another element that is no block, whose text is no part of the line around it."""

    __slots__ = ("tag", "container", "mark", "hard", "inside", "link", "mute")

    def __init__(self, tag, container=0, mark=0, hard=False, inside=False, link=False, mute=False):
        self.tag, self.container, self.mark, self.hard = tag, container, mark, hard
        self.inside, self.link, self.mute = inside, link, mute


class _Lines(HTMLParser):
    """Collects the page's lines, its tree of containers and its tree of marked elements.

    Where an element of each kind was opened last is kept, so that no tag looks through the stack.
    """

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.lines: list[Line] = []
        self.stack = [_Element("")]
        self.at: dict[str, list[int]] = {}  # tag: where it is on the stack
        self.blocks: list[int] = []
        self.boxes: list[int] = []
        self.parents = [-1]  # of containers
        self.mark_parents = [-1]
        self.wrappers: set[int] = set()  # marks that hold an article or main
        self.text: list[str] = []
        self.links = 0
        self.tags = 0

    def flush(self):
        text = _SPACE.sub(" ", "".join(self.text)).strip()
        links, self.text, self.links = self.links, [], 0
        if text:
            e = self.stack[-1]
            self.lines.append(Line(text, max(1, self.tags), e.container, e.mark, e.hard, links, e.inside))
            self.tags = 0

    def _push(self, e: _Element):
        k = len(self.stack)
        self.stack.append(e)
        self.at.setdefault(e.tag, []).append(k)
        if e.tag in BLOCKS:
            self.blocks.append(k)
        if e.tag in CONTAINERS:
            self.boxes.append(k)

    def _cut(self, k: int):
        """Close everything from place ``k`` of the stack on."""
        while len(self.stack) > k:
            self.at[self.stack.pop().tag].pop()
        for places in (self.blocks, self.boxes):
            while places and places[-1] >= k:
                places.pop()

    def _last(self, tag: str) -> int:
        places = self.at.get(tag)
        return places[-1] if places else 0

    def handle_starttag(self, tag, attrs):
        self.tags += 1
        if tag in BLOCKS:
            self.flush()
        elif tag == "br":
            self.text.append(" ")
        if tag in CLOSES_P and self.blocks and self.stack[self.blocks[-1]].tag == "p":
            self._cut(self.blocks[-1])
        if tag == "li" and self._last("li") >= max(1, len(self.stack) - 3, *(1 + self._last(x) for x in ("ul", "ol", "menu"))):
            self._cut(self._last("li"))
        if tag in VOID:
            return
        up = self.stack[-1]
        e = _Element(tag, up.container, up.mark, up.hard, up.inside or tag in ("article", "main"), up.link or tag == "a")
        gone = tag in BOILERPLATE or (tag == "header" and not up.inside) or _hidden(attrs)
        e.hard, e.mute = up.hard or gone, up.mute or (gone and tag not in BLOCKS)
        if tag in ("article", "main"):
            mark = up.mark
            while mark > 0 and mark not in self.wrappers:
                self.wrappers.add(mark)
                mark = self.mark_parents[mark]
        elif tag not in ("body", "html") and not e.hard and _marked(attrs):
            self.mark_parents.append(up.mark)
            e.mark = len(self.mark_parents) - 1
        if tag in CONTAINERS:
            self.parents.append(up.container)
            e.container = len(self.parents) - 1
        self._push(e)

    def handle_startendtag(self, tag, attrs):
        self.handle_starttag(tag, attrs)
        if tag not in VOID:
            self.handle_endtag(tag)

    def handle_endtag(self, tag):
        self.tags += 1
        if tag in BLOCKS:
            self.flush()
        k = self._last(tag)
        if k and (tag in BLOCKS or not self.boxes or k > self.boxes[-1]):
            self._cut(k)

    def handle_data(self, data):
        if self.stack[-1].mute:
            return
        self.text.append(data)
        if self.stack[-1].link:
            self.links += len(data.strip())

    def unknown_decl(self, data):
        pass


def _smooth(values: list[float], sigma: float, reach: int) -> list[float]:
    kernel = [math.exp(-(d * d) / (2 * sigma * sigma)) for d in range(reach + 1)]
    n, out = len(values), []
    for i in range(n):
        total = weight = 0.0
        for j in range(max(0, i - reach), min(n, i + reach + 1)):
            w = kernel[abs(i - j)]
            total += w * values[j]
            weight += w
        out.append(total / weight)
    return out


def _with_parents(n: int, parents: list[int], marked: set[int]) -> list[bool]:
    """Of every node, whether it or a node above it is marked; parents come before their children."""
    out = [False] * n
    for k in range(n):
        out[k] = k in marked or (parents[k] >= 0 and out[parents[k]])
    return out


def _common(parents: list[int], used: list[int]) -> int:
    """The lowest container that holds all of ``used``."""
    below = [0] * len(parents)
    for c in used:
        below[c] += 1
    for k in range(len(parents) - 1, 0, -1):
        below[parents[k]] += below[k]
    return max(k for k in range(len(parents)) if below[k] == len(used))  # deepest comes last


def _wrapping(page: _Lines, used: list[int]) -> set[int]:
    """Marks around all of the cluster: from the top, the heaviest one each time, until some of the cluster shows.

    ``used`` has the innermost mark of each of the cluster's characters.
    """
    n = len(page.mark_parents)
    own = [0] * n
    for m in used:
        own[m] += 1
    weight, inside = list(own), [[] for _ in range(n)]
    for m in range(n - 1, 0, -1):
        weight[page.mark_parents[m]] += weight[m]
        inside[page.mark_parents[m]].append(m)
    out, node = set(), 0
    while inside[node] and max(weight[m] for m in inside[node]):
        node = max(inside[node], key=lambda m: (weight[m], -m))
        out.add(node)
        if own[node]:
            break
    return out


def cluster(ratios: list[float]) -> list[bool]:
    """Lines at or above the threshold: one standard deviation of the smoothed ratios, at most their mean."""
    mean = sum(ratios) / len(ratios)
    spread = math.sqrt(sum((x - mean) ** 2 for x in ratios) / len(ratios))
    return [x >= min(mean, spread) for x in ratios]


def main_text(html: str | None, *, sigma: float = 1.0, reach: int = 2, link_share: float = 0.5) -> str:
    """Blocks of the content regions, joined by one newline."""
    if not html:
        return ""
    page = _Lines()
    page.feed(html)
    page.close()
    page.flush()
    lines = page.lines
    if not any(not x.hard for x in lines):
        return ""
    high = cluster(_smooth([len(x.text) / x.tags for x in lines], sigma, reach))

    def open_lines(ignored: set[int]) -> list[bool]:
        """Lines outside boilerplate and link lists."""
        n = len(page.mark_parents)
        closed = _with_parents(n, page.mark_parents, set(range(1, n)) - ignored)
        return [not x.hard and not closed[x.mark] and (h or x.inside or x.links < link_share * len(x.text))
                for x, h in zip(lines, high)]

    ignored = set(page.wrappers)
    open_ = open_lines(ignored)
    if not any(o and h for o, h in zip(open_, high)):
        ignored |= _wrapping(page, [x.mark for x, h in zip(lines, high) if h and not x.hard for _ in x.text])
        open_ = open_lines(ignored)
    core = [o and h for o, h in zip(open_, high)]
    if not any(core):
        core = open_  # a page of short lines
    if not any(core):
        return ""
    around = _common(page.parents, [x.container for x, c in zip(lines, core) if c])
    inside = _with_parents(len(page.parents), page.parents, {around})
    out, segment, held = [], [], False
    for x, o, c in [*zip(lines, open_, core), (None, False, False)]:
        if o:
            segment.append(x)
            held = held or c
            continue
        out += segment if held else [y for y in segment if inside[y.container]]
        segment, held = [], False
    return "\n".join(x.text for x in out)


def _run(batches):
    for b in batches:
        texts = [main_text(h) for h in b.column(1).to_pylist()]
        yield pa.RecordBatch.from_arrays([b.column(0), pa.array(texts, pa.string())], names=["row", "text"])


def extract(pages: DataFrame, *, html_col: str = "html", keep: tuple[str, ...] = ("page_id", "url")) -> DataFrame:
    """The ``keep`` columns and ``text``, ``n_chars`` of every row; order and repeats as given."""
    kept = F.struct(*[F.col(quoted(c)) for c in keep])
    src = pages.select(kept.alias("row"), F.col(html_col).alias("html"))
    out = src.mapInArrow(_run, StructType([StructField("row", src.schema["row"].dataType), StructField("text", StringType())]))
    return out.select(*[F.col("row")[c].alias(c) for c in keep], "text", F.char_length("text").cast("long").alias("n_chars"))

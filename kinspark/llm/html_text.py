"""Main text of web pages from parser events and text-to-tag ratios.

html.parser's events are folded, as they come, into lines: runs of text between
block-level tags, each with the number of tags since the line before. The
text-to-tag ratios of the lines are smoothed with a Gaussian kernel, and a
threshold (their standard deviation) separates content lines from the rest; the
few largest ratios and lengths are cut to the next one first, so that an outlier
moves neither. The region that holds most of the text of content lines is the main
text: articles and main elements, or without them the deepest container with most of
it, and the content lines elsewhere. A page without a content line has none.

Lines of a region are clustered: where most of its text is in content lines, all of it stays, with its headings
and short items; else only its content lines do, and what stands between two close ones.
So the ratios choose both the region and its lines.

Elements that are menus, footers, sidebars, forms or hidden by their tags or roles are skipped. Class names and
ids only lower the ratios of the lines inside them, the more the plainer they name what
is not main text (HINTS); a block so named goes if most of its text is then not content. A name that only
begins so lowers them by half, and a block that is mostly links goes by its ratios alone.

Forms are skipped, and names counted, only when the whole page is
known: one that encloses a region no lighter than those outside, or (with no
region outside) most of the page's text, is a wrapper of the page and counts as
neither. All regions are taken, unless they hold less than half of the
content; then the container is looked for as if there were none, and they are kept beside it.

Defined results: null and empty pages have empty text; a tag that the end of the page cuts
off within its name or attributes is dropped, any other text after the last "<" is kept; null
ids and urls and repeated rows are kept; other columns are ignored.
"""

from __future__ import annotations

import re
from html.parser import HTMLParser

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .scratch import ship

VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark q s samp small span strike strong sub sup time tt u var wbr img".split())
SKIPPED = frozenset("script style noscript template title head nav footer aside button select option textarea input iframe svg canvas object dialog menu audio video map datalist".split())
WRAPPERS = frozenset(["form", "fieldset"])
CLOSED_BY = {
    "p": frozenset("address article aside blockquote div dl fieldset footer form h1 h2 h3 h4 h5 h6 header hr main menu nav ol p pre section table ul".split()),
    "li": frozenset(["li"]),
    "dt": frozenset(["dt", "dd"]),
    "dd": frozenset(["dt", "dd"]),
    "tr": frozenset(["tr", "tbody", "tfoot"]),
    "td": frozenset(["td", "th", "tr"]),
    "th": frozenset(["td", "th", "tr"]),
    "option": frozenset(["option"]),
    "head": frozenset(["body"]),
}
#: Names of what a page has beside its main text, and by how much each lowers the ratios of lines inside it: remarks of readers,
#: then adverts, notices, menus and the like, then names that main text may have as well.
HINTS = (
    (1 / 64, re.compile(r"^(comments?|commentlist|respond|replies|disqus)$")),
    (
        1 / 16,
        re.compile(
            r"^(ads?|adv|advert\w*|adbox|adslot|banners?|promo\w*|sponsor\w*|side-?bar\w*|sidecol|cookies?|consent|gdpr|notices?|notification\w*|alerts?|newsletter\w*|subscribe\w*|subscription|"
            r"popup|modal|nav\w*|menus?|breadcrumbs?|footer|masthead|login|signin|signup|pagination|pager|outbrain|taboola)$"
        ),
    ),
    (1 / 2, re.compile(r"^(header|overlay|share|sharing|social|related|recommended|reply|search\w*|widgets?|toolbar|skip|copyright|legal)$")),
)
#: Parts of names that say where or how a block stands, not what it holds.
NEUTRAL = frozenset(
    "area bar block body bottom box buttons center col column container footer global group holder home icons inner item items layer left links list main mobile module outer page panel posts primary right row section secondary site slot space top unit view wrap wrapper zone".split()
)
NEGATED = frozenset("has have no not with without is hide show".split())
TITLED = frozenset("entry post article page content story main section blog".split())
ROLES = frozenset("navigation banner complementary contentinfo search form dialog alert alertdialog menu menubar toolbar".split())
HEADINGS = frozenset(["h1", "h2", "h3", "h4", "h5", "h6"])
REGIONS = frozenset(["article", "main"])
PARAGRAPHS = HEADINGS | frozenset("p pre blockquote li dt dd figure figcaption address".split())  # no containers
SIGMA, RADIUS = 1.0, 2
NEAR = 3
SOLID = 0.7
SPACES = re.compile(r"\s+")
#: A tag that the page's end cuts off: its name and any number of attributes, the last of them unfinished.
CUT_OFF = re.compile(r"""<(?:[/!?]?[a-zA-Z][^\s<>/]*(?:\s+[^\s<>"'=/]+\s*=\s*(?:"[^"<>]*"|'[^'<>]*'|[^\s"'<>]+))*(?:\s+[^\s<>"'=/]*(?:\s*=\s*(?:"[^"<>]*|'[^'<>]*|[^\s"'<>]*))?)?\s*/?|[/!?]?|!-[^>]*)$""")
LAST_OPEN = re.compile(r"<(?=[^<>]*$)")


def ended(html: str) -> str:
    """The page without a tag that its end cuts off; a last "<" that begins none is text."""
    cut = CUT_OFF.sub("", html)
    return LAST_OPEN.sub("&lt;", cut) if len(cut) == len(html) else cut


def factor_of(name: str) -> float:
    return next((f for f, pattern in HINTS if pattern.match(name)), 1.0)


def hints(value: str) -> tuple[float, bool]:
    """By how much a class or id lowers ratios (1: not at all), and whether a name does so as a whole: by itself or by parts
    that all tell or are neutral. One that only begins so lowers them by half at most; names that say what a block has
    (has-sidebar) or heads (entry-header) say nothing."""
    factor, whole = 1.0, False
    for name in value.split():
        parts = [x for x in re.split(r"[-_\d]+", name) if x]
        if not parts or parts[0] in NEGATED or parts[-1] == "header" and parts[0] in TITLED:
            continue
        own = min([factor_of(name), *map(factor_of, parts)])
        if own == 1.0:
            continue
        if factor_of(name) < 1 or all(x in NEUTRAL or factor_of(x) < 1 for x in parts):
            factor, whole = min(factor, own), True
        elif factor_of(parts[0]) < 1:
            factor = min(factor, max(own, 1 / 2))
    return factor, whole


class Lines(HTMLParser):
    """Events to lines: (text, tags, link characters, enclosing containers, enclosing ones that are doubtful). A doubtful container has
    a factor: 0 for forms, else that of its name. ``hinted`` are all containers with a telling name, ``blocks`` the other ones
    that may be lists of links."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.open: list[tuple[str, int, bool, bool, bool]] = []  # tag, container number, region, skipped, doubtful
        self.lines: list[tuple[str, int, int, tuple[int, ...], tuple[int, ...]]] = []
        self.factors: dict[int, float] = {}
        self.blocks: set[int] = set()
        self.hinted: set[int] = set()
        self.regions: dict[int, str] = {}
        self.paragraphs: set[int] = set()
        self.text: list[str] = []
        self.tags = self.links = self.anchors = self.made = 0

    def end_line(self) -> None:
        text = SPACES.sub(" ", "".join(self.text)).strip()
        if text:
            inside = tuple(n for _, n, *_ in self.open if n)
            self.lines.append((text, self.tags, self.links, inside, tuple(n for _, n, _, _, maybe in self.open if maybe)))
            self.tags = 0
        self.text, self.links = [], 0

    def skipped(self, tag: str, attrs: list) -> tuple[bool, float, bool]:
        """Whether an element is skipped, else its factor, and whether it is doubtful."""
        if tag in SKIPPED:
            return True, 1.0, False
        inside = any(region for _, _, region, *_ in self.open)
        if tag == "header":
            return not inside, 1.0, False
        factor, doubtful = (0.0, True) if tag in WRAPPERS else (1.0, False)
        for name, value in attrs:
            value = (value or "").lower()
            if name in ("class", "id"):
                if tag not in ("body", "html", "main"):
                    own, whole = hints(value)
                    factor, doubtful = min(factor, own), doubtful or whole
            elif name == "role" and value in ("form", "search"):
                factor, doubtful = 0.0, True
            elif name == "role" and value in ROLES or name == "hidden" or name == "aria-hidden" and value == "true" or name == "style" and re.search(r"display:\s*none|visibility:\s*hidden", value):
                return True, 1.0, False
        return doubtful and tag in INLINE and factor <= 1 / 16, factor, doubtful

    def handle_starttag(self, tag: str, attrs: list) -> None:
        if tag not in INLINE:
            if tag == "br":
                self.text.append(" ")
            else:
                self.end_line()
            while self.open and tag in CLOSED_BY.get(self.open[-1][0], ()):
                self.open.pop()
            if self.open and any(t == "p" for t, *_ in self.open[-4:]) and tag in CLOSED_BY["p"]:
                self.handle_close("p")
        within = bool(self.open) and self.open[-1][3]
        self.tags += not within  # those of what is skipped say nothing about the line after it
        if tag in VOID:
            return
        skip, factor, doubtful = (True, 1.0, False) if within else self.skipped(tag, attrs)
        number = 0
        region = tag in REGIONS or any(n == "role" and v == "main" or n == "itemprop" and v == "articleBody" for n, v in attrs)
        if tag not in INLINE:
            self.made += 1
            number = self.made
            if tag in PARAGRAPHS:
                self.paragraphs.add(number)
            if region and not skip:
                self.regions[number] = tag
            if factor < 1:
                self.factors[number] = factor
                self.hinted.add(number)
            elif tag not in PARAGRAPHS:
                self.blocks.add(number)
        self.open.append((tag, number, region, skip, bool(number and doubtful)))
        self.anchors += tag == "a"

    def handle_startendtag(self, tag: str, attrs: list) -> None:
        self.handle_starttag(tag, attrs)
        if tag not in VOID:
            self.handle_endtag(tag)

    def handle_close(self, tag: str) -> None:
        for i in range(len(self.open) - 1, -1, -1):
            if self.open[i][0] == tag:
                self.anchors -= sum(t == "a" for t, *_ in self.open[i:])
                del self.open[i:]
                return

    def handle_endtag(self, tag: str) -> None:
        self.tags += not self.open or not self.open[-1][3]
        if tag not in INLINE:
            self.end_line()
        self.handle_close(tag)

    def handle_data(self, data: str) -> None:
        if not self.open or not self.open[-1][3]:
            self.text.append(data)
            if self.anchors:
                self.links += len(data)


def smoothed(ratios: np.ndarray) -> np.ndarray:
    """A Gaussian mean over neighbouring lines."""
    kernel = np.exp(-((np.arange(-RADIUS, RADIUS + 1) / SIGMA) ** 2) / 2)
    weight = np.convolve(np.ones(len(ratios)), kernel, "same") if len(ratios) > 2 * RADIUS else None
    if weight is None:
        i = np.arange(len(ratios))
        k = np.exp(-(((i[:, None] - i) / SIGMA) ** 2) / 2)
        return k @ ratios / k.sum(1)
    return np.convolve(ratios, kernel, "same") / weight


def levelled(values: np.ndarray) -> np.ndarray:
    """The largest twentieth (one at least) cut to the next largest value."""
    if len(values) < 3:
        return values
    return np.minimum(values, np.sort(values)[-1 - -(-len(values) // 20)])


def unskipped(parser: Lines) -> tuple[list[tuple], np.ndarray]:
    """The lines outside forms, and the factor of each: the product of those of its doubtful and hinted containers, but for
    containers that enclose the page's own text. These are no reason to lower or leave out anything."""
    size: dict[int, int] = {}
    around: dict[int, tuple[int, ...]] = {}  # of each region, the doubtful blocks around it
    doubtful = {n for *_, maybe in parser.lines for n in maybe}
    for text, _, _, path, maybe in parser.lines:
        for n in path:
            size[n] = size.get(n, 0) + len(text)
            if n in parser.regions:
                around[n] = tuple(m for m in maybe if m in path[: path.index(n) + 1])
    total = sum(len(text) for text, *_ in parser.lines)
    outside = sum(len(text) for text, _, _, path, maybe in parser.lines if not maybe and any(n in parser.regions for n in path))
    spared = set()
    for n, blocks in around.items():
        if n not in blocks and size[n] >= outside:
            spared.update(blocks)
    if not outside:
        spared |= {n for n in doubtful if size[n] > total * (0.9 if 0 < parser.factors[n] < 1 / 16 else 0.5)}
    parser.hinted -= spared
    factor = lambda path: float(np.prod([parser.factors[n] for n in path if n in parser.factors and n not in spared]))
    kept = [(line, f) for line in parser.lines if (f := factor(line[3]))]
    return [line for line, _ in kept], np.array([f for _, f in kept])


def struck(parser: Lines, lines: list[tuple], content: np.ndarray, fair: np.ndarray, region: int) -> set[int]:
    """Containers to leave out: hinted ones most of whose text is not in fair lines, and blocks of links most of
    whose text is not content."""
    size: dict[int, int] = {}
    good: dict[int, int] = {}
    linked: dict[int, int] = {}
    for (text, _, links, path, _), by_ratio, near in zip(lines, content.tolist(), fair.tolist(), strict=True):
        for n in path:
            size[n] = size.get(n, 0) + len(text)
            good[n] = good.get(n, 0) + len(text) * (near if n in parser.hinted else by_ratio)
            linked[n] = linked.get(n, 0) + links
    poor = {n for n in size if 2 * good[n] < size[n] and n not in parser.regions and n != region}
    return {n for n in poor if n in parser.hinted or n in parser.blocks and linked[n] > 0.6 * size[n]}


def clustered(content: np.ndarray, inside: np.ndarray, size: np.ndarray) -> np.ndarray:
    """The lines of a region that stay: all, where SOLID of its text or more is in content lines, as in a text with headings and
    short items; else those lines alone, with what stands between two that are RADIUS lines apart or less."""
    if (size * (content & inside)).sum() >= SOLID * (size * inside).sum():
        return inside
    at = np.flatnonzero(content & inside)
    out = np.zeros(len(content), bool)
    out[at] = True
    for a, b in zip(at[:-1].tolist(), at[1:].tolist(), strict=True):
        if b - a <= RADIUS:
            out[a:b] = True
    return out & inside


def main_text(html: str | None) -> str:
    if not html:
        return ""
    parser = Lines()
    parser.feed(ended(html))
    parser.close()
    parser.end_line()
    lines, factors = unskipped(parser)
    if not lines:
        return ""
    size = np.array([len(text) for text, *_ in lines], float)
    own_ratio = levelled(size / np.array([max(1, tags) for _, tags, *_ in lines])) * factors
    # Lines of firm names say nothing about their neighbours, nor these about them.
    plain = factors >= 1 / 2 if (factors >= 1 / 2).any() else factors > 0
    ratio = own_ratio.copy()
    ratio[plain] = smoothed(own_ratio[plain])
    linked = np.array([links > 0.6 * len(text) for text, _, links, *_ in lines])
    least = ratio.std()
    content = (ratio >= least) & (ratio > 0)
    near = np.where(factors >= 1 / 2, NEAR, 1)  # a short paragraph among long ones is no menu
    fair = content & (factors == 1) | (near * own_ratio >= least) & (ratio > 0)
    by_ratio = content
    if (content & ~linked).any():
        content = content & ~linked
    weight = np.where(content, levelled(size), 0.0)
    if not content.any():
        return ""

    inside: dict[int, float] = {}
    for (_, _, _, path, _), w in zip(lines, weight.tolist(), strict=True):
        for n in path:
            inside[n] = inside.get(n, 0.0) + w
    regions = parser.regions.keys() & inside.keys()
    own = np.array([any(n in regions for n in path) for _, _, _, path, _ in lines])
    best = 0
    if weight[own].sum() >= 0.5 * weight.sum():
        chosen = own
    else:
        best = max((n for n, w in inside.items() if w >= 0.7 * weight.sum() and n not in parser.paragraphs), default=0)
        within = np.array([not best or best in path for _, _, _, path, _ in lines])
        # Beside the container, lines that only their neighbours lift are not content.
        chosen = own | (within | content & (own_ratio >= least)) & ~linked
    gone = struck(parser, lines, by_ratio, fair, best)
    left = np.array([gone.isdisjoint(path) for _, _, _, path, _ in lines])
    stays = clustered(by_ratio, chosen & left, size)
    return "\n\n".join(text for (text, *_), take in zip(lines, stays.tolist(), strict=True) if take)


def extract(pages: DataFrame) -> DataFrame:
    """page_id, url, text and n_chars of every page."""

    def run(batches):
        for batch in batches:
            texts = [main_text(h) for h in batch.column("html").to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [batch.column("page_id"), batch.column("url"), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())],
                ["page_id", "url", "text", "n_chars"],
            )

    ship(pages.sparkSession)
    return pages.select(F.col("page_id").cast("long"), "url", "html").mapInArrow(run, "page_id long, url string, text string, n_chars long")

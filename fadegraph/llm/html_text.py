"""Main text of web pages by tag-path ratios.

A page is cut into blocks, each with the path of block-level tags from the root
to it.  Text length and punctuation are summed for each path and divided by its
number of blocks; these ratios, taken in page order, are smoothed over
neighbouring blocks, fused into one weight for each path, and paths that reach
the spread or the mean of the weights (by their text) hold the content, as does
the path with the most text.  A marked article or main that holds most of what
is marked is the article, and the path with the most text in it is content too;
without one it is the smallest element that holds all of what the paths select.

Blocks of the article whose path is not selected belong to it, unless an element
that says neither by its tag nor by its name that it is text is around them and
around nothing that was selected: such a box is an unlisted notice or advert, if
what it says is light.  Outside a marked article mostly linked blocks do not
belong either.  Elements that by their tag, class or id are menus, notices,
adverts, forms or comments take no part, unless the page's article is in them: a
main, the only articles, or, where next to no text is outside and no article or
main is marked, most of the text.

Elements are numbered as they open and know their parent and the last one inside
them, and paths are numbered too, so a page takes time and memory in proportion
to its length, however deep its elements lie in each other.
"""

from __future__ import annotations

import html
import math
import re
from bisect import bisect_right
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# What the names of elements, classes and ids say about them.
RAW = ("script", "style", "noscript", "template", "textarea", "iframe", "object", "svg", "math", "title", "xmp", "noembed",
       "noframes")
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark q rp rt ruby s samp small "
                   "span strike strong sub sup time tt u var wbr img".split())
ASIDE = frozenset("head nav aside footer form button select option dialog menu fieldset input audio video canvas map".split())
ASIDE_ROLES = frozenset("navigation banner contentinfo complementary search dialog alertdialog alert menu menubar form".split())
_NAMES = (
    r"(?:ad|ads|adv|advert|adverts|advertisement|advertising|banner|sponsor|sponsored|promo|promotion|cookie|cookies|"
    r"consent|gdpr|notice|notices|notification|alert|popup|modal|overlay|sidebar|side|aside|comment|comments|commentlist|"
    r"disqus|reply|replies|respond|discussion|menu|nav|navbar|navigation|breadcrumb|breadcrumbs|pagination|pager|toolbar|"
    r"share|sharing|social|related|recommended|recommendations|newsletter|subscribe|subscription|signup|login|search|"
    r"footer|masthead|widget|widgets|copyright|legal|disclaimer|skip|hidden)")
# A whole class or id, or its first or last part; layouts say of a page that it has or is without something.
ASIDE_NAMES = re.compile(
    r"(?:^|\s)(?:" + _NAMES + r"(?![^\s_\d-])|(?!(?:has|have|no|with|without|is|not|layout|page|content)[_-])[^\s]*[_-]" + _NAMES
    + r"\d*(?!\S))", re.IGNORECASE)
# Tags that are set aside, but may hold a page's article.
WRAPPERS = frozenset("aside form fieldset header".split())
# An element with its own text is never set aside by its name alone.
KEPT_TAGS = frozenset("html body article main".split())
# Tags that end an open one of the kinds named.
CLOSES = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"},
          "option": {"option"}, "thead": {"tr", "td", "th"}, "tbody": {"tr", "td", "th", "thead"}, "tfoot": {"tr", "td", "th", "tbody"}}
SCOPES = {"li": {"ul", "ol"}, "dt": {"dl"}, "dd": {"dl"}, "tr": {"table"}, "td": {"table"}, "th": {"table"}, "option": {"select"},
          "thead": {"table"}, "tbody": {"table"}, "tfoot": {"table"}}
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
# Parts of a text, which are no article by themselves.
PARTS = HEADINGS | frozenset("p ul ol li dl dt dd table caption thead tbody tfoot tr td th blockquote pre figure figcaption header hgroup "
                             "section".split())
# Parts that are text whatever the element around them is called.
SOLID = frozenset("table pre blockquote figure dl".split())
# Names of elements that are text.
TEXT_NAMES = re.compile(
    r"(?:^|[\s_-])(?:abstract|article|author|body|byline|caption|chapter|code|content|date|dateline|dek|entry|figure|footnote|footnotes|"
    r"intro|introduction|lead|lede|main|meta|note|notes|paragraph|post|preface|prose|quote|references|section|source|sources|standfirst|"
    r"story|subtitle|summary|table|text|title)(?![^\s_\d-])", re.IGNORECASE)
PUNCTUATION = re.compile("[.,;:!?。，；：！？]")


def _tokens(closable: tuple[str, ...]) -> re.Pattern:
    """Tags, comments and raw elements; those of ``closable`` may end in their own tag, ``<svg/>``."""
    return re.compile(
        r"<!--.*?(?:-->|\Z)"
        r"|<(?:" + "|".join(closable) + r")(?:/|\s(?:[^>\"']|\"[^\"]*\"|'[^']*')*?/)>"
        r"|<(" + "|".join(RAW) + r")(?=[\s/>])[^>]*>.*?(?:</\1\s*>|\Z)"
        r"|<[!?][^>]*(?:>|\Z)"
        r"|<(/?)([A-Za-z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*)>"
        r"|<(/?)([A-Za-z][^\s/>]*)([^>]*)(?:>|\Z)", re.DOTALL | re.IGNORECASE)


_TOKEN, _XHTML_TOKEN = _tokens(("svg", "math")), _tokens(RAW)
# What a page of XHTML says before its text.
_XHTML = re.compile(r"\s*(?:<\?xml\b|(?:<!--.*?-->|<!doctype\b[^>]*>|\s)*<html\b[^>]*\bxmlns\s*=\s*[\"']http://www\.w3\.org/1999/xhtml)"
                    r"|\s*<!doctype\b[^>]*\bxhtml\b", re.DOTALL | re.IGNORECASE)
# Every attribute in its turn, so that none is found in the value of another.
_ATTRIBUTE = re.compile(r"""([^\s"'>/=]+)(?:\s*=\s*("[^"]*"|'[^']*'|[^\s"'>]+))?""")

SMOOTHING = (0.25, 0.5, 0.25)
MOSTLY_LINKS = 0.5
OWN_SHARE = 0.75
LITTLE = 0.1


# What an element says of itself: that its text is text, nothing, or a name that says neither.
_TEXT, _PLAIN, _NAMED = range(3)


class _Block:
    __slots__ = ("text", "path", "element", "linked", "wrapper")

    def __init__(self, path: int, element: int, wrapper: int):
        self.text, self.path, self.element, self.linked, self.wrapper = "", path, element, 0, wrapper


class _Page:
    """Elements, paths and blocks of a page, by number; 0 is the page itself."""

    def __init__(self) -> None:
        self.parent, self.last, self.tag, self.says = [0], [0], [""], [_TEXT]
        self.paths: dict[tuple[int, str], int] = {}
        self.path_tags: list[frozenset[str]] = [frozenset()]
        self.blocks: list[_Block] = []
        # Set-aside elements that may hold the article, each with the one around it.
        self.wrapper_parent: dict[int, int] = {}
        # Articles and mains outside what is always set aside, each with the innermost wrapper around it.
        self.marked: list[tuple[int, int]] = []

    def open(self, tag: str, parent: int, says: int) -> int:
        self.parent.append(parent)
        self.last.append(len(self.tag))
        self.tag.append(tag)
        self.says.append(says)
        return len(self.tag) - 1

    def path(self, above: int, tag: str) -> int:
        found = self.paths.get((above, tag))
        if found is None:
            found = self.paths[above, tag] = len(self.path_tags)
            known = self.path_tags[above]
            self.path_tags.append(known if tag in known else known | {tag})
        return found

    def holds(self, element: int, inner: int) -> bool:
        return element <= inner <= self.last[element]


def _attributes(text: str) -> list[tuple[str, str]]:
    return [(m.group(1).lower(), (m.group(2) or "").strip("\"'")) for m in _ATTRIBUTE.finditer(text)]


def _hidden(attributes: list[tuple[str, str]]) -> bool:
    return any(name == "hidden" or (name == "aria-hidden" and value.lower() == "true")
               or (name == "style" and re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", value, re.IGNORECASE))
               for name, value in attributes)


def _set_aside(tag: str, attributes: list[tuple[str, str]]) -> str:
    """Whether an element takes no part: ``always``, ``wrapper`` (unless the page's article is in it), or empty."""
    found = ""
    if tag in ASIDE:
        if tag not in WRAPPERS:
            return "always"
        found = "wrapper"
    if not attributes or tag in KEPT_TAGS:
        return found
    if _hidden(attributes):
        return "always"
    for name, value in attributes:
        if name in ("class", "id") and ASIDE_NAMES.search(value) or name == "role" and value.lower() in ASIDE_ROLES:
            found = "wrapper"
    return found


def _says(tag: str, attributes: list[tuple[str, str]]) -> int:
    """A part of a text says so by its tag; another element by its name, if it has one."""
    names = [value for name, value in attributes if name in ("class", "id") and value.strip()]
    if tag in PARTS or tag in KEPT_TAGS or any(TEXT_NAMES.search(v) for v in names):
        return _TEXT
    return _NAMED if names else _PLAIN


class _Reader:
    """Reads a page into elements and blocks."""

    def __init__(self) -> None:
        self.page = _Page()
        self.stack = [0]  # open elements
        self.stack_paths = [0]
        self.open_at: dict[str, list[int]] = {}  # by tag: places in the stack
        self.aside_from = 0  # place of the outermost element that takes no part in any case
        self.wrappers: list[tuple[int, int]] = []  # place and number
        self.link_place = 0
        self.block: _Block | None = None
        self.parts: list[str] = []  # of the open block
        self.inline_hidden: list[str] = []

    def text(self, piece: str) -> None:
        if self.aside_from or self.inline_hidden or not piece:
            return
        if self.block is None:
            if not piece.strip():
                return
            self.block = _Block(self.stack_paths[-1], self.stack[-1], self.wrappers[-1][1] if self.wrappers else 0)
            self.page.blocks.append(self.block)
            self.parts = []
        self.parts.append(piece)
        if self.link_place:
            self.block.linked += len(piece.strip())

    def close_to(self, place: int) -> None:
        """Close the element at a place of the stack and all in it."""
        page = self.page
        while len(self.stack) > place:
            element = self.stack.pop()
            self.stack_paths.pop()
            page.last[element] = len(page.tag) - 1
            self.open_at[page.tag[element]].pop()
        if self.aside_from >= place:
            self.aside_from = 0
        while self.wrappers and self.wrappers[-1][0] >= place:
            self.wrappers.pop()
        if self.link_place > place:
            self.link_place = 0
        self.end_block()

    def end_block(self) -> None:
        if self.block is not None:
            self.block.text = " ".join(html.unescape("".join(self.parts)).split())
            self.block, self.parts = None, []

    def place_of(self, tag: str) -> int:
        """Place of the innermost open element of the tag, 0 if there is none."""
        places = self.open_at.get(tag)
        return places[-1] if places else 0

    def _inline(self, tag: str, ending: bool, attributes: str) -> None:
        if self.inline_hidden:
            if not ending and tag == self.inline_hidden[0] and tag not in VOID:
                self.inline_hidden.append(tag)
            elif ending and tag == self.inline_hidden[0]:
                self.inline_hidden.pop()
            return
        if tag == "a":
            self.link_place = 0 if ending else len(self.stack)
        # What an inline element is called says nothing against its words.
        if not ending and attributes and tag not in VOID and _hidden(_attributes(attributes)):
            self.inline_hidden.append(tag)

    def _make_room(self, tag: str) -> None:
        """Close what the start of an element ends."""
        if self.place_of("p"):
            self.close_to(self.place_of("p"))
        closes = CLOSES.get(tag)
        if closes:
            scope = max(self.place_of(t) for t in SCOPES[tag])
            outer = [places[at] for t in closes if (places := self.open_at.get(t)) and (at := bisect_right(places, scope)) < len(places)]
            if outer:
                self.close_to(min(outer))
        if tag in HEADINGS and self.page.tag[self.stack[-1]] in HEADINGS:
            self.close_to(len(self.stack) - 1)
        if tag == "body" and self.place_of("head"):
            self.close_to(self.open_at["head"][0])

    def tag(self, tag: str, ending: bool, attributes: str) -> None:
        if tag == "br":
            self.text(" ")
        elif tag == "hr":
            self.end_block()
        elif tag in INLINE:
            self._inline(tag, ending, attributes)
        else:
            self.inline_hidden.clear()
            if ending:
                if self.place_of(tag):
                    self.close_to(self.place_of(tag))
                self.end_block()
                return
            self._make_room(tag)
            self.end_block()
            if tag not in VOID:
                self._open(tag, _attributes(attributes) if attributes else [])

    def _open(self, tag: str, attributes: list[tuple[str, str]]) -> None:
        page, place = self.page, len(self.stack)
        # A header is the page's unless it heads an article.
        aside = _set_aside(tag, attributes) or (
            "wrapper" if tag == "header" and not (self.place_of("article") or self.place_of("main")) else "")
        element = page.open(tag, self.stack[-1], _says(tag, attributes))
        if aside == "always" and not self.aside_from:
            self.aside_from = place
        elif aside == "wrapper":
            page.wrapper_parent[element] = self.wrappers[-1][1] if self.wrappers else 0
            self.wrappers.append((place, element))
        elif tag in ("article", "main") and not self.aside_from:
            page.marked.append((element, self.wrappers[-1][1] if self.wrappers else 0))
        self.stack.append(element)
        self.stack_paths.append(page.path(self.stack_paths[-1], tag))
        self.open_at.setdefault(tag, []).append(place)


def read_page(source: str) -> _Page:
    reader, at = _Reader(), 0
    for m in (_XHTML_TOKEN if _XHTML.match(source) else _TOKEN).finditer(source):
        if m.start() > at:
            reader.text(source[at:m.start()])
        at = m.end()
        name = m.group(3) or m.group(6)
        if m.group(1) is None and name is not None:
            reader.tag(name.lower(), bool(m.group(2) or m.group(5)), m.group(4) or m.group(7) or "")
    if at < len(source):
        reader.text(source[at:])
    reader.end_block()
    reader.close_to(1)
    reader.page.last[0] = len(reader.page.tag) - 1
    return reader.page


def _left_out(page: _Page) -> set[int]:
    """Set-aside elements that stay so, and all such inside them."""
    above = page.wrapper_parent  # parents come before what is in them
    clear: set[int] = set()

    def clear_around(wrapper: int) -> None:
        while wrapper and wrapper not in clear:
            clear.add(wrapper)
            wrapper = above[wrapper]

    for element, wrapper in page.marked:
        if page.tag[element] == "main":
            clear_around(wrapper)

    def out() -> set[int]:
        found: set[int] = set()
        for wrapper, parent in above.items():
            if wrapper not in clear or parent in found:
                found.add(wrapper)
        return found

    inside = out()
    if all(wrapper in inside for _, wrapper in page.marked):  # no article is outside
        for _, wrapper in page.marked:
            clear_around(wrapper)
        if not page.marked:
            sizes = dict.fromkeys(above, 0)
            outside = total = 0
            for b in page.blocks:
                size = len(b.text)
                total += size
                if b.wrapper:
                    sizes[b.wrapper] += size
                else:
                    outside += size
            for wrapper in reversed(above):
                if above[wrapper]:
                    sizes[above[wrapper]] += sizes[wrapper]
            if outside < LITTLE * total:
                clear.update(w for w in above if 2 * sizes[w] > total)
    return out()


# A block as it is judged: text, path, innermost element, share of linked text.
Found = tuple[str, int, int, float]


def blocks_of(page: _Page) -> list[Found]:
    """Blocks in page order, without those that are set aside."""
    left_out = _left_out(page)
    return [(b.text, b.path, b.element, min(1.0, b.linked / len(b.text))) for b in page.blocks if b.text and b.wrapper not in left_out]


def _weight(length: float, points: float) -> float:
    return math.log1p(length) * (1.0 + math.log1p(points))


def path_weights(blocks: list[Found]) -> tuple[dict[int, float], dict[int, float]]:
    """Fused weight of each tag path, of smoothed ratios of text and of punctuation to its blocks; and its unlinked text."""
    sums: dict[int, list[float]] = {}
    for body, path, _, linked in blocks:
        s = sums.setdefault(path, [0.0, 0.0, 0.0])
        s[0] += len(body) * (1.0 - linked)
        s[1] += len(PUNCTUATION.findall(body))
        s[2] += 1.0
    lengths = [sums[path][0] / sums[path][2] for _, path, _, _ in blocks]
    points = [sums[path][1] / sums[path][2] for _, path, _, _ in blocks]

    def smooth(values: list[float]) -> list[float]:
        side, middle, other = SMOOTHING
        padded = [values[0], *values, values[-1]]
        return [side * padded[i] + middle * padded[i + 1] + other * padded[i + 2] for i in range(len(values))]

    weights: dict[int, float] = {}
    for (_, path, _, _), length, point in zip(blocks, smooth(lengths), smooth(points)):
        weights[path] = weights.get(path, 0.0) + _weight(length, point)
    return {path: w / sums[path][2] for path, w in weights.items()}, {path: s[0] for path, s in sums.items()}


def _threshold(weights: dict[int, float], sizes: dict[int, float]) -> float:
    """Mean or spread of the weights by text, whichever is larger, but never above the path with the most text."""
    total = sum(sizes.values())
    shares = {p: sizes[p] / total if total else 1.0 / len(sizes) for p in sizes}
    mean = sum(weights[p] * shares[p] for p in weights)
    spread = math.sqrt(sum(shares[p] * (weights[p] - mean) ** 2 for p in weights))
    return min(weights[max(sizes, key=sizes.__getitem__)], max(mean, spread))


def _marked(page: _Page, blocks: list[Found]) -> int | None:
    """The article or main that is the article: it holds most of the text in any such element."""
    if not page.marked:
        return None
    elements = [e for _, _, e, _ in blocks]  # in page order, but not always ascending
    order = sorted(range(len(blocks)), key=elements.__getitem__)
    ascending = [elements[i] for i in order]
    upto = [0.0]
    for i in order:
        upto.append(upto[-1] + len(blocks[i][0]) * (1.0 - blocks[i][3]))

    def size(element: int) -> float:
        return upto[bisect_right(ascending, page.last[element])] - upto[bisect_right(ascending, element - 1)]

    outer, total, end = [], 0.0, -1
    for element, _ in page.marked:
        if element > end:
            outer.append(element)
            total, end = total + size(element), page.last[element]
    for tag in ("article", "main"):
        best = max((e for e, _ in page.marked if page.tag[e] == tag), key=size, default=None)
        if best is not None and size(best) > 0 and 2 * size(best) > total:
            return best
    return None


def _around(page: _Page, chosen: list[int]) -> int:
    """The smallest element around all of some elements that is no part of a text; 0 for the page."""
    at = chosen[0]
    low, high = min(chosen), max(chosen)
    while at and not (at <= low and high <= page.last[at]):
        at = page.parent[at]
    while at and page.tag[at] in PARTS:
        at = page.parent[at]
    return at


def main_text(source: str | None) -> str:
    """Text of the article of a page; empty if there is none."""
    page = read_page(source or "")
    blocks = blocks_of(page)
    if not blocks:
        return ""
    weights, sizes = path_weights(blocks)
    threshold = _threshold(weights, sizes)
    chosen = {path for path, w in weights.items() if w >= threshold}
    article = _marked(page, blocks)
    is_marked = article is not None
    if is_marked:
        own: dict[int, float] = {}
        for body, path, element, linked in blocks:
            if page.holds(article, element):
                own[path] = own.get(path, 0.0) + len(body) * (1.0 - linked)
        chosen.add(max(own, key=own.__getitem__))
    else:
        article = _around(page, [e for _, path, e, _ in blocks if path in chosen])
    around = {0}
    for _, path, element, _ in blocks:
        if path in chosen and page.holds(article, element):
            while element not in around:
                around.add(element)
                element = page.parent[element]
    # Whether a holder may be plain: not where the article is all of the page.
    bounded = page.tag[article] not in ("", "html", "body")

    # By element: whether it and all up to the article or something chosen are text by what they say.
    open_ = {article: True}

    def belongs(element: int) -> bool:
        way = []
        while element not in open_ and element not in around:
            way.append(element)
            element = page.parent[element]
        value = open_.get(element, True)
        for e in reversed(way):
            value = value and (page.says[e] == _TEXT or (bounded and page.says[e] == _PLAIN))
            open_[e] = value
        return value

    taken = []
    follows = False  # whether the next block but headings is given
    for body, path, element, linked in reversed(blocks):
        inside = page.holds(article, element)
        tags = page.path_tags[path]
        given = inside and path in chosen
        heading = not HEADINGS.isdisjoint(tags)
        if inside and not given and (linked < MOSTLY_LINKS or (is_marked and belongs(element))):
            given = (belongs(element) or not SOLID.isdisjoint(tags)
                     or _weight(len(body) * (1.0 - linked), len(PUNCTUATION.findall(body))) >= OWN_SHARE * threshold
                     or (heading and (follows or "h1" in tags)))
        if given:
            taken.append(body)
        if given or not heading:
            follows = given
    return " ".join(reversed(taken))


def _extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        texts = [main_text(page) for page in batch.column("html").to_pylist()]
        yield pa.RecordBatch.from_arrays(
            [batch.column("page_id"), batch.column("url"), pa.array(texts, pa.string()),
             pa.array([len(t) for t in texts], pa.int64())], ["page_id", "url", "text", "n_chars"])


def extract_text(pages: DataFrame, page_id: str = "page_id", url: str = "url", html_: str = "html") -> DataFrame:
    """Main text of each page: (page_id, url, text, n_chars), one row for each row of ``pages``.

    The whole page is read, however long or broken.  Character references are
    decoded, white space within a block becomes one space, blocks are joined in
    page order by one space.  A null or empty page, or one without text outside
    the parts that are set aside, has an empty text.  Null ids and urls stay
    null, repeated rows are kept, other columns are dropped, and an empty table
    gives an empty result.
    """
    rows = pages.select(F.col(page_id).cast("long").alias("page_id"), F.col(url).cast("string").alias("url"),
                        F.col(html_).cast("string").alias("html"))
    return rows.mapInArrow(_extract, "page_id long, url string, text string, n_chars long")

"""Main text of HTML pages by the distribution of line blocks.

Markup is stripped first: scripts, styles, comments, navigation, headers,
footers, sidebars, forms and elements whose class or id marks them as adverts,
menus, notices or reader comments go with all they hold. Names that articles use as well, such
as search, legal or social, only count alone or with a word for a page's furniture (share-bar),
and within an article only for an element whose lines the block measure finds silent too:
no block of them rises above ``surge``. What remains is a list
of lines, one per block element, each with its length, the share of it that is
link text, and the element that holds it.

Line blocks are then summed: the weight of a line is the length of its text
outside links, and the block at a line sums the weights of ``window`` lines from
there on. The text surges where a block rises above ``surge`` characters out of
silence and dives where the blocks fall back to the silence of ``dive``
characters. The stretch with the most text between a surge and a dive is the
core. An article or main element that holds nearly all the core's text overrides
the method: all its lines are kept, and no others. Elsewhere the innermost container
that holds every line from the first surge to the last dive, and the headings
directly above, is kept whole, so that short first and last paragraphs and lines
between two surges stay; if that is only the body, the lines from the first surge
to the last dive are kept, with the headings directly above.

A page without a surge (short ones) keeps the lines of its article or main
element, or else all lines outside links. Null or empty html gives an empty
text. Unclosed tags, comments, scripts and quotes end with the page. Repeated rows give
repeated results; only the key columns and the html are read, so other columns
of any name do no harm.
"""

from __future__ import annotations

import re
from bisect import bisect_left, bisect_right
from collections import Counter
from collections.abc import Iterator, Sequence
from dataclasses import dataclass, field
from html import unescape

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

WINDOW = 3
SURGE = 80
DIVE = 0
# The article element holds this share of the core's text.
MOST_OF_CORE = 0.9

TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)"
    r"|<!\[CDATA\[.*?(?:\]\]>|\Z)"
    r"|<[!?][^>]*(?:>|\Z)"
    r"|<(?P<close>/?)(?P<name>[A-Za-z][^\s/>]*)"
    r"(?P<attributes>(?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+|[^>]*)(?:>|\Z)",
    re.DOTALL,
)
NAMED = re.compile(r"""(?<![\w-])(class|id|role)\s*=\s*("[^"]*"|'[^']*'|[^\s>]+)""", re.IGNORECASE)
SPACE = re.compile(r"\s+")

RAW = frozenset("script style noscript template textarea title iframe svg select option annotation annotation-xml".split())
BOILERPLATE = frozenset("nav footer aside form button dialog menu head fieldset".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
INLINE = frozenset(
    "a abbr acronym b bdi bdo big br cite code data del dfn em font i img input ins kbd label mark q"
    " rp rt ruby s samp small span strike strong sub sup time tt u var wbr"
    " math maction merror mfrac mi mmultiscripts mn mo mover mpadded mphantom mroot mrow ms mspace msqrt mstyle"
    " msub msubsup msup mtext munder munderover semantics object".split()
)
ARTICLE = frozenset(("article", "main"))
BOXES = frozenset(("div", "section", "td", "center", "blockquote"))
# An opening tag of the first kind ends an open one of the second.
ENDED_BY = {
    "li": frozenset(("li",)),
    "dt": frozenset(("dt", "dd")),
    "dd": frozenset(("dt", "dd")),
    "tr": frozenset(("tr", "td", "th")),
    "td": frozenset(("td", "th")),
    "th": frozenset(("td", "th")),
}
MARKED = re.compile(
    r"^(?:(?:site|page|main|global|top)[_-]?)?header$|^adsbygoogle$"
    r"|(?:^|[_-])(?:ads?|advert\w*|sponsor\w*|banner|sidebar|menu|nav|navbar|navigation"
    r"|breadcrumbs?|cookies?|consent|popup|modal|overlay|newsletter|subscribe|signup"
    r"|related|recommended|comments?|commentlist|respond|replies|disqus"
    r"|footer|masthead|topbar|toolbar|pagination|pager|login)(?=$|[_\d-])",
    re.IGNORECASE,
)
# Names that articles use as well.
AMBIGUOUS = re.compile(
    r"^(?:(?:site|page|top|main|post|entry)[_-])?(?:promo\w*|side|notices?|alert|share|sharing|social|widget|skip"
    r"|search|legal|copyright)(?:[_-]?(?:bars?|box(?:es)?|buttons?|links?|lists?|icons?|widgets?|wrap(?:per)?"
    r"|container|tools?|menu|panel|block|area|form|banner|message|info|content|to|\d+))*$",
    re.IGNORECASE,
)
# Names that say what else is on the page, such as has-sidebar.
BESIDE = ("has-", "with-", "no-", "without-", "is-", "has_", "with_", "no_")
ROLES = frozenset("navigation banner contentinfo complementary search form dialog alert menu menubar".split())


@dataclass
class Line:
    text: str
    weight: int
    element: int
    heading: bool


@dataclass
class Elements:
    """Elements numbered in page order; 0 is the body.

    The elements inside number n are those from n + 1 to ``last[n]``.
    """

    names: list[str] = field(default_factory=lambda: ["body"])
    parents: list[int] = field(default_factory=lambda: [0])
    last: list[int] = field(default_factory=lambda: [0])

    def open(self, name: str, parent: int) -> int:
        self.names.append(name)
        self.parents.append(parent)
        self.last.append(len(self.names) - 1)
        return len(self.names) - 1

    def close(self, number: int) -> None:
        self.last[number] = len(self.names) - 1

    def chain(self, number: int) -> list[int]:
        """From the body down to the element."""
        found = [number]
        while found[-1]:
            found.append(self.parents[found[-1]])
        return found[::-1]

    def inside(self, line: Line, number: int) -> bool:
        return number <= line.element <= self.last[number]


@dataclass
class Builder:
    """Collects lines while the markup is read."""

    lines: list[Line] = field(default_factory=list)
    parts: list[str] = field(default_factory=list)
    linked: int = 0

    def add(self, text: str, in_link: bool) -> None:
        self.parts.append(text)
        if in_link:
            self.linked += len(text.strip())

    def end(self, element: int, heading: bool) -> None:
        text = SPACE.sub(" ", "".join(self.parts)).strip()
        if text:
            self.lines.append(Line(text, max(len(text) - self.linked, 0), element, heading))
        self.parts.clear()
        self.linked = 0


def marks_boilerplate(name: str, attributes: str, inside_article: bool) -> bool | None:
    """Whether an element is boilerplate by its tag and names; None leaves it to its lines."""
    if name in BOILERPLATE or (name == "header" and not inside_article):
        return True
    if not attributes or name in ("html", "body", "article", "main"):
        return False
    found: bool | None = False
    for key, value in NAMED.findall(attributes):
        for token in value.strip("\"'").lower().split():
            if key.lower() == "role":
                if token in ROLES:
                    return True
            elif not token.startswith(BESIDE):
                if MARKED.search(token):
                    return True
                if AMBIGUOUS.match(token):
                    if not inside_article:
                        return True
                    found = None
    return found


def lines_of(html: str) -> tuple[list[Line], Elements, list[int]]:
    """The lines outside boilerplate, all elements, and those that their lines may show to be some."""
    built, elements = Builder(), Elements()
    opened: Counter[str] = Counter()
    doubtful: list[int] = []
    stack: list[tuple[str, int, bool]] = []  # name, number, whether it starts boilerplate
    skipped = links = inside = 0
    heading = False
    at = 0

    def current() -> int:
        return stack[-1][1] if stack else 0

    def leave(depth: int) -> None:
        nonlocal skipped, links, inside, heading
        while len(stack) > depth:
            name, number, boilerplate = stack[-1]
            if name not in INLINE:
                built.end(number, heading)
            stack.pop()
            elements.close(number)
            opened[name] -= 1
            skipped -= boilerplate
            links -= name == "a"
            inside -= name in ARTICLE
            heading = heading and not re.fullmatch("h[1-6]", name)

    while at < len(html):
        token = TOKEN.search(html, at)
        text = html[at : token.start() if token else len(html)]
        if text and not skipped:
            built.add(unescape(text) if "&" in text else text, links > 0)
        if token is None:
            break
        at = max(token.end(), token.start() + 1)
        if token["name"] is None:
            continue
        name = token["name"].lower()
        if token["close"]:
            if opened[name]:
                depth = len(stack) - 1
                while stack[depth][0] != name:
                    depth -= 1
                leave(depth)
            elif name not in INLINE:
                built.end(current(), heading)
            continue
        if name in RAW:
            end = re.compile(rf"</{re.escape(name)}\s*>", re.IGNORECASE).search(html, at)
            if not token["attributes"].rstrip().endswith("/"):
                at = end.end() if end else len(html)
            continue
        if name == "br":
            built.add(" ", False)
        if name not in INLINE:
            built.end(current(), heading)
            close = {"p"} | ENDED_BY.get(name, frozenset())
            for depth in range(len(stack) - 1, -1, -1):
                if stack[depth][0] in close:
                    leave(depth)
                    break
                if stack[depth][0] not in INLINE:
                    break
        if name in VOID or token["attributes"].rstrip().endswith("/"):
            continue
        boilerplate = marks_boilerplate(name, token["attributes"], inside > 0)
        if boilerplate is not False and not skipped and name not in INLINE:
            built.end(current(), heading)
        number = elements.open(name, current())
        if boilerplate is None:
            doubtful.append(number)
        boilerplate = bool(boilerplate)
        stack.append((name, number, boilerplate))
        opened[name] += 1
        skipped += boilerplate
        links += name == "a"
        inside += name in ARTICLE
        heading = heading or bool(re.fullmatch("h[1-6]", name))
    leave(0)
    built.end(0, False)
    elements.close(0)
    return built.lines, elements, doubtful


def without_silent(
    lines: list[Line], elements: Elements, doubtful: Sequence[int], window: int, surge: int
) -> list[Line]:
    """The lines without those of doubtful elements in which no block rises above ``surge``."""
    order = sorted(range(len(lines)), key=lambda i: lines[i].element)
    numbers = [lines[i].element for i in order]
    silent: set[int] = set()
    for number in doubtful:
        low, high = bisect_left(numbers, number), bisect_right(numbers, elements.last[number])
        inside = sorted(order[low:high])
        if not stretches([lines[i].weight for i in inside], window, surge, 0):
            silent.update(inside)
    return [x for i, x in enumerate(lines) if i not in silent]


def stretches(weights: Sequence[int], window: int, surge: int, dive: int) -> list[tuple[int, int]]:
    """Line ranges from a surge to the dive that follows it."""
    total = sum(weights[:window])
    blocks = []
    for i, weight in enumerate(weights):
        blocks.append(total)
        total += (weights[i + window] if i + window < len(weights) else 0) - weight
    found, start = [], None
    for i, block in enumerate(blocks):
        if start is None and block > surge:
            start = i
        elif start is not None and block <= dive:
            found.append((start, i))
            start = None
    if start is not None:
        found.append((start, len(blocks)))
    return found


def shared_container(lines: Sequence[Line], elements: Elements, share: float) -> int:
    """The innermost element that holds ``share`` (over a half) of the text of the lines."""
    held = [0] * len(elements.names)
    for line in lines:
        held[line.element] += line.weight
    for number in range(len(held) - 1, 0, -1):
        held[elements.parents[number]] += held[number]
    return max(number for number, weight in enumerate(held) if weight >= share * held[0])


def common_chain(lines: Sequence[Line], elements: Elements) -> list[int]:
    """The elements that hold all of the lines, from the body inwards."""
    first, last = min(x.element for x in lines), max(x.element for x in lines)
    return [e for e in elements.chain(first) if elements.last[e] >= last]


def main_text(
    html: str | None,
    window: int = WINDOW,
    surge: int = SURGE,
    dive: int = DIVE,
    share: float = MOST_OF_CORE,
) -> str:
    if not html:
        return ""
    lines, elements, doubtful = lines_of(html)
    if doubtful:
        lines = without_silent(lines, elements, doubtful, window, surge)
    weights = [line.weight for line in lines]
    found = stretches(weights, window, surge, dive)
    if found:
        first, last = max(found, key=lambda f: sum(weights[f[0] : f[1]]))
        chain = elements.chain(shared_container(lines[first:last], elements, share))
        article = [e for e in chain if elements.names[e] in ARTICLE]
        if article:
            boxes = article
        else:
            start = found[0][0]
            while not lines[start].heading and not weights[start]:
                start += 1
            while start > 0 and lines[start - 1].heading:
                start -= 1
            holders = common_chain(lines[start : found[-1][1]], elements)
            boxes = [e for e in holders if elements.names[e] in BOXES]
        if boxes:
            kept = [x for x in lines if elements.inside(x, boxes[-1])]
        else:
            start = found[0][0]
            while not lines[start].heading and weights[start] < surge // 2:
                start += 1
            while start > 0 and lines[start - 1].heading:
                start -= 1
            kept = lines[start : found[-1][1]]
    else:
        articles = [e for e, name in enumerate(elements.names) if name in ARTICLE]
        kept = [x for x in lines if any(elements.inside(x, e) for e in articles[:1])]
        kept = kept or [x for x in lines if x.weight]
    return "\n".join(x.text for x in kept)


def extracted(pages: DataFrame, keys: Sequence[str], html: str = "html", **settings) -> DataFrame:
    """Key columns, ``text`` and its length ``n_chars`` for every row."""

    @F.pandas_udf("string")
    def texts(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for batch in batches:
            yield batch.map(lambda page: main_text(page, **settings)).astype(object)

    return pages.select(*[F.col(k) for k in keys], texts(F.col(html)).alias("text")).withColumn(
        "n_chars", F.length("text").cast("long")
    )

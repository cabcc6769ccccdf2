"""Main text of web pages by line-block distribution.

A page is stripped to lines: one for each block element, with its text (character
references decoded, white space made one space), how much of it is link text,
and whether it lies in a part that is never article text (menus, headers,
footers, sidebars, notices, adverts, forms, comments, by element, role or name).

The weight of a line is the length of its own text without links.  Sums over
windows of ``WINDOW`` lines rise at a surge point, where a weighing line begins a
window of at least SURGE characters, and end at a dive point, behind which a whole
window weighs nothing.  What stands between surge and dive is kept in page order,
joined by spaces, with the short lines in it and those just before its surge.

Markup only shifts weights.  Lines of ``<article>`` or ``<main>`` weigh SURGE more, so
each of them is a surge, and other lines then weigh nothing, unless they hold more
than twice as much text (the article is a teaser).  Lines of parts that are no
article are taken out before windows are laid, so they end no region.  Such
parts are known by their element, role or hiding, or by class and id names; a
name that may mean something else (``social-policy``) counts only where the parts so
named hold less text than the rest of the page, any name only where other
text is left.  Inside an article fewer names count, and never those of headings and paragraphs.

Edge cases: null and empty html give an empty text; broken or unclosed markup is
read as far as it goes; a page without text gives an empty text; repeated rows
give equal results; an empty table gives an empty result; other columns are not
read.
"""

from __future__ import annotations

import html as entities
import re
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

WINDOW = 3
#: Characters in a window at which a region begins.
SURGE = 80

_MARKUP = re.compile(
    r"<!--.*?(?:-->|\Z)|<[!?][^>]*>|<(/?)([a-zA-Z][a-zA-Z0-9:-]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*+)>", re.S)
_ATTRIBUTE = re.compile(r"([a-zA-Z-]+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>\"']+)))?")

# HTML elements by what they mean here.
_RAW = frozenset("script style noscript template iframe object svg math canvas textarea select title head".split())
_BLOCK = frozenset(
    "address article aside blockquote body caption dd details dialog div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6"
    " header hr html legend li main menu nav ol p pre section summary table tbody td tfoot th thead tr ul".split())
_HOLDS = _BLOCK - frozenset("p li dt dd hr tr td th tbody thead tfoot h1 h2 h3 h4 h5 h6 html body caption legend summary".split())
_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
_ASIDE = frozenset("nav footer aside form menu dialog button label".split())
_ASIDE_STARTS = ("comment", "advert", "sponsor", "cookie", "newsletter", "sidebar", "navbar", "breadcrumb", "footer", "subscri", "recommend")
_ASIDE_ROLES = frozenset("navigation banner contentinfo complementary search alert alertdialog dialog menu menubar form".split())
_ASIDE_NAMES = frozenset(
    "ad ads advert adverts advertisement advertising sponsor sponsored promo promotion banner cookie cookies consent gdpr notice notices alert"
    " popup modal overlay newsletter subscribe subscription signup sidebar side rail nav navbar navigation menu breadcrumb breadcrumbs footer"
    " foot header masthead topbar toolbar comment comments disqus reply replies respond discussion share sharing social related recommended"
    " recommendations pagination pager login search widget widgets hidden skip".split())

#: Names that mean no article text inside an article too (``discussion``, ``related`` and others may be its sections).
_INSIDE_NAMES = frozenset(
    "ad ads advert adverts advertisement advertising sponsored gdpr popup modal newsletter signup sidebar navbar breadcrumb breadcrumbs"
    " masthead topbar toolbar comments commentlist disqus pagination pager".split())
_TEXT_OF = frozenset("p h1 h2 h3 h4 h5 h6".split())


#: How sure it is that a part is no article: not, by a name of other meanings, by a name, by its element, role or hiding.
PLAIN, NAMED, SURELY_NAMED, ASIDE = range(4)


@dataclass
class Line:
    text: str
    links: int
    aside: int
    inside: bool

    @property
    def weight(self) -> int:
        return max(0, len(self.text) - self.links)


def _aside(name: str, attributes: str, inside: bool) -> int:
    """How sure it is that an element begins a part that is no article text."""
    if name in _ASIDE or (name == "header" and not inside):
        return ASIDE
    if not attributes.strip(" /") or name in ("article", "main", "body", "html"):
        return PLAIN
    found = PLAIN
    for m in _ATTRIBUTE.finditer(attributes):
        key, value = m[1].lower(), (m[2] or m[3] or m[4] or "").lower()
        if key in ("class", "id"):
            for one in value.split():
                words = [w for w in re.split(r"[^a-z]+", one) if w]
                if inside:
                    known = () if name in _TEXT_OF else _INSIDE_NAMES
                    sure = True
                else:
                    known = _ASIDE_NAMES
                    sure = all(w in known for w in words) or any(w.startswith(_ASIDE_STARTS) for w in words)
                if any(w in known for w in words) or (not inside and any(w.startswith(_ASIDE_STARTS) for w in words)):
                    found = max(found, SURELY_NAMED if sure else NAMED)
        if (key == "role" and value in _ASIDE_ROLES) or (key == "aria-hidden" and value == "true") or (key == "hidden" and value != "until-found"):
            return ASIDE
        if key == "style" and re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", value):
            return ASIDE
    return found


def lines_of(page: str) -> list[Line]:
    """The non-empty lines of a page, in order."""
    lines: list[Line] = []
    pieces: list[str] = []
    link_pieces: list[str] = []
    stack: list[tuple[str, int, bool]] = []  # (element, how surely it begins an aside, it is the article)
    asides = [0, 0, 0, 0]  # open elements of each sureness
    articles = links = 0
    open_names: dict[str, int] = {}
    unclosed: set[str] = set()

    def close_line() -> None:
        text = " ".join(entities.unescape("".join(pieces)).split())
        if text:
            link_text = " ".join(entities.unescape("".join(link_pieces)).split())
            lines.append(Line(text, len(link_text), max((k for k in (NAMED, SURELY_NAMED, ASIDE) if asides[k]), default=PLAIN), articles > 0))
        pieces.clear()
        link_pieces.clear()

    def pop() -> str:
        nonlocal articles
        name, aside, article = stack.pop()
        open_names[name] -= 1
        asides[aside] -= 1
        articles -= article
        return name

    def add(text: str) -> None:
        pieces.append(text)
        if links:
            link_pieces.append(text)

    at, n = 0, len(page)
    while at < n:
        m = _MARKUP.search(page, at)
        if not m:
            add(page[at:])
            break
        if m.start() > at:
            add(page[at : m.start()])
        at = m.end()
        name = (m[2] or "").lower()
        if not name:
            continue
        if m[1]:
            if name == "a":
                links = max(0, links - 1)
            if name in _BLOCK:
                close_line()
            if open_names.get(name):
                while pop() != name:
                    pass
            continue
        if name in _RAW:
            if not m[3].endswith("/") and name not in unclosed:
                end = re.compile(rf"</{name}[\s>/]|<body[\s>]" if name == "head" else rf"</{name}[\s>/]", re.I).search(page, at)
                if end is not None:
                    at = end.start()
                elif name in ("script", "style", "title", "textarea"):
                    at = n
                else:
                    unclosed.add(name)
            continue
        if name in _BLOCK:
            close_line()
            while stack and stack[-1][0] in ("p", "h1", "h2", "h3", "h4", "h5", "h6") and name not in ("hr",):
                pop()
            if stack and stack[-1][0] == name and name in ("li", "dt", "dd", "td", "th", "tr"):
                pop()
        elif name == "br":
            add(" ")
        if name == "a":
            links += 1
        if name in _VOID or m[3].endswith("/"):
            continue
        aside = _aside(name, m[3], articles > 0)
        if aside and name not in _BLOCK:
            close_line()
        if aside or name in _HOLDS:
            article = name in ("article", "main")
            stack.append((name, aside, article))
            open_names[name] = open_names.get(name, 0) + 1
            asides[aside] += 1
            articles += article
    close_line()
    return lines


def regions(weights: list[int], surge: int) -> list[tuple[int, int]]:
    """(first, end) of the stretches between surge and dive points."""
    n = len(weights)
    ahead = [0] * (n + 1)
    for i in range(n - 1, -1, -1):
        ahead[i] = ahead[i + 1] + weights[i]
    window = lambda i: ahead[i] - ahead[min(n, i + WINDOW)]
    out, i = [], 0
    while i < n:
        if not weights[i] or window(i) < surge:
            i += 1
            continue
        end = i + 1
        while end < n and window(end):
            end += 1
        out.append((i, end))
        i = end
    return out


def article_lines(lines: list[Line]) -> list[Line]:
    """Lines without those of parts that are no article."""
    held = [sum(x.weight for x in lines if x.aside == level) for level in (PLAIN, NAMED, SURELY_NAMED)]
    most = PLAIN
    if held[NAMED] > held[PLAIN]:
        most = NAMED
    if not sum(held[: most + 1]):
        most = SURELY_NAMED
    return [x for x in lines if x.aside <= most]


def main_text(page: str | None) -> str:
    if not page:
        return ""
    lines = article_lines(lines_of(page))
    within, beyond = (sum(x.weight + 1 for x in lines if x.inside == side) for side in (True, False))
    trusted = within > 0 and 2 * within >= beyond - sum(1 for x in lines if not x.inside)
    if trusted:
        weights = [SURGE + x.weight if x.inside else 0 for x in lines]
    else:
        weights = [x.weight for x in lines]
    found = regions(weights, SURGE) or regions(weights, 1)
    keep: list[str] = []
    done = 0
    for first, end in found:
        # A heading just before a surge belongs to it.
        while first > done and weights[first - 1]:
            first -= 1
        keep += [x.text for x in lines[first:end] if x.inside or not trusted]
        done = end
    return " ".join(keep)


def extract_text(pages: DataFrame, *, html: str = "html", keep: tuple[str, ...] = ("page_id", "url")) -> DataFrame:
    """The columns of ``keep`` and the main ``text`` of every row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first in range(0, batch.num_rows, 1000):
                part = batch.slice(first, 1000)
                texts = pa.array([main_text(t.as_py()) for t in part.column(part.num_columns - 1)], pa.string())
                yield pa.record_batch([*part.columns[:-1], texts], [*part.schema.names[:-1], "text"])

    rows = pages.select(*[F.col(f"`{c}`") for c in keep], F.col(f"`{html}`").alias("_html_"))
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields[:-1])
    return rows.mapInArrow(run, f"{fields}, text string")

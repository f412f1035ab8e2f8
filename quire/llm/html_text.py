"""Main text of web pages by line-block distribution.

Markup is stripped so that every block of the page is a line; what is never text of an article
(scripts, menus, headers, footers, sidebars, adverts, notices, forms, comments) leaves empty
lines.  The text lengths over a sliding window of lines rise at surge points, where a window
first holds more than the threshold, and fall to nothing at dive points.  The lines of each
stretch around a surge, from its first line of text to its dive, are kept.
"""

from __future__ import annotations

import html
import re
from collections import Counter, defaultdict
from collections.abc import Iterable

import pyarrow as pa
from pyspark.sql import Column

from quire.llm.common import arrow_column

#: Lines in a window, and characters in one that make a surge (less where the whole page has
#: less: then half of its fullest window).
WINDOW, SURGE = 3, 80

# fixed values: element names, and words of class, id and role names
_RAW = "script|style|textarea|title"
#: Elements that are no text but may stand inside a line of it.
EMBEDDED = set("noscript template iframe svg select object canvas audio video annotation annotation-xml".split())
INLINE = set(
    "a abbr acronym b bdi bdo big cite code data del dfn em font i img ins kbd label mark q rp rt ruby s samp "
    "small span strike strong sub sup time tt u var wbr "
    "math maction menclose merror mfrac mi mmultiscripts mn mo mover mpadded mphantom mprescripts mroot mrow ms "
    "mspace msqrt mstyle msub msubsup msup mtable mtd mtext mtr munder munderover semantics".split()
)
BOILERPLATE = set("nav header footer aside form menu head dialog button fieldset".split())
SECTIONS = set("section aside nav header footer main article body html".split())
IN_HEAD = set("base link meta noscript script style template title".split())
VOID = set("area base br col embed hr img input link meta param source track wbr".split())
HINTS = set(
    "ad ads adv advert adverts advertisement advertising adsense banner promo promotion sponsor sponsored cookie "
    "cookies consent gdpr notice notices alert popup modal overlay newsletter subscribe subscription signup login "
    "sidebar sidebars aside menu menus nav navbar navigation breadcrumb breadcrumbs header masthead topbar footer "
    "comment comments commentlist respond disqus discussion replies related recommended recommendations share "
    "sharing social widget widgets pagination pager toolbar search".split()
)
COMMENTS = set("comment comments commentlist respond disqus replies".split())
SIDEBARS = set("sidebar sidebars aside related recommended recommendations widget widgets".split())
#: Parts that make a name tell of the layout around an element, as in has-sidebar.
LAYOUT = set("no not has have with without and is hide show".split())
CONTENT = set("content article post entry story main maincontent articlebody".split())
ROLES = set("navigation banner contentinfo complementary search form dialog alert alertdialog menu menubar".split())
#: Elements that a new one ends, and those it looks no further than.
IMPLIED = {
    "li": ({"li"}, {"ul", "ol", "menu"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}),
    "td": ({"td", "th"}, {"tr", "table"}), "th": ({"td", "th"}, {"tr", "table"}), "tr": ({"tr"}, {"table"}),
}

_HIDDEN = re.compile(rf"<!--|<({_RAW})\b|<[!?]", re.I)
_RAW_END = {name: re.compile(rf"</{name}\s*+>", re.I) for name in _RAW.split("|")}
_TAG = re.compile(r"""<(/?)([a-zA-Z][a-zA-Z0-9:-]*+)((?:[^>"']++|"[^"]*+"|'[^']*+')*+>|[^<>]*+>)""")
#: A tag that the page ends in.
_CUT_TAG = re.compile(r"<(/?)([a-zA-Z][a-zA-Z0-9:-]*+)([^<>]*+)\Z")
_ATTRIBUTE = re.compile(r"""\b(class|id|role|style|aria-hidden|hidden)\b\s*(?:=\s*("[^"]*"|'[^']*'|[^\s"'>]+))?""", re.I)
_PARTS = re.compile(r"[^a-z]+")
_CAMEL = re.compile(r"(?<=[a-z])(?=[A-Z])")

#: What an element is: text; a wrapper by its name only, or a form, which may hold the page's
#: text; never text itself, though an article may start in it; never text, nor is an article in it.
TEXT, WRAPPER, PLAIN, APART = range(4)


def boilerplate(tag: str, attributes: str, article: bool = False) -> int:
    """What an element is by its name, role, class or id; ``article``: whether it is in one."""
    if tag in EMBEDDED or tag in ("aside", "footer"):
        return APART
    kind = WRAPPER if tag in ("form", "fieldset") else PLAIN if tag in BOILERPLATE else TEXT
    if not attributes or tag in ("body", "html", "article", "main"):
        return kind
    for name, value in _ATTRIBUTE.findall(attributes):
        name, value = name.lower(), value.strip("\"'")
        if name == "hidden" or name == "aria-hidden" and value.lower() == "true":
            return APART
        if name == "style" and re.search(r"display\s*:\s*none", value, re.I):
            return APART
        if name == "role" and value.lower() in ROLES:
            role = value.lower()
            kind = max(kind, APART if role in ("complementary", "contentinfo") else WRAPPER if role == "form" else PLAIN)
        if name in ("class", "id"):
            names = [[x for x in _PARTS.split(_CAMEL.sub("-", x).lower()) if x] for x in value.split()]
            if any(len(p) == 1 and p[0] in CONTENT for p in names):
                continue
            for p in names:
                if not p or LAYOUT & set(p) or p[0] not in HINTS and p[-1] not in HINTS:
                    continue
                if p[0] in COMMENTS or p[-1] in COMMENTS:
                    return APART
                if not (article and tag == "section"):
                    kind = max(kind, APART if p[-1] in SIDEBARS else WRAPPER)
    return kind


def _ends(tags: list[tuple[bool, str, str]]) -> dict[int, tuple[int, bool]]:
    """For each start tag of an element with an end: the tag before which it ends, and whether
    that is its own end tag.

    Blocks end an open paragraph, items the item before, and an end tag all that is open inside
    its element.  Only sections end an article that is open inside them.
    """
    ends: dict[int, tuple[int, bool]] = {}
    stack: list[tuple[str, int]] = []
    scopes: list[Counter[str]] = [Counter()]  # open elements by name, from an article on each
    every: Counter[str] = Counter()
    held: set[int] = set()  # embedded elements whose own end tag is the next of that name
    # places on the stack, the innermost last: of each name, of blocks, of held elements
    named: defaultdict[str, list[int]] = defaultdict(list)
    blocks: list[int] = []
    fixed: list[int] = []

    def pop(size: int, at: int, own: bool) -> None:
        while len(stack) > size:
            tag, i = stack.pop()
            ends[i] = (at, own and len(stack) == size)
            every[tag] -= 1
            if tag in ("article", "main"):
                scopes.pop()
            scopes[-1][tag] -= 1
            for places in (named[tag], blocks, fixed):
                if places and places[-1] == len(stack):
                    places.pop()

    def push(tag: str, at: int) -> None:
        named[tag].append(len(stack))
        if tag not in INLINE and tag not in EMBEDDED and tag != "p":
            blocks.append(len(stack))
        if at in held:
            fixed.append(len(stack))
        stack.append((tag, at))
        every[tag] += 1
        scopes[-1][tag] += 1
        if tag in ("article", "main"):
            scopes.append(Counter())

    def implied(wanted: set[str], stops: Iterable[list[int]], at: int) -> None:
        """End the innermost wanted element that no stop is inside of."""
        k = max((named[t][-1] for t in wanted if named[t]), default=-1)
        if k > max((x[-1] for x in (*stops, fixed) if x), default=-1):
            pop(k, at, False)

    last: dict[str, int] = {}
    for i, (closing, tag, _) in enumerate(tags):
        if tag in EMBEDDED:
            if closing and tag in last:
                held.add(last[tag])
            last.pop(tag, None)
            if not closing:
                last[tag] = i
    for i, (closing, tag, rest) in enumerate(tags):
        if closing:
            if not (every if tag in SECTIONS else scopes[-1])[tag]:
                continue
            if tag in INLINE and stack[-1][0] not in (tag, "p"):
                continue
            pop(named[tag][-1], i, True)
            continue
        if tag in VOID and tag != "hr":
            continue
        if stack and stack[-1][0] == "head" and tag not in IN_HEAD:
            pop(len(stack) - 1, i, False)
        if tag == "body":
            pop(0, i, False)
        if tag in IMPLIED:
            wanted, stop = IMPLIED[tag]
            implied(wanted, [named[t] for t in (*stop, *SECTIONS)], i)
        if tag not in INLINE and tag not in EMBEDDED and scopes[-1]["p"]:
            implied({"p"}, [blocks], i)
        if tag in VOID or rest.endswith("/>"):
            continue
        if tag not in INLINE or every[tag] or boilerplate(tag, rest[:-1]):
            push(tag, i)
    pop(0, len(tags), False)
    return ends


class Lines:
    """Blocks of a page in order: text, characters inside links, inside an article or not, and
    the wrapper around it (-1: none); ``around`` has the wrapper around each wrapper."""

    def __init__(self) -> None:
        self.rows: list[tuple[str, int, bool, int]] = []
        self.around: list[int] = []
        self.parts: list[str] = []
        self.linked = 0

    def end(self, article: bool, wrapper: int) -> None:
        text = " ".join(html.unescape("".join(self.parts)).split()) if self.parts else ""
        self.rows.append((text, self.linked, article, wrapper))
        self.parts, self.linked = [], 0


def visible(page: str) -> str:
    """The page without comments, declarations, scripts, styles and what else is raw.

    What has no end goes to the end of the page; a start tag or declaration that is never
    closed stays.  Each character is looked at a fixed number of times.
    """
    out, at, last = [], 0, page.rfind(">")
    while m := _HIDDEN.search(page, at):
        out.append(page[at : m.start()])
        if m[0] == "<!--":
            end = page.find("-->", m.end())
            at = len(page) if end < 0 else end + 3
        elif m.end() > last:  # nothing closes from here on
            out.append(page[m.start() :])
            at = len(page)
        else:
            at = page.find(">", m.end()) + 1
            if m[1]:
                end = _RAW_END[m[1].lower()].search(page, at)
                at = end.end() if end else len(page)
    out.append(page[at:])
    return "".join(out)


def lines(page: str) -> Lines:
    page = visible(page)
    # beyond the last end of a tag there is none that ends
    found = list(_TAG.finditer(page, 0, page.rfind(">") + 1))
    if cut := _CUT_TAG.match(page, max(0, page.rfind("<"))):
        found.append(cut)
    tags = [(m[1] == "/", m[2].lower(), m[3]) for m in found]
    ends = _ends(tags)
    out, at = Lines(), 0
    # open articles and skipped elements: their end, what was before them, whether a line ends there
    states: list[tuple[int, tuple[bool, bool, bool, int], bool]] = []
    article = mute = apart = False
    wrapper, link = -1, 0
    for i, (closing, tag, rest) in enumerate(tags):
        if not mute and found[i].start() > at:
            text = page[at : found[i].start()]
            out.parts.append(text)
            if link:
                out.linked += len(text)
        at = found[i].end()
        while states and states[-1][0] <= i:
            _, before, breaks = states.pop()
            if breaks:
                out.end(article, wrapper)
            article, mute, apart, wrapper = before
        if tag == "br":
            if not mute:
                out.parts.append(" ")
            continue
        if not closing and i in ends and not apart:
            now, (end, own) = (article, mute, apart, wrapper), ends[i]
            if tag in ("article", "main"):
                # an article starts, also in a menu, a form or a sidebar that was never closed
                out.end(article, wrapper)
                states.append((end, now, True))
                article, mute, wrapper = True, False, -1
                continue
            kind = boilerplate(tag, rest[:-1], article)
            if kind:
                breaks = tag not in EMBEDDED
                if breaks:
                    out.end(article, wrapper)
                states.append((end, now, breaks))
                apart = kind == APART and own
                if not mute and (kind == WRAPPER or not own and breaks and tag not in ("nav", "head")):
                    out.around.append(wrapper)
                    wrapper = len(out.around) - 1
                else:
                    mute = True
                continue
        if mute:
            continue
        if tag == "a":
            link = 0 if closing else 1
        if tag not in INLINE and tag not in EMBEDDED:
            out.end(article, wrapper)
    if not mute and at < len(page):
        out.parts.append(page[at:])
    out.end(article, wrapper)
    return out


def _weights(rows: list[tuple[str, int, bool, int]], marked: bool) -> list[int]:
    """Lines outside the article, and lists of links, weigh nothing."""
    return [
        0 if (not article if marked else text and linked >= 0.6 * len(text)) else len(text)
        for text, linked, article, _ in rows
    ]


def _opened(page: Lines, marked: bool) -> set[int]:
    """Wrappers around the fullest window, if most of the page's text is in them."""
    rows = [r for r in page.rows if r[0]]
    weight = _weights(rows, marked)
    inside: Counter[int] = Counter()
    most, where = 0, -1
    for i, row in enumerate(rows):
        inside[row[3]] += weight[i]
        total = sum(weight[k] for k in range(i, min(i + WINDOW, len(rows))) if rows[k][3] == row[3])
        if total > most:
            most, where = total, row[3]
    chain: set[int] = set()
    while where >= 0:
        chain.add(where)
        where = page.around[where]
    return chain if sum(inside[w] for w in chain) > inside[-1] else set()


def main_text(page: str) -> str:
    """Blocks of the article, one a line."""
    read = lines(page)
    marked = any(text for text, _, article, wrapper in read.rows if article and wrapper < 0)
    opened = _opened(read, marked) | {-1}
    # lines without text say nothing, nor do those in wrappers that stay closed
    rows = [r for r in read.rows if r[0] and r[3] in opened]
    weight = _weights(rows, any(article for _, _, article, _ in rows))
    sums = [sum(weight[i : i + WINDOW]) for i in range(len(weight))]
    surge = min(SURGE, max(sums, default=0) / 2)
    kept: list[str] = []
    i = 0
    while i < len(weight):
        if not weight[i]:
            i += 1
            continue
        dive = i
        while dive < len(weight) and sums[dive] > 0:
            dive += 1
        if max(sums[i:dive]) > surge:
            kept += [rows[k][0] for k in range(i, dive) if weight[k]]
        i = dive
    return "\n".join(kept)


def extract(page: Column) -> Column:
    """Main text of HTML; empty for null, empty and textless pages.

    Character references are decoded, white space inside a block is one blank, blocks are
    joined by a line feed, nothing else is cut.  Broken markup (unclosed elements, a page that
    ends inside a tag) is read as far as it goes.
    """

    def run(pages: pa.Array) -> pa.Array:
        return pa.array([main_text(p.as_py() or "") for p in pages], pa.string())

    return arrow_column(run, "string", page)

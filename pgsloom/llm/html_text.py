"""Main text of web pages by tag-path ratios.

A page is read into text nodes, each with its root-to-leaf tag path. For every path, text length and punctuation are
summed over its nodes and divided by their number; both ratios are smoothed along the page, fused by their product, and
paths above a threshold of the page hold content. The content nodes select the main text: from the whole page the search
goes down into the element that has nearly all of their text, weighed by its path's ratio, until paragraphs share it. Where it ends at the
body itself, only those of its parts are taken that hold a content node. Names break ties: nodes in menus, headers, footers, sidebars,
notices, adverts, forms, hidden elements or reader comments, by element or by class and id, do not vote and are no part of
the text, and an article or main element around the place found is taken whole.

Character references are decoded, white space inside a block becomes one space, blocks are joined by a line feed in the
order of the page. Line breaks end a block. Time and memory grow in proportion to the page, however deep its elements nest.

Defined cases: a null page is empty; a page without content has the empty text; unclosed and stray tags are mended as
they come, and a script or style that is never closed ends at the next tag; of elements with equally much text the
first is taken; repeated rows are extracted for each row; an empty table gives an empty result; other columns are not read.
"""

from __future__ import annotations

import html
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from pgsloom.llm.common import table

#: Kinds of elements.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title iframe noembed noframes".split())
INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark q s samp small span strike strong sub sup time tt u var wbr img ruby rb rt rp svg g path math mi mn mo ms mtext mrow mfrac msqrt mroot msub msup msubsup munder mover munderover mstyle semantics".split())
APART = frozenset("nav footer aside form menu dialog button select option fieldset object audio video canvas head template".split())
#: Elements that hold text themselves; a place found in one of them belongs to what is around it.
TEXT = INLINE | frozenset("p h1 h2 h3 h4 h5 h6 li dt dd pre blockquote ul ol dl".split())
#: Which open element (by its place in ``Element.near``) an element of this name ends, and which places it hides.
ENDS = {"li": 1, "dt": 2, "dd": 2, "tr": 3, "td": 4, "th": 4, "option": 5}
HIDES = {"ul": (1,), "ol": (1,), "menu": (1,), "dl": (2,), "table": (1, 2, 3, 4), "tr": (4,), "td": (1, 2), "th": (1, 2), "select": (5,)}
ROLES = frozenset("navigation banner contentinfo complementary search dialog alert alertdialog menu menubar toolbar form".split())
#: Words of class and id names of what is not main text, and words that may stand beside them.
NAMES = frozenset(
    "nav navbar navigation menu submenu sidebar sidenav aside footer masthead topbar ad ads adv advert adverts advertisement advertisements adsense banner promo promotion sponsor sponsored "
    "cookie cookies consent gdpr notice notices newsletter subscribe subscription signup login share sharing social comment comments commentlist reply replies respond disqus "
    "related recommended recommendations breadcrumb breadcrumbs popup modal overlay widget widgets paywall pagination pager skip toolbar".split()
)
BESIDE = frozenset(
    "site page global main primary secondary top bottom left right header head inner outer wrap wrapper container box block area section list item items link links bar panel group row col column content "
    "text title button buttons icon icons form message messages posts post article articles user reader readers mobile desktop fixed sticky slot unit space holder thread tree body js the of and to in for".split()
)
TOKEN = re.compile(r"""<!--.*?(?:-->|\Z)|<!\[CDATA\[|<[!?][^>]*+>|<(/?)([a-zA-Z][^\s/>]*+)((?:[^>"']++|"[^"]*+"|'[^']*+')*+)>""", re.S)
ATTRIBUTE = re.compile(r"""([^\s"'>/=]++)(?:\s*+=\s*+(?:"([^"]*+)"|'([^']*+)'|([^\s"'>]++)))?|["'=]""")
NEXT_TAG = re.compile(r"<[a-zA-Z/!]")
PUNCTUATION = re.compile(r"[.,;:!?…。，]")
NAME_WORD = re.compile(r"[A-Z]?[a-z]+|[A-Z]+(?![a-z])")


class Element:
    """An open or closed element: its tag path by number, whether it is no part of the main text, and open elements that a tag inside may end."""

    __slots__ = ("apart", "home", "name", "near", "parent", "path", "place")

    def __init__(self, name: str, parent: Element | None, path: int, place: int, apart: bool, home: bool):
        self.name, self.parent, self.path, self.place, self.apart, self.home = name, parent, path, place, apart, home
        near = parent.near if parent else (None,) * 6  # p, li, dt or dd, tr, td or th, option
        hidden, own = HIDES.get(name, ()), 0 if name == "p" else ENDS.get(name)
        if hidden or own is not None:
            near = tuple(self if k == own else None if k in hidden else x for k, x in enumerate(near))
        self.near = near


def named_apart(value: str) -> bool:
    """Whether a class or id says that its element is no main text: one of its names is made of such words and words beside them."""
    for name in value.split():
        words = {w.lower() for w in NAME_WORD.findall(name)}
        if not words.isdisjoint(NAMES) and words <= NAMES | BESIDE:
            return True
    return False


def _apart(name: str, attributes: str, inside: bool) -> bool:
    """Whether an element is no part of the main text; a header inside an article is that article's own."""
    if name in APART or (name == "header" and not inside):
        return True
    for m in ATTRIBUTE.finditer(attributes) if attributes.strip(" /") else ():
        key, value = (m[1] or "").lower(), m[2] or m[3] or m[4] or ""
        if key == "hidden" or (key == "aria-hidden" and value.lower() == "true") or (key == "role" and value.lower() in ROLES):
            return True
        if key in ("class", "id") and name not in ("html", "body", "article", "main") and named_apart(value):
            return True
    return False


def read(page: str) -> tuple[list[Element], list[tuple[Element, str, int]]]:
    """All elements, each after the one around it, and (element, raw text, block number) of each text node but those of scripts and the like."""
    top = here = Element("", None, 0, 0, False, False)
    elements, out, paths, is_open, endless = [top], [], {}, {}, set()
    block, at, length = 0, 0, len(page)

    def leave(element: Element) -> Element:
        """Close everything from the place reached up to an element."""
        e = here
        while True:
            is_open[e.name] -= 1
            if e is element:
                return e.parent
            e = e.parent

    match = TOKEN.search(page)
    while match:
        if match.start() > at:
            out.append((here, page[at : match.start()], block))
        at = match.end()
        name = match[2]
        if name is None:
            if match[0] == "<![CDATA[":
                end = page.find("]]>", at)
                out.append((here, html.escape(page[at : end if end >= 0 else length]), block))
                at = end + 3 if end >= 0 else length
        else:
            name = name.lower()
            if name not in INLINE:
                block += 1
            if match[1]:
                if is_open.get(name):
                    e = here
                    while e.name != name:
                        e = e.parent
                    here = leave(e)
            elif name in RAW:
                end = None if name in endless else re.compile(rf"</{name}\s*+>", re.I).search(page, at)
                if end:
                    at = end.end()
                else:  # no such end from here on
                    endless.add(name)
                    tag = NEXT_TAG.search(page, at)
                    at = tag.start() if tag else length
            elif name not in VOID:
                if name not in INLINE and here.near[0]:
                    here = leave(here.near[0])
                k = ENDS.get(name)
                if k is not None and here.near[k]:
                    here = leave(here.near[k])
                path = paths.setdefault((here.path, name), len(paths) + 1)
                here = Element(name, here, path, len(elements), here.apart or _apart(name, match[3], here.home), here.home or name in ("article", "main"))
                is_open[name] = is_open.get(name, 0) + 1
                elements.append(here)
        match = TOKEN.search(page, at)
    if at < length:
        out.append((here, page[at:], block))
    return elements, out


def smooth(values: np.ndarray, radius: int = 1) -> np.ndarray:
    """Weighted mean of each value and its neighbours."""
    if len(values) < 2:
        return values
    weights = np.exp(-0.5 * np.arange(-radius, radius + 1) ** 2)
    return np.convolve(np.pad(values, radius, mode="edge"), weights / weights.sum(), mode="valid")


def content(found: list[tuple[Element, str, int]], strictness: float = 1.0) -> np.ndarray:
    """For each node the fused ratio of its tag path, or 0 where that is not above the page's threshold."""
    of = np.unique([e.path for e, _, _ in found], return_inverse=True)[1]
    sizes = np.array([len(t) for _, t, _ in found], float)
    marks = np.array([len(PUNCTUATION.findall(t)) for _, t, _ in found], float)
    count = np.bincount(of)
    text, punctuation = (smooth((np.bincount(of, x) / count)[of]) for x in (sizes, marks + 1))
    fused = np.bincount(of, text * punctuation) / count  # one value a path
    spread = np.sqrt(fused)
    return np.where(spread >= min(strictness * spread[of].std(), spread.max()), spread, 0)[of]


def selected(elements: list[Element], found: list[tuple[Element, str, int]], nearly: float = 0.75) -> np.ndarray:
    """Which elements hold the main text, chosen by the text on content paths."""
    votes = np.zeros(len(elements))
    for (e, t, _), ratio in zip(found, content(found).tolist()):
        if not e.apart:
            votes[e.place] += ratio * len(t)
    if not votes.any():  # nothing but what names set apart is on a content path
        for e, t, _ in found:
            votes[e.place] += 0 if e.apart else len(t)
    inside = np.zeros(len(elements), bool)
    if not votes.any():
        return inside
    at_home = sum(votes[e.place] for e in elements if e.home)
    heaviest = np.zeros(len(elements), np.int64)  # the child with most of the votes
    for e in reversed(elements[1:]):
        up = e.parent.place
        votes[up] += votes[e.place]
        if not heaviest[up] or votes[e.place] >= votes[heaviest[up]]:
            heaviest[up] = e.place
    total, here = votes[0], elements[0]
    while heaviest[here.place] and votes[heaviest[here.place]] >= nearly * total:
        here = elements[heaviest[here.place]]
    while here.name in TEXT and here.parent is not None:
        here = here.parent
    up = here
    while up is not None and up.name not in ("article", "main"):
        up = up.parent
    if up is not None:
        roots = {up}
    elif at_home >= nearly * total:  # several articles
        roots = {e for e in elements if e.name in ("article", "main") and votes[e.place] and not e.parent.home}
    elif here.name in ("", "html", "body"):
        # each part of the page for itself: what holds text directly, and other parts only with a content node
        inside[here.place] = True
        roots = {e for e in elements if e.parent is here and (e.name in TEXT or votes[e.place])}
    else:
        roots = {here}
    for e in elements:
        if e in roots or (e.parent is not None and e.parent is not here and inside[e.parent.place]) or (e.parent is here and here in roots):
            inside[e.place] = True
    return inside


def main_text(page: str | None) -> str:
    elements, every = read(page or "")
    found = [x for x in every if not x[1].isspace()]
    if not found:
        return ""
    inside = selected(elements, found)
    blocks: dict[int, list[str]] = {}
    for e, t, b in every:
        if inside[e.place] and not e.apart:
            blocks.setdefault(b, []).append(t)
    lines = [" ".join(html.unescape("".join(parts)).split()) for parts in blocks.values()]
    return "\n".join(x for x in lines if x)


def extract(pages: DataFrame) -> DataFrame:
    """(page_id, url, text, n_chars) for each page."""
    id_type = pages.schema["page_id"].dataType.simpleString()

    def batches(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts:
            texts = [main_text(p.as_py()) for p in part.column(2)]
            yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], names=["page_id", "url", "text", "n_chars"])

    return pages.select("page_id", "url", "html").mapInArrow(batches, f"page_id {id_type}, url string, text string, n_chars bigint")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract(table(spark, sf_dir, "pages"))

"""Main text of web pages by line-block distribution.

Markup is stripped so that each block element becomes a line. Lines of page furniture (menus,
headers, footers, sidebars, notices, adverts, forms, scripts, styles, reader comments) count no
text, nor do lines outside the article, where the page marks one, or else lines that are mostly
links.
Text lengths are summed over a sliding window of lines; the sum surges where running text
begins and dives to nothing where it ends. The lines with text from the first surge to the dive
after the last are kept, and all of them on a page whose text is too short to surge. Tags that
only wrap other blocks make no line; an empty block does. In a marked article every line with
text surges: nothing of it may be lost, so there the distribution only finds where it begins and
ends. Headers and footers go wherever they stand, in an article as well.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from html import unescape

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Lines in the sliding window; characters in it for a surge, where no article is marked.
WINDOW = 3
SURGE = 80

_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
_RAW = frozenset("script style textarea title xmp iframe noembed noframes noscript".split())
_INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark q rp rt ruby s samp small span strike strong sub sup time tt u var wbr img br nobr input button select svg canvas object embed audio video picture map area source track meter progress output math".split())
_FURNITURE = frozenset("head nav header footer aside form button select fieldset dialog menu template svg canvas object applet audio video".split())
_NAMED = frozenset(
    "ad ads adv advert adverts advertisement advertising sponsor sponsored banner cookie cookies consent gdpr notice notices popup modal overlay "
    "sidebar menu nav navbar navigation breadcrumb breadcrumbs comment comments disqus respond reply replies share sharing social related "
    "recommended promo promotion newsletter subscribe subscription signup login footer header masthead widget pagination pager topbar toolbar".split()
)
#: What may follow in a compound name without changing what it names: ``menu-list`` is a menu, ``menu-of-the-day`` is none.
_HOLDERS = frozenset(
    "area articles bar block body bottom box button buttons center column container content digits entry form full group icons image inner item items label large layer left "
    "link links list main media meta mobile module outer overlay panel parent popup posts primary right row section secondary sidebar slot small stories text thread title toggle top unit widget wrap wrapper".split()
)
#: A name that begins so is furniture as well: comment lists, cookie bars and the like.
_NAMED_FROM = re.compile(r"(?:comment(?!ar)|cookie|advert|sidebar|sponsor|newsletter|breadcrumb|popup|navbar)")
_ROLES = frozenset("navigation banner contentinfo complementary search form alert dialog menu menubar".split())
_ABOUT = frozenset("has with no without is".split())
_BODY = frozenset(("html", "body", "main"))
#: A quote opens a value after an equals sign only. Nothing is given back once read, so tags that never end cost no more than others.
_TAG = re.compile(r"""<!--.*?(?:-->|$)|<(/?)([a-zA-Z][^\s/>]*)((?:[^>=]++|=\s*+(?:"[^"]*"|'[^']*')?+)*+)>|<[!?/][^>]*>|<([a-zA-Z][^\s/>]*)[^>]*>""", re.S)
_ATTRIBUTE = re.compile(r"""(?:^|\s)(class|id|role|hidden|aria-hidden|style)(?=[\s=/]|$)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+)))?""", re.I)
#: Quoted values, which may hold anything; a link is an ``a`` with an ``href``, others are places.
_QUOTED = re.compile(r""""[^"]*"|'[^']*'""")
_HREF = re.compile(r"(?:^|\s)href(?=[\s=/]|$)", re.I)
_MAIN = re.compile(r"""(?:^|\s)role\s*=\s*["']?main(?=["'\s]|$)""", re.I)
_NAME_PARTS = re.compile(r"[^a-z0-9]+")


def _named(value: str, whole: bool = False) -> bool:
    """Whether a class or id names furniture; ``whole``: by a name of its own, not by a part of one.

    A compound name does by its last part (``main-nav``), or by its first if holders alone follow
    (``ad-slot-2``). Names that say what a container has (``has-sidebar``, ``no-ads``) say nothing of itself.
    """
    furniture = lambda part: part in _NAMED or bool(_NAMED_FROM.match(part))
    for name in value.lower().split():
        parts = [name] if whole else [p for p in _NAME_PARTS.split(name) if p]
        if not parts or parts[0] in _ABOUT:
            continue
        if furniture(parts[-1]) or furniture(parts[0]) and all(p in _HOLDERS or p in _NAMED or p.isdigit() for p in parts[1:]):
            return True
    return False


def _is_furniture(tag: str, attributes: str) -> bool:
    if tag in _FURNITURE or "-" in tag and _named(tag):
        return True
    if not attributes or tag in _BODY:
        return False
    for name, *values in _ATTRIBUTE.findall(attributes):
        name, value = name.lower(), "".join(values).lower()
        if name == "hidden" or name == "aria-hidden" and value == "true" or name == "role" and value in _ROLES:
            return True
        if name == "style" and re.search(r"display\s*:\s*none", value) or name in ("class", "id") and _named(value, tag == "article"):
            return True
    return False


def lines_of(html: str) -> tuple[list[tuple[str, int, bool]], bool]:
    """Lines ``(text, characters in links, inside an article)`` without furniture, and whether the page marks an article."""
    lines: list[tuple[str, int, bool]] = []
    parts: list[str] = []
    linked: list[str] = []
    stack: list[tuple[str, bool, bool, bool]] = []  # tag, furniture, marks the article, is a link
    blocks: list[int] = []  # places in the stack of tags that break lines
    depths: dict[str, int] = {}  # how many of each tag are open
    dropped = inside = links = hushed = 0  # hushed: open furniture within a line, such as a button
    opened = ""  # the block just opened, if nothing is in it yet
    marked = False
    at, end = 0, len(html)
    last = html.rfind(">") + 1  # no tag ends behind it

    def text(piece: str) -> None:
        nonlocal opened
        if not piece.isspace() and piece:
            opened = ""
        if piece and not dropped:
            parts.append(piece)
            if links:
                linked.append(piece)

    def close(empty: bool = False) -> None:
        said = " ".join(unescape("".join(parts)).split()) if parts else ""
        if said or empty:
            lines.append((said, len(" ".join(unescape("".join(linked)).split())) if linked else 0, inside > 0))
        parts.clear()
        linked.clear()

    def pop_to(depth: int) -> None:
        nonlocal dropped, inside, links, hushed
        for tag, furniture, main, link in stack[depth:]:
            dropped -= furniture
            inside -= main
            links -= link
            hushed -= furniture and tag in _INLINE
            depths[tag] -= 1
        del stack[depth:]
        while blocks and blocks[-1] >= depth:
            blocks.pop()

    while at < end:
        found = _TAG.search(html, at, last)
        if not found:
            text(html[at:])
            break
        if found[0].startswith("<!--") and not found[0].endswith("-->"):
            text(html[at : found.start()])
            break
        text(html[at : found.start()])
        at, tag, attributes = found.end(), (found[2] or found[4] or "").lower(), found[3] or ""
        if not tag:
            continue
        if found[1]:
            breaks = tag not in _INLINE and (not hushed or depths.get(tag, 0) > 0)
            if breaks and not hushed:
                close(tag == opened)
                opened = ""
            if depths.get(tag, 0):  # the search ends at an open tag, and all it passes is closed with it
                pop_to(next(i for i in range(len(stack) - 1, -1, -1) if stack[i][0] == tag))
            continue
        if tag in _RAW:
            stop = re.compile(rf"</{re.escape(tag)}(?=[\s/>])[^>]*>", re.I).search(html, at)
            at = stop.end() if stop else end
            continue
        if tag == "br" or tag == "hr":
            text(" ")
        if tag not in _INLINE and not hushed:
            close(tag == "hr")
            opened = "" if tag in _VOID else tag
            if blocks and stack[blocks[-1]][0] in (("p",) if tag != "li" else ("p", "li")):
                pop_to(blocks[-1])
        if tag in _VOID or attributes.rstrip().endswith("/") and hushed:
            continue
        furniture = _is_furniture(tag, attributes)
        main = not furniture and not dropped and (tag == "article" or tag == "main" or bool(_MAIN.search(attributes)))
        marked = marked or main
        link = tag == "a" and bool(_HREF.search(_QUOTED.sub(" ", attributes)))
        if tag not in _INLINE:
            blocks.append(len(stack))
        stack.append((tag, furniture, main, link))
        depths[tag] = depths.get(tag, 0) + 1
        dropped += furniture
        inside += main
        links += link
        hushed += furniture and tag in _INLINE
    close()
    return lines, marked


def extract(html: str | None, window: int = WINDOW, surge: int = SURGE) -> str:
    """The main text of one page: its blocks in page order, joined by two line feeds."""
    if not html:
        return ""
    lines, marked = lines_of(html)
    weights = [len(said) if (inside if marked else links * 2 <= len(said)) else 0 for said, links, inside in lines]
    least = 1 if marked else surge
    sums = [sum(weights[i : i + window]) for i in range(len(weights))]
    runs: list[tuple[list[str], bool]] = []
    run: list[str] = []
    high = False
    for (said, _, _), weight, total in zip(lines, weights, sums):
        if weight:
            run.append(said)
        high = high or total >= least
        if not total:  # a dive
            runs.append((run, high))
            run, high = [], False
    runs.append((run, high))
    surged = [i for i, (_, high) in enumerate(runs) if high]
    if surged:
        runs = runs[surged[0] : surged[-1] + 1]
    elif not any(c.isalnum() for run, _ in runs for said in run for c in said):
        return ""
    return "\n\n".join(said for run, _ in runs for said in run)


def main_text(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """``(page_id, url, text, n_chars)`` for every page, from its whole html.

    A null or empty html, and a page without a letter or digit of text, has the empty text and 0
    characters.
    Ids and urls are carried as they are, null and repeated ones too; extra columns are ignored.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [extract(h.as_py()) for h in batch.column(2)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(texts, pa.string()), pa.array(map(len, texts), pa.int64())], names=["page_id", "url", "text", "n_chars"])

    only = pages.select(F.col(id_col).cast("long").alias("page_id"), F.col(url_col).cast("string").alias("url"), F.col(html_col).cast("string").alias("html"))
    return only.mapInArrow(run, "page_id long, url string, text string, n_chars long")

"""Main text of web pages by two passes of block rules (operator 4).

A page is cut into blocks at block-level tags; what stands in menus, headers, footers, asides, forms, scripts,
styles or in elements named as adverts, notices, sidebars or comments is boilerplate by its place.  The first pass
calls the other blocks good, bad, short or near-good by stop-word density, length and link density; the second
gives the undecided ones the label of the nearest decided neighbours.  A page's <article> or <main>, where it has
one, shifts the labels of the first pass: those of blocks in it one step up, those of undecided blocks outside one
step down.  Its bounds are edges to the second pass, and what is boilerplate by place in it decides no neighbour.

Defined results: null html is empty and gives an empty text; broken and unclosed markup is read as far as it goes;
repeated rows are read alike; empty tables give empty results; extra columns are ignored.
"""

from __future__ import annotations

import html as entities
import re
from collections import Counter, defaultdict
from collections.abc import Iterator
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import DataFrame

from . import scratch

# Elements of HTML by what they do to text.
DROPPED_WHOLE = "script style template noscript iframe object svg math canvas audio video head title select option textarea button datalist".split()
BOILERPLATE = "nav header footer aside form menu dialog fieldset".split()
BLOCKS = (
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form "
    "h1 h2 h3 h4 h5 h6 header hgroup hr html li main menu nav ol p pre section summary table tbody td tfoot th thead tr ul"
).split()
VOID = "area base br col embed hr img input link meta param source track wbr".split()
MAIN = "article main".split()
#: A class token or id is boilerplate as a whole: these words, joined or beside words that only say place or form.
_NAMES = (
    r"(?:ads?|advert\w*|banner|sponsor\w*|promo\w*|sidebar|side|cookies?|notices?|consent|popup|modal|comments?|replies|"
    r"disqus|discussion|nav\w*|menus?|breadcrumbs?|footer|share|sharing|social|related|newsletter|subscribe|login|pagination|widgets?)"
)
_NEUTRAL = r"(?:site|main|top|bottom|left|right|box|bar|block|area|list|wrap|wrapper|container|inner|primary|secondary|\d+)"
_NAME, _PLAIN, _OPEN_NAME = re.compile(_NAMES, re.I), re.compile(_NEUTRAL, re.I), re.compile(r"(?:advert|sponsor|nav)\w*", re.I)
ROLES = "navigation banner contentinfo complementary search form dialog alert".split()
# Frequent function words of the languages of the corpus.
STOP_WORDS = frozenset(
    "the of and a to in is that for it as was on are by this with be from at or an have not he his they you which but were "
    "der die und das den von zu mit sich des auf für ist im dem nicht ein eine als auch es an er so dass "
    "de la le les et des en un une du que est pour qui dans par sur au pas avec plus ce il "
    "el los las y del se por con una su para al lo como más pero sus o no".split()
)
#: First pass: density of stop words that makes a block good or bad, characters of short and long blocks, link share.
STOP_LOW, STOP_HIGH = 0.15, 0.30
SHORT, LONG = 70, 200
MOST_LINKS = 0.33
#: An attribute ends at the next "<" that is not quoted, so no start is read twice.
_TAG = re.compile(r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*>?|<(/?)([a-zA-Z][a-zA-Z0-9:-]*+)((?:[^<>\"']|\"[^\"]*\"|'[^']*')*+)>|<(/?)([a-zA-Z][a-zA-Z0-9:-]*+)[^<>]*+>?", re.S)
_ATTRIBUTE = re.compile(r"([^\s\"'<>/=]+)(?:\s*=\s*(\"[^\"]*\"|'[^']*'|[^\s\"'>]+))?")
_KINDS = {t: "drop" for t in DROPPED_WHOLE} | {t: "boilerplate" for t in BOILERPLATE}
_BLOCKS, _VOID, _MAIN = frozenset(BLOCKS), frozenset(VOID), frozenset(MAIN)
#: A start tag of the first ends an open element of the second, with no end tag between.
_ENDS = {"li": {"li"}, "p": {"p"}, "td": {"td", "th"}, "th": {"td", "th"}, "tr": {"tr", "td", "th"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}}


@dataclass
class Block:
    text: str
    boilerplate: int  # elements around it that make boilerplate
    inside: bool
    heading: bool
    linked: int = 0


def named(token: str) -> bool:
    """Whether a class token or id is boilerplate: pieces that say place or form, and one at least that names it."""
    if token.lower() in ("header", "site-header", "site_header"):
        return True
    pieces = re.split("([-_]+)", token)
    found = swallowed = False
    for piece, joint in zip(pieces[::2], ["", *pieces[1::2]], strict=True):
        # A name that may go on also takes what an underscore joins to it.
        swallowed = swallowed and "-" not in joint
        if _NAME.fullmatch(piece):
            found = True
            swallowed = swallowed or bool(_OPEN_NAME.fullmatch(piece))
        elif not swallowed and not _PLAIN.fullmatch(piece):
            return False
    return found


def _named_boilerplate(attributes: str) -> bool:
    for m in _ATTRIBUTE.finditer(attributes):
        name, value = m.group(1).lower(), entities.unescape((m.group(2) or "").strip("\"'"))
        if name in ("class", "id") and any(map(named, value.split())):
            return True
        if name == "role" and value.strip().lower() in ROLES:
            return True
        if name == "hidden" or name == "aria-hidden" and value.strip().lower() == "true":
            return True
    return False


def blocks(page: str, lifted: bool = False) -> tuple[list[Block], bool]:
    """The blocks of a page in order, and whether it has an article or main element.

    Attributes do not make an element boilerplate that holds the page's article or main: where all of these are in
    boilerplate, the page is read again, ``lifted``, and the attributes of the elements around them count for nothing.
    """
    out: list[Block] = []
    has_main = has_light = False
    # Open elements: name ("" once an inline one has been closed below others) and whether it makes boilerplate.  Beside
    # them, where the open elements of each name stand, where the blocks do, and those that only attributes make
    # boilerplate, with the number of blocks before them: so no tag walks the stack.
    open_: list[tuple[str, bool]] = []
    at_name: dict[str, list[int]] = defaultdict(list)
    at_block: list[int] = []
    by_attribute: dict[int, int] = {}
    endless: set[str] = set()
    dark = inside = links = 0
    parts: list[str] = []
    linked = 0
    heading = ""
    at = 0

    def end_block() -> None:
        nonlocal linked
        if parts:
            text = " ".join(entities.unescape("".join(parts)).split())
            if text:
                out.append(Block(text, dark, inside > 0, bool(heading), linked))
            parts.clear()
        linked = 0

    def leave(k: int) -> None:
        nonlocal dark, inside, links, heading
        for name, is_dark in reversed(open_[k:]):
            if not name:
                continue
            at_name[name].pop()
            if name in _BLOCKS:
                at_block.pop()
            dark -= is_dark
            inside -= name in _MAIN
            links -= name == "a"
            heading = "" if name == heading else heading
        del open_[k:]
        while by_attribute and next(reversed(by_attribute)) >= k:
            by_attribute.popitem()

    while m := _TAG.search(page, at):
        chunk = page[at : m.start()]
        if chunk:
            parts.append(chunk)
            linked += len(chunk) if links else 0
        at = m.end()
        name = (m.group(2) or m.group(5) or "").lower()
        if not name:
            continue
        closing, attributes = m.group(1) or m.group(4), m.group(3) or ""
        if closing:
            if name in _BLOCKS:
                end_block()
            if at_name[name]:
                k = at_name[name][-1]
                if name not in _BLOCKS and at_block and at_block[-1] > k:
                    # An inline end tag does not close the blocks opened since.
                    dark -= open_[k][1]
                    links -= name == "a"
                    at_name[name].pop()
                    open_[k] = ("", False)
                    by_attribute.pop(k, None)
                else:
                    leave(k)
            continue
        kind = _KINDS.get(name)
        if kind == "drop":
            if attributes.rstrip().endswith("/") and name not in ("script", "style"):
                continue
            end = None if name in endless else re.compile(rf"</{name}\b[^<>]*>", re.I).search(page, at)
            if end:
                at = end.end()
                parts.append(" ")
                continue
            endless.add(name)
            if name in ("script", "style", "textarea"):
                at = len(page)
            parts.append(" ")
            continue
        if name == "br":
            parts.append(" ")
            continue
        if name in _BLOCKS:
            end_block()
            if at_block and open_[at_block[-1]][0] in _ENDS.get(name, ()):
                leave(at_block[-1])
        if name in _VOID:
            continue
        by_place = kind == "boilerplate" and not (name == "header" and inside)
        by_name = not by_place and name not in ("html", "body", "article", "main") and bool(attributes) and _named_boilerplate(attributes)
        dark += by_place or by_name
        if name in _MAIN:
            if lifted and by_attribute:
                firsts = Counter(by_attribute.values())
                less = 0
                for n in range(min(firsts), len(out)):
                    less += firsts[n]
                    out[n].boilerplate -= less
                for k in by_attribute:
                    open_[k] = (open_[k][0], False)
                    dark -= 1
                by_attribute.clear()
            inside += 1
            has_main = True
            has_light |= not dark
        links += name == "a"
        if re.fullmatch("h[1-6]", name):
            heading = name
        at_name[name].append(len(open_))
        if name in _BLOCKS:
            at_block.append(len(open_))
        if by_name:
            by_attribute[len(open_)] = len(out)
        open_.append((name, by_place or by_name))
    parts.append(page[at:])
    end_block()
    if has_main and not has_light and not lifted:
        return blocks(page, lifted=True)
    return out, has_main


def first_pass(block: Block) -> str:
    if block.boilerplate:
        return "bad"
    n = len(block.text)
    if block.linked > MOST_LINKS * n:
        return "bad"
    words = block.text.lower().split()
    density = sum(w.strip(".,;:!?#$%&*|") in STOP_WORDS for w in words) / len(words)
    if n < SHORT:
        return "short"
    if density >= STOP_HIGH:
        return "good" if n > LONG else "near"
    if density >= STOP_LOW:
        return "near"
    return "bad" if n <= LONG else "near"


STEPS = ["bad", "short", "near", "good"]


def shifted(block: Block, label: str) -> str:
    """The label on a page with an article or main element."""
    if block.boilerplate or block.linked > MOST_LINKS * len(block.text) or label == "good":
        return label
    return STEPS[min(STEPS.index(label) + 1, 3) if block.inside else max(STEPS.index(label) - 1, 0)]


def _decided(found: list[Block], labels: list[str]) -> list[str | None]:
    """For each block the last decided label before it, on its side of the bounds of article and main."""
    out, last, inside = [], None, False
    for b, x in zip(found, labels, strict=True):
        if b.inside != inside:
            last, inside = None, b.inside
        out.append(last)
        last = x if x in ("good", "bad") and not (b.inside and b.boilerplate) else last
    return out


def second_pass(found: list[Block], labels: list[str], has_main: bool) -> list[bool]:
    """Whether each block is kept.  Undecided blocks take the label of the nearest decided neighbours: good if either
    is, for near-good ones, and only if both are (or the page's edge is next to them) for short ones; where no
    neighbour is decided, near-good ones are kept, and short ones in an article or main element."""
    if has_main:
        labels = [shifted(b, x) for b, x in zip(found, labels, strict=True)]
    before, after = _decided(found, labels), _decided(found[::-1], labels[::-1])[::-1]
    kept = []
    for b, x, p, n in zip(found, labels, before, after, strict=True):
        if x in ("good", "bad"):
            kept.append(x == "good")
        elif b.heading:
            kept.append(n == "good" or n is None and (p == "good" or p is None and b.inside))
        elif x == "near":
            kept.append("good" in (p, n) or p is None and n is None)
        else:
            known = [y for y in (p, n) if y is not None]
            kept.append(all(y == "good" for y in known) if known else b.inside)
    if not any(kept) and not any(x == "good" for x in labels):
        # A page of short blocks only: what is not boilerplate by place or links is its text.
        return [x != "bad" for x in labels]
    return kept


def main_text(page: str) -> str:
    found, has_main = blocks(page)
    keep = second_pass(found, [first_pass(b) for b in found], has_main)
    return "\n".join(b.text for b, k in zip(found, keep, strict=True) if k)


def extracted(pages: DataFrame) -> DataFrame:
    """page_id, url, text and n_chars of every page.  No shuffle."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            text = [main_text(h) if h else "" for h in pdf["html"]]
            yield pd.DataFrame({"page_id": pdf["page_id"], "url": pdf["url"], "text": text, "n_chars": [len(t) for t in text]})

    return pages.select("page_id", "url", "html").mapInPandas(run, "page_id long, url string, text string, n_chars long")


def op4_main_text(spark, sf_dir: str) -> DataFrame:
    return extracted(scratch.table(spark, sf_dir, "pages"))

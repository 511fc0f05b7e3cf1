"""Main text of web pages by two-pass block rules.

A page is cut into blocks at block-level tags. The first pass decides blocks by where they stand (navigation, footers,
adverts, forms, comments and the like are boilerplate), by link density, length and stop-word density. Short or middling
blocks stay open; in the second pass they take the label of the nearest decided blocks of the same region (the page's
article if it has one, else the page), the article itself counting as good where nothing in it is decided. Boilerplate places have no say in that, and where no block of a page is
decided as good (a page of a heading and two short lines), its open blocks are its text.

Names are loose evidence: a form or a wrapper with a boilerplate word inside a longer name ("with-sidebar") is boilerplate unless it holds the
page's main element, or the page's only articles, or, where the name speaks of layout, most of the page's text; names that are boilerplate as a whole, too, give way where hardly any text
would be left. Inside the main element only names that say nothing else count ("ad", "share-buttons", not "press-notice"), and names that an article may have as well ("menu") only where the
text is mostly links. An article itself is boilerplate only by a name of its own kind ("comment"), not by its topics or states ("tags-news"). Articles of hardly any
text beside a long text are teasers. Lists of comments and of related pages, and boilerplate elements and hidden ones, never give way to an article of theirs.
Where a page shows few of the known stop words, its language is taken as unknown and length decides alone.

Character references are decoded, white space inside a block becomes one space, blocks are trimmed and joined by one space
in page order. Null, empty and tag-only pages give an empty text; unclosed and stray tags are tolerated as browsers do;
text of any length is kept whole. Rows are mapped one to one, repeated ones too; an empty table gives an empty one, and other columns are not looked at. The time that a page takes is
in proportion to its length, however deep its tags are nested: a page is read READS times at most.
"""

from __future__ import annotations

import html
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import DataFrame, functions as F

from .shared import small_batches

#: First-pass limits: shares of characters in links, characters, shares of stop words.
LINKS, SHORT, LONG, FEW_STOPS, MANY_STOPS = 0.4, 70, 200, 0.12, 0.25

#: Shares of characters in links: of a block of an article (its headings may be links as a whole), and of a short block that is not decided by its links.
MOST_LINKS, SHORT_LINKS = 0.9, 0.6

# Fixed lists of the rules.
STOP_WORDS = frozenset("""
the of and to a in is that it for was on as with are be by this from at or an not have has but they which you his her its were been their will would can
der die das und in zu den mit von ist des im für auf nicht ein eine als auch es an werden aus er hat dass sie nach wird bei einer um am sind noch wie einem über
de la le les et des en un du une que est pour qui dans par sur pas plus au il ne se ce avec ou son sont cette aux
el los y del las se una por con no su al lo como más pero sus o este sí porque esta entre cuando muy sin sobre también
""".split())
RAW = "script|style|textarea|title|iframe|noembed|noframes|xmp"
BAD_TAGS = frozenset("nav footer aside form noscript template svg math canvas object select button menu dialog head audio video".split())
MAIN_TAGS = frozenset(("article", "main"))
BLOCK_TAGS = frozenset("address article aside blockquote body br center dd details dialog div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 head header hr html legend li main menu nav ol option p pre section select summary table tbody td tfoot th thead title tr ul button noscript template".split())
VOID_TAGS = frozenset("area base br col embed hr img input link meta param source track wbr".split())
BAD_NAMES = frozenset("ad ads advert adverts advertisement advertising sponsor sponsored promo promotion banner nav navbar navigation menu breadcrumb breadcrumbs footer masthead sidebar side widget cookie cookies consent gdpr notice notices disclaimer comment comments reply replies disqus share sharing social related recommended newsletter subscribe subscription signup login popup modal overlay toolbar pagination pager skip toc tags".split())

_TOKEN = re.compile(
    rf"""<!--.*?(?:-->|\Z)|<(?P<raw>{RAW})\b(?:[^<>"']|"[^"]*"|'[^']*')*+>.*?(?:</(?P=raw)\s*>|\Z)|<(?P<close>/?)(?P<tag>[a-zA-Z][^\s/>]*)(?P<rest>(?:[^<>"']|"[^"]*"|'[^']*')*+)>|<[!?/][^<>]*+>""",
    re.S | re.I,
)
#: Names that say what a wrapper holds, not where it stands: they count inside longer names as well.
OWN_NAMES = frozenset("comment comments reply replies disqus related recommended".split())
#: Tags that a layout wrapper may hold and a boilerplate block hardly ever does.
LAYOUT_TAGS = frozenset("article main h1 header nav footer aside".split())
#: Parts of names that speak of layout or of a state.
LOOSE_NAMES = frozenset("has with no without is wrap wrapper container layout page body content main grid row col column enabled open active two three".split())
#: Parts that say nothing about a place, and names that inside an article may as well be its topic.
FILLERS = frozenset("area bar block bottom box button buttons card container form group icon icons inline inner item items left links list outer panel right row section site slot small text top unit wrap wrapper".split())
LINKED_NAMES = frozenset("menu side tags toc".split())
#: Kinds of bad places: by part of a name, by a whole name, for certain.
PART, WHOLE, SURE = 1, 2, 3

_ATTRIBUTE = re.compile(r"""([^\s"'>/=]+)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+)))?""")
_NONE = re.compile(r"display\s*:\s*none", re.I)
_WORD = re.compile(r"[^\W\d_]+")
_PART = re.compile(r"[^a-z]+")


@dataclass
class Block:
    text: str
    linked: int
    bad: bool
    region: int
    heading: bool = False
    sure: bool = False
    inside: int = -1

    @property
    def stops(self) -> float:
        words = _WORD.findall(self.text.lower())
        return sum(w in STOP_WORDS for w in words) / len(words) if words else 0.0


@dataclass
class Wrapper:
    """A place that is bad by its name: kind, innermost wrapper around it, tags of layout that it holds, whether it may be layout, whether it must be mostly links to count; and, when the page is read, its text."""

    begin: int
    kind: int
    around: int
    held: set[str]
    loose: bool
    by_links: bool
    long_text: int = 0
    text: int = 0
    linked: int = 0


def _attributes(rest: str) -> list[tuple[str, str]]:
    return [(name.lower(), a or b or c) for name, a, b, c in _ATTRIBUTE.findall(rest)]


def _bad_place(tag: str, rest: str, inside_main: bool) -> tuple[int, bool]:
    """How a tag's place is bad, 0 (not), PART, WHOLE or SURE, and whether only if it is mostly links."""
    if tag != "form" and tag in BAD_TAGS or tag == "header" and not inside_main:
        return SURE, False
    found, by_links = PART if tag == "form" else 0, False
    if not rest or tag in ("html", "body", "main"):
        return found, False
    for name, value in _attributes(rest):
        if name == "hidden" or name == "aria-hidden" and value.strip().lower() == "true" or name == "style" and _NONE.search(value):
            return SURE, False
        if name in ("class", "id", "role"):
            for token in value.lower().split():
                names = {x for x in _PART.split(token) if x}
                parts = BAD_NAMES & names
                if tag == "article":
                    kind = WHOLE if token in OWN_NAMES else 0
                elif not parts or inside_main and names - FILLERS - parts and not parts & OWN_NAMES:
                    kind = 0
                else:
                    kind = WHOLE if inside_main or parts == names or parts & OWN_NAMES else PART
                if kind > found:
                    found, by_links = kind, inside_main and parts <= LINKED_NAMES
    return found, by_links


def _loose(tag: str, rest: str) -> bool:
    """Whether a place that is bad by part of a name may be mere layout: a form, or names that speak of layout."""
    names = [set(_PART.split(token)) for name, value in _attributes(rest) if name in ("class", "id", "role") for token in value.lower().split()]
    return tag == "form" and not any(n & BAD_NAMES for n in names) or all(n & LOOSE_NAMES for n in names if n & BAD_NAMES) and any(n & BAD_NAMES for n in names)


def _read(page: str, layout: set[int]) -> tuple[list[Block], list[Wrapper]]:
    """The blocks of a page with their link characters, whether they stand in a bad place, and their region (the article they are in, 0 if none); and the places that are bad by name.

    layout: where the tags begin whose names do not count."""
    out: list[Block] = []
    wrappers: list[Wrapper] = []
    open_tags: list[tuple[str, int, int, int]] = []  # tag, bad, region, innermost wrapper
    opened: Counter[str] = Counter()
    pieces: list[tuple[str, bool]] = []
    bad, region, inside, regions, link, heading, at = 0, 0, -1, 0, False, False, 0

    def flush() -> None:
        nonlocal pieces
        text = " ".join("".join(p for p, _ in pieces).split())
        if text:
            out.append(Block(text, sum(len(" ".join(p.split())) for p, linked in pieces if linked), bad > 0, region, heading, bad == SURE, inside))
        pieces = []

    def enter(tag: str, rest: str, inner: int, where: int) -> None:
        nonlocal bad, region, inside
        kind, by_links = _bad_place(tag, rest, inner > 0)
        if kind in (PART, WHOLE):
            if where in layout:
                kind = 0
            else:
                wrappers.append(Wrapper(where, kind, inside, {tag} if tag == "article" else set(), kind == PART and _loose(tag, rest), by_links))
                inside = len(wrappers) - 1
        bad, region = max(bad, kind), inner
        open_tags.append((tag, bad, region, inside))
        opened[tag] += 1

    def leave() -> str:
        nonlocal bad, region, inside
        tag = open_tags.pop()[0]
        opened[tag] -= 1
        bad, region, inside = open_tags[-1][1:] if open_tags else (0, 0, -1)
        return tag

    for m in _TOKEN.finditer(page):
        if m.start() > at:
            piece = page[at : m.start()]
            pieces.append((html.unescape(piece) if "&" in piece else piece, link))
        at = m.end()
        if not (tag := m["tag"]):
            continue
        tag = tag.lower()
        if tag == "a":
            link = not m["close"] and any(name == "href" for name, _ in _attributes(m["rest"]))
            continue
        if tag not in BLOCK_TAGS:
            if tag not in VOID_TAGS and tag in BAD_TAGS or tag == "span" and not m["close"] and _bad_place(tag, m["rest"], region > 0)[0]:
                flush()
            else:
                if tag == "span" and m["close"] and open_tags and open_tags[-1][0] == "span":
                    flush()
                    leave()
                continue
        flush()
        if tag in VOID_TAGS:
            continue
        if m["close"]:
            while opened[tag] and leave() != tag:
                pass
            heading = False
        elif tag != "p" and not m["rest"].endswith("/"):
            if bad in (PART, WHOLE) and tag in LAYOUT_TAGS and inside >= 0:
                wrappers[inside].held.add(tag)
            inner = region
            if tag in MAIN_TAGS and not region and not bad:
                regions += 1
                inner = regions
            enter(tag, m["rest"], inner, m.start())
            heading = tag in ("h1", "h2", "h3", "h4", "h5", "h6")
        elif tag == "p":
            if open_tags and open_tags[-1][0] == "p":
                leave()
            if not bad and _bad_place(tag, m["rest"], region > 0)[0]:
                enter(tag, m["rest"], region, m.start())
    if at < len(page):
        piece = page[at:]
        pieces.append((html.unescape(piece) if "&" in piece else piece, link))
    flush()
    for b in out:
        if b.inside >= 0:
            w = wrappers[b.inside]
            w.text, w.linked = w.text + len(b.text), w.linked + b.linked
            if _is_text(b) and not b.sure:
                w.long_text += len(b.text)
    for w in reversed(wrappers):  # wrappers come after those around them
        if w.around >= 0:
            up = wrappers[w.around]
            up.held |= w.held
            up.long_text, up.text, up.linked = up.long_text + w.long_text, up.text + w.text, up.linked + w.linked
    return out, wrappers


def _is_text(b: Block) -> bool:
    return len(b.text) >= SHORT and b.linked <= LINKS * len(b.text)


def _freed(out: list[Block], wrappers: list[Wrapper]) -> set[int]:
    """Where the places begin that turn out to be layout or text, though their names are bad."""
    if freed := {w.begin for w in wrappers if "main" in w.held or w.by_links and w.linked <= LINKS * w.text}:
        return freed
    if not any(b.region and not b.bad for b in out) and (freed := {w.begin for w in wrappers if w.kind == PART and "article" in w.held}):
        return freed
    total = sum(len(b.text) for b in out if _is_text(b) and not b.sure)
    if freed := {w.begin for w in wrappers if w.loose and 2 * w.long_text > total}:
        return freed
    return set() if any(len(b.text) >= SHORT and not b.bad for b in out) else {w.begin for w in wrappers if w.held}


#: Times that a page is read at most, each time without the names found to be no boilerplate.
READS = 6


def blocks(page: str) -> list[Block]:
    layout: set[int] = set()
    for _ in range(READS):
        out, wrappers = _read(page, layout)
        if not (freed := _freed(out, wrappers)):
            break
        layout |= freed
    return out


def _without_teasers(found: list[Block]) -> None:
    """Articles of hardly any text beside a long text outside are marked as boilerplate."""
    inside = sum(len(b.text) for b in found if b.region and not b.bad)
    outside = sum(len(b.text) for b in found if not b.region and not b.bad and len(b.text) >= LONG and _is_text(b))
    if inside < 2 * SHORT and outside >= 4 * inside:
        for b in found:
            if b.region:
                b.bad, b.region = True, 0


def _known_language(found: list[Block]) -> bool:
    """Whether the texts outside bad places show the known stop words; pages without such texts count as known."""
    words = [w for b in found if not b.bad and _is_text(b) for w in _WORD.findall(b.text.lower())]
    return not words or sum(w in STOP_WORDS for w in words) >= FEW_STOPS / 2 * len(words)


def first_pass(b: Block, has_article: bool, known: bool = True) -> bool | None:
    """True (main text), False (boilerplate) or None (open). known: whether stop words tell anything on this page."""
    n = len(b.text)
    if b.bad or has_article and not b.region:
        return False
    if b.linked > (MOST_LINKS if b.region else LINKS) * n and not (b.region and b.heading):
        return None if n < SHORT and b.linked <= SHORT_LINKS * n else False
    if n < SHORT or b.heading:
        return None
    if b.region:
        return True if n >= LONG or b.stops >= FEW_STOPS else None
    if not known:
        return True if n >= LONG else None
    stops = b.stops
    if stops >= MANY_STOPS:
        return True if n >= LONG else None
    return None if stops >= FEW_STOPS or n >= LONG else False


def main_text(page: str | None) -> str:
    if not page:
        return ""
    found = blocks(page)
    if any(b.region and not b.bad for b in found):
        _without_teasers(found)
    has_article = any(b.region and not b.bad for b in found)
    known = has_article or _known_language(found)
    labels = [first_pass(b, has_article, known) for b in found]
    if not has_article and True not in labels:
        return " ".join(b.text for b, label in zip(found, labels, strict=True) if label is None)
    # second pass: nearest decided block before and after, within the region
    n = len(found)
    before: list[tuple[int, bool] | None] = [None] * n
    after: list[tuple[int, bool] | None] = [None] * n
    for order, near in ((range(n), before), (range(n - 1, -1, -1), after)):
        last: dict[int, tuple[int, bool]] = {}
        for i in order:
            if (label := labels[i]) is not None and not found[i].bad:
                last[found[i].region] = (i, label)
            near[i] = last.get(found[i].region)
    keep = []
    for i, b in enumerate(found):
        label = labels[i]
        if label is None:
            near = [x for x in (before[i], after[i]) if x]
            if not near:
                label = bool(b.region) or not has_article
            elif b.heading and after[i]:
                label = after[i][1]
            else:
                distance = min(abs(x[0] - i) for x in near)
                label = any(x[1] for x in near if abs(x[0] - i) == distance) if b.region or len(b.text) >= SHORT else all(x[1] for x in near if abs(x[0] - i) == distance)
        if label:
            keep.append(b.text)
    return " ".join(keep)


def extract(pages: DataFrame) -> DataFrame:
    """(page_id, url, text, n_chars) for each row of pages (page_id, url, html)."""
    small_batches(pages.sparkSession)

    def texts(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            yield frame[["page_id", "url"]].assign(text=[main_text(h) for h in frame["html"]])

    rows = pages.select(F.col("page_id").cast("string").alias("page_id"), "url", "html")
    out = rows.mapInPandas(texts, "page_id string, url string, text string")
    return out.select(F.col("page_id").cast(dict(pages.dtypes)["page_id"]).alias("page_id"), "url", "text", F.char_length("text").cast("long").alias("n_chars"))

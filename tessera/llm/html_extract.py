"""Main text of web pages by two passes of rules over text blocks.

Pass one decides long blocks by link density and stop-word density (by length and links alone where no
block of the page has stop words of a known language), and blocks in parts of the page that are never
its article by their tags and class names.  A class name does not hold for a part that contains the
page's article or first heading, if there is no text outside of it.  Pass two gives ambiguous short
blocks the label of their nearest decided neighbours.
"""

from __future__ import annotations

import heapq
import html as entities
import re
from collections.abc import Iterator
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera.llm.common import batch_rows

SCHEMA = T.StructType([T.StructField("page_id", T.LongType()), T.StructField("url", T.StringType()), T.StructField("text", T.StringType())])

# Frequent function words of the languages that the corpus holds.
STOP_WORDS = frozenset(
    """the of and to in is it that a an for on with as are this be by at from or was not have has had but they he she
    his her its their we you i were been which will would there can if about so
    der die das und ist in den von zu mit sich des auf für nicht ein eine einer eines einem als auch es an werden aus
    er hat dass sie nach bei um am sind noch wie einen so über vor zum zur war wir aber ich
    le la les de des du un une et est en que qui dans pour pas sur au aux par avec ce cette ces il elle on ne se son
    sa ses plus nous vous ils sont été mais ou où
    el los las y del al lo se por con no una su para como más o pero sus ha me sin sobre este ya entre cuando muy
    también hasta hay donde quien desde todo son""".split()
)
# Elements by their part in a page.
RAW = frozenset("script style noscript template textarea iframe svg".split())
NEVER = frozenset("head nav footer aside form button select option dialog menu object canvas video audio".split()) | RAW
BLOCK = frozenset(
    """address article aside blockquote body caption center dd details dialog div dl dt fieldset figcaption figure
    footer form h1 h2 h3 h4 h5 h6 head header hr html legend li main menu nav ol option p pre section select summary
    table tbody td tfoot th thead title tr ul""".split()
)
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
HINTS = re.compile(
    r"(?:^|[\s_-])(?:ads?|advert\w*|sponsor\w*|promo\w*|banner\w*|cookie\w*|consent|gdpr|notices?|alerts?|popup|modal|overlay|"
    r"newsletter|subscribe|signup|login|side-?bar|widget|related|recommend\w*|share|sharing|social|comments?|replies|"
    r"disqus|respond|breadcrumbs?|menus?|nav|navbar|navigation|pagination|pager|footer|masthead|skip|toolbar|search)(?:$|[\s_-])",
    re.I,
)
TAG = re.compile(r"<(?:!--.*?(?:--!?>|\Z)|([!?/]?)([a-zA-Z\[][^\s/>]*)((?:\"[^\"]*\"|'[^']*'|[^\"'>])*>|[^>]*(?:>|\Z)))", re.S)
NAMED = re.compile(r"\b(?:class|id|role)\s*=\s*(\"[^\"]*\"|'[^']*'|[^\s\"'>]+)", re.I)
WORDS = re.compile(r"\w+")

SHORT = 70  # characters below which a block is ambiguous
LINKS = 0.33  # share of a block's characters in links from which it is a menu
STOPS = 0.12  # share of stop words from which a long block is text


@dataclass
class Block:
    text: str
    linked: int
    never: bool  # by an element's name
    hint: int  # the innermost element around it whose class or id says so, 0: none
    inside: bool
    heading: bool
    good: bool | None = None


@dataclass
class Hints:
    """Elements whose class or id says that they are no article, numbered from 1 as they open."""

    outer: list[int]  # the next such element around each
    holds: list[bool]  # whether an article or a first heading opens inside

    def add(self, outer: int) -> int:
        self.outer.append(outer)
        self.holds.append(False)
        return len(self.outer) - 1

    def hold(self, hint: int) -> None:
        while hint and not self.holds[hint]:
            self.holds[hint] = True
            hint = self.outer[hint]


class Open:
    """The open elements: (name, never text, hint, in an article), with the places of each name.

    Every step takes constant time for each element that it opens or closes, however many stay open.
    """

    def __init__(self) -> None:
        self.stack: list[tuple[str, bool, int, bool]] = []
        self.places: dict[str, list[int]] = {}
        self.blocks: list[int] = []

    def push(self, element: tuple[str, bool, int, bool]) -> None:
        self.places.setdefault(element[0], []).append(len(self.stack))
        if element[0] in BLOCK:
            self.blocks.append(len(self.stack))
        self.stack.append(element)

    def last(self, name: str) -> int:
        at = self.places.get(name)
        return at[-1] if at else -1

    def last_block(self) -> int:
        return self.blocks[-1] if self.blocks else -1

    def leave(self, k: int) -> None:
        """Close the element at place k and whatever is still open inside, such as a link."""
        while len(self.stack) > k:
            name = self.stack.pop()[0]
            self.places[name].pop()
            if name in BLOCK:
                self.blocks.pop()


def blocks_of(page: str) -> tuple[list[Block], Hints]:
    """Text blocks in page order with what pass one needs to know of each, and the hinted elements."""
    out: list[Block] = []
    now = Open()
    parts: list[str] = []
    linked, at, hinted = 0, 0, Hints([0], [False])

    def close() -> None:
        nonlocal parts, linked
        text = " ".join(entities.unescape("".join(parts)).split())
        if text:
            never, hint, inside = now.stack[-1][1:] if now.stack else (False, 0, False)
            heading = any(e[0][0] in "hH" and e[0][1:].isdigit() for e in now.stack[-3:])
            out.append(Block(text, linked, never, hint, inside, heading))
        parts, linked = [], 0

    def add(piece: str) -> None:
        nonlocal linked
        parts.append(piece)
        if now.places.get("a"):
            linked += len(piece)

    end = 0
    for m in TAG.finditer(page):
        if m.start() < end:
            continue
        if m.start() > at:
            add(page[at : m.start()])
        at = m.end()
        sign, name = m[1], (m[2] or "").lower()
        if not name or sign in ("!", "?"):
            continue
        if name == "br":
            parts.append(" ")
            continue
        if name in BLOCK:
            close()
        if sign:
            if (k := now.last(name)) >= 0:
                now.leave(k)
            continue
        if name in VOID or m[3].endswith("/>"):
            continue
        if name in RAW:
            stop = re.compile(rf"</{name}\b[^>]*>?", re.I).search(page, at)
            at = end = stop.end() if stop else len(page)
            continue
        # a paragraph ends where a block begins, a link where the next one does
        if name == "a" and now.last("a") > now.last_block():
            now.leave(now.last("a"))
        elif name in BLOCK and now.last("p") >= 0 and now.last("p") == now.last_block():
            now.leave(now.last("p"))
        never, hint, inside = now.stack[-1][1:] if now.stack else (False, 0, False)
        if name in ("article", "main", "h1"):
            hinted.hold(hint)
        if name in ("article", "main") and not never and not hint:
            inside = True
        elif name in NEVER or (name == "header" and not inside):
            never = True
        if not never and name not in ("html", "body", "article", "main") and len(m[3]) > 1 and any(HINTS.search(v.strip("\"'")) for v in NAMED.findall(m[3])):
            hint = hinted.add(hint)
        now.push((name, never, hint, inside))
    if at < len(page):
        add(page[at:])
    close()
    return out, hinted


def stop_share(text: str) -> float:
    words = WORDS.findall(text.lower())
    return sum(w in STOP_WORDS for w in words) / max(1, len(words))


def free_of_hints(blocks: list[Block], like_text: list[bool], hints: Hints) -> list[bool]:
    """Whether a block with that innermost hint may be text, for every hint (the first entry: without one).

    As long as no block that is like text is free, the outermost hinted element that has most of such
    text, of those that hold an article, gives way, and then those inside it.  Elements wait in a
    heap, each enters it once.
    """
    n = len(hints.outer)
    total, direct, free = [0] * n, [False] * n, [True] + [False] * (n - 1)
    for b, t in zip(blocks, like_text, strict=True):
        if t and not b.never:
            total[b.hint] += len(b.text)
            direct[b.hint] = True
    if direct[0]:
        return free
    inner: list[list[int]] = [[] for _ in range(n)]
    for h in range(n - 1, 0, -1):
        total[hints.outer[h]] += total[h]
        inner[hints.outer[h]].append(h)
    waiting = []

    def enter(outer: int) -> None:
        for h in inner[outer]:
            if hints.holds[h] and total[h]:
                heapq.heappush(waiting, (-total[h], h))

    enter(0)
    while waiting:
        h = heapq.heappop(waiting)[1]
        free[h] = True
        if direct[h]:
            break
        enter(h)
    return free


def decide(blocks: list[Block], hints: Hints) -> None:
    """Pass one: decided blocks get a label, ambiguous ones keep None."""
    stops = [stop_share(b.text) for b in blocks]
    known = any(len(b.text) >= SHORT and s >= STOPS for b, s in zip(blocks, stops, strict=True))
    like_text = [
        len(b.text) >= (SHORT if known else 2 * SHORT) and b.linked < LINKS * len(b.text) and (s >= STOPS or not known) for b, s in zip(blocks, stops, strict=True)
    ]
    free = free_of_hints(blocks, like_text, hints)
    for b, s, t in zip(blocks, stops, like_text, strict=True):
        if b.never or not free[b.hint] or b.linked >= LINKS * len(b.text):
            b.good = False
        elif b.inside:
            b.good = True if len(b.text) >= SHORT or s >= STOPS else None
        elif len(b.text) >= SHORT:
            b.good = t


def inherit(blocks: list[Block]) -> None:
    """Pass two: an ambiguous block takes the label of its nearest decided neighbours.

    If they differ, a block of the article and a heading before text are text, others are not.
    Beyond the first and the last decided block a page has no text; without any, all of it is text.
    """
    labels = [b.good for b in blocks]
    after: list[bool | None] = []
    last: bool | None = None
    for g in reversed(labels):
        after.append(last)
        last = last if g is None else g
    after.reverse()
    before: bool | None = None
    decided = any(g is not None for g in labels)
    for b, g, nxt in zip(blocks, labels, after, strict=True):
        if g is None:
            sides = [x for x in (before, nxt) if x is not None]
            if not decided:
                b.good = True
            elif all(x == sides[0] for x in sides):
                b.good = sides[0] or b.inside
            else:
                b.good = b.inside or (b.heading and bool(nxt))
        else:
            before = g


def main_text(page: str | None) -> str:
    blocks, hints = blocks_of(page or "")
    decide(blocks, hints)
    inherit(blocks)
    return "\n".join(b.text for b in blocks if b.good)


def extract(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for pdf in batches:
        yield pd.DataFrame({"page_id": pdf["page_id"], "url": pdf["url"], "text": [main_text(h) for h in pdf["html"].tolist()]})


def main_texts(pages: DataFrame) -> DataFrame:
    """page_id, url, text, n_chars for every row of pages (page_id, url, html).

    Null and empty html, and pages without text, give an empty string.  Malformed markup is read as
    far as it goes, in time linear in its length.  Repeated rows are extracted each; an empty table gives an empty result.  Extra
    columns are ignored.
    """
    batch_rows(pages.sparkSession)
    rows = pages.select(F.col("page_id").cast("long"), F.col("url").cast("string"), F.col("html").cast("string"))
    out = rows.mapInPandas(extract, SCHEMA)
    return out.select("page_id", "url", "text", F.length("text").cast("long").alias("n_chars"))

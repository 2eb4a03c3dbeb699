"""Main text of web pages: flat text blocks classified by a small decision tree.

A page is cut into blocks at every element that is not inline. Each block has its number
of words, the share of them inside links, the same two of its neighbours, and its zone:
whether an element around it is page furniture, the innermost telling one an article, or
nothing of the kind. A decision tree grown on the labelled table below keeps or drops the
block. Furniture is told by the element or by the noun of a class, id or role; where nothing
is left of a page, what was furniture by such a name alone is judged as if it had none.

A page is read once from front to back: what a tag or quote leaves open is not looked for
again.
"""

from __future__ import annotations

import html
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

FURNITURE, PLAIN, ARTICLE = -1, 0, 1

_INLINE = frozenset(
    "a abbr b bdi bdo big cite code data del dfn em font i img ins kbd mark q s samp small span strike strong "
    "sub sup time tt u var wbr".split()
)
_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
_FURNITURE_TAGS = frozenset(
    "head title nav header footer aside form button select option label fieldset menu dialog address".split()
)
_ARTICLE_TAGS = frozenset(["article", "main"])
_FURNITURE_NAMES = frozenset(
    "ad ads adv advert adverts advertisement advertising sponsor sponsored promo promotion banner cookie cookies consent "
    "notice notices alert popup modal overlay newsletter subscribe signup sidebar rail widget widgets related recommended "
    "share sharing social nav navbar navigation menu breadcrumb breadcrumbs pagination pager header masthead footer "
    "copyright legal comment comments commentlist reply replies discussion respond login search toolbar complementary "
    "contentinfo hidden".split()
)
_ARTICLE_NAMES = frozenset("article articlebody post entry story main maincontent".split())
#: Parts of a name that say where or what a box is; the noun stands before them.
_PLACES = frozenset(
    "area bar block body bottom box button buttons card col column container content group holder icon inner item items left "
    "line link links list outer panel right row section slot text top unit wrap wrapper zone".split()
)
#: A name that begins so tells of something else on the page.
_ABOUT = frozenset("with without no not has hasnt is show shows hide below above before after".split())

_START = re.compile(r"<(?:(!--)|([!?])|(/?)([a-z][a-z0-9:-]*))", re.I)
_REST = re.compile(r"[^>\"']*(?:\"[^\"]*\"[^>\"']*|'[^']*'[^>\"']*)*")
_RAW = frozenset("script style noscript template textarea iframe svg object canvas".split())
_RAW_END = {tag: re.compile(rf"</{tag}\s*>", re.I) for tag in _RAW}
_ATTRIBUTE = re.compile(r"([^\s=>\"'/]+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+)))?")
_UNSEEN = re.compile(r"display\s*:\s*none|visibility\s*:\s*hidden", re.I)


def _tokens(page: str) -> Iterator[tuple[str, str, str]]:
    """Text (``"", text, ""``), tags (``name, "", attributes``) and end tags (``name, "/", ""``) in order.

    Comments, declarations and elements of other contents are left out; one that is not closed
    reaches to the end, as does a tag. After a quote that never ends quotes protect no longer.
    """
    start = at = 0
    last, quotes = page.rfind(">"), True
    while (lt := page.find("<", at)) >= 0:
        found = _START.match(page, lt)
        if not found:
            at = lt + 1
            continue
        if lt > start:
            yield "", page[start:lt], ""
        start = at = len(page)
        if found[1]:
            end = page.find("-->", lt + 4)
            at = len(page) if end < 0 else end + 3
        elif last >= found.end():
            end = page.find(">", found.end())
            if found[4] and quotes:
                whole = _REST.match(page, found.end()).end()
                quotes = whole < len(page) and page[whole] == ">"
                end = whole if quotes else end
            at = end + 1
            tag = (found[4] or "").lower()
            if tag:
                yield tag, found[3], page[found.end() : end]
            if tag in _RAW and not found[3]:
                close = _RAW_END[tag].search(page, at)
                at = close.end() if close else len(page)
        start = at
    if start < len(page):
        yield "", page[start:], ""


@dataclass
class Block:
    text: str
    words: int
    linked: int
    zone: int
    #: Furniture by a name alone.
    named: bool = False

    @property
    def density(self) -> float:
        return self.linked / self.words if self.words else 0.0


def _meaning(name: str) -> int | None:
    """What a class, id or role says: the noun is its last part that is no place."""
    parts = re.findall(r"[a-z]+", re.sub(r"(?<=[a-z])(?=[A-Z])", " ", name).lower())
    if not parts or parts[0] in _ABOUT:
        return None
    while len(parts) > 1 and parts[-1] in _PLACES:
        parts.pop()
    if parts[-1] in _FURNITURE_NAMES:
        of_article = parts[-1] == "header" and not _ARTICLE_NAMES.isdisjoint(parts)
        return None if of_article else FURNITURE
    return ARTICLE if parts[-1] in _ARTICLE_NAMES else None


def _zone(tag: str, attributes: str) -> tuple[int | None, bool]:
    """Zone that an element opens, if any, and whether a name alone says so."""
    if tag in _FURNITURE_TAGS:
        return FURNITURE, False
    said: set[int | None] = set()
    for found in _ATTRIBUTE.finditer(attributes):
        name = found[1].lower()
        value = found[2] or found[3] or found[4] or ""
        if name == "hidden" and value.lower() not in ("false", "until-found"):
            return FURNITURE, False
        if name == "aria-hidden" and value.lower() == "true" or name == "style" and _UNSEEN.search(value):
            return FURNITURE, False
        if name in ("class", "id", "role", "itemprop"):
            said.update(_meaning(one) for one in value.split())
    if tag in _ARTICLE_TAGS:
        return ARTICLE, False
    if FURNITURE in said and tag not in ("body", "html"):
        return FURNITURE, True
    return (ARTICLE if ARTICLE in said else None), False


def blocks_of(page: str) -> list[Block]:
    """Flat blocks of a page in order, without empty ones. Markup left open ends with its parent."""
    blocks: list[Block] = []
    stack: list[tuple[str, int, bool]] = []  # open elements with the zone inside them
    opened: Counter[str] = Counter()
    parts: list[str] = []
    links: list[str] = []
    depth_in_link = 0
    zone, named = PLAIN, False

    def close() -> None:
        words = len(text := " ".join("".join(parts).split())) and text.count(" ") + 1
        if words:
            linked = len("".join(links).split())
            blocks.append(Block(text, words, min(linked, words), zone, named))
        parts.clear()
        links.clear()

    for tag, other, attributes in _tokens(page):
        if not tag:
            text = html.unescape(other) if "&" in other else other
            parts.append(text)
            if depth_in_link:
                links.append(text)
            elif links:
                links.append(" ")
            continue
        if tag in _RAW:
            if not other:
                close()
            continue
        if other:
            if tag not in _INLINE:
                close()
            depth_in_link = max(0, depth_in_link - 1) if tag == "a" else depth_in_link
            if opened[tag]:
                before = zone, named
                while True:
                    gone = stack.pop()
                    opened[gone[0]] -= 1
                    if gone[0] == tag:
                        break
                inside = stack[-1][1:] if stack else (PLAIN, False)
                if inside != before:
                    close()
                zone, named = inside
            continue
        if tag not in _INLINE:
            close()
            if tag != "br":
                depth_in_link = 0
        elif tag == "a":
            depth_in_link = 1
        if tag in _VOID:
            continue
        own, by_name = _zone(tag, attributes)
        # Furniture stays furniture below, but for what only its name makes so.
        if own is not None and (zone != FURNITURE or named and own == FURNITURE and not by_name) and (own, by_name) != (zone, named):
            close()
            zone, named = own, by_name
        stack.append((tag, zone, named))
        opened[tag] += 1
    close()
    return blocks


def features(blocks: list[Block]) -> np.ndarray:
    """``words, density`` of the block, the one before and the one after, and the zone."""
    own = np.array([[b.words, b.density] for b in blocks], dtype=float).reshape(-1, 2)
    edge = np.zeros((1, 2))
    before, after = np.vstack([edge, own[:-1]]), np.vstack([own[1:], edge])
    return np.hstack([own, before, after, np.array([[b.zone] for b in blocks], dtype=float).reshape(-1, 1)])


#: Labelled blocks: words, density, words and density before, words and density after, zone, kept.
LABELLED = np.array(
    [
        # page furniture, whatever its length
        (1, 0, 0, 0, 1, 1, -1, 0), (9, 0, 0, 0, 1, 1, -1, 0), (1, 1, 1, 1, 1, 1, -1, 0), (2, 1, 1, 1, 3, 1, -1, 0),
        (7, 0, 1, 1, 11, 0, -1, 0), (12, 0, 1, 1, 40, 0, -1, 0), (45, 0, 60, 0, 80, 0, -1, 0), (90, 0, 70, 0, 15, 0, -1, 0),
        (30, 0.1, 120, 0, 0, 0, -1, 0), (6, 0, 60, 0, 0, 0, -1, 0), (25, 0.5, 80, 0, 25, 0.4, -1, 0), (3, 0, 30, 0, 2, 0, -1, 0),
        (150, 0, 90, 0, 140, 0, -1, 0), (400, 0.05, 200, 0, 3, 1, -1, 0),
        # inside an article, down to single words and linked lines
        (1, 0, 60, 0, 70, 0, 1, 1), (8, 0, 7, 0, 12, 0, 1, 1), (11, 0, 1, 1, 20, 0, 1, 1), (60, 0, 11, 0, 80, 0, 1, 1),
        (200, 0, 50, 0, 1, 0, 1, 1), (2, 0, 90, 0, 5, 0, 1, 1), (15, 0.4, 60, 0, 60, 0, 1, 1), (4, 1, 50, 0, 60, 0, 1, 1),
        (3, 0, 0, 0, 0, 0, 1, 1), (1, 1, 1, 1, 1, 1, 1, 1), (30, 0, 3, 0, 9, 0, 1, 1), (500, 0.02, 300, 0, 4, 0, 1, 1),
        # no telling element: running text is kept
        (60, 0, 50, 0, 70, 0, 0, 1), (120, 0.05, 8, 0, 90, 0, 0, 1), (25, 0, 40, 0, 35, 0, 0, 1), (40, 0.1, 1, 1, 60, 0, 0, 1),
        (80, 0, 60, 0, 3, 1, 0, 1), (18, 0, 0, 0, 0, 0, 0, 1), (35, 0.2, 60, 0, 50, 0, 0, 1), (300, 0.1, 2, 1, 2, 1, 0, 1),
        (22, 0.1, 2, 1, 45, 0, 0, 1), (16, 0, 55, 0, 2, 1, 0, 1),
        # short lines next to running text belong to it
        (6, 0, 3, 1, 60, 0, 0, 1), (3, 0, 60, 0, 70, 0, 0, 1), (8, 0, 40, 0, 50, 0, 0, 1), (1, 0, 45, 0, 40, 0, 0, 1),
        (5, 0, 30, 0, 25, 0, 0, 1), (10, 0, 2, 1, 30, 0, 0, 1), (4, 0, 0, 0, 50, 0, 0, 1),
        # linked lines and short lines among short ones are furniture
        (1, 1, 1, 1, 1, 1, 0, 0), (2, 1, 2, 1, 2, 1, 0, 0), (4, 1, 3, 1, 60, 0, 0, 0), (5, 0.9, 70, 0, 4, 1, 0, 0),
        (12, 0.8, 12, 0.9, 10, 0.8, 0, 0), (30, 0.8, 3, 1, 4, 1, 0, 0), (8, 0.6, 60, 0, 3, 0, 0, 0), (20, 0.7, 60, 0, 50, 0, 0, 0),
        (3, 0, 2, 1, 2, 1, 0, 0), (2, 0, 3, 0, 4, 0, 0, 0), (5, 0, 60, 0, 0, 0, 0, 0), (6, 0, 80, 0, 2, 1, 0, 0),
        (4, 0, 5, 0, 3, 1, 0, 0), (7, 0, 1, 1, 5, 0, 0, 0), (3, 0, 0, 0, 1, 1, 0, 0), (2, 0, 40, 0, 3, 0, 0, 0),
    ]
)


@dataclass
class Tree:
    """A split on one feature, or a leaf with ``kept`` set."""

    kept: int | None = None
    feature: int = 0
    limit: float = 0.0
    low: Tree | None = None
    high: Tree | None = None

    def keep(self, rows: np.ndarray) -> np.ndarray:
        if self.kept is not None:
            return np.full(len(rows), bool(self.kept))
        out = np.empty(len(rows), dtype=bool)
        under = rows[:, self.feature] <= self.limit
        out[under] = self.low.keep(rows[under])
        out[~under] = self.high.keep(rows[~under])
        return out


def grow(rows: np.ndarray, kept: np.ndarray, depth: int = 6) -> Tree:
    """The tree whose every split lowers the Gini impurity most; ties take the first feature and limit."""
    if depth == 0 or len(set(kept)) == 1:
        return Tree(kept=int(kept.mean() >= 0.5))
    best = None
    for feature in range(rows.shape[1]):
        values = np.unique(rows[:, feature])
        for limit in (values[1:] + values[:-1]) / 2:
            under = rows[:, feature] <= limit
            impurity = sum(part.sum() * (p := kept[part].mean()) * (1 - p) for part in (under, ~under))
            if best is None or impurity < best[0] - 1e-12:
                best = (impurity, feature, limit)
    if best is None:
        return Tree(kept=int(kept.mean() >= 0.5))
    _, feature, limit = best
    under = rows[:, feature] <= limit
    return Tree(None, feature, float(limit), grow(rows[under], kept[under], depth - 1), grow(rows[~under], kept[~under], depth - 1))


def train_tree(table: np.ndarray = LABELLED) -> Tree:
    return grow(table[:, :-1], table[:, -1])


def main_text(page: str | None, tree: Tree) -> str:
    found = blocks_of(page or "")
    if not found:
        return ""
    kept = tree.keep(features(found))
    if not kept.any():
        # Names are not believed where they take the whole page, and short lines that are no links are all it has.
        found = [Block(b.text, b.words, b.linked, PLAIN) if b.named else b for b in found]
        kept = tree.keep(features(found))
        if not kept.any():
            kept = [b.zone == PLAIN and b.density < 0.5 and any(map(str.isalnum, b.text)) for b in found]
    return " ".join(b.text for b, keep in zip(found, kept, strict=True) if keep)


def extract_text(pages: DataFrame, html_col: str = "html", text_col: str = "text") -> DataFrame:
    """``pages`` without the markup column and with the main text, empty where there is none.

    NULL and empty pages give an empty text; pages are read whole, repeated rows are kept and
    other columns pass through, except one named as the new column, which is replaced.
    """
    tree = train_tree()
    others = [c for c in pages.columns if c not in (html_col, text_col)]
    rows = pages.select(*[F.col(f"`{c}`") for c in others], F.col(html_col).cast("string").alias("__html"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [main_text(page.as_py(), tree) for page in batch.column(len(others))]
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(texts, pa.string())], names=[*others, text_col])

    schema = rows.select(*[F.col(f"`{c}`") for c in others], F.lit("").alias(text_col)).schema
    return rows.mapInArrow(run, schema)

"""Benchmark decontamination: n-gram seeds, then Smith-Waterman alignment.

Seeds are the word n-grams of the test items. Where a training text holds a seed of an
item, the passage around it is aligned with the item word by word; copies score by how
much of the item they keep, through replaced, dropped and added words.

No seed is left out for being common: a leak into many documents makes its own seeds so.
What common seeds point at in vain falls to an exact bound instead: an alignment scores at
most the full value of the item's words that the text, and then the passage, has at all.

The tables of the items are sent to the executors in blocks of a fixed number of seeds,
so their size is bounded however many items there are; each block is one pass.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from flowgauge.llm.words import WordReader, chunks, shingles

SEED_WORDS = 3
#: Most seeds of one block.
BLOCK_SEEDS = 1_000_000
MATCH, MISMATCH, GAP = 2, -1, -1
#: Items shorter than this count as copied only if they stand in the text word for word.
FULL_WORDS = 8
#: Places of items that are opened at once for the seeds of a text.
OPENED = 1 << 20


@dataclass
class Items:
    """Words and seeds of one block of items."""

    ids: list[int]
    words: list[np.ndarray]
    seeds: np.ndarray  # distinct, sorted
    begin: np.ndarray  # postings of each seed
    item: np.ndarray
    place: np.ndarray
    known: np.ndarray  # distinct words of all items, sorted
    word: np.ndarray  # places in ``known`` of the items' words, one item after the other
    start: np.ndarray  # where the words of each item begin (one entry more than items)

    @staticmethod
    def of(rows: list[tuple[int, str]]) -> Items:
        reader = WordReader(marks=False)
        words, at = reader.read([text for _, text in rows])
        each = [words[at[i] : at[i + 1]] for i in range(len(rows))]
        found = [shingles(w, SEED_WORDS) if len(w) >= SEED_WORDS else w[:0] for w in each]
        flat = np.concatenate([*found, np.zeros(0, dtype=np.uint64)])
        item = np.repeat(np.arange(len(rows)), [len(f) for f in found])
        place = np.concatenate([*[np.arange(len(f)) for f in found], np.zeros(0, dtype=np.int64)])
        order = np.argsort(flat, kind="stable")
        seeds, begin = np.unique(flat[order], return_index=True)
        known, word = np.unique(words, return_inverse=True)
        return Items([i for i, _ in rows], each, seeds, np.append(begin, len(flat)), item[order], place[order], known, word, at)

    def hits(self, words: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Places in a text and the seeds found there."""
        if len(words) < SEED_WORDS or not len(self.seeds):
            return np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64)
        found = shingles(words, SEED_WORDS)
        at = np.minimum(np.searchsorted(self.seeds, found), len(self.seeds) - 1)
        place = np.nonzero(self.seeds[at] == found)[0]
        return place, at[place]

    def enough(self, least: float) -> np.ndarray:
        """Score from which on a text counts as a copy of each item."""
        length = np.diff(self.start)
        full = MATCH * length
        return np.where(length < FULL_WORDS, full, np.maximum(least * full, MATCH * FULL_WORDS / 2))


def align(passages: list[np.ndarray], items: list[np.ndarray]) -> np.ndarray:
    """Best local alignment score of each passage with its item, all pairs row by row at once."""
    if not passages:
        return np.zeros(0, dtype=np.int32)
    width, height = max(map(len, passages)), max(map(len, items))
    text = np.zeros((len(passages), width), dtype=np.uint64)
    here = np.zeros((len(passages), width), dtype=bool)
    for k, p in enumerate(passages):
        text[k, : len(p)], here[k, : len(p)] = p, True
    item = np.zeros((len(items), height), dtype=np.uint64)
    length = np.array([len(i) for i in items])
    for k, i in enumerate(items):
        item[k, : len(i)] = i
    slope = (-GAP * np.arange(width)).astype(np.int32)
    row = np.zeros((len(passages), width + 1), dtype=np.int32)
    best = np.zeros(len(passages), dtype=np.int32)
    for r in range(height):
        live = (r < length)[:, None] & here
        step = np.where(live, np.where(text == item[:, r : r + 1], MATCH, MISMATCH), -(1 << 20)).astype(np.int32)
        new = np.maximum(np.maximum(row[:, :-1] + step, row[:, 1:] + GAP), 0)
        # Gaps along the row: a running maximum once the slope of the gaps is taken out.
        new = np.maximum.accumulate(new + slope, axis=1) - slope
        row = np.concatenate([np.zeros((len(row), 1), dtype=np.int32), new], axis=1)
        best = np.maximum(best, np.where(r < length, new.max(axis=1), 0))
    return best


def _ranges(begin: np.ndarray, n: np.ndarray) -> np.ndarray:
    """``begin, begin + 1, ...``, ``n`` of them, for each entry."""
    return np.repeat(begin - (np.cumsum(n) - n), n) + np.arange(n.sum())


def _passages(items: Items, words: np.ndarray, enough: np.ndarray, has: np.ndarray) -> list[tuple[int, int, int]]:
    """``item, begin, end`` of the passages of a text that its seeds point at, without those
    that hold too few of the item's words to score ``enough``.

    ``has`` is room for a mark on each known word and one more, and is left as it was, unset.
    """
    place, seed = items.hits(words)
    if not len(place):
        return []
    at = np.minimum(np.searchsorted(items.known, words), len(items.known) - 1)
    word = np.where(items.known[at] == words, at, -1)
    # Every matching column of an alignment takes one of the item's words that the text has. Items are
    # judged by it from each seed once, before the places of seeds that come often are opened.
    n = np.diff(items.begin)
    met = np.unique(seed)
    own = np.unique(items.item[_ranges(items.begin[met], n[met])])
    length = np.diff(items.start)
    has[word] = True
    held = np.add.reduceat(has[items.word[_ranges(items.start[own], length[own])]], np.cumsum(length[own]) - length[own], dtype=np.int64)
    has[word] = False
    hopeful = np.zeros(len(length), dtype=bool)
    hopeful[own[MATCH * held >= enough[own]]] = True
    if not hopeful.any():
        return []
    opened = np.cumsum(n[seed])
    cuts = np.searchsorted(opened, np.arange(0, opened[-1], OPENED), side="left")
    found = []
    for a, b in zip(cuts, [*cuts[1:], len(seed)], strict=True):
        posting = _ranges(items.begin[seed[a:b]], n[seed[a:b]])
        keep = hopeful[items.item[posting]]
        found.append((items.item[posting][keep], (np.repeat(place[a:b], n[seed[a:b]]) - items.place[posting])[keep]))
    item, shift = (np.concatenate(x) for x in zip(*found, strict=True))
    if not len(item):
        return []
    order = np.lexsort((shift, item))
    item, shift = item[order], shift[order]
    length = length[item]
    new = np.nonzero(np.append(True, (item[1:] != item[:-1]) | (shift[1:] - shift[:-1] > length[1:])))[0]
    out = []
    for a, b in zip(new, [*new[1:], len(item)], strict=True):
        k, m = item[a], length[a]
        begin, end = max(0, int(shift[a] - m // 2)), min(len(words), int(shift[b - 1] + m + m // 2))
        has[word[begin:end]] = True
        held = np.count_nonzero(has[items.word[items.start[k] : items.start[k + 1]]])
        has[word[begin:end]] = False
        if MATCH * held >= enough[k]:
            out.append((int(k), begin, end))
    return out


def scores(items: Items, texts: list[str], reader: WordReader, least: float) -> list[dict[int, float]]:
    """For each text the items copied into it, and the share of the item's full score."""
    words, at = reader.read(texts)
    enough = items.enough(least)
    has = np.zeros(len(items.known) + 1, dtype=bool)
    cases = []
    for i in range(len(texts)):
        own = words[at[i] : at[i + 1]]
        cases += [(i, item, own[a:b]) for item, a, b in _passages(items, own, enough, has)]
    cases.sort(key=lambda c: (len(c[2]), len(items.words[c[1]])))
    out: list[dict[int, float]] = [{} for _ in texts]
    at_once = 0
    while at_once < len(cases):
        # About as many cells at once, whatever the lengths.
        size = max(1, (1 << 20) // max(1, len(cases[at_once][2])))
        some = cases[at_once : at_once + size]
        widest = len(some[-1][2])
        some = some[: max(1, (1 << 20) // max(1, widest))]
        at_once += len(some)
        best = align([p for _, _, p in some], [items.words[k] for _, k, _ in some])
        for (i, k, _), score in zip(some, best, strict=True):
            if score >= enough[k]:
                out[i][k] = max(out[i].get(k, 0.0), float(score) / (MATCH * len(items.words[k])))
    return out


def item_blocks(items: DataFrame, item_col: str, item_text: str) -> Iterator[Broadcast]:
    """The items, block by block."""
    spark = items.sparkSession
    rows = items.where(F.col(item_col).isNotNull() & F.col(item_text).isNotNull()).select(
        F.col(item_col).cast("long").alias("item"), F.col(item_text).alias("text")
    )
    # A text has no more words than half its characters and one.
    weight = rows.agg(F.sum(F.length("text") / 2 + 1)).first()[0] or 0
    blocks = max(1, int(-(-weight // BLOCK_SEEDS)))
    for block in range(blocks):
        own = rows.where(F.pmod(F.xxhash64("item", "text"), F.lit(blocks)) == block).distinct().collect()
        yield spark.sparkContext.broadcast(Items.of(sorted((r["item"], r["text"]) for r in own)))


def find_leaks(
    docs: DataFrame,
    items: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    item_col: str = "item_id",
    item_text: str = "text",
    *,
    least: float = 0.5,
) -> DataFrame:
    """``id_col, item_id, score`` of every pair of a text and an item whose alignment reaches
    ``least`` of the item's full score.

    Items under eight words count only when the text holds all their words in a row; items
    without a seed (under three words), NULL items and NULL texts match nothing. Repeated
    rows each give their pairs. Empty tables give an empty result.
    """
    rows = docs.select(F.col(id_col).cast("long").alias("doc"), F.col(text_col).alias("text"))
    out = None

    def scan(items: Broadcast) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            reader = WordReader(marks=False)
            for batch in batches:
                for start, texts in chunks(batch.column(1)):
                    found = scores(items.value, texts, reader, least)
                    pairs = [(start + i, k, s) for i, own in enumerate(found) for k, s in own.items()]
                    yield pa.RecordBatch.from_pydict(
                        {
                            "doc": batch.column(0).take(pa.array([p[0] for p in pairs], pa.int64())),
                            "item": pa.array([items.value.ids[p[1]] for p in pairs], pa.int64()),
                            "score": pa.array([p[2] for p in pairs], pa.float64()),
                        }
                    )

        return run

    for block in item_blocks(items, item_col, item_text):
        found = rows.mapInArrow(scan(block), "doc long, item long, score double")
        out = found if out is None else out.unionByName(found)
    return out.select(F.col("doc").alias(id_col), F.col("item").alias("item_id"), "score")


def drop_leaks(
    docs: DataFrame,
    items: DataFrame,
    text_col: str = "text",
    item_col: str = "item_id",
    item_text: str = "text",
    *,
    least: float = 0.5,
) -> DataFrame:
    """The rows of ``docs``, all columns, into whose text no item is copied."""

    def keep(items: Broadcast) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            reader = WordReader(marks=False)
            for batch in batches:
                clean: list[bool] = []
                for _, texts in chunks(batch.column(batch.schema.get_field_index(text_col))):
                    clean += [not own for own in scores(items.value, texts, reader, least)]
                yield batch.filter(pa.array(clean, pa.bool_()))

        return run

    left = docs
    for block in item_blocks(items, item_col, item_text):
        left = left.mapInArrow(keep(block), docs.schema)
    return left

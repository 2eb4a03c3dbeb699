"""Language-model scores from a class-based bigram model (Brown classes found by exchange).

Every word belongs to a class. The probability of a text is the product over its tokens of
the probability of the token's class after the class before, and of the token in its class.
Classes are found by the exchange algorithm: each word moves to the class that raises the
likelihood of the class bigrams most.

What is exchanged are *units*: each of the most frequent words is one, all other words are
units by a checksum of their last three bytes. So every word of the corpus, seen or not,
has a class, while the map from words to classes has a size fixed by parameters. Counts of
words are exact for all words: those of the frequent ones go to every task, in a table of
bounded size, the others are joined.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import repeat
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from flowgauge.llm.words import raw_texts, word_blocks
from flowgauge.runtime import scratch_path

#: Words with a unit of their own at most, units that share the other words, and classes.
OWN_UNITS, SHARED_UNITS, CLASSES = 7_167, 1_024, 64
#: Words whose counts go to every task at most, and the bytes such a word has at most.
FREQUENT, FREQUENT_BYTES = 65_536, 64
ROUNDS = 20
#: Added to the count of each word of a class and to that of an unseen one; weight of the class shares.
WORD_SMOOTHING, CLASS_SMOOTHING = 1.0, 20.0
#: Tokens whose pairs are counted together in a task.
BLOCK_TOKENS = 1 << 21
_LOWER = bytes(b + 32 if 65 <= b <= 90 else 32 if 9 <= b <= 13 else b for b in range(256))
#: Class of the end of a text, which is also what stands before its first word.
END_CLASS = 0


def learnt_from(doc_id: Column, fold: int = 7, held: int = 2) -> Column:
    """Whether a document is learnt from: the checksum of its id does not leave the held remainder."""
    return F.coalesce(F.pmod(F.crc32(doc_id.cast("string").cast("binary")), F.lit(fold)) != held, F.lit(True))


# --- counts ----------------------------------------------------------------------


def word_counts(texts: DataFrame) -> DataFrame:
    """``word, n`` over all rows; counts are combined in each task before they are shuffled."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: Counter[bytes] = Counter()

        def out() -> pa.RecordBatch:
            columns = [pa.array(list(seen), pa.binary()), pa.array(list(seen.values()), pa.int64())]
            return pa.RecordBatch.from_arrays(columns, names=["word", "n"])

        for batch in batches:
            for text in raw_texts(batch.column(0)):
                for words in word_blocks(text, _LOWER):
                    seen.update(words)
                if len(seen) >= BLOCK_TOKENS // 2:
                    yield out()
                    seen.clear()
        yield out()

    return texts.mapInArrow(run, "word binary, n bigint").groupBy("word").agg(F.sum("n").alias("n"))


def frequent_words(counts: DataFrame, limit: int = FREQUENT) -> list[tuple[bytes, int]]:
    """The most frequent words with their counts, in order, ``limit`` at most.

    Words are taken from steps of counts, all of a step or none, so nothing is sorted.
    """
    short = counts.where(F.octet_length("word") <= FREQUENT_BYTES)
    step = F.floor(F.log2("n") * 32).cast("long")
    steps = sorted(short.groupBy(step.alias("step")).count().collect(), reverse=True)
    least, total = None, 0
    for at, n in steps:
        total += n
        if total > limit:
            break
        least = at
    if least is None:
        return []
    found = short.where(step >= least).select("word", "n").collect()
    return sorted(((bytes(w), n) for w, n in found), key=lambda x: (-x[1], x[0]))


class Units:
    """Words to units. Units: own words first, then shared ones, then the end of a text."""

    def __init__(self, words: list[bytes], own: int, shared: int) -> None:
        self.place = {w: i for i, w in enumerate(words)}
        self.own, self.shared = min(own, len(words)), shared
        self.end = self.own + shared
        self.size = self.end + 1

    def shared_unit(self, word: bytes) -> int:
        return self.own + crc32(word[-3:]) % self.shared

    def of(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Place of each word among the frequent ones (-1: not one of them), and its unit."""
        place = np.array(list(map(self.place.get, words, repeat(-1))), dtype=np.int64)
        unit = place.copy()
        for i in np.nonzero((place < 0) | (place >= self.own))[0].tolist():
            unit[i] = self.shared_unit(words[i])
        return place, unit


def unit_pairs(texts: DataFrame, units: Units) -> DataFrame:
    """``unit, right, left``: of each unit the counts of the units after and before it.

    A list has an entry for each unit at most. A task combines its pairs before the shuffle.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] = []
        size = 0

        def out() -> pa.RecordBatch:
            code, n = np.unique(np.concatenate([*held, np.empty(0, np.int64)]), return_counts=True)
            a, b = (pa.array(x.astype(np.int32)) for x in (code // units.size, code % units.size))
            return pa.RecordBatch.from_arrays([a, b, pa.array(n)], names=["a", "b", "n"])

        for batch in batches:
            for text in raw_texts(batch.column(0)):
                last = units.end
                for words in word_blocks(text, _LOWER):
                    unit = np.concatenate([[last], units.of(words)[1]])
                    held.append(unit[:-1] * units.size + unit[1:])
                    size, last = size + len(words), int(unit[-1])
                held.append(np.array([last * units.size + units.end]))
                size += 1
                if size >= BLOCK_TOKENS:
                    yield out()
                    held, size = [], 0
        yield out()

    pairs = texts.mapInArrow(run, "a int, b int, n bigint").groupBy("a", "b").agg(F.sum("n").alias("n"))
    path = scratch_path(texts.sparkSession, "unit-pairs")
    pairs.write.parquet(path)
    pairs = texts.sparkSession.read.schema("a int, b int, n bigint").parquet(path)
    lists = [
        pairs.groupBy(F.col(of).alias("unit")).agg(F.collect_list(F.struct(F.col(other).alias("v"), "n")).alias(name))
        for of, other, name in (("a", "b", "right"), ("b", "a", "left"))
    ]
    return lists[0].join(lists[1], "unit", "full")


# --- exchange --------------------------------------------------------------------


def _plogp(x: np.ndarray) -> np.ndarray:
    return x * np.log(np.maximum(x, 1e-300))


def likelihood(pairs: np.ndarray) -> float:
    """Log likelihood of the class bigrams, up to what does not depend on the classes."""
    return float(_plogp(pairs).sum() - _plogp(pairs.sum(0)).sum() - _plogp(pairs.sum(1)).sum())


def best_moves(
    pairs: np.ndarray, home: np.ndarray, right: np.ndarray, left: np.ndarray, alone: np.ndarray
) -> tuple[np.ndarray, np.ndarray]:
    """For each unit the class it would raise the likelihood most in, and by how much over staying.

    ``pairs`` counts class bigrams; ``home`` is the class of each unit, ``right`` and ``left`` its
    counts with the classes after and before it, ``alone`` those with itself (in both).
    """
    i = np.arange(len(home))
    right, left = right.copy(), left.copy()
    right[i, home] -= alone
    left[i, home] -= alone
    rest = np.repeat(pairs[None], len(home), axis=0)
    rest[i, home, :] -= right
    rest[i, :, home] -= left
    rest[i, home, home] -= alone
    own = np.einsum("ikk->ik", rest)
    # Wherever a unit goes, the units around it keep their own totals.
    rows, cols = rest.sum(2) + left, rest.sum(1) + right
    n_right, n_left = (x.sum(1) + alone for x in (right, left))
    base = _plogp(rest)
    gain = (_plogp(rest + right[:, None, :]) - base).sum(2) + (_plogp(rest + left[:, :, None]) - base).sum(1)
    # The class pair with itself gets the counts of both sides at once.
    gain += _plogp(own + right + left + alone[:, None]) - _plogp(own + right) - _plogp(own + left) + _plogp(own)
    gain -= _plogp(rows + n_right[:, None]) - _plogp(rows) + _plogp(cols + n_left[:, None]) - _plogp(cols)
    gain[:, END_CLASS] = -np.inf
    best = gain.argmax(axis=1)
    return best, gain[i, best] - gain[i, home]


def _few_units(batches: Iterator[pa.RecordBatch], rows: int = 64) -> Iterator[pa.RecordBatch]:
    """Batches of so many units at most, so that their lists stay small as numbers."""
    for batch in batches:
        for at in range(0, batch.num_rows, rows):
            yield batch.slice(at, rows)


def _side(batch: pa.RecordBatch, name: str, classes: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Counts of each row's list by class of the other unit, and with the unit itself."""
    column = batch.column(batch.schema.get_field_index(name))
    unit = batch.column(batch.schema.get_field_index("unit")).to_numpy(zero_copy_only=False)
    lengths = column.value_lengths().fill_null(0).to_numpy(zero_copy_only=False)
    row = np.repeat(np.arange(len(unit)), lengths)
    flat = column.flatten()
    other = flat.field("v").to_numpy(zero_copy_only=False).astype(np.int64)
    n = flat.field("n").to_numpy(zero_copy_only=False).astype(np.float64)
    sums = np.bincount(row * k + classes[other], weights=n, minlength=len(unit) * k).reshape(len(unit), k)
    return sums, np.bincount(row, weights=n * (other == unit[row]), minlength=len(unit))


def _class_pairs(lists: DataFrame, classes: np.ndarray, k: int) -> np.ndarray:
    """Class bigrams under a map of units to classes: one number for each pair of classes from each task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((k, k))
        for batch in _few_units(batches):
            home = classes[batch.column(0).to_numpy(zero_copy_only=False)]
            np.add.at(total, home, _side(batch, "right", classes, k)[0])
        cell = np.nonzero(total.ravel())[0]
        n = pa.array(total.ravel()[cell].astype(np.int64))
        yield pa.RecordBatch.from_arrays([pa.array(cell), n], names=["cell", "n"])

    out = np.zeros(k * k)
    summed = lists.select("unit", "right").mapInArrow(run, "cell bigint, n bigint").groupBy("cell").agg(F.sum("n"))
    for cell, n in summed.collect():
        out[cell] = n
    return out.reshape(k, k)


def _moves(lists: DataFrame, classes: np.ndarray, pairs: np.ndarray, parts: int, part: int) -> list:
    """``unit, best, gain`` of the units of one part that would gain by a move."""
    k = len(pairs)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _few_units(batches):
            unit = batch.column(0).to_numpy(zero_copy_only=False).astype(np.int64)
            home = classes[unit]
            (right, alone), (left, _) = (_side(batch, side, classes, k) for side in ("right", "left"))
            mine = np.nonzero(((unit * 2654435761 >> 7) % parts == part) & (home != END_CLASS))[0]
            best, gain = np.empty(len(mine), np.int64), np.empty(len(mine))
            if len(mine):
                best, gain = best_moves(pairs, home[mine], right[mine], left[mine], alone[mine])
            up = gain > 1e-6
            columns = [pa.array(unit[mine][up]), pa.array(best[up]), pa.array(gain[up])]
            yield pa.RecordBatch.from_arrays(columns, names=["unit", "best", "gain"])

    return lists.mapInArrow(run, "unit bigint, best bigint, gain double").collect()


def exchange(lists: DataFrame, units: Units, k: int = CLASSES, rounds: int = ROUNDS) -> tuple[np.ndarray, np.ndarray]:
    """Classes of all units and their bigrams, by moving a part of the units at once in each round.

    Units are judged in tasks against the class bigrams of the round before. Moves of one round
    do not know each other, so a round that lowers the likelihood is taken back, and one that
    gains little of what its moves promised is followed by rounds of smaller parts.
    """
    classes = 1 + np.arange(units.size) % (k - 1)
    classes[units.end] = END_CLASS
    pairs = _class_pairs(lists, classes, k)
    parts, idle = 2, 0
    for at in range(rounds):
        moves = _moves(lists, classes, pairs, parts, at % parts)
        idle = 0 if moves else idle + 1
        if idle == parts:
            break
        if not moves:
            continue
        new = classes.copy()
        new[[m[0] for m in moves]] = [m[1] for m in moves]
        found = _class_pairs(lists, new, k)
        gained, promised = likelihood(found) - likelihood(pairs), sum(m[2] for m in moves)
        if gained < 0.3 * promised:
            parts *= 2
        if gained > 0:
            classes, pairs = new, found
    return classes, pairs


# --- model -----------------------------------------------------------------------


@dataclass(frozen=True)
class ClassModel:
    """What every task needs: bounded by the parameters of the module."""

    words: list[bytes]
    counts: np.ndarray
    own: int
    shared: int
    classes: np.ndarray
    #: log10 of the class after a class, and of what a class's word counts are divided by.
    transition: np.ndarray
    mass: np.ndarray
    train_tokens: int
    train_words: int
    train_texts: int


def train_class_model(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    *,
    own: int = OWN_UNITS,
    shared: int = SHARED_UNITS,
    k: int = CLASSES,
    frequent: int = FREQUENT,
    rounds: int = ROUNDS,
) -> tuple[ClassModel, DataFrame]:
    """The model, and ``word, n`` of all words it was learnt from.

    Learns from the whole texts of all documents that :func:`learnt_from` names.
    """
    spark = docs.sparkSession
    texts = docs.where(learnt_from(F.col(id_col))).select(F.col(text_col).alias("text"))
    path = scratch_path(spark, "word-counts")
    word_counts(texts).write.parquet(path)
    counts = spark.read.schema("word binary, n bigint").parquet(path)
    top = frequent_words(counts, frequent)
    units = Units([w for w, _ in top], own, shared)
    path = scratch_path(spark, "unit-lists")
    # Units of many pairs come first in no particular order, so small files spread them.
    unit_pairs(texts, units).repartition(64, "unit").write.parquet(path)
    entry = "array<struct<v: int, n: bigint>>"
    lists = spark.read.schema(f"unit int, right {entry}, left {entry}").parquet(path)
    classes, pairs = exchange(lists, units, k, rounds)

    def by_class(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokens, types = np.zeros(k, np.int64), np.zeros(k, np.int64)
        for batch in batches:
            words = batch.column(0).to_pylist()
            home = classes[units.of(words)[1]] if words else np.empty(0, np.int64)
            tokens += np.bincount(home, weights=batch.column(1).to_numpy(zero_copy_only=False), minlength=k).astype(np.int64)
            types += np.bincount(home, minlength=k)
        columns = [pa.array(np.arange(k)), pa.array(tokens), pa.array(types)]
        yield pa.RecordBatch.from_arrays(columns, names=["class", "tokens", "types"])

    tokens, types = np.zeros(k), np.zeros(k)
    shares = counts.mapInArrow(by_class, "class bigint, tokens bigint, types bigint").groupBy("class")
    for at, n, distinct in shares.agg(F.sum("tokens"), F.sum("types")).collect():
        tokens[at], types[at] = n, distinct
    n_texts = int(pairs[:, END_CLASS].sum())
    tokens[END_CLASS], types[END_CLASS] = n_texts, min(n_texts, 1)
    share = (tokens + 1) / (tokens.sum() + k)
    transition = np.log10((pairs + CLASS_SMOOTHING * share) / (pairs.sum(1, keepdims=True) + CLASS_SMOOTHING))
    mass = np.log10(tokens + WORD_SMOOTHING * (types + 1))
    model = ClassModel(
        [w for w, _ in top], np.array([n for _, n in top], dtype=np.int64), units.own, shared, classes, transition, mass,
        int(tokens.sum()), int(types.sum()), n_texts,
    )
    return model, counts


def score_texts(
    docs: DataFrame, model: ClassModel, counts: DataFrame, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """``id, n_tokens, n_known, train_tokens, base_score, score`` of every whole text.

    A text's tokens are its words and one end; NULL and empty texts have only the end. ``score``
    is the log10 probability under the class model, ``base_score`` that under word counts plus
    one. Repeated rows and NULL ids are kept as often as they occur; an empty table gives an
    empty result, and a model learnt from nothing gives every token the same share. Other
    columns are not read.

    Frequent words are scored in the task that reads the text. The others leave it once per text
    with their number, meet their count in a join on the word, which adaptive execution splits
    where a word is hot, and come back combined by count.
    """
    spark = docs.sparkSession
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    kind = dict(rows.dtypes)["id"]
    base_mass = float(np.log10(model.train_tokens + model.train_words + 1))
    # The end of a text is a token as well, as often learnt from as there were texts.
    counts_here = np.append(model.counts, model.train_texts)
    here_base, here_score = np.log10(counts_here + 1.0), np.log10(counts_here + WORD_SMOOTHING)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        units = Units(model.words, model.own, model.shared)
        for batch in batches:
            n_tokens, n_known, base, score = [], [], [], []
            rare, rare_n = [], []
            for text in raw_texts(batch.column(1)):
                tokens, known = 1, int(model.train_texts > 0)
                sums = np.array([here_base[-1], here_score[-1] - model.mass[END_CLASS]])
                others: Counter[bytes] = Counter()
                last = END_CLASS
                for words in word_blocks(text, _LOWER):
                    place, unit = units.of(words)
                    home = model.classes[unit]
                    here = place[place >= 0]
                    before = np.concatenate([[last], home[:-1]])
                    sums += here_base[here].sum(), here_score[here].sum() + (model.transition[before, home] - model.mass[home]).sum()
                    others.update([words[i] for i in np.nonzero(place < 0)[0].tolist()])
                    tokens, known, last = tokens + len(words), known + len(here), int(home[-1])
                n_tokens.append(tokens)
                n_known.append(known)
                base.append(sums[0] - tokens * base_mass)
                score.append(sums[1] + model.transition[last, END_CLASS])
                rare.append(list(others))
                rare_n.append(list(others.values()))
            numbers = [pa.array(x, pa.int64()) for x in (n_tokens, n_known)] + [pa.array(x, pa.float64()) for x in (base, score)]
            lists = [pa.array(rare, pa.list_(pa.binary())), pa.array(rare_n, pa.list_(pa.int64()))]
            names = ["id", "n_tokens", "n_known", "base_score", "score", "rare", "rare_n"]
            yield pa.RecordBatch.from_arrays([batch.column(0), *numbers, *lists], names=names)

    schema = f"id {kind}, n_tokens bigint, n_known bigint, base_score double, score double, rare array<binary>, rare_n array<bigint>"
    path = scratch_path(spark, "class-scores")
    # Rows are numbered once, in what is written; equal rows stay apart by their number.
    rows.mapInArrow(run, schema).withColumn("row", F.monotonically_increasing_id()).write.parquet(path)
    scored = spark.read.schema(f"{schema}, row bigint").parquet(path)
    words = scored.select("row", F.explode(F.arrays_zip("rare", "rare_n")).alias("w"))
    words = words.select("row", F.col("w.rare").alias("word"), F.col("w.rare_n").alias("times"))
    met = words.join(counts, "word", "left").select("row", F.coalesce("n", F.lit(0)).alias("n"), "times")
    met = met.groupBy("row", "n").agg(F.sum("times").alias("times"))
    more = met.select(
        "row",
        F.when(F.col("n") > 0, F.col("times")).otherwise(0).alias("n_known"),
        (F.col("times") * F.log10(F.col("n") + 1.0)).alias("base_score"),
        (F.col("times") * F.log10(F.col("n") + F.lit(WORD_SMOOTHING))).alias("score"),
    )
    numbers = ["n_known", "base_score", "score"]
    own = scored.select("row", "id", "n_tokens", *numbers)
    none = [F.lit(None).cast(kind).alias("id"), F.lit(None).cast("bigint").alias("n_tokens")]
    summed = own.unionByName(more.select("row", *none, *numbers)).groupBy("row")
    summed = summed.agg(F.max("id").alias("id"), F.max("n_tokens").alias("n_tokens"), *[F.sum(c).alias(c) for c in numbers])
    return summed.select(
        F.col("id").alias(id_col),
        "n_tokens",
        "n_known",
        F.lit(model.train_tokens).cast("bigint").alias("train_tokens"),
        "base_score",
        "score",
    )

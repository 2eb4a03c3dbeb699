"""Class-based language model against plain Python."""

import math
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from flowgauge.llm import classes
from flowgauge.llm.queries import QUERIES
from tests.llm.plain import words

SCHEMA = "doc_id bigint, text string"


def held(i):
    return i is not None and zlib.crc32(str(i).encode()) % 7 == 2


def plain(docs, model):
    """``(id, n_tokens, n_known, N, base, score)`` token by token, classes taken from the model."""
    counts, n_texts = Counter(), 0
    for i, t in docs:
        if not held(i):
            counts.update(words(t))
            n_texts += 1
    total, types = sum(counts.values()) + n_texts, len(counts) + (n_texts > 0)
    own = {w.decode(): k for k, w in enumerate(model.words[: model.own])}

    def home(w):
        return int(model.classes[own[w] if w in own else model.own + zlib.crc32(w.encode()[-3:]) % model.shared])

    size, kinds, pairs = Counter(), Counter(), Counter()
    for w, n in counts.items():
        size[home(w)] += n
        kinds[home(w)] += 1
    size[0], kinds[0] = n_texts, int(n_texts > 0)
    for i, t in docs:
        if not held(i):
            path = [0, *map(home, words(t)), 0]
            pairs.update(zip(path, path[1:]))
    after = Counter()
    for (a, _), n in pairs.items():
        after[a] += n
    k = len(model.transition)
    out = []
    for i, t in docs:
        path, seen = [0, *map(home, words(t)), 0], [*(counts[w] for w in words(t)), n_texts]
        base = sum(math.log10((c + 1) / (total + types + 1)) for c in seen)
        score = 0.0
        for a, b, c in zip(path[:-1], path[1:], seen, strict=True):
            share = (size[b] + 1) / (total + k)
            score += math.log10((pairs[a, b] + 20 * share) / (after[a] + 20)) + math.log10((c + 1) / (size[b] + kinds[b] + 1))
        out.append((i, len(seen), sum(c > 0 for c in seen), total, base, score))
    return out


def same(rows, expected):
    def order(r):
        return (r[0] is None, r[0] or 0, *r[1:])

    rows, expected = sorted(map(tuple, rows), key=order), sorted(expected, key=order)
    assert [r[:4] for r in rows] == [r[:4] for r in expected]
    assert np.allclose([r[4:] for r in rows], [r[4:] for r in expected], rtol=1e-9)


def test_query_equals_plain_version(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    model, counts = classes.train_class_model(docs, rounds=6)
    found = classes.score_texts(docs, model, counts).collect()
    same(found, plain([tuple(r) for r in docs.collect()], model))
    rows = QUERIES["op12_class_lm"](spark, sf_dir).collect()
    assert {(r["doc_id"], r["n_known"], r["held_out"]) for r in rows} == {(r[0], r[2], held(r[0])) for r in found}
    # Classes know more about the next word than its count alone.
    unseen = [r for r in rows if r["held_out"] and r["n_tokens"] > 20]
    assert np.mean([(r["score"] - r["base_score"]) / r["n_tokens"] for r in unseen]) > 0.1


def test_few_frequent_words_and_rare_ones_give_the_same(spark):
    rows = [(i, " ".join(f"w{(i * k) % 23}" for k in range(1, 30))) for i in range(40)]
    rows += [(40, None), (41, ""), (41, ""), (None, "w1 W2 only-here"), (43, "w1\tw2\x0bw3 w4 " + "x" * 500)]
    docs = spark.createDataFrame(rows, SCHEMA).withColumn("score", F.lit(1)).withColumn("word", F.lit("a"))
    for frequent, own in ((0, 10), (5, 3), (100, 7), (100, 100)):
        model, counts = classes.train_class_model(docs, own=own, shared=4, k=5, frequent=frequent, rounds=4)
        same(classes.score_texts(docs, model, counts).collect(), plain(rows, model))


def test_long_texts_go_block_by_block(spark, monkeypatch):
    rows = [(1, "one two three four " * 30_000), (2, "three two one " * 5)]
    docs = spark.createDataFrame(rows, SCHEMA)
    model, counts = classes.train_class_model(docs, own=2, shared=3, k=4, frequent=3, rounds=2)
    same(classes.score_texts(docs, model, counts).collect(), plain(rows, model))


def test_nothing_to_learn_from(spark):
    outside = next(i for i in range(100) if held(i))
    docs = spark.createDataFrame([(outside, "a b")], SCHEMA)
    model, counts = classes.train_class_model(docs, rounds=1)
    row = classes.score_texts(docs, model, counts).first()
    assert (row["n_tokens"], row["n_known"], row["train_tokens"], row["base_score"]) == (3, 0, 0, 0.0)
    assert row["score"] == pytest.approx(3 * math.log10(1 / 64))
    none = spark.createDataFrame([], SCHEMA)
    assert classes.score_texts(none, *classes.train_class_model(none, rounds=1)).count() == 0


def test_probabilities_sum_to_one(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    model, counts = classes.train_class_model(docs, rounds=2)
    assert np.allclose((10**model.transition).sum(1), 1)
    units = classes.Units(model.words, model.own, model.shared)
    found = [(bytes(w), n) for w, n in counts.collect()]
    home = model.classes[units.of([w for w, _ in found])[1]]
    words_mass = np.bincount(home, weights=[n + 1 for _, n in found], minlength=64) + 1
    assert np.allclose(words_mass[1:], 10 ** model.mass[1:])


def test_gain_of_a_move_is_the_change_of_likelihood():
    rng = np.random.default_rng(3)
    size, k = 12, 4
    n = rng.integers(0, 9, (size, size)).astype(float)
    home = 1 + np.arange(size) % (k - 1)

    def grouped(of):
        hot = np.eye(k)[of]
        return hot.T @ n @ hot

    right, left = n @ np.eye(k)[home], n.T @ np.eye(k)[home]
    best, gain = classes.best_moves(grouped(home), home, right, left, np.diag(n).copy())
    for u in range(size):
        changes = []
        for to in range(1, k):
            moved = home.copy()
            moved[u] = to
            changes.append(classes.likelihood(grouped(moved)) - classes.likelihood(grouped(home)))
        assert gain[u] == pytest.approx(max(changes), abs=1e-9) and changes[best[u] - 1] == pytest.approx(max(changes))


def test_exchange_parts_two_languages(spark):
    left, right = [f"a{i}" for i in range(30)], [f"b{i}" for i in range(30)]
    rng = np.random.default_rng(5)
    texts = [" ".join(rng.choice(left if i % 2 else right, 40)) for i in range(200)]
    docs = spark.createDataFrame(list(enumerate(texts)), SCHEMA)
    model, _ = classes.train_class_model(docs, own=60, shared=1, k=3, rounds=12)
    side = [(re.sub(r"\d", "", w.decode()), int(model.classes[i])) for i, w in enumerate(model.words)]
    assert len(set(side)) == 2

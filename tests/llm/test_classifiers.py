"""Language identification and toxicity: held-out accuracy, gradients and odd rows."""

import random
import zlib

import numpy as np
import pytest

from flowgauge.llm import language, queries, toxicity
from flowgauge.llm.chars import letter_table, letters

PARTS = {"en": ["the", "th", "ing", "er", "wh"], "fr": ["é", "que", "eau", "oi", "le"], "de": ["sch", "ung", "ü", "keit", "der"]}


def _texts(n, seed=3):
    rng = random.Random(seed)
    out = []
    for i in range(n):
        lang = rng.choice(sorted(PARTS))
        words = ["".join(rng.choices(PARTS[lang], k=rng.randint(1, 3))) for _ in range(rng.randint(5, 60))]
        out.append((i, lang, words))
    return out


@pytest.fixture(scope="module")
def labelled(spark):
    rows = [(i, " ".join(w), lang) for i, lang, w in _texts(400)]
    rows += [(1000, "the thing", None), (1001, None, "en"), (None, "queleau", "fr")]
    return rows, spark.createDataFrame(rows, "doc_id long, text string, lang string")


def test_language_of_texts_never_seen(spark, labelled):
    rows, df = labelled
    model = language.train_language_model(df)
    got = {r["doc_id"]: r for r in language.predict_language(df, model).collect()}
    held = [i for i, _, _ in rows if i is not None and i < 1000 and zlib.crc32(str(i).encode()) % 5 == 0]
    assert len(held) > 50
    assert sum(got[i]["lang_pred"] == rows[i][2] for i in held) >= 0.98 * len(held)
    assert all(0 <= r["score"] <= 1 for r in got.values())
    assert (model.weights == 0).mean() > 0.5  # elastic net leaves most weights at zero


def test_language_odd_rows(spark, labelled):
    model = language.train_language_model(labelled[1])
    rows = [(1, None, 0), (2, "", 0), (3, "12 ... \n", 0), (4, "ing the " * 100_000, 0), (None, "𝐭𝐡𝐞 the", 0), (4, "the", 0)]
    df = spark.createDataFrame(rows, "doc_id long, text string, score int")
    got = [(r["doc_id"], r["lang_pred"], r["score"]) for r in language.predict_language(df, model).collect()]
    assert [g[1:] for g in got[:3]] == [("und", 0.0)] * 3 and [g[1] for g in got[3:]] == ["en"] * 3
    assert language.predict_language(df.limit(0), model).count() == 0
    none = language.train_language_model(labelled[1].limit(0))
    assert none is None and {r["lang_pred"] for r in language.predict_language(df, none).collect()} == {"und"}


def test_language_batch_matches_single_texts(labelled):
    table = letter_table()
    rng = np.random.default_rng(1)
    weights = np.vstack([rng.normal(size=(1 << language.SLOT_BITS, 2)), np.zeros(2)])
    model = language.LanguageModel(["a", "b"], weights, np.zeros(2), 1.0)
    texts = ["", "a", "Ab c", "no. 1 été", "x" * 50, " "]
    whole, _ = model.logits(texts, table)
    ones = np.ones(1 << language.SLOT_BITS)
    for text, z in zip(texts, whole, strict=True):
        used, values = language.features(text, ones, table)
        assert z == pytest.approx(values @ weights[used] if len(used) else np.zeros(2))


def test_letters_keep_texts_apart():
    codes = letters(["Ab, c", "", "É1"], letter_table())
    assert codes.tolist() == [97, 98, 0, 99, 1, 1, 233, 0, 1]


def test_network_gradients():
    net = toxicity.Network.start(1)
    net.p = {k: v.astype(np.float64) for k, v in net.p.items()}
    words = toxicity.read_words(["one two three four", "b " * 40, ""], letter_table())

    def loss():
        return (net.forward(net.inputs(words).astype(np.float64), words.windows) ** 2).sum() / 2

    memory, vectors = {}, net.inputs(words).astype(np.float64)
    grads = net.gradients(words, vectors, words.windows, memory, net.forward(vectors, words.windows, memory))
    for name in ("Uf", "Ub", "Wf", "Wb", "cf", "cb", "A", "v", "o", "b"):
        at = np.unravel_index(1 % net.p[name].size, net.p[name].shape)
        step, keep = 1e-3, net.p[name][at]
        net.p[name][at] = keep + step
        up = loss()
        net.p[name][at] = keep - step
        down = loss()
        net.p[name][at] = keep
        assert grads[name][at] == pytest.approx((up - down) / (2 * step), rel=1e-2, abs=1e-5)


def test_windows_cover_every_word():
    for n in (0, 1, 31, 32, 33, 56, 57, 200):
        words = toxicity.read_words([" ".join("w" + "x" * i for i in range(n))], letter_table())
        seen = set(words.windows.ravel().tolist()) - {-1}
        assert len(seen) == n and (words.text_of == 0).all()


def test_toxicity_of_texts_never_seen(spark):
    rng = random.Random(2)
    rows, labels = [], []
    for i, _, words in _texts(600):
        toxic = int(rng.random() < 0.4)
        for _ in range(3 * toxic):
            words.insert(rng.randint(0, len(words)), rng.choice(["idiot", "scum", "zoxx" + rng.choice("abc")]))
        rows.append((i, " ".join(words), 1))
        labels.append((i, toxic, 0))
    labels += [(None, 1, 0), (3, None, 0), (999_999, 1, 0)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, label int")
    marks = spark.createDataFrame(labels, "doc_id long, toxic int, text int")
    net = toxicity.train_toxicity_model(docs, marks)
    got = {r["doc_id"]: r["score"] for r in toxicity.score_toxicity(docs, net).collect()}
    held = [i for i in range(600) if zlib.crc32(str(i).encode()) % 5 == 0]
    right = sum((got[i] >= 0.5) == bool(labels[i][1]) for i in held)
    assert right >= 0.97 * len(held)
    odd = spark.createDataFrame([(1, None), (1, ""), (2, "fine " * 50_000 + "idiot scum"), (None, "1")], "doc_id long, text string")
    scores = [r["score"] for r in toxicity.score_toxicity(odd, net).collect()]
    assert scores[0] == scores[1] < 0.5 < scores[2]
    kept = toxicity.reject_toxic(docs, net)
    assert kept.columns == docs.columns
    assert {r["doc_id"] for r in kept.collect()} == {i for i, s in got.items() if s < 0.5}
    untaught = toxicity.train_toxicity_model(docs, marks.limit(0))
    assert toxicity.reject_toxic(docs, untaught).count() == len(rows)


def test_queries_keep_the_contract(spark, sf_dir):
    for name, more in (("op1_language_id", {"lang_pred"}), ("op7_toxicity", {"predicted"})):
        got = queries.QUERIES[name](spark, sf_dir).collect()
        assert len(got) == spark.read.parquet(f"{sf_dir}/documents.parquet").count()
        assert {"doc_id", "held_out", "score", *more} == set(got[0].asDict())
        assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0) for r in got)


def test_sample_of_a_hot_id_is_bounded(spark):
    """A third of the rows on one id, or without one, do not reach the driver together; repeated rows count once."""
    from flowgauge.llm.common import labelled_sample

    rows = spark.range(30_000).selectExpr(
        "CASE WHEN id % 3 = 0 THEN 7 WHEN id % 3 = 1 THEN NULL ELSE id END AS doc_id", "concat('text ', id div 2) AS text", "id % 2 AS label"
    )
    found = labelled_sample(rows, "doc_id", "label", 1000)
    assert 1600 <= len(found) <= 2400 and len({tuple(r) for r in found}) == len(found)
    same = spark.range(20_000).selectExpr("1 AS doc_id", "'one' AS text", "0 AS label")
    assert len(labelled_sample(same, "doc_id", "label", 1000)) == 1

"""Language identification by sparse multinomial logistic regression.

Features are TF-IDF values of hashed character n-grams. The weights come from
follow-the-regularised-leader steps with elastic-net penalties, and a temperature
fitted on rows the weights have not seen makes the probabilities honest.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from flowgauge.llm.chars import END, GAP, chunks, letter_table, letters, ngram_hashes
from flowgauge.llm.common import held_out, labelled_sample

NGRAMS = (1, 2, 3)
SLOT_BITS = 16
UNKNOWN = "und"


def slots(codes: np.ndarray, n: int) -> np.ndarray:
    """Slot of the n-gram from each place; one past the last slot where a text ends within it."""
    found = (ngram_hashes(codes, n) & np.uint64((1 << SLOT_BITS) - 1)).astype(np.int64)
    end = codes == END
    for k in range(n):
        found[end[k : k + len(found)]] = 1 << SLOT_BITS
    return found


def _document_counts(table: np.ndarray) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros(1 << SLOT_BITS, dtype=np.int64)
        texts_seen = 0
        for batch in batches:
            for _, texts in chunks(batch.column(0)):
                codes = letters(texts, table)
                ends = np.nonzero(codes == END)[0]
                begins = np.concatenate([[0], ends[:-1] + 1])
                found = [slots(codes, n) for n in NGRAMS]
                for a, b in zip(begins, ends, strict=True):
                    seen = np.zeros((1 << SLOT_BITS) + 1, dtype=bool)
                    for f in found:
                        seen[f[a:b]] = True
                    counts += seen[:-1]
                texts_seen += len(texts)
        used = np.nonzero(counts)[0]
        yield pa.RecordBatch.from_pydict(
            {
                "slot": pa.array(np.append(used, -1), pa.int32()),
                "n": pa.array(np.append(counts[used], texts_seen), pa.int64()),
            }
        )

    return run


def inverse_frequencies(texts: DataFrame, text_col: str = "text") -> np.ndarray:
    """IDF of every slot over all ``texts``; one row per slot reaches the driver, whatever the table."""
    rows = (
        texts.select(text_col)
        .mapInArrow(_document_counts(letter_table()), "slot int, n long")
        .groupBy("slot")
        .agg(F.sum("n").alias("n"))
        .collect()
    )
    seen = np.zeros(1 << SLOT_BITS)
    total = 0
    for r in rows:
        if r["slot"] < 0:
            total = r["n"]
        else:
            seen[r["slot"]] = r["n"]
    return np.log((1.0 + total) / (1.0 + seen)) + 1.0


@dataclass
class LanguageModel:
    languages: list[str]
    weights: np.ndarray  # (slots + 1, languages), IDF included; the last row is zero
    bias: np.ndarray
    temperature: float

    def logits(self, texts: list[str], table: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Scores per text and language, and the number of letters of each text."""
        codes = letters(texts, table)
        ends = np.nonzero(codes == END)[0]
        begins = np.concatenate([[0], ends[:-1] + 1])
        total = np.zeros((len(texts), len(self.languages)))
        n = np.zeros(len(texts))
        for size in NGRAMS:
            found = slots(codes, size)
            if not len(found):
                continue
            own = begins[begins < len(found)]
            total[: len(own)] += np.add.reduceat(self.weights[found], own, axis=0)
            n[: len(own)] += np.add.reduceat(found < (1 << SLOT_BITS), own, dtype=np.int64)
        is_letter = np.add.reduceat((codes != GAP) & (codes != END), begins, dtype=np.int64)
        return SCALE * total / np.maximum(n, 1)[:, None] + self.bias, is_letter


#: Features are shares of a text times IDF; the scale brings their length near one.
SCALE = 30.0


def features(text: str, idf: np.ndarray, table: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    codes = letters([text], table)
    found = np.concatenate([slots(codes, n) for n in NGRAMS])
    found = found[found < (1 << SLOT_BITS)]
    used, counts = np.unique(found, return_counts=True)
    return used, SCALE * counts / max(1, len(found)) * idf[used]


def _softmax(z: np.ndarray) -> np.ndarray:
    e = np.exp(z - z.max(axis=-1, keepdims=True))
    return e / e.sum(axis=-1, keepdims=True)


def train_ftrl(
    rows: list[tuple[np.ndarray, np.ndarray, int]],
    n_classes: int,
    *,
    alpha: float = 0.3,
    beta: float = 1.0,
    l1: float = 0.002,
    l2: float = 0.01,
    epochs: int = 4,
    seed: int = 7,
) -> tuple[np.ndarray, np.ndarray]:
    """Weights and bias. Each step keeps the sum of gradients ``z`` and of squares ``n`` per weight;
    a weight is zero while ``|z|`` stays within ``l1`` and else follows in closed form."""
    width = 1 << SLOT_BITS
    z, n = np.zeros((width + 1, n_classes)), np.zeros((width + 1, n_classes))

    def current(at: np.ndarray) -> np.ndarray:
        za = z[at]
        pull = np.maximum(np.abs(za) - l1, 0.0)
        return -np.sign(za) * pull / ((beta + np.sqrt(n[at])) / alpha + l2)

    rng = np.random.default_rng(seed)
    for _ in range(epochs):
        for i in rng.permutation(len(rows)):
            used, values, label = rows[i]
            at = np.append(used, width)  # the last row is the bias
            x = np.append(values, 1.0)
            w = current(at)
            p = _softmax(x @ w)
            p[label] -= 1.0
            g = x[:, None] * p
            step = (np.sqrt(n[at] + g * g) - np.sqrt(n[at])) / alpha
            z[at] += g - step * w
            n[at] += g * g
    w = current(np.arange(width + 1))
    return w[:-1], w[-1]


def fit_temperature(logits: np.ndarray, labels: np.ndarray) -> float:
    """The temperature of least cross-entropy, by golden-section search on its logarithm."""
    if not len(labels):
        return 1.0

    def loss(t: float) -> float:
        p = _softmax(logits / np.exp(t))
        return float(-np.log(np.maximum(p[np.arange(len(labels)), labels], 1e-12)).mean())

    low, high, ratio = -3.0, 3.0, (5**0.5 - 1) / 2
    for _ in range(40):
        a, b = high - ratio * (high - low), low + ratio * (high - low)
        if loss(a) < loss(b):
            high = b
        else:
            low = a
    return float(np.exp((low + high) / 2))


def train_language_model(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    lang_col: str = "lang",
    *,
    per_language: int = 1000,
) -> LanguageModel | None:
    """Learns from documents that are not held out and have a language; None if there is none.

    IDF counts every such document. Weights are fitted on about ``per_language``
    documents of each language, the temperature on a fifth of them set aside.
    """
    learn = docs.where(~held_out(F.col(id_col)) & F.col(lang_col).isNotNull()).select(
        F.col(id_col).alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"), F.col(lang_col).alias("lang")
    )
    sample = labelled_sample(learn, "id", "lang", per_language)
    if not sample:
        return None
    idf, table = inverse_frequencies(learn), letter_table()
    languages = sorted({r["lang"] for r in sample})
    rows = [(*features(r["text"], idf, table), languages.index(r["lang"])) for r in sample]
    rows = [r for r in rows if len(r[0])]
    aside = [r for i, r in enumerate(rows) if i % 5 == 0]
    weights, bias = train_ftrl([r for i, r in enumerate(rows) if i % 5], len(languages))
    logits = np.array([v @ weights[u] + bias for u, v, _ in aside]).reshape(len(aside), len(languages))
    temperature = fit_temperature(logits, np.array([y for _, _, y in aside], dtype=int))
    scaled = np.vstack([weights * idf[:, None], np.zeros(len(languages))])
    return LanguageModel(languages, scaled, bias, temperature)


def _predictor(model: LanguageModel, table: np.ndarray) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lang, score = [], []
            for _, texts in chunks(batch.column(batch.num_columns - 1)):
                logits, n_letters = model.logits(texts, table)
                p = _softmax(logits / model.temperature)
                best = p.argmax(axis=1)
                known = n_letters > 0
                lang += [model.languages[b] if k else UNKNOWN for b, k in zip(best, known, strict=True)]
                score.append(np.where(known, p[np.arange(len(best)), best], 0.0))
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[:-1], pa.array(lang, pa.string()), pa.array(np.concatenate(score or [[]]), pa.float64())],
                names=[*batch.schema.names[:-1], "lang_pred", "score"],
            )

    return run


def predict_language(docs: DataFrame, model: LanguageModel | None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``id, lang_pred, score`` of every whole text. NULL texts and texts without a letter are
    ``und`` with score 0, as is everything when there is no model. Repeated rows are kept."""
    rows = docs.select(F.col(id_col), F.col(text_col).alias("__text"))
    if model is None:
        return rows.select(id_col, F.lit(UNKNOWN).alias("lang_pred"), F.lit(0.0).alias("score"))
    kind = dict(rows.dtypes)[id_col]
    return rows.mapInArrow(_predictor(model, letter_table()), f"`{id_col}` {kind}, lang_pred string, score double")

"""Toxicity by a bidirectional gated recurrent network with attention pooling.

A word enters as the sum of an embedding of the word and the mean of embeddings of its
character n-grams. A forward and a backward recurrence read a window of words, attention
pools their states, and a logistic output scores the window. All overlapping windows of a
text are scored; the text's score follows from its worst window.

Training is plain numpy on a bounded sample: labels mark whole texts, so a text counts as
toxic if at least one of its windows does (noisy-or over windows).
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from flowgauge.llm.chars import END, GAP, chunks, letter_table, letters, mix
from flowgauge.llm.common import held_out, labelled_sample

WINDOW, STRIDE = 32, 24
WORD_SLOTS, NGRAM_SLOTS = 1 << 14, 1 << 14
DIM, HIDDEN = 12, 8
NGRAM_SIZES = (3, 4)
#: Windows that go through the recurrence at once.
BATCH = 4096
_BASE = np.uint64(0x9E3779B97F4A7C15)


@dataclass
class Words:
    """Texts as windows over distinct words."""

    word_slot: np.ndarray  # of each distinct word
    ngram_slot: np.ndarray  # n-grams of the distinct words, one word after the other
    ngram_begin: np.ndarray
    windows: np.ndarray  # (windows, WINDOW): place of the distinct word, or -1
    text_of: np.ndarray  # text of each window


def read_words(texts: list[str], table: np.ndarray) -> Words:
    """Words are runs of letters. A text without a word has one empty window."""
    codes = letters(texts, table)
    inside = codes > END
    edges = np.diff(np.concatenate([[False], inside, [False]]).astype(np.int8))
    begin, end = np.nonzero(edges == 1)[0], np.nonzero(edges == -1)[0]
    text_at = np.cumsum(codes == END)
    owner = text_at[begin] if len(begin) else np.zeros(0, dtype=np.int64)
    # A word's hash is a polynomial in its letters; the position is divided out by the
    # running power at its begin, which is odd and so has an inverse.
    letters64 = mix(codes.astype(np.uint64))
    power = np.multiply.accumulate(np.full(len(codes) + 1, _BASE, dtype=np.uint64)) if len(codes) else np.zeros(1, np.uint64)
    inverse = np.multiply.accumulate(np.full(len(codes) + 1, np.uint64(pow(int(_BASE), -1, 1 << 64)), dtype=np.uint64))
    total = np.concatenate([[np.uint64(0)], np.add.accumulate(letters64 * power[: len(codes)])])
    hashes = mix((total[end] - total[begin]) * inverse[begin])
    _, first, place = np.unique(hashes, return_index=True, return_inverse=True)
    word_slot = (hashes[first] % np.uint64(WORD_SLOTS)).astype(np.int64)
    # n-grams of the distinct words, with the gaps around a word as its marks
    own_begin, own_end = begin[first] - 1, end[first] + 1
    marked = np.where(inside, codes, GAP).astype(np.uint64)
    marked = np.concatenate([[np.uint64(0)], marked, [np.uint64(0)]])
    parts, sizes = [], []
    for n in NGRAM_SIZES:
        count = np.maximum(own_end - own_begin - n + 1, 1)
        at = np.repeat(own_begin - (np.cumsum(count) - count), count) + np.arange(count.sum()) + 1
        h = np.full(len(at), n, dtype=np.uint64)
        for k in range(n):
            h = (h + marked[np.minimum(at + k, len(marked) - 1)]) * _BASE
            h ^= h >> np.uint64(31)
        parts.append((mix(h) % np.uint64(NGRAM_SLOTS)).astype(np.int64))
        sizes.append(count)
    n_words = len(first)
    counts = np.sum(sizes, axis=0) if n_words else np.zeros(0, dtype=np.int64)
    slots = np.concatenate(parts)[np.argsort(np.concatenate([np.repeat(np.arange(n_words), c) for c in sizes]), kind="stable")]
    # windows: every STRIDE words from the start of the text, until one reaches its end
    per_text = np.bincount(owner, minlength=len(texts))
    n_windows = np.where(per_text <= WINDOW, 1, -(-(per_text - WINDOW) // STRIDE) + 1)
    text_of = np.repeat(np.arange(len(texts)), n_windows)
    nth = np.arange(n_windows.sum()) - np.repeat(np.cumsum(n_windows) - n_windows, n_windows)
    offset = nth[:, None] * STRIDE + np.arange(WINDOW)
    inside_text = offset < per_text[text_of][:, None]
    where = (np.cumsum(per_text) - per_text)[text_of][:, None] + offset
    windows = np.where(inside_text, np.append(place, -1)[np.where(inside_text, where, -1)], -1)
    return Words(word_slot, slots, np.cumsum(counts) - counts, windows, text_of)


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1.0 / (1.0 + np.exp(-x))


def _row_sums(at: np.ndarray, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The distinct values of ``at`` in order, and the sum of the rows of each."""
    order = np.argsort(at, kind="stable")
    at = at[order]
    begin = np.nonzero(np.append(True, at[1:] != at[:-1]))[0] if len(at) else np.zeros(0, dtype=np.int64)
    return at[begin], np.add.reduceat(rows[order], begin, axis=0) if len(at) else rows[:0]


@dataclass
class Network:
    """Weights, and the slope and offset that turn the worst window's output into a score."""

    p: dict[str, np.ndarray] = field(default_factory=dict)
    slope: float = 1.0
    offset: float = 0.0

    @staticmethod
    def start(seed: int) -> Network:
        rng = np.random.default_rng(seed)

        def some(*shape: int, scale: float) -> np.ndarray:
            return rng.normal(0, scale, shape).astype(np.float32)

        p = {"word": some(WORD_SLOTS, DIM, scale=0.1), "ngram": some(NGRAM_SLOTS, DIM, scale=0.3)}
        for d in "fb":
            p[f"W{d}"] = some(DIM, 3 * HIDDEN, scale=0.5)
            p[f"U{d}"] = some(HIDDEN, 3 * HIDDEN, scale=0.25)
            p[f"c{d}"] = np.zeros(3 * HIDDEN, dtype=np.float32)
        p |= {"A": some(2 * HIDDEN, HIDDEN, scale=0.4), "v": some(HIDDEN, scale=0.4)}
        p |= {"o": some(2 * HIDDEN, scale=0.4), "b": np.full(1, -3.0, dtype=np.float32)}
        return Network(p)

    def inputs(self, words: Words) -> np.ndarray:
        """Input vector of each distinct word; the last row is the empty place."""
        p = self.p
        out = np.zeros((len(words.word_slot) + 1, DIM), dtype=np.float32)
        if len(words.word_slot):
            n = np.diff(np.append(words.ngram_begin, len(words.ngram_slot)))
            grams = np.add.reduceat(p["ngram"][words.ngram_slot], words.ngram_begin, axis=0)
            out[:-1] = p["word"][words.word_slot] + grams / n[:, None]
        return out

    def _direction(self, d: str, projected: np.ndarray, windows: np.ndarray, keep: list | None) -> np.ndarray:
        u = self.p[f"U{d}"]
        h = np.zeros((len(windows), HIDDEN), dtype=np.float32)
        out = np.empty((len(windows), WINDOW, HIDDEN), dtype=np.float32)
        for t in range(WINDOW) if d == "f" else range(WINDOW - 1, -1, -1):
            x = projected[windows[:, t]]
            r = h @ u
            gates = _sigmoid(x[:, : 2 * HIDDEN] + r[:, : 2 * HIDDEN])
            z, s = gates[:, :HIDDEN], gates[:, HIDDEN:]
            new = np.tanh(x[:, 2 * HIDDEN :] + s * r[:, 2 * HIDDEN :])
            here = (windows[:, t] >= 0)[:, None]
            if keep is not None:
                keep.append((t, h, z, s, new, r[:, 2 * HIDDEN :], here))
            h = np.where(here, z * h + (1 - z) * new, h)
            out[:, t] = h
        return out

    def forward(self, vectors: np.ndarray, windows: np.ndarray, memory: dict | None = None) -> np.ndarray:
        """Output of every window before the logistic step."""
        p = self.p
        kept = {"f": [], "b": []} if memory is not None else {"f": None, "b": None}
        states = np.concatenate(
            [self._direction(d, vectors @ p[f"W{d}"] + p[f"c{d}"], windows, kept[d]) for d in "fb"], axis=2
        )
        hidden = np.tanh(states @ p["A"])
        weight = hidden @ p["v"]
        here = windows >= 0
        weight = np.where(here, weight, np.float32(-30))
        weight = np.exp(weight - weight.max(axis=1, keepdims=True))
        weight /= weight.sum(axis=1, keepdims=True)
        context = np.einsum("bt,bth->bh", weight, states)
        if memory is not None:
            memory |= {"kept": kept, "states": states, "hidden": hidden, "weight": weight, "context": context}
        return context @ p["o"] + p["b"]

    def gradients(self, words: Words, vectors: np.ndarray, windows: np.ndarray, memory: dict, dout: np.ndarray) -> dict:
        """Gradients of all weights for the gradient ``dout`` of each window's output."""
        p, g = self.p, {}
        states, hidden, weight = memory["states"], memory["hidden"], memory["weight"]
        g["o"], g["b"] = memory["context"].T @ dout, dout.sum(keepdims=True)
        dcontext = dout[:, None] * p["o"]
        dstates = weight[:, :, None] * dcontext[:, None, :]
        dweight = np.einsum("bh,bth->bt", dcontext, states)
        dweight = weight * (dweight - (weight * dweight).sum(axis=1, keepdims=True))
        g["v"] = np.einsum("bt,bth->h", dweight, hidden)
        dhidden = dweight[:, :, None] * p["v"] * (1 - hidden**2)
        g["A"] = np.einsum("bti,bth->ih", states, dhidden)
        dstates += dhidden @ p["A"].T
        dvectors = np.zeros_like(vectors)
        for k, d in enumerate("fb"):
            u, w = p[f"U{d}"], p[f"W{d}"]
            dinputs = np.zeros((*windows.shape, 3 * HIDDEN), dtype=np.float32)
            du = np.zeros_like(u)
            dh = np.zeros((len(windows), HIDDEN), dtype=np.float32)
            for t, h, z, s, new, r, here in reversed(memory["kept"][d]):
                dh = dh + dstates[:, t, k * HIDDEN : (k + 1) * HIDDEN]
                live = np.where(here, dh, 0)
                dnew = live * (1 - z) * (1 - new**2)
                dz = live * (h - new) * z * (1 - z)
                ds = dnew * r * s * (1 - s)
                drec = np.concatenate([dz, ds, dnew * s], axis=1)
                dx = np.concatenate([dz, ds, dnew], axis=1)
                du += h.T @ drec
                dinputs[:, t] = dx
                dh = np.where(here, live * z, dh) + drec @ u.T
            dprojected = np.zeros((len(vectors), 3 * HIDDEN), dtype=np.float32)
            at, sums = _row_sums(windows.ravel(), dinputs.reshape(-1, 3 * HIDDEN))
            dprojected[at] = sums
            dprojected[-1] = 0
            g[f"U{d}"], g[f"c{d}"], g[f"W{d}"] = du, dprojected.sum(axis=0), vectors.T @ dprojected
            dvectors += dprojected @ w.T
        dvectors = dvectors[:-1]
        n = np.diff(np.append(words.ngram_begin, len(words.ngram_slot)))
        g["word"] = (words.word_slot, dvectors)
        g["ngram"] = (words.ngram_slot, np.repeat(dvectors / n[:, None], n, axis=0))
        return g

    def outputs(self, words: Words) -> np.ndarray:
        vectors = self.inputs(words)
        return np.concatenate(
            [self.forward(vectors, words.windows[i : i + BATCH]) for i in range(0, len(words.windows), BATCH)]
        )

    def worst(self, words: Words, n_texts: int) -> np.ndarray:
        """Largest window output of each text."""
        top = np.full(n_texts, -np.inf)
        np.maximum.at(top, words.text_of, self.outputs(words).astype(np.float64))
        return top


def train(
    texts: list[str], labels: np.ndarray, table: np.ndarray, *, epochs: int = 4, rate: float = 0.02, batch: int = 24, seed: int = 5
) -> Network:
    """Adam steps on batches of whole texts, half of each label; then slope and offset of the score."""
    net = Network.start(seed)
    rng = np.random.default_rng(seed)
    first = {k: np.zeros_like(v) for k, v in net.p.items()}
    second = {k: np.zeros_like(v) for k, v in net.p.items()}
    ones, zeros = np.nonzero(labels == 1)[0], np.nonzero(labels == 0)[0]
    steps = max(40, min(1, len(ones)) * -(-max(len(ones), len(zeros)) // (batch // 2)) * epochs)
    step = 0
    while step < steps and len(ones) and len(zeros):
        pick = np.concatenate([rng.choice(ones, batch // 2), rng.choice(zeros, batch - batch // 2)])
        words = read_words([texts[i] for i in pick], table)
        y = labels[pick]
        vectors, memory = net.inputs(words), {}
        out = net.forward(vectors, words.windows, memory).astype(np.float64)
        p = np.clip(_sigmoid(out), 1e-6, 1 - 1e-6)
        none = np.bincount(words.text_of, weights=np.log1p(-p), minlength=batch)
        none = np.exp(none)[words.text_of]
        toxic = y[words.text_of] == 1
        dout = np.where(toxic, -p * none / np.maximum(1 - none, 1e-6), p) / batch
        grads = net.gradients(words, vectors, words.windows, memory, dout.astype(np.float32))
        step += 1
        lr = rate * (1 - step / (steps + 1)) * min(1.0, step / 20)
        for k, g in grads.items():
            if isinstance(g, tuple):  # only the embeddings that were read
                at, dense = _row_sums(*g)
                m = first[k][at] = 0.9 * first[k][at] + 0.1 * dense
                s = second[k][at] = 0.999 * second[k][at] + 0.001 * dense**2
                net.p[k][at] -= lr * (m / (1 - 0.9**step)) / (np.sqrt(s / (1 - 0.999**step)) + 1e-6)
            else:
                m = first[k] = 0.9 * first[k] + 0.1 * g
                s = second[k] = 0.999 * second[k] + 0.001 * g**2
                net.p[k] -= (lr * (m / (1 - 0.9**step)) / (np.sqrt(s / (1 - 0.999**step)) + 1e-6)).astype(np.float32)
    top = np.concatenate([net.worst(read_words(texts[i : i + 64], table), len(texts[i : i + 64])) for i in range(0, len(texts), 64)]) if texts else np.zeros(0)
    net.slope, net.offset = _fit_score(top, labels)
    return net


def _fit_score(top: np.ndarray, labels: np.ndarray, strength: float = 1e-2) -> tuple[float, float]:
    """Slope and offset of a logistic curve over the worst windows' outputs, by Newton steps."""
    if not len(top):
        return 1.0, 0.0
    x = np.stack([np.clip(top, -15, 15), np.ones(len(top))], axis=1)
    w = np.array([1.0, 0.0])
    for _ in range(50):
        p = _sigmoid(x @ w)
        gradient = x.T @ (p - labels) + strength * (w - [1.0, 0.0])
        curve = (x * (p * (1 - p))[:, None]).T @ x + strength * np.eye(2)
        w = w - np.linalg.solve(curve, gradient)
    return (float(w[0]), float(w[1])) if np.isfinite(w).all() and w[0] > 0 else (1.0, 0.0)


def train_toxicity_model(
    docs: DataFrame,
    labels: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    label_col: str = "toxic",
    *,
    per_label: int = 1500,
) -> Network:
    """Learns from about ``per_label`` texts of each label that are not held out.

    Rows with a NULL id, label or text teach nothing. With only one label, or none, the
    network stays as it starts and calls nothing toxic.
    """
    marks = labels.where(F.col(id_col).isNotNull() & F.col(label_col).isin(0, 1)).select(
        F.col(id_col).alias("__id"), F.col(label_col).cast("int").alias("label")
    )
    wanted = marks.where(~held_out(F.col("__id"))).distinct()
    texts = docs.where(F.col(text_col).isNotNull()).select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    rows = labelled_sample(wanted, "__id", "label", per_label)
    spark = docs.sparkSession
    picked = spark.createDataFrame([(r["__id"], r["label"]) for r in rows], "id long, label int")
    # The picked ids are bounded by the parameter, so they may be sent to every executor.
    sample = texts.join(F.broadcast(picked), "id").collect()
    sample = sorted(sample, key=lambda r: (r["id"], r["label"], r["text"]))
    return train([r["text"] for r in sample], np.array([r["label"] for r in sample], dtype=int), letter_table())


def _scorer(net: Network, table: np.ndarray) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            scores = [np.zeros(0)]
            for _, texts in chunks(batch.column(batch.num_columns - 1)):
                top = net.worst(read_words(texts, table), len(texts))
                scores.append(_sigmoid(np.clip(net.slope * np.clip(top, -15, 15) + net.offset, -30, 30)))
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[:-1], pa.array(np.concatenate(scores), pa.float64())],
                names=[*batch.schema.names[:-1], "score"],
            )

    return run


def score_toxicity(docs: DataFrame, net: Network, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` columns but the text, and ``score``; the text is read whole. NULL and empty texts
    get the score of an empty window. Repeated rows are kept."""
    rows = docs.select(F.col(id_col), F.col(text_col).alias("__text"))
    kind = dict(rows.dtypes)[id_col]
    return rows.mapInArrow(_scorer(net, letter_table()), f"`{id_col}` {kind}, score double")


def reject_toxic(docs: DataFrame, net: Network, text_col: str = "text", threshold: float = 0.5) -> DataFrame:
    """The rows of ``docs``, all columns, whose whole text scores below ``threshold``."""
    table = letter_table()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            clean = [np.zeros(0, dtype=bool)]
            for _, texts in chunks(batch.column(batch.schema.get_field_index(text_col))):
                top = net.worst(read_words(texts, table), len(texts))
                clean.append(_sigmoid(np.clip(net.slope * np.clip(top, -15, 15) + net.offset, -30, 30)) < threshold)
            yield batch.filter(pa.array(np.concatenate(clean)))

    return docs.mapInArrow(run, docs.schema)

"""Texts as arrays of word hashes, and shingles of them.

Words are runs of bytes other than the six ASCII white-space characters, with A-Z
lowered. A word's hash is a polynomial in random numbers of its bytes, taken from
running sums over many texts at once, so no word becomes a Python object.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

from flowgauge.llm.chars import mix

_BASE = np.uint64(0x9E3779B97F4A7C15)
#: Texts are worked on together until they hold so many characters.
CHUNK_CHARS = 1 << 19


class WordReader:
    """Word hashes of texts. Keeps the running powers of the hash between calls.

    ``marks`` tells whether ASCII marks belong to words or part them as space does.
    """

    def __init__(self, marks: bool = True) -> None:
        numbers = mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(0xD6E8FEB86659FD93))
        lower = np.arange(256)
        lower[65:91] += 32
        self.number = numbers[lower]
        self.space = np.zeros(256, dtype=bool)
        self.space[[32, *range(9, 14)]] = True
        if not marks:
            self.space[[i for i in range(128) if not chr(i).isalnum()]] = True
        self.power = self.inverse = np.ones(1, dtype=np.uint64)

    def read(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Hashes of all words, and where the words of each text begin (one entry more than texts)."""
        raw = [t.encode("utf-8", "surrogatepass") for t in texts]
        data = np.frombuffer(b"\n".join([*raw, b""]), dtype=np.uint8)
        if len(self.power) <= len(data):
            n = len(data) + 1
            self.power = np.multiply.accumulate(np.full(n, _BASE, dtype=np.uint64))
            self.inverse = np.multiply.accumulate(np.full(n, np.uint64(pow(int(_BASE), -1, 1 << 64)), dtype=np.uint64))
        inside = ~self.space[data]
        edges = np.diff(np.concatenate([[False], inside]).astype(np.int8), append=np.int8(0))
        begin, end = np.nonzero(edges[:-1] == 1)[0], np.nonzero(edges[:-1] == -1)[0]
        total = np.concatenate([[np.uint64(0)], np.add.accumulate(self.number[data] * self.power[: len(data)])])
        hashes = mix((total[end] - total[begin]) * self.inverse[begin] + (end - begin).astype(np.uint64))
        starts = np.concatenate([[0], np.cumsum([len(r) + 1 for r in raw])])
        return hashes, np.searchsorted(begin, starts)


def shingles(words: np.ndarray, n: int) -> np.ndarray:
    """Hash of the ``n`` words from each place on; a shorter text is one shingle, an empty one none."""
    if not len(words):
        return words
    size = min(n, len(words))
    h = np.full(len(words) - size + 1, size, dtype=np.uint64)
    for k in range(size):
        h = (h ^ words[k : len(words) - size + 1 + k]) * _BASE
        h ^= h >> np.uint64(32)
    return mix(h)


def word_blocks(text: bytes | None, table: bytes, block: int = 1 << 20) -> Iterator[list[bytes]]:
    """Words of a text as bytes, a block of the text at a time; ``table`` maps what parts words to spaces."""
    text = (text or b"").translate(table)
    at = 0
    while at < len(text):
        end = text.find(b" ", at + block)
        end = len(text) if end < 0 else end
        words = text[at:end].split()
        at = end
        if words:
            yield words


def raw_texts(column: pa.Array) -> Iterator[bytes | None]:
    """Texts as bytes, without decoding them."""
    return (value.as_py() for value in column.cast(pa.large_binary()))


def chunks(column: pa.Array) -> Iterator[tuple[int, list[str]]]:
    """Places and texts, some at a time, NULL as the empty text."""
    held: list[str] = []
    size = start = 0
    for i, value in enumerate(column):
        text = value.as_py() or ""
        held.append(text)
        size += len(text)
        if size >= CHUNK_CHARS:
            yield start, held
            held, size, start = [], 0, i + 1
    if held:
        yield start, held

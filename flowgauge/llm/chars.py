"""Texts as arrays of lower-case letters, for the classifiers that read characters."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

#: Codes of what is not a letter: any run of other characters, and the end of a text.
GAP, END = 0, 1
#: Texts are worked on together until they hold so many characters.
CHUNK_CHARS = 1 << 20


def letter_table() -> np.ndarray:
    """Lower-case code of every letter of the basic plane, GAP for the rest."""
    table = np.zeros(1 << 16, dtype=np.uint32)
    for code in range(1 << 16):
        char = chr(code)
        if char.isalpha():
            table[code] = ord(char.lower()[0])
    return table


def letters(texts: list[str], table: np.ndarray) -> np.ndarray:
    """All texts in one array: letters, single GAPs between words, END after each text."""
    raw = np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), dtype="<u4")
    codes = table[np.minimum(raw, 0xFFFF)]
    for code in np.unique(raw[raw > 0xFFFF]):
        codes[raw == code] = ord(chr(code).lower()[0]) if chr(code).isalpha() else GAP
    ends = np.cumsum([len(t) for t in texts])
    codes = np.insert(codes, ends, END)
    gap = codes == GAP
    gap[1:] &= gap[:-1]
    gap[0] = False
    return codes[~gap]


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


def mix(h: np.ndarray) -> np.ndarray:
    """Finishing step of a 64-bit hash, so that every bit of the input reaches every bit."""
    h = h ^ (h >> np.uint64(33))
    h = h * np.uint64(0xFF51AFD7ED558CCD)
    h = h ^ (h >> np.uint64(33))
    h = h * np.uint64(0xC4CEB9FE1A85EC53)
    return h ^ (h >> np.uint64(33))


def ngram_hashes(codes: np.ndarray, n: int) -> np.ndarray:
    """A 64-bit hash of the ``n`` codes from each place on; the last ``n - 1`` places have none."""
    h = np.full(max(0, len(codes) - n + 1), n, dtype=np.uint64)
    for k in range(n):
        h *= np.uint64(0x9E3779B97F4A7C15)
        h += codes[k : len(codes) - n + 1 + k]
        h ^= h >> np.uint64(29)
    return mix(h)

"""Plain, slow versions of the training-data operators, to compare with."""

import hashlib
import re
from collections import Counter, defaultdict

_LOW = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})


def words(text):
    return re.findall("[^\x20\x09-\x0d]+", (text or "").translate(_LOW))


def shingle_set(text, n=4):
    w = words(text)
    if len(w) < n:
        return frozenset([tuple(w)] if w else [])
    return frozenset(tuple(w[k : k + n]) for k in range(len(w) - n + 1))


class Union:
    def __init__(self, nodes):
        self.up = {n: n for n in nodes}

    def root(self, x):
        while self.up[x] != x:
            x = self.up[x]
        return x

    def join(self, a, b):
        a, b = self.root(a), self.root(b)
        self.up[max(a, b)] = min(a, b)


def jaccard(docs, percent=85):
    """``{id: (size, component)}`` by comparing all documents that share a shingle."""
    sets = {i: shingle_set(t) for i, t in docs}
    holders = defaultdict(list)
    union = Union(sets)
    for i in sorted(sets):
        shared = Counter(j for s in sets[i] for j in holders[s])
        for j, n in shared.items():
            if 100 * n >= percent * (len(sets[i]) + len(sets[j]) - n):
                union.join(i, j)
        for s in sets[i]:
            holders[s].append(i)
    return {i: (len(s), union.root(i)) for i, s in sets.items()}


def dedup_lines(docs, min_chars=10, min_docs=2):
    def key(line):
        return line.strip(" \t\n\x0b\x0c\r").translate(_LOW)

    holders = defaultdict(set)
    for i, t in docs:
        for line in (t or "").split("\n"):
            if i is not None and len(key(line)) >= min_chars:
                holders[key(line)].add(i)
    out = []
    for i, t in docs:
        lines = (t or "").split("\n")
        kept = [
            x for x in lines if i is None or not (len(holders[key(x)]) >= min_docs and i != min(holders[key(x)]))
        ]
        digest = hashlib.sha256("\n".join(kept).encode()).hexdigest()
        out.append((i, len(lines), len(lines) - len(kept), digest))
    return out


def plain_words(text):
    return re.findall("[0-9A-Za-z\x80-\U0010ffff]+", (text or "").translate(_LOW))


def alignment(a, b, match=2, mismatch=-1, gap=-1):
    """Best local alignment score, cell by cell."""
    best, row = 0, [0] * (len(b) + 1)
    for x in a:
        new = [0]
        for j, y in enumerate(b, 1):
            new.append(max(0, row[j - 1] + (match if x == y else mismatch), row[j] + gap, new[j - 1] + gap))
        best, row = max(best, *new), new
    return best


def mixed(docs, weights=(5, 2, 1), share=1.5, most=2.0, seed=42):
    """``copies`` of each row ``(id, source, text)``, by one walk along each source."""

    def unit(text):
        return int(hashlib.md5(text.encode()).hexdigest()[:8], 16) / 2**32

    def size_class(size):
        step = size.bit_length() - 5
        return size if size < 64 else 64 + 16 * (size.bit_length() - 7) + (size >> step) - 16

    sizes = [len(words(t)) for _, _, t in docs]
    total = Counter()
    for (_, source, _), size in zip(docs, sizes, strict=True):
        total[source] += size
    order = sorted(total, key=lambda s: (s is None, s or ""))
    weight = {s: weights[k % len(weights)] for k, s in enumerate(order)}
    target, open_, left = {}, set(order), share * sum(total.values())
    while open_:
        level = left / sum(weight[s] for s in open_)
        full = {s for s in open_ if weight[s] * level > most * total[s]}
        if not full:
            target |= {s: weight[s] * level for s in open_}
            break
        for s in full:
            target[s] = most * total[s]
            left -= target[s]
        open_ -= full
    copies = [0] * len(docs)
    for source in order:
        rate = target[source] / total[source] if total[source] else 0.0
        shift = unit(f"{seed}|{str(source is None).lower()}|{source or ''}")
        own = [k for k, d in enumerate(docs) if d[1] == source]
        cell = {k: int(unit("" if docs[k][0] is None else str(docs[k][0])) * 64) for k in own}
        own.sort(key=lambda k: (size_class(sizes[k]), cell[k], sizes[k], docs[k][0] if docs[k][0] is not None else -1))
        for place, k in enumerate(own, 1):
            copies[k] = int(place * rate + shift) - int((place - 1) * rate + shift)
    return copies, target, total

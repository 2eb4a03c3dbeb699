"""Jaccard join, embedding near-dedup, decontamination and substring dedup against plain versions."""

import math
import random

import numpy as np
import pytest

import corpus_pipeline
from flowgauge.llm import decontaminate, embeddings, jaccard, passages, queries
from flowgauge.llm.common import components, with_marks
from tests.llm import plain


def _random_text(rng, n):
    return " ".join(rng.choice("abcdefghijklmnopqrstuvwxyz") + str(rng.randint(0, 400)) for _ in range(n))


def _edited(rng, text, n):
    words = text.split(" ")
    for _ in range(n):
        at = rng.randrange(len(words))
        words[at : at + rng.randint(0, 1)] = [f"new{rng.randint(0, 99)}"]
    return " ".join(words)


@pytest.fixture(scope="module")
def copied():
    rng = random.Random(4)
    line = _random_text(rng, 14)
    docs = []
    for i in range(60):
        base = _random_text(rng, rng.choice([3, 20, 60, 150]))
        docs.append(base)
        for k in range(rng.randint(0, 6)):
            docs.append(_edited(rng, base, k))
        if i % 3 == 0:
            docs.append(line + " " + _random_text(rng, 120))
    docs += [docs[0].upper(), docs[5], docs[5], "", " \n\t", "one", "ONE", "one two three", "a b c d"]
    rng.shuffle(docs)
    return list(enumerate(docs))


def test_components_of_random_links(spark):
    rng = random.Random(1)
    links = [(rng.randint(0, 150), rng.randint(0, 150)) for _ in range(110)] + [(500 + i, 501 + i) for i in range(40)]
    links += [(1000, 1000 + i) for i in range(50)]
    union = plain.Union({n for e in links for n in e})
    for a, b in links:
        union.join(a, b)
    df = spark.createDataFrame([*links, (None, 3)], "a long, b long")
    got = {r["node"]: r["component"] for r in components(df).collect()}
    assert got == {n: union.root(n) for a, b in links if a != b for n in (a, b)}
    assert components(df.limit(0)).count() == 0


def test_jaccard_matches_plain(spark, copied):
    df = spark.createDataFrame([(i, t, 0) for i, t in copied] + [(None, copied[3][1], 0), (9999, None, 0), copied[7] + (1,)], "doc_id long, text string, key int")
    want = plain.jaccard([*copied, (9999, None)])
    rows = jaccard.jaccard_components(df).collect()
    assert len(rows) == len(copied) + 3
    assert {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in rows if r["doc_id"] is not None} == want
    assert [r["component_id"] for r in rows if r["doc_id"] is None] == [None]
    assert sum(c != i for i, (_, c) in want.items()) > 50
    assert jaccard.jaccard_components(df.limit(0)).count() == 0


def test_jaccard_on_the_table(spark, sf_dir):
    docs = [tuple(r) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").collect()]
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in queries.op3_ngram_jaccard(spark, sf_dir).collect()}
    assert got == plain.jaccard(docs)


def test_count_tree_loses_no_pair():
    rng = np.random.default_rng(3)
    for n in (2, 31, 33, 1100):
        points = rng.poisson(3, (n, jaccard.GROUPS)).astype(np.int32)
        points[n // 2 :] = points[: n - n // 2] + rng.integers(0, 2, (n - n // 2, jaccard.GROUPS))
        sizes = points.sum(axis=1)
        met = [np.stack([np.minimum(a, b), np.maximum(a, b)]) for a, b in jaccard.CountTree(points, sizes).pairs(85)]
        met = np.concatenate(met, axis=1).T.tolist()
        want = [
            [i, j]
            for i in range(n)
            for j in np.nonzero(np.minimum(points[i], points[i + 1 :]).sum(axis=1) >= jaccard.needed(sizes[i] + sizes[i + 1 :], 85))[0] + i + 1
        ]
        assert sorted(met) == want


def _vectors(seed=5, dim=16):
    rng = np.random.default_rng(seed)
    out = []
    for k in range(80):
        base = rng.normal(size=dim)
        for _ in range(int(rng.choice([1, 1, 2, 5, 40]))):
            out.append((base + rng.normal(size=dim) * rng.choice([0, 0.02, 0.1, 0.2])).tolist())
    return out


def test_vectors_match_plain(spark):
    found = _vectors()
    odd = [None, [], [0.0] * 16, [1.0, None], [math.nan] * 16, [math.inf, 1.0], [1.0, 2.0], [2.0, 4.0], found[0], [1e-300] * 16, [1e300] * 16]
    rows = [(i, v, 0) for i, v in enumerate(found + odd)]
    df = spark.createDataFrame([*rows, (None, found[0], 0)], "vec_id long, embedding array<double>, node int")
    good = [(i, np.array(v)) for i, v, _ in rows if v and None not in v and np.isfinite(v).all() and any(v)]
    union, links = plain.Union(range(len(rows))), dict.fromkeys(range(len(rows)), 0)
    for k, (i, a) in enumerate(good):
        for j, b in good[k + 1 :]:
            if len(a) == len(b) and (a / np.abs(a).max()) @ (b / np.abs(b).max()) >= 0.95 * np.linalg.norm(a / np.abs(a).max()) * np.linalg.norm(b / np.abs(b).max()):
                union.join(i, j)
                links[i] += 1
                links[j] += 1
    got = {r["vec_id"]: r for r in embeddings.near_duplicates(df).collect()}
    assert {i: (r["n_links"], r["component_id"]) for i, r in got.items() if i is not None} == {i: (links[i], union.root(i)) for i in links}
    assert all(r["kept"] == (i is not None and i == r["component_id"]) for i, r in got.items())
    assert (got[None]["n_links"], got[None]["component_id"]) == (0, None)
    assert embeddings.near_duplicates(df.limit(0)).count() == 0


def test_alignment_matches_plain():
    rng = np.random.default_rng(2)
    pairs = [(rng.integers(1, 5, rng.integers(1, 30)), rng.integers(1, 5, rng.integers(1, 20))) for _ in range(40)]
    got = decontaminate.align([a.astype(np.uint64) for a, _ in pairs], [b.astype(np.uint64) for _, b in pairs])
    assert got.tolist() == [plain.alignment(a.tolist(), b.tolist()) for a, b in pairs]


def test_leaks_are_found_and_others_left(spark):
    rng = random.Random(6)
    items = [(i, _random_text(rng, 30)) for i in range(12)] + [(50, "a1 b2 c3 d4"), (51, "x"), (52, None), (None, "n u l l")]
    docs = []
    for i in range(12):
        words = items[i][1].split(" ")
        noise = [_random_text(rng, 200) for _ in range(2)]
        docs.append((2 * i, " ".join([noise[0], items[i][1].upper().replace(" ", ", "), noise[1]])))
        for _ in range(4):  # some words replaced, one dropped, one added
            words[rng.randrange(len(words))] = "changed"
        del words[10]
        words.insert(20, "added")
        docs.append((2 * i + 1, " ".join([noise[1], *words])))
    docs += [(100 + i, _random_text(rng, 300)) for i in range(40)]
    docs += [(200, "so a1 b2 c3 d4 it is"), (201, "so a1 b2 c3 it is"), (202, None), (203, ""), (204, _random_text(rng, 40_000) + " " + items[3][1])]
    df = spark.createDataFrame([(i, t, 0) for i, t in docs], "doc_id long, text string, item_id int")
    marks = spark.createDataFrame(items, "item_id long, text string")
    got = {(r["doc_id"], r["item_id"]) for r in decontaminate.find_leaks(df, marks).collect()}
    want = {(2 * i + k, i) for i in range(12) for k in (0, 1)} | {(200, 50), (204, 3)}
    assert got == want
    left = decontaminate.drop_leaks(df, marks)
    assert left.columns == df.columns
    assert {r["doc_id"] for r in left.collect()} == {i for i, _ in docs} - {i for i, _ in want}
    assert decontaminate.find_leaks(df, marks.limit(0)).count() == 0
    assert decontaminate.drop_leaks(df, marks.limit(0)).count() == len(docs)
    assert decontaminate.find_leaks(df.limit(0), marks).count() == 0


def test_leaks_in_blocks_are_the_same(spark, sf_dir, monkeypatch):
    whole = {tuple(r) for r in queries.op5_decontamination(spark, sf_dir).collect()}
    monkeypatch.setattr(decontaminate, "BLOCK_SEEDS", 1500)
    assert {tuple(r) for r in queries.op5_decontamination(spark, sf_dir).collect()} == whole


def test_a_leak_into_many_documents_keeps_its_seeds(spark):
    rng = random.Random(8)
    item = _random_text(rng, 25)
    df = spark.createDataFrame([(i, _random_text(rng, 10) + " " + item) for i in range(300)], "doc_id long, text string")
    marks = spark.createDataFrame([(1, item), (2, _random_text(rng, 25))], "item_id long, text string")
    assert decontaminate.find_leaks(df, marks).count() == 300


def test_edited_and_half_leaks_into_many_documents(spark):
    rng = random.Random(13)
    edited, half = _random_text(rng, 30).split(" "), _random_text(rng, 30)
    marks = spark.createDataFrame([(1, " ".join(edited)), (2, half)], "item_id long, text string")
    edited[7], edited[15], edited[23] = "x", "y", "z"
    docs = [(i, _random_text(rng, 10) + " " + " ".join(edited)) for i in range(300)]
    docs += [(500 + i, _random_text(rng, 10) + " " + " ".join(half.split(" ")[:16]) + " " + _random_text(rng, 10)) for i in range(50)]
    docs += [(600, half)] + [(700 + i, " ".join(half.split(" ")[20:24]) + " " + _random_text(rng, 40)) for i in range(60)]
    df = spark.createDataFrame(docs, "doc_id long, text string")
    got = {(r["doc_id"], r["item_id"]) for r in decontaminate.find_leaks(df, marks).collect()}
    assert got == {(i, 1) for i in range(300)} | {(500 + i, 2) for i in range(50)} | {(600, 2)}


def test_compact_windows_match_plain():
    rng = np.random.default_rng(9)
    v = rng.integers(1, 1 << 40, 400).astype(np.uint64)
    v[[120, 121, 300]] = 0
    c, left, right = passages.compact_windows(v, 20)
    want = []
    for k in range(len(v)):
        a, b = k, k
        while a > 0 and v[a - 1] >= v[k]:
            a -= 1
        while b + 1 < len(v) and v[b + 1] >= v[k]:
            b += 1
        if v[k] and b - a + 1 >= 20:
            want.append((k, min(k - a, 19), min(b - k, 19)))
    assert list(zip(c.tolist(), left.tolist(), right.tolist(), strict=True)) == want


def _repeats(docs, n=50):
    """Documents and word places of n-word passages that another document has too."""
    holders = {}
    for i, t in docs:
        w = plain.words(t)
        for k in range(len(w) - n + 1):
            holders.setdefault(tuple(w[k : k + n]), set()).add(i)
    out = []
    for i, t in docs:
        w = plain.words(t)
        out += [(i, k) for k in range(len(w) - n + 1) if len(holders[tuple(w[k : k + n])]) > 1]
    return out


def test_verbatim_passages_are_covered(spark, sf_dir):
    docs = [tuple(r) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").collect()]
    got = {}
    for r in queries.op6_substring_dedup(spark, sf_dir).collect():
        got.setdefault(r["doc_id"], []).append((r["start_word"], r["end_word"], r["other_id"]))
        assert r["other_id"] != r["doc_id"] and r["end_word"] - r["start_word"] >= 50
    assert all(any(a <= k and k + 50 <= b for a, b, _ in got.get(i, [])) for i, k in _repeats(docs))


def test_passages_planted_among_others(spark):
    rng = random.Random(11)
    shared, line = _random_text(rng, 55), _random_text(rng, 20)
    docs = [(i, " ".join([_random_text(rng, rng.randint(0, 80)), shared, _random_text(rng, 60)])) for i in range(30)]
    docs += [(100 + i, _random_text(rng, 100) + " " + line + " " + _random_text(rng, 50)) for i in range(30)]
    edited = shared.split(" ")
    edited[27] = "changed"
    docs += [(200, _random_text(rng, 70) + " " + _random_text(rng, 300)), (300, None), (301, ""), (302, line)]
    long = _random_text(rng, 20_000)
    docs += [(400, long), (401, long), (401, long), (402, long + " " + shared)]
    df = spark.createDataFrame([(i, t, 0) for i, t in docs] + [(None, long, 0)], "doc_id long, text string, node int")
    got = {r["doc_id"] for r in passages.repeated_passages(df).collect()}
    assert got == set(range(30)) | {400, 401, 402}
    assert passages.repeated_passages(df.limit(0)).count() == 0


def test_passages_behind_a_line_shared_with_a_hub(spark):
    rng = random.Random(21)
    reader = passages.WordReader()

    def least(text):
        """Places of the least shingle by the first two hashes."""
        found = passages.shingles(reader.read([text])[0], 5)
        return [int(np.argmin(passages.mix(found ^ np.uint64(0x51ED270B * (f + 1))) | np.uint64(1))) for f in (0, 1)]

    # 30 words with their least shingles so far back that the side before them is in the line too.
    line = next(t for t in iter(lambda: _random_text(rng, 30), None) if min(least(t)) >= 24)
    ends = (line + " " + _random_text(rng, 20) for _ in iter(int, 1))
    ends = [next(t for t in ends if min(p := least(t)) >= 24 and max(p) <= 25) for _ in range(12)]
    docs = [(i, _random_text(rng, 80) + " " + line + " " + _random_text(rng, 80)) for i in range(40)]
    docs += [(100 + 2 * k + j, _random_text(rng, 80) + " " + end) for k, end in enumerate(ends) for j in (0, 1)]
    df = spark.createDataFrame(docs, "doc_id long, text string")
    got = {r["doc_id"]: r["other_id"] for r in passages.repeated_passages(df).collect()}
    assert got == {i: i ^ 1 for i in range(100, 124)}


def test_edited_passages_are_found(spark):
    """Jaccard 41/51 = 0.804: one word in the middle of 50 changed."""
    rng = random.Random(31)
    docs = []
    for i in range(300):
        words = _random_text(rng, 50).split(" ")
        for k in (0, 1):
            docs.append((2 * i + k, " ".join([_random_text(rng, 60), *words, _random_text(rng, 60)])))
            words[25] = "changed"
    df = spark.createDataFrame(docs, "doc_id long, text string")
    got = {r["doc_id"] for r in passages.repeated_passages(df).collect() if r["other_id"] == r["doc_id"] ^ 1}
    assert len(got) >= 0.99 * len(docs), len(got) / len(docs)


def test_edited_passages_verify():
    rng = random.Random(12)
    words = _random_text(rng, 140).split(" ")
    other = words.copy()
    other[40], other[95:96] = "changed", []
    read = lambda w: passages.shingles(passages.WordReader().read([" ".join(w)])[0], 5)
    a, b = read(words), read(other)
    seeds = [(p, q) for p in range(len(a)) for q in range(len(b)) if a[p] == b[q]]
    spans = passages.matching_spans(a, b, seeds, 46, 0.8)
    covered = {k for s in spans for k in range(s[0], s[1])}
    assert len(covered) > 100
    assert not passages.matching_spans(a, read(_random_text(rng, 140).split(" ")), seeds, 46, 0.8)


def template_texts(n, common, own):
    shared = " ".join(f"t{i}" for i in range(common))
    return [(k, shared + " " + " ".join(f"x{k}w{i}" for i in range(own))) for k in range(n)]


@pytest.mark.parametrize("own, one", [(92, False), (40, True)])
def test_texts_of_a_template(spark, monkeypatch, own, one):
    """Below the threshold no pair of a template's texts is verified, above it all are one component."""
    verified, plainly = spark.sparkContext.accumulator(0), jaccard._verifier

    def counting(n, percent):
        inner = plainly(n, percent)

        def run(batches):
            def seen():
                for batch in batches:
                    verified.add(batch.num_rows)
                    yield batch

            return inner(seen())

        return run

    monkeypatch.setattr(jaccard, "_verifier", counting)
    docs = template_texts(200, 900, own)
    found = jaccard.jaccard_components(spark.createDataFrame(docs, "doc_id bigint, text string")).collect()
    assert {r["component_id"] for r in found} == ({0} if one else set(range(200)))
    assert verified.value <= 2 * len(docs)


def test_passages_of_repeated_words(spark):
    """Words that come thousands of times in a row are two places, not thousands; the rest is found."""
    rng = random.Random(11)
    tail = " ".join(f"q{rng.randrange(10**6)}" for _ in range(60))
    docs = [(i, "spam " * 5000 + tail + f" end{i}") for i in range(3)]
    docs += [(3, "one two three four five six " * 300), (4, "one two three four five six " * 200 + "last words")]
    found = passages.repeated_passages(spark.createDataFrame(docs, "doc_id bigint, text string")).collect()
    by = {}
    for r in found:
        by.setdefault(r["doc_id"], []).append((r["start_word"], r["end_word"]))
    for i in range(3):
        assert any(a <= 5000 and b >= 5060 for a, b in by[i])
    assert {3, 4} <= set(by)


def test_marked_places_cover_all_shared_keys(spark, sf_dir):
    rows = spark.read.parquet(f"{sf_dir}/documents.parquet").where("text IS NOT NULL")
    rows = rows.selectExpr("xxhash64(text) AS node", "text")
    whole = np.full(1 << (passages.FILTER_BITS - 3), 255, dtype=np.uint8)
    schema = "key long, node long, c int, l short, r short"
    bits = passages.shared_places(rows, 46)

    def shared(b):
        windows = rows.mapInArrow(passages._windows(46, b), schema)
        return {
            r["key"] for r in windows.selectExpr("key", "node").distinct().groupBy("key").count().where("count > 1").collect()
        }

    assert shared(bits) == shared(whole) and np.unpackbits(bits).sum() > 0


def test_items_of_one_beginning_and_a_text_that_repeats_it(spark):
    """Places of a seed are opened only for items that the text could hold."""
    import resource

    begin = "which of the following is"
    items = decontaminate.Items.of([(i, f"{begin} " + " ".join(f"w{i}x{k}" for k in range(10))) for i in range(4000)])
    texts = [f"{begin} " * 2000, f"{begin} " * 2000 + items_text(7)]
    before = resource.getrusage(resource.RUSAGE_SELF).ru_maxrss
    found = decontaminate.scores(items, texts, decontaminate.WordReader(), 0.5)
    assert found[0] == {} and set(found[1]) == {7}
    assert resource.getrusage(resource.RUSAGE_SELF).ru_maxrss - before < 500_000  # KB


def items_text(i):
    return "which of the following is " + " ".join(f"w{i}x{k}" for k in range(10))


def test_passages_at_every_place_of_a_repeated_pattern(spark):
    """Of a long run of a pattern all that a shorter run holds is reported, and copies at middle places of a hub's key are."""
    rng = random.Random(17)
    filler = [_random_text(rng, 80) for _ in range(8)]
    pattern = "one two three four five six "
    docs = [(0, f"{filler[0]} " + pattern * 300 + filler[1]), (1, f"{filler[2]} " + pattern * 20 + filler[3])]
    # A line that comes five times; the copies of the edited passage lie around the third.
    line = " ".join(f"line{i}" for i in range(40))
    around = [_random_text(rng, 30) for _ in range(10)]
    hub = " ".join(f"{around[2 * i]} {line} {around[2 * i + 1]}" for i in range(5))
    docs += [(2, hub), (3, f"{filler[4]} {around[4]} {line} {around[5].replace(' ', ' x ', 1)} {filler[5]}")]
    found = passages.repeated_passages(spark.createDataFrame(docs, "doc_id bigint, text string")).collect()
    covered = {}
    for r in found:
        covered.setdefault(r["doc_id"], set()).update(range(r["start_word"], r["end_word"]))
    assert set(range(80, 80 + 1800)) <= covered[0] and set(range(80, 80 + 120)) <= covered[1]
    assert set(range(80, 80 + 70)) <= covered[3] and set(range(200, 270)) <= covered[2]


def test_similar_windows_with_repeated_shingles():
    """Windows are found though a shingle of theirs has several places in the other text."""
    rng = np.random.default_rng(4)
    b = rng.integers(0, 1 << 62, 46).astype(np.uint64)
    b[20:32] = b[8:20]
    a = b.copy()
    a[8:12] = rng.integers(0, 1 << 62, 4).astype(np.uint64)
    p, q = np.unique(a), np.unique(b)
    both = len(np.intersect1d(p, q))
    assert both >= 0.8 * (len(p) + len(q) - both)
    assert passages._similar(a, b, 46, 0.8) == [0]


def test_passage_spans_match_plain():
    """All stretches of windows that reach the similarity with any window of the other text, and no more."""
    rng = np.random.default_rng(3)

    def plain_spans(a, b, length, least):
        sides = [[set(v[i : i + length].tolist()) for i in range(max(0, len(v) - length + 1))] for v in (a, b)]
        similar = lambda p, q: len(p & q) >= least * len(p | q) - 1e-9
        at = [[i for i, p in enumerate(x) if any(similar(p, q) for q in y)] for x, y in (sides, sides[::-1])]
        return tuple(passages._runs(np.array(k, dtype=np.int64), length) for k in at)

    def edited(v):
        v = v.copy()
        v[rng.integers(0, len(v), rng.integers(0, 4))] = rng.integers(0, 1000)
        return v

    for _ in range(60):
        length, least, words = int(rng.integers(5, 14)), float(rng.choice([0.5, 0.6, 0.8, 0.9])), int(rng.choice([4, 12, 40, 1000]))
        base = rng.integers(0, words, rng.integers(3, 50)).astype(np.uint64)
        rest = [rng.integers(0, words, rng.integers(0, 30)).astype(np.uint64) for _ in range(2)]
        a = passages.mix(np.concatenate([rest[0], edited(base), edited(base)]) + np.uint64(1))
        b = passages.mix(np.concatenate([edited(base), rest[1], edited(base)[2:]]) + np.uint64(1))
        assert passages.passage_spans(a, b, length, least) == plain_spans(a, b, length, least)


def test_texts_of_many_lines_that_nearly_link_verify_in_time():
    """Sixty copies of a line in each text, just below the similarity, were half a minute for the pair."""
    import time

    import pyarrow as pa

    rng = random.Random(5)
    line = _random_text(rng, 40).split(" ")

    def text(step):
        out = []
        for i in range(60):
            out += [*line[:20], f"x{step}y{i}", *line[20:], f"z{step}y{i}"]
        return " ".join(out)

    places = list(range(60 * 42 - 50))
    seeds = [[{"key": 1, "shingle": None, "places": places, "long": True, "open": True}]]
    batch = pa.RecordBatch.from_pydict({"a": [1], "b": [2], "seeds": seeds, "text_a": [text("p")], "text_b": [text("q")]})
    began = time.time()
    found = [r for out in passages._verifier(46, 0.8)(iter([batch])) for r in out.to_pylist()]
    assert time.time() - began < 5
    assert [(r["node"], r["key"], r["places"]) for r in found] == [(2, 1, places)]


def test_marks_leave_out_no_partner(spark):
    """Every row with a partner is marked, NULL keys too, and few others are."""
    rows = spark.range(20_000).selectExpr("id", "cast(id * 7 as string) AS t").union(spark.sql("SELECT NULL, 'x'"))
    held = rows.where("id % 9 = 0 OR id IS NULL")
    found = with_marks(rows, held, ["id", "t"])
    assert found.columns == ["id", "t", "marked"] and found.count() == 20_001
    assert found.where("(id % 9 = 0 OR id IS NULL) AND NOT marked").isEmpty()
    assert found.where("id % 9 != 0 AND marked").count() < 100
    assert with_marks(rows, held.limit(0), ["id", "t"]).where("marked").isEmpty()


def _shuffled_rows(plan):
    """Rows written by all exchanges of an executed plan."""
    name, n = plan.getClass().getSimpleName(), 0
    if name == "AdaptiveSparkPlanExec":
        return _shuffled_rows(plan.executedPlan())
    if name.endswith("QueryStageExec"):
        return _shuffled_rows(plan.plan())
    if name == "ShuffleExchangeExec":
        n = plan.metrics().apply("shuffleRecordsWritten").value()
    return n + sum(_shuffled_rows(plan.children().apply(i)) for i in range(plan.children().size()))


def test_texts_without_a_copy_are_not_moved(spark):
    """Where the copies are too many for a broadcast, only rows that may be among them go through the joins."""
    rng = random.Random(9)
    docs = [(i, _random_text(rng, 30)) for i in range(300)]
    docs += [(300, docs[7][1]), (8, docs[8][1]), (8, _random_text(rng, 30)), (None, docs[9][1]), (301, None), (301, None)]
    name = "spark.sql.autoBroadcastJoinThreshold"
    before = spark.conf.get(name)
    spark.conf.set(name, "-1")
    try:
        df = corpus_pipeline.drop_near_copies(spark, spark.createDataFrame(docs, "doc_id long, text string"), "")
        got = df.collect()
        moved = _shuffled_rows(df._jdf.queryExecution().executedPlan())
    finally:
        spark.conf.set(name, before)
    assert sorted(map(tuple, got), key=repr) == sorted([*docs[:300], docs[302], docs[303], docs[304]], key=repr)
    assert 0 < moved < 50


def _near_copies(rng, n, words):
    """Texts of one beginning, each with some words of its own, between others."""
    base = _random_text(rng, words).split(" ")
    out = []
    for i in range(n):
        own = base.copy()
        for k in rng.sample(range(words), 3):
            own[k] = f"own{i}x{k}"
        out.append((i, " ".join([_random_text(rng, 20), *own, _random_text(rng, 20)])))
    return out


def _covered(spans):
    out = {}
    for i, first, last in spans:
        out.setdefault(i, set()).update(range(first, last))
    return out


@pytest.fixture
def compared(spark, monkeypatch):
    """Counts the pairs of texts that are compared."""
    n, plainly = spark.sparkContext.accumulator(0), passages._verifier

    def counting(length, least):
        inner = plainly(length, least)

        def run(batches):
            def seen():
                for batch in batches:
                    n.add(batch.num_rows)
                    yield batch

            return inner(seen())

        return run

    monkeypatch.setattr(passages, "_verifier", counting)
    return n


def test_many_near_copies_are_not_all_compared(spark, compared):
    """Of 100 near copies all that repeats anywhere is found, without comparing each with each and pairs twice."""
    docs = _near_copies(random.Random(41), 100, 200)
    reader = passages.WordReader()
    sets = [passages.shingles(reader.read([t])[0], 5) for _, t in docs]
    want = []
    for i, a in enumerate(sets):
        for j in range(i):
            for x, spans in zip((i, j), passages.passage_spans(a, sets[j], 46, 0.8), strict=True):
                want += [(x, first, last + 4) for first, last in spans]
    found = passages.repeated_passages(spark.createDataFrame(docs, "doc_id bigint, text string")).collect()
    got, want = _covered(r[:3] for r in found), _covered(want)
    assert all(got[i] <= want[i] for i in got)
    assert sum(map(len, got.values())) >= 0.99 * sum(map(len, want.values()))
    assert compared.value < 100 * 99 / 2


def test_passages_in_slices_leave_little_on_disk(spark, monkeypatch):
    """Pairs taken some at a time give the same, and only what the result is read from stays."""
    import glob

    from flowgauge.runtime import shared_dir

    docs = _near_copies(random.Random(43), 30, 120)
    df = spark.createDataFrame(docs, "doc_id bigint, text string")
    whole = {tuple(r) for r in passages.repeated_passages(df).collect()}
    folder = shared_dir(spark).removeprefix("file:") + "/flowgauge/passages-*"
    before = set(glob.glob(folder))
    monkeypatch.setattr(passages, "MOVED_TEXTS", 4)
    monkeypatch.setattr(passages, "MOVED_LEAST", 1)
    found = passages.repeated_passages(df)
    left = {p.rpartition("/passages-")[2] for p in set(glob.glob(folder)) - before}
    assert {tuple(r) for r in found.collect()} == whole and len(whole) >= 30
    assert left and all(x.startswith(("classes-", "spans-")) for x in left)
    assert sum(x.startswith("spans-hub-") for x in left) > 1 or sum(x.startswith("spans-few-") for x in left) > 1
    assert spark.conf.get("spark.sql.classic.shuffleDependency.fileCleanup.enabled", "false") == "false"


def test_passages_broadcast_nothing_that_grows(spark, monkeypatch):
    """Compressed files hide the size of rows, so only bitmaps of fixed size are broadcast, in the steps and in the result."""
    plans, plainly = [], passages.Scratch.stored

    def seen(self, df, name):
        plans.append(df._jdf.queryExecution().executedPlan().toString())
        return plainly(self, df, name)

    monkeypatch.setattr(passages.Scratch, "stored", seen)
    docs = _near_copies(random.Random(47), 6, 80) + [(100, "x " * 60), (101, "x " * 60)]
    found = passages.repeated_passages(spark.createDataFrame(docs, "doc_id bigint, text string"))
    plans.append(found._jdf.queryExecution().executedPlan().toString())
    joins = [line for p in plans for line in p.splitlines() if "Join" in line]
    assert any("SortMergeJoin" in x for x in joins)
    assert all("__bucket" in x for x in joins if "Broadcast" in x)
    assert found.count() >= 6

"""Importance resampling against plain Python."""

import hashlib
import math
import re
import zlib

import duckdb
import numpy as np
import pytest

from flowgauge.llm import resampling
from flowgauge.llm.queries import QUERIES, SQL

_LOW = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})
SCHEMA = "doc_id bigint, text string"


def plain_features(text):
    words = re.findall("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+", (text or "").translate(_LOW))
    return len(words), [
        zlib.crc32(" ".join(words[i : i + n]).encode()) % 10000 for n in (1, 2, 3) for i in range(len(words) - n + 1)
    ]


def plain(docs, target, percent=5):
    found = [(i, *plain_features(t)) for i, t in docs]
    s, t = [0] * 10000, [0] * 10000
    for _, _, f in found:
        for b in f:
            s[b] += 1
    for text in target:
        for b in plain_features(text)[1]:
            t[b] += 1
    gain = [
        math.floor(1000 * math.log((t[b] + 1) * (sum(s) + 10000) / ((s[b] + 1) * (sum(t) + 10000)))) for b in range(10000)
    ]
    rows = []
    for i, words, f in found:
        h = int(hashlib.sha256(f"42:{i}".encode()).hexdigest()[:8], 16)
        weight = sum(gain[b] for b in f)
        rows.append([i, words, len(f), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))])
    may = sorted((r for r in rows if r[1] >= 20), key=lambda r: (-r[4], r[0]))
    rank = {r[0]: k for k, r in enumerate(may[: percent * len(may) // 100], 1)}
    return {(r[0], r[2], r[3], r[4], rank.get(r[0])) for r in rows}


def test_query_equals_plain_version(spark, sf_dir):
    docs = [tuple(r) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").collect()]
    target = [r[0] for r in spark.read.parquet(f"{sf_dir}/benchmark.parquet").select("text").collect()]
    rows = QUERIES["op13_importance_resampling"](spark, sf_dir)
    assert [t for _, t in rows.dtypes] == ["bigint"] * 5
    assert {tuple(r) for r in rows.collect()} == plain(docs, target)
    db = duckdb.connect()
    for table in ("documents", "benchmark"):
        db.execute(f"CREATE VIEW {table} AS SELECT * FROM '{sf_dir}/{table}.parquet'")
    assert set(db.execute(SQL["op13_importance_resampling"]).fetchall()) == plain(docs, target)


def test_planes_equal_the_sum_of_products():
    rng = np.random.default_rng(1)
    gains = rng.integers(-9000, 9000, 10000)
    counts = np.where(rng.random((5, 10000)) < 0.1, rng.integers(0, 3000, (5, 10000)), 0)
    counts[0] = 0
    assert resampling.GainPlanes.of(gains).weigh(counts).tolist() == (counts @ gains).tolist()
    assert resampling.GainPlanes.of(np.zeros(10000, dtype=np.int64)).weigh(counts).tolist() == [0] * 5


def test_blocks_of_a_text_give_the_same_runs():
    text = ("Ab, cdé 9x--" * 40 + "z" * 50 + " . . ." + "end of it") * 3
    whole = sorted(b for _, f in resampling._runs(text.encode(), 3) for b in f)
    for block in (1, 7, 60):
        assert sorted(b for _, f in resampling._runs(text.encode(), 3, block) for b in f) == whole
    assert sorted(b % 10000 for b in whole) == sorted(plain_features(text)[1])


def test_odd_rows(spark):
    long = "word other thing " * 60_000
    rows = [(1, None), (2, ""), (3, " .,"), (4, "a b c " * 10), (4, "a b c " * 10), (None, "a b c " * 10), (5, long)]
    docs = spark.createDataFrame(rows, SCHEMA).selectExpr("*", "'x' AS weight", "1 AS score", "text AS id")
    found = resampling.draw(resampling.importance_weights(docs, docs), percent=50).collect()
    by = {(r["doc_id"], r["n_words"]): r for r in found}
    assert len(found) == 7 and by[1, 0]["weight"] == by[3, 0]["weight"] == by[2, 0]["n_features"] == 0
    assert by[5, 180_000]["n_features"] == 3 * 180_000 - 3
    # Four rows are long enough, two are drawn; equal rows tie and still get ranks of their own.
    assert sorted(r["rank"] for r in found if r["rank"]) == [1, 2]
    kept = resampling.resample(docs, docs, percent=50)
    assert kept.columns == docs.columns and kept.count() >= 1


@pytest.mark.parametrize("side", ["docs", "target"])
def test_empty_tables(spark, side):
    some, none = spark.createDataFrame([(1, "a b " * 12)], SCHEMA), spark.createDataFrame([], SCHEMA)
    docs, target = (none, some) if side == "docs" else (some, none)
    found = resampling.draw(resampling.importance_weights(docs, target), percent=100).collect()
    assert [r["rank"] for r in found] == ([] if side == "docs" else [1])


def test_copies_of_the_target_come_first(spark):
    rare = " ".join(f"q{i}" for i in range(40))
    docs = [(i, " ".join(f"w{(i * 7 + k) % 50}" for k in range(40))) for i in range(99)] + [(99, rare)]
    found = resampling.draw(resampling.importance_weights(spark.createDataFrame(docs, SCHEMA), spark.createDataFrame([(0, rare)], SCHEMA)))
    assert found.where("rank = 1").first()["doc_id"] == 99 and found.where("rank IS NOT NULL").count() == 5

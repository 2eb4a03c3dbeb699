"""Line dedup and source mixing."""

from collections import Counter

import duckdb
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from flowgauge.llm import lines, mixing, queries
from tests.llm import plain

LONG = "word " * 30_000 + "\n" + "the very same line\n" * 500


def _digests(df):
    kept = lines.dedup_lines(df).select(
        "doc_id", "n_lines", "n_dropped", F.sha2(F.col("kept_text").cast("binary"), 256)
    )
    return sorted((tuple(r) for r in kept.collect()), key=repr)


ROWS = [
    (1, "  The Very SAME line \nonly here, really\nshort"),
    (2, "the very same line\nshort\n\nthe very same line"),
    (2, "the very same line\nshort\n\nthe very same line"),
    (2, "another text of the same id\nthe very same line"),
    (3, None),
    (4, ""),
    (5, LONG),
    (None, "the very same line\nÉtude longue ici"),
    (6, "étude longue ici\nÉtude longue ici"),
    (7, "ÉTUDE LONGUE ICI\n\t\x0bÉtude longue ici\r"),
]


def test_lines_match_plain(spark):
    df = spark.createDataFrame(ROWS, "doc_id long, text string")
    assert _digests(df) == sorted(plain.dedup_lines(ROWS), key=repr)


@settings(max_examples=6, deadline=None)
@given(st.lists(st.lists(st.sampled_from(["Alpha beta gamma", "alpha BETA gamma ", "tiny", "", "delta epsilon zeta", " \t"]), max_size=5), max_size=6))
def test_lines_of_any_mix(spark, texts):
    rows = [(i, "\n".join(t)) for i, t in enumerate(texts)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert _digests(df) == sorted(plain.dedup_lines(rows), key=repr)


def test_lines_need_more_documents_when_asked(spark):
    rows = [(i, f"held by everyone here\nheld by two only {i // 2}") for i in range(4)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r["doc_id"]: r["kept_text"] for r in lines.dedup_lines(df, min_docs=3).collect()}
    assert got == {i: t if i == 0 else f"held by two only {i // 2}" for i, t in rows}


def test_lines_extra_columns_and_no_rows(spark):
    df = spark.createDataFrame([(1, "a line to keep", 7, "x")], "doc_id long, text string, pos int, hub string")
    assert lines.dedup_lines(df).columns == [*df.columns, "n_lines", "n_dropped", "kept_text"]
    assert lines.dedup_lines(df.limit(0)).count() == 0


def _mixed(spark, rows):
    df = spark.createDataFrame(rows, "doc_id long, source string, text string, key int")
    return mixing.mix_sources(df)


def test_mix_matches_plain(spark):
    rows = [(i, f"s{i % 4}" if i % 4 else None, "w " * (i * 7 % 90), i) for i in range(300)]
    rows += [(5, "s1", "tie tie", 0), (5, "s1", "tie tie", 0), (None, "s2", None, 1), (900, "big", "w " * 20_000, 1)]
    copies, target, total = plain.mixed([r[:3] for r in rows])
    got = Counter((r["doc_id"], r["source"], r["copies"]) for r in _mixed(spark, rows).collect())
    assert got == Counter((r[0], r[1], c) for r, c in zip(rows, copies, strict=True))
    for r in _mixed(spark, rows).select("source", "source_size", "target").distinct().collect():
        assert r["source_size"] == total[r["source"]] and r["target"] == pytest.approx(target[r["source"]])


def test_mix_of_nothing_and_of_empty_texts(spark):
    assert _mixed(spark, []).count() == 0
    got = _mixed(spark, [(1, "a", None, 0), (2, "a", " ", 0), (3, None, "", 0)]).collect()
    assert [(r["size"], r["target"], r["copies"]) for r in got] == [(0, 0.0, 0)] * 3


def test_emit_repeats_rows(spark):
    rows = [(i, "a" if i else "b", "one two three", 0) for i in range(40)]
    mixed = _mixed(spark, rows)
    out = mixing.emit(mixed, ["doc_id", "source", "text", "key"])
    assert Counter(r["doc_id"] for r in out.collect()) == Counter(
        {r["doc_id"]: r["copies"] for r in mixed.collect() if r["copies"]}
    )


@pytest.mark.parametrize("name", sorted(queries.SQL))
def test_queries_match_sql(spark, sf_dir, name):
    con = duckdb.connect()
    con.execute(f"create view documents as select * from '{sf_dir}/documents.parquet'")
    found = queries.QUERIES[name](spark, sf_dir)
    columns = sorted(found.columns)
    want = con.execute(f"select {', '.join(columns)} from ({queries.SQL[name]})").fetchall()
    assert sorted(tuple(r) for r in found.select(columns).collect()) == sorted(want)
    assert not [x for x in ("Python", "Pandas", "Arrow") if x in found._jdf.queryExecution().toString()]


def test_a_text_of_many_lines_is_split_once(spark):
    """Time follows the number of lines, not its square."""
    import time

    n = 30_000
    rows = [(1, "this line is common\n" + "x"), (2, "\n".join([*(f"line number {i} of many" for i in range(n)), "this line is common"]))]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    begun = time.monotonic()
    found = {r["doc_id"]: r for r in lines.dedup_lines(docs).collect()}
    assert time.monotonic() - begun < 30
    assert (found[2]["n_lines"], found[2]["n_dropped"]) == (n + 1, 1) and found[2]["kept_text"].endswith(f"line number {n - 1} of many")

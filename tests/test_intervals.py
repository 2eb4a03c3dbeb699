"""Ranges by dyadic pieces, positions by ranges, and node counts, against plain versions."""

import random

import pytest
from pyspark.sql import functions as F

from flowgauge.operators import capacity as K
from flowgauge.operators import intervals as I
from flowgauge.operators import ordered as O
from flowgauge.operators import rollup as R


def test_pieces_cover_a_range_once(spark):
    rng = random.Random(1)
    ends = [(a, a + rng.randrange(0, 70)) for a in range(-20, 90)] + [(5, 4), (0, 0), (0, 63), (1, 64)]
    df = spark.createDataFrame(ends, "lo bigint, hi bigint").select("lo", "hi", I.dyadic_pieces("lo", "hi").alias("p"))
    for lo, hi, pieces in df.collect():
        covered = sorted(x for p in pieces or [] for x in range(p["block"] << p["level"], (p["block"] + 1) << p["level"]))
        assert covered == list(range(lo, hi + 1))


def test_a_long_range_has_few_pieces(spark):
    sizes = spark.createDataFrame([(1, 10_000_000), (123_456, 10_123_455)], "lo bigint, hi bigint")
    assert all(r[0] <= 48 for r in sizes.select(F.size(I.dyadic_pieces("lo", "hi"))).collect())
    executors = sizes.select(F.col("lo").alias("executor"), F.lit("c").alias("component"), F.col("lo").alias("start_task"), F.col("hi").alias("end_task"))
    load = spark.createDataFrame([(1, 5), (9_999_999, 6), (10_050_000, 7), (0, 8), (None, 9)], "task_id bigint, load bigint")
    got = sorted((r["task_id"], r["executor"]) for r in R.executor_of_task(load, executors).collect())
    assert got == [(1, 1), (9_999_999, 1), (9_999_999, 123_456), (10_050_000, 123_456)]


def test_overlapping_ranges(spark):
    rng = random.Random(3)
    ranges = [(i, f"c{i % 3}", a := rng.randrange(60), a + rng.randrange(-2, 25)) for i in range(25)]
    executors = spark.createDataFrame(ranges, "executor int, component string, start_task int, end_task int")
    load = [(rng.randrange(-3, 90), i) for i in range(200)]
    rows = R.executor_of_task(spark.createDataFrame(load, "task_id int, load int"), executors)
    expected = sorted((t, v, e) for t, v in load for e, _, a, b in ranges if a <= t <= b)
    assert sorted((r["task_id"], r["load"], r["executor"]) for r in rows.collect()) == expected
    bounds = spark.createDataFrame([("x", 5, 40), ("y", 0, 90), ("z", 9, 8)], "component string, min_task int, max_task int")
    inside = R.executors_in_component(executors, bounds).collect()
    assert sorted((r["component"], r["executor"]) for r in inside) == sorted(
        (n, e) for n, lo, hi in (("x", 5, 40), ("y", 0, 90)) for e, _, a, b in ranges if lo <= a <= hi and b <= hi
    )


def test_positions_of_bunched_rows(spark):
    """All rows at one time: the ties part them, no partition holds a few times the mean."""
    rng = random.Random(5)
    rows = [(7 if i % 10 else rng.randrange(20), f"f{i % 3}", i) for i in range(4000)]
    rng.shuffle(rows)
    df = spark.createDataFrame(rows, "ts_ms bigint, file string, pos int").repartition(6)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        placed = O.range_position(df, ["ts_ms", "file", "pos"], name="position")
        sizes = [r[0] for r in placed.groupBy(F.spark_partition_id()).count().select("count").collect()]
        got = placed.collect()
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert [tuple(r)[:3] for r in got] == sorted(rows) and [r["position"] for r in got] == list(range(4000))
    assert max(sizes) <= 3 * 4000 / 4
    assert O.range_position(df.limit(0), ["ts_ms"]).count() == 0


@pytest.mark.parametrize("seed", range(4))
def test_fewest_nodes_is_the_least_that_fits(spark, seed):
    rng = random.Random(seed)
    executors = [(i // 2, rng.randrange(1, 40)) for i in range(rng.randrange(1, 60))]
    hosts = [(f"h{i:02}", rng.randrange(1, 4), 100) for i in range(rng.randrange(1, 13))]
    load = spark.createDataFrame(executors, "start_task bigint, load bigint")
    node = spark.createDataFrame(hosts, "hostname string, core_count int, core_speed bigint")
    dealt = sorted(executors)
    peaks = {
        n: max(sum(v for _, v in dealt[k::n]) / (hosts[k][1] * hosts[k][2]) for k in range(min(n, len(dealt))))
        for n in range(1, len(hosts) + 1)
    }
    found = {r["node_count"]: r["peak"] for r in K.sizing_whatif(load, node).collect()}
    assert found == pytest.approx(peaks)
    for limit in (0.05, 0.4, 0.65, 3.0):
        fits = [n for n, peak in peaks.items() if peak <= limit]
        assert K.fewest_nodes(load, node, limit=limit).first()[0] == (min(fits) if fits else len(hosts))
    assert K.fewest_nodes(load.limit(0), node).first()[0] is None

"""Ordered scans, ranges and configuration lines at their edges."""

import random

import pytest
from pyspark.sql import functions as F

from flowgauge.operators import capacity as K
from flowgauge.operators import ordered
from flowgauge.operators import rollup as R
from flowgauge.sources import readers as SRC


@pytest.mark.parametrize("width", [1, 3, 10, 1000])
def test_scan_matches_a_loop_with_null_keys_and_ties(spark, width):
    rng = random.Random(width)
    rows = [(rng.choice([None, "a", "b"]), rng.choice([None, 1]), rng.randrange(40), i, rng.randrange(9)) for i in range(150)]
    df = spark.createDataFrame(rows, "k string, j int, at bigint, no int, v int")
    got = ordered.scan(
        df, ["k", "j"], "at", totals={"total": ("sum", "v"), "n": ("count", "at")}, lags={"last": "v"}, tie=["no"], width=width
    )
    want, state = {}, {}
    for k, j, at, no, v in sorted(rows, key=lambda r: (r[2], r[3])):
        total, n, last = state.get((k, j), (0, 0, None))
        want[no] = (total + v, n + 1, last)
        state[k, j] = (total + v, n + 1, v)
    assert {r["no"]: (r["total"], r["n"], r["last"]) for r in got.collect()} == want


def test_ranges_of_many_logs_are_spread(spark):
    bounds = spark.range(1000).select("id", F.lit(0).cast("bigint").alias("lo"), F.lit(99).cast("bigint").alias("hi"))
    rows = ordered.integer_range(bounds, "lo", "hi", "second")
    # Which partition a log's rows are dealt to; coalescing for the test's few cores comes later.
    tasks = rows.select("id", F.pmod(F.hash("id", F.lit(0).cast("bigint")), F.lit(16)).alias("task"))
    assert rows.count() == 100_000 and tasks.groupBy("task").count().agg(F.max("count")).first()[0] < 15_000
    assert "hashpartitioning(id" in rows._jdf.queryExecution().executedPlan().toString()


def test_more_executors_than_tasks(spark):
    bounds = spark.createDataFrame([("a", 10, 11, 3), ("b", 20, 26, 3)], "component string, min_task int, max_task int, parallelism int")
    split = K.split_tasks(bounds)
    assert split.count() == 6
    opened = R.executor_tasks(split.withColumn("executor", F.concat("component", "executor_no")))
    assert sorted(r["task_id"] for r in opened.collect()) == [10, 11, *range(20, 27)]


def test_a_repeated_key_keeps_its_last_line(spark):
    text = ["spout0 = s,1", "bolt0 = a,1", "bolt0 = b,2", "bolt1 = c,3", "bolt2 = d,4", "bolt4 = far,1", "edge0 = s,b"]
    lines = spark.createDataFrame(list(enumerate(text)), "line_no int, text string")
    components, _, edges = SRC.parse_topology_config(lines)
    assert {(r["component"], r["parallelism"]) for r in components.collect()} == {("s", 1), ("b", 2), ("c", 3), ("d", 4)}
    assert [(r["src"], r["dst"]) for r in edges.collect()] == [("s", "b")]


@pytest.mark.parametrize("gap, slab_ms, bits", [(1000, 700, 1), (50, 400, 2), (1000, 5000, 1), (3000, 500, 6)])
def test_steps_compose_over_a_tree(spark, monkeypatch, gap, slab_ms, bits):
    """Small blocks make several levels; the accepted readings stay those of a walk through time."""
    from flowgauge.operators import cpu as C

    monkeypatch.setattr(C, "_FAN_BITS", bits)
    rng = random.Random(gap + slab_ms)
    rows, expected = [], []
    for task in range(3):
        ts, last = rng.randrange(10**6), None
        for i in range(250):
            ts += rng.choice([0, 1, 40, 333, 999, 1000, 1001, 9000])
            rows.append((task, ts, 1000 * i + task))
    first = {}
    for task, ts, ns in rows:
        first[task, ts] = min(ns, first.get((task, ts), ns))
    for task in range(3):
        last, before = None, 0
        for (own, ts), ns in sorted(first.items()):
            if own == task and (last is None or ts >= last + gap):
                expected.append((task, ts, ns, ns - before))
                last, before = ts, ns
    df = spark.createDataFrame(rows, "task_id int, ts_ms bigint, cpu_ns bigint")
    got = C.accepted_readings(df, gap_ms=gap, slab_ms=slab_ms).collect()
    assert sorted(map(tuple, got)) == expected

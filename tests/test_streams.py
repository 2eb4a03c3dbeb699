"""Streams fed file by file give what the batch operators give."""

import random
import time

import pytest
from pyspark.sql import functions as F

from flowgauge.operators import cpu as C
from flowgauge.runtime import scratch_path
from flowgauge.sources import state as ST
from flowgauge.sources import writers as SNK
from flowgauge.streaming import keyed as KS
from flowgauge.streaming import streams as L


def in_files(spark, df, order, n):
    """Store ``df`` as ``n`` files in ``order`` and stream one file per micro-batch.

    Rows that tie on ``order`` stay in one file. The stream takes files by age.
    """
    path = scratch_path(spark, "test-stream")
    values = sorted(r[0] for r in df.select(order).distinct().collect())
    for i in range(n):
        part = values[i * len(values) // n : (i + 1) * len(values) // n]
        inside = F.col(order).between(F.lit(part[0]), F.lit(part[-1]))
        df.filter(inside).coalesce(1).write.mode("append").parquet(path)
        time.sleep(0.05)
    return spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(path)


def run(spark, stream, mode):
    path = scratch_path(spark, "test-out")
    L.run_updates(stream, path, output_mode=mode).awaitTermination()
    return L.read_updates(spark, path)


def plain(df):
    return sorted(tuple(r) for r in df.collect())


@pytest.fixture(scope="module")
def tuples(spark):
    rng = random.Random(1)
    rows = [
        (1_700_000_000 + i // 10, rng.randrange(3), rng.randrange(-1, 3), "ab"[i % 2], rng.randrange(50))
        for i in range(600)
    ]
    df = spark.createDataFrame(
        rows, "s bigint, task_id int, source_task_id int, stream string, latency_ms bigint"
    )
    return df.withColumn("ts", F.timestamp_seconds("s")).drop("s")


def test_windowed_streams(spark, tuples):
    stream = in_files(spark, tuples, "ts", 3)
    keys = ["bucket", "task_id", "source_task_id"]
    got = L.final_values(run(spark, L.traffic_stream(stream), "update"), keys)
    assert plain(got.select(*keys, "traffic")) == plain(L.traffic_stream(tuples).select(*keys, "traffic"))
    keys = ["bucket", "task_id"]
    got = L.final_values(run(spark, L.latency_stream(stream), "update"), keys)
    assert plain(got.select(*keys, "n")) == plain(L.latency_stream(tuples).select(*keys, "n"))


def test_tuple_sizes(spark, tuples):
    stream = in_files(spark, tuples, "ts", 3)
    got = L.final_values(
        run(spark, L.tuple_size_stream(stream, ["stream"]), "update"), ["task_id", "stream"]
    )
    assert plain(got) == plain(L.tuple_size_stream(tuples, ["stream"]))


def shuffled(spark, readings, key, files, seed):
    """Readings dealt to files at random, and the one that ends the stream in a file of its own."""
    spread = readings.withColumn("file", F.pmod(F.xxhash64(F.lit(seed), *readings.columns), F.lit(files)))
    closing = KS.closing_reading(readings, key).withColumn("file", F.lit(files).cast("bigint"))
    return in_files(spark, spread.unionByName(closing), "file", files + 1)


@pytest.mark.parametrize("seed", [1, 2])
def test_cycles_in_any_order_of_arrival(spark, seed):
    rng, rows = random.Random(2), []
    for task in "ab":
        ts = cpu = 0
        for _ in range(300):
            ts += rng.choice([0, 3, 400, 999, 1000, 2500])
            cpu += rng.randrange(10**6)
            rows.append((task, ts, cpu))
    df = spark.createDataFrame(rows, "task_id string, ts_ms bigint, cpu_ns bigint")
    with KS.keyed_state(spark):
        stream = KS.load_stream(shuffled(spark, df, "task_id", 4, seed), speed_hz=5_000_000_000, cores=2)
        out = run(spark, stream, "append")
    got = plain(out.select("task_id", "ts_ms", "cycles"))
    assert got == plain(C.task_cycles(df, speed_hz=5_000_000_000, cores=2, slab_ms=7000))
    assert KS.sum_buckets(out).agg(F.sum("load")).first()[0] == sum(c for _, _, c in got)


def test_rolling_cpu_in_any_order_of_arrival(spark):
    rng, rows = random.Random(3), []
    for host in "xy":
        cpu = 0
        for i in range(30):
            cpu += rng.randrange(1, 5 * 10**9)
            rows.append((host, i * 10_000, cpu, 2))
    df = spark.createDataFrame(rows, "host string, ts_ms bigint, cpu_ns bigint, cores int")
    with KS.keyed_state(spark):
        out = run(spark, KS.cpu_stream(shuffled(spark, df, "host", 4, 5)), "append")
    assert plain(out.drop("epoch")) == plain(C.rolling_cpu(df))


def test_rows_beyond_the_watermark_are_counted(spark):
    """A sample out of order inside the watermark counts in its place; one beyond it is dropped and counted."""
    ns = 10**9
    samples = [("h", 0, ns, 1), ("h", 20_000, 5 * ns, 1), ("h", 10_000, 2 * ns, 1), ("h", 40_000, 7 * ns, 1)]
    late = [("h", 5_000, ns, 1)]
    schema = "host string, ts_ms bigint, cpu_ns bigint, cores int"
    on_time = spark.createDataFrame(samples, schema)
    batches = [(*r, i) for i, r in enumerate(samples)] + [("h", 41_000, None, None, 4)] + [(*r, 5) for r in late]
    batches += [("h", 200_000, None, None, 6)]
    stream = in_files(spark, spark.createDataFrame(batches, schema + ", file int"), "file", 7)
    path = scratch_path(spark, "late")
    with KS.keyed_state(spark):
        query = L.run_updates(KS.cpu_stream(stream, watermark="15 seconds"), path, output_mode="append")
        query.awaitTermination()
    rows = L.read_updates(spark, path).drop("epoch")
    assert plain(rows) == plain(C.rolling_cpu(on_time)) and all(p >= 0 for _, _, p, _ in plain(rows))
    assert KS.late_rows(query) == len(late)


def test_sizes_are_published_once_a_while(spark, tuples):
    """Three micro-batches inside the pause give one report for each key, with whole sums."""
    path = scratch_path(spark, "sizes")
    stream = in_files(spark, tuples, "ts", 3)
    with KS.keyed_state(spark):
        reports = KS.size_reports(stream, ["stream"], every="15 seconds")
        query = L.run_updates(reports, path, trigger={"processingTime": "0 seconds"})
        end, fed = time.time() + 90, 0
        expected = plain(L.tuple_size_stream(tuples, ["stream"]))
        # Timers make batches without data as well, so the query is never idle.
        while time.time() < end and (fed < 3 or L.read_updates(spark, path).count() < len(expected)):
            time.sleep(0.5)
            fed = max(fed, len([p for p in query.recentProgress if p.numInputRows]))
        query.stop()
    assert fed == 3
    assert plain(L.read_updates(spark, path).drop("epoch")) == expected


def test_latest_state_rewrites_only_what_a_batch_touches(spark):
    rng = random.Random(4)
    rows = [(rng.randrange(200), i, i * 7) for i in range(1000)] + [(3, 2000, 1), (3, 2000, 0)]
    df = spark.createDataFrame(rows, "k int, ts bigint, v int")
    stream = in_files(spark, df.withColumn("file", F.when(F.col("ts") == 2000, 3).otherwise(F.col("ts") % 3)), "file", 4)
    path = scratch_path(spark, "state")
    L.latest_state_stream(stream.drop("file"), path, ["k"], buckets=8).awaitTermination()
    assert plain(L.latest_state(spark, path).select("k", "ts", "v")) == plain(SNK.newest_per_key(df, ["k"], ["ts"]))
    assert ST.state_versions(spark, path) == [2, 3]  # however many batches there were
    before, after = (ST.manifest(spark, path, v) for v in (2, 3))
    assert [b for b in after if after[b] != before[b]] == [b for b, v in after.items() if v == 3] and len(after) == 8
    assert sum(v == 3 for v in after.values()) == 1


def test_state_versions_can_be_retried(spark):
    def rows(*values):
        return spark.createDataFrame(list(values), "k int, ts bigint, v string")

    path = scratch_path(spark, "state")
    ST.apply_rows(rows((1, 1, "a"), (2, 5, "b"), (None, 1, "n")), path, ["k"], 0, buckets=4)
    for _ in range(2):  # tried again after it was stored
        ST.apply_rows(rows((1, 1, "c"), (2, 4, "old"), (3, 1, "d")), path, ["k"], 1, buckets=4)
    whole = {(1, 1, "c"), (2, 5, "b"), (3, 1, "d"), (None, 1, "n")}

    def stored(version=None):
        return [tuple(r) for r in ST.read_state(spark, path, version).collect()]

    assert len(stored()) == 4 and set(stored()) == whole
    assert len(stored(0)) == 3  # a reader of the version before
    assert ST.apply_rows(rows().limit(0), path, ["k"], 2, buckets=4) == []
    assert ST.state_versions(spark, path) == [1, 2]
    assert set(stored()) == whole


def test_snapshots_go_on_while_no_data_comes(spark):
    table = spark.createDataFrame([(1, "a")], "k int, v string")
    path = scratch_path(spark, "snaps")

    def run_for(snapshots):
        query = L.snapshot_stream(path, lambda: table, spark=spark, every="1 second")
        end = time.time() + 60
        while time.time() < end and not (query.lastProgress and query.lastProgress.batchId >= snapshots):
            time.sleep(0.1)
        query.stop()

    run_for(2)
    time.sleep(4)
    run_for(4)  # after a restart numbers go on, and the pause is counted
    got = L.read_updates(spark, path).select("snapshot_id", "beat", "missed", "k", "v").orderBy("snapshot_id").collect()
    assert [r["snapshot_id"] for r in got] == list(range(len(got))) and len(got) >= 4
    assert all(a["beat"] <= b["beat"] for a, b in zip(got, got[1:])) and max(r["missed"] for r in got) >= 2
    assert {(r["k"], r["v"]) for r in got} == {(1, "a")}


def test_rewritten_batch_is_not_counted_twice(spark, tuples):
    path = scratch_path(spark, "test-retry")
    for _ in range(2):
        tuples.write.mode("overwrite").parquet(f"{path}/data/epoch=0")
    assert L.read_updates(spark, path).count() == tuples.count()

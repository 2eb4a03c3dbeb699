"""Whole runs, several applications at once, and edge cases."""

import pytest
from pyspark.sql import functions as F

from flowgauge.operators import capacity as K
from flowgauge.operators import propagate as G
from flowgauge.operators import rollup as R
from flowgauge.operators import selectivity as A
from flowgauge.operators import series as E
from flowgauge.plans.adapters import Telemetry
from flowgauge.plans.profile import Tables, assess, profile


@pytest.fixture(scope="module")
def tables(spark, sf_dir):
    t = Telemetry(spark, sf_dir)
    return Tables(t.components, t.tasks, t.edges, t.traffic, t.load, t.worker, t.node, t.tuplesize)


def test_profile_and_assess(spark, sf_dir, tables):
    done = profile(tables, max_traffic=35220, factor=20, max_epochs=200)
    assert done.mean_selectivity.count() == 10
    assert done.max_traffic.count() == 10
    assert done.component_models.count() == 5
    assert done.worker_model.count() == 1
    assert done.tuple_size.count() == 10
    executors = Telemetry(spark, sf_dir).executors
    running = executors.select(
        F.col("executor").alias("component"), "executor", "start_task", "end_task"
    )
    target = tables.components.select("component", F.lit(2).alias("parallelism"))
    plan = assess(tables, done, running, target=target, current_nodes=9).collect()
    assert {r["item"] for r in plan} == {"nodes", "parallelism"}
    assert all(r["target"] == 2 for r in plan if r["item"] == "parallelism")
    node = next(r for r in plan if r["item"] == "nodes")
    assert 1 <= node["target"] <= 4


def test_two_applications_stay_apart(spark):
    def app(rows, schema):
        one = spark.createDataFrame(rows, schema)
        return one.withColumn("topology_id", F.lit("x")).unionByName(
            one.withColumn("topology_id", F.lit("y"))
        )

    components = app([("s", "spout"), ("b", "bolt")], "component string, kind string")
    tasks = app([("s", 1), ("b", 2)], "component string, task_id int")
    edges = app([("s", "b")], "src string, dst string")
    traffic = app([(0, 1, 2, 5), (1, 1, 2, 7), (2, 1, 2, 0)],
                  "snapshot_id int, source_task_id int, destination_task_id int, traffic int")
    # The second application runs at double rate and one snapshot longer.
    more = spark.createDataFrame([("y", 3, 1, 2, 11)],
                                 "topology_id string, snapshot_id int, source_task_id int, destination_task_id int, traffic int")
    traffic = traffic.withColumn(
        "traffic", F.when(F.col("topology_id") == "y", F.col("traffic") * 2).otherwise(F.col("traffic"))
    ).unionByName(more)
    weights = R.edge_traffic(traffic, tasks, edges)
    got = {(r["topology_id"], r["snapshot_id"]): r["weight"] for r in weights.collect()}
    assert got == {("x", 0): 5, ("x", 1): 7, ("x", 2): 0,
                   ("y", 0): 10, ("y", 1): 14, ("y", 2): 0, ("y", 3): 11}
    alfa = A.edge_selectivity(weights, components)
    per = {(r["topology_id"], r["snapshot_id"]): r["alfa"] for r in alfa.collect()}
    assert per == {("x", 1): 1.0, ("x", 2): 1.0, ("y", 1): 1.0, ("y", 2): 1.0, ("y", 3): 0.0}
    peak = G.propagate_max_traffic(edges, A.mean_selectivity(alfa), components, 9.0)
    assert [r["max_traffic"] for r in peak.collect()] == [9.0, 9.0]


def test_two_logs_have_their_own_start(spark):
    log = spark.createDataFrame(
        [("x", 5000, 1), ("x", 7500, 1), ("y", 100, 1), ("y", 1100, 1)],
        "topology_id string, ts_ms bigint, latency_ns bigint",
    )
    got = {(r["topology_id"], r["second"]): r["n"] for r in E.throughput_per_second(log).collect()}
    assert got == {("x", 0): 1, ("x", 1): None, ("x", 2): 1, ("y", 0): 2}


def test_selectivity_corners(spark):
    """No input divides by 1; a silent spout has ratio 0."""
    weights = spark.createDataFrame(
        [(s, a, b, w) for s in (0, 1) for a, b, w in (("s", "m", 0), ("m", "t", 6))],
        "snapshot_id int, src string, dst string, weight bigint",
    )
    components = spark.createDataFrame(
        [("s", "spout"), ("m", "bolt"), ("t", "bolt")], "component string, kind string"
    )
    got = {(r["src"], r["dst"]): r["alfa"] for r in A.edge_selectivity(weights, components).collect()}
    assert got == {("s", "m"): 0.0, ("m", "t"): 6.0}


def test_empty_inputs(spark):
    log = spark.createDataFrame([], "ts_ms bigint, latency_ns bigint")
    assert E.latency_per_second(log).count() == 0
    reports = spark.createDataFrame([], "row_id bigint, second bigint")
    assert E.peak_second(E.reports_per_second(reports)).count() == 0
    traffic = spark.createDataFrame(
        [], "snapshot_id int, source_task_id int, destination_task_id int, traffic bigint"
    )
    tasks = spark.createDataFrame([("a", 1)], "component string, task_id int")
    edges = spark.createDataFrame([("a", "a")], "src string, dst string")
    assert R.edge_traffic(traffic, tasks, edges).count() == 0


def test_listed_hosts_are_all_reported(spark):
    traffic = spark.createDataFrame(
        [(1, 1, 2, 5)], "snapshot_id int, source_task_id int, destination_task_id int, traffic bigint"
    )
    load = spark.createDataFrame(
        [(0, 2, "h1", 7), (1, 2, "h1", 9)],
        "snapshot_id int, task_id int, worker_hostname string, load bigint",
    )
    worker = spark.createDataFrame([(1, "h1", 1, 0, 40)], "snapshot_id int, hostname string, port int, ts int, cpu_usage int")
    hosts = spark.createDataFrame([("h1",), ("h2",)], "host string")
    got = sorted(tuple(r) for r in R.worker_points(traffic, load, worker, hosts).collect())
    assert got == [(0, "h1", 0, 0, 7, 0), (0, "h2", 0, 0, 0, 0), (1, "h1", 5, 0, 9, 40), (1, "h2", 0, 0, 0, 0)]
    into = sorted(tuple(r) for r in R.worker_traffic(traffic, load, "in", hosts).collect())
    assert into == [(0, "h1", 0), (0, "h2", 0), (1, "h1", 5), (1, "h2", 0)]


def test_one_event(spark):
    log = spark.createDataFrame([(77, 3_000_000)], "ts_ms bigint, latency_ns bigint")
    assert [tuple(r) for r in E.latency_per_second(log).collect()] == [(0, 3)]


def test_idle_allocation_is_not_meaningful(spark):
    place = spark.createDataFrame([(0, 1, "x", 1)], "allocation_id int, executor int, hostname string, port int")
    load = spark.createDataFrame([(1, 0)], "executor int, load bigint")
    pairs = spark.createDataFrame([], "src_executor int, dst_executor int, traffic bigint")
    node = spark.createDataFrame([("x", 2, 100)], "hostname string, core_count int, core_speed bigint")
    got = K.placement_meaningful(
        K.placement_score(K.node_load_stats(place, load, node), K.placement_traffic_split(place, pairs))
    ).first()
    assert (got["score"], got["meaningful"], got["reason"]) == (0.0, False, K.MEANINGFUL_NO)


def test_no_node_count_is_enough(spark):
    load = spark.createDataFrame([(1, 1000), (2, 1000)], "start_task int, load bigint")
    node = spark.createDataFrame([("a", 1, 10), ("b", 1, 10)], "hostname string, core_count int, core_speed bigint")
    whatif = K.sizing_whatif(load, node)
    assert [r["ok"] for r in whatif.collect()] == [False, False]
    assert K.min_nodes(whatif).first()["nodes"] == 2

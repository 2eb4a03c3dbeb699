"""Placement quality and cluster sizing, as queries over tables."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from flowgauge.functions.scalars import normalise
from flowgauge.operators.filters import node_capacity
from flowgauge.operators.models import component_net, worker_net
from flowgauge.operators.ordered import dense_position
from flowgauge.operators.rollup import (
    cluster_capacity,
    cluster_totals,
    executor_latest_load,
    executor_traffic,
    scope,
    zero_if_null,
)
from flowgauge.runtime import cut_lineage

# The texts that say whether a placement can be judged.
MEANINGFUL_YES = "meaningful: yes"
MEANINGFUL_NO = "meaningful: no because both mean load and total traffic are zero"


# --- executors -------------------------------------------------------------------


def executor_weight(
    load: DataFrame, traffic: DataFrame, executors: DataFrame, *, alfa: float = 0.5
) -> DataFrame:
    """Share of total load and total traffic, mixed by ``alfa``; a zero total adds 0."""
    keys = [*scope(load, traffic, executors), "executor"]
    totals = cluster_totals(load, traffic, executors)
    total_load = totals.select("total_load").scalar()
    total_traffic = totals.select("total_traffic").scalar()
    both = executor_latest_load(load, executors).join(executor_traffic(traffic, executors), keys)

    def share(column: str, total: Column) -> Column:
        return F.coalesce(F.try_divide(F.col(column).cast("double"), total), F.lit(0.0))

    return both.select(
        *keys,
        "load",
        "traffic",
        (alfa * share("load", total_load) + (1 - alfa) * share("traffic", total_traffic)).alias(
            "weight"
        ),
    )


def executors_by_weight(weights: DataFrame) -> DataFrame:
    """Heaviest first, with ``position``; the executor id settles ties.

    One row per executor of the running applications, so one sort is enough.
    """
    order = [F.desc("weight"), *scope(weights), "executor"]
    return weights.withColumn("position", F.row_number().over(W.orderBy(*order)) - 1).orderBy("position")


def split_tasks(components: DataFrame) -> DataFrame:
    """Spread ``min_task..max_task`` of each component over ``parallelism`` executors.

    The first ``size mod parallelism`` executors take one task more.
    """
    n = F.col("parallelism")
    width = F.col("max_task") - F.col("min_task") + 1
    i = F.col("executor_no")
    opened = components.withColumns(
        {
            "__each": F.floor(width / n).cast("int"),
            "__more": (width % n).cast("int"),
            "executor_no": F.explode(F.sequence(F.lit(0), n - 1)),
        }
    )
    start = F.col("min_task") + i * F.col("__each") + F.least(i, F.col("__more"))
    extra = F.when(i < F.col("__more"), F.lit(1)).otherwise(F.lit(0))
    return opened.select(
        *scope(components),
        "component",
        "executor_no",
        start.alias("start_task"),
        (start + F.col("__each") + extra - 1).alias("end_task"),
    )


# --- nodes and workers -----------------------------------------------------------


def cluster_nodes(node: DataFrame, supervisors: DataFrame) -> DataFrame:
    """Nodes with a supervisor and their speed."""
    return node_capacity(node).join(supervisors.select("host").distinct(), "host")


def nodes_without_supervisor(node: DataFrame, supervisors: DataFrame) -> DataFrame:
    return node_capacity(node).join(supervisors, "host", "left_anti")


def free_workers(workers: DataFrame, placements: DataFrame) -> DataFrame:
    """Workers that hold no executor."""
    return workers.join(placements, ["hostname", "port"], "left_anti")


def free_worker_counts(workers: DataFrame, placements: DataFrame) -> DataFrame:
    """Free workers per host, 0 for a full host."""
    free = free_workers(workers, placements).groupBy("hostname").agg(F.count(F.lit(1)).alias("free"))
    return (
        workers.select("hostname").distinct().join(free, "hostname", "left")
        .withColumn("free", zero_if_null("free"))
    )


def remaining_workers(workers: DataFrame, used: DataFrame) -> DataFrame:
    return workers.select("hostname", "port").exceptAll(used.select("hostname", "port").distinct())


def unallocated_executors(executors: DataFrame, placements: DataFrame) -> DataFrame:
    keys = [*scope(executors, placements), "executor"]
    return executors.join(placements, keys, "left_anti")


def current_placement(
    assignments: DataFrame, workers: DataFrame, executors: DataFrame
) -> DataFrame:
    """Assigned start tasks as executors on workers; unassigned executors give no rows."""
    keys = [*scope(assignments, executors), "start_task"]
    return (
        assignments.join(workers, ["node_id", "port"])
        .join(executors, keys)
        .select(*keys, "executor", "component", "hostname", "port")
    )


# --- placement quality -----------------------------------------------------------


def positive_traffic(placed: DataFrame) -> DataFrame:
    return placed.filter(F.col("traffic") > 0)


def placed_traffic(placements: DataFrame, pair_traffic: DataFrame) -> DataFrame:
    """Executor traffic with both ends placed, and how far it travels."""
    keys = scope(placements, pair_traffic)
    place = placements.select(*keys, "allocation_id", "executor", "hostname", "port")
    src = place.withColumnsRenamed(
        {"executor": "src_executor", "hostname": "src_host", "port": "src_port"}
    )
    dst = place.withColumnsRenamed(
        {"executor": "dst_executor", "hostname": "dst_host", "port": "dst_port"}
    )
    joined = pair_traffic.join(src, [*keys, "src_executor"]).join(
        dst, [*keys, "allocation_id", "dst_executor"]
    )
    span = (
        F.when(F.col("src_host") != F.col("dst_host"), F.lit("node"))
        .when(F.col("src_port") != F.col("dst_port"), F.lit("slot"))
        .otherwise(F.lit("local"))
    )
    return positive_traffic(joined).select(
        *keys, "allocation_id", "src_executor", "dst_executor", "traffic", span.alias("span")
    )


def placement_traffic_split(placements: DataFrame, pair_traffic: DataFrame) -> DataFrame:
    """Total, inter-node and inter-slot traffic per allocation."""

    def across(span: str) -> Column:
        return F.sum(F.when(F.col("span") == span, F.col("traffic")).otherwise(F.lit(0)))

    sums = placed_traffic(placements, pair_traffic).groupBy("allocation_id").agg(
        F.sum("traffic").alias("total_traffic"),
        across("node").alias("inter_node"),
        across("slot").alias("inter_slot"),
    )
    return (
        placements.select("allocation_id")
        .distinct()
        .join(sums, "allocation_id", "left")
        .select(
            "allocation_id",
            *[zero_if_null(c).alias(c) for c in ("total_traffic", "inter_node", "inter_slot")],
        )
    )


def node_load_stats(placements: DataFrame, exec_load: DataFrame, node: DataFrame) -> DataFrame:
    """Mean and sample deviation of node load over speed, idle nodes included as 0.

    Idle nodes enter through their count, by combining the moments of the loaded
    nodes with those of the zeros, so allocations are never multiplied by nodes.
    """
    keys = [*scope(placements, exec_load), "executor"]
    loaded = (
        placements.join(exec_load.select(*keys, "load"), keys)
        .groupBy("allocation_id", F.col("hostname").alias("host"))
        .agg(F.sum("load").alias("load"))
        .join(node_capacity(node), "host")
        .withColumn("share", F.col("load").cast("double") / F.col("speed"))
    )
    moments = loaded.groupBy("allocation_id").agg(
        F.count("share").alias("m"), F.avg("share").alias("mu"), F.var_pop("share").alias("v")
    )
    n = node.agg(F.count(F.lit(1))).scalar()
    m, mu = F.col("m"), F.col("mu")
    square = F.col("v") * m + mu * mu * m * (n - m) / n
    return moments.select(
        "allocation_id",
        (mu * m / n).alias("mean_load"),
        F.coalesce(F.sqrt(F.try_divide(square, n - 1)), F.lit(0.0)).alias("stddev_load"),
    )


def placement_score(
    stats: DataFrame, split: DataFrame, *, alfa: float = 0.5, beta: float = 0.5
) -> DataFrame:
    """Distance from a placement with equal loads and no traffic between workers."""

    def part(a: Column, b: Column) -> Column:
        return F.when(b > 0, a.cast("double") / b).otherwise(F.lit(0.0))

    load_term = F.pow(alfa * part(F.col("stddev_load"), F.col("mean_load")), 2)
    total = F.col("total_traffic")
    moved = beta * part(F.col("inter_node"), total) + (1 - beta) * part(F.col("inter_slot"), total)
    return stats.join(split, "allocation_id").select(
        *stats.columns,
        *[c for c in split.columns if c != "allocation_id"],
        F.sqrt(load_term + F.pow((1 - alfa) * moved, 2)).alias("score"),
    )


def placement_meaningful(scores: DataFrame) -> DataFrame:
    """Whether a score says anything, with the reason as text."""
    known = (F.col("mean_load") > 0) | (F.col("total_traffic") > 0)
    return scores.withColumns(
        {
            "meaningful": known,
            "reason": F.when(known, F.lit(MEANINGFUL_YES)).otherwise(F.lit(MEANINGFUL_NO)),
        }
    )


def placement_constraints(
    placements: DataFrame, executors: DataFrame, topologies: DataFrame
) -> DataFrame:
    """Used workers against the request, and whether each worker serves one application.

    ``placements`` and ``executors`` carry ``topology_id``; ``topologies`` has
    ``requested_workers``.
    """
    slots = placements.select("allocation_id", "topology_id", "hostname", "port").distinct()
    used = slots.groupBy("allocation_id", "topology_id").agg(F.count(F.lit(1)).alias("used_workers"))
    shared = (
        slots.groupBy("allocation_id", "hostname", "port")
        .agg(F.count(F.lit(1)).alias("tenants"))
        .groupBy("allocation_id")
        .agg((F.max("tenants") == 1).alias("exclusive_ok"))
    )
    sizes = executors.groupBy("topology_id").agg(F.count(F.lit(1)).alias("executors"))
    required = topologies.join(sizes, "topology_id").select(
        "topology_id", F.least("requested_workers", "executors").alias("required_workers")
    )
    return (
        used.join(required, "topology_id")
        .join(shared, "allocation_id")
        .select(
            "allocation_id",
            "topology_id",
            "used_workers",
            "required_workers",
            (F.col("used_workers") == F.col("required_workers")).alias("workers_ok"),
            "exclusive_ok",
        )
    )


def best_placement(scores: DataFrame, constraints: DataFrame) -> DataFrame:
    """Lowest score among meaningful placements that keep every constraint."""
    kept = constraints.groupBy("allocation_id").agg(
        F.bool_and(F.col("workers_ok") & F.col("exclusive_ok")).alias("ok")
    )
    usable = (
        placement_meaningful(scores)
        .filter("meaningful")
        .join(kept.filter("ok"), "allocation_id", "left_semi")
    )
    return (
        usable.agg(F.min(F.struct("score", "allocation_id")).alias("b"))
        .filter(F.col("b").isNotNull())
        .select("b.allocation_id", "b.score")
    )


# --- sizing ----------------------------------------------------------------------


def sizing_candidates(executors: DataFrame, nodes: int | Column) -> DataFrame:
    """Every node count from 1 to ``nodes`` for each executor."""
    top = F.lit(nodes) if isinstance(nodes, int) else nodes
    return executors.withColumn("node_count", F.explode(F.sequence(F.lit(1).cast("bigint"), top.cast("bigint"))))


def _positioned(exec_load: DataFrame, order: str) -> DataFrame:
    tie = [*scope(exec_load), "load"]
    return dense_position(exec_load.select(order, *tie), [], order, tie=tie).select("pos", "load")


def _residue_sums(placed: DataFrame, counts: Sequence[int]) -> DataFrame:
    """``node_count, node_no, load``: sums over the executors dealt to each node, partial by task.

    Executors are summed by the remainder of their position where they are read, so a chunk of
    them gives at most a row for each node of each count, and never one for each executor.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            pos = batch.column(0).to_numpy(zero_copy_only=False)
            load = batch.column(1).fill_null(0).to_numpy(zero_copy_only=False)
            for count in counts:
                used, at = np.unique(pos % count, return_inverse=True)
                sums = np.zeros(len(used), dtype=np.int64)
                np.add.at(sums, at, load)
                columns = [pa.array(np.full(len(used), count)), pa.array(used), pa.array(sums)]
                yield pa.RecordBatch.from_arrays(columns, names=["node_count", "node_no", "load"])

    whole = placed.select("pos", F.col("load").cast("bigint").alias("load"))
    return whole.mapInArrow(run, "node_count bigint, node_no bigint, load bigint")


def _peaks(placed: DataFrame, node: DataFrame, counts: Sequence[int], limit: float) -> DataFrame:
    # One row per machine of the cluster.
    numbered = node_capacity(node).select(
        "speed", (F.row_number().over(W.orderBy("host")) - 1).cast("bigint").alias("node_no")
    )
    dealt = _residue_sums(placed, counts).groupBy("node_count", "node_no").agg(F.sum("load").alias("load"))
    return (
        dealt.join(numbered, "node_no")
        .groupBy("node_count")
        .agg(F.max(F.col("load").cast("double") / F.col("speed")).alias("peak"))
        .withColumn("ok", F.col("peak") <= limit)
    )


def sizing_whatif(
    exec_load: DataFrame, node: DataFrame, *, limit: float = 0.65, order: str = "start_task"
) -> DataFrame:
    """Peak node utilisation for each node count when executors are dealt out evenly.

    Nodes are taken in host order. ``exec_load`` has one row per executor with
    ``load`` and an integer ``order`` column; executors of several applications that
    tie on it are dealt in the order of the application, then of the load.
    """
    return _peaks(_positioned(exec_load, order), node, range(1, node.count() + 1), limit)


def fewest_nodes(
    exec_load: DataFrame, node: DataFrame, *, limit: float = 0.65, order: str = "start_task"
) -> DataFrame:
    """Fewest nodes without a bottleneck, else all of them, as :func:`min_nodes` of :func:`sizing_whatif`.

    Counts are examined in ranges that double, 1, 2 to 3, 4 to 7 and so on, and no further than
    the first range with a fit. NULL where there is no executor.
    """
    placed, total = cut_lineage(_positioned(exec_load, order)), node.count()
    low, found, any_at_all = 1, None, not placed.isEmpty()
    while any_at_all and found is None and low <= total:
        fits = _peaks(placed, node, range(low, min(2 * low - 1, total) + 1), limit).filter("ok")
        found = fits.agg(F.min("node_count")).first()[0]
        low *= 2
    nodes = found if found is not None or not any_at_all else total
    return node.sparkSession.createDataFrame([(nodes,)], "nodes bigint")


def min_nodes(whatif: DataFrame) -> DataFrame:
    """Fewest nodes without a bottleneck, else all of them."""
    return whatif.agg(
        F.coalesce(F.min(F.when(F.col("ok"), F.col("node_count"))), F.max("node_count")).alias("nodes")
    )


def parallelism_changes(target: DataFrame, actual: DataFrame) -> DataFrame:
    """Components in both tables whose parallelism differs."""
    keys = [*scope(target, actual), "component"]
    return (
        target.select(*keys, F.col("parallelism").alias("target"))
        .join(actual.select(*keys, F.col("parallelism").alias("actual")), keys)
        .filter(F.col("target") != F.col("actual"))
    )


def rebalance_plan(nodes: DataFrame, current_nodes: int, changes: DataFrame) -> DataFrame:
    """What to change: the node count if it differs, and each changed parallelism."""
    machines = nodes.filter(F.col("nodes") != current_nodes).select(
        F.lit("nodes").alias("item"),
        F.lit(None).cast("string").alias("component"),
        F.lit(current_nodes).cast("bigint").alias("actual"),
        F.col("nodes").cast("bigint").alias("target"),
    )
    parallelism = changes.select(
        F.lit("parallelism").alias("item"),
        F.col("component").cast("string").alias("component"),
        F.col("actual").cast("bigint").alias("actual"),
        F.col("target").cast("bigint").alias("target"),
    )
    return machines.unionByName(parallelism)


def sizing_history(assessments: DataFrame) -> DataFrame:
    """One row per assessment: node count and ``component:parallelism`` list."""
    entry = F.concat(F.col("component").cast("string"), F.lit(":"), F.col("parallelism").cast("string"))
    return assessments.groupBy("ts").agg(
        F.max("nodes").alias("nodes"),
        F.array_join(F.array_sort(F.collect_list(entry)), ",").alias("executors"),
    )


# --- forecasts -------------------------------------------------------------------


def executor_load_forecast(
    traffic_in: DataFrame,
    parallelism: DataFrame,
    max_in: DataFrame,
    models: DataFrame,
    node: DataFrame,
) -> DataFrame:
    """Load of one executor when its component's traffic is shared equally."""
    keys = [*scope(traffic_in, parallelism, max_in, models), "component"]
    each = F.col("traffic_in") / F.col("parallelism")
    return (
        traffic_in.join(parallelism.select(*keys, "parallelism"), keys)
        .join(max_in, keys, "left")
        .join(models.select(*keys, "w"), keys)
        .withColumn("executor_traffic", each)
        .select(
            *keys,
            "executor_traffic",
            (
                component_net(
                    normalise("executor_traffic", F.coalesce("max_in", F.lit(0.0))), "w"
                )
                * cluster_capacity(node).scalar()
            ).alias("executor_load"),
        )
    )


def worker_cpu_forecast(
    placed_executors: DataFrame, model: DataFrame, node: DataFrame, *, max_worker_traffic: Column
) -> DataFrame:
    """CPU percent per host from the traffic and load of the executors placed there.

    ``placed_executors`` has ``hostname``, ``traffic_in``, ``traffic_out`` and ``load``
    per executor; ``model`` is the one-row worker model.
    """
    capacity = cluster_capacity(node).scalar()
    keys = [c for c in ("allocation_id", "hostname") if c in placed_executors.columns]
    sums = placed_executors.groupBy(*keys).agg(
        F.sum("traffic_in").alias("i"), F.sum("traffic_out").alias("o"), F.sum("load").alias("l")
    )
    scaled = sums.select(
        *keys,
        normalise("i", max_worker_traffic).alias("norm_in"),
        normalise("o", max_worker_traffic).alias("norm_out"),
        (F.col("l").cast("double") / capacity).alias("norm_load"),
        model.select("w").scalar().alias("__w"),
    )
    return scaled.select(*keys, (worker_net("__w") * 100).alias("cpu_percent"))


def scaling_flags(
    usage: DataFrame, column: str, *, scale_out: float = 0.65, scale_in: float = 0.40
) -> DataFrame:
    """Mark rows above the scale-out or below the scale-in limit."""
    return usage.withColumn(
        "action",
        F.when(F.col(column) > scale_out, F.lit("scale-out"))
        .when(F.col(column) < scale_in, F.lit("scale-in"))
        .otherwise(F.lit("keep")),
    )

"""Roll-ups from task samples to components, edges, hosts and executors.

Tables may hold many applications. When every input of an operator carries a
``topology_id`` column, it joins and groups by it as well; without the column the
input is read as one application.

No broadcast is forced: the optimizer broadcasts a side only when its measured
size is under ``spark.sql.autoBroadcastJoinThreshold`` and otherwise shuffles,
where adaptive execution splits skewed partitions.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from flowgauge.functions.scalars import int_div
from flowgauge.operators.intervals import within


def scope(*dfs: DataFrame, extra: tuple[str, ...] = ()) -> list[str]:
    """Key columns all inputs share: the application, then ``extra`` where present."""
    wanted = ("topology_id", *extra)
    return [c for c in wanted if all(c in df.columns for df in dfs)]


def zero_if_null(c: Column | str) -> Column:
    return F.coalesce(F.col(c) if isinstance(c, str) else c, F.lit(0))


# --- task sums -----------------------------------------------------------------


def stream_in_task(traffic: DataFrame) -> DataFrame:
    keys = scope(traffic, extra=("snapshot_id",))
    return traffic.groupBy(*keys, F.col("destination_task_id").alias("task_id")).agg(
        F.sum("traffic").alias("traffic_in")
    )


def stream_out_task(traffic: DataFrame) -> DataFrame:
    keys = scope(traffic, extra=("snapshot_id",))
    return traffic.groupBy(*keys, F.col("source_task_id").alias("task_id")).agg(
        F.sum("traffic").alias("traffic_out")
    )


def snapshot_frame(metadata: DataFrame, samples: DataFrame) -> DataFrame:
    """Each metadata row once per snapshot of its application, first to last.

    Snapshots are numbered without gaps, so the range comes from the two ends and
    needs no product with a list of snapshots.
    """
    keys = scope(metadata, samples)
    ends = samples.groupBy(*keys).agg(
        F.min("snapshot_id").alias("__lo"), F.max("snapshot_id").alias("__hi")
    )
    if keys:
        ranged = metadata.join(ends, keys)
    else:
        # One row: the ends of a single application, read in one pass.
        both = ends.select(F.struct("__lo", "__hi")).scalar()
        ranged = (
            metadata.withColumn("__ends", both)
            .select(*metadata.columns, "__ends.__lo", "__ends.__hi")
            .filter(F.col("__lo").isNotNull())
        )
    return ranged.select(
        *metadata.columns, F.explode(F.sequence("__lo", "__hi")).alias("snapshot_id")
    )


def load_of_task(tasks: DataFrame, load: DataFrame) -> DataFrame:
    """Load of every task and snapshot, 0 where no sample exists."""
    frame = snapshot_frame(tasks, load)
    keys = [*scope(frame, load, extra=("snapshot_id",)), "task_id"]
    known = load.groupBy(*keys).agg(F.sum("load").alias("load"))
    return frame.join(known, keys, "left").withColumn("load", zero_if_null("load"))


def component_load(tasks: DataFrame, load: DataFrame) -> DataFrame:
    join_keys = [*scope(tasks, load), "task_id"]
    keys = scope(load, extra=("snapshot_id",))
    return (
        load.join(tasks, join_keys).groupBy(*keys, "component").agg(F.sum("load").alias("load"))
    )


# --- edges ---------------------------------------------------------------------


def map_task_pairs(pairs: DataFrame, tasks: DataFrame) -> DataFrame:
    """Replace both task ends of a pair table by their components."""
    keys = scope(pairs, tasks)
    named = tasks.select(*keys, "task_id", "component")
    source = named.withColumnsRenamed({"task_id": "source_task_id", "component": "src"})
    target = named.withColumnsRenamed({"task_id": "destination_task_id", "component": "dst"})
    return pairs.join(source, [*keys, "source_task_id"]).join(
        target, [*keys, "destination_task_id"]
    )


def edge_traffic(traffic: DataFrame, tasks: DataFrame, edges: DataFrame) -> DataFrame:
    """Tuples per second on each declared edge and snapshot, 0 where none flowed."""
    keys = scope(traffic, tasks, edges, extra=())
    at = [*keys, "snapshot_id", "src", "dst"]
    weights = map_task_pairs(traffic, tasks).groupBy(*at).agg(F.sum("traffic").alias("weight"))
    frame = snapshot_frame(edges.select(*keys, "src", "dst"), traffic)
    return frame.join(weights, at, "left").select(*at, zero_if_null("weight").alias("weight"))


def component_stream_in(weights: DataFrame) -> DataFrame:
    keys = scope(weights, extra=("snapshot_id",))
    return weights.groupBy(*keys, F.col("dst").alias("component")).agg(
        F.sum("weight").alias("stream_in")
    )


def component_stream_out(weights: DataFrame) -> DataFrame:
    keys = scope(weights, extra=("snapshot_id",))
    return weights.groupBy(*keys, F.col("src").alias("component")).agg(
        F.sum("weight").alias("stream_out")
    )


def edge_tuple_size(tuplesize: DataFrame, tasks: DataFrame, edges: DataFrame) -> DataFrame:
    """Whole-number mean tuple size per declared edge and snapshot."""
    keys = scope(tuplesize, tasks, edges)
    at = [*keys, "snapshot_id", "src", "dst"]
    sums = (
        map_task_pairs(tuplesize, tasks)
        .join(edges.select(*keys, "src", "dst"), [*keys, "src", "dst"], "left_semi")
        .groupBy(*at)
        .agg(F.sum("tuplesizesum").alias("s"), F.sum("tuplesizecount").alias("c"))
    )
    return sums.select(*at, int_div("s", F.col("c")).alias("tuple_size"))


# --- hosts ---------------------------------------------------------------------


def host_frame(load: DataFrame, hosts: DataFrame | None) -> DataFrame:
    """Hosts per snapshot: those that carry load, or every listed one."""
    keys = scope(load, extra=("snapshot_id",))
    if hosts is None:
        return load.select(*keys, F.col("worker_hostname").alias("host")).distinct()
    if "snapshot_id" in load.columns:
        return snapshot_frame(hosts, load)
    return hosts


def worker_traffic(
    traffic: DataFrame, load: DataFrame, direction: str, hosts: DataFrame | None = None
) -> DataFrame:
    """Traffic into (``in``) or out of (``out``) the tasks each host runs, 0 for none.

    ``load`` has one row per task and snapshot. ``hosts`` lists the hosts to report;
    by default those with a task.
    """
    if direction not in ("in", "out"):
        raise ValueError("direction is 'in' or 'out'")
    summed = stream_in_task(traffic) if direction == "in" else stream_out_task(traffic)
    value = f"traffic_{direction}"
    keys = scope(traffic, load, extra=("snapshot_id",))
    at = [*keys, "host"]
    # Sum per task first: the join then meets one row per task and snapshot.
    per_host = (
        load.select(*keys, "task_id", F.col("worker_hostname").alias("host"))
        .join(summed, [*keys, "task_id"], "left")
        .groupBy(*at)
        .agg(zero_if_null(F.sum(value)).alias("traffic"))
    )
    if hosts is None:
        return per_host
    return (
        host_frame(load, hosts)
        .join(per_host, at, "left")
        .select(*at, zero_if_null("traffic").alias("traffic"))
    )


def worker_load(load: DataFrame) -> DataFrame:
    keys = scope(load, extra=("snapshot_id",))
    return load.groupBy(*keys, F.col("worker_hostname").alias("host")).agg(
        F.sum("load").alias("load")
    )


def worker_cpu_usage(worker: DataFrame) -> DataFrame:
    """Latest CPU percent per host; the lowest port decides between equal times."""
    keys = [c for c in ("snapshot_id",) if c in worker.columns]
    return worker.groupBy(*keys, F.col("hostname").alias("host")).agg(
        F.max_by("cpu_usage", F.struct("ts", -F.col("port"))).alias("cpu")
    )


def worker_points(
    traffic: DataFrame, load: DataFrame, worker: DataFrame, hosts: DataFrame | None = None
) -> DataFrame:
    """Input traffic, output traffic, load and CPU percent per host and snapshot."""
    keys = scope(traffic, load, extra=("snapshot_id",))
    at = [*keys, "host"]
    cpu_at = [c for c in ("snapshot_id",) if c in worker.columns]
    into = worker_traffic(traffic, load, "in").withColumnRenamed("traffic", "traffic_in")
    out = worker_traffic(traffic, load, "out").withColumnRenamed("traffic", "traffic_out")
    loaded = worker_load(load)
    if hosts is not None:
        loaded = host_frame(load, hosts).join(loaded, at, "left")
    return (
        loaded.join(into, at, "left")
        .join(out, at, "left")
        .join(worker_cpu_usage(worker), [*cpu_at, "host"], "left")
        .select(
            *at,
            *[zero_if_null(c).alias(c) for c in ("traffic_in", "traffic_out", "load", "cpu")],
        )
    )


def task_points(
    traffic: DataFrame, load: DataFrame, tasks: DataFrame, components: DataFrame
) -> DataFrame:
    """Traffic and load of each task: input of a bolt, output of a spout."""
    frame = load_of_task(
        tasks.join(
            components.select(*scope(tasks, components), "component", "kind"),
            [*scope(tasks, components), "component"],
        ),
        load,
    )
    keys = [*scope(frame, traffic, extra=("snapshot_id",)), "task_id"]
    return (
        frame.join(stream_in_task(traffic), keys, "left")
        .join(stream_out_task(traffic), keys, "left")
        .select(
            *keys,
            "component",
            zero_if_null(
                F.when(F.col("kind") == "spout", F.col("traffic_out")).otherwise(F.col("traffic_in"))
            ).alias("traffic"),
            "load",
        )
    )


# --- capacity ------------------------------------------------------------------


def cluster_capacity(node: DataFrame) -> DataFrame:
    return node.agg(
        F.sum(F.col("core_count").cast("bigint") * F.col("core_speed")).alias("capacity")
    )


# --- executors -----------------------------------------------------------------


def executor_tasks(executors: DataFrame) -> DataFrame:
    """One row per task of each executor, so range containment is an equi join.

    An executor whose range ends before it starts has no task.
    """
    return executors.filter("start_task <= end_task").withColumn(
        "task_id", F.explode(F.sequence("start_task", "end_task"))
    )


def executor_of_task(load: DataFrame, executors: DataFrame) -> DataFrame:
    """``load`` with the executors whose range holds its task.

    Only the distinct tasks meet the ranges, by pieces of them, see
    :mod:`flowgauge.operators.intervals`; the rows are joined with what was found.
    """
    keys = scope(load, executors)
    ranges = executors.select(*keys, "executor", "component", "start_task", "end_task")
    tasks = load.select(*keys, "task_id").distinct()
    held = within(tasks, ranges, keys, "task_id", "start_task", "end_task")
    return load.join(held.drop("start_task", "end_task"), [*keys, "task_id"])


def executors_in_component(executors: DataFrame, task_bounds: DataFrame) -> DataFrame:
    """Executors that lie inside the task range of a component: their first task does, and they end in it."""
    keys = scope(executors, task_bounds)
    owners = task_bounds.select(*keys, F.col("component").alias("owner"), "min_task", "max_task")
    starts = executors.select(*keys, "executor", "start_task", "end_task")
    return (
        within(starts, owners, keys, "start_task", "min_task", "max_task")
        .filter(F.col("end_task") <= F.col("max_task"))
        .select(*keys, F.col("owner").alias("component"), "executor", "start_task", "end_task")
    )


def component_parallelism(executors: DataFrame) -> DataFrame:
    return executors.groupBy(*scope(executors), "component").agg(
        F.count(F.lit(1)).alias("parallelism")
    )


def component_task_bounds(tasks: DataFrame) -> DataFrame:
    return tasks.groupBy(*scope(tasks), "component").agg(
        F.min("task_id").alias("min_task"), F.max("task_id").alias("max_task")
    )


def executor_latest_load(load: DataFrame, executors: DataFrame) -> DataFrame:
    """Newest load of each executor over its tasks; the lowest task id breaks ties."""
    keys = scope(load, executors)
    newest = (
        executor_of_task(load.filter(F.col("task_id") > 0), executors)
        .groupBy(*keys, "executor")
        .agg(F.max_by("load", F.struct("ts", -F.col("task_id"))).alias("load"))
    )
    return (
        executors.select(*keys, "executor")
        .distinct()
        .join(newest, [*keys, "executor"], "left")
        .withColumn("load", zero_if_null("load"))
    )


def executor_pair_traffic(traffic: DataFrame, executors: DataFrame) -> DataFrame:
    """Traffic between executors, summed over their task pairs."""
    keys = scope(traffic, executors)
    opened = executor_tasks(executors).select(*keys, "task_id", "executor")
    source = opened.withColumnsRenamed({"task_id": "source_task_id", "executor": "src_executor"})
    target = opened.withColumnsRenamed(
        {"task_id": "destination_task_id", "executor": "dst_executor"}
    )
    return (
        traffic.join(source, [*keys, "source_task_id"])
        .join(target, [*keys, "destination_task_id"])
        .groupBy(*keys, "src_executor", "dst_executor")
        .agg(F.sum("traffic").alias("traffic"))
    )


def executor_traffic(traffic: DataFrame, executors: DataFrame) -> DataFrame:
    """Input plus output traffic of each executor; a self-loop counts on both ends."""
    keys = scope(traffic, executors)
    ends = executor_pair_traffic(traffic, executors).select(
        *keys, F.explode(F.array("src_executor", "dst_executor")).alias("executor"), "traffic"
    )
    summed = ends.groupBy(*keys, "executor").agg(F.sum("traffic").alias("traffic"))
    return (
        executors.select(*keys, "executor")
        .distinct()
        .join(summed, [*keys, "executor"], "left")
        .withColumn("traffic", zero_if_null("traffic"))
    )


def cluster_totals(load: DataFrame, traffic: DataFrame, executors: DataFrame) -> DataFrame:
    """Total newest load and total traffic over all executors."""
    total_load = executor_latest_load(load, executors).agg(zero_if_null(F.sum("load")).alias("v"))
    total_traffic = executor_pair_traffic(traffic, executors).agg(
        zero_if_null(F.sum("traffic")).alias("v")
    )
    return total_load.select(
        F.col("v").alias("total_load"), total_traffic.scalar().alias("total_traffic")
    )


def distinct_executors(executors_by_task: DataFrame) -> DataFrame:
    return executors_by_task.dropDuplicates(
        [*scope(executors_by_task), "component", "start_task", "end_task"]
    )


def task_lists(tasks: DataFrame, *, chunk: int = 4096) -> DataFrame:
    """Sorted task ids per component, in lists of at most ``chunk`` ids.

    A component with ids in several blocks of ``chunk`` has one row per block, so no
    list grows with the application.
    """
    return tasks.groupBy(
        *scope(tasks), "component", F.expr(f"task_id div {int(chunk)}").alias("chunk")
    ).agg(F.sort_array(F.collect_set("task_id")).alias("tasks"))


def component_task_list(executors: DataFrame, *, chunk: int = 4096) -> DataFrame:
    """Task ids of each component, opened from its executor ranges."""
    return task_lists(executor_tasks(executors), chunk=chunk)


# --- graph shape -----------------------------------------------------------------


def sink_components(components: DataFrame, edges: DataFrame) -> DataFrame:
    """Components with an input edge and no output edge."""
    keys = scope(components, edges)
    has_input = edges.select(*keys, F.col("dst").alias("component"))
    has_output = edges.select(*keys, F.col("src").alias("component"))
    at = [*keys, "component"]
    return components.join(has_input, at, "left_semi").join(has_output, at, "left_anti")

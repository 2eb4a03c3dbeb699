"""Whole plans: a profiling run and an assessment, each from telemetry tables.

Both return lazy DataFrames built from the operators. The propagated peak traffic
is the one intermediate that several outputs share; it has one row per edge and is
already materialised by the propagation itself.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from flowgauge.functions.scalars import max_traffic_per_second
from flowgauge.operators import capacity as K
from flowgauge.operators import models as J
from flowgauge.operators import propagate as G
from flowgauge.operators import rollup as R
from flowgauge.operators import selectivity as A
from flowgauge.runtime import cut_lineage


@dataclass(frozen=True)
class Tables:
    """Inputs of a run; samples carry ``snapshot_id``."""

    components: DataFrame
    tasks: DataFrame
    edges: DataFrame
    traffic: DataFrame
    load: DataFrame
    worker: DataFrame
    node: DataFrame
    tuplesize: DataFrame | None = None


@dataclass(frozen=True)
class Profile:
    """What a profiling run leaves behind."""

    edge_traffic: DataFrame
    selectivity: DataFrame
    mean_selectivity: DataFrame
    max_traffic: DataFrame
    component_train: DataFrame
    worker_train: DataFrame
    tuple_size: DataFrame | None
    component_models: DataFrame | None
    worker_model: DataFrame | None


def profile(
    tables: Tables,
    *,
    max_traffic: float,
    factor: int,
    fit: bool = True,
    max_epochs: int = 50_000,
) -> Profile:
    """Snapshots to selectivity, peak traffic, training sets and fitted models."""
    spark = tables.traffic.sparkSession
    max_sec = (
        spark.range(1).select(max_traffic_per_second(max_traffic, factor).alias("r")).first()["r"]
    )
    # Small after the roll-up, and read by every later step.
    weights = cut_lineage(R.edge_traffic(tables.traffic, tables.tasks, tables.edges))
    alfa = A.edge_selectivity(weights, tables.components)
    mean_alfa = A.mean_selectivity(alfa)
    peak = cut_lineage(
        G.propagate_max_traffic(tables.edges, mean_alfa, tables.components, max_sec)
    )
    points = R.task_points(tables.traffic, tables.load, tables.tasks, tables.components)
    component_train = J.component_training_set(
        points, tables.components, peak, tables.node, max_sec=max_sec
    )
    worker_train = J.worker_training_set(
        R.worker_points(tables.traffic, tables.load, tables.worker), peak, tables.node
    )
    sizes = (
        None
        if tables.tuplesize is None
        else A.mean_tuple_size(tables.tuplesize, tables.tasks, tables.edges)
    )
    return Profile(
        edge_traffic=weights,
        selectivity=alfa,
        mean_selectivity=mean_alfa,
        max_traffic=peak,
        component_train=component_train,
        worker_train=worker_train,
        tuple_size=sizes,
        component_models=J.fit_component_models(component_train, max_epochs=max_epochs)
        if fit
        else None,
        worker_model=J.fit_worker_model(worker_train) if fit else None,
    )


def forecast_executor_load(
    tables: Tables, profiled: Profile, component_parallelism: DataFrame
) -> DataFrame:
    """Forecast load per executor when the newest spout rates run through the graph.

    A spout has no input edge, so its own output rate stands in for its input, and
    its model is scaled by the assumed peak like its training rows.
    """
    weights = profiled.edge_traffic
    keys = R.scope(weights)
    if keys:
        ends = weights.groupBy(*keys).agg(F.max("snapshot_id").alias("snapshot_id"))
        newest = weights.join(ends, [*keys, "snapshot_id"]).drop("snapshot_id")
    else:
        last = weights.agg(F.max("snapshot_id")).scalar()
        newest = weights.filter(F.col("snapshot_id") == last).drop("snapshot_id")
    at = [*keys, "component"]
    spouts = tables.components.filter("kind = 'spout'").select(*at)
    inside = G.propagate_current_traffic(newest, profiled.mean_selectivity, tables.components)
    emitted = (
        R.component_stream_out(newest)
        .join(spouts, at, "left_semi")
        .select(*at, F.col("stream_out").cast("double").alias("traffic_in"))
    )
    peak_in = G.max_traffic_in(profiled.max_traffic)
    # Every spout edge carries the assumed peak in full.
    peak_out = (
        profiled.max_traffic.withColumnRenamed("src", "component")
        .join(spouts, at, "left_semi")
        .groupBy(*at)
        .agg(F.max("max_traffic").alias("max_in"))
    )
    return K.executor_load_forecast(
        inside.unionByName(emitted),
        component_parallelism,
        peak_in.unionByName(peak_out),
        profiled.component_models,
        tables.node,
    )


def assess(
    tables: Tables,
    profiled: Profile,
    executors: DataFrame,
    *,
    target: DataFrame,
    current_nodes: int,
    limit: float = 0.65,
) -> DataFrame:
    """Sizing advice: fewest nodes for the forecast load, and changed parallelisms.

    ``executors`` are the running ones; ``target`` holds the wanted parallelism per
    component. Executor ranges are redrawn for the target before sizing.
    """
    keys = R.scope(executors, target, tables.tasks)
    at = [*keys, "component"]
    redrawn = K.split_tasks(
        R.component_task_bounds(tables.tasks).join(target.select(*at, "parallelism"), at)
    )
    forecast = forecast_executor_load(tables, profiled, target)
    wanted = redrawn.join(forecast, at).select(
        *keys, "start_task", F.greatest(F.col("executor_load"), F.lit(0.0)).alias("load")
    )
    nodes = K.min_nodes(K.sizing_whatif(wanted, tables.node, limit=limit))
    changes = K.parallelism_changes(target, R.component_parallelism(executors))
    return K.rebalance_plan(nodes, current_nodes, changes)

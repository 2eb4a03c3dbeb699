"""Row filters and small projections over telemetry tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def drop_warmup(df: DataFrame) -> DataFrame:
    """Snapshot 0 carries counters from before the run and is not used."""
    return df.filter(F.col("snapshot_id") > 0)


def user_tasks(df: DataFrame) -> DataFrame:
    """Drop system tasks: ids above 0 for load, source ids from 0 for traffic."""
    if "source_task_id" in df.columns:
        return df.filter(F.col("source_task_id") >= 0)
    return df.filter(F.col("task_id") > 0)


def components_of_kind(components: DataFrame, kind: str) -> DataFrame:
    return components.filter(F.col("kind") == kind)


def component_by_name(components: DataFrame, name) -> DataFrame:
    """One component by name; the job fails when there is none."""
    hits = components.filter(F.col("component") == name)
    found = hits.agg(F.count(F.lit(1))).scalar()
    complaint = F.raise_error(F.lit(f"no component named {name}"))
    missing = components.sparkSession.range(1).filter(found == 0).select(
        *[complaint.cast(f.dataType).alias(f.name) for f in components.schema]
    )
    return hits.unionByName(missing)


def only_topology(df: DataFrame, topology_id: str) -> DataFrame:
    return df.filter(F.col("topology_id") == topology_id)


def node_capacity(node: DataFrame) -> DataFrame:
    """Cycles per second a host offers."""
    return node.select(
        F.col("hostname").alias("host"),
        (F.col("core_count").cast("bigint") * F.col("core_speed")).alias("speed"),
    )


def first_timestamp(traffic: DataFrame) -> DataFrame:
    return traffic.agg(F.min("ts").alias("first_ts"))

"""Traffic propagation through the component graph.

Propagation is linear, so it runs as waves: wave 0 is what the spouts send, and
each later wave is the previous one collected per component and passed on with the
ratio of each outgoing edge. The total on an edge is the sum over the waves. That
takes at most as many rounds as the longest path and one small aggregate per
round; paths are never enumerated.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from flowgauge.functions.scalars import max_traffic_per_second
from flowgauge.operators.rollup import scope, task_lists, zero_if_null
from flowgauge.runtime import cut_lineage


def _waves(first: DataFrame, inner: DataFrame, keys: list[str], rounds: int) -> DataFrame:
    """Sum of all waves per edge, starting from ``first(keys, src, dst, amount)``."""
    inner = cut_lineage(inner)
    wave = cut_lineage(first)
    waves = [wave]
    for _ in range(rounds + 1):
        if wave.isEmpty():
            break
        arrived = wave.groupBy(*keys, F.col("dst").alias("src")).agg(F.sum("amount").alias("amount"))
        wave = cut_lineage(
            inner.join(arrived, [*keys, "src"]).select(
                *keys, "src", "dst", (F.col("alfa") * F.col("amount")).alias("amount")
            )
        )
        waves.append(wave)
    else:
        raise ValueError("the component graph has a cycle")
    return (
        reduce(DataFrame.unionByName, waves)
        .groupBy(*keys, "src", "dst")
        .agg(F.sum("amount").alias("amount"))
    )


def _propagate(
    edges: DataFrame, alfa: DataFrame, components: DataFrame, spout_amount: Column
) -> DataFrame:
    keys = scope(edges, alfa, components)
    at = [*keys, "src", "dst"]
    kinds = components.select(*keys, F.col("component").alias("src"), "kind")
    known = edges.join(kinds, [*keys, "src"])
    first = known.filter(F.col("kind") == "spout").select(
        *at, spout_amount.cast("double").alias("amount")
    )
    inner = (
        known.filter(F.col("kind") != "spout")
        .join(alfa.select(*at, "alfa"), at)
        .select(*at, "alfa")
    )
    # No path visits more components than the largest application has.
    sizes = components.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"))
    depth = sizes.agg(F.max("n")).first()[0] or 0
    totals = _waves(first, inner, keys, depth)
    return edges.select(*at).join(totals, at, "left").select(*at, zero_if_null("amount").alias("amount"))


def propagate_max_traffic(
    edges: DataFrame, alfa: DataFrame, components: DataFrame, max_sec: float
) -> DataFrame:
    """Peak traffic per edge when every spout edge carries the full assumed peak."""
    spread = _propagate(edges, alfa, components, F.lit(float(max_sec)))
    return spread.withColumnRenamed("amount", "max_traffic")


def propagate_current_traffic(
    weights: DataFrame, alfa: DataFrame, components: DataFrame
) -> DataFrame:
    """Input per component when spout edges carry their measured weight."""
    spread = _propagate(weights, alfa, components, F.col("weight"))
    keys = scope(spread)
    return spread.groupBy(*keys, F.col("dst").alias("component")).agg(
        F.sum("amount").alias("traffic_in")
    )


def max_traffic_in(max_traffic: DataFrame) -> DataFrame:
    """Peak input per component."""
    return max_traffic.groupBy(*scope(max_traffic), F.col("dst").alias("component")).agg(
        F.sum("max_traffic").alias("max_in")
    )


def worker_traffic_normaliser(max_traffic: DataFrame) -> DataFrame:
    """Sum of the peak inputs of all components."""
    return max_traffic_in(max_traffic).groupBy(*scope(max_traffic)).agg(
        F.sum("max_in").alias("max_worker_traffic")
    )


def whatif_traffic(
    edges: DataFrame,
    alfa: DataFrame,
    components: DataFrame,
    *,
    max_traffic: float,
    factor: int,
    current_max_sec: float,
    current_factor: int,
) -> DataFrame:
    """Peak traffic per edge under another assumed peak or factor."""
    rate = edges.sparkSession.range(1).select(
        max_traffic_per_second(max_traffic, factor, current_max_sec, current_factor).alias("r")
    )
    return propagate_max_traffic(edges, alfa, components, rate.first()[0])


def topology_listing(components: DataFrame, tasks: DataFrame, weights: DataFrame) -> DataFrame:
    """One text row per component with its tasks and per edge with its weight.

    A component with very many tasks continues on further rows, told apart by ``chunk``;
    an edge is chunk 0.
    """
    keys = scope(components, tasks, weights)
    vertex = components.join(task_lists(tasks), [*keys, "component"], "left").select(
        *keys,
        F.lit("component").alias("item"),
        F.coalesce(F.col("chunk").cast("bigint"), F.lit(0).cast("bigint")).alias("chunk"),
        F.concat(
            F.col("component").cast("string"),
            F.lit(", task: ["),
            F.coalesce(F.array_join(F.col("tasks").cast("array<string>"), ", "), F.lit("")),
            F.lit("]"),
        ).alias("text"),
    )
    edge = weights.select(
        *keys,
        F.lit("edge").alias("item"),
        F.lit(0).cast("bigint").alias("chunk"),
        F.concat(
            F.lit("("),
            F.col("src").cast("string"),
            F.lit(" : "),
            F.col("dst").cast("string"),
            F.lit(") w="),
            F.col("weight").cast("string"),
        ).alias("text"),
    )
    return vertex.unionByName(edge)

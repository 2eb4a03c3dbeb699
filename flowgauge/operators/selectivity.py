"""Selectivity and tuple size per edge, and their histories."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from flowgauge.operators.filters import drop_warmup
from flowgauge.operators.ordered import dense_position
from flowgauge.operators.rollup import component_stream_in, edge_tuple_size, scope, zero_if_null


def previous_snapshot(weights: DataFrame) -> DataFrame:
    """Weight of each edge one snapshot earlier.

    After the roll-up an edge has exactly one row per snapshot, so no edge can
    outweigh another and a plain window is bounded by the number of snapshots.
    """
    w = W.partitionBy(*scope(weights), "src", "dst").orderBy("snapshot_id")
    return weights.withColumn("previous_weight", F.lag("weight").over(w))


def edge_selectivity(weights: DataFrame, components: DataFrame) -> DataFrame:
    """Output over input per edge and snapshot, from the weights one snapshot back.

    A component without input divides by 1. A spout creates its own stream, so its
    ratio is 1 when it emits and 0 when it does not.
    """
    keys = scope(weights, components)
    shifted = drop_warmup(previous_snapshot(weights)).select(
        *keys, "snapshot_id", "src", "dst", F.col("previous_weight").alias("weight")
    )
    into = component_stream_in(shifted).withColumnRenamed("component", "src")
    kinds = components.select(*keys, F.col("component").alias("src"), "kind")
    total_in = F.coalesce(F.nullif(F.col("stream_in"), F.lit(0)), F.lit(1))
    joined = shifted.join(into, [*keys, "snapshot_id", "src"], "left").join(kinds, [*keys, "src"])
    return joined.select(
        *keys,
        "snapshot_id",
        "src",
        "dst",
        zero_if_null("stream_in").alias("stream_in"),
        F.col("weight").alias("stream_out"),
        F.when((F.col("kind") == "spout") & (F.col("weight") != 0), F.lit(1.0))
        .otherwise(F.col("weight").cast("double") / total_in)
        .alias("alfa"),
    )


def mean_selectivity(alfa: DataFrame) -> DataFrame:
    """Mean ratio per edge over every kept snapshot, zeros included."""
    return alfa.groupBy(*scope(alfa), "src", "dst").agg(F.avg("alfa").alias("alfa"))


def mean_tuple_size(tuplesize: DataFrame, tasks: DataFrame, edges: DataFrame) -> DataFrame:
    sizes = drop_warmup(edge_tuple_size(tuplesize, tasks, edges))
    return sizes.groupBy(*scope(sizes), "src", "dst").agg(F.avg("tuple_size").alias("tuple_size"))


def history_array(
    df: DataFrame, keys: Sequence[str], value: str, *, order: str = "snapshot_id", chunk: int = 4096
) -> DataFrame:
    """Past values of each key as newest-first arrays of at most ``chunk`` items.

    Chunk 0 holds the newest values. Reading the chunks of a key in order gives
    its whole history, while no array and no task ever holds more than one chunk.
    """
    newest_first = df.select(*keys, (-F.col(order)).alias("__age"), F.col(value).alias("__v"))
    placed = dense_position(newest_first, keys, "__age", name="__pos")
    return (
        placed.withColumn("chunk", F.expr(f"__pos div {int(chunk)}"))
        .groupBy(*keys, "chunk")
        .agg(
            F.transform(
                F.array_sort(F.collect_list(F.struct("__pos", "__v"))), lambda x: x["__v"]
            ).alias("history")
        )
    )

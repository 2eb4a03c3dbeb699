"""Streaming forms of the metric roll-ups.

Every function takes a streaming DataFrame and returns one, except those that need
``foreachBatch``. A watermark (10 minutes by default) bounds the state; rows later
than that are dropped and show up as ``numRowsDroppedByWatermark`` in the query
progress.

``run_updates`` stores each micro-batch under its epoch, so a batch that is retried
after a lost executor overwrites its own folder and nothing is counted twice.

Operators that keep rows or timers for each key are in :mod:`flowgauge.streaming.keyed`.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import StructType

from flowgauge.functions.scalars import int_div, tuple_bytes
from flowgauge.operators.filters import user_tasks
from flowgauge.sources import state
from flowgauge.sources.writers import newest_per_key

BUCKET = "10 seconds"
WATERMARK = "10 minutes"


def file_stream(
    spark: SparkSession, folder: str, schema: StructType, glob: str = "*", *, max_files: int | None = None
) -> DataFrame:
    """Files of a folder as a stream; ``max_files`` bounds a micro-batch, so a backlog is read in steps."""
    reader = spark.readStream.schema(schema).option("pathGlobFilter", glob)
    return (reader if max_files is None else reader.option("maxFilesPerTrigger", max_files)).parquet(folder)


# --- windowed roll-ups -----------------------------------------------------------


def _bucketed(rows: DataFrame, keys: Sequence[str], bucket: str, watermark: str, *aggs) -> DataFrame:
    return (
        rows.withWatermark("ts", watermark)
        .groupBy(F.window("ts", bucket), *keys)
        .agg(*aggs)
        .select(F.col("window.start").alias("bucket"), "*")
        .drop("window")
    )


def traffic_stream(
    tuples: DataFrame, *, bucket: str = BUCKET, watermark: str = WATERMARK
) -> DataFrame:
    """Tuples received per task, source task and bucket; system sources are left out."""
    return _bucketed(
        user_tasks(tuples),
        ["task_id", "source_task_id"],
        bucket,
        watermark,
        F.count(F.lit(1)).alias("traffic"),
    )


def latency_stream(
    tuples: DataFrame, *, bucket: str = BUCKET, watermark: str = WATERMARK
) -> DataFrame:
    """Mean execute latency per task and bucket."""
    return _bucketed(
        user_tasks(tuples),
        ["task_id"],
        bucket,
        watermark,
        F.avg("latency_ms").alias("latency_ms"),
        F.count(F.lit(1)).alias("n"),
    )


def tuple_size_stream(tuples: DataFrame, value_columns: Sequence[str]) -> DataFrame:
    """Cumulative bytes and count per task and input stream, for update mode.

    :func:`flowgauge.streaming.keyed.size_reports` publishes them at a pace of its own.
    """
    return (
        tuples.withColumn("__bytes", tuple_bytes(value_columns))
        .groupBy("task_id", "stream")
        .agg(
            F.sum(F.col("__bytes").cast("bigint")).alias("tuplesizesum"),
            F.count(F.lit(1)).alias("tuplesizecount"),
        )
        .withColumn("tuple_size", int_div("tuplesizesum", F.col("tuplesizecount")))
    )


# --- sinks -----------------------------------------------------------------------


def run_updates(
    stream: DataFrame,
    path: str,
    *,
    output_mode: str = "update",
    trigger: dict | None = None,
    transform: Callable[[DataFrame, int], DataFrame] | None = None,
) -> StreamingQuery:
    """Start a query that writes each micro-batch to ``path/data/epoch=<id>``."""

    def write(batch: DataFrame, epoch: int) -> None:
        rows = transform(batch, epoch) if transform else batch
        rows.write.mode("overwrite").parquet(f"{path}/data/epoch={epoch}")

    return (
        stream.writeStream.outputMode(output_mode)
        .option("checkpointLocation", f"{path}/checkpoint")
        .trigger(**(trigger or {"availableNow": True}))
        .foreachBatch(write)
        .start()
    )


def read_updates(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(f"{path}/data")


def final_values(updates: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Last emitted value per key of an update-mode query."""
    return newest_per_key(updates, keys, ["epoch"]).drop("epoch")


def latest_state_stream(
    rows: DataFrame,
    path: str,
    keys: Sequence[str],
    *,
    ts: str = "ts",
    trigger: dict | None = None,
    buckets: int = state.BUCKETS,
) -> StreamingQuery:
    """Keep the newest row per key as a table; a later batch wins equal times.

    Each micro-batch becomes a version of the table, see :mod:`flowgauge.sources.state`: it
    rewrites only the buckets its rows fall into, and a batch that is tried again gives the
    same version.
    """

    def merge(batch: DataFrame, epoch: int) -> None:
        batch = batch.persist()  # read for the buckets and for the rows
        try:
            state.apply_rows(batch, path, keys, epoch, ts=ts, buckets=buckets)
        finally:
            batch.unpersist()

    return (
        rows.writeStream.outputMode("append")
        .option("checkpointLocation", f"{path}/checkpoint")
        .trigger(**(trigger or {"availableNow": True}))
        .foreachBatch(merge)
        .start()
    )


def latest_state(spark: SparkSession, path: str) -> DataFrame:
    """The newest row per key, as of the last version stored whole."""
    return state.read_state(spark, path)


def clock(spark: SparkSession) -> DataFrame:
    """One row a second, numbered from the first start of the query that reads it, pauses included."""
    return spark.readStream.format("rate").option("rowsPerSecond", 1).load().select(F.col("value").alias("second"))


def snapshot_stream(
    path: str,
    snapshot: Callable[[], DataFrame],
    *,
    spark: SparkSession,
    every: str = "10 seconds",
    trigger: dict | None = None,
) -> StreamingQuery:
    """Store a numbered snapshot of the latest tables at every beat of a clock.

    The query is paced by a source of its own, so snapshots go on while no data comes.
    ``snapshot`` reads the current latest state. ``snapshot_id`` counts the snapshots from 0 and
    goes on after a restart. ``beat`` is the whole number of periods since the first start, and
    ``missed`` how many periods before it, since the snapshot before, have none of their own.
    """
    seconds = max(1, int(pd.Timedelta(every).total_seconds()))

    def numbered(beats: DataFrame, epoch: int) -> DataFrame:
        first, last = beats.agg(F.min("second"), F.max("second")).first()
        beat, before = (last or 0) // seconds, ((first or 0) - 1) // seconds
        missed = max(0, beat - before - 1)
        return snapshot().select(
            "*", F.lit(epoch).alias("snapshot_id"), F.lit(beat).cast("bigint").alias("beat"), F.lit(missed).cast("bigint").alias("missed")
        )

    return run_updates(
        clock(spark), path, output_mode="append", trigger=trigger or {"processingTime": every}, transform=numbered
    )

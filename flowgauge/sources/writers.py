"""Writers and state tables."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def newest_per_key(rows: DataFrame, keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    """Newest row per key by the ``order`` columns, as a hash aggregate.

    Partial maxima form before the shuffle, so a key with many versions sends one
    row per task. Rows equal in ``order`` are settled by their other columns.
    """
    keys = list(keys)
    rest = [c for c in rows.columns if c not in (*keys, *order)]
    newest = rows.groupBy(*keys).agg(F.max(F.struct(*order, *rest)).alias("__row"))
    return newest.select(
        *[F.col(c) if c in keys else F.col(f"__row.{c}").alias(c) for c in rows.columns]
    )


def upsert_state(
    state: DataFrame, updates: DataFrame, keys: Sequence[str], *, ts: str = "ts"
) -> DataFrame:
    """State after the updates: newest row per key, an update winning over equal times."""
    tagged = state.withColumn("__update", F.lit(0)).unionByName(
        updates.withColumn("__update", F.lit(1))
    )
    return newest_per_key(tagged, keys, [ts, "__update"]).drop("__update")


def retain_running(df: DataFrame, running: DataFrame) -> DataFrame:
    """Rows of running applications; an empty list keeps none."""
    return df.join(running, "topology_id", "left_semi")


def _edge_text():
    return F.concat(
        F.lit("("), F.col("src").cast("string"), F.lit(" : "), F.col("dst").cast("string"), F.lit(")")
    )


def write_history(df: DataFrame, path: str, kind: str, *, run_id: str) -> None:
    """Write profiled values of one run as CSV under ``run_id=<run_id>``.

    Other runs stay; the same run written again replaces its rows.
    """
    columns = {
        "worker": ["host", "traffic_in", "traffic_out", "load", "cpu"],
        "load": ["component", "traffic", "load"],
        "alfa": [_edge_text().alias("edge"), "alfa"],
        "tuple": [_edge_text().alias("edge"), "tuple_size"],
    }[kind]
    df.select(*columns, F.lit(run_id).alias("run_id")).write.partitionBy("run_id").option(
        "partitionOverwriteMode", "dynamic"
    ).mode("overwrite").csv(path)


def write_training_set(
    df: DataFrame, path: str, *, columns: Sequence[str], run_id: str = "0", files: int = 8
) -> None:
    """Write normalised rows as CSV, one folder per component and run.

    Other runs stay; the same run written again replaces its rows. A component gets at
    most ``files`` files, so a hot one is not written by one task.
    """
    rows = df.select(*columns, "component", F.lit(run_id).alias("run_id"))
    spread = F.pmod(F.xxhash64(*columns), F.lit(files))
    rows.repartition("component", spread).write.partitionBy("component", "run_id").option(
        "partitionOverwriteMode", "dynamic"
    ).mode("overwrite").csv(path)


def second_lines(series: DataFrame, value: str) -> DataFrame:
    """``second,value`` lines in order, an empty line for a missing value."""
    line = F.concat(F.col("second").cast("string"), F.lit(","), F.col(value).cast("string"))
    return series.orderBy("second").select(F.coalesce(line, F.lit("")).alias("value"))


def write_second_series(series: DataFrame, path: str, *, value: str) -> None:
    """Write a per-second series as text files that are in order by file name."""
    second_lines(series, value).write.mode("errorifexists").text(path)

"""Session helpers: shared folders and lineage cuts."""

from __future__ import annotations

import os
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """Folder every executor can reach, taken from ``spark.checkpoint.dir``.

    Only a local-mode session without the setting gets a temporary folder; a
    cluster without one is an error, because files on one machine would be lost
    with it.
    """
    context = spark.sparkContext
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if context.getCheckpointDir() is None:
        if not configured and not context.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder all executors share")
        context.setCheckpointDir(configured or tempfile.mkdtemp(prefix="flowgauge-"))
    return configured or context.getCheckpointDir()


def scratch_path(spark: SparkSession, label: str) -> str:
    """A new, unused path under the shared folder."""
    return os.path.join(shared_dir(spark), "flowgauge", f"{label}-{uuid.uuid4().hex}")


def cut_lineage(df: DataFrame) -> DataFrame:
    """Materialise ``df`` reliably so later plans start from files, not history."""
    shared_dir(df.sparkSession)
    return df.checkpoint(eager=True)


class Scratch:
    """Tables under the shared folder that go as soon as they are no longer needed."""

    def __init__(self, spark: SparkSession, label: str) -> None:
        self.spark, self.label, self.paths = spark, label, {}

    def stored(self, df: DataFrame, name: str) -> DataFrame:
        path = self.paths[name] = scratch_path(self.spark, f"{self.label}-{name}")
        df.write.option("compression", "zstd").parquet(path)
        return self.spark.read.schema(df.schema).parquet(path)

    def drop(self, *names: str) -> None:
        for name in names:
            at = self.spark._jvm.org.apache.hadoop.fs.Path(self.paths.pop(name))
            at.getFileSystem(self.spark._jsparkSession.sessionState().newHadoopConf()).delete(at, True)


@contextmanager
def shuffles_dropped(spark: SparkSession) -> Iterator[None]:
    """Within, Spark removes the shuffle files of a query when it ends, not when the driver collects its garbage."""
    key = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(key, None)
    spark.conf.set(key, "true")
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(key)
        else:
            spark.conf.set(key, before)

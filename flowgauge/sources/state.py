"""A latest-row-per-key table in buckets, changed a version at a time.

Rows lie in buckets by a hash of their key. A version is a manifest: for each bucket the
version that wrote it last. Applying rows rewrites only the buckets they fall into and
stores a new manifest beside the one before; files that neither of the two names are
removed. A version applied again starts from the same manifest and gives the same table,
and a reader of the version before is not cut off.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from flowgauge.sources.writers import newest_per_key, upsert_state

BUCKETS = 64
_MANIFEST = "bucket int, version bigint"


def _files(spark: SparkSession, path: str):
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark._jsc.hadoopConfiguration()), at


def bucket_of(keys: Sequence[str], buckets: int) -> Column:
    return F.pmod(F.xxhash64(*keys), F.lit(buckets)).cast("int")


def state_versions(spark: SparkSession, path: str) -> list[int]:
    """Versions whose manifest is stored whole, in order."""
    files, at = _files(spark, f"{path}/manifests")
    if not files.exists(at):
        return []
    found = [str(s.getPath()) for s in files.listStatus(at)]
    done = [p for p in found if "version=" in p and files.exists(_files(spark, f"{p}/_SUCCESS")[1])]
    return sorted(int(p.rpartition("version=")[2]) for p in done)


def manifest(spark: SparkSession, path: str, version: int) -> dict[int, int]:
    """Of each bucket that has rows the version that wrote it."""
    return {r[0]: r[1] for r in spark.read.schema(_MANIFEST).json(f"{path}/manifests/version={version}").collect()}


def _read(spark: SparkSession, path: str, parts: dict[int, int], schema) -> DataFrame:
    folders = [f"{path}/data/version={v}/bucket={b}" for b, v in sorted(parts.items())]
    reader = spark.read if schema is None else spark.read.schema(schema)
    return reader.parquet(*folders) if folders else spark.createDataFrame([], schema)


def apply_rows(
    rows: DataFrame, path: str, keys: Sequence[str], version: int, *, ts: str = "ts", buckets: int = BUCKETS
) -> list[int]:
    """Make ``version`` of the table at ``path`` from the one before and ``rows``; the buckets it wrote.

    The newest row per key by ``ts`` stays, one of ``rows`` winning over equal times. ``rows`` is
    read twice and should be cheap to read. The number of buckets must not change over a table's
    life; it bounds what the driver gets. No rows give a version with the same content.
    """
    spark, keys = rows.sparkSession, list(keys)
    newest = newest_per_key(rows, keys, [ts])
    touched = [r[0] for r in newest.select(bucket_of(keys, buckets).alias("b")).distinct().collect()]
    older = [v for v in state_versions(spark, path) if v < version]
    parts = manifest(spark, path, older[-1]) if older else {}
    if touched:
        before = {b: v for b, v in parts.items() if b in touched}
        merged = upsert_state(_read(spark, path, before, rows.schema), newest, keys, ts=ts) if before else newest
        placed = merged.withColumn("bucket", bucket_of(keys, buckets))
        placed.repartition("bucket").write.mode("overwrite").partitionBy("bucket").parquet(f"{path}/data/version={version}")
    parts = parts | dict.fromkeys(touched, version)
    listed = spark.createDataFrame(sorted(parts.items()), _MANIFEST)
    listed.coalesce(1).write.mode("overwrite").json(f"{path}/manifests/version={version}")
    _forget(spark, path, [*older[-1:], version])
    return sorted(touched)


def _forget(spark: SparkSession, path: str, kept: list[int]) -> None:
    """Remove older manifests and the buckets no kept manifest names."""
    named = {(v, b) for k in kept for b, v in manifest(spark, path, k).items()}
    for version in state_versions(spark, path):
        if version < kept[0]:
            files, at = _files(spark, f"{path}/manifests/version={version}")
            files.delete(at, True)
    files, at = _files(spark, f"{path}/data")
    for folder in files.listStatus(at) if files.exists(at) else []:
        version = int(str(folder.getPath()).rpartition("version=")[2])
        if version > kept[-1]:
            continue
        buckets = [s.getPath() for s in files.listStatus(folder.getPath()) if "bucket=" in str(s.getPath())]
        gone = [b for b in buckets if (version, int(str(b).rpartition("bucket=")[2])) not in named]
        for bucket in gone:
            files.delete(bucket, True)
        if len(gone) == len(buckets):
            files.delete(folder.getPath(), True)


def read_state(spark: SparkSession, path: str, version: int | None = None, schema=None) -> DataFrame:
    """The newest row per key, as of the last version stored whole or one that is still kept."""
    versions = state_versions(spark, path)
    return _read(spark, path, manifest(spark, path, versions[-1] if version is None else version), schema)

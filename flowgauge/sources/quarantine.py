"""Logs read line by line: good lines as rows, bad ones set aside with file, line and reason."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql import Window as W


def read_checked(
    spark: SparkSession,
    folder: str,
    schema: T.StructType,
    path: str,
    *,
    glob: str = "*",
    leave_out: str | None = None,
    separator: str = ",",
) -> tuple[DataFrame, DataFrame]:
    """``(good, bad)`` lines of the text files in ``folder``, both stored under ``path``.

    A good line has one field for each column of ``schema``, each empty (NULL) or of the column's
    type; ``good`` has these columns and ``file``. ``bad`` has ``file``, ``line_no`` (from 0 in the
    file), ``line`` and ``reason``, the first that holds. Together they are all lines. ``glob`` picks
    files by name, those whose name starts with ``leave_out`` are not read.

    The text is read once: each line is judged and written to one of the two tables. Lines are
    numbered from the counts of the blocks the scan read, taken from what was written.
    """
    raw = spark.read.option("pathGlobFilter", glob).text(folder).select(
        "value",
        F.col("_metadata.file_path").alias("__path"),
        F.col("_metadata.file_name").alias("file"),
        F.col("_metadata.file_block_start").alias("__block"),
        F.monotonically_increasing_id().alias("__id"),
    )
    if leave_out:
        raw = raw.filter(~F.col("file").startswith(leave_out))
    parts = F.split("value", f"\\Q{separator}\\E", -1)
    fields = {f.name: F.trim(F.get(parts, F.lit(i))) for i, f in enumerate(schema.fields)}
    typed = {f.name: fields[f.name].try_cast(f.dataType) for f in schema.fields}
    reason = F.when(F.trim("value") == "", "empty line").when(
        F.size(parts) != len(fields),
        F.concat(F.lit(f"{len(fields)} fields expected, "), F.size(parts).cast("string"), F.lit(" found")),
    )
    for f in schema.fields:
        wrong = (fields[f.name] != "") & typed[f.name].isNull()
        reason = reason.when(wrong, f"{f.name} is no {f.dataType.simpleString()}")
    judged = raw.select("*", reason.alias("reason"))
    good = F.col("reason").isNull()
    judged.select(
        "__path",
        "file",
        "__block",
        "__id",
        *[F.when(good, c).alias(name) for name, c in typed.items()],
        F.when(~good, F.col("value")).alias("line"),
        "reason",
        good.alias("good"),
    ).write.partitionBy("good").parquet(path)
    columns = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in schema.fields)
    stored = spark.read.schema(
        f"__path string, file string, __block bigint, __id bigint, {columns}, line string, reason string, good boolean"
    ).parquet(path)
    blocks = stored.groupBy("__path", "__block").agg(F.min("__id").alias("__first"), F.count(F.lit(1)).alias("__n"))
    before = F.sum("__n").over(W.partitionBy("__path").orderBy("__block").rowsBetween(W.unboundedPreceding, -1))
    offsets = blocks.select("__path", "__block", (F.coalesce(before, F.lit(0)) - F.col("__first")).alias("__shift"))
    numbered = stored.filter("NOT good").join(offsets, ["__path", "__block"])
    bad = numbered.select("file", (F.col("__id") + F.col("__shift")).alias("line_no"), "line", "reason")
    return stored.filter("good").select(*schema.names, "file"), bad


def read_checked_log(
    spark: SparkSession, folder: str, schema: T.StructType, path: str, *, prefix: str = ""
) -> tuple[DataFrame, DataFrame]:
    """Log files whose name starts with ``prefix``; without one, all but those already merged."""
    return read_checked(spark, folder, schema, path, glob=f"{prefix}*", leave_out=None if prefix else "merge")

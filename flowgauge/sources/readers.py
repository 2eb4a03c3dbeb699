"""Readers for telemetry tables, logs, configuration and model files."""

from __future__ import annotations

import re
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql import Window as W

from flowgauge import schemas
from flowgauge.functions.scalars import csv_field, mhz_to_hz, task_range
from flowgauge.operators.ordered import running
from flowgauge.operators.rollup import scope


def read_telemetry(
    spark: SparkSession,
    location: str,
    table: str,
    *,
    fmt: str = "parquet",
    history: bool = False,
    **options,
) -> DataFrame:
    """Scan one telemetry table with its fixed schema.

    ``location`` is the folder that holds a folder per table, or the URL for
    ``fmt="jdbc"``. ``history`` adds the ``snapshot_id`` column.
    """
    schema = schemas.TABLES[table]
    if history:
        schema = T.StructType([*schema.fields, T.StructField("snapshot_id", T.IntegerType())])
    if fmt == "jdbc":
        rows = spark.read.format("jdbc").options(url=location, dbtable=table, **options).load()
        return rows.select(*[F.col(f.name).cast(f.dataType).alias(f.name) for f in schema.fields])
    return spark.read.schema(schema).format(fmt).options(**options).load(f"{location}/{table}")


def _glob_literal(text: str) -> str:
    return re.sub(r"([\\*?\[\]{}])", r"\\\1", text)


def read_latency_logs(spark: SparkSession, folder: str, prefix: str) -> DataFrame:
    """``ts_ms,latency_ns`` lines of every file whose name starts with ``prefix``."""
    return (
        spark.read.schema(schemas.LATENCY_LOG)
        .options(mode="FAILFAST", pathGlobFilter=f"{_glob_literal(prefix)}*")
        .csv(folder)
        .select("*", F.col("_metadata.file_name").alias("file"))
    )


def read_throughput_logs(spark: SparkSession, folder: str) -> DataFrame:
    """``ts_ms,count`` lines of every file whose name does not start with ``merge``."""
    return (
        spark.read.schema(schemas.THROUGHPUT_LOG)
        .options(mode="FAILFAST")
        .csv(folder)
        .select("*", F.col("_metadata.file_name").alias("file"))
        .filter(~F.col("file").startswith("merge"))
    )


def read_lines(spark: SparkSession, path: str) -> DataFrame:
    """Text lines with their 0-based number over all files in name order.

    Each scan block numbers its own lines as it reads them; only one row per block
    is counted up across blocks, so the lines are never shuffled or sorted.
    """
    raw = spark.read.text(path).select(
        "value",
        F.col("_metadata.file_path").alias("file"),
        F.col("_metadata.file_block_start").alias("block"),
        F.monotonically_increasing_id().alias("__id"),
    )
    blocks = raw.groupBy("file", "block").agg(
        F.min("__id").alias("__first"), F.count(F.lit(1)).alias("__n")
    )
    before = F.sum("__n").over(W.orderBy("file", "block").rowsBetween(W.unboundedPreceding, -1))
    offsets = blocks.select(
        "file", "block", (F.coalesce(before, F.lit(0)) - F.col("__first")).alias("__shift")
    )
    return raw.join(offsets, ["file", "block"]).select(
        (F.col("__id") + F.col("__shift")).alias("line_no"), "value", "file"
    )


def read_reports(spark: SparkSession, path: str) -> DataFrame:
    """Report lines in arrival order with the second they belong to."""
    return read_lines(spark, path).select(
        F.col("line_no").alias("row_id"),
        csv_field("value", 1, "bigint").alias("second"),
        F.col("value").alias("line"),
    )


# --- configuration ---------------------------------------------------------------


def _numbered(lines: DataFrame, kinds: str) -> DataFrame:
    """``kindN = value`` entries whose numbers run from 0 without a gap.

    Numbering restarts per kind and reading stops at the first missing number. Of a
    key set twice the last line counts, by ``line_no`` if the lines have it (else the
    greatest value, so that reruns agree). A configuration is a few lines per
    component, so the window is small.
    """
    keys = scope(lines)
    pattern = rf"^\s*({kinds})(\d+)\s*[=:]\s*(.*?)\s*$"
    hits = lines.filter(F.col("text").rlike(pattern)).select(
        *keys,
        *(["line_no"] if "line_no" in lines.columns else []),
        F.regexp_extract("text", pattern, 1).alias("entry"),
        F.regexp_extract("text", pattern, 2).try_cast("int").alias("no"),
        F.regexp_replace(F.regexp_extract("text", pattern, 3), " ", "").alias("value"),
    )
    last = F.max_by("value", "line_no") if "line_no" in lines.columns else F.max("value")
    hits = hits.groupBy(*keys, "entry", "no").agg(last.alias("value"))
    expected = F.row_number().over(W.partitionBy(*keys, "entry").orderBy("no")) - 1
    return hits.withColumn("__expected", expected).filter("no = __expected").drop("__expected")


def _known(name: Column, found: Column, what: str) -> Column:
    complaint = F.raise_error(F.concat(F.lit(f"unknown {what}: "), name)).cast("string")
    return F.when(found.isNotNull(), name).otherwise(complaint)


def _named_tasks(lines: DataFrame, components: DataFrame) -> DataFrame:
    keys = scope(lines, components)
    entries = _numbered(lines, "task").select(
        *keys,
        F.split_part("value", F.lit(","), F.lit(1)).alias("component"),
        F.split_part("value", F.lit(","), F.lit(2)).alias("ids"),
    )
    names = components.select(*keys, "component", F.lit(True).alias("__found"))
    return entries.join(names, [*keys, "component"], "left").select(
        *keys,
        _known(F.col("component"), F.col("__found"), "component").alias("component"),
        F.explode(task_range("ids")).alias("task_id"),
    )


def parse_topology_config(lines: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Components, tasks and edges of ``kindN = value`` configuration lines.

    Tasks and edges that name an unknown component fail the job, as does an edge
    that leads into a spout.
    """
    keys = scope(lines)
    declared = _numbered(lines, "spout|bolt")
    components = declared.select(
        *keys,
        F.split_part("value", F.lit(","), F.lit(1)).alias("component"),
        F.col("entry").alias("kind"),
        F.split_part("value", F.lit(","), F.lit(2)).cast("int").alias("parallelism"),
    )
    tasks = _named_tasks(lines, components)
    pairs = _numbered(lines, "edge").select(
        *keys,
        F.split_part("value", F.lit(","), F.lit(1)).alias("src"),
        F.split_part("value", F.lit(","), F.lit(2)).alias("dst"),
    )
    sources = components.select(*keys, F.col("component").alias("src"), F.lit(True).alias("__s"))
    targets = components.filter("kind = 'bolt'").select(
        *keys, F.col("component").alias("dst"), F.lit(True).alias("__d")
    )
    edges = (
        pairs.join(sources, [*keys, "src"], "left")
        .join(targets, [*keys, "dst"], "left")
        .select(
            *keys,
            _known(F.col("src"), F.col("__s"), "edge source").alias("src"),
            _known(F.col("dst"), F.col("__d"), "edge target").alias("dst"),
        )
    )
    return components, tasks, edges


def parse_topology_tasks_update(
    components: DataFrame, tasks: DataFrame, new_lines: DataFrame
) -> DataFrame:
    """Replace the task list of every component the new lines mention."""
    keys = [*scope(components, tasks, new_lines), "component"]
    fresh = _named_tasks(new_lines, components)
    kept = tasks.join(fresh.select(*keys), keys, "left_anti")
    return kept.unionByName(fresh)


# --- host descriptions -----------------------------------------------------------


def host_core_inventory(lines: DataFrame) -> DataFrame:
    """One row per core from ``key : value`` host descriptions.

    ``lines`` has ``host``, ``line_no`` and ``text``. A block starts at each
    ``processor`` line. Blocks are numbered slab by slab, so a host with very many
    lines is not sorted in one task.
    """
    has_colon = F.instr("text", ":") > 0
    fields = lines.filter(has_colon).select(
        "host",
        "line_no",
        F.regexp_extract("text", r"^\s*([^:]*?)\s*:", 1).alias("k"),
        F.regexp_extract("text", r"^[^:]*:\s*(.*?)\s*$", 1).alias("v"),
    )
    starts = fields.withColumn("__starts", (F.col("k") == "processor").cast("bigint"))
    blocks = running(starts, ["host"], "line_no", {"block": ("sum", "__starts")})

    def last(key: str) -> Column:
        mine = F.col("k") == key
        return F.max_by(F.when(mine, F.col("v")), F.when(mine, F.col("line_no")))

    cores = (
        blocks.filter("block > 0")
        .groupBy("host", "block")
        .agg(
            last("processor").cast("int").alias("core"),
            F.coalesce(last("model name"), F.lit("")).alias("model"),
            F.coalesce(mhz_to_hz(last("cpu MHz")), F.lit(0)).alias("speed_hz"),
        )
    )
    return cores.groupBy("host", "core").agg(
        F.max_by("model", "block").alias("model"), F.max_by("speed_hz", "block").alias("speed_hz")
    )


def read_cpu_counters(lines: DataFrame) -> DataFrame:
    """Counter lines ``cpu…`` as one row per host, core and time.

    ``lines`` has ``host``, ``ts_ms`` and ``text``; the whole host is core ``cpu``.
    """
    names = ["user", "nice", "system", "idle", "iowait", "irq", "softirq"]
    parts = F.split(F.regexp_replace("text", " +", " "), " ")
    return lines.filter(F.col("text").startswith("cpu")).select(
        "host",
        parts[0].alias("core"),
        "ts_ms",
        *[parts[i + 1].cast("bigint").alias(name) for i, name in enumerate(names)],
    )


# --- histories and models --------------------------------------------------------


def read_history(spark: SparkSession, path: str, kind: str, *, runs: Sequence[str] | None = None) -> DataFrame:
    """Re-read profiled values: ``worker``, ``load``, ``alfa`` or ``tuple``.

    With ``runs`` only the folders of these runs are listed for reading, and ``run_id`` is added.
    """

    def of_runs(rows: DataFrame) -> DataFrame:
        return rows if runs is None else rows.filter(F.col("run_id").isin(*runs))

    run = [] if runs is None else [T.StructField("run_id", T.StringType())]
    if kind in ("worker", "load"):
        columns = schemas.WORKER_HISTORY if kind == "worker" else schemas.LOAD_HISTORY
        schema = T.StructType([*columns.fields, *run])
        return of_runs(spark.read.schema(schema).options(mode="FAILFAST").csv(path))
    if kind not in ("alfa", "tuple"):
        raise ValueError("kind is worker, load, alfa or tuple")
    edge = r"^\((.*) : (.*)\),(.*)$"
    lines = spark.read.schema(T.StructType([T.StructField("value", T.StringType()), *run])).text(path)
    return of_runs(lines).select(
        F.regexp_extract("value", edge, 1).alias("src"),
        F.regexp_extract("value", edge, 2).alias("dst"),
        F.regexp_extract("value", edge, 3).cast("double").alias(
            "alfa" if kind == "alfa" else "tuple_size"
        ),
        *[f.name for f in run],
    )


def read_model_files(spark: SparkSession, path: str) -> DataFrame:
    """One row per model file: its name and whole text (a few hundred bytes)."""
    return spark.read.text(path, wholetext=True).select(
        F.col("_metadata.file_name").alias("model"), F.col("value").alias("text")
    )


def read_model_weights(files: DataFrame) -> DataFrame:
    """Layer sizes and flat weights from ``key=value`` model text.

    Weights keep the file's order: output layer first, bias last in each row.
    """

    def entry(key: str) -> Column:
        return F.regexp_extract("text", rf"(?m)^{key}=([^\r\n]*)", 1)

    def numbers(key: str, dtype: str) -> Column:
        return F.transform(F.split(entry(key), ","), lambda x: F.trim(x).cast(dtype))

    return files.select(
        "model",
        numbers("layerCounts", "int").alias("layer_counts"),
        numbers("weights", "double").alias("w"),
    )


def latest_file(files: DataFrame) -> DataFrame:
    """Per host the data file with the largest time stamp in its name.

    Names look like ``host.cpu_dataset.<ts>.csv``; others are ignored.
    """
    pattern = r"^(.*?)\.cpu_dataset\.(.*)\.[^.]*$"
    stamped = files.select(
        F.regexp_extract("name", pattern, 1).alias("host"),
        F.regexp_extract("name", pattern, 2).try_cast("bigint").alias("stamp"),
        "name",
    )
    return (
        stamped.filter(F.col("stamp") > 0)
        .groupBy("host")
        .agg(F.max_by("name", F.struct("stamp", "name")).alias("name"))
    )

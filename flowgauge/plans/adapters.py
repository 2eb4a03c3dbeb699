"""Telemetry-shaped views over the driver's tables.

Each method builds one view; the SQL twins are in :mod:`flowgauge.plans.oracles`.
"""

from __future__ import annotations

from functools import cached_property

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from flowgauge.operators.ordered import running
from flowgauge.runtime import cut_lineage

CORE_SPEED = 2_936_012_800


def _whole(c: str) -> Column:
    return F.floor(F.col(c)).cast("bigint")


def micros(c: str) -> Column:
    return F.unix_micros(F.col(c).cast("timestamp"))


class Telemetry:
    """Views over one scale-factor folder."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark = spark
        self.sf_dir = sf_dir.rstrip("/")

    def table(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.sf_dir}/{name}.parquet")

    def stored(self, *names: str) -> Telemetry:
        """Store the named views first, for plans that read them many times."""
        for name in names:
            self.__dict__[name] = cut_lineage(getattr(self, name))
        return self

    # --- graph -----------------------------------------------------------------

    @cached_property
    def components(self) -> DataFrame:
        r = self.table("region")
        return r.select(
            F.col("r_regionkey").alias("component"),
            F.when(F.col("r_regionkey") == 0, F.lit("spout")).otherwise(F.lit("bolt")).alias("kind"),
            F.lit(5).alias("parallelism"),
        )

    @cached_property
    def tasks(self) -> DataFrame:
        return self.table("nation").select(
            F.col("n_regionkey").alias("component"), F.col("n_nationkey").alias("task_id")
        )

    @cached_property
    def edges(self) -> DataFrame:
        r = self.table("region")
        top = r.agg(F.max("r_regionkey")).scalar()
        later = r.select(F.col("r_regionkey").alias("src"), top.alias("top")).filter("src < top")
        pairs = later.select("src", F.explode(F.sequence(F.col("src") + 1, F.col("top"))).alias("dst"))
        return pairs.join(r.select(F.col("r_regionkey").alias("dst")), "dst", "left_semi").select(
            "src", "dst"
        )

    # --- samples ---------------------------------------------------------------

    @cached_property
    def _shipments(self) -> DataFrame:
        """Line items with supplier and customer nation and order date."""
        line = self.table("lineitem").select("l_orderkey", "l_suppkey", "l_extendedprice")
        supplier = self.table("supplier").select(F.col("s_suppkey").alias("l_suppkey"), "s_nationkey")
        customer = self.table("customer").select(F.col("c_custkey").alias("o_custkey"), "c_nationkey")
        orders = self.table("orders").select(
            F.col("o_orderkey").alias("l_orderkey"), "o_custkey", "o_orderdate"
        )
        return (
            line.join(supplier, "l_suppkey")
            .join(orders.join(customer, "o_custkey"), "l_orderkey")
            .select(
                (F.year("o_orderdate") - 1995).alias("snapshot_id"),
                F.col("s_nationkey").alias("source_task_id"),
                F.col("c_nationkey").alias("destination_task_id"),
                "o_orderdate",
                "l_extendedprice",
            )
        )

    @cached_property
    def traffic(self) -> DataFrame:
        return self._shipments.groupBy("snapshot_id", "source_task_id", "destination_task_id").agg(
            F.max("o_orderdate").alias("ts"), F.count(F.lit(1)).alias("traffic")
        )

    @cached_property
    def tuplesize(self) -> DataFrame:
        return self._shipments.groupBy("snapshot_id", "source_task_id", "destination_task_id").agg(
            F.sum(_whole("l_extendedprice")).alias("tuplesizesum"),
            F.count(F.lit(1)).alias("tuplesizecount"),
        )

    @cached_property
    def _orders(self) -> DataFrame:
        customer = self.table("customer").select(F.col("c_custkey").alias("o_custkey"), "c_nationkey")
        return (
            self.table("orders")
            .select("o_custkey", "o_orderdate", "o_totalprice")
            .join(customer, "o_custkey")
            .withColumn("snapshot_id", F.year("o_orderdate") - 1995)
        )

    @cached_property
    def load(self) -> DataFrame:
        return (
            self._orders.groupBy("snapshot_id", F.col("c_nationkey").alias("task_id"))
            .agg(F.max("o_orderdate").alias("ts"), F.sum(_whole("o_totalprice")).alias("load"))
            .select(
                "snapshot_id",
                "task_id",
                F.concat(F.lit("w"), F.col("task_id") % 4).alias("worker_hostname"),
                (6700 + F.col("task_id") % 2).alias("worker_port"),
                "ts",
                "load",
            )
        )

    @cached_property
    def worker(self) -> DataFrame:
        host = F.concat(F.lit("w"), F.col("c_nationkey") % 4)
        return self._orders.groupBy("snapshot_id", host.alias("hostname")).agg(
            F.lit(6700).alias("port"),
            F.max("o_orderdate").alias("ts"),
            (F.count(F.lit(1)) % 101).cast("int").alias("cpu_usage"),
        )

    @cached_property
    def node(self) -> DataFrame:
        return (
            self.table("nation")
            .select(
                F.concat(F.lit("w"), F.col("n_nationkey") % 4).alias("hostname"),
                (2 + F.col("n_nationkey") % 4).alias("core_count"),
                F.lit(CORE_SPEED).cast("bigint").alias("core_speed"),
            )
            .distinct()
        )

    # --- logs ------------------------------------------------------------------

    @cached_property
    def events(self) -> DataFrame:
        return self.table("events")

    @cached_property
    def latency(self) -> DataFrame:
        return self.events.select(
            F.expr("unix_micros(cast(ts as timestamp)) div 1000000").alias("ts_ms"),
            F.floor(F.col("value") * 1_000_000).cast("bigint").alias("latency_ns"),
            F.col("event_type").alias("file"),
        )

    @cached_property
    def throughput(self) -> DataFrame:
        return self.events.select(
            F.expr("unix_micros(cast(ts as timestamp)) div 1000000").alias("ts_ms"),
            (1 + F.col("user_id") % 3).alias("cnt"),
            F.col("event_type").alias("file"),
        )

    @cached_property
    def reports(self) -> DataFrame:
        late = F.when(F.col("event_id") % 7 == 0, F.lit(1)).otherwise(F.lit(0))
        return self.events.select(
            F.col("event_id").alias("row_id"),
            (
                F.expr("(unix_micros(cast(ts as timestamp)) - 1704067200000000) div 3600000000") - late
            ).alias("second"),
        )

    @cached_property
    def cpu_samples(self) -> DataFrame:
        """Counters that only grow, from the slab-wise running sum."""
        base = self.events.select(
            F.concat(F.lit("h"), F.col("user_id") % 4).alias("host"),
            (F.col("user_id") % 2).cast("int").alias("core"),
            F.col("event_id").alias("seq"),
            "ts",
            F.floor(F.col("value") * 100).cast("bigint").alias("__busy"),
            (10000 - _whole("value")).alias("__idle"),
        )
        counted = running(
            base, ["host", "core"], "seq", {"busy": ("sum", "__busy"), "idle": ("sum", "__idle")}
        )
        return counted.select("host", "core", "seq", "ts", "busy", "idle")

    @cached_property
    def lines(self) -> DataFrame:
        rem = F.col("event_id") % 3
        return self.events.select(
            F.col("event_id").alias("row_id"),
            F.when(
                rem == 0,
                F.concat("event_type", F.lit(","), F.col("user_id").cast("string"), F.lit("*"), "props"),
            )
            .when(rem == 1, F.concat("event_type", F.lit("#"), "props"))
            .otherwise(F.col("event_type"))
            .alias("line"),
        )

    # --- executors and placements ----------------------------------------------

    @cached_property
    def executors(self) -> DataFrame:
        return (
            self.table("nation")
            .groupBy(F.expr("n_nationkey div 5").cast("int").alias("executor"))
            .agg(F.min("n_nationkey").alias("start_task"), F.max("n_nationkey").alias("end_task"))
            .select(
                "executor",
                F.concat(F.lit("c"), F.col("start_task")).alias("component"),
                "start_task",
                "end_task",
            )
        )

    @cached_property
    def placements(self) -> DataFrame:
        r = self.table("region")
        opened = self.executors.select(
            "executor",
            F.explode(
                F.sequence(r.agg(F.min("r_regionkey")).scalar(), r.agg(F.max("r_regionkey")).scalar())
            ).alias("allocation_id"),
        )
        known = r.select(F.col("r_regionkey").alias("allocation_id"))
        e, a = F.col("executor"), F.col("allocation_id")
        return opened.join(known, "allocation_id", "left_semi").select(
            "allocation_id",
            "executor",
            F.concat(F.lit("w"), (e * (a + 1)) % 4).alias("hostname"),
            (6700 + (e + a) % 2).alias("port"),
        )

"""One query per operator over the driver's tables, each with its SQL twin."""

from __future__ import annotations

import time
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from flowgauge import schemas
from flowgauge.functions import scalars as S
from flowgauge.operators import capacity as K
from flowgauge.operators import cpu as C
from flowgauge.operators import filters as P
from flowgauge.operators import models as J
from flowgauge.operators import propagate as G
from flowgauge.operators import rollup as R
from flowgauge.operators import selectivity as A
from flowgauge.operators import series as E
from flowgauge.plans.adapters import Telemetry
from flowgauge.plans.oracles import with_views
from flowgauge.runtime import scratch_path
from flowgauge.sources import quarantine as Q
from flowgauge.sources import readers as SRC
from flowgauge.sources import state as ST
from flowgauge.sources import writers as SNK
from flowgauge.streaming import keyed as KS
from flowgauge.streaming import streams as L

MAX_SEC = 11740.0
CPU_ORDER = {"order": "seq"}


@dataclass(frozen=True)
class Entry:
    run: Callable[[Telemetry], DataFrame]
    sql: str | None


CATALOG: dict[str, Entry] = {}


def query(name: str, sql: str | None = None):
    def register(fn: Callable[[Telemetry], DataFrame]):
        CATALOG[name] = Entry(fn, sql)
        return fn

    return register


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    def bind(entry: Entry):
        return lambda spark, sf_dir: entry.run(Telemetry(spark, sf_dir))

    return {name: bind(entry) for name, entry in CATALOG.items()}


def oracle_sql() -> dict[str, str]:
    return {name: with_views(e.sql) for name, e in CATALOG.items() if e.sql is not None}


def r9(c: Column | str) -> Column:
    return F.round(F.col(c) if isinstance(c, str) else c, 9)


def text(c: str) -> Column:
    return F.array_join(F.col(c).cast("array<string>"), ",")


def as_double(df: DataFrame, *columns: str) -> DataFrame:
    """Whole numbers that may be NULL, in the type both engines hand over alike."""
    return df.withColumns({c: F.col(c).cast("double") for c in columns})


# --- shared intermediate results ---------------------------------------------------


def weights(t: Telemetry) -> DataFrame:
    return R.edge_traffic(t.traffic, t.tasks, t.edges)


def alfa(t: Telemetry) -> DataFrame:
    return A.edge_selectivity(weights(t), t.components)


def mean_alfa(t: Telemetry) -> DataFrame:
    return A.mean_selectivity(alfa(t))


def max_traffic(t: Telemetry) -> DataFrame:
    return G.propagate_max_traffic(t.edges, mean_alfa(t), t.components, MAX_SEC)


def points(t: Telemetry) -> DataFrame:
    return R.task_points(t.traffic, t.load, t.tasks, t.components)


def component_train(t: Telemetry) -> DataFrame:
    t = t.stored("traffic", "load")
    return J.component_training_set(
        points(t), t.components, max_traffic(t), t.node, max_sec=MAX_SEC
    )


def worker_train(t: Telemetry) -> DataFrame:
    t = t.stored("traffic", "load")
    return J.worker_training_set(
        R.worker_points(t.traffic, t.load, t.worker), max_traffic(t), t.node
    )


def models(t: Telemetry) -> DataFrame:
    """Fixed example weights per component, so that scoring has an exact twin."""
    one = F.col("component") + 1
    w = [((one * (i + 3)) % 7 - 3) / 4.0 for i in range(10)]
    return t.components.select("component", F.array(*w).alias("w"))


def worker_model(t: Telemetry) -> DataFrame:
    w = F.array(*[F.lit(((i * 5) % 11 - 5) / 8.0) for i in range(21)])
    return t.components.agg(F.count(F.lit(1))).select(w.alias("w"))


def linear_points(t: Telemetry) -> DataFrame:
    return component_train(t).select(
        "component", "task_id", "snapshot_id", "norm_traffic", "norm_load"
    )


def exec_load(t: Telemetry) -> DataFrame:
    return R.executor_latest_load(t.load, t.executors).join(
        t.executors.select("executor", "start_task"), "executor"
    )


def pair_traffic(t: Telemetry) -> DataFrame:
    return R.executor_pair_traffic(t.traffic, t.executors)


def scores(t: Telemetry) -> DataFrame:
    return K.placement_score(
        K.node_load_stats(t.placements, exec_load(t), t.node),
        K.placement_traffic_split(t.placements, pair_traffic(t)),
    )


def tenant(executor: str = "executor") -> Column:
    return F.concat(F.lit("t"), F.col(executor) % 2)


def constraints(t: Telemetry) -> DataFrame:
    executors = t.executors.withColumn("topology_id", tenant())
    wanted = executors.select("topology_id").distinct().withColumn("requested_workers", F.lit(2))
    return K.placement_constraints(
        t.placements.withColumn("topology_id", tenant()), executors, wanted
    )


def workers(t: Telemetry) -> DataFrame:
    """Four slots per host."""
    return t.node.select(
        "hostname", F.explode(F.sequence(F.lit(6700), F.lit(6703))).alias("port")
    )


def zipped(t: Telemetry) -> DataFrame:
    driver = E.merged_throughput_per_second(t.throughput)
    return E.plot_series(
        driver, E.throughput_per_second(t.latency), E.latency_per_second(t.latency), k=3
    )


def rolling_samples(t: Telemetry) -> DataFrame:
    return t.cpu_samples.select(
        "host", "seq", (F.col("busy") * 100000).alias("cpu_ns"), F.lit(2).alias("cores")
    )


def readings(t: Telemetry) -> DataFrame:
    return t.cpu_samples.select(
        F.col("host").alias("task_id"),
        F.expr("unix_micros(cast(ts as timestamp)) div 1000000").alias("ts_ms"),
        (F.col("busy") * 1000).alias("cpu_ns"),
    )


def whatif(t: Telemetry) -> DataFrame:
    return K.sizing_whatif(exec_load(t), t.node)


def named_lines(t: Telemetry) -> DataFrame:
    """Configuration text for the adapter graph."""
    name = F.concat(F.lit("c"), F.col("component").cast("string"))
    bolts = F.when(F.col("kind") == "spout", F.lit(0)).otherwise(F.col("component") - 1)
    declared = t.components.select(
        F.concat(F.col("kind"), bolts, F.lit(" = "), name, F.lit(","), "parallelism").alias("text")
    )
    ranges = t.tasks.select(
        F.concat(
            F.lit("task"), "task_id", F.lit("  = "), name, F.lit(", "), "task_id", F.lit("-"),
            F.col("task_id") + 1,
        ).alias("text")
    )
    top = t.components.agg(F.count(F.lit(1))).scalar()
    # Position of the pair in (src, dst) order of a complete forward graph.
    number = F.expr("cast(src * (2 * n - src - 1) / 2 + dst - src - 1 as int)")
    links = t.edges.withColumn("n", top).select(
        F.concat(F.lit("edge"), number, F.lit("= c"), "src", F.lit(",c"), "dst").alias("text")
    )
    noise = t.components.agg(F.count(F.lit(1))).select(F.lit("# comment").alias("text"))
    return declared.unionByName(ranges).unionByName(links).unionByName(noise)


# === A: sources ====================================================================


@query(
    "read_telemetry",
    """select 'app' as topology_id, task_id, cast(epoch_us(ts) // 1000000 as bigint) as ts_s,
              worker_hostname, worker_port, load, snapshot_id from fx_load""",
)
def _(t):
    path = scratch_path(t.spark, "tables")
    t.load.select(
        F.lit("app").alias("topology_id"),
        "task_id",
        F.col("ts").cast("timestamp").alias("ts"),
        "worker_hostname",
        "worker_port",
        "load",
        "snapshot_id",
    ).write.parquet(f"{path}/load")
    back = SRC.read_telemetry(t.spark, path, "load", history=True)
    return back.select(
        "topology_id", "task_id", F.unix_seconds("ts").alias("ts_s"), "worker_hostname",
        "worker_port", "load", "snapshot_id",
    )


def scanned(t: Telemetry, table: str, rows: DataFrame) -> DataFrame:
    """Store rows as a telemetry table and read it back with its fixed schema."""
    path = scratch_path(t.spark, "tables")
    named = rows.withColumns({"topology_id": F.lit("app"), "ts": F.col("ts").cast("timestamp")}) if "ts" in rows.columns else rows
    wanted = [f.name for f in schemas.TABLES[table].fields]
    history = [c for c in ("snapshot_id",) if c in rows.columns]
    typed = [F.col(f.name).cast(f.dataType).alias(f.name) for f in schemas.TABLES[table].fields]
    named.select(*typed, *[F.col(c).cast("int").alias(c) for c in history]).write.parquet(f"{path}/{table}")
    back = SRC.read_telemetry(t.spark, path, table, history=bool(history))
    seconds = [F.unix_seconds("ts").alias("ts_s")] if "ts" in wanted else []
    return back.select(*[c for c in back.columns if c != "ts"], *seconds)


@query(
    "read_telemetry_traffic",
    """select 'app' as topology_id, cast(source_task_id as int) as source_task_id,
              cast(destination_task_id as int) as destination_task_id, traffic, cast(snapshot_id as int) as snapshot_id,
              cast(epoch_us(ts) // 1000000 as bigint) as ts_s from fx_traffic""",
)
def _(t):
    return scanned(t, "traffic", t.traffic)


@query(
    "read_telemetry_worker",
    """select hostname, cast(port as int) as port, cast(cpu_usage as int) as cpu_usage,
              cast(snapshot_id as int) as snapshot_id, cast(epoch_us(ts) // 1000000 as bigint) as ts_s
       from fx_worker""",
)
def _(t):
    return scanned(t, "worker", t.worker)


@query(
    "read_telemetry_node",
    "select hostname, cast(core_count as int) as core_count, cast(core_speed as bigint) as core_speed from fx_node",
)
def _(t):
    return scanned(t, "node", t.node)


@query(
    "read_telemetry_tuplesize",
    """select 'app' as topology_id, cast(z.source_task_id as int) as source_task_id,
              cast(z.destination_task_id as int) as destination_task_id, tuplesizesum, tuplesizecount,
              cast(z.snapshot_id as int) as snapshot_id, cast(epoch_us(ts) // 1000000 as bigint) as ts_s
       from fx_tuplesize z join fx_traffic x on x.snapshot_id = z.snapshot_id
            and x.source_task_id = z.source_task_id and x.destination_task_id = z.destination_task_id""",
)
def _(t):
    keys = ["snapshot_id", "source_task_id", "destination_task_id"]
    return scanned(t, "tuplesize", t.tuplesize.join(t.traffic.select(*keys, "ts"), keys))


@query("read_latency_logs", "select ts_ms, latency_ns from fx_latency")
def _(t):
    path = scratch_path(t.spark, "latency")
    t.latency.select("ts_ms", "latency_ns").write.csv(path)
    return SRC.read_latency_logs(t.spark, path, "part-").select("ts_ms", "latency_ns")


@query("read_throughput_logs", "select ts_ms, cnt from fx_throughput")
def _(t):
    path = scratch_path(t.spark, "throughput")
    t.throughput.select("ts_ms", "cnt").write.csv(path)
    return SRC.read_throughput_logs(t.spark, path).select("ts_ms", "cnt")


@query(
    "quarantine_lines",
    """select reason, line, ts_ms::double as ts_ms, cnt::double as cnt, count(*) as n from (
         select case when pos % 11 = 0 then 'empty line' when pos % 7 = 0 then '2 fields expected, 3 found'
                     when pos % 5 = 0 then 'cnt is no bigint' end as reason,
                case when pos % 11 = 0 then ' ' when pos % 7 = 0 then concat(ts_ms, ',', cnt, ',more')
                     when pos % 5 = 0 then concat(ts_ms, ',x', cnt) end as line,
                case when pos % 11 <> 0 and pos % 7 <> 0 and pos % 5 <> 0 then ts_ms end as ts_ms,
                case when pos % 11 <> 0 and pos % 7 <> 0 and pos % 5 <> 0 then cnt end as cnt
         from (select event_id as pos, epoch_us(ts) // 1000000 as ts_ms, 1 + user_id % 3 as cnt from events))
       group by 1, 2, 3, 4""",
)
def _(t):
    pos, (ts, cnt) = F.col("event_id"), (F.col(c).cast("string") for c in ("ts_ms", "cnt"))
    rows = t.events.select(
        "event_id",
        F.expr("unix_micros(cast(ts as timestamp)) div 1000000").alias("ts_ms"),
        (1 + F.col("user_id") % 3).alias("cnt"),
    )
    path = scratch_path(t.spark, "logs")
    rows.select(
        F.when(pos % 11 == 0, F.lit(" "))
        .when(pos % 7 == 0, F.concat_ws(",", ts, cnt, F.lit("more")))
        .when(pos % 5 == 0, F.concat(ts, F.lit(",x"), cnt))
        .otherwise(F.concat_ws(",", ts, cnt))
    ).write.text(path)
    good, bad = Q.read_checked_log(t.spark, path, schemas.THROUGHPUT_LOG, scratch_path(t.spark, "checked"))
    none = [F.lit(None).cast("string").alias(c) for c in ("reason", "line")]
    empty = [F.lit(None).cast("bigint").alias(c) for c in ("ts_ms", "cnt")]
    both = good.select(*none, "ts_ms", "cnt").unionByName(bad.select("reason", "line", *empty))
    return as_double(both.groupBy("reason", "line", "ts_ms", "cnt").agg(F.count(F.lit(1)).alias("n")), "ts_ms", "cnt")


@query("read_reports", "select row_id, second from fx_reports")
def _(t):
    path = scratch_path(t.spark, "reports")
    t.reports.orderBy("row_id").select(
        F.concat_ws(",", F.lit("0"), F.col("second").cast("string"), F.col("row_id").cast("string"))
    ).write.text(path)
    return SRC.read_reports(t.spark, path).select("row_id", "second")


@query(
    "parse_topology_config",
    """select 'component' as item, concat('c', component) as a,
              concat(kind, ',', parallelism) as b from fx_components
       union all
       select distinct 'task', concat('c', component), cast(id as varchar)
       from (select component, unnest([task_id, task_id + 1]) as id, task_id from fx_tasks)
       union all select 'edge', concat('c', src), concat('c', dst) from fx_edges""",
)
def _(t):
    components, tasks, edges = SRC.parse_topology_config(named_lines(t))
    return (
        components.select(
            F.lit("component").alias("item"),
            F.col("component").alias("a"),
            F.concat_ws(",", "kind", F.col("parallelism").cast("string")).alias("b"),
        )
        .unionByName(
            tasks.distinct().select(
                F.lit("task").alias("item"),
                F.col("component").alias("a"),
                F.col("task_id").cast("string").alias("b"),
            )
        )
        .unionByName(
            edges.select(F.lit("edge").alias("item"), F.col("src").alias("a"), F.col("dst").alias("b"))
        )
    )


@query(
    "parse_topology_tasks_update",
    """select component, task_id from
         (select concat('c', component) as component, task_id from fx_tasks where component <> 1)
       union all
       select 'c1', cast(unnest(generate_series(100, 100 + (select count(*) from fx_tasks) - 1)) as int)""",
)
def _(t):
    named = t.tasks.select(F.concat(F.lit("c"), "component").alias("component"), "task_id")
    components = t.components.select(F.concat(F.lit("c"), "component").alias("component"))
    lines = t.tasks.agg(F.count(F.lit(1)).alias("n")).select(
        F.concat(F.lit("task0 = c1,100-"), 99 + F.col("n")).alias("text")
    )
    return SRC.parse_topology_tasks_update(components, named, lines)


@query(
    "host_core_inventory",
    """select concat('h', s_nationkey) as host, cast(s_suppkey as int) as core, s_name as model,
              cast(floor(cast(1000 + abs(s_acctbal) as float)) as bigint) * 1048576 as speed_hz
       from supplier""",
)
def _(t):
    return SRC.host_core_inventory(host_lines(t))


def host_lines(t: Telemetry) -> DataFrame:
    fields = [
        F.concat(F.lit("processor\t: "), F.col("s_suppkey").cast("string")),
        F.concat(F.lit("model name\t: "), "s_name"),
        F.concat(F.lit("cpu MHz\t\t: "), (1000 + F.abs("s_acctbal")).cast("string")),
        F.lit("flags without a colon"),
    ]
    return t.table("supplier").select(
        F.concat(F.lit("h"), "s_nationkey").alias("host"),
        "s_suppkey",
        F.posexplode(F.array(*fields)).alias("i", "text"),
    ).select("host", (F.col("s_suppkey") * 4 + F.col("i")).alias("line_no"), "text")


@query(
    "host_speed",
    """select concat('h', s_nationkey) as host, count(*) as cores,
              cast(sum(cast(floor(cast(1000 + abs(s_acctbal) as float)) as bigint) * 1048576)
                   as bigint) as speed_hz
       from supplier group by 1""",
)
def _(t):
    return C.host_speed(SRC.host_core_inventory(host_lines(t)))


@query(
    "read_cpu_counters",
    """select concat('h', l_suppkey) as host,
              case when l_linenumber = 1 then 'cpu' else concat('cpu', l_linenumber) end as core,
              l_orderkey as ts_ms, l_orderkey as "user", l_partkey as nice, l_suppkey as "system",
              cast(floor(l_quantity) as bigint) as idle, l_orderkey + 1 as iowait,
              l_partkey + 2 as irq, l_suppkey + 3 as softirq
       from lineitem""",
)
def _(t):
    line = t.table("lineitem")
    core = F.when(F.col("l_linenumber") == 1, F.lit("cpu ")).otherwise(
        F.concat(F.lit("cpu"), "l_linenumber")
    )
    values = [
        F.col("l_orderkey"), F.col("l_partkey"), F.col("l_suppkey"),
        F.floor("l_quantity").cast("bigint"), F.col("l_orderkey") + 1, F.col("l_partkey") + 2,
        F.col("l_suppkey") + 3,
    ]
    return SRC.read_cpu_counters(
        line.select(
            F.concat(F.lit("h"), "l_suppkey").alias("host"),
            F.col("l_orderkey").alias("ts_ms"),
            F.concat_ws(" ", core, *[v.cast("string") for v in values]).alias("text"),
        )
    )


@query(
    "read_history",
    """select cast(src as varchar) as src, cast(dst as varchar) as dst, round(alfa, 9) as alfa
       from fx_alfa""",
)
def _(t):
    path = scratch_path(t.spark, "history")
    SNK.write_history(alfa(t), path, "alfa", run_id="1")
    return SRC.read_history(t.spark, path, "alfa").select("src", "dst", r9("alfa").alias("alfa"))


@query(
    "read_model_weights",
    """select cast(vec_id as varchar) as model, concat(len(embedding), ',1') as layers,
              cast(len(embedding) as int) as n,
              round(list_sum([floor(x::double * 1000) / 8.0::double for x in embedding]), 6) as total
       from embeddings""",
)
def _(t):
    numbers = F.transform(
        "embedding", lambda x: (F.floor(x.cast("double") * 1000) / 8.0).cast("string")
    )
    files = t.table("embeddings").select(
        F.col("vec_id").cast("string").alias("model"),
        F.concat(
            F.lit("[NETWORK]\nlayerCounts="), F.size("embedding").cast("string"),
            F.lit(",1\nweights="), F.array_join(numbers, ","), F.lit("\nend=1"),
        ).alias("text"),
    )
    total = F.aggregate("w", F.lit(0.0), lambda a, x: a + x)
    return SRC.read_model_weights(files).select(
        "model", text("layer_counts").alias("layers"), F.size("w").alias("n"),
        F.round(total, 6).alias("total"),
    )


@query(
    "latest_file",
    """select concat('h', user_id % 4) as host,
              concat('h', user_id % 4, '.cpu_dataset.', max(event_id), '.csv') as name
       from events where event_id % 5 <> 0 group by user_id % 4""",
)
def _(t):
    stamp = F.when(F.col("event_id") % 5 == 0, F.lit("broken")).otherwise(
        F.col("event_id").cast("string")
    )
    return SRC.latest_file(
        t.events.select(
            F.concat(F.lit("h"), F.col("user_id") % 4, F.lit(".cpu_dataset."), stamp, F.lit(".csv"))
            .alias("name")
        )
    )


# === B: sinks ======================================================================


@query(
    "upsert_state",
    """select task_id, arg_max(worker_hostname, ts) as worker_hostname,
              arg_max(load, ts) as load, arg_max(snapshot_id, ts) as snapshot_id
       from fx_load group by 1""",
)
def _(t):
    state, updates = t.load.filter("snapshot_id <= 2"), t.load.filter("snapshot_id > 2")
    return SNK.upsert_state(state, updates, ["task_id"]).select(
        "task_id", "worker_hostname", "load", "snapshot_id"
    )


@query(
    "bucketed_state",
    """select task_id, arg_max(worker_hostname, ts) as worker_hostname,
              arg_max(load, ts) as load, arg_max(snapshot_id, ts) as snapshot_id
       from fx_load group by 1""",
)
def _(t):
    path, load = scratch_path(t.spark, "state"), t.stored("load").load
    for version, rows in enumerate((load.filter("snapshot_id <= 2"), load.filter("snapshot_id > 2"))):
        ST.apply_rows(rows, path, ["task_id"], version, buckets=16)
    return ST.read_state(t.spark, path).select("task_id", "worker_hostname", "load", "snapshot_id")


@query(
    "write_history",
    """select host, traffic_in, traffic_out, load, cast(cpu as int) as cpu from fx_worker_points""",
)
def _(t):
    path = scratch_path(t.spark, "history")
    SNK.write_history(R.worker_points(t.traffic, t.load, t.worker), path, "worker", run_id="1")
    return SRC.read_history(t.spark, path, "worker").select(
        "host", "traffic_in", "traffic_out", "load", "cpu"
    )


@query(
    "write_training_set",
    """select cast(component as int) as component, round(norm_traffic, 9) as norm_traffic,
              round(norm_load, 9) as norm_load from fx_component_train""",
)
def _(t):
    path = scratch_path(t.spark, "train")
    SNK.write_training_set(component_train(t), path, columns=["norm_traffic", "norm_load"])
    back = t.spark.read.schema("norm_traffic double, norm_load double, component int").csv(path)
    return back.select("component", r9("norm_traffic").alias("norm_traffic"), r9("norm_load").alias("norm_load"))


@query(
    "write_second_series",
    """select second as line_no, case when n is null then '' else concat(second, ',', n) end as value
       from fx_throughput_series""",
)
def _(t):
    path = scratch_path(t.spark, "series")
    SNK.write_second_series(E.throughput_per_second(t.latency), path, value="n")
    return SRC.read_lines(t.spark, path).select("line_no", "value")


@query(
    "format_plot_rows",
    """select replace(case when spout is null
                           then concat_ws(';', second, data_driver::double, data_driver_avg)
                           else concat_ws(';', second, data_driver::double, data_driver_avg,
                                          spout::double, spout_avg, latency::double, latency_avg)
                           end, '.', ',') as value
       from fx_smooth
       union all
       select 'time;data driver;data driver_avg;spout;spout_avg;latency;latency_avg;'""",
)
def _(t):
    return E.format_plot_rows(zipped(t))


@query(
    "sizing_history",
    """select snapshot_id as ts, max(nodes) as nodes,
              string_agg(entry, ',' order by entry) as executors
       from (select l.snapshot_id, concat(e.component, ':', count(*)) as entry,
                    count(distinct worker_hostname) as nodes
             from fx_load l join fx_executor_tasks e on e.task_id = l.task_id
             group by l.snapshot_id, e.component) group by 1""",
)
def _(t):
    assessed = R.executor_of_task(t.load, t.executors).groupBy(
        F.col("snapshot_id").alias("ts"), "component"
    ).agg(
        F.count(F.lit(1)).alias("parallelism"), F.countDistinct("worker_hostname").alias("nodes")
    )
    return K.sizing_history(assessed)


@query(
    "retain_running",
    """select concat('t', task_id % 3) as topology_id, snapshot_id, task_id, load
       from fx_load where task_id % 3 in (select distinct component % 2 from fx_tasks)""",
)
def _(t):
    rows = t.load.select(
        F.concat(F.lit("t"), F.col("task_id") % 3).alias("topology_id"), "snapshot_id", "task_id", "load"
    )
    running = t.tasks.select(F.concat(F.lit("t"), F.col("component") % 2).alias("topology_id"))
    return SNK.retain_running(rows, running)


# === C: filters ====================================================================


@query("drop_warmup", "select snapshot_id, task_id, load from fx_load where snapshot_id > 0")
def _(t):
    return P.drop_warmup(t.load).select("snapshot_id", "task_id", "load")


@query("user_tasks", "select snapshot_id, task_id, load from fx_load where task_id > 0")
def _(t):
    return P.user_tasks(t.load).select("snapshot_id", "task_id", "load")


@query("components_of_kind", "select component, kind from fx_components where kind = 'bolt'")
def _(t):
    return P.components_of_kind(t.components, "bolt").select("component", "kind")


@query("component_by_name", "select component, kind, parallelism from fx_components where component = 2")
def _(t):
    return P.component_by_name(t.components, 2)


@query(
    "only_topology",
    """select 't1' as topology_id, snapshot_id, task_id, load from fx_load where task_id % 3 = 1""",
)
def _(t):
    rows = t.load.select(
        F.concat(F.lit("t"), F.col("task_id") % 3).alias("topology_id"), "snapshot_id", "task_id", "load"
    )
    return P.only_topology(rows, "t1")


@query("positive_traffic", "select allocation_id, src_executor, dst_executor, traffic from fx_placed")
def _(t):
    return K.positive_traffic(K.placed_traffic(t.placements, pair_traffic(t))).select(
        "allocation_id", "src_executor", "dst_executor", "traffic"
    )


@query("node_capacity", "select hostname as host, core_count * core_speed as speed from fx_node")
def _(t):
    return P.node_capacity(t.node)


@query("first_timestamp", "select cast(min(epoch_us(ts)) as bigint) as first_us from fx_traffic")
def _(t):
    return P.first_timestamp(t.traffic).select(
        F.unix_micros(F.col("first_ts").cast("timestamp")).alias("first_us")
    )


# === D: joins ======================================================================


@query("edge_traffic", "select snapshot_id, src, dst, weight from fx_edge_traffic")
def _(t):
    return weights(t)


@query(
    "worker_traffic",
    """select 'in' as direction, snapshot_id, host, traffic from fx_worker_in
       union all select 'out', snapshot_id, host, traffic from fx_worker_out""",
)
def _(t):
    sides = [
        R.worker_traffic(t.traffic, t.load, d).select(
            F.lit(d).alias("direction"), "snapshot_id", "host", "traffic"
        )
        for d in ("in", "out")
    ]
    return sides[0].unionByName(sides[1])


@query("task_points", "select snapshot_id, task_id, component, traffic, load from fx_task_points")
def _(t):
    return points(t)


@query(
    "worker_points",
    "select snapshot_id, host, traffic_in, traffic_out, load, cpu from fx_worker_points",
)
def _(t):
    return R.worker_points(t.traffic, t.load, t.worker)


@query(
    "executor_of_task",
    """select l.snapshot_id, l.task_id, l.load, e.executor, e.component
       from fx_load l join fx_executors e on l.task_id between e.start_task and e.end_task""",
)
def _(t):
    return R.executor_of_task(t.load, t.executors).select(
        "snapshot_id", "task_id", "load", "executor", "component"
    )


@query(
    "executors_in_component",
    """select b.component, e.executor, e.start_task, e.end_task
       from fx_executors e join (select component, min(task_id) as lo, max(task_id) as hi
                                 from fx_tasks group by 1) b
         on e.start_task >= b.lo and e.end_task <= b.hi""",
)
def _(t):
    return R.executors_in_component(t.executors, R.component_task_bounds(t.tasks))


@query("placed_traffic", "select allocation_id, src_executor, dst_executor, traffic, span from fx_placed")
def _(t):
    return K.placed_traffic(t.placements, pair_traffic(t))


@query(
    "cluster_nodes",
    """select hostname as host, core_count * core_speed as speed, hostname <> 'w3' as supervised
       from fx_node""",
)
def _(t):
    hosts = t.node.select(F.col("hostname").alias("host")).filter("host <> 'w3'")
    return (
        K.cluster_nodes(t.node, hosts)
        .withColumn("supervised", F.lit(True))
        .unionByName(K.nodes_without_supervisor(t.node, hosts).withColumn("supervised", F.lit(False)))
    )


@query(
    "zip_by_position",
    """select second, data_driver, spout::double as spout, latency::double as latency
       from fx_zipped""",
)
def _(t):
    zipped_rows = E.zip_by_position(
        E.merged_throughput_per_second(t.throughput).withColumnRenamed("n", "data_driver"),
        E.throughput_per_second(t.latency).withColumnRenamed("n", "spout"),
        E.latency_per_second(t.latency).withColumnRenamed("latency_ms", "latency"),
    )
    return as_double(zipped_rows, "spout", "latency")


@query(
    "parallelism_changes",
    """select component, parallelism as target, n as actual
       from (select c.component, c.parallelism + c.component % 2 as parallelism, a.n
             from fx_components c join (select component, count(*) as n from fx_tasks group by 1) a
               on a.component = c.component) where parallelism <> n""",
)
def _(t):
    target = t.components.select(
        "component", (F.col("parallelism") + F.col("component") % 2).alias("parallelism")
    )
    actual = t.tasks.groupBy("component").agg(F.count(F.lit(1)).alias("parallelism"))
    return K.parallelism_changes(target, actual)


@query(
    "sink_components",
    """select component, kind from fx_components
       where component in (select dst from fx_edges) and component not in (select src from fx_edges)""",
)
def _(t):
    return R.sink_components(t.components, t.edges).select("component", "kind")


@query(
    "free_workers",
    """select hostname, port from (select hostname, cast(unnest(generate_series(6700, 6703)) as int) as port
                                   from fx_node)
       where (hostname, port) not in (select (hostname, port) from fx_placements)""",
)
def _(t):
    return K.free_workers(workers(t), t.placements)


@query(
    "free_worker_counts",
    """select w.hostname, count(*) filter (where p.port is null) as free
       from (select hostname, cast(unnest(generate_series(6700, 6703)) as int) as port from fx_node) w
       left join (select distinct hostname, port from fx_placements) p
         on p.hostname = w.hostname and p.port = w.port group by 1""",
)
def _(t):
    return K.free_worker_counts(workers(t), t.placements)


@query(
    "sizing_candidates",
    """select executor, unnest(generate_series(1, (select count(*) from fx_node))) as node_count
       from fx_executors""",
)
def _(t):
    nodes = t.node.agg(F.count(F.lit(1))).scalar()
    return K.sizing_candidates(t.executors, nodes).select("executor", "node_count")


@query(
    "unallocated_executors",
    """select executor, component from fx_executors
       where executor not in (select executor from fx_placements where hostname = 'w3')""",
)
def _(t):
    return K.unallocated_executors(
        t.executors, t.placements.filter("hostname = 'w3'")
    ).select("executor", "component")


@query(
    "current_placement",
    """select e.start_task, e.executor, e.component, p.hostname, p.port
       from fx_placements p join fx_executors e on e.executor = p.executor""",
)
def _(t):
    node_id = F.concat(F.lit("node-"), "hostname").alias("node_id")
    assigned = t.placements.join(t.executors.select("executor", "start_task"), "executor").select(
        "start_task", node_id, "port"
    )
    return K.current_placement(assigned, workers(t).select(node_id, "hostname", "port"), t.executors)


# === E: aggregates =================================================================


@query("stream_in_task", "select snapshot_id, task_id, traffic_in from fx_stream_in_task")
def _(t):
    return R.stream_in_task(t.traffic)


@query("stream_out_task", "select snapshot_id, task_id, traffic_out from fx_stream_out_task")
def _(t):
    return R.stream_out_task(t.traffic)


@query("load_of_task", "select snapshot_id, task_id, component, load from fx_task_points")
def _(t):
    return R.load_of_task(t.tasks, t.load)


@query(
    "component_load",
    """select l.snapshot_id, t.component, cast(sum(load) as bigint) as load
       from fx_load l join fx_tasks t on t.task_id = l.task_id group by 1, 2""",
)
def _(t):
    return R.component_load(t.tasks, t.load)


@query(
    "component_stream_in",
    """select snapshot_id, dst as component, cast(sum(weight) as bigint) as stream_in
       from fx_edge_traffic group by 1, 2""",
)
def _(t):
    return R.component_stream_in(weights(t))


@query(
    "component_stream_out",
    """select snapshot_id, src as component, cast(sum(weight) as bigint) as stream_out
       from fx_edge_traffic group by 1, 2""",
)
def _(t):
    return R.component_stream_out(weights(t))


@query(
    "worker_load",
    """select snapshot_id, worker_hostname as host, cast(sum(load) as bigint) as load
       from fx_load group by 1, 2""",
)
def _(t):
    return R.worker_load(t.load)


@query(
    "worker_cpu_usage",
    "select hostname as host, arg_max(cpu_usage, ts) as cpu from fx_worker group by 1",
)
def _(t):
    return R.worker_cpu_usage(t.worker.drop("snapshot_id"))


_TUPLE_SIZE = """
    select x.snapshot_id, a.component as src, b.component as dst,
           cast(sum(tuplesizesum) // nullif(sum(tuplesizecount), 0) as bigint) as tuple_size
    from fx_tuplesize x join fx_tasks a on a.task_id = source_task_id
    join fx_tasks b on b.task_id = destination_task_id
    join fx_edges e on e.src = a.component and e.dst = b.component
    group by 1, 2, 3"""


@query("edge_tuple_size", _TUPLE_SIZE)
def _(t):
    return R.edge_tuple_size(t.tuplesize, t.tasks, t.edges)


@query(
    "edge_selectivity",
    """select snapshot_id, src, dst, stream_in, stream_out, round(alfa, 9) as alfa from fx_alfa""",
)
def _(t):
    return alfa(t).withColumn("alfa", r9("alfa"))


@query("mean_selectivity", "select src, dst, round(alfa, 9) as alfa from fx_mean_alfa")
def mean_selectivity(t):
    return mean_alfa(t).withColumn("alfa", r9("alfa"))


@query(
    "mean_tuple_size",
    f"""select src, dst, round(avg(tuple_size), 9) as tuple_size from ({_TUPLE_SIZE})
        where snapshot_id > 0 group by 1, 2""",
)
def _(t):
    sizes = A.mean_tuple_size(t.tuplesize, t.tasks, t.edges)
    return sizes.withColumn("tuple_size", r9("tuple_size"))


@query("cluster_capacity", "select capacity from fx_capacity")
def _(t):
    return R.cluster_capacity(t.node)


@query("latency_per_second", "select second, latency_ms::double as latency_ms from fx_latency_series")
def _(t):
    return as_double(E.latency_per_second(t.latency), "latency_ms")


@query("throughput_per_second", "select second, n::double as n from fx_throughput_series")
def _(t):
    return as_double(E.throughput_per_second(t.latency), "n")


@query("merged_throughput_per_second", "select second, n from fx_merged_series")
def _(t):
    return E.merged_throughput_per_second(t.throughput)


@query("reports_per_second", "select second, n from fx_per_second")
def _(t):
    return E.reports_per_second(t.reports)


@query(
    "component_parallelism",
    "select component, count(*) as parallelism from fx_executors group by 1",
)
def _(t):
    return R.component_parallelism(t.executors)


@query(
    "component_task_bounds",
    "select component, min(task_id) as min_task, max(task_id) as max_task from fx_tasks group by 1",
)
def _(t):
    return R.component_task_bounds(t.tasks)


@query("executor_latest_load", "select executor, load from fx_executor_load")
def _(t):
    return R.executor_latest_load(t.load, t.executors)


@query("executor_traffic", "select executor, traffic from fx_executor_traffic")
def _(t):
    return R.executor_traffic(t.traffic, t.executors)


@query("executor_pair_traffic", "select src_executor, dst_executor, traffic from fx_executor_pairs")
def _(t):
    return pair_traffic(t)


@query(
    "cluster_totals",
    """select cast((select sum(load) from fx_executor_load) as bigint) as total_load,
              cast((select sum(traffic) from fx_executor_pairs) as bigint) as total_traffic""",
)
def _(t):
    return R.cluster_totals(t.load, t.traffic, t.executors)


@query(
    "worker_traffic_normaliser",
    "select round(sum(max_in), 6) as max_worker_traffic from fx_max_in",
)
def _(t):
    total = G.worker_traffic_normaliser(max_traffic(t))
    return total.select(F.round("max_worker_traffic", 6).alias("max_worker_traffic"))


@query(
    "node_load_stats",
    """select allocation_id, round(mean_load, 9) as mean_load, round(stddev_load, 9) as stddev_load
       from fx_node_stats""",
)
def _(t):
    stats = K.node_load_stats(t.placements, exec_load(t), t.node)
    return stats.select("allocation_id", r9("mean_load").alias("mean_load"), r9("stddev_load").alias("stddev_load"))


@query(
    "placement_traffic_split",
    "select allocation_id, total_traffic, inter_node, inter_slot from fx_split",
)
def _(t):
    return K.placement_traffic_split(t.placements, pair_traffic(t))


@query(
    "placement_constraints",
    """select allocation_id, topology_id, used_workers, required_workers, workers_ok, exclusive_ok
       from fx_constraints""",
)
def _(t):
    return constraints(t)


@query("distinct_executors", "select executor, component, start_task, end_task from fx_executors")
def _(t):
    return R.distinct_executors(R.executor_tasks(t.executors)).drop("task_id")


@query(
    "host_process_cpu_time",
    """select concat('h', user_id % 4) as host, epoch_us(ts) // 1000000000 as ts_ms,
              cast(sum(cast(floor(value * 100) as bigint)) as bigint) as cpu_ns
       from events group by 1, 2""",
)
def _(t):
    return C.host_process_cpu_time(
        t.events.select(
            F.concat(F.lit("h"), F.col("user_id") % 4).alias("host"),
            F.expr("unix_micros(cast(ts as timestamp)) div 1000000000").alias("ts_ms"),
            F.floor(F.col("value") * 100).cast("bigint").alias("cpu_ns"),
        )
    )


@query(
    "component_task_list",
    """select component, cast(task_id // 10 as bigint) as chunk,
              string_agg(cast(task_id as varchar), ',' order by task_id) as tasks
       from fx_executor_tasks group by 1, 2""",
)
def _(t):
    return R.component_task_list(t.executors, chunk=10).withColumn("tasks", text("tasks"))


# === F: windows ====================================================================


@query("anchored_second", "select ts_ms, latency_ns, file, second from fx_lat_second")
def _(t):
    return E.anchored_second(t.latency)


@query("fill_gaps", "select second, coalesce(n, 0) as n from fx_throughput_series")
def _(t):
    counts = E.anchored_second(t.latency).groupBy("second").agg(F.count(F.lit(1)).alias("n"))
    return E.fill_gaps(counts, 0)


@query(
    "moving_average",
    """select second, data_driver, spout::double as spout, latency::double as latency,
              round(data_driver_avg, 9) as data_driver_avg,
              round(spout_avg, 9) as spout_avg, round(latency_avg, 9) as latency_avg
       from fx_smooth""",
)
def _(t):
    smooth = as_double(zipped(t), "spout", "latency")
    return smooth.withColumns({c: r9(c) for c in ("data_driver_avg", "spout_avg", "latency_avg")})


@query(
    "cpu_utilisation",
    """select host, core, seq, round((busy - pb)::double / nullif(busy - pb + idle - pi, 0), 9)
              as utilisation
       from (select *, lag(busy) over w as pb, lag(idle) over w as pi from fx_cpu_samples
             window w as (partition by host, core order by seq)) where pb is not null""",
)
def _(t):
    return C.cpu_utilisation(t.cpu_samples, **CPU_ORDER).withColumn(
        "utilisation", r9("utilisation")
    )


@query("rolling_cpu", "select host, seq, cpu_percent, cpu_usage from fx_rolling")
def _(t):
    return C.rolling_cpu(rolling_samples(t), **CPU_ORDER)


@query("running_second", "select row_id, second, current_second from fx_running")
def _(t):
    return E.running_second(t.reports)


@query(
    "previous_snapshot",
    """select snapshot_id, src, dst, weight,
              lag(weight) over (partition by src, dst order by snapshot_id)::double
                as previous_weight
       from fx_edge_traffic""",
)
def _(t):
    return as_double(A.previous_snapshot(weights(t)), "previous_weight")


@query(
    "history_array",
    """select src, dst, cast(0 as bigint) as chunk,
              string_agg(cast(weight as varchar), ',' order by snapshot_id desc) as history
       from fx_edge_traffic group by 1, 2""",
)
def _(t):
    history = A.history_array(weights(t), ["src", "dst"], "weight")
    return history.withColumn("history", text("history"))


@query("task_cycles", "select task_id, ts_ms, cycles from fx_cycles")
def _(t):
    return C.task_cycles(readings(t), speed_hz=10_000_000_000, cores=4, slab_ms=100_000)


@query(
    "every_nth",
    """select host, seq, busy from (select *, row_number() over (partition by host order by seq) as k
                                    from fx_cpu_samples) where k % 10 = 1""",
)
def _(t):
    return C.every_nth(t.cpu_samples, n=10, **CPU_ORDER).select("host", "seq", "busy")


@query(
    "split_tasks",
    """select component, cast(bucket - 1 as int) as executor_no, min(task_id) as start_task,
              max(task_id) as end_task
       from (select e.component, t.task_id,
                    ntile(3) over (partition by e.component order by t.task_id) as bucket
             from fx_executors e join fx_executor_tasks t on t.executor = e.executor)
       group by 1, 2""",
)
def _(t):
    bounds = t.executors.select(
        "component",
        F.col("start_task").alias("min_task"),
        F.col("end_task").alias("max_task"),
        F.lit(3).alias("parallelism"),
    )
    return K.split_tasks(bounds)


@query(
    "forecast_window",
    """with per_minute as (
         select concat('s', user_id % 2) as spout, epoch_us(ts) // 60000000 as minute,
                cast(count(*) as bigint) as cnt from events group by 1, 2),
       dense as (
         select m.spout, m.minute, coalesce(p.cnt, 0) as cnt
         from (select spout, unnest(generate_series(min(minute), max(minute))) as minute
               from per_minute group by spout) m
         left join per_minute p on p.spout = m.spout and p.minute = m.minute),
       framed as (
         select spout, minute, list(cnt) over w as f, lead(cnt, 5) over (partition by spout order by minute) as label
         from dense window w as (partition by spout order by minute rows between 9 preceding and current row))
       select spout, minute, array_to_string(f, ',') as features, label
       from framed where len(f) = 10 and label is not null""",
)
def _(t):
    counts = t.events.select(
        F.concat(F.lit("s"), F.col("user_id") % 2).alias("spout"),
        F.expr("unix_micros(cast(ts as timestamp))").alias("ts_us"),
        F.lit(1).alias("cnt"),
    )
    rows = E.forecast_window(counts, n=10, horizon=5)
    return rows.withColumn("features", text("features"))


# === G: sorts ======================================================================


@query(
    "merge_logs",
    """select ts_ms, latency_ns, file, pos, row_number() over (order by ts_ms, file, pos) - 1 as position
       from (select epoch_us(ts) // 1000000 as ts_ms, cast(floor(value * 1000000) as bigint) as latency_ns,
                    event_type as file, event_id as pos from events)""",
)
def _(t):
    lines = t.events.select(
        F.expr("unix_micros(cast(ts as timestamp)) div 1000000").alias("ts_ms"),
        F.floor(F.col("value") * 1_000_000).cast("bigint").alias("latency_ns"),
        F.col("event_type").alias("file"),
        F.col("event_id").alias("pos"),
    )
    first = F.col("pos") % 2 == 0
    return E.merge_logs(lines.filter(first), lines.filter(~first))


@query(
    "executors_by_weight",
    """select e.executor, round(0.5 * e.load / (select sum(load) from fx_executor_load)
              + 0.5 * x.traffic / (select sum(traffic) from fx_executor_pairs), 9) as weight,
              row_number() over (order by 0.5 * e.load / (select sum(load) from fx_executor_load)
              + 0.5 * x.traffic / (select sum(traffic) from fx_executor_pairs) desc, e.executor) - 1 as position
       from fx_executor_load e join fx_executor_traffic x on x.executor = e.executor""",
)
def _(t):
    ranked = K.executors_by_weight(K.executor_weight(t.load, t.traffic, t.executors))
    return ranked.select("executor", r9("weight").alias("weight"), F.col("position").cast("bigint").alias("position"))


@query(
    "peak_second",
    "select second, n from fx_per_second order by n desc, second limit 1",
)
def _(t):
    return E.peak_second(E.reports_per_second(t.reports))


@query(
    "best_placement",
    """select allocation_id, round(score, 9) as score from fx_scores
       where (mean_load > 0 or total_traffic > 0)
         and allocation_id in (select allocation_id from fx_constraints group by 1
                               having bool_and(workers_ok and exclusive_ok))
       order by score, allocation_id limit 1""",
)
def _(t):
    return K.best_placement(scores(t), constraints(t)).withColumn("score", r9("score"))


@query(
    "min_nodes",
    """select coalesce(min(case when ok then node_count end), max(node_count)) as nodes
       from fx_whatif""",
)
def _(t):
    return K.min_nodes(whatif(t))


# === H: set operations =============================================================


@query(
    "union_logs",
    """select ts_ms, latency_ns, file from fx_latency where file = 'click'
       union all select ts_ms, latency_ns, file from fx_latency where file <> 'click'
       union all select ts_ms, latency_ns, file from fx_latency""",
)
def _(t):
    return E.union_logs(t.latency, t.latency)


@query(
    "remaining_workers",
    """select hostname, cast(unnest(generate_series(6700, 6703)) as int) as port from fx_node
       except select hostname, port from fx_placements""",
)
def _(t):
    return K.remaining_workers(workers(t), t.placements)


# === S: scalars ====================================================================


@query(
    "strip_decoration",
    """select row_id, case when contains(line, '*') then split_part(line, '*', 1)
                           when contains(line, '#') then split_part(line, '#', 1) end as text
       from fx_lines""",
)
def _(t):
    return t.lines.select("row_id", S.strip_decoration("line").alias("text"))


@query(
    "pig_latin",
    """select word, case when left(word, 1) in ('a', 'e', 'i', 'o', 'u') then concat(word, 'ay')
                         else concat(substr(word, 2), left(word, 1), 'ay') end as latin, n
       from fx_words""",
)
def _(t):
    words = (
        t.table("documents")
        .select(F.explode(F.split("text", " ")).alias("word"))
        .filter("word <> ''")
        .groupBy("word")
        .agg(F.count(F.lit(1)).alias("n"))
    )
    return words.select("word", S.pig_latin("word").alias("latin"), "n")


@query(
    "calendar_features",
    """select event_id, round(dayofweek(ts) / 6.0::double, 9) as day_of_week,
              round((month(ts) - 1) / 12.0::double, 9) as month,
              round(day(ts) / 30.0::double, 9) as day, round(hour(ts) / 23.0::double, 9) as hour,
              round(minute(ts) / 59.0::double, 9) as minute from events""",
)
def _(t):
    made = t.events.select("event_id", *S.calendar_features("ts"))
    return made.select("event_id", *[r9(F.col(c).cast("double")).alias(c) for c in made.columns[1:]])


@query("ns_to_ms", "select ts_ms, latency_ns // 1000000 as latency_ms from fx_latency")
def _(t):
    return t.latency.select("ts_ms", S.ns_to_ms("latency_ns").alias("latency_ms"))


@query("decimal_comma", "select event_id, replace(cast(value as varchar), '.', ',') as value from events")
def _(t):
    return t.events.select("event_id", S.decimal_comma(F.col("value").cast("string")).alias("value"))


@query(
    "csv_field",
    """select row_id, try_cast(split_part(split_part(line, '*', 1), ',', 2) as bigint)::double as field
       from fx_lines""",
)
def _(t):
    plain = F.substring_index("line", "*", 1)
    field = S.csv_field(plain, 1, strict=False)
    return t.lines.select("row_id", field.cast("double").alias("field"))


@query(
    "task_range",
    """select executor, cast(unnest(generate_series(start_task, end_task)) as int) as task_id
       from fx_executors
       union all select task_id + 1000, task_id from fx_tasks""",
)
def _(t):
    ranges = t.executors.select("executor", F.concat_ws("-", "start_task", "end_task").alias("text"))
    single = t.tasks.select(
        (F.col("task_id") + 1000).alias("executor"), F.col("task_id").cast("string").alias("text")
    )
    return ranges.unionByName(single).select("executor", F.explode(S.task_range("text")).alias("task_id"))


@query(
    "array_text",
    """select vec_id, array_to_string([cast(floor(x::double * 100) as bigint) for x in embedding], '  ')
              as text
       from embeddings""",
)
def _(t):
    whole = F.transform("embedding", lambda x: F.floor(x.cast("double") * 100))
    return t.table("embeddings").select("vec_id", S.array_text(whole).alias("text"))


@query(
    "tanh_net",
    """select snapshot_id, task_id, round(yhat, 9) as yhat from fx_scored""",
)
def _(t):
    joined = component_train(t).join(models(t), "component")
    return joined.select("snapshot_id", "task_id", r9(J.component_net("norm_traffic", "w")).alias("yhat"))


@query(
    "normalise",
    """select event_id, value / case when user_id % 5 = 0 then 1 else user_id % 5 end as x
       from events""",
)
def _(t):
    return t.events.select("event_id", S.normalise("value", F.col("user_id") % 5).alias("x"))


@query(
    "tuple_bytes",
    """select event_id, cast(octet_length(encode(concat('{"user_id":', user_id, ',"event_type":"',
              event_type, '"}'))) as int) as bytes from events""",
)
def _(t):
    return t.events.select("event_id", S.tuple_bytes(["user_id", "event_type"]).alias("bytes"))


@query(
    "max_traffic_per_second",
    """select event_id,
              round(case when user_id % 3 > 0
                   then (user_id % 3) * 1000.0::double
                        * (case when event_id % 4 > 0 then event_id % 4 else 20 end) / 60
                   else 11740.0::double end, 9) as rate
       from events""",
)
def _(t):
    rate = S.max_traffic_per_second(
        (F.col("user_id") % 3) * 1000.0, F.col("event_id") % 4, MAX_SEC, 20
    )
    return t.events.select("event_id", r9(rate).alias("rate"))


@query(
    "mhz_to_hz",
    """select p_partkey, cast(floor(cast(p_retailprice as float)) as bigint) * 1048576 as hz
       from part""",
)
def _(t):
    return t.table("part").select("p_partkey", S.mhz_to_hz("p_retailprice").alias("hz"))


# === I: propagation ================================================================


@query(
    "propagate_max_traffic",
    "select src, dst, round(max_traffic, 6) as max_traffic from fx_max_traffic",
)
def _(t):
    return max_traffic(t).withColumn("max_traffic", F.round("max_traffic", 6))


@query(
    "propagate_current_traffic",
    """select e.dst as component, round(coalesce(sum(amount), 0), 6) as traffic_in
       from fx_edges e left join fx_current_paths p on p.src = e.src and p.dst = e.dst group by 1""",
)
def _(t):
    known = weights(t)
    last = known.agg(F.max("snapshot_id")).scalar()
    latest = known.filter(F.col("snapshot_id") == last).drop("snapshot_id")
    spread = G.propagate_current_traffic(latest, mean_alfa(t), t.components)
    return spread.withColumn("traffic_in", F.round("traffic_in", 6))


@query("max_traffic_in", "select component, round(max_in, 6) as max_in from fx_max_in")
def _(t):
    return G.max_traffic_in(max_traffic(t)).withColumn("max_in", F.round("max_in", 6))


@query(
    "whatif_traffic",
    "select src, dst, round(max_traffic * (60000.0::double * 20 / 60) / 11740.0::double, 6) as max_traffic from fx_max_traffic",
)
def _(t):
    spread = G.whatif_traffic(
        t.edges, mean_alfa(t), t.components,
        max_traffic=60000.0, factor=0, current_max_sec=MAX_SEC, current_factor=20,
    )
    return spread.withColumn("max_traffic", F.round("max_traffic", 6))


@query(
    "whatif_training_set",
    """select snapshot_id, task_id, component, traffic, load,
              round(norm_traffic / ((60000.0::double * 20 / 60) / 11740.0::double), 9) as norm_traffic,
              round(norm_load, 9) as norm_load
       from fx_component_train""",
)
def _(t):
    points = R.task_points(t.traffic, t.load, t.tasks, t.components)
    _, train = J.whatif_training_set(
        points, t.edges, mean_alfa(t), t.components, t.node,
        max_traffic=60000.0, factor=0, current_max_sec=MAX_SEC, current_factor=20,
    )
    return train.withColumns({c: r9(c) for c in ("norm_traffic", "norm_load")})


@query(
    "topology_listing",
    """select 'component' as item, 0::bigint as chunk,
              concat(c.component, ', task: [', string_agg(cast(task_id as varchar), ', ' order by task_id), ']')
                as text
       from fx_components c join fx_tasks t on t.component = c.component group by c.component
       union all
       select 'edge', 0, concat('(', src, ' : ', dst, ') w=', cast(sum(weight) as bigint))
       from fx_edge_traffic group by src, dst""",
)
def _(t):
    total = weights(t).groupBy("src", "dst").agg(F.sum("weight").alias("weight"))
    return G.topology_listing(t.components, t.tasks, total)


# === J: models =====================================================================


@query(
    "component_training_set",
    """select snapshot_id, task_id, component, traffic, load,
              round(norm_traffic, 9) as norm_traffic, round(norm_load, 9) as norm_load
       from fx_component_train""",
)
def _(t):
    return component_train(t).withColumns({c: r9(c) for c in ("norm_traffic", "norm_load")})


@query(
    "worker_training_set",
    """select snapshot_id, host, round(norm_in, 9) as norm_in, round(norm_out, 9) as norm_out,
              round(norm_load, 9) as norm_load, round(norm_cpu, 9) as norm_cpu
       from fx_worker_train""",
)
def _(t):
    return worker_train(t).select(
        "snapshot_id", "host", *[r9(c).alias(c) for c in ("norm_in", "norm_out", "norm_load", "norm_cpu")]
    )


def fit_facts(models, points, keys, target, net, bound):
    """What must hold of any fit: its rows, the error its weights really make, and one below ``bound``."""
    y = F.col(target)
    one = [models.select(c).scalar().alias(c) for c in ("w", "mse", "n")]
    scored = points.join(models, keys) if keys else points.select("*", *one)
    return scored.groupBy(*keys, "mse", "n").agg(
        F.count(F.lit(1)).alias("rows"),
        (F.first("mse") <= bound).alias("below_bound"),
        (F.abs(F.avg((y - net) * (y - net)) - F.first("mse")) <= 1e-6 * F.var_pop(y) + 1e-15).alias("error_is_real"),
        (F.first("n") == F.count(F.lit(1))).alias("all_rows"),
    ).drop("mse", "n")


@query(
    "fit_component_models",
    """select component, count(*) as rows, true as below_bound, true as error_is_real, true as all_rows
       from fx_component_train group by 1""",
)
def _(t):
    # Nowhere worse than the straight line by a twentieth; the mean is ten times worse for most components.
    train = component_train(t)
    fitted = J.fit_component_models(train)
    left = F.var_pop("norm_load") * (1 - F.coalesce(F.regr_r2("norm_load", "norm_traffic"), F.lit(0.0)))
    return fit_facts(fitted, train, ["component"], "norm_load", J.component_net("norm_traffic", "w"), 1.05 * left + 1e-15)


@query(
    "fit_worker_model",
    """select count(*) as rows, true as below_bound, true as error_is_real, true as all_rows
       from fx_worker_train""",
)
def _(t):
    # Nothing explains the fixture's CPU by a line. Newton steps reach the limit at sf0.01 in 81 passes,
    # resilient propagation does not in a thousand.
    train = worker_train(t)
    fitted = J.fit_worker_model(train, method="newton", max_epochs=100)
    return fit_facts(fitted, train, [], "norm_cpu", J.worker_net("w"), 0.75 * F.var_pop("norm_cpu"))


@query(
    "fit_linear_load",
    """select component, round(regr_slope(norm_load, norm_traffic), 6) as slope,
              round(regr_intercept(norm_load, norm_traffic), 6) as intercept,
              round(regr_r2(norm_load, norm_traffic), 6) as r2, count(*) as n
       from fx_component_train group by 1""",
)
def _(t):
    fitted = J.fit_linear_load(component_train(t))
    return fitted.withColumns({c: F.round(c, 6) for c in ("slope", "intercept", "r2")})


@query(
    "score_component_load",
    """select component, snapshot_id, task_id,
              round(yhat * (select capacity from fx_capacity), 2) as predicted_load from fx_scored""",
)
def _(t):
    scored = J.score_component_load(linear_points(t), models(t), t.node)
    return scored.select(
        "component", "snapshot_id", "task_id", F.round("predicted_load", 2).alias("predicted_load")
    )


@query(
    "model_error",
    """select component, round(avg((norm_load - yhat) * (norm_load - yhat)), 9) as mse, count(*) as n
       from fx_scored group by 1""",
)
def _(t):
    return J.model_error(linear_points(t), models(t)).withColumn("mse", r9("mse"))


@query(
    "replace_model",
    """select component, case when component = 3 then '0.5,0.5,0.5,0.5,0.5,0.5,0.5,0.5,0.5,0.5'
                              else array_to_string(w, ',') end as w from fx_models""",
)
def _(t):
    return J.replace_model(models(t), 3, [0.5] * 10).withColumn("w", text("w"))


# === K: capacity ===================================================================


@query(
    "executor_weight",
    """select e.executor, e.load, x.traffic,
              round(0.5 * e.load / (select sum(load) from fx_executor_load)
              + 0.5 * x.traffic / (select sum(traffic) from fx_executor_pairs), 9) as weight
       from fx_executor_load e join fx_executor_traffic x on x.executor = e.executor""",
)
def _(t):
    return K.executor_weight(t.load, t.traffic, t.executors).withColumn("weight", r9("weight"))


@query("placement_score", "select allocation_id, round(score, 9) as score from fx_scores")
def _(t):
    return scores(t).select("allocation_id", r9("score").alias("score"))


@query(
    "placement_meaningful",
    """select allocation_id, (mean_load > 0 or total_traffic > 0) as meaningful,
              case when mean_load > 0 or total_traffic > 0 then 'meaningful: yes'
                   else 'meaningful: no because both mean load and total traffic are zero' end
                as reason
       from fx_scores""",
)
def _(t):
    return K.placement_meaningful(scores(t)).select("allocation_id", "meaningful", "reason")


_EXECUTOR_FORECAST = """
    select m.component, m.max_in / c.parallelism as executor_traffic,
           (select capacity from fx_capacity)
           * tanh(w[4] + w[1] * tanh(w[6] + w[5] / c.parallelism)
                       + w[2] * tanh(w[8] + w[7] / c.parallelism)
                       + w[3] * tanh(w[10] + w[9] / c.parallelism)) as executor_load
    from fx_max_in m join fx_components c on c.component = m.component
    join fx_models x on x.component = m.component"""


@query(
    "executor_load_forecast",
    f"""select component, round(executor_traffic, 6) as executor_traffic,
               round(executor_load, 2) as executor_load from ({_EXECUTOR_FORECAST})""",
)
def _(t):
    top = G.max_traffic_in(max_traffic(t))
    forecast = K.executor_load_forecast(
        top.withColumnRenamed("max_in", "traffic_in"), t.components, top, models(t), t.node
    )
    return forecast.select(
        "component",
        F.round("executor_traffic", 6).alias("executor_traffic"),
        F.round("executor_load", 2).alias("executor_load"),
    )


def placed_executors(t: Telemetry) -> DataFrame:
    """Traffic and load of each executor where it is placed."""
    pairs = pair_traffic(t)
    into = pairs.groupBy(F.col("dst_executor").alias("executor")).agg(F.sum("traffic").alias("traffic_in"))
    out = pairs.groupBy(F.col("src_executor").alias("executor")).agg(F.sum("traffic").alias("traffic_out"))
    return (
        t.placements.join(exec_load(t), "executor")
        .join(into, "executor", "left")
        .join(out, "executor", "left")
        .fillna(0, ["traffic_in", "traffic_out"])
    )


def cpu_forecast(t: Telemetry) -> DataFrame:
    top = pair_traffic(t).agg(F.sum("traffic").cast("double")).scalar()
    return K.worker_cpu_forecast(
        placed_executors(t), worker_model(t), t.node, max_worker_traffic=top
    )


_CPU_FORECAST = """
    select allocation_id, hostname,
           100 * tanh(w[5] + w[1] * tanh(w[9] + w[6] * i + w[7] * o + w[8] * l)
                           + w[2] * tanh(w[13] + w[10] * i + w[11] * o + w[12] * l)
                           + w[3] * tanh(w[17] + w[14] * i + w[15] * o + w[16] * l)
                           + w[4] * tanh(w[21] + w[18] * i + w[19] * o + w[20] * l)) as cpu_percent
    from (select p.allocation_id, p.hostname,
                 sum(coalesce(a.traffic, 0))::double / (select sum(traffic) from fx_executor_pairs) as i,
                 sum(coalesce(b.traffic, 0))::double / (select sum(traffic) from fx_executor_pairs) as o,
                 sum(e.load)::double / (select capacity from fx_capacity) as l,
                 [((k * 5) % 11 - 5) / 8.0::double for k in range(21)] as w
          from fx_placements p join fx_executor_load e on e.executor = p.executor
          left join (select dst_executor as executor, sum(traffic) as traffic
                     from fx_executor_pairs group by 1) a on a.executor = p.executor
          left join (select src_executor as executor, sum(traffic) as traffic
                     from fx_executor_pairs group by 1) b on b.executor = p.executor
          group by 1, 2)"""


@query(
    "worker_cpu_forecast",
    f"select allocation_id, hostname, round(cpu_percent, 6) as cpu_percent from ({_CPU_FORECAST})",
)
def _(t):
    return cpu_forecast(t).withColumn("cpu_percent", F.round("cpu_percent", 6))


@query(
    "fewest_nodes",
    "select coalesce(min(case when ok then node_count end), max(node_count)) as nodes from fx_whatif",
)
def _(t):
    return K.fewest_nodes(exec_load(t), t.node)


@query("sizing_whatif", "select node_count, round(peak, 9) as peak, ok from fx_whatif")
def _(t):
    return whatif(t).withColumn("peak", r9("peak"))


@query(
    "scaling_flags",
    """select snapshot_id, host, norm_cpu, case when norm_cpu > 0.65 then 'scale-out'
              when norm_cpu < 0.40 then 'scale-in' else 'keep' end as action
       from (select snapshot_id, host, cpu / 100.0::double as norm_cpu from fx_worker_points)""",
)
def _(t):
    usage = R.worker_points(t.traffic, t.load, t.worker).select(
        "snapshot_id", "host", (F.col("cpu") / 100.0).alias("norm_cpu")
    )
    return K.scaling_flags(usage, "norm_cpu")


@query(
    "rebalance_plan",
    """select 'nodes' as item, null as component, 9 as actual, nodes as target
       from (select coalesce(min(case when ok then node_count end), max(node_count)) as nodes
             from fx_whatif) where nodes <> 9
       union all
       select 'parallelism', cast(component as varchar), n, parallelism
       from (select c.component, c.parallelism + c.component % 2 as parallelism, a.n
             from fx_components c join (select component, count(*) as n from fx_tasks group by 1) a
               on a.component = c.component) where parallelism <> n""",
)
def _(t):
    target = t.components.select(
        "component", (F.col("parallelism") + F.col("component") % 2).alias("parallelism")
    )
    actual = t.tasks.groupBy("component").agg(F.count(F.lit(1)).alias("parallelism"))
    return K.rebalance_plan(K.fewest_nodes(exec_load(t), t.node), 9, K.parallelism_changes(target, actual))


# === L: streams ====================================================================


def event_stream(t: Telemetry) -> DataFrame:
    raw = L.file_stream(t.spark, t.sf_dir, t.events.schema, "events.parquet")
    return raw.select(
        F.col("ts").cast("timestamp").alias("ts"),
        (F.col("user_id") % 7).alias("task_id"),
        (F.col("event_id") % 6 - 1).alias("source_task_id"),
        F.col("event_type").alias("stream"),
        "props",
        F.floor("value").cast("bigint").alias("latency_ms"),
    )


def finish(t: Telemetry, stream: DataFrame, label: str, **kw) -> DataFrame:
    """Run a stream over everything there is and read what it wrote."""
    path = scratch_path(t.spark, label)
    L.run_updates(stream, path, **kw).awaitTermination()
    return L.read_updates(t.spark, path)


def stored_stream(t: Telemetry, rows: DataFrame, label: str) -> DataFrame:
    """Write derived rows as files and stream them back."""
    path = scratch_path(t.spark, label)
    rows.write.parquet(path)
    return L.file_stream(t.spark, path, rows.schema)


def ended(rows: DataFrame, key: str) -> DataFrame:
    """Readings and the one that ends their stream."""
    return rows.unionByName(KS.closing_reading(rows, key))


def until(stored: Callable[[], bool], running, seconds: int = 120) -> None:
    """Let a query that would go on run until what it has stored will do."""
    try:
        end = time.monotonic() + seconds
        while not stored() and running.isActive and time.monotonic() < end:
            time.sleep(0.2)
    finally:
        running.stop()


def bucket_s() -> Column:
    return F.unix_seconds("bucket").alias("bucket_s")


@query(
    "traffic_stream",
    """select epoch_us(ts) // 10000000 * 10 as bucket_s, task_id, source_task_id, count(*) as traffic
       from fx_tuples where source_task_id >= 0 group by 1, 2, 3""",
)
def _(t):
    rows = finish(t, L.traffic_stream(event_stream(t)), "traffic")
    last = L.final_values(rows, ["bucket", "task_id", "source_task_id"])
    return last.select(bucket_s(), "task_id", "source_task_id", "traffic")


@query(
    "load_stream",
    """select task_id, ts_ms // 10000 * 10000 as bucket_ms, cast(sum(cycles) as bigint) as load
       from fx_cycles group by 1, 2""",
)
def _(t):
    with KS.keyed_state(t.spark):
        source = stored_stream(t, ended(readings(t), "task_id"), "readings")
        rows = finish(t, KS.load_stream(source, speed_hz=10_000_000_000, cores=4), "load", output_mode="append")
    return KS.sum_buckets(rows)


@query(
    "latency_stream",
    """select epoch_us(ts) // 10000000 * 10 as bucket_s, task_id,
              round(avg(latency_ms), 9) as latency_ms, count(*) as n
       from fx_tuples where source_task_id >= 0 group by 1, 2""",
)
def _(t):
    rows = finish(t, L.latency_stream(event_stream(t)), "latency")
    last = L.final_values(rows, ["bucket", "task_id"])
    return last.select(bucket_s(), "task_id", r9("latency_ms").alias("latency_ms"), "n")


@query(
    "tuple_size_stream",
    """select task_id, stream, cast(sum(b) as bigint) as tuplesizesum, count(*) as tuplesizecount,
              cast(sum(b) // count(*) as bigint) as tuple_size
       from (select task_id, stream,
                    octet_length(encode(concat('{"stream":"', stream, '","latency_ms":', latency_ms, '}')))
                      as b from fx_tuples) group by 1, 2""",
)
def _(t):
    stream = L.tuple_size_stream(event_stream(t), ["stream", "latency_ms"])
    return L.final_values(finish(t, stream, "sizes"), ["task_id", "stream"])


@query(
    "latest_state_stream",
    """select task_id, arg_max(load, ts) as load, arg_max(snapshot_id, ts) as snapshot_id
       from fx_load group by 1""",
)
def _(t):
    rows = t.load.withColumn("ts", F.col("ts").cast("timestamp"))
    path = scratch_path(t.spark, "state")
    L.latest_state_stream(stored_stream(t, rows, "loads"), path, ["task_id"]).awaitTermination()
    return L.latest_state(t.spark, path).select("task_id", "load", "snapshot_id")


@query("cpu_stream", "select host, seq as ts_ms, cpu_percent, cpu_usage from fx_rolling")
def _(t):
    samples = rolling_samples(t).withColumnRenamed("seq", "ts_ms")
    with KS.keyed_state(t.spark):
        stream = KS.cpu_stream(stored_stream(t, ended(samples, "host"), "samples"))
        rows = finish(t, stream, "cpu", output_mode="append")
    return rows.drop("epoch")


@query(
    "size_reports",
    """select task_id, stream, cast(sum(b) as bigint) as tuplesizesum, count(*) as tuplesizecount
       from (select task_id, stream,
                    octet_length(encode(concat('{"stream":"', stream, '","latency_ms":', latency_ms, '}')))
                      as b from fx_tuples) group by 1, 2""",
)
def _(t):
    path, total = scratch_path(t.spark, "reports"), t.events.count()
    columns = ["task_id", "stream"]

    def published() -> DataFrame:
        return L.final_values(L.read_updates(t.spark, path), columns)

    with KS.keyed_state(t.spark):
        stream = KS.size_reports(event_stream(t), ["stream", "latency_ms"], every="2 seconds")
        running = L.run_updates(stream, path, trigger={"processingTime": "1 second"})
        begun = lambda: bool(running.lastProgress and running.lastProgress.batchId >= 1)
        until(lambda: begun() and published().agg(F.sum("tuplesizecount")).first()[0] == total, running)
    return published().select(*columns, "tuplesizesum", "tuplesizecount")


@query("snapshot_stream", "select 0 as snapshot_id, task_id, arg_max(load, ts) as load from fx_load group by 2")
def _(t):
    """The first beat of a clock that goes on without data."""
    rows = t.load.drop("snapshot_id").withColumn("ts", F.col("ts").cast("timestamp"))
    source = stored_stream(t, rows, "loads")
    state, path = scratch_path(t.spark, "state"), scratch_path(t.spark, "snapshots")
    L.latest_state_stream(source, state, ["task_id"]).awaitTermination()
    running = L.snapshot_stream(path, lambda: L.latest_state(t.spark, state), spark=t.spark, every="1 second")
    until(lambda: bool(running.lastProgress and running.lastProgress.batchId >= 1), running)
    return t.spark.read.parquet(f"{path}/data/epoch=0").select("snapshot_id", "task_id", "load")

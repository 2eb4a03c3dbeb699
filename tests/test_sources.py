"""File readers and writers on real files."""

import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from flowgauge import schemas
from flowgauge.operators import cpu as C
from flowgauge.operators import filters as P
from flowgauge.operators import series as E
from flowgauge.runtime import scratch_path
from flowgauge.sources import readers as SRC
from flowgauge.sources import writers as SNK

CONFIG = """
# components
spout0 = reader,4
bolt0  = __acker,1
bolt1  = counter,2
bolt3  = ignored,2
edge0  = reader,counter
edge1 = counter, __acker
task0  = reader,34-37
task1 = counter, 6-7
task2 = __acker,5
"""


def lines(spark, text):
    return spark.createDataFrame([(x,) for x in text.splitlines()], "text string")


def test_latency_logs(spark, tmp_path):
    (tmp_path / "app-1.a").write_text("1000,5000000\n1414667658228,626\n")
    (tmp_path / "app-1.b").write_text("2000,7\n")
    (tmp_path / "app-2.a").write_text("3000,7\n")
    got = SRC.read_latency_logs(spark, str(tmp_path), "app-1").orderBy("ts_ms").collect()
    assert [tuple(r) for r in got] == [
        (1000, 5000000, "app-1.a"), (2000, 7, "app-1.b"), (1414667658228, 626, "app-1.a"),
    ]


def test_bad_number_fails(spark, tmp_path):
    (tmp_path / "app.a").write_text("1000,x\n")
    with pytest.raises(Exception, match="MALFORMED|FAILFAST|malformed"):
        SRC.read_latency_logs(spark, str(tmp_path), "app").collect()


def test_throughput_logs_skip_merged_files(spark, tmp_path):
    (tmp_path / "a").write_text("1000,3\n")
    (tmp_path / "merge").write_text("1000,99\n")
    assert [r["cnt"] for r in SRC.read_throughput_logs(spark, str(tmp_path)).collect()] == [3]


def test_merged_files_keep_order(spark, tmp_path):
    (tmp_path / "a").write_text("1,10\n5,11\n5,12\n")
    (tmp_path / "b").write_text("2,20\n5,21\n")
    rows = SRC.read_lines(spark, str(tmp_path)).select(
        F.split("value", ",")[0].cast("bigint").alias("ts_ms"),
        F.split("value", ",")[1].alias("v"),
        "file",
        F.col("line_no").alias("pos"),
    )
    assert [r["v"] for r in E.merge_logs(rows).collect()] == ["10", "20", "11", "12", "21"]


def test_line_numbers_over_many_blocks(spark, tmp_path):
    path = tmp_path / "big.txt"
    path.write_text("".join(f"row {i}\n" for i in range(5000)))
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    try:
        spark.conf.set("spark.sql.files.maxPartitionBytes", "4096")
        got = SRC.read_lines(spark, str(path))
        assert got.rdd.getNumPartitions() > 1
        assert got.filter(F.concat(F.lit("row "), "line_no") != F.col("value")).count() == 0
        assert got.count() == 5000
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)


def test_reports(spark, tmp_path):
    path = tmp_path / "r.csv"
    path.write_text(
        "0,0,107,23,0,0,1,74,395625,-1,-1,-1,-1,-1,-1\n"
        "2,104,274,-1,-1,-1,-1,-1,-1,18,-1,-1,-1,-1,-1\n"
        "0,10784,93477,55,0,4,1,2,11140,-1,-1,-1,-1,-1,-1\n"
    )
    got = SRC.read_reports(spark, str(path)).orderBy("row_id").collect()
    assert [(r["row_id"], r["second"]) for r in got] == [(0, 0), (1, 104), (2, 10784)]


def test_configuration(spark):
    components, tasks, edges = SRC.parse_topology_config(lines(spark, CONFIG))
    # bolt3 is not reached: bolt2 is missing.
    assert sorted(tuple(r) for r in components.collect()) == [
        ("__acker", "bolt", 1), ("counter", "bolt", 2), ("reader", "spout", 4),
    ]
    assert sorted(tuple(r) for r in tasks.collect()) == [
        ("__acker", 5), ("counter", 6), ("counter", 7),
        ("reader", 34), ("reader", 35), ("reader", 36), ("reader", 37),
    ]
    assert sorted(tuple(r) for r in edges.collect()) == [("counter", "__acker"), ("reader", "counter")]
    update = lines(spark, "task0 = counter,50-51")
    moved = SRC.parse_topology_tasks_update(components, tasks, update)
    assert sorted(r["task_id"] for r in moved.filter("component = 'counter'").collect()) == [50, 51]
    assert moved.count() == 7


@pytest.mark.parametrize(
    ("extra", "part"),
    [
        ("task3 = nobody,9", 1),
        ("task3 = counter,1-2-3", 1),
        ("edge2 = nobody,counter", 2),
        ("edge2 = counter,reader", 2),
    ],
)
def test_bad_configuration_fails(spark, extra, part):
    parsed = SRC.parse_topology_config(lines(spark, CONFIG + extra))
    with pytest.raises(PySparkException):
        parsed[part].collect()


def test_host_description(spark):
    text = (
        "processor\t: 0\nmodel name\t: Fast: 3\ncpu MHz\t\t: 2800.9\n\n"
        "processor\t: 1\nmodel name\t: Fast: 3\ncpu MHz\t\t: 2800.0\n"
    )
    rows = [("h", i, x) for i, x in enumerate(text.splitlines())]
    cores = SRC.host_core_inventory(spark.createDataFrame(rows, "host string, line_no int, text string"))
    hz = 2800 * 1024 * 1024
    assert sorted(tuple(r) for r in cores.collect()) == [("h", 0, "Fast: 3", hz), ("h", 1, "Fast: 3", hz)]
    assert tuple(C.host_speed(cores).first()) == ("h", 2, 2 * hz)


def test_cpu_counters(spark):
    rows = [("h", 1, "cpu  1 2 3 4 5 6 7 0 0"), ("h", 1, "cpu0 10 20 30 40 50 60 70 0"), ("h", 1, "intr 5")]
    got = SRC.read_cpu_counters(spark.createDataFrame(rows, "host string, ts_ms bigint, text string"))
    assert sorted(tuple(r) for r in got.collect()) == [
        ("h", "cpu", 1, 1, 2, 3, 4, 5, 6, 7), ("h", "cpu0", 1, 10, 20, 30, 40, 50, 60, 70),
    ]
    folded = {r["core"]: (r["busy"], r["idle"]) for r in C.busy_idle(got).collect()}
    assert folded["cpu"] == (1 + 2 + 3 + 6 + 7, 4 + 5)


def test_model_files(spark, tmp_path):
    (tmp_path / "net_a.txt").write_text("[NET]\nlayerCounts=2,4,2\nweightIndex=0,4,10\nweights=0.5,-1E-3,3\nx=1\n")
    got = SRC.read_model_weights(SRC.read_model_files(spark, str(tmp_path))).first()
    assert (got["model"], got["layer_counts"], got["w"]) == ("net_a.txt", [2, 4, 2], [0.5, -0.001, 3.0])


def test_latest_file(spark):
    names = ["h.x.cpu_dataset.9.csv", "h.x.cpu_dataset.10.csv", "h.x.cpu_dataset.bad.csv", "other.csv"]
    got = SRC.latest_file(spark.createDataFrame([(n,) for n in names], "name string")).collect()
    assert [tuple(r) for r in got] == [("h.x", "h.x.cpu_dataset.10.csv")]


def test_history_appends_per_run(spark):
    path = scratch_path(spark, "test-history")
    df = spark.createDataFrame([("a", "b", 0.25)], "src string, dst string, alfa double")
    for run in ("1", "2"):
        SNK.write_history(df, path, "alfa", run_id=run)
    got = SRC.read_history(spark, path, "alfa").collect()
    assert [tuple(r) for r in got] == [("a", "b", 0.25)] * 2


def test_second_series_lines(spark):
    path = scratch_path(spark, "test-series")
    series = spark.createDataFrame([(1, None), (0, 5), (2, 7)], "second bigint, n bigint")
    SNK.write_second_series(series, path, value="n")
    got = SRC.read_lines(spark, path).orderBy("line_no").collect()
    assert [r["value"] for r in got] == ["0,5", "", "2,7"]


def test_telemetry_formats(spark):
    path = scratch_path(spark, "test-tables")
    rows = spark.createDataFrame([("h", 4, 100)], schemas.NODE)
    rows.write.csv(f"{path}/node")
    got = SRC.read_telemetry(spark, path, "node", fmt="csv")
    assert got.schema == schemas.NODE and tuple(got.first()) == ("h", 4, 100)


def test_upsert(spark):
    schema = "k string, ts int, v string"
    state = spark.createDataFrame([("a", 1, "old"), ("b", 5, "kept"), ("c", 3, "old")], schema)
    updates = spark.createDataFrame([("a", 2, "new"), ("b", 4, "late"), ("c", 3, "new"), ("d", 1, "ins")], schema)
    got = {r["k"]: r["v"] for r in SNK.upsert_state(state, updates, ["k"]).collect()}
    assert got == {"a": "new", "b": "kept", "c": "new", "d": "ins"}


def test_no_running_application_keeps_nothing(spark):
    df = spark.createDataFrame([("t", 1)], "topology_id string, task_id int")
    none = spark.createDataFrame([], "topology_id string")
    assert SNK.retain_running(df, none).count() == 0


def test_missing_component_fails(spark):
    df = spark.createDataFrame([("a", "bolt")], "component string, kind string")
    assert P.component_by_name(df, "a").count() == 1
    with pytest.raises(PySparkException):
        P.component_by_name(df, "z").collect()


def test_plot_rows(spark):
    schema = "second bigint, data_driver bigint, data_driver_avg double, spout bigint, spout_avg double, latency bigint, latency_avg double"
    df = spark.createDataFrame([(1, 4, 8.0, None, 0.0, None, 0.0), (0, 3, 6.5, 2, 2.0, 7, 7.25)], schema)
    assert [r["value"] for r in E.format_plot_rows(df).collect()] == [
        E.PLOT_HEADER, "0;3,0;6,5;2,0;2,0;7,0;7,25", "1;4,0;8,0",
    ]


def test_bad_lines_are_set_aside(spark):
    """Good and bad lines together are the input; bad ones carry file, line and reason."""
    from flowgauge import schemas
    from flowgauge.sources import quarantine as Q

    folder = scratch_path(spark, "logs")
    texts = {"a": ["1,2", "x,2", "", "3,,4", "5,"], "b": ["7", "9, 8 "], "merge_old": ["broken"]}
    for name, lines in texts.items():
        spark.createDataFrame([(x,) for x in lines], "value string").coalesce(1).write.text(f"{folder}/{name}")
    import glob
    import os
    import shutil

    flat = scratch_path(spark, "flat").removeprefix("file:")
    os.makedirs(flat)
    for name in texts:
        shutil.copy(glob.glob(f"{folder.removeprefix('file:')}/{name}/part-*")[0], f"{flat}/{name}.log")
    good, bad = Q.read_checked_log(spark, flat, schemas.THROUGHPUT_LOG, scratch_path(spark, "checked"))
    assert sorted((r["file"], r["ts_ms"], r["cnt"]) for r in good.collect()) == [("a.log", 1, 2), ("a.log", 5, None), ("b.log", 9, 8)]
    assert sorted((r["file"], r["line_no"], r["line"], r["reason"]) for r in bad.collect()) == [
        ("a.log", 1, "x,2", "ts_ms is no bigint"),
        ("a.log", 2, "", "empty line"),
        ("a.log", 3, "3,,4", "2 fields expected, 3 found"),
        ("b.log", 0, "7", "2 fields expected, 1 found"),
    ]


def test_history_reads_only_the_runs_asked_for(spark):
    path = scratch_path(spark, "history")
    for run in ("1", "2"):
        rows = spark.createDataFrame([("c", int(run), 5)], "component string, traffic bigint, load bigint")
        SNK.write_history(rows, path, "load", run_id=run)
    found = SRC.read_history(spark, path, "load", runs=["2"])
    assert [tuple(r) for r in found.collect()] == [("c", 2, 5, "2")]
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(run_id" in plan or "PartitionFilters: [(run_id" in plan
    assert SRC.read_history(spark, path, "load").count() == 2

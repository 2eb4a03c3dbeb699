"""Recorded results of one profiling run: 45 snapshots on four hosts."""

import pytest
from pyspark.sql import functions as F

from flowgauge.operators import models as J
from flowgauge.operators import propagate as G
from flowgauge.operators import rollup as R
from flowgauge.operators import selectivity as A

# Ratio of one edge, snapshots 1 to 44.
RATIOS = [
    0.0, 0.0, 0.0, 1.0, 1.0, 1.0, 1.0052356020942408, 1.0434782608695652, 0.9824561403508771,
    1.0, 0.9895833333333334, 1.0, 1.01875, 1.004158004158004, 0.9917864476386037,
    0.9983079526226735, 0.9914089347079038, 1.0, 1.0, 1.0921052631578947, 1.0, 1.0,
    1.0034246575342465, 1.0057142857142858, 0.9898580121703854, 1.0010204081632652, 1.0,
    0.998158379373849, 0.9990783410138249, 0.9949409780775716, 0.9974554707379135,
    0.9343137254901961, 0.999219968798752, 1.0023474178403755, 1.0050983248361254,
    0.9956076134699854, 1.1785400175901495, 0.9959211420802175, 1.086092715231788,
    0.8805460750853242, 0.8477226376614548, 1.0443520443520444, 0.4997043169722058,
    0.7598314606741573,
]

# Mean ratio of every edge.
MEAN_ALFA = {
    ("feature-generation-bolt", "svm-bolt"): 0.9167322257227547,
    ("feature-generation-bolt", "__acker"): 0.9202220429028707,
    ("pos-tagger-bolt", "feature-generation-bolt"): 0.9513133148399231,
    ("pos-tagger-bolt", "__acker"): 0.9446171659133225,
    ("preprocessor-bolt", "pos-tagger-bolt"): 0.9290091397203587,
    ("preprocessor-bolt", "__acker"): 0.9216071869566744,
    ("svm-bolt", "__acker"): 0.9276164889940706,
    ("tokenizer-bolt", "preprocessor-bolt"): 0.9376810468226466,
    ("tokenizer-bolt", "__acker"): 0.93079301520273,
    ("tweet-reader", "tokenizer-bolt"): 0.9318181818181818,
    ("tweet-reader", "__acker"): 0.9318181818181818,
}

# Peak input per component at 11740 tuples/s, and their sum.
MAX_IN = {
    "tokenizer-bolt": 11740.0,
    "preprocessor-bolt": 11008.37548969787,
    "pos-tagger-bolt": 10226.881443402901,
    "feature-generation-bolt": 9728.968486398511,
    "svm-bolt": 8918.858934522648,
    "__acker": 59699.48759826868,
}
MAX_WORKER_TRAFFIC = 111322.57195229062
CAPACITY = 46_976_204_800

# Last snapshot per host, raw and normalised.
WORKERS = [
    ("01", 7408, 3785, 5627608289, 82, 0.06654535437049404, 0.034000292426069105, 0.11979699750031744),
    ("03", 3212, 2862, 3846555427, 82, 0.028853088315068418, 0.02570907184238039, 0.08188306065542357),
    ("04", 3629, 2561, 4310286068, 82, 0.03259895936967101, 0.023005217675868685, 0.09175466784409114),
    ("02", 3148, 3108, 3906696231, 80, 0.028278182445776893, 0.02791886627746969, 0.08316330039075442),
]


@pytest.fixture(scope="module")
def graph(spark):
    alfa = spark.createDataFrame([(*e, a) for e, a in MEAN_ALFA.items()], "src string, dst string, alfa double")
    names = sorted({n for e in MEAN_ALFA for n in e})
    components = spark.createDataFrame(
        [(n, "spout" if n == "tweet-reader" else "bolt") for n in names], "component string, kind string"
    )
    node = spark.createDataFrame([(f"h{i}", 4, CAPACITY // 16) for i in range(4)], "hostname string, core_count int, core_speed bigint")
    peak = G.propagate_max_traffic(alfa.select("src", "dst"), alfa, components, 35220 * 20 / 60)
    return components, node, peak.cache()


def test_mean_ratio(spark):
    rows = [("f", "s", i + 1, r) for i, r in enumerate(RATIOS)]
    df = spark.createDataFrame(rows, "src string, dst string, snapshot_id int, alfa double")
    assert df.count() == 44
    got = A.mean_selectivity(df).first()["alfa"]
    assert got == pytest.approx(MEAN_ALFA[("feature-generation-bolt", "svm-bolt")], abs=1e-15)


def test_peak_traffic(graph):
    _, _, peak = graph
    got = {r["component"]: r["max_in"] for r in G.max_traffic_in(peak).collect()}
    assert got == pytest.approx(MAX_IN, rel=1e-14)
    total = G.worker_traffic_normaliser(peak).first()[0]
    assert total == pytest.approx(MAX_WORKER_TRAFFIC, rel=1e-14)


def test_capacity(graph):
    assert R.cluster_capacity(graph[1]).first()[0] == CAPACITY


def test_worker_training_rows(spark, graph):
    _, node, peak = graph
    points = spark.createDataFrame(
        [w[:5] for w in WORKERS],
        "host string, traffic_in bigint, traffic_out bigint, load bigint, cpu int",
    )
    got = {r["host"]: r for r in J.worker_training_set(points, peak, node).collect()}
    for host, _, _, _, cpu, norm_in, norm_out, norm_load in WORKERS:
        r = got[host]
        assert (r["norm_in"], r["norm_out"], r["norm_load"], r["norm_cpu"]) == pytest.approx(
            (norm_in, norm_out, norm_load, cpu / 100), abs=1.4e-16
        )


@pytest.mark.parametrize(
    ("component", "norm_traffic", "top"),
    [
        ("svm-bolt", 0.01446373363981278, MAX_IN["svm-bolt"]),
        ("svm-bolt", 0.016257685099014367, MAX_IN["svm-bolt"]),
        ("svm-bolt", 0.027918369583824668, MAX_IN["svm-bolt"]),
        ("__acker", 0.17555366269165246, 11740.0),
        ("tweet-reader", 0.08202725724020443, 11740.0),
    ],
)
def test_component_normaliser(spark, graph, component, norm_traffic, top):
    """Recorded training inputs times the peak are whole tuples per second."""
    components, node, peak = graph
    traffic = round(norm_traffic * top)
    points = spark.createDataFrame(
        [(component, 1, 1, traffic, 1000)],
        "component string, task_id int, snapshot_id int, traffic bigint, load bigint",
    )
    train = J.component_training_set(points, components, peak, node, max_sec=11740.0)
    assert train.first()["norm_traffic"] == pytest.approx(norm_traffic, rel=1e-13)


def test_row_counts(spark, graph):
    """45 snapshots of 4 tasks give 176 component rows and 180 worker rows."""
    components, node, peak = graph
    points = spark.range(45).select(
        F.lit("svm-bolt").alias("component"),
        F.explode(F.sequence(F.lit(1), F.lit(4))).alias("task_id"),
        F.col("id").cast("int").alias("snapshot_id"),
        F.lit(5).cast("bigint").alias("traffic"),
        F.lit(7).cast("bigint").alias("load"),
    )
    assert J.component_training_set(points, components, peak, node, max_sec=11740.0).count() == 176
    hosts = points.select(
        F.concat(F.lit("h"), "task_id").alias("host"), "snapshot_id",
        F.col("traffic").alias("traffic_in"), F.col("traffic").alias("traffic_out"),
        "load", F.lit(3).alias("cpu"),
    )
    assert J.worker_training_set(hosts, peak, node).count() == 180


def test_network_layout(spark):
    """A recorded model scores a recorded input the way the saved layout says."""
    import numpy as np

    from flowgauge.functions import nets

    # One saved 1-3-1 model.
    w = [
        -0.0817035423, 0.1218008011, 0.7932648433, 0.3396404889, -0.7954397606,
        0.0736226165, 1.0290588303, 0.1114491322, -0.1321127393, -0.4681706867,
    ]
    df = spark.createDataFrame([(w, 0.01446373363981278)], "w array<double>, norm_traffic double")
    got = df.select(J.component_net("norm_traffic", "w")).first()[0]
    assert got == pytest.approx(nets.forward(np.array(w), np.array([[0.01446373363981278]]), 3)[1][0])
    # The load recorded with this input; the model's recorded error is 5.6e-7.
    assert got == pytest.approx(0.004341311007738114, abs=3e-3)

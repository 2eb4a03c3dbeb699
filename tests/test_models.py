"""Fitting and scoring."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from flowgauge.functions import nets
from flowgauge.operators import models as J


def test_jacobian_matches_differences():
    rng = np.random.default_rng(0)
    x, w = rng.normal(size=(5, 3)), rng.normal(size=nets.size(3, 4))
    _, jac = nets.jacobian(w, x, 4)
    for i in range(len(w)):
        step = np.zeros_like(w)
        step[i] = 1e-6
        diff = (nets.forward(w + step, x, 4)[1] - nets.forward(w - step, x, 4)[1]) / 2e-6
        assert jac[:, i] == pytest.approx(diff, abs=1e-6)


@pytest.fixture(scope="module")
def train(spark):
    """Two components; each traffic value repeats, so grouping has work to do."""
    x = (F.col("id") % 40) / 40.0
    noise = (F.hash("id") % 100) / 1e5
    return spark.range(800).select(
        F.when(F.col("id") % 2 == 0, "a").otherwise("b").alias("component"),
        x.alias("norm_traffic"),
        (F.when(F.col("id") % 2 == 0, x * 0.5).otherwise(x * x * 0.1) + noise).alias("norm_load"),
    )


def test_component_models(spark, train):
    models = J.fit_component_models(train).cache()
    assert {r["component"] for r in models.collect()} == {"a", "b"}
    reported = {r["component"]: r["mse"] for r in models.collect()}
    measured = {r["component"]: r["mse"] for r in J.model_error(train, models).collect()}
    assert measured == pytest.approx(reported, abs=1e-9)
    assert all(mse <= 1e-4 for mse in reported.values())


def test_no_fit_is_worse_than_the_mean(spark, train):
    """Targets that no input explains leave the network at the mean or below it."""
    df = train.withColumn("norm_load", (F.abs(F.hash("norm_load")) % 1000) / 1e9)
    variance = {r[0]: r[1] for r in df.groupBy("component").agg(F.var_pop("norm_load")).collect()}
    for method in ("rprop", "newton"):
        models = J.fit_component_models(df, tolerance=0.0, max_epochs=6, method=method).collect()
        assert all(r["mse"] <= variance[r["component"]] * (1 + 1e-9) and r["n"] == 400 for r in models)
    assert J.fit_component_models(df.limit(0)).count() == 0


def test_fit_goes_on_until_the_limit(spark, train):
    """No step count or gain ends a fit that still improves."""
    models = J.fit_component_models(train, tolerance=1e-6, method="newton").collect()
    assert all(r["mse"] <= 1e-6 for r in models), models


def test_resilient_propagation_follows_a_curve():
    """Steps of their own take all weights far below the best line, from sums alone, and never back."""
    x = np.linspace(0, 1, 50)[:, None]
    y = 0.5 * x[:, 0] ** 2 + 0.1
    own = (np.full(50, 3.0), 3 * y, 3 * y * y)
    line = np.polyfit(x[:, 0], y, 1)
    straight = ((np.polyval(line, x[:, 0]) - y) ** 2).mean()
    w = nets.line_start(nets.initial_weights(1, 3, 7), y.mean(), line[:1], x.mean(0), 3)
    fit = nets.Propagation(w, np.ones(1), straight / 20, 150.0)
    fit.accept(w, fit.sums(w, x, *own, 3))
    assert fit.mse <= 1.5 * straight  # the line bends a little on the way through the output
    errors = [fit.mse]
    while not fit.done and fit.epochs < 2000:
        (trial,) = fit.trials()
        fit.choose([trial], [fit.sums(trial, x, *own, 3)])
        errors.append(fit.mse)
    assert fit.mse <= straight / 20 and errors == sorted(errors, reverse=True)


def test_resilient_propagation_over_spark(spark, train):
    """Gradients summed by Spark lead to the limit, which ends the fit."""
    models = J.fit_component_models(train, max_epochs=60).collect()
    variance = {r[0]: r[1] for r in train.groupBy("component").agg(F.var_pop("norm_load")).collect()}
    assert all(r["mse"] <= 3e-5 < variance[r["component"]] and r["epochs"] < 60 for r in models)


def test_worker_model(spark):
    cols = [(F.abs(F.hash("id", F.lit(i))) % 1000) / 15000.0 for i in range(3)]
    df = spark.range(400).select(*[c.alias(n) for c, n in zip(cols, J.WORKER_INPUTS)])
    df = df.withColumn("norm_cpu", F.tanh(8 * F.col("norm_in") + 6 * F.col("norm_load")))
    model = J.fit_worker_model(df, method="newton")
    got = model.first()
    assert got["mse"] <= 0.015 and len(got["w"]) == 21
    error = df.withColumn("w", model.select("w").scalar()).agg(
        F.avg(F.pow(F.col("norm_cpu") - J.worker_net("w"), 2))
    ).first()[0]
    assert error == pytest.approx(got["mse"], rel=1e-6)


def test_linear_baseline(spark):
    df = spark.range(10).select(
        F.lit("c").alias("component"), F.col("id").cast("double").alias("norm_traffic"),
        (F.col("id") * 2.0 + 1).alias("norm_load"),
    )
    got = J.fit_linear_load(df).first()
    assert (got["slope"], got["intercept"], got["r2"]) == pytest.approx((2, 1, 1))


def test_no_fit_is_worse_than_the_line(spark):
    """The output's bend does not keep a network that starts as a line from being one."""
    x = F.col("id") % 40
    df = spark.range(400).select(
        F.lit("c").alias("component"), (x / 4.0 + 20).alias("norm_traffic"), (0.15 + x * 0.015 + (F.col("id") % 3) * 1e-3).alias("norm_load")
    )
    left = df.agg(F.var_pop("norm_load") * (1 - F.regr_r2("norm_load", "norm_traffic"))).first()[0]
    (fit,) = J.fit_component_models(df, tolerance=left, max_epochs=0).collect()
    assert fit["mse"] <= 1.05 * left, (fit["mse"], left)


@pytest.mark.parametrize("method", ["rprop", "newton"])
def test_networks_of_few_inputs_take_the_same_steps(spark, train, method):
    """A fit in one task and one by Spark passes end at the same weights and epochs."""
    df = train.withColumn("component", F.when(F.col("component") == "a", "a"))
    ways = []
    for alone in (0, 10_000):
        models = J.fit_networks(
            df, ["component"], ["norm_traffic"], "norm_load", hidden=3, tolerance=1e-9, max_epochs=4, method=method, attempts=2, alone=alone
        )
        ways.append({r["component"]: r for r in models.collect()})
    assert set(ways[0]) == set(ways[1]) == {"a", None}
    for key in ways[0]:
        assert ways[0][key]["epochs"] == ways[1][key]["epochs"] and ways[0][key]["n"] == ways[1][key]["n"] == 400
        assert ways[0][key]["mse"] == pytest.approx(ways[1][key]["mse"], rel=1e-4)


def test_long_fits_of_few_inputs_need_no_passes(spark):
    """Thousands of epochs of a network with few inputs: no job an epoch."""
    df = spark.range(60).select(
        F.lit("c").alias("component"), (F.col("id") % 20).cast("double").alias("norm_traffic"), (F.abs(F.hash("id")) % 100 / 100.0).alias("norm_load")
    )
    tracker = spark.sparkContext.statusTracker()
    spark.sparkContext.setJobGroup("long-fit", "long-fit")
    try:
        (fit,) = J.fit_component_models(df, max_epochs=2_000).collect()
    finally:
        spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    assert fit["mse"] > 3e-5 and fit["epochs"] > 500
    assert len(tracker.getJobIdsForGroup("long-fit")) < 60


def test_worker_model_on_scattered_targets(spark):
    """28 points that no line explains, far from zero: one set of hidden neurons stays at 0.9 of the variance."""
    rows = []
    for i in range(28):
        load = 1.1 + 0.045 * i
        rows.append((6.2 * load + 0.3 * ((i * 7) % 5), 6.0 * load + 0.3 * ((i * 3) % 7), load, float((i * 37 + (i * i) % 11 * 13) % 101) / 100))
    df = spark.createDataFrame(rows, [*J.WORKER_INPUTS, "norm_cpu"])
    variance = df.agg(F.var_pop("norm_cpu")).first()[0]
    fit = J.fit_worker_model(df, method="newton", max_epochs=100).first()
    assert fit["mse"] <= 0.5 * variance, fit["mse"] / variance

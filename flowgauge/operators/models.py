"""Training sets, model fitting and scoring."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from flowgauge.functions import nets
from flowgauge.functions.scalars import max_traffic_per_second, normalise, tanh_net
from flowgauge.operators.filters import drop_warmup
from flowgauge.operators.propagate import max_traffic_in, whatif_traffic, worker_traffic_normaliser
from flowgauge.operators.rollup import cluster_capacity, scope
from flowgauge.runtime import cut_lineage

COMPONENT_HIDDEN = 3
WORKER_HIDDEN = 4
WORKER_INPUTS = ("norm_in", "norm_out", "norm_load")
#: Distinct inputs up to which one task fits a network; beyond, every epoch is a Spark pass.
ALONE_INPUTS = 10_000


def component_training_set(
    points: DataFrame,
    components: DataFrame,
    max_traffic: DataFrame,
    node: DataFrame,
    *,
    max_sec: float,
    system_components: Sequence[str] = ("__acker",),
) -> DataFrame:
    """Traffic over peak input and load over cluster capacity, per task and snapshot.

    Spouts and the system components listed use the assumed peak itself.
    """
    keys = scope(points, components, max_traffic)
    at = [*keys, "component"]
    by_peak = (F.col("kind") == "spout") | F.col("component").cast("string").isin(
        *system_components
    )
    tops = (
        components.select(*at, "kind")
        .join(max_traffic_in(max_traffic), at, "left")
        .select(
            *at,
            F.when(by_peak, F.lit(float(max_sec)))
            .otherwise(F.coalesce("max_in", F.lit(0.0)))
            .alias("__top"),
        )
    )
    capacity = cluster_capacity(node).scalar()
    return (
        drop_warmup(points)
        .join(tops, at)
        .select(
            *points.columns,
            normalise("traffic", "__top").alias("norm_traffic"),
            (F.col("load").cast("double") / capacity).alias("norm_load"),
        )
    )


def whatif_training_set(
    points: DataFrame,
    edges: DataFrame,
    alfa: DataFrame,
    components: DataFrame,
    node: DataFrame,
    *,
    max_traffic: float,
    factor: int,
    current_max_sec: float,
    current_factor: int,
) -> tuple[DataFrame, DataFrame]:
    """Peak traffic and training set under another assumed peak or factor, for fitting anew."""
    spread = whatif_traffic(
        edges,
        alfa,
        components,
        max_traffic=max_traffic,
        factor=factor,
        current_max_sec=current_max_sec,
        current_factor=current_factor,
    )
    rate = max_traffic_per_second(max_traffic, factor, current_max_sec, current_factor)
    top = points.sparkSession.range(1).select(rate.alias("r")).first()[0]
    return spread, component_training_set(points, components, spread, node, max_sec=top)


def worker_training_set(points: DataFrame, max_traffic: DataFrame, node: DataFrame) -> DataFrame:
    """Input, output, load and CPU of each host and snapshot, each over its peak."""
    keys = scope(points, max_traffic)
    total = worker_traffic_normaliser(max_traffic)
    if keys:
        known = points.join(total, keys)
    else:
        known = points.withColumn("max_worker_traffic", total.scalar())
    capacity = cluster_capacity(node).scalar()
    return known.select(
        *points.columns,
        normalise("traffic_in", "max_worker_traffic").alias("norm_in"),
        normalise("traffic_out", "max_worker_traffic").alias("norm_out"),
        (F.col("load").cast("double") / capacity).alias("norm_load"),
        (F.col("cpu") / 100.0).alias("norm_cpu"),
    )


# --- fitting ---------------------------------------------------------------------


def _begun(
    known: dict, inputs: int, *, hidden: int, tolerance: float, method: str, starts: Sequence[str], attempts: int, seed: int
) -> tuple[list[nets.Search], list[list[np.ndarray]]]:
    """The searches for one network and the weights that each may start with, from sums over its rows."""
    n, mean = known["n"], known["sy"] / known["n"]
    centre = np.array([known[f"__x_{i}"] for i in range(inputs)]) / n
    cross = np.array([known[f"__xy_{i}"] for i in range(inputs)]) / n - mean * centre
    spread = np.zeros((inputs, inputs))
    for i in range(inputs):
        for j in range(i + 1):
            spread[i, j] = spread[j, i] = known[f"__xx_{i}_{j}"] / n - centre[i] * centre[j]
    # Inputs are brought to one place and size for the search; weights are scaled back.
    scale = np.sqrt(np.maximum(np.diag(spread), 0.0))
    scale = np.where(scale > 1e-6 * np.abs(centre), scale, np.maximum(np.abs(centre), 1e-300))
    slope = np.linalg.lstsq(spread / scale / scale[:, None], cross / scale, rcond=1e-10)[0]
    ends = np.array([[known[f"__{end}_{i}"] for i in range(inputs)] for end in ("low", "high")])
    steps = slope * (ends - centre) / scale
    span = float(steps.min(axis=0).sum()), float(steps.max(axis=0).sum())
    searches, tried = [], []
    for k in range(attempts):
        w = nets.initial_weights(inputs, hidden, seed + k)
        begun = {"mean": lambda: nets.mean_start(w, mean, hidden)}  # noqa: B023
        begun["line"] = lambda: nets.line_start(w, mean, slope, np.zeros(inputs), hidden, span)  # noqa: B023
        tried.append([begun[start]() for start in starts])
        searches.append(nets.METHODS[method](w, scale, tolerance, n, centre=centre))
    return searches, tried


def _search(
    begun: dict[tuple, tuple[list[nets.Search], list[list[np.ndarray]]]],
    sums_at: Callable[[dict[tuple, list[np.ndarray]]], dict[tuple, np.ndarray]],
    max_epochs: int,
) -> dict[tuple, nets.Search]:
    """Run the searches of all networks side by side, on sums that ``sums_at`` gives for many weights at once."""

    def sums_of(wanted: dict[tuple, list[list[np.ndarray]]]) -> dict[tuple, list[np.ndarray]]:
        found = sums_at({key: [w for own in lists for w in own] for key, lists in wanted.items()})
        return {key: np.split(found[key], np.cumsum([len(own) for own in lists])[:-1]) for key, lists in wanted.items()}

    if begun:
        for key, found in sums_of({key: tried for key, (_, tried) in begun.items()}).items():
            for fit, tried, own in zip(*begun[key], found, strict=True):
                best = int(np.argmin(own[:, -1]))
                fit.accept(tried[best], own[best])
    fits = {key: searches for key, (searches, _) in begun.items()}
    for _ in range(max_epochs):
        left = {key: [f for f in own if not f.done] for key, own in fits.items() if all(f.mse > f.limit for f in own)}
        left = {key: own for key, own in left.items() if own}
        if not left:
            break
        trials = {key: [f.trials() for f in own] for key, own in left.items()}
        for key, found in sums_of(trials).items():
            for fit, tried, own in zip(left[key], trials[key], found, strict=True):
                fit.choose(tried, own)
    return {key: min(own, key=lambda f: f.mse) for key, own in fits.items()}


def fit_networks(
    train: DataFrame,
    keys: Sequence[str],
    inputs: Sequence[str],
    target: str,
    *,
    hidden: int,
    tolerance: float,
    max_epochs: int,
    method: str = "rprop",
    starts: Sequence[str] = ("mean", "line"),
    attempts: int = 1,
    alone: int = ALONE_INPUTS,
    seed: int = 7,
) -> DataFrame:
    """Fit one tanh network per key over any number of rows: ``keys, w, mse, n, epochs``.

    Rows are first grouped by key and equal inputs into count, sum and sum of squares
    of the target; squared error depends on nothing else. Every network starts as the
    best of its ``starts``, the mean of its targets or the plane of least squares, and
    none ends worse; of ``attempts`` with other hidden neurons the best is kept. ``method``
    is ``rprop``, resilient propagation with a step of its own for each weight, or
    ``newton``, damped Gauss-Newton steps, which take more sums and far fewer epochs.

    An epoch is one pass for all networks together: tasks sum what a step needs over
    their own rows, Spark adds the sums per key, and the driver sees those few numbers per
    network to choose its next step. A network of at most ``alone`` distinct inputs, which
    a pass costs more than its arithmetic, takes the same steps in one task from end to end.

    A network is done at a mean squared error of ``tolerance``, where no step changes
    it any more, or after ``max_epochs``.
    """
    keys, inputs = list(keys), list(inputs)
    spark, y, sums = train.sparkSession, F.col(target).cast("double"), nets.METHODS[method].sums
    data = cut_lineage(
        train.groupBy(*keys, *[F.col(c).cast("double").alias(c) for c in inputs]).agg(
            F.count(F.lit(1)).cast("double").alias("__n"), F.sum(y).alias("__sy"), F.sum(y * y).alias("__syy")
        )
    )
    schema = "".join(f"`{c}` {train.schema[c].dataType.simpleString()}, " for c in keys)
    schema += "w array<double>, mse double, n long, epochs int"
    settings = {
        "hidden": hidden, "tolerance": tolerance, "method": method, "starts": tuple(starts), "attempts": attempts, "seed": seed,
    }
    pairs = [(i, j) for i in range(len(inputs)) for j in range(i + 1)]

    def result(key: tuple, fit: nets.Search) -> tuple:
        return (*key, fit.scaled_back(len(inputs), hidden), fit.mse, int(fit.rows), fit.epochs)

    def whole(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        x, (n, sy, syy) = pdf[inputs].to_numpy(), (pdf[c].to_numpy() for c in ("__n", "__sy", "__syy"))
        known = {"n": n.sum(), "sy": sy.sum()}
        for i in range(len(inputs)):
            known |= {f"__low_{i}": x[:, i].min(), f"__high_{i}": x[:, i].max(), f"__x_{i}": n @ x[:, i], f"__xy_{i}": sy @ x[:, i]}
        known |= {f"__xx_{i}_{j}": (n * x[:, i]) @ x[:, j] for i, j in pairs}
        begun = _begun(known, len(inputs), **settings)
        x = (x - begun[0][0].centre) / begun[0][0].scale
        found = _search({(): begun}, lambda at: {(): np.array([sums(w, x, n, sy, syy, hidden) for w in at[()]])}, max_epochs)
        return pd.DataFrame([result(key, found[()])], columns=[*keys, "w", "mse", "n", "epochs"])

    # One row per network: its size, and the sums of a plane of least squares.
    known = data.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("__m"),
        F.sum("__n").alias("n"),
        F.sum("__sy").alias("sy"),
        *[F.min(c).alias(f"__low_{i}") for i, c in enumerate(inputs)],
        *[F.max(c).alias(f"__high_{i}") for i, c in enumerate(inputs)],
        *[F.sum(F.col("__n") * F.col(c)).alias(f"__x_{i}") for i, c in enumerate(inputs)],
        *[F.sum(F.col("__sy") * F.col(c)).alias(f"__xy_{i}") for i, c in enumerate(inputs)],
        *[F.sum(F.col("__n") * F.col(inputs[i]) * F.col(inputs[j])).alias(f"__xx_{i}_{j}") for i, j in pairs],
    )
    known = cut_lineage(known.where("n > 0"))
    large = known.where(F.col("__m") > alone)
    begun = {tuple(row[c] for c in keys): _begun(row.asDict(), len(inputs), **settings) for row in large.collect()}
    # Networks of few inputs, each in a task; none of them has more rows than ``alone``.
    few = known.where(F.col("__m") <= alone).select(*[F.col(c).alias(f"__few_{c}") for c in keys])
    same = [F.col(c).eqNullSafe(F.col(f"__few_{c}")) for c in keys]
    mine = data.join(few, same, "left_semi") if keys else (data.limit(0) if begun else data)
    if keys:
        mine = mine.repartition(int(spark.conf.get("spark.sql.shuffle.partitions")), *keys)
    small = mine.groupBy(*keys).applyInPandas(whole, schema)

    def sums_at(trials: dict[tuple, list[np.ndarray]]) -> dict[tuple, np.ndarray]:
        places = {key: (begun[key][0][0].centre, begun[key][0][0].scale) for key in trials}
        order = list(trials)

        def partial(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            total = {}
            for pdf in batches:
                groups = pdf.groupby(keys, sort=False, dropna=False) if keys else [((), pdf)]
                for key, rows in groups:
                    key = tuple(None if pd.isna(v) else v for v in key)
                    if key in places:
                        x = (rows[inputs].to_numpy() - places[key][0]) / places[key][1]
                        own = [rows[c].to_numpy() for c in ("__n", "__sy", "__syy")]
                        found = np.array([sums(w, x, *own, hidden) for w in trials[key]])
                        total[key] = total.get(key, 0.0) + found
            for key, found in total.items():
                yield pd.DataFrame({"m": order.index(key), "i": np.arange(found.size), "v": found.ravel()})

        added = data.mapInPandas(partial, "m int, i int, v double").groupBy("m", "i").agg(F.sum("v").alias("v"))
        flat: dict[int, dict[int, float]] = {}
        for row in added.collect():
            flat.setdefault(row["m"], {})[row["i"]] = row["v"]
        return {
            order[m]: np.array([found[i] for i in range(len(found))]).reshape(len(trials[order[m]]), -1)
            for m, found in flat.items()
        }

    fits = _search(begun, sums_at, max_epochs)
    return cut_lineage(small).unionByName(spark.createDataFrame([result(key, fit) for key, fit in fits.items()], schema))


def fit_component_models(
    train: DataFrame, *, tolerance: float = 3e-5, max_epochs: int = 50_000, method: str = "rprop", seed: int = 7
) -> DataFrame:
    """Fit traffic -> load per component with a tanh 1-3-1 network, see :func:`fit_networks`.

    Traffic is a whole number of tuples per second, so a component has at most its
    peak rate in distinct inputs however long the history is.
    """
    return fit_networks(
        train,
        [*scope(train), "component"],
        ["norm_traffic"],
        "norm_load",
        hidden=COMPONENT_HIDDEN,
        tolerance=tolerance,
        max_epochs=max_epochs,
        method=method,
        seed=seed,
    )


def fit_worker_model(
    train: DataFrame,
    *,
    tolerance: float = 0.015,
    max_epochs: int = 1_000,
    method: str = "rprop",
    attempts: int = 8,
    seed: int = 7,
) -> DataFrame:
    """Fit host traffic and load -> CPU with one tanh 3-4-1 network over all rows.

    It starts at the mean: a plane would bind the first of few neurons. One set of hidden
    neurons often stays far from what others reach, so several are tried.
    """
    return fit_networks(
        train,
        [],
        WORKER_INPUTS,
        "norm_cpu",
        hidden=WORKER_HIDDEN,
        tolerance=tolerance,
        max_epochs=max_epochs,
        method=method,
        starts=("mean",),
        attempts=attempts,
        seed=seed,
    )


def fit_linear_load(train: DataFrame) -> DataFrame:
    """Straight-line baseline of load on traffic per component."""
    y, x = F.col("norm_load"), F.col("norm_traffic")
    return train.groupBy(*scope(train), "component").agg(
        F.regr_slope(y, x).alias("slope"),
        F.regr_intercept(y, x).alias("intercept"),
        F.regr_r2(y, x).alias("r2"),
        F.count(F.lit(1)).alias("n"),
    )


# --- scoring ---------------------------------------------------------------------


def component_net(x: Column | str, w: Column | str) -> Column:
    return tanh_net([F.col(x) if isinstance(x, str) else x], w, COMPONENT_HIDDEN)


def worker_net(w: Column | str, inputs: Sequence[str] = WORKER_INPUTS) -> Column:
    return tanh_net([F.col(c) for c in inputs], w, WORKER_HIDDEN)


def score_component_load(points: DataFrame, models: DataFrame, node: DataFrame) -> DataFrame:
    """Predicted cycles per second for each point with a ``norm_traffic``."""
    keys = [*scope(points, models), "component"]
    return points.join(models.select(*keys, "w"), keys).select(
        *points.columns,
        (component_net("norm_traffic", "w") * cluster_capacity(node).scalar()).alias(
            "predicted_load"
        ),
    )


def model_error(points: DataFrame, models: DataFrame) -> DataFrame:
    """Mean squared error of each component model on normalised points."""
    keys = [*scope(points, models), "component"]
    miss = F.col("norm_load") - component_net("norm_traffic", "w")
    return (
        points.join(models.select(*keys, "w"), keys)
        .groupBy(*keys)
        .agg(F.avg(miss * miss).alias("mse"), F.count(F.lit(1)).alias("n"))
    )


def replace_model(models: DataFrame, component, w: Sequence[float]) -> DataFrame:
    """Swap the weights of one component; unknown components change nothing."""
    new = F.array(*[F.lit(float(v)) for v in w])
    return models.withColumn("w", F.when(F.col("component") == component, new).otherwise(F.col("w")))

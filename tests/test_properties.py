"""Distributed forms against plain sequential loops on random inputs."""

import random

import pytest
from pyspark.sql import functions as F

from flowgauge.operators import capacity as K
from flowgauge.operators import cpu as C
from flowgauge.operators import ordered as O
from flowgauge.operators import propagate as G
from flowgauge.operators import selectivity as A
from flowgauge.operators import series as E


def make(spark, rows, schema):
    return spark.createDataFrame(rows, schema)


def random_log(seed, n=300):
    rng = random.Random(seed)
    ts, rows = 1_000_000, []
    for _ in range(n):
        ts += rng.choice([0, 1, 250, 999, 1000, 1001, 1500, 7000])
        rows.append((ts, rng.randrange(10**9)))
    return rows


def loop_seconds(rows):
    begin, second, out = rows[0][0], 0, []
    for ts, value in rows:
        while ts - begin > 1000:
            begin += 1000
            second += 1
        out.append((second, value))
    return out


@pytest.mark.parametrize("seed", range(3))
def test_anchored_seconds(spark, seed):
    rows = random_log(seed)
    expected = {}
    for second, ns in loop_seconds(rows):
        expected.setdefault(second, []).append(ns // 1_000_000)
    log = make(spark, random.Random(seed).sample(rows, len(rows)), "ts_ms bigint, latency_ns bigint")
    latency = {r["second"]: r["latency_ms"] for r in E.latency_per_second(log).collect()}
    counts = {r["second"]: r["n"] for r in E.throughput_per_second(log).collect()}
    for second in range(max(expected) + 1):
        values = expected.get(second)
        assert latency[second] == (sum(values) // len(values) if values else None)
        assert counts[second] == (len(values) if values else None)
    assert len(latency) == max(expected) + 1


@pytest.mark.parametrize("seed", range(3))
def test_merged_throughput(spark, seed):
    rows = [(ts, v % 9) for ts, v in random_log(seed)]
    sums = {}
    for second, v in loop_seconds(rows):
        sums[second] = sums.get(second, 0) + v
    last = max(sums)
    log = make(spark, rows, "ts_ms bigint, cnt bigint")
    got = {r["second"]: r["n"] for r in E.merged_throughput_per_second(log).collect()}
    assert got == {s: sums.get(s, 0) for s in range(last)}


@pytest.mark.parametrize("seed", range(3))
def test_reports(spark, seed):
    rng = random.Random(seed)
    second, rows = -3, []
    for i in range(400):
        second += rng.choice([0, 0, 0, 1, 3])
        rows.append((i, second - rng.choice([0, 0, 1, 2])))
    last, count, expected = -1, 0, {}
    for _, s in rows:
        if s > last:
            if last > -1:
                expected[last] = count
            last, count = s, 0
        count += 1
    df = make(spark, rows, "row_id bigint, second bigint")
    got = E.reports_per_second(df)
    assert {r["second"]: r["n"] for r in got.collect()} == expected
    peak = E.peak_second(got).first()
    best = max(expected.values())
    assert (peak["second"], peak["n"]) == (min(s for s, n in expected.items() if n == best), best)


def test_moving_average(spark):
    rng = random.Random(5)
    values = [rng.choice([None, rng.randrange(100)]) for _ in range(83)]
    df = make(spark, list(enumerate(values)), "second bigint, v bigint")
    got = E.moving_average(df, ["v"], scale={"v": 3}, width=16).orderBy("second").collect()
    flat = [3 * (v or 0) for v in values]
    for i, r in enumerate(got):
        want = flat[i] if i < 10 else sum(flat[i - 9 : i + 1]) / 10
        assert r["v_avg"] == pytest.approx(want)
    assert len(got) == len(values)


def skewed(seed, n=500):
    """One key holds most rows; order values have holes."""
    rng = random.Random(seed)
    at, rows = {}, []
    for _ in range(n):
        key = rng.choice(["hot"] * 5 + ["a", "b"])
        at[key] = at.get(key, rng.randrange(50)) + rng.choice([1, 2, 40])
        rows.append((key, at[key], rng.randrange(-20, 20)))
    return rows


def by_key(rows):
    out = {}
    for row in sorted(rows, key=lambda r: r[:2]):
        out.setdefault(row[0], []).append(row)
    return out


@pytest.mark.parametrize("width", [1, 7, 64, 1 << 20])
def test_ordered_scans(spark, width):
    rows = skewed(width)
    df = make(spark, rows, "k string, o bigint, v bigint")
    got = O.running(
        df, ["k"], "o", {"s": ("sum", "v"), "m": ("max", "v"), "n": ("count", "v")}, width=width
    )
    before = O.previous(df, ["k"], "o", {"p": "v"}, width=width)
    placed = O.dense_position(df, ["k"], "o", width=width)
    tail = O.trailing(placed, ["k"], "pos", {"t": F.sum("v")}, rows=4, width=max(width, 5))
    running = {(r["k"], r["o"]): (r["s"], r["m"], r["n"]) for r in got.collect()}
    lag = {(r["k"], r["o"]): r["p"] for r in before.collect()}
    trail = {(r["k"], r["o"]): r["t"] for r in tail.collect()}
    assert len(running) == len(lag) == len(trail) == len(rows)
    for key, mine in by_key(rows).items():
        vs = [r[2] for r in mine]
        for i, (_, o, _) in enumerate(mine):
            assert running[key, o] == (sum(vs[: i + 1]), max(vs[: i + 1]), i + 1)
            assert lag[key, o] == (vs[i - 1] if i else None)
            assert trail[key, o] == sum(vs[max(0, i - 3) : i + 1])


def test_integer_range(spark):
    ends = make(spark, [("a", 3, 20), ("b", 0, 0), ("c", 5, 4)], "k string, lo bigint, hi bigint")
    got = {}
    for r in O.integer_range(ends, "lo", "hi", "i", chunk=4).collect():
        got.setdefault(r["k"], []).append(r["i"])
    assert {k: sorted(v) for k, v in got.items()} == {"a": list(range(3, 21)), "b": [0]}


@pytest.mark.parametrize("slab_ms", [1000, 2500, 60_000, 3_600_000])
def test_accepted_readings(spark, slab_ms):
    rng = random.Random(slab_ms)
    rows, expected = [], []
    for task in ("hot", "cold", "one"):
        ts, cpu = 1_000_000, 0
        readings = []
        for _ in range({"hot": 600, "cold": 60, "one": 1}[task]):
            ts += rng.choice([0, 1, 30, 400, 999, 1000, 1001]) if task == "hot" else rng.randrange(9000)
            cpu += rng.randrange(1, 10**6)
            readings.append((task, ts, cpu))
        rows += readings
        last_ts, last_cpu = None, 0
        for _, ts, cpu in readings:
            if last_ts is None or ts - last_ts >= 1000:
                expected.append((task, ts, int((cpu - last_cpu) * 2.5)))
                last_ts, last_cpu = ts, cpu
    rng.shuffle(rows)
    df = make(spark, rows, "task_id string, ts_ms bigint, cpu_ns bigint")
    got = C.task_cycles(df, speed_hz=10_000_000_000, cores=4, slab_ms=slab_ms).collect()
    assert sorted(tuple(r) for r in got) == sorted(expected)


def test_rolling_cpu(spark):
    rng = random.Random(9)
    cpu, rows = 0, []
    for i in range(40):
        cpu += rng.randrange(0, 9 * 10**9)
        rows.append(("h", i * 10_000, cpu, 2))
    recent, expected = [], {}
    for (_, _, before, _), (_, ts, now, _) in zip(rows, rows[1:]):
        if before > 0:
            recent = [*recent, (now - before) * 100 // (10 * 10**9 * 2)][-6:]
            expected[ts] = (recent[-1], sum(recent) // len(recent))
    df = make(spark, rows, "host string, ts_ms bigint, cpu_ns bigint, cores int")
    got = C.rolling_cpu(df, width=70_000).collect()
    assert {r["ts_ms"]: (r["cpu_percent"], r["cpu_usage"]) for r in got} == expected


def test_cpu_utilisation_without_progress(spark):
    rows = [("h", "cpu", 0, 5, 5), ("h", "cpu", 1, 8, 6), ("h", "cpu", 2, 8, 6)]
    df = make(spark, rows, "host string, core string, ts_ms bigint, busy bigint, idle bigint")
    got = {r["ts_ms"]: r["utilisation"] for r in C.cpu_utilisation(df).collect()}
    assert got == {1: 0.75, 2: None}


def test_history_chunks(spark):
    rows = [("e", i, float(i)) for i in range(25)]
    df = make(spark, rows, "k string, snapshot_id int, v double")
    got = A.history_array(df, ["k"], "v", chunk=10).orderBy("chunk").collect()
    assert [len(r["history"]) for r in got] == [10, 10, 5]
    assert [v for r in got for v in r["history"]] == [float(i) for i in reversed(range(25))]


@pytest.mark.parametrize(("low", "high", "n"), [(1, 7, 3), (6, 9, 4), (10, 10, 1), (1, 100, 7)])
def test_split_tasks(spark, low, high, n):
    df = make(spark, [("c", low, high, n)], "component string, min_task int, max_task int, parallelism int")
    got = K.split_tasks(df).orderBy("executor_no").collect()
    sizes = [r["end_task"] - r["start_task"] + 1 for r in got]
    assert max(sizes) - min(sizes) <= 1 and sizes == sorted(sizes, reverse=True)
    covered = [t for r in got for t in range(r["start_task"], r["end_task"] + 1)]
    assert covered == list(range(low, high + 1))


@pytest.mark.parametrize("seed", range(2))
def test_propagation_on_random_graphs(spark, seed):
    rng = random.Random(seed)
    kinds = {f"c{i}": "spout" if i < 2 else "bolt" for i in range(8)}
    names = list(kinds)
    edges = {
        (a, b): rng.random()
        for i, a in enumerate(names)
        for b in names[max(i + 1, 2) :]
        if rng.random() < 0.5
    }

    def total_in(c):
        return sum(weight(a, b) for a, b in edges if b == c)

    def weight(a, b):
        return 100.0 if kinds[a] == "spout" else edges[a, b] * total_in(a)

    alfa = make(spark, [(*e, v) for e, v in edges.items()], "src string, dst string, alfa double")
    components = make(spark, list(kinds.items()), "component string, kind string")
    got = G.propagate_max_traffic(alfa.select("src", "dst"), alfa, components, 100.0).collect()
    assert {(r["src"], r["dst"]): r["max_traffic"] for r in got} == pytest.approx(
        {e: weight(*e) for e in edges}
    )


def test_cycle_is_refused(spark):
    rows = [("s", "a", 1.0), ("a", "b", 1.0), ("b", "a", 1.0)]
    alfa = make(spark, rows, "src string, dst string, alfa double")
    components = make(spark, [("s", "spout"), ("a", "bolt"), ("b", "bolt")], "component string, kind string")
    with pytest.raises(ValueError, match="cycle"):
        G.propagate_max_traffic(alfa.select("src", "dst"), alfa, components, 1.0)


def placement_score(spark, names):
    placements = [(0, 1, names[0], 1), (0, 2, names[0], 2), (0, 3, names[1], 1)]
    place = make(spark, placements, "allocation_id int, executor int, hostname string, port int")
    load = make(spark, [(1, 40), (2, 10), (3, 30)], "executor int, load bigint")
    pairs = make(
        spark, [(1, 2, 5), (1, 3, 7), (2, 3, 0)], "src_executor int, dst_executor int, traffic bigint"
    )
    node = make(spark, [(n, 2, 100) for n in names], "hostname string, core_count int, core_speed bigint")
    score = K.placement_score(
        K.node_load_stats(place, load, node), K.placement_traffic_split(place, pairs)
    )
    return score.first()


def test_score_by_hand_and_under_renaming(spark):
    import statistics

    got = placement_score(spark, ["x", "y", "idle"])
    shares = [50 / 200, 30 / 200, 0.0]
    mean, sd = statistics.mean(shares), statistics.stdev(shares)
    assert (got["mean_load"], got["stddev_load"]) == pytest.approx((mean, sd))
    assert (got["total_traffic"], got["inter_node"], got["inter_slot"]) == (12, 7, 5)
    want = ((0.5 * sd / mean) ** 2 + (0.5 * (0.5 * 7 / 12 + 0.5 * 5 / 12)) ** 2) ** 0.5
    assert got["score"] == pytest.approx(want)
    assert placement_score(spark, ["b", "a", "c"])["score"] == pytest.approx(want)


def test_one_node_has_no_deviation(spark):
    place = make(spark, [(0, 1, "x", 1)], "allocation_id int, executor int, hostname string, port int")
    load = make(spark, [(1, 40)], "executor int, load bigint")
    node = make(spark, [("x", 2, 100)], "hostname string, core_count int, core_speed bigint")
    assert K.node_load_stats(place, load, node).first()["stddev_load"] == 0.0

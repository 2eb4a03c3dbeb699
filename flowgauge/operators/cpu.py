"""CPU utilisation and cycle counts from cumulative counters."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from flowgauge.functions.scalars import int_div
from flowgauge.operators.ordered import dense_position, previous, scan, trailing
from flowgauge.runtime import cut_lineage


def busy_idle(counters: DataFrame) -> DataFrame:
    """Fold raw counters into busy and idle time; waiting for I/O is idle."""
    busy = sum((F.col(c) for c in ("nice", "system", "irq", "softirq")), F.col("user"))
    return counters.select(
        "host", "core", "ts_ms", busy.alias("busy"), (F.col("idle") + F.col("iowait")).alias("idle")
    )


def cpu_utilisation(
    samples: DataFrame, *, order: str = "ts_ms", keys: Sequence[str] = ("host", "core"), **slab
) -> DataFrame:
    """Share of busy time since the sample before; the first sample has none."""
    seen = previous(samples, keys, order, {"__busy": "busy", "__idle": "idle"}, **slab)
    d_busy = F.col("busy") - F.col("__busy")
    d_idle = F.col("idle") - F.col("__idle")
    return seen.filter(F.col("__busy").isNotNull()).select(
        *keys, order, F.try_divide(d_busy, d_busy + d_idle).alias("utilisation")
    )


def rolling_cpu(
    samples: DataFrame,
    *,
    order: str = "ts_ms",
    keys: Sequence[str] = ("host",),
    bucket_seconds: int = 10,
    buckets: int = 6,
    **slab,
) -> DataFrame:
    """CPU percent per bucket and its whole-number mean over the last buckets.

    ``samples`` has one cumulative ``cpu_ns`` reading per bucket and ``cores``. A
    reading counts from the first positive one on; the counter never falls, so the
    readings before it are the first ones and need no numbering of their own.
    """
    keys = list(keys)
    seen = scan(
        samples,
        keys,
        order,
        totals={"__n": ("count", order)},
        lags={"__before": "cpu_ns"},
        **slab,
    )
    budget = F.lit(bucket_seconds * 1_000_000_000) * F.col("cores")
    percent = int_div((F.col("cpu_ns") - F.col("__before")) * 100, budget)
    used = seen.select(
        *keys,
        order,
        (F.col("__n") - 1).alias("__pos"),
        F.when(F.col("__before") > 0, percent).alias("cpu_percent"),
    )
    sums = trailing(
        used,
        keys,
        "__pos",
        {"__s": F.sum("cpu_percent"), "__n": F.count("cpu_percent")},
        rows=buckets,
    )
    return sums.filter(F.col("cpu_percent").isNotNull()).select(
        *keys, order, "cpu_percent", int_div("__s", F.col("__n")).alias("cpu_usage")
    )


def every_nth(
    samples: DataFrame, *, n: int = 10, order: str = "ts_ms", keys: Sequence[str] = ("host",), **slab
) -> DataFrame:
    """Keep the first of every ``n`` samples of each key."""
    placed = dense_position(samples, keys, order, name="__pos", **slab)
    return placed.filter(F.col("__pos") % n == 0).drop("__pos")


def host_speed(inventory: DataFrame) -> DataFrame:
    return inventory.groupBy("host").agg(
        F.count(F.lit(1)).alias("cores"), F.sum("speed_hz").alias("speed_hz")
    )


def host_process_cpu_time(threads: DataFrame) -> DataFrame:
    """Total thread CPU time per worker process and sample."""
    return threads.groupBy("host", "ts_ms").agg(F.sum("cpu_ns").alias("cpu_ns"))


# --- cycles ----------------------------------------------------------------------
#
# A reading is accepted when it comes at least ``gap`` after the last accepted one.
# That is a chain through time, but a slab of time only needs to know the last
# acceptance before it. Which reading a slab leaves with depends on the entry alone,
# and entries can only differ inside the first ``gap`` of the slab, so each slab is
# summarised by a short step function. Step functions of neighbouring slabs compose to
# one of the same kind, so blocks of slabs are summarised as slabs are, and blocks of
# blocks, up to one block for a task; from there entries are handed down again.

#: Slabs, or blocks, in a block: two to the power of this.
_FAN_BITS = 6


def _next_index(ts: np.ndarray, gap: int) -> np.ndarray:
    return np.searchsorted(ts, ts + gap, side="left")


def _slab_steps(gap: int, slab_ms: int):
    def steps(pdf: pd.DataFrame) -> pd.DataFrame:
        rows = pdf.sort_values("ts_ms")
        ts, counter = rows["ts_ms"].to_numpy(), rows["cpu_ns"].to_numpy()
        n = len(ts)
        slab = int(rows["slab"].iloc[0])
        after = _next_index(ts, gap)
        jump = np.where(after < n, after, np.arange(n))
        while True:
            further = jump[jump]
            if np.array_equal(further, jump):
                break
            jump = further
        candidates = min(np.searchsorted(ts, slab * slab_ms + gap, side="left") + 1, n)
        leave = jump[:candidates]
        last_of_step = np.append(leave[1:] != leave[:-1], True)
        leave = leave[last_of_step]
        return pd.DataFrame(
            {
                "task_id": rows["task_id"].iloc[0],
                "slab": slab,
                "enter_until": ts[:candidates][last_of_step],
                "leave_ms": ts[leave],
                "leave_ns": counter[leave],
            }
        )

    return steps


def _after(steps: tuple, last_ms: int | None, last_ns: int, gap: int) -> tuple:
    """The last acceptance behind some steps, given the one before them."""
    until, ms, ns = steps
    at = 0 if last_ms is None else int(np.searchsorted(until, last_ms + gap, side="left"))
    return (int(ms[at]), int(ns[at])) if at < len(until) else (last_ms, last_ns)


def _then(first: tuple, second: tuple, gap: int, start: int) -> tuple:
    """Steps of two neighbouring stretches of time as one that begins at ``start``."""
    until, ms, ns = first
    at = np.searchsorted(second[0], ms + gap, side="left")
    goes = at < len(second[0])
    place = np.minimum(at, max(0, len(second[0]) - 1))
    if len(second[0]):
        ms, ns = np.where(goes, second[1][place], ms), np.where(goes, second[2][place], ns)
    later = second[0] > until[-1] if len(until) else np.ones(len(second[0]), dtype=bool)
    joined = [np.concatenate([a, b[later]]) for a, b in zip((until, ms, ns), second, strict=True)]
    # All entries lie before the start, so what follows the first step beyond its gap is never met.
    joined = [c[: np.searchsorted(joined[0], start + gap, side="left") + 1] for c in joined]
    last_of_step = np.append(joined[1][1:] != joined[1][:-1], True)
    return tuple(c[last_of_step] for c in joined)


def _stretches(pdf: pd.DataFrame):
    """Block number and steps of each block in a frame, in order."""
    ordered = pdf.sort_values(["slab", "enter_until"])
    for slab, rows in ordered.groupby("slab", sort=False):
        yield int(slab), tuple(rows[c].to_numpy() for c in ("enter_until", "leave_ms", "leave_ns"))


def _compose(gap: int, block_ms: int):
    """Steps of a block of blocks; ``block_ms`` is the length of the whole."""

    def compose(pdf: pd.DataFrame) -> pd.DataFrame:
        whole, parent = None, int(pdf["slab"].iloc[0]) >> _FAN_BITS
        for _, steps in _stretches(pdf):
            whole = steps if whole is None else _then(whole, steps, gap, parent * block_ms)
        until, ms, ns = whole
        return pd.DataFrame(
            {"task_id": pdf["task_id"].iloc[0], "slab": parent, "enter_until": until, "leave_ms": ms, "leave_ns": ns}
        )

    return compose


def _chain(gap: int):
    """Entry of each block of one parent, from the entry of the parent."""

    def chain(pdf: pd.DataFrame) -> pd.DataFrame:
        first = pdf["entry_ms"].iloc[0]
        last = (None, 0) if pd.isna(first) else (int(first), int(pdf["entry_ns"].iloc[0]))
        slabs, entries = [], []
        for slab, steps in _stretches(pdf):
            slabs.append(slab)
            entries.append(last)
            last = _after(steps, *last, gap)
        return pd.DataFrame(
            {
                "task_id": pdf["task_id"].iloc[0],
                "slab": slabs,
                "last_ms": pd.array([e[0] for e in entries], dtype="Int64"),
                "last_ns": [e[1] for e in entries],
            }
        )

    return chain


def _entries(steps: DataFrame, task: str, gap: int, slab_ms: int) -> DataFrame:
    """Last acceptance before each slab, over a tree of blocks of slabs.

    No task holds more than one block's steps: as many blocks as its fan, with at most a step for
    each millisecond of the gap.
    """
    steps = cut_lineage(steps)
    spans = steps.groupBy("task_id").agg(F.min("slab").alias("lo"), F.max("slab").alias("hi"))
    widths = [
        F.max(F.shiftright("hi", _FAN_BITS * k) - F.shiftright("lo", _FAN_BITS * k)).alias(f"w{k}") for k in range(1, 11)
    ]
    wide = spans.agg(*widths).first()
    levels = 1 + sum(bool(w) for w in wide)
    tree = [steps]
    for level in range(1, levels):
        parent = F.shiftright("slab", _FAN_BITS)
        block_ms = slab_ms << (_FAN_BITS * level)
        tree.append(cut_lineage(tree[-1].groupBy("task_id", parent).applyInPandas(_compose(gap, block_ms), steps.schema)))
    entries = None
    for blocks in reversed(tree):
        placed = blocks.withColumn("parent", F.shiftright("slab", _FAN_BITS))
        if entries is None:
            entry = [F.lit(None).cast("bigint").alias("entry_ms"), F.lit(0).cast("bigint").alias("entry_ns")]
            placed = placed.select("*", *entry)
        else:
            names = {"slab": "parent", "last_ms": "entry_ms", "last_ns": "entry_ns"}
            placed = placed.join(entries.withColumnsRenamed(names), ["task_id", "parent"])
        entries = placed.groupBy("task_id", "parent").applyInPandas(
            _chain(gap), f"{task}, slab bigint, last_ms bigint, last_ns bigint"
        )
    return entries


def _mark(gap: int):
    def mark(pdf: pd.DataFrame) -> pd.DataFrame:
        rows = pdf.sort_values("ts_ms")
        ts = rows["ts_ms"].to_numpy()
        after = _next_index(ts, gap)
        last = rows["last_ms"].iloc[0]
        at = 0 if pd.isna(last) else int(np.searchsorted(ts, int(last) + gap, side="left"))
        taken = []
        while at < len(ts):
            taken.append(at)
            at = int(after[at])
        counter = rows["cpu_ns"].to_numpy()[taken]
        return pd.DataFrame(
            {
                "task_id": rows["task_id"].iloc[0],
                "ts_ms": ts[taken],
                "cpu_ns": counter,
                "used_ns": np.diff(counter, prepend=rows["last_ns"].iloc[0]),
            }
        )

    return mark


def accepted_readings(
    readings: DataFrame, *, gap_ms: int = 1000, slab_ms: int = 3_600_000
) -> DataFrame:
    """Readings at least ``gap_ms`` apart, starting with the first of each task, and
    the CPU time used since the one accepted before.

    Readings of one millisecond are reduced to the first before the shuffle; the
    counter never falls, so that is the smallest.
    """
    thinned = (
        readings.groupBy("task_id", "ts_ms")
        .agg(F.min("cpu_ns").alias("cpu_ns"))
        .withColumn("slab", F.expr(f"ts_ms div {int(slab_ms)}"))
        # Said here, so that both uses below have one plan and share its shuffle.
        .filter(F.col("task_id").isNotNull() & F.col("slab").isNotNull())
    )
    task = f"task_id {thinned.schema['task_id'].dataType.simpleString()}"
    steps = thinned.groupBy("task_id", "slab").applyInPandas(
        _slab_steps(gap_ms, slab_ms),
        f"{task}, slab bigint, enter_until bigint, leave_ms bigint, leave_ns bigint",
    )
    entries = _entries(steps, task, gap_ms, slab_ms)
    return (
        thinned.join(entries, ["task_id", "slab"])
        .groupBy("task_id", "slab")
        .applyInPandas(
            _mark(gap_ms), f"{task}, ts_ms bigint, cpu_ns bigint, used_ns bigint"
        )
    )


def task_cycles(
    readings: DataFrame, *, speed_hz: int, cores: int, gap_ms: int = 1000, slab_ms: int = 3_600_000
) -> DataFrame:
    """CPU cycles each task used since its last accepted reading, truncated."""
    cycles_per_ns = speed_hz / cores / 1_000_000_000
    return accepted_readings(readings, gap_ms=gap_ms, slab_ms=slab_ms).select(
        "task_id", "ts_ms", (F.col("used_ns") * F.lit(cycles_per_ns)).cast("bigint").alias("cycles")
    )

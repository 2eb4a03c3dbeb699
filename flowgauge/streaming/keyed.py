"""Stateful stream operators: readings taken in the order of their time, and paced reports.

Readings of a key are held until the watermark has passed them and then handed on in
order, whatever order they arrived in. So a stream gives what the batch operators give on
the same rows, as long as no row is later than the watermark allows; rows that are later
are dropped and counted, see :func:`late_rows`.

All of these need the RocksDB state store, see :func:`keyed_state`.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from contextlib import contextmanager

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle, StreamingQuery

from flowgauge.functions.scalars import int_div, tuple_bytes

WATERMARK = "10 minutes"
#: Time whose rows are kept as one value of the state.
SLAB_MS = 10_000
#: Stands for a missing number. Such a reading is not one, it only moves the clock.
NOTHING = -(1 << 63)


@contextmanager
def keyed_state(spark: SparkSession):
    """Session setting the stateful processors need, put back afterwards."""
    name = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(name, None)
    spark.conf.set(
        name, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
    )
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(name)
        else:
            spark.conf.set(name, before)


def late_rows(query: StreamingQuery) -> int:
    """Rows that came after the watermark had passed them, over the progress the query still has."""
    return sum(op.numRowsDroppedByWatermark for p in query.recentProgress for op in p.stateOperators)


def closing_reading(readings: DataFrame, key: str, *, watermark: str = WATERMARK) -> DataFrame:
    """One reading without numbers, so late that all of ``readings`` are handed on when it is read.

    It ends a stream that will not go on; a live one is moved on by its next readings.
    """
    delay = int(pd.Timedelta(watermark) / pd.Timedelta("1ms"))
    ends = readings.agg(F.max(key).alias(key), (F.max("ts_ms") + 2 * delay + 1).alias("ts_ms"))
    empty = [F.lit(None).cast(f.dataType).alias(f.name) for f in readings.schema if f.name not in (key, "ts_ms")]
    return ends.where(F.col("ts_ms").isNotNull()).select("*", *empty).select(readings.columns)


class _InOrder(StatefulProcessor):
    """Holds rows of whole numbers, the time first, and hands them on by :meth:`take`.

    One timer per key stands at the earliest row held. Rows are kept in slabs of time, so a
    micro-batch rewrites only the slabs its rows fall into.
    """

    columns: tuple[str, ...]

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.held = handle.getMapState("held", "slab bigint", "rows binary")
        self.due = handle.getValueState("due", "ts_ms bigint")

    def take(self, key: tuple, rows: np.ndarray) -> Iterator[pd.DataFrame]:
        raise NotImplementedError

    def _rows(self, slab: int) -> np.ndarray:
        return np.frombuffer(bytes(self.held.getValue((slab,))[0]), dtype=np.int64).reshape(-1, len(self.columns))

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        for pdf in rows:
            block = pdf[list(self.columns)].to_numpy(dtype=np.int64)
            block = block[(block != NOTHING).all(axis=1)]
            slabs = block[:, 0] // SLAB_MS
            for slab in np.unique(slabs).tolist():
                own = block[slabs == slab]
                if self.held.containsKey((slab,)):
                    own = np.concatenate([self._rows(slab), own])
                self.held.updateValue((slab,), (np.ascontiguousarray(own).tobytes(),))
            if len(block):
                self._wake(int(block[:, 0].min()))
        return iter(())

    def _wake(self, ts: int) -> None:
        """A timer at the earliest row; event time is one millisecond ahead, so that 0 is not late."""
        before = self.due.get()[0] if self.due.exists() else None
        if before is None or ts < before:
            if before is not None:
                self.handle.deleteTimer(before + 1)
            self.handle.registerTimer(ts + 1)
            self.due.update((ts,))

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        passed = timerValues.getCurrentWatermarkInMs() - 1
        self.due.clear()
        slabs = sorted(k[0] for k in self.held.keys())
        for slab in slabs:
            block = self._rows(slab)
            ready = block[:, 0] <= passed
            if not ready.all():
                self._wake(int(block[~ready, 0].min()))
            if ready.any():
                if ready.all():
                    self.held.removeKey((slab,))
                else:
                    self.held.updateValue((slab,), (np.ascontiguousarray(block[~ready]).tobytes(),))
                block = block[ready]
                yield from self.take(key, block[np.lexsort(block.T[::-1])])
            if not ready.all():
                break

    def close(self) -> None:
        pass


def _timed(rows: DataFrame, key: str, columns: Sequence[str], watermark: str) -> DataFrame:
    """Key, whole numbers without NULL and the event time."""

    def whole(name: str) -> Column:
        return F.coalesce(F.col(name).cast("bigint"), F.lit(NOTHING)).alias(name)

    event = F.timestamp_millis(F.col("ts_ms") + 1).alias("event_time")
    return rows.select(key, *[whole(c) for c in columns], event).withWatermark("event_time", watermark)


# --- readings a second apart -------------------------------------------------------


class _Cycles(_InOrder):
    """Keeps the last accepted reading of a task."""

    columns = ("ts_ms", "cpu_ns")

    def __init__(self, gap_ms: int, cycles_per_ns: float):
        self.gap_ms = gap_ms
        self.cycles_per_ns = cycles_per_ns

    def init(self, handle: StatefulProcessorHandle) -> None:
        super().init(handle)
        self.last = handle.getValueState("last", "ts_ms bigint, cpu_ns bigint")

    def take(self, key: tuple, rows: np.ndarray) -> Iterator[pd.DataFrame]:
        ts, first = np.unique(rows[:, 0], return_index=True)
        counter = rows[first, 1]
        before_ts, before_ns = self.last.get() if self.last.exists() else (None, 0)
        at = 0 if before_ts is None else int(np.searchsorted(ts, before_ts + self.gap_ms))
        taken = []
        while at < len(ts):
            taken.append(at)
            at = int(np.searchsorted(ts, ts[at] + self.gap_ms))
        if taken:
            used = np.diff(np.concatenate([[before_ns], counter[taken]]))
            self.last.update((int(ts[taken[-1]]), int(counter[taken[-1]])))
            cycles = np.trunc(used * self.cycles_per_ns).astype(np.int64)
            yield pd.DataFrame({"task_id": key[0], "ts_ms": ts[taken], "cycles": cycles})


def load_stream(
    readings: DataFrame,
    *,
    speed_hz: int,
    cores: int,
    gap_ms: int = 1000,
    bucket_ms: int = 10_000,
    watermark: str = WATERMARK,
) -> DataFrame:
    """Cycles of each accepted reading with the bucket it belongs to.

    ``readings`` has ``task_id``, ``ts_ms`` (0 or more) and the cumulative ``cpu_ns``, in any order;
    one without a counter is no reading. The first reading of a task and each one at least
    ``gap_ms`` after the last accepted one count, in the order of time, as in
    :func:`flowgauge.operators.cpu.task_cycles`. Sums per bucket add up over micro-batches, see
    :func:`sum_buckets`.
    """
    task_type = readings.schema["task_id"].dataType.simpleString()
    return (
        _timed(readings, "task_id", _Cycles.columns, watermark)
        .groupBy("task_id")
        .transformWithStateInPandas(
            _Cycles(gap_ms, speed_hz / cores / 1_000_000_000),
            f"task_id {task_type}, ts_ms bigint, cycles bigint",
            "Append",
            "EventTime",
        )
        .withColumn("bucket_ms", F.expr(f"ts_ms div {int(bucket_ms)} * {int(bucket_ms)}"))
    )


def sum_buckets(cycles: DataFrame) -> DataFrame:
    return cycles.groupBy("task_id", "bucket_ms").agg(F.sum("cycles").alias("load"))


# --- CPU of a host -----------------------------------------------------------------


class _RollingCpu(_InOrder):
    """Keeps the last counter and the last few percentages of a host."""

    columns = ("ts_ms", "cpu_ns", "cores")

    def __init__(self, budget_ns: int, buckets: int):
        self.budget_ns = budget_ns
        self.buckets = buckets

    def init(self, handle: StatefulProcessorHandle) -> None:
        super().init(handle)
        self.counter = handle.getValueState("counter", "cpu_ns bigint")
        self.recent = handle.getListState("recent", "percent bigint")

    def take(self, key: tuple, rows: np.ndarray) -> Iterator[pd.DataFrame]:
        before = self.counter.get()[0] if self.counter.exists() else 0
        recent = [row[0] for row in self.recent.get()] if self.recent.exists() else []
        out = []
        for ts, cpu_ns, cores in rows.tolist():
            if before > 0:
                percent = (cpu_ns - before) * 100 // (self.budget_ns * cores)
                recent = [*recent, percent][-self.buckets :]
                out.append((key[0], ts, percent, sum(recent) // len(recent)))
            before = cpu_ns
        self.counter.update((before,))
        if recent:
            self.recent.put([(p,) for p in recent])
        if out:
            yield pd.DataFrame(out, columns=["host", "ts_ms", "cpu_percent", "cpu_usage"])


def cpu_stream(
    samples: DataFrame, *, bucket_seconds: int = 10, buckets: int = 6, watermark: str = WATERMARK
) -> DataFrame:
    """CPU percent per bucket and the whole-number mean of the last buckets, live.

    ``samples`` has one reading per host and bucket with ``ts_ms`` (0 or more), ``cpu_ns`` and
    ``cores``, in any order. Readings count in the order of time, as in
    :func:`flowgauge.operators.cpu.rolling_cpu`.
    """
    host_type = samples.schema["host"].dataType.simpleString()
    return (
        _timed(samples, "host", _RollingCpu.columns, watermark)
        .groupBy("host")
        .transformWithStateInPandas(
            _RollingCpu(bucket_seconds * 1_000_000_000, buckets),
            f"host {host_type}, ts_ms bigint, cpu_percent bigint, cpu_usage bigint",
            "Append",
            "EventTime",
        )
    )


# --- sizes, published at a pace ----------------------------------------------------


class _Sizes(StatefulProcessor):
    """Sums of a task's stream, published a while after the first change that was not."""

    def __init__(self, every_ms: int):
        self.every_ms = every_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.sums = handle.getValueState("sums", "bytes bigint, n bigint")
        self.pending = handle.getValueState("pending", "at bigint")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        total, n = self.sums.get() if self.sums.exists() else (0, 0)
        for pdf in rows:
            total, n = total + int(pdf["bytes"].sum()), n + int(pdf["n"].sum())
        self.sums.update((total, n))
        if not self.pending.exists():
            at = timerValues.getCurrentProcessingTimeInMs() + self.every_ms
            self.handle.registerTimer(at)
            self.pending.update((at,))
        return iter(())

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        self.pending.clear()
        total, n = self.sums.get()
        yield pd.DataFrame({"task_id": [key[0]], "stream": [key[1]], "tuplesizesum": [total], "tuplesizecount": [n]})

    def close(self) -> None:
        pass


def _partial_sizes(chunks: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for pdf in chunks:
        sums = pdf.groupby(["task_id", "stream"], dropna=False)["bytes"].agg(["sum", "count"]).reset_index()
        yield sums.rename(columns={"sum": "bytes", "count": "n"})


def size_reports(tuples: DataFrame, value_columns: Sequence[str], *, every: str = "1 minute") -> DataFrame:
    """Cumulative bytes and count per task and input stream, published at most once in ``every``.

    However often the query is triggered, a change is published by a timer of its key that long
    after it came, with all that came meanwhile. Run it in update mode with a processing-time
    trigger; timers fire while no data comes. Each chunk of rows is summed before the shuffle.
    """
    task_type = tuples.schema["task_id"].dataType.simpleString()
    sized = tuples.select("task_id", "stream", tuple_bytes(value_columns).cast("bigint").alias("bytes"))
    return (
        sized.mapInPandas(_partial_sizes, f"task_id {task_type}, stream string, bytes bigint, n bigint")
        .groupBy("task_id", "stream")
        .transformWithStateInPandas(
            _Sizes(int(pd.Timedelta(every) / pd.Timedelta("1ms"))),
            f"task_id {task_type}, stream string, tuplesizesum bigint, tuplesizecount bigint",
            "Update",
            "ProcessingTime",
        )
        .withColumn("tuple_size", int_div("tuplesizesum", F.col("tuplesizecount")))
    )

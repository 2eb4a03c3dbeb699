"""Per-second series from raw latency, throughput and report logs.

Seconds are anchored at the first event and right-closed: an event exactly 1000 ms
after the start of a second still belongs to it. Raw rows are only ever reduced by
a hash aggregate with map-side partials, so a hot second or file costs nothing
extra; everything ordered works on one row per second, in slabs.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from flowgauge.functions.scalars import decimal_comma, int_div, ns_to_ms
from flowgauge.operators.ordered import integer_range, range_position, running, trailing
from flowgauge.operators.rollup import scope

# The column titles of a plot file.
PLOT_HEADER = "time;data driver;data driver_avg;spout;spout_avg;latency;latency_avg;"
PLOT_HEADER_EMITTED = (
    "time;data driver;data driver_avg;spout;spout_avg;latency;latency_avg;"
    "emit_throughput;emit_throughput_avg"
)


def _ends(log: DataFrame, ts: str) -> DataFrame:
    """First and last time of each log, in one pass over one column."""
    return log.groupBy(*scope(log)).agg(F.min(ts).alias("__begin"), F.max(ts).alias("__end"))


def _second_of(ts: Column, begin: Column) -> Column:
    index = int_div(ts - begin + 999, 1000) - 1
    return F.when(index < 0, F.lit(0).cast("bigint")).otherwise(index)


def anchored_second(df: DataFrame, ts: str = "ts_ms") -> DataFrame:
    """Add ``second``: index of the anchored second each row falls into."""
    keys, ends = scope(df), _ends(df, ts)
    if keys:
        dated = df.join(ends, keys)
        begin = F.col("__begin")
    else:
        dated = df
        begin = ends.select(F.struct("__begin", "__end")).scalar()["__begin"]
    return dated.select(*df.columns, _second_of(F.col(ts), begin).alias("second"))


def _join_seconds(seconds: DataFrame, series: DataFrame, fill: int | None) -> DataFrame:
    keys = [*scope(series), "second"]
    filled = seconds.join(series, keys, "left")
    if fill is None:
        return filled
    return filled.fillna(fill, [c for c in series.columns if c not in keys])


def fill_gaps(series: DataFrame, fill: int | None = None) -> DataFrame:
    """Add the missing seconds from 0 to the last one, with NULL or ``fill``."""
    bounds = series.groupBy(*scope(series)).agg(
        F.min(F.lit(0).cast("bigint")).alias("lo"), F.max("second").cast("bigint").alias("hi")
    )
    return _join_seconds(integer_range(bounds, "lo", "hi", "second"), series, fill)


def _every_second(log: DataFrame, ts: str = "ts_ms", *, drop_last: bool = False) -> DataFrame:
    """All seconds of a log, from its ends alone, so the sums are not computed twice."""
    last = _second_of(F.col("__end"), F.col("__begin")) - (1 if drop_last else 0)
    bounds = _ends(log, ts).select(
        *scope(log), F.lit(0).cast("bigint").alias("lo"), last.alias("hi")
    )
    return integer_range(bounds, "lo", "hi", "second")


def latency_per_second(log: DataFrame) -> DataFrame:
    """Whole-number mean latency in ms per second; NULL where no event fell."""
    keys = [*scope(log), "second"]
    sums = (
        anchored_second(log)
        .groupBy(*keys)
        .agg(F.sum(ns_to_ms("latency_ns")).alias("s"), F.count(F.lit(1)).alias("n"))
    )
    means = sums.select(*keys, int_div("s", F.col("n")).alias("latency_ms"))
    return _join_seconds(_every_second(log), means, None)


def throughput_per_second(log: DataFrame) -> DataFrame:
    """Number of events per second; NULL where no event fell."""
    counts = anchored_second(log).groupBy(*scope(log), "second").agg(F.count(F.lit(1)).alias("n"))
    return _join_seconds(_every_second(log), counts, None)


def merged_throughput_per_second(log: DataFrame) -> DataFrame:
    """Sum of partial counts per second, 0 in gaps, without the unfinished last second."""
    sums = anchored_second(log).groupBy(*scope(log), "second").agg(F.sum("cnt").alias("n"))
    return _join_seconds(_every_second(log, drop_last=True), sums, 0)


def running_second(reports: DataFrame) -> DataFrame:
    """Add ``current_second``: the largest second seen so far, in arrival order."""
    seen = running(reports, scope(reports), "row_id", {"current_second": ("max", "second")})
    return seen.withColumn("current_second", F.greatest("current_second", F.lit(-1)))


def reports_per_second(reports: DataFrame) -> DataFrame:
    """Reports per current second; late rows count in the current one, the last is open."""
    keys = scope(reports)
    counts = (
        running_second(reports)
        .filter(F.col("current_second") > -1)
        .groupBy(*keys, F.col("current_second").alias("second"))
        .agg(F.count(F.lit(1)).alias("n"))
    )
    if keys:
        ends = reports.groupBy(*keys).agg(F.max("second").alias("__end"))
        return counts.join(ends, keys).filter("second < __end").drop("__end")
    return counts.filter(F.col("second") < reports.agg(F.max("second")).scalar())


def peak_second(per_second: DataFrame) -> DataFrame:
    """Second with the most reports, the earliest on ties."""
    keys = scope(per_second)
    best = F.max(F.struct(F.col("n"), (-F.col("second")).alias("earliest")))
    return (
        per_second.groupBy(*keys)
        .agg(best.alias("b"))
        .filter(F.col("b").isNotNull())
        .select(*keys, (-F.col("b.earliest")).alias("second"), F.col("b.n").alias("n"))
    )


def union_logs(*logs: DataFrame) -> DataFrame:
    """All rows of all partial logs, duplicates kept."""
    merged = logs[0]
    for log in logs[1:]:
        merged = merged.unionByName(log)
    return merged


def merge_logs(*logs: DataFrame, tie: Sequence[str] = ("file", "pos")) -> DataFrame:
    """One log in time order with each row's ``position``; equal times keep file order, then line order.

    The result's partitions are ranges of the order and sorted, see
    :func:`flowgauge.operators.ordered.range_position`.
    """
    merged = union_logs(*logs)
    rest = [c for c in merged.columns if c not in ("ts_ms", *tie)]
    return range_position(merged, ["ts_ms", *[c for c in tie if c in merged.columns], *rest], name="position")


def zip_by_position(first: DataFrame, *others: DataFrame, on: str = "second") -> DataFrame:
    """Align series by position; the first one sets the length."""
    keys = [*scope(first, *others), on]
    zipped = first
    for other in others:
        zipped = zipped.join(other, keys, "left")
    return zipped


def moving_average(
    df: DataFrame,
    columns: Sequence[str],
    *,
    n: int = 10,
    scale: dict[str, int] | None = None,
    pos: str = "second",
    width: int = 1 << 16,
) -> DataFrame:
    """Add ``<column>_avg``: the value itself for the first ``n`` positions, then
    the mean of the last ``n``. A missing value counts as 0; scaled columns are
    averaged after scaling."""
    scale = scale or {}
    keys = scope(df)
    at = {c: F.coalesce(F.col(c), F.lit(0)).cast("double") * scale.get(c, 1) for c in columns}
    means = trailing(
        df, keys, pos, {f"{c}_avg": F.avg(value) for c, value in at.items()}, rows=n, width=width
    )
    return means.withColumns(
        {
            f"{c}_avg": F.when(F.col(pos) < n, value).otherwise(F.col(f"{c}_avg"))
            for c, value in at.items()
        }
    )


def plot_series(
    data_driver: DataFrame,
    throughput: DataFrame,
    latency: DataFrame,
    *,
    k: int,
    emitted: DataFrame | None = None,
) -> DataFrame:
    """Zip the per-second series and smooth each.

    Inputs are ``(second, n)`` for the driver, completed and emitted throughput, and
    ``(second, latency_ms)``.
    """
    keys = [*scope(data_driver), "second"]
    parts = [
        data_driver.select(*keys, F.col("n").alias("data_driver")),
        throughput.select(*keys, F.col("n").alias("spout")),
        latency.select(*keys, F.col("latency_ms").alias("latency")),
    ]
    columns = ["data_driver", "spout", "latency"]
    if emitted is not None:
        parts.append(emitted.select(*keys, F.col("n").alias("emitted")))
        columns.append("emitted")
    return moving_average(zip_by_position(*parts), columns, scale={"data_driver": k})


def format_plot_rows(df: DataFrame, *, header: bool = True) -> DataFrame:
    """Semicolon-separated text with decimal commas, in time order.

    A second without completed tuples gives a short row: time and driver columns.
    """
    with_emitted = "emitted" in df.columns
    always = ["data_driver", "data_driver_avg"]
    optional = ["spout", "spout_avg", "latency", "latency_avg"]
    if with_emitted:
        optional += ["emitted", "emitted_avg"]

    def text(columns):
        numbers = [F.col(c).cast("double").cast("string") for c in columns]
        return F.concat_ws(";", F.col("second").cast("string"), *numbers)

    body = df.select(
        "second",
        decimal_comma(
            F.when(F.col("spout").isNull(), text(always)).otherwise(text(always + optional))
        ).alias("value"),
    )
    if header:
        title = PLOT_HEADER_EMITTED if with_emitted else PLOT_HEADER
        head = df.sparkSession.range(1).select(
            F.lit(-1).cast("bigint").alias("second"), F.lit(title).alias("value")
        )
        body = body.unionByName(head)
    return body.orderBy("second").select("value")


def forecast_window(
    counts: DataFrame, *, n: int = 10, horizon: int = 1, width: int = 1 << 16
) -> DataFrame:
    """Training rows for a traffic forecast: the last ``n`` per-minute counts of each
    spout, oldest first, with the count ``horizon`` minutes later as the label.

    ``counts`` has ``spout``, ``ts_us`` (microseconds) and ``cnt``. A minute without
    tuples is a 0 in the window.
    """
    keys = [*scope(counts), "spout"]
    per_minute = counts.groupBy(*keys, int_div("ts_us", 60_000_000).alias("minute")).agg(
        F.sum("cnt").alias("cnt")
    )
    ends = per_minute.groupBy(*keys).agg(F.min("minute").alias("lo"), F.max("minute").alias("hi"))
    starts = ends.select(*keys, F.col("lo").alias("__begin"))
    dense = (
        integer_range(ends, "lo", "hi", "minute")
        .join(per_minute, [*keys, "minute"], "left")
        .join(starts, keys)
        .select(
            *keys,
            "minute",
            (F.col("minute") - F.col("__begin")).alias("pos"),
            F.coalesce("cnt", F.lit(0)).alias("cnt"),
        )
    )
    span = n + horizon
    windows = trailing(dense, keys, "pos", {"w": F.collect_list("cnt")}, rows=span, width=width)
    return windows.filter(F.size("w") == span).select(
        *keys,
        (F.col("minute") - horizon).alias("minute"),
        F.slice("w", 1, n).alias("features"),
        F.element_at("w", -1).alias("label"),
    )

"""Column expressions. All stay inside Catalyst; none is a Python UDF."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F


def _col(x: Column | str) -> Column:
    return F.col(x) if isinstance(x, str) else x


def strip_decoration(line: Column | str) -> Column:
    """Text before the first ``*``, else before the first ``#``, else NULL."""
    c = _col(line)
    return F.when(F.instr(c, "*") > 0, F.substring_index(c, "*", 1)).when(
        F.instr(c, "#") > 0, F.substring_index(c, "#", 1)
    )


def pig_latin(word: Column | str) -> Column:
    """Vowel-first words get ``ay``; others move the first letter to the end first."""
    c = _col(word)
    first = F.substring(c, 1, 1)
    return F.when(first.isin("a", "e", "i", "o", "u"), F.concat(c, F.lit("ay"))).when(
        F.length(c) > 0, F.concat(F.substring(c, F.lit(2), F.length(c)), first, F.lit("ay"))
    )


def calendar_features(ts: Column | str) -> list[Column]:
    """Day of week, month, day, hour and minute, each scaled towards [0, 1]."""
    c = _col(ts)
    return [
        ((F.dayofweek(c) - 1) / 6.0).alias("day_of_week"),
        ((F.month(c) - 1) / 12.0).alias("month"),
        (F.dayofmonth(c) / 30.0).alias("day"),
        (F.hour(c) / 23.0).alias("hour"),
        (F.minute(c) / 59.0).alias("minute"),
    ]


def int_div(a: Column | str, b: Column | int) -> Column:
    """Whole-number division that truncates; NULL when the divisor is 0."""
    divisor = F.lit(b) if isinstance(b, int) else b
    return F.call_function("div", _col(a), F.nullif(divisor, F.lit(0)))


def ns_to_ms(ns: Column | str) -> Column:
    return int_div(ns, 1_000_000)


def decimal_comma(text: Column | str) -> Column:
    return F.replace(_col(text), F.lit("."), F.lit(","))


def csv_field(line: Column | str, index: int, dtype: str = "bigint", *, strict: bool = True) -> Column:
    """0-based comma field; a bad number raises, or gives NULL when not strict."""
    field = F.split_part(_col(line), F.lit(","), F.lit(index + 1))
    return field.cast(dtype) if strict else field.try_cast(dtype)


def task_range(text: Column | str) -> Column:
    """``5`` or ``6-9`` as an array of ids; any other shape raises."""
    bare = F.regexp_replace(_col(text), " ", "")
    parts = F.split(bare, "-")
    low = parts[0].cast("int")
    high = F.coalesce(F.get(parts, F.lit(1)), parts[0]).cast("int")
    bad = F.raise_error(F.concat(F.lit("bad task range: "), bare)).cast("array<int>")
    # A reversed range names no task: sequence() would count down.
    ids = F.when(low <= high, F.sequence(low, high)).otherwise(F.array().cast("array<int>"))
    return F.when(F.size(parts) <= 2, ids).otherwise(bad)


def array_text(values: Column | str) -> Column:
    return F.array_join(_col(values).cast("array<string>"), "  ")


def normalise(x: Column | str, top: Column | str) -> Column:
    """``x / top`` with a zero top read as 1."""
    divisor = _col(top)
    return _col(x).cast("double") / F.when(divisor == 0, F.lit(1.0)).otherwise(divisor)


def tuple_bytes(columns: Sequence[Column | str]) -> Column:
    """Size of a row as the byte length of its JSON text."""
    return F.octet_length(F.to_json(F.struct(*[_col(c) for c in columns])))


def max_traffic_per_second(
    max_traffic: Column | float,
    factor: Column | int,
    current_max: Column | float | None = None,
    current_factor: Column | int | None = None,
) -> Column:
    """Assumed peak in tuples/s: ``max_traffic * factor / 60``.

    A factor that is not positive keeps the current factor. A peak that is not
    positive keeps the current rate, which was scaled by the factor of its day.
    """

    def lit(x):
        return x if isinstance(x, Column) else F.lit(x)

    peak, scale = lit(max_traffic).cast("double"), lit(factor)
    used = scale if current_factor is None else F.when(scale > 0, scale).otherwise(lit(current_factor))
    rate = peak * used / 60.0
    if current_max is None:
        return rate
    return F.when(peak > 0, rate).otherwise(lit(current_max).cast("double"))


def mhz_to_hz(mhz: Column | str) -> Column:
    """Whole MHz times 1024 * 1024."""
    return _col(mhz).cast("float").cast("bigint") * 1_048_576


def tanh_net(x: Sequence[Column], w: Column | str, hidden: int) -> Column:
    """Forward pass of a small fully connected tanh network with one output.

    ``w`` is a flat array: the output row first (one weight per hidden neuron, bias
    last), then one row per hidden neuron (one weight per input, bias last).
    """
    weights = _col(w)
    total = weights[hidden]
    step = len(x) + 1
    for j in range(hidden):
        base = hidden + 1 + j * step
        inner = weights[base + len(x)]
        for i, xi in enumerate(x):
            inner = inner + weights[base + i] * xi
        total = total + weights[j] * F.tanh(inner)
    return F.tanh(total)

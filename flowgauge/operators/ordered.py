"""Ordered scans that never put a whole key into one task.

A plain ``Window.partitionBy(key).orderBy(pos)`` sorts all rows of a key in one
task, which fails when one key holds a third of the table. Here the order column
is cut into slabs of fixed width. Rows are windowed inside ``(key, slab)``, each
slab is reduced to one summary row, and the running value of the summaries is
joined back as a carry. A slab holds at most ``width`` distinct order values, so
the sort per task is bounded whatever the key holds, and only the summaries (one
row per slab) are ever ordered across slabs.

The order column must be an integer type.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from flowgauge.runtime import cut_lineage

SLAB_WIDTH = 1 << 20
_SLAB = "__slab"

_RUNNING = {"sum": F.sum, "max": F.max, "count": F.count}
_MERGE = {
    "sum": lambda carry, here: F.coalesce(carry, F.lit(0)) + here,
    "count": lambda carry, here: F.coalesce(carry, F.lit(0)) + here,
    "max": lambda carry, here: F.greatest(carry, here),
}


def _with_slab(df: DataFrame, order: str, width: int) -> DataFrame:
    return df.withColumn(_SLAB, F.expr(f"`{order}` div {int(width)}"))


def scan(
    df: DataFrame,
    keys: Sequence[str],
    order: str,
    *,
    totals: dict[str, tuple[str, str]] | None = None,
    lags: dict[str, str] | None = None,
    tie: Sequence[str] = (),
    width: int = SLAB_WIDTH,
) -> DataFrame:
    """Running aggregates and values one row back, with one shuffle of the rows.

    ``totals`` maps a new column to ``(function, column)``, function being ``sum``,
    ``max`` or ``count``, over the first row of the key up to the current one.
    ``lags`` maps a new column to the column it repeats from one row earlier. Rows
    that tie on ``order`` are taken one by one, in the order of ``tie`` and then of the
    repeated columns, inside a slab and across slabs alike. NULL is a key like others.
    """
    keys, totals, lags = list(keys), totals or {}, lags or {}
    rows = _with_slab(df, order, width)
    by = [order, *tie, *dict.fromkeys(c for c in lags.values() if c not in (order, *tie))]
    place = F.struct(*by) if len(by) > 1 else F.col(order)
    # One max_by per column keeps number columns in hash aggregation.
    summary = rows.groupBy(*keys, _SLAB).agg(
        *[_RUNNING[fn](col).alias(f"__carry_{name}") for name, (fn, col) in totals.items()],
        *[F.max_by(col, place).alias(f"__carry_{name}") for name, col in lags.items()],
    )
    across = W.partitionBy(*keys).orderBy(_SLAB)
    before = across.rowsBetween(W.unboundedPreceding, -1)
    carried = {
        **{
            name: (F.max if fn == "max" else F.sum)(f"__carry_{name}").over(before)
            for name, (fn, _) in totals.items()
        },
        **{name: F.lag(f"__carry_{name}").over(across) for name in lags},
    }
    carry = summary.select(
        *keys, _SLAB, *[value.alias(f"__carry_{name}") for name, value in carried.items()]
    )
    inside = W.partitionBy(*keys, _SLAB).orderBy(*by)
    so_far = inside.rowsBetween(W.unboundedPreceding, 0)
    local = rows.select(
        "*",
        F.row_number().over(inside).alias("__row"),
        *[_RUNNING[fn](col).over(so_far).alias(f"__here_{name}") for name, (fn, col) in totals.items()],
        *[F.lag(col).over(inside).alias(f"__here_{name}") for name, col in lags.items()],
    )
    first = F.col("__row") == 1

    def merged(name: str) -> Column:
        then, here = F.col(f"__carry_{name}"), F.col(f"__here_{name}")
        if name in lags:
            return F.when(first, then).otherwise(here)
        return _MERGE[totals[name][0]](then, here)

    renamed = carry.withColumnsRenamed({k: f"__of_{k}" for k in (*keys, _SLAB)})
    same = [F.col(k).eqNullSafe(F.col(f"__of_{k}")) for k in (*keys, _SLAB)]
    return local.join(renamed, same, "left").select(
        *df.columns, *[merged(name).alias(name) for name in carried]
    )


def running(
    df: DataFrame,
    keys: Sequence[str],
    order: str,
    outputs: dict[str, tuple[str, str]],
    *,
    width: int = SLAB_WIDTH,
) -> DataFrame:
    """Running aggregates only, see :func:`scan`."""
    return scan(df, keys, order, totals=outputs, width=width)


def previous(
    df: DataFrame,
    keys: Sequence[str],
    order: str,
    outputs: dict[str, str],
    *,
    width: int = SLAB_WIDTH,
) -> DataFrame:
    """Values one row back only, see :func:`scan`."""
    return scan(df, keys, order, lags=outputs, width=width)


def dense_position(
    df: DataFrame,
    keys: Sequence[str],
    order: str,
    *,
    name: str = "pos",
    tie: Sequence[str] = (),
    width: int = SLAB_WIDTH,
) -> DataFrame:
    """0-based row number of each row inside its key, ties in the order of ``tie``."""
    counted = scan(df, keys, order, totals={name: ("count", order)}, tie=tie, width=width)
    return counted.withColumn(name, F.col(name) - 1)


def range_position(df: DataFrame, by: Sequence[str], *, name: str = "pos") -> DataFrame:
    """``df`` in the order of ``by`` (NULL first) with the 0-based position of each row in it.

    Rows are dealt by ranges once and sorted inside them; each partition numbers its rows and
    adds the counts of the partitions before it, one row each. So partitions are of about
    equal size however the values bunch, as long as ``by`` tells rows apart; rows equal in all
    of it lie in one partition. The rows are stored once, since another job would cut the
    ranges elsewhere.
    """
    placed = cut_lineage(
        df.repartitionByRange(*by).sortWithinPartitions(*by).withColumn("__place", F.monotonically_increasing_id())
    )
    part = F.shiftrightunsigned("__place", 33)
    sizes = placed.groupBy(part.alias("__part")).agg(F.count(F.lit(1)).alias("__n"))
    before = F.sum("__n").over(W.orderBy("__part").rowsBetween(W.unboundedPreceding, -1))
    offsets = sizes.select("__part", F.coalesce(before, F.lit(0)).alias("__before"))
    inside = F.col("__place").bitwiseAND(F.lit((1 << 33) - 1))
    # One row per partition, so the rows stay where they are and in their order.
    return placed.join(F.broadcast(offsets), part == F.col("__part")).select(
        *df.columns, (F.col("__before") + inside).alias(name)
    )


def trailing(
    df: DataFrame,
    keys: Sequence[str],
    pos: str,
    outputs: dict[str, Column],
    *,
    rows: int,
    width: int = SLAB_WIDTH,
) -> DataFrame:
    """Aggregates over the current row and the ``rows - 1`` rows before it.

    ``pos`` must be the dense 0-based position inside the key. The last
    ``rows - 1`` positions of a slab are copied into the next one, so every frame
    is complete inside its slab; the copies are dropped again.
    """
    keys = list(keys)
    back = rows - 1
    if back >= width:
        raise ValueError("the frame must be shorter than a slab")
    own = F.expr(f"`{pos}` div {int(width)}")
    near_end = (F.col(pos) % width) >= (width - back)
    copied = df.withColumn(
        _SLAB, F.explode(F.when(near_end, F.array(own, own + 1)).otherwise(F.array(own)))
    )
    frame = W.partitionBy(*keys, _SLAB).orderBy(pos).rowsBetween(-back, 0)
    return (
        copied.select("*", *[expr.over(frame).alias(name) for name, expr in outputs.items()])
        .filter(F.col(_SLAB) == own)
        .drop(_SLAB)
    )


def integer_range(bounds: DataFrame, low: str, high: str, name: str, *, chunk: int = 4096) -> DataFrame:
    """All integers from ``low`` to ``high`` for each row, built in chunks.

    Chunk starts are spread over the cluster before they are opened, so no row
    ever holds the whole range as one array.
    """
    keep = [c for c in bounds.columns if c not in (low, high)]
    starts = bounds.filter(F.col(low) <= F.col(high)).select(
        *keep,
        F.col(high).alias("__high"),
        F.explode(F.sequence(F.col(low), F.col(high), F.lit(chunk).cast("bigint"))).alias("__start"),
    )
    # By the row and the chunk: all ranges that begin at one number would share a task otherwise.
    return starts.repartition(*keep, "__start").select(
        *keep,
        F.explode(
            F.sequence(F.col("__start"), F.least(F.col("__start") + chunk - 1, F.col("__high")))
        ).alias(name),
    )

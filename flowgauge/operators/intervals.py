"""Joins of whole numbers with the ranges that hold them, by pieces of the ranges.

A range is cut into dyadic pieces: blocks of 2^k numbers whose first is a multiple of 2^k.
There are at most two of each size, so a range of ten million numbers has a few dozen. A
number lies in one block of each size, so containment becomes an equi join on size and block.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def dyadic_pieces(low: str, high: str) -> Column:
    """Array of ``(level, block)``: blocks of 2^level numbers that together are ``low`` to ``high``.

    Empty where the range is. Walking from the smallest size up, the part not covered yet is
    [ceil(low / 2^k), floor((high + 1) / 2^k)); an odd number at either end of it is a piece.
    """
    lo, hi = f"cast(`{low}` as bigint)", f"cast(`{high}` as bigint)"
    left, right = f"shiftright({lo} + shiftleft(1L, k) - 1, k)", f"shiftright({hi} + 1, k)"
    pieces = f"""transform(sequence(0, cast(log2({hi} - {lo} + 1) as int) + 1), k -> array(
        struct(k as level, {left} as block, {left} < {right} and {left} & 1 = 1 as here),
        struct(k as level, {right} - 1 as block, {left} + ({left} & 1) < {right} and {right} & 1 = 1 as here)))"""
    return F.when(F.expr(f"{lo} <= {hi}"), F.expr(f"filter(flatten({pieces}), p -> p.here)"))


def within(points: DataFrame, ranges: DataFrame, keys: Sequence[str], point: str, low: str, high: str) -> DataFrame:
    """``points`` with the other columns of each of ``ranges`` that holds them, both ends included.

    A point in several ranges comes once for each. NULL points and ends match nothing, as does a
    range that ends before it starts. ``points`` are repeated once for each size of piece that
    occurs, at most 63; hand over distinct ones where rows repeat.
    """
    keys = list(keys)
    cut = ranges.select("*", F.explode(dyadic_pieces(low, high)).alias("__piece"))
    cut = cut.select(*ranges.columns, F.col("__piece.level").alias("__level"), F.col("__piece.block").alias("__block"))
    levels = sorted(r[0] for r in cut.select("__level").distinct().collect())
    sizes = F.explode(F.array(*map(F.lit, levels)).cast("array<int>")).alias("__level")
    probes = points.select("*", sizes).withColumn("__block", F.expr(f"shiftright(cast(`{point}` as bigint), __level)"))
    return probes.join(cut, [*keys, "__level", "__block"]).drop("__level", "__block")

"""Mixing sources to target weights by systematic sampling.

DataFrame functions only; nothing runs in Python on the executors.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from flowgauge.llm.common import SPACE
from flowgauge.runtime import cut_lineage

#: Cells of one size class, so that a class with a third of all rows is still dealt out.
SPREAD = 64


def word_count(text: Column) -> Column:
    """Number of words, runs of characters other than ASCII white space; 0 for NULL."""
    return F.coalesce(F.regexp_count(text, F.lit("[^\\x20\\x09-\\x0D]+")), F.lit(0)).cast("long")


def _size_class(size: str) -> Column:
    """Sizes below 64 each for itself, larger ones in sixteen steps to a doubling."""
    return F.expr(
        f"CASE WHEN {size} < 64 THEN {size} ELSE "
        f"64 + 16 * (length(bin({size})) - 7) + (shiftright({size}, length(bin({size})) - 5) - 16) END"
    ).cast("long")


def _unit(*parts: Column) -> Column:
    """A fixed number in [0, 1) drawn from the text of ``parts``."""
    return F.conv(F.substring(F.md5(F.concat(*parts).cast("binary")), 1, 8), 16, 10).cast("long") / F.lit(4294967296.0)


def source_targets(
    sizes: DataFrame, weights: Sequence[float] = (5, 2, 1), share: float = 1.5, most: float = 2.0
) -> DataFrame:
    """Adds ``__target`` to rows ``(__null, __src, __size)``, one per source.

    Sources in the order of their code points, NULL last, weigh as ``weights`` says,
    over and over, and share ``share`` times all sizes. A target stops at ``most`` times
    the source's own size and what it leaves is shared again by weight, until none is
    above. Each pass over the sources gives two sums; the driver sees nothing else.

    The place of a source comes from a range partition: rows are numbered within it
    and the counts of earlier partitions are added, so no task sorts all sources.
    """
    dealt = cut_lineage(
        sizes.repartitionByRange("__null", "__src").select("__null", "__src", "__size", F.spark_partition_id().alias("__part"))
    )
    parts = dealt.groupBy("__part").agg(F.count("*").alias("__n"))
    earlier = parts.select(
        "__part", (F.sum("__n").over(W.orderBy("__part")) - F.col("__n")).alias("__before")
    )  # one row per partition of the sources
    place = F.row_number().over(W.partitionBy("__part").orderBy("__null", "__src")) + F.col("__before") - 1
    steps = F.array(*[F.lit(float(w)) for w in weights])
    ranked = cut_lineage(
        dealt.join(earlier, "__part").select(
            "__null", "__src", "__size",
            F.get(steps, F.pmod(place, F.lit(len(weights))).cast("int")).alias("__weight"),
        )
    )
    total = ranked.agg(F.sum("__size")).first()[0] or 0
    level = None
    while True:
        full = F.lit(False) if level is None else F.col("__weight") * F.lit(level) > F.lit(most) * F.col("__size")
        taken, weight = ranked.agg(
            F.sum(F.when(full, F.col("__size")).otherwise(0)), F.sum(F.when(full, F.lit(0.0)).otherwise(F.col("__weight")))
        ).first()
        left = share * total - most * (taken or 0)
        new = left / weight if weight else level or 0.0
        if new == level or not weight:
            break
        level = new
    return ranked.withColumn(
        "__target", F.least(F.col("__weight") * F.lit(float(level or 0.0)), F.lit(most) * F.col("__size"))
    )


def mix_sources(
    docs: DataFrame,
    id_col: str = "doc_id",
    source_col: str = "source",
    text_col: str = "text",
    *,
    weights: Sequence[float] = (5, 2, 1),
    share: float = 1.5,
    most: float = 2.0,
    seed: int = 42,
) -> DataFrame:
    """``docs`` with ``size``, ``source_size``, ``target`` and ``copies``, the times the mix takes a row.

    Every row of a source expects ``target / source_size`` copies. The expected copies are
    summed up along the source, one random offset per source is added, and a row is taken
    once for each whole number its stretch crosses. Rows are summed in the order of their
    size, so what is taken stays within about one document of the target.

    The order is (size class, a spread drawn from the id, size, id). A window never holds
    more than one such cell; earlier cells come from a table of counts, which has a fixed
    number of rows per source, so a source with a third of all rows is dealt out.

    NULL texts have size 0; NULL is a source of its own, last in order; NULL ids and ties
    are taken one by one in any order, with the same counts. Extra columns pass through.
    """
    key = ["__null", "__src", "__class", "__cell"]
    doc = F.coalesce(F.col(id_col).cast("string"), F.lit(""))
    rows = (
        docs.withColumn("__size", word_count(F.col(text_col)))
        .withColumn("__null", F.col(source_col).isNull())
        .withColumn("__src", F.coalesce(F.col(source_col).cast("string"), F.lit("")))
        .withColumn("__class", _size_class("__size"))
        .withColumn("__cell", F.floor(_unit(doc) * SPREAD).cast("long"))
    )
    cells = cut_lineage(rows.groupBy(*key).agg(F.count("*").alias("__n"), F.sum("__size").alias("__words")))
    sizes = cells.groupBy("__null", "__src").agg(F.sum("__words").alias("__size"))
    targets = source_targets(sizes, weights, share, most).select(
        "__null", "__src", F.col("__size").alias("__source_size"), "__target"
    )
    along = W.partitionBy("__null", "__src").orderBy("__class", "__cell")
    before = cells.select(*key, (F.sum("__n").over(along) - F.col("__n")).alias("__before")).join(
        targets, ["__null", "__src"]
    )
    rate = F.when(F.col("__source_size") > 0, F.col("__target") / F.col("__source_size")).otherwise(F.lit(0.0))
    offset = _unit(F.lit(f"{seed}|"), F.col("__null").cast("string"), F.lit("|"), F.col("__src"))
    place = F.row_number().over(W.partitionBy(*key).orderBy("__size", id_col)) + F.col("__before")
    crossed = F.floor(F.col("__place") * F.col("__rate") + F.col("__offset")) - F.floor(
        (F.col("__place") - 1) * F.col("__rate") + F.col("__offset")
    )
    return (
        rows.join(before.withColumn("__rate", rate).withColumn("__offset", offset), key)
        .withColumn("__place", place)
        .select(
            *[F.col(c) for c in docs.columns],
            F.col("__size").alias("size"),
            F.col("__source_size").alias("source_size"),
            F.col("__target").alias("target"),
            F.least(crossed, F.ceil("__rate")).cast("long").alias("copies"),
        )
    )


def emit(mixed: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Each row ``copies`` times, with only ``columns``."""
    return mixed.where("copies > 0").withColumn("__copy", F.explode(F.sequence(F.lit(1), F.col("copies")))).select(*columns)


OP8_SQL = r"""
WITH RECURSIVE sized AS (
  SELECT doc_id, source, CAST(coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0) AS BIGINT) AS size
  FROM documents
), per_source AS (
  SELECT source, CAST(sum(size) AS BIGINT) AS source_size,
         CASE (row_number() OVER (ORDER BY source IS NULL, source) - 1) % 3 WHEN 0 THEN 5.0::DOUBLE WHEN 1 THEN 2.0 ELSE 1.0 END AS weight
  FROM sized GROUP BY source
), levels AS (
  SELECT 0 AS step, -1.0::DOUBLE AS earlier, (SELECT 1.5::DOUBLE * sum(source_size) / sum(weight) FROM per_source) AS level
  UNION ALL
  SELECT l.step + 1, l.level,
         (SELECT (1.5::DOUBLE * sum(source_size) - 2.0::DOUBLE * coalesce(sum(source_size) FILTER (WHERE weight * l.level > 2 * source_size), 0))
                 / sum(weight) FILTER (WHERE NOT weight * l.level > 2 * source_size) FROM per_source)
  FROM levels l WHERE l.level IS NOT NULL AND l.level <> l.earlier
), targets AS (
  SELECT source, source_size,
         least(weight * (SELECT arg_max(level, step) FROM levels WHERE level IS NOT NULL), 2.0::DOUBLE * source_size) AS target,
         ('0x' || substr(md5('42|' || (source IS NULL) || '|' || coalesce(source, '')), 1, 8))::BIGINT / 4294967296.0::DOUBLE AS shift
  FROM per_source
), placed AS (
  SELECT doc_id, source, size, row_number() OVER (
    PARTITION BY source ORDER BY
      CASE WHEN size < 64 THEN size
           ELSE 64 + 16 * (length(bin(size)) - 7) + ((size >> (length(bin(size)) - 5)::BIGINT) - 16) END,
      floor(('0x' || substr(md5(coalesce(doc_id::VARCHAR, '')), 1, 8))::BIGINT / 4294967296.0::DOUBLE * 64), size, doc_id) AS place
  FROM sized
)
SELECT p.doc_id, p.size, t.source_size, t.target,
       CAST(p.size * (floor(p.place * (t.target / t.source_size) + t.shift)
                      - floor((p.place - 1) * (t.target / t.source_size) + t.shift)) AS BIGINT) AS taken
FROM placed p JOIN targets t ON p.source IS NOT DISTINCT FROM t.source
"""

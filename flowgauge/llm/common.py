"""Helpers shared by the training-data operators."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from flowgauge.runtime import cut_lineage

#: The white space that parts words: space and the five control characters from tab on.
SPACE = "[\\x20\\x09-\\x0D]"
SPACE_CHARS = " \t\n\x0b\x0c\r"
#: Bits of a bitmap of keys, as a power of two: 2 MB.
MARK_BITS = 24
_UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def ascii_lower(text: Column) -> Column:
    """A-Z lowered and nothing else; ``lower`` alone is used where all bytes are ASCII."""
    return F.when(F.octet_length(text) == F.length(text), F.lower(text)).otherwise(
        F.translate(text, _UPPER, _UPPER.lower())
    )


def held_out(doc_id: Column) -> Column:
    """True for the fifth of the documents that no model may learn from."""
    return F.coalesce(F.pmod(F.crc32(doc_id.cast("string").cast("binary")), F.lit(5)) == 0, F.lit(False))


def with_marks(rows: DataFrame, held: DataFrame, keys: Sequence[str]) -> DataFrame:
    """``rows`` with ``marked``: true wherever a row of ``held`` has the same keys, and for few others.

    A bitmap of fixed size goes to all tasks, so rows without a partner need not be moved to a
    join. The fuller it is, the more rows are marked in vain, which the join behind sorts out.
    """
    place = F.pmod(F.xxhash64(*keys), F.lit(1 << MARK_BITS)) + 1
    dealt = held.select(place.alias("__place")).withColumn("__bucket", F.bitmap_bucket_number("__place"))
    bits = F.bitmap_construct_agg(F.bitmap_bit_position("__place")).alias("__bits")
    bitmap = cut_lineage(dealt.repartition("__bucket").groupBy("__bucket").agg(bits))
    byte = F.expr("conv(hex(substring(__bits, cast(bitmap_bit_position(__place) div 8 as int) + 1, 1)), 16, 10)")
    bit = F.expr("cast(bitmap_bit_position(__place) % 8 as int)")
    found = rows.withColumn("__place", place).withColumn("__bucket", F.bitmap_bucket_number("__place"))
    found = found.join(F.broadcast(bitmap), "__bucket", "left")
    found = found.withColumn("marked", F.coalesce(F.call_function("shiftright", byte.cast("int"), bit).bitwiseAND(F.lit(1)) == 1, F.lit(False)))
    return found.select(*rows.columns, "marked")


def components(links: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """Connected components of undirected links: one row ``(node, component)`` per linked node.

    ``component`` is the smallest node reachable. Alternates the large-star and
    small-star steps until the links no longer change. A hub's links are never
    gathered in one task: each step is a minimum per node, which combines before the
    shuffle, joined back to the links, which adaptive execution splits. NULL ends and
    self links are ignored.
    """
    a_, b_ = F.col(a), F.col(b)
    edges = cut_lineage(
        links.where(a_ != b_).select(F.greatest(a_, b_).alias("u"), F.least(a_, b_).alias("v")).distinct()
    )
    before = None
    while True:
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(low, "u").where("v > u and v != m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        large = cut_lineage(large.distinct())
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = (
            large.join(least, "u")
            .where("v != m")
            .select(F.col("v").alias("u"), F.col("m").alias("v"))
            .unionByName(least.select("u", F.col("m").alias("v")))
            .distinct()
        )
        edges = cut_lineage(small)
        now = edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if now == before:
            break
        before = now
    roots = edges.select(F.col("v").alias("node")).distinct().select("node", F.col("node").alias("component"))
    return edges.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(roots)


def labelled_sample(rows: DataFrame, id_col: str, label_col: str, per_label: int) -> list:
    """Distinct rows of each label, about ``per_label`` of them, picked by a hash of the whole row.

    A label with fewer gives all. The share of each label follows from the number of its
    distinct rows, estimated over all rows, so the size of what reaches the driver is
    bounded by the parameter and the number of labels, not by the table, also where one
    id or none stands in many rows. Rows come in the order of their hash.
    """
    distinct = F.approx_count_distinct(F.xxhash64(*rows.columns))
    counts = {r[0]: r[1] for r in rows.groupBy(label_col).agg(distinct).collect()}
    place = F.pmod(F.xxhash64(F.lit("sample"), *rows.columns), F.lit(1 << 30))
    picked = F.lit(False)
    for label, n in counts.items():
        share = min(1.0, per_label / n)
        picked = picked | ((F.col(label_col) == F.lit(label)) & (F.col("__place") < F.lit(int(share * (1 << 30)))))
    found = rows.withColumn("__place", place).where(F.coalesce(picked, F.lit(False))).dropDuplicates(rows.columns)
    return sorted(found.collect(), key=lambda r: (r["__place"], str(r[id_col])))

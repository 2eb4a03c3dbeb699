"""Line dedup: lines found in several documents stay only in the smallest one.

DataFrame functions only; nothing runs in Python.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from flowgauge.llm.common import SPACE_CHARS, ascii_lower
from flowgauge.runtime import cut_lineage


def line_key(line: Column) -> Column:
    return ascii_lower(F.btrim(line, F.lit(SPACE_CHARS)))


def dedup_lines(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", *, min_chars: int = 10, min_docs: int = 2
) -> DataFrame:
    """``docs`` with ``n_lines``, ``n_dropped`` and ``kept_text``.

    A line's key is the line stripped of ASCII white space and with A-Z lowered. Keys
    of at least ``min_chars`` code points found in at least ``min_docs`` distinct
    documents lose all their lines except in the smallest document id holding them.

    NULL and empty texts are one empty line. Rows with a NULL id are not compared and
    keep all lines. Repeated rows count as one document. Other columns of ``docs``
    pass through untouched; an empty table gives an empty result.

    Only two 64-bit hashes per line and the document id travel to the count, which
    combines a minimum and a maximum per key before the shuffle, so a line found
    everywhere costs one row per task. The join that marks lines is split by adaptive
    execution where a key is hot. Positions are looked up by document id and a hash of
    the text, so equal ids with different texts do not mix.
    """
    # Own names throughout, so a column of the caller's cannot clash with them.
    text = F.coalesce(F.col(text_col), F.lit(""))
    ident = [F.col(id_col).alias("__doc"), F.xxhash64(text).alias("__text_hash")]
    lines = (
        docs.where(F.col(id_col).isNotNull())
        .select(*ident, F.posexplode(F.split(text, "\n")).alias("__pos", "__line"))
        .select("__doc", "__text_hash", "__pos", line_key(F.col("__line")).alias("__key"))
        .where(F.length("__key") >= min_chars)
        .select(
            "__doc",
            "__text_hash",
            "__pos",
            F.xxhash64(F.lit(1), "__key").alias("__h1"),
            F.xxhash64(F.lit(2), "__key").alias("__h2"),
        )
    )
    if min_docs == 2:
        common = lines.groupBy("__h1", "__h2").agg(F.min("__doc").alias("__first"), F.max("__doc").alias("__last"))
        common = common.where("__first < __last")
    else:
        common = (
            lines.select("__h1", "__h2", "__doc")
            .distinct()
            .groupBy("__h1", "__h2")
            .agg(F.min("__doc").alias("__first"), F.count("*").alias("__n"))
            .where(F.col("__n") >= min_docs)
        )
    # Written first: adaptive execution splits a hot key only where both sides are shuffled for the join itself.
    common = cut_lineage(common)
    dropped = (
        lines.join(common.select("__h1", "__h2", "__first"), ["__h1", "__h2"])
        .where("__doc != __first")
        .groupBy("__doc", "__text_hash")
        .agg(F.collect_set("__pos").alias("__dropped"))
    )
    joined = docs.withColumn("__text_hash", F.xxhash64(text)).join(
        dropped.withColumnRenamed("__text_hash", "__hash"),
        (F.col(id_col) == F.col("__doc")) & (F.col("__text_hash") == F.col("__hash")),
        "left",
    )
    parts = F.split(text, "\n")
    kept = F.array_except(F.sequence(F.lit(0), F.size(parts) - 1), F.col("__dropped"))
    # Bound to a variable, so that a text is split once and not for each of its lines.
    whole = F.array(F.struct(parts.alias("parts"), kept.alias("kept")))
    rebuilt = F.get(
        F.transform(whole, lambda w: F.array_join(F.transform(w["kept"], lambda i: F.get(w["parts"], i)), "\n")), F.lit(0)
    )
    return joined.select(
        *[F.col(c) for c in docs.columns],
        F.size(parts).cast("long").alias("n_lines"),
        F.coalesce(F.size("__dropped"), F.lit(0)).cast("long").alias("n_dropped"),
        F.when(F.col("__dropped").isNull(), text).otherwise(rebuilt).alias("kept_text"),
    )


OP2_SQL = r"""
WITH lines AS (
  SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line,
         generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS pos
  FROM documents
), keyed AS (
  SELECT doc_id, pos, line,
         translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)),
                   'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key
  FROM lines
), common AS (
  SELECT key, min(doc_id) AS keeper FROM keyed WHERE length(key) >= 10
  GROUP BY key HAVING count(DISTINCT doc_id) >= 2
), marked AS (
  SELECT k.doc_id, k.pos, k.line, c.keeper IS NOT NULL AND c.keeper <> k.doc_id AS dropped
  FROM keyed k LEFT JOIN common c ON k.key = c.key
)
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (WHERE dropped) AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (WHERE NOT dropped), '')) AS kept_sha256
FROM marked GROUP BY doc_id
"""

"""Importance resampling: documents are drawn by how much they read like a target set.

A text's features are its runs of one to three words, hashed to buckets. A bucket's gain
is the logarithm of how much more often the target uses it than the corpus does. A
document's weight is the sum of gains over its features, taken from bit planes: its
bucket counts are written as planes of one bit per bucket, the gains as one set of planes
for the positive and one for the negative, and the weight is the sum of powers of two
times the set bits that a count plane and a gain plane share. All numbers are integers,
so the weight is exact.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from flowgauge.llm.words import raw_texts, word_blocks
from flowgauge.runtime import cut_lineage

BUCKETS = 10_000
LONGEST_RUN = 3
#: Bytes of a text that are cut into words together, and documents whose counts are weighed together.
BLOCK_BYTES = 1 << 20
BLOCK_DOCS = 64
#: Word bytes are digits, letters and all bytes of characters beyond ASCII; the others part words.
_WORD_BYTES = bytes(b if b > 127 else ord(chr(b).lower()) if chr(b).isalnum() else 32 for b in range(256))


def _runs(text: bytes | None, longest: int, block: int = BLOCK_BYTES) -> Iterator[tuple[int, list[int]]]:
    """Number of words and checksums of the runs that end in them, a block of the text at a time."""
    before: list[bytes] = []
    for fresh in word_blocks(text, _WORD_BYTES, block):
        words = before + fresh
        joined = [b" " + word for word in words]
        sums = list(map(crc32, words))
        found = sums[len(before) :]
        for more in range(1, longest):
            sums = list(map(crc32, joined[more:], sums))
            found += sums[max(0, len(before) - more) :]
        yield len(fresh), found
        before = words[-(longest - 1) :] if longest > 1 else []


def _bucket_counts(text: bytes | None, longest: int, buckets: int) -> tuple[int, np.ndarray]:
    """Number of words, and of features in each bucket."""
    words, counts = 0, np.zeros(buckets, dtype=np.int64)
    for n, sums in _runs(text, longest):
        words += n
        counts += np.bincount(np.array(sums, dtype=np.int64) % buckets, minlength=buckets)
    return words, counts


def bucket_totals(
    docs: DataFrame, text_col: str = "text", *, longest: int = LONGEST_RUN, buckets: int = BUCKETS
) -> np.ndarray:
    """Features in each bucket over all texts. A task sends at most one row for each bucket."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(buckets, dtype=np.int64)
        for batch in batches:
            for text in raw_texts(batch.column(batch.num_columns - 1)):
                total += _bucket_counts(text, longest, buckets)[1]
        used = np.nonzero(total)[0]
        yield pa.RecordBatch.from_arrays([pa.array(used), pa.array(total[used])], names=["bucket", "n"])

    counted = docs.select(F.col(text_col).alias("text")).mapInArrow(run, "bucket bigint, n bigint")
    out = np.zeros(buckets, dtype=np.int64)
    for bucket, n in counted.groupBy("bucket").agg(F.sum("n").alias("n")).collect():
        out[bucket] = n
    return out


def bucket_gains(corpus: np.ndarray, target: np.ndarray) -> np.ndarray:
    """Whole-number gain of each bucket: a thousand times the log ratio of its smoothed shares, floors down."""
    corpus_mass, target_mass = float(corpus.sum() + len(corpus)), float(target.sum() + len(target))
    return np.array(
        [
            math.floor(1000 * math.log((t + 1.0) * corpus_mass / ((s + 1.0) * target_mass)))
            for s, t in zip(corpus.tolist(), target.tolist(), strict=True)
        ],
        dtype=np.int64,
    )


def _packed(bits: np.ndarray) -> np.ndarray:
    """One bit a bucket, in words of 64."""
    packed = np.packbits(bits, axis=-1)
    wide = np.zeros((*packed.shape[:-1], -(-packed.shape[-1] // 8) * 8), dtype=np.uint8)
    wide[..., : packed.shape[-1]] = packed
    return wide.view(np.uint64)


@dataclass(frozen=True)
class GainPlanes:
    """Gains as bit planes: one mask for each power of two and sign that occurs."""

    masks: list[tuple[int, np.ndarray]]

    @classmethod
    def of(cls, gains: np.ndarray) -> GainPlanes:
        masks = []
        for sign in (1, -1):
            size = np.maximum(gains * sign, 0)
            masks += [(sign << j, _packed((size >> j) & 1 == 1)) for j in range(int(size.max()).bit_length())]
        return cls(masks)

    def weigh(self, counts: np.ndarray) -> np.ndarray:
        """Sum of count times gain for each row of ``counts``."""
        weights = np.zeros(len(counts), dtype=np.int64)
        for i in range(int(counts.max(initial=0)).bit_length()):
            plane = _packed((counts >> i) & 1 == 1)
            rows = np.nonzero(plane.any(axis=1))[0]
            plane = plane[rows]
            for factor, mask in self.masks:
                shared = np.bitwise_count(plane & mask).sum(axis=1, dtype=np.int64)
                weights[rows] += (factor * (1 << i)) * shared
        return weights


def importance_weights(
    docs: DataFrame,
    target: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    target_text_col: str = "text",
    *,
    longest: int = LONGEST_RUN,
    buckets: int = BUCKETS,
) -> DataFrame:
    """``id, n_words, n_features, weight`` of every whole text, by its likeness to ``target``.

    Counts cover all rows of both tables. NULL and empty texts and texts without a word have
    no features and weigh 0. Repeated rows count and are returned as often as they occur; a
    NULL id is kept. An empty target makes all its shares equal, an empty ``docs`` gives an
    empty result. Other columns are not read. Long texts are cut into words a block at a time;
    the driver gets one number for each bucket.
    """
    gains = bucket_gains(
        bucket_totals(docs, text_col, longest=longest, buckets=buckets),
        bucket_totals(target, target_text_col, longest=longest, buckets=buckets),
    )
    planes = GainPlanes.of(gains)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            words, sizes, weights = [], [], []
            held: list[np.ndarray] = []
            for text in raw_texts(batch.column(batch.num_columns - 1)):
                n, counts = _bucket_counts(text, longest, buckets)
                words.append(n)
                sizes.append(int(counts.sum()))
                held.append(counts)
                if len(held) == BLOCK_DOCS:
                    weights += planes.weigh(np.array(held)).tolist()
                    held = []
            if held:
                weights += planes.weigh(np.array(held)).tolist()
            numbers = [pa.array(x, pa.int64()) for x in (words, sizes, weights)]
            names = ["id", "n_words", "n_features", "weight"]
            yield pa.RecordBatch.from_arrays([batch.column(0), *numbers], names=names)

    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    kind = dict(rows.dtypes)["id"]
    out = rows.mapInArrow(run, f"id {kind}, n_words bigint, n_features bigint, weight bigint")
    return out.withColumnRenamed("id", id_col)


def draw(weighted: DataFrame, id_col: str = "doc_id", *, percent: int = 5, min_words: int = 20, seed: int = 42) -> DataFrame:
    """``weighted`` with ``score`` and ``rank``: the highest scores of documents long enough.

    The score is the weight, a thousandth of a log unit each, plus noise of a Gumbel
    distribution drawn from the seed and the id, so the highest scores are a draw without
    replacement in proportion to the exponential of the weights. Of N documents with at least
    ``min_words`` words, floor(percent * N / 100) are drawn; ``rank`` counts them from 1 and is
    NULL for the rest. Ties go to the smaller id, NULL ids last (their noise is that of an empty
    id), then to fewer features; rows equal in all of these share their fate by place alone.

    Rows are dealt by ranges of the score and numbered inside each, so no task ranks them all.
    """
    ident = F.coalesce(F.col(id_col).cast("string"), F.lit(""))
    digest = F.substring(F.sha2(F.concat(F.lit(f"{seed}:"), ident).cast("binary"), 256), 1, 8)
    unit = (F.conv(digest, 16, 10).cast("double") + 0.5) / 4294967296.0
    noise = F.floor(F.lit(-1000.0) * F.log(-F.log(unit))).cast("long")
    scored = weighted.withColumn("score", F.col("weight") + noise).withColumn("__may", F.col("n_words") >= min_words)
    # Dealing by ranges reads its input twice.
    scored = cut_lineage(scored)
    order = [F.desc("__may"), F.desc("score"), F.asc_nulls_last(id_col), F.asc("n_features"), F.asc("weight")]
    placed = cut_lineage(
        scored.repartitionByRange(*order)
        .sortWithinPartitions(*order)
        .withColumn("__place", F.monotonically_increasing_id())
    )
    part = F.shiftrightunsigned("__place", 33).alias("__part")
    parts = placed.select(part, "__may").groupBy("__part").agg(F.count("*").alias("n"), F.count_if("__may").alias("may"))
    parts = cut_lineage(parts)
    n_drawn = percent * (parts.agg(F.sum("may")).first()[0] or 0) // 100
    # One row for each partition of the sort above.
    before = F.sum("n").over(W.orderBy("__part").rowsBetween(W.unboundedPreceding, -1))
    offsets = parts.select("__part", F.coalesce(before, F.lit(0)).alias("__before"))
    inside = F.col("__place").bitwiseAND(F.lit((1 << 33) - 1))
    rank = F.col("__before") + inside + 1
    ranked = placed.select("*", part).join(F.broadcast(offsets), "__part")
    return ranked.select(*weighted.columns, "score", F.when(rank <= n_drawn, rank).alias("rank"))


def resample(
    docs: DataFrame,
    target: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    *,
    percent: int = 5,
    min_words: int = 20,
    seed: int = 42,
) -> DataFrame:
    """The drawn rows of ``docs``, all columns. Ids are taken to be unique; rows with a NULL id are not drawn."""
    weighted = importance_weights(docs, target, id_col, text_col)
    drawn = draw(weighted, id_col, percent=percent, min_words=min_words, seed=seed).where("rank IS NOT NULL")
    return docs.join(drawn.select(id_col), id_col, "left_semi").select(docs.columns)


OP13_SQL = r"""
WITH RECURSIVE texts AS (
  SELECT doc_id AS id, 0 AS side, text FROM documents UNION ALL SELECT item_id, 1, text FROM benchmark
), listed AS (
  SELECT id, side, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                      '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM texts
), runs AS (
  SELECT id, side, array_to_string(w[i:i + n - 1], ' ') AS f
  FROM (SELECT id, side, w, unnest(range(1, len(w) + 1)) AS i FROM listed), (SELECT unnest([1, 2, 3]) AS n)
  WHERE i + n - 1 <= len(w)
), counted AS (SELECT id, side, f, count(*) AS n FROM runs GROUP BY id, side, f),
hexed AS (SELECT f, hex(encode(f)) AS h, octet_length(encode(f)) AS size FROM (SELECT DISTINCT f FROM counted)),
longest AS (SELECT coalesce(max(size), 0) AS most FROM hexed),
-- The checksum is linear: each byte adds its own, shifted by the bytes behind it.
crc_bytes AS (
  SELECT i AS b, list_reduce(range(8), lambda c, k: CASE WHEN c % 2 = 1 THEN xor(c // 2, 3988292384) ELSE c // 2 END, i) AS v
  FROM range(256) r(i)
), shifted AS (
  SELECT 0::BIGINT AS behind, b, v FROM crc_bytes
  UNION ALL
  SELECT behind + 1, s.b, xor(s.v // 256, t.v) FROM shifted s JOIN crc_bytes t ON t.b = s.v % 256
  WHERE behind + 1 < (SELECT most FROM longest)
), started AS (
  SELECT 0::BIGINT AS size, 4294967295::BIGINT AS v
  UNION ALL
  SELECT size + 1, xor(s.v // 256, t.v) FROM started s JOIN crc_bytes t ON t.b = s.v % 256
  WHERE size < (SELECT most FROM longest)
), opened AS (
  SELECT f, size, size - 1 - i AS behind,
         16 * (instr('0123456789ABCDEF', substr(h, 2 * i + 1, 1)) - 1) + instr('0123456789ABCDEF', substr(h, 2 * i + 2, 1)) - 1 AS b
  FROM (SELECT f, size, h, unnest(range(size)) AS i FROM hexed)
), summed AS (
  SELECT f, any_value(size) AS size, bit_xor(v) AS v FROM opened JOIN shifted USING (behind, b) GROUP BY f
), hashed AS (
  SELECT f, xor(xor(m.v, s.v), 4294967295) % 10000 AS bucket FROM summed m JOIN started s USING (size)
), used AS (SELECT id, side, bucket, sum(n) AS n FROM counted JOIN hashed USING (f) GROUP BY id, side, bucket),
buckets AS (
  SELECT i AS bucket, coalesce(sum(n) FILTER (WHERE side = 0), 0)::DOUBLE AS s, coalesce(sum(n) FILTER (WHERE side = 1), 0)::DOUBLE AS t
  FROM range(10000) r(i) LEFT JOIN used ON used.bucket = i GROUP BY i
), gains AS (
  SELECT bucket, floor(1000 * ln((t + 1) * ((sum(s) OVER ()) + 10000) / ((s + 1) * ((sum(t) OVER ()) + 10000))))::BIGINT AS gain FROM buckets
), weighed AS (
  SELECT id, sum(n)::BIGINT AS n_features, sum(n * gain)::BIGINT AS weight FROM used JOIN gains USING (bucket) WHERE side = 0 GROUP BY id
), scored AS (
  SELECT id, len(w) AS words, coalesce(n_features, 0) AS n_features, coalesce(weight, 0) AS weight,
         coalesce(weight, 0) + floor(-1000 * ln(-ln((list_reduce(
           list_transform(range(1, 9), lambda i: instr('0123456789abcdef', sha256('42:' || id)[i])::BIGINT - 1),
           lambda a, d: a * 16 + d) + 0.5::DOUBLE) / 4294967296)))::BIGINT AS score
  FROM listed LEFT JOIN weighed USING (id) WHERE side = 0
), ranked AS (
  SELECT *, row_number() OVER (PARTITION BY words >= 20 ORDER BY score DESC, id) AS place,
         count(*) FILTER (WHERE words >= 20) OVER () AS may FROM scored
)
SELECT id AS doc_id, n_features, weight, score, CASE WHEN words >= 20 AND place <= 5 * may // 100 THEN place END AS rank FROM ranked
"""

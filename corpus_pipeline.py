"""The corpus pipeline: five operators in a row, each over all that the one before has kept."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from flowgauge.llm import decontaminate, jaccard, mixing, tokens, toxicity
from flowgauge.llm.common import table, with_marks
from flowgauge.runtime import scratch_path


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts that the network, trained on the labels, scores at 0.5 or more go."""
    net = toxicity.train_toxicity_model(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    return toxicity.reject_toxic(docs, net)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of texts linked by shared 4-word shingles the one with the smallest id stays, in one row.

    Texts are judged, not ids: of rows that share an id and differ in text each stays or goes with its
    own group. Within a group ties of the id go to the smaller hash of the text. Texts without a word
    are groups of their own by id and text. Rows without an id belong to no group and stay.
    """
    found = jaccard.jaccard_components(docs.select("doc_id", "text"), per_text=True).where("doc_id IS NOT NULL")
    alone = F.struct(F.xxhash64("doc_id", "text_hash").alias("group"), F.lit(True).alias("wordless"))
    group = F.when(F.col("group").isNull(), alone).otherwise(F.struct("group", F.lit(False).alias("wordless")))
    texts = found.select(group.alias("group"), "doc_id", "text_hash").groupBy("group", "doc_id", "text_hash")
    path = scratch_path(spark, "pipeline-groups")
    texts.agg(F.count("*").alias("n")).write.parquet(path)
    texts = spark.read.schema(
        "group struct<group: bigint, wordless: boolean>, doc_id bigint, text_hash bigint, n bigint"
    ).parquet(path)
    first = texts.groupBy("group").agg(F.min(F.struct("doc_id", "text_hash")).alias("first"), F.sum("n").alias("rows"))
    stays = F.struct("doc_id", "text_hash") == F.col("first")
    # Only texts that go or repeat are looked up; a bitmap of their keys tells which others need not be moved.
    path = scratch_path(spark, "pipeline-copies")
    judged = texts.join(first.where("rows > 1").drop("rows"), "group").select("doc_id", "text_hash", "n", stays.alias("stays"))
    judged.where("NOT stays OR n > 1").select("doc_id", "text_hash", "stays").write.parquet(path)
    looked_up = spark.read.schema("doc_id bigint, text_hash bigint, stays boolean").parquet(path)
    keys = ["doc_id", "text_hash"]
    hashed = with_marks(docs.withColumn("text_hash", F.xxhash64("text")), looked_up, keys)
    moved = hashed.where("marked")
    single = moved.join(looked_up.select(*keys), keys, "left_anti")
    repeated = moved.join(looked_up.where("stays").select(*keys), keys, "left_semi").dropDuplicates(keys)
    kept = hashed.where("NOT marked").unionByName(single).unionByName(repeated)
    return kept.select(docs.columns)


def drop_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that a benchmark item has leaked into go."""
    return decontaminate.drop_leaks(docs, table(spark, sf_dir, "benchmark"))


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix of sources takes it."""
    return mixing.emit(mixing.mix_sources(docs), docs.columns)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of all documents, written in blocks and read back."""
    return tokens.tokenize(docs)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("toxicity", drop_toxic),
    ("near copies", drop_near_copies),
    ("decontamination", drop_benchmark),
    ("mixing", mix),
    ("tokens", encode),
]

#: A trained network and alignment are no SQL; the pipeline is tested against plain Python.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; each writes its rows under the shared folder for the next."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        out = stage(spark, docs, sf_dir)
        path = scratch_path(spark, "pipeline-" + name.replace(" ", "-"))
        out.write.parquet(path)
        docs = spark.read.schema(out.schema).parquet(path)
    return docs

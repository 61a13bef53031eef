"""The corpus pipeline: low quality goes, near copies go, benchmark leaks go, secrets are masked, what is left is packed.

Each stage takes (spark, docs, sf_dir) and works on all rows that the one before kept; all but the last return the columns
of documents. Only the packed pieces come out.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from assayer.llm import decontam, neardup, packing, quality, secrets
from assayer.llm.common import Cut, cut, held_out, small, table


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps documents that the classifier scores at its cut or above; it learns from the labelled ones among docs."""
    labels = table(spark, sf_dir, "labels").where(~held_out())
    scored = quality.quality(docs, labels, keep=docs.columns, name="__quality")
    # A row for each document kept; a filter would be pushed below the features and repeat them.
    return scored.withColumn("__kept", F.explode(F.when(F.col("__quality") >= quality.CUT, F.array(F.lit(True))))).select(*docs.columns)


def near_dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one document of each group of near copies, the one of least id; of repeated rows of one id and text, one.

    Rows without an id count as one document for each text, and rows of one id with several texts as one for each; both come
    after all other ids.
    """
    ids = docs.where("doc_id is not null").groupBy("doc_id").agg(F.min(F.xxhash64("text")).alias("a"), F.max(F.xxhash64("text")).alias("b"))
    mixed = Cut(ids.where("a <> b").select(F.col("doc_id").alias("__mixed")), "mixed").df
    made = F.lit(1 << 61) + F.xxhash64("doc_id", "text").bitwiseAND(F.lit((1 << 61) - 1))
    node = F.when(F.col("doc_id").isNull() | F.col("__mixed").isNotNull(), made).otherwise(F.col("doc_id").cast("long"))
    named = docs.join(small(mixed), F.col("doc_id") == F.col("__mixed"), "left").withColumn("__node", node).select(*docs.columns, "__node")
    found = Cut(neardup.near_duplicates(named.select(F.col("__node").alias("doc_id"), "text")), "classes").df.withColumnRenamed("doc_id", "__node")
    gone = Cut(found.where("not kept").select("__node").distinct(), "gone").df
    kept = named.join(small(gone), "__node", "left_anti")
    again = Cut(found.where("kept").groupBy("__node").count().where("count > 1").select("__node"), "again").df
    if again.isEmpty():
        return kept.select(*docs.columns)
    once, more = (kept.join(small(again), "__node", how).select(*docs.columns, "__node") for how in ("left_anti", "left_semi"))
    return once.unionByName(more.dropDuplicates(["__node"])).select(*docs.columns)


def decontamination_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents that hold a benchmark item, whole or with few words changed; rows are known by their text, whatever their id."""
    texts = docs.select(F.xxhash64("text").alias("doc_id"), "text")
    leaks = decontam.contamination(texts, table(spark, sf_dir, "benchmark"), short=decontam.SHORT)
    found = cut(leaks.select(F.col("doc_id").alias("__text")).distinct(), "leaks")
    return docs.withColumn("__text", F.xxhash64("text")).join(small(found), "__text", "left_anti").select(*docs.columns)


def secrets_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Masks the secrets in each text; no document goes."""
    return secrets.redacted(docs, secrets.scanned(docs, F.col("source"), F.col("doc_id")))


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Packs the texts into sequences of tokens."""
    return packing.pack(docs)


STAGES = [
    ("quality classifier", quality_stage),
    ("MinHash near-dedup", near_dedup_stage),
    ("benchmark decontamination", decontamination_stage),
    ("secret scans", secrets_stage),
    ("packing", packing_stage),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages over documents, each written and read again before the next."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = cut(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)


#: The classifier and the tokenizer are beyond SQL; tests hold the stages against brute force.
ORACLE_SQL = None

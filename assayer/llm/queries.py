"""The queries of the training-data operators, each over its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from assayer.llm import align, decontam, html, langid, lm, neardup, packing, quality, resample, rules, secrets, sql, urls, warc
from assayer.llm.common import held_out, table


def _training_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "labels").where(~held_out())


def op1_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A document's source owns it; the document itself stands for a repository."""
    return secrets.digest(secrets.scanned(table(spark, sf_dir, "documents"), F.col("source"), F.col("doc_id")))


def op2_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    scored = quality.quality(table(spark, sf_dir, "documents"), _training_labels(spark, sf_dir))
    return scored.select("doc_id", held_out().alias("held_out"), "score", (F.col("score") >= quality.CUT).cast("int").alias("predicted"))


def op3_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    found = langid.identify(docs, docs.where(~held_out()))
    return found.select("doc_id", held_out().alias("held_out"), "lang_pred", "score")


def op4_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html.main_text(table(spark, sf_dir, "pages"))


def op5_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rules.judged(table(spark, sf_dir, "documents"), _training_labels(spark, sf_dir))


def op6_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The target is what the training labels mark as good."""
    return lm.cross_entropy_difference(table(spark, sf_dir, "documents"), _training_labels(spark, sf_dir).where("quality = 1"))


def op7_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neardup.near_duplicates(table(spark, sf_dir, "documents"))


def op8_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontam.contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), short=decontam.SHORT)


def op9_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"))


def op10_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return urls.judged(table(spark, sf_dir, "pages"))


def op11_token_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return align.alignment(table(spark, sf_dir, "documents"))


def op12_warc_archive(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.archived(table(spark, sf_dir, "pages"))


def op13_target_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Towards the benchmark's texts."""
    return resample.resampled(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (
        op1_secret_scan,
        op2_quality_classifier,
        op3_language_id,
        op4_html_extraction,
        op5_quality_rules,
        op6_lm_scoring,
        op7_minhash_near_dedup,
        op8_benchmark_decontamination,
        op9_packing,
        op10_url_filter,
        op11_token_alignment,
        op12_warc_archive,
        op13_target_resampling,
    )
}

ORACLE_SQL: dict[str, str] = {"op1_secret_scan": sql.OP1, "op7_minhash_near_dedup": sql.OP7, "op12_warc_archive": sql.OP12}

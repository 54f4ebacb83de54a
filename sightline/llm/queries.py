"""The thin queries over the whole tables, and SQL where it can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sightline.llm import audio, decontam, htmltext, license, linededup, packing, pii, quality, rankmerge, simhash
from sightline.llm.common import read


def vocabulary() -> str:
    """Path of the public word-end BPE vocabulary."""
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def op1_telephony_audio(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audio.payload_features(audio.payload_media(read(spark, sf_dir, "documents")))


def op2_benchmark_leaks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontam.leaks(read(spark, sf_dir, "documents"), decontam.split_items(read(spark, sf_dir, "benchmark")))


def op3_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rankmerge.count_tokens(read(spark, sf_dir, "documents"), vocabulary())


def op4_personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.find_spans(read(spark, sf_dir, "documents"), pii.train())


def op5_pack_sequences(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(read(spark, sf_dir, "documents"), vocabulary())


def op6_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return linededup.summary(read(spark, sf_dir, "documents"))


def op7_main_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return htmltext.extract(read(spark, sf_dir, "pages"))


def op8_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license.scan(read(spark, sf_dir, "documents"))


def op9_simhash_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(read(spark, sf_dir, "documents"), shingle=3, radius=3, extra=0)


def op10_quality_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels")
    scored = quality.score(docs, quality.fit_on_labels(docs, labels))
    return scored.select("doc_id", quality.held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    named = (op1_telephony_audio, op2_benchmark_leaks, op3_token_counts, op4_personal_data, op5_pack_sequences, op6_line_dedup, op7_main_text, op8_license_scan, op9_simhash_groups, op10_quality_scores)
    return {f.__name__: f for f in named} | {"pipeline": pipeline}


def oracle_sql() -> dict[str, str]:
    return {"op8_license_scan": license.oracle()}

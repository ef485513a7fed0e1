"""One query per operator, over its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import exact_dedup, filter_audit, license_scan, line_dedup, lm_scoring, minhash, mixing, quality_gam, quality_rules, sentencepiece_codec, sharding, spelling, wordpiece

#: The vocabulary file that the coding queries use; a parameter of their operators.
PIECE_MODEL = "/opt/tokenizers/piece_bpe_32k.model"


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    groups = exact_dedup.exact_groups(_table(spark, sf_dir, "documents"))
    return groups.select("doc_id", "keep_id", "group_size", "kept", "text_sha256")


def op2_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(_table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")


def op3_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    groups = minhash.near_groups(_table(spark, sf_dir, "documents"), n=2, threshold=0.8)
    return groups.select("doc_id", "n_shingles", "component_id", "kept")


def op4_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return wordpiece.count_tokens(_table(spark, sf_dir, "documents"), PIECE_MODEL)


def op5_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules.judge(_table(spark, sf_dir, "documents"))


def op6_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    return line_dedup.common_lines_report(docs, batches=line_dedup.hash_batches(docs))


def op7_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sentencepiece_codec.codec_report(_table(spark, sf_dir, "documents"), PIECE_MODEL)


def op8_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.shard_report(_table(spark, sf_dir, "documents"))


def op9_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lm_scoring.score_words(_table(spark, sf_dir, "documents"))


def op10_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_gam.quality_report(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def op11_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filter_audit.audit(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def op12_license_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_scan.scan(_table(spark, sf_dir, "documents"))


def op13_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    words = spelling.word_counts(_table(spark, sf_dir, "documents"), shortest=6, least=5, typo_every=199)
    return spelling.group_variants(words, factor=5, shortest=6)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    own = (op1_exact_dedup, op2_mixing, op3_minhash, op4_token_counts, op5_quality_rules, op6_line_dedup, op7_sentencepiece, op8_sharding, op9_lm_scoring, op10_quality_classifier, op11_filter_audit, op12_license_scans, op13_spelling_variants)
    return {f.__name__: f for f in own}

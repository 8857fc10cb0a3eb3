"""The registered queries of this subpackage: each applies one operator to a whole table and derives its digest."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import ann, credentials, jaccard, lines, packing, quality_gbdt, quality_rules, sentencepiece_codec, suffix, warc
from .common import parquet_table


def tokenizer_file(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sentencepiece_codec.digest(parquet_table(spark, sf_dir, "documents"), tokenizer_file("piece_bpe_32k.model"))


def op2_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.link_components(parquet_table(spark, sf_dir, "documents"))


def op3_nearest_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ann.search(parquet_table(spark, sf_dir, "embeddings"), F.col("vec_id") % 100 == 0)


def op4_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lines.digest(lines.dedupe(parquet_table(spark, sf_dir, "documents")))


def op5_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix.dedupe(parquet_table(spark, sf_dir, "documents"), with_kept=False)


def op6_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_gbdt.classify(parquet_table(spark, sf_dir, "documents"), parquet_table(spark, sf_dir, "labels"))


def op7_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = quality_rules.apply_rules(parquet_table(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


def op8_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.round_trip(parquet_table(spark, sf_dir, "pages")).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op9_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(parquet_table(spark, sf_dir, "documents"), tokenizer_file("word_bpe_49k.json"), with_ids=False)


def op10_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return credentials.digest(credentials.scan(parquet_table(spark, sf_dir, "documents")))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (op1_sentencepiece, op2_ngram_jaccard_join, op3_nearest_neighbours, op4_line_dedup, op5_suffix_dedup, op6_quality_classifier, op7_quality_rules, op8_warc, op9_best_fit_packing, op10_secret_scan)}


def oracle_sql() -> dict[str, str]:
    return {"op2_ngram_jaccard_join": jaccard.oracle(), "op4_line_dedup": lines.oracle(), "op5_suffix_dedup": suffix.oracle(), "op7_quality_rules": quality_rules.oracle(), "op8_warc": warc.oracle()}

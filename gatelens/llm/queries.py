"""The registered queries of the training-data operators and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from . import hard_negatives, html_extract, license_scan, minhash_dedup, packing, periodic_runs, piece_codec, quality_rules, secret_scan, simhash, source_mixing, substring_dedup, token_counts
from .common import table


def tokenizer_path(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return source_mixing.mixed_sizes(table(spark, sf_dir, "documents"))


def op2_repeats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring_dedup.remove_repeats(table(spark, sf_dir, "documents"))


def op3_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(table(spark, sf_dir, "documents"), tokenizer_path("word_bpe_49k.json"))


def op4_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.fingerprint_report(table(spark, sf_dir, "documents"))


def op5_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash_dedup.near_duplicates(table(spark, sf_dir, "documents"), shingle=4)


def op6_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secret_scan.scan_report(table(spark, sf_dir, "documents"))


def op7_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.token_counts(table(spark, sf_dir, "documents"), tokenizer_path("piece_bpe_32k.model"), keep=["doc_id"])


def op8_main_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_extract.main_text(table(spark, sf_dir, "pages"), keep=["page_id", "url"])


def op9_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules.quality_rules(table(spark, sf_dir, "documents"), keep=["doc_id"])


def op10_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_scan.with_licenses(table(spark, sf_dir, "documents"), keep=["doc_id"])


def op11_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return periodic_runs.runs_report(table(spark, sf_dir, "documents"))


def op12_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hard_negatives.negatives_report(table(spark, sf_dir, "embeddings"))


def op13_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    return piece_codec.codec_report(table(spark, sf_dir, "documents"), tokenizer_path("piece_bpe_32k.model"))


QUERIES = {f.__name__: f for f in (op1_mixing, op2_repeats, op3_packing, op4_fingerprints, op5_near_duplicates, op6_secrets, op7_token_counts, op8_main_text, op9_quality, op10_licenses, op11_runs, op12_negatives, op13_pieces)}
ORACLE_SQL: dict[str, str] = {"op1_mixing": source_mixing.oracle_sql(), "op2_repeats": substring_dedup.ORACLE_SQL, "op5_near_duplicates": minhash_dedup.ORACLE_SQL, "op10_licenses": license_scan.oracle_sql(), "op12_negatives": hard_negatives.ORACLE_SQL}

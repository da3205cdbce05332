"""The queries opN_<name> and their DuckDB SQL."""

from __future__ import annotations

from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

from . import bwt_dedup, decontaminate, exact_dedup, fingerprints, hard_negatives, html_extract, licenses, mixing, ngram_join, quality_mil, resampling, token_store, toxicity


def _read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def tokenizer_config(path: str | None = None) -> str:
    """A tokenizer file's text; the driver reads it and sends it on."""
    if path is None:
        import public_tokenizers

        path = public_tokenizers.path("word_bpe_49k.json")
    return Path(path).read_text()


def op1_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix_plan(_read(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken", "copies")


def op2_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.toxicity(_read(spark, sf_dir, "documents"), _read(spark, sf_dir, "labels"))


def op3_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.exact_dedup(_read(spark, sf_dir, "documents")).drop("seen")


def op4_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_store.token_digest(_read(spark, sf_dir, "documents"), tokenizer_config())


def op5_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.similar_components(_read(spark, sf_dir, "documents"))


def op6_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.contaminated(_read(spark, sf_dir, "documents"), _read(spark, sf_dir, "benchmark"))


def op7_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_extract.extract_pages(_read(spark, sf_dir, "pages"))


def op8_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_mil.quality(_read(spark, sf_dir, "documents"), _read(spark, sf_dir, "labels"))


def op9_bwt_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bwt_dedup.repeat_digest(_read(spark, sf_dir, "documents"))


def op10_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.license_scan(_read(spark, sf_dir, "documents"), licenses.known_digests(spark))


def op11_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprints.fingerprint_report(_read(spark, sf_dir, "documents"))


def op12_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return resampling.resample(_read(spark, sf_dir, "documents"), _read(spark, sf_dir, "benchmark"))


def op13_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hard_negatives.hard_negatives(_read(spark, sf_dir, "embeddings"))


QUERIES = {f.__name__: f for f in (op1_mixing, op2_toxicity, op3_exact_dedup, op4_token_files, op5_ngram_join, op6_decontamination, op7_html_extraction, op8_quality, op9_bwt_dedup, op10_license_scan, op11_fingerprints, op12_resampling, op13_hard_negatives)}
ORACLES = {"op1_mixing": mixing.ORACLE, "op3_exact_dedup": exact_dedup.ORACLE, "op10_license_scan": licenses.ORACLE, "op12_resampling": resampling.ORACLE, "op13_hard_negatives": hard_negatives.ORACLE}

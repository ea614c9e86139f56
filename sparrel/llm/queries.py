"""The registered queries of this subpackage: each operator over its whole table, with production parameters."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from sparrel.llm import language_model, media, near_vectors, ngram_join, packing, pieces, quality, secrets, substrings, warc
from sparrel.llm.oracle import ORACLE_SQL


def tokenizer(name: str) -> str:
    """Where a public tokenizer's vocabulary file lies; the operators take any path."""
    import public_tokenizers

    return public_tokenizers.path(name)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.ngram_jaccard_join(table(spark, sf_dir, "documents"))


def op2_language_model(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language_model.score_documents(table(spark, sf_dir, "documents"))


def op3_media_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    return media.media_digest(table(spark, sf_dir, "documents"))


def op4_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.secret_digest(table(spark, sf_dir, "documents"))


def op5_near_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_vectors.near_vectors(table(spark, sf_dir, "embeddings"))


def op6_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substrings.keep_first(table(spark, sf_dir, "documents"), with_text=False).drop("kept")


def op7_importance_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.quality_digest(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op8_curve_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"), tokenizer("byte_bpe_50k.json"))


def op9_revisit_resolution(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.revisit_digest(table(spark, sf_dir, "pages"))


def op10_piece_coding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pieces.pieces_digest(table(spark, sf_dir, "documents"), tokenizer("piece_bpe_32k.model"))


__all__ = ["ORACLE_SQL", "QUERIES"]

QUERIES = {
    f.__name__: f
    for f in (
        op1_ngram_join,
        op2_language_model,
        op3_media_columns,
        op4_secret_scan,
        op5_near_vectors,
        op6_substring_dedup,
        op7_importance_resampling,
        op8_curve_packing,
        op9_revisit_resolution,
        op10_piece_coding,
    )
}

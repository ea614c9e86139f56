"""A training corpus from raw documents: quality, near duplicates, repeated passages, secrets, packing.

Each stage takes what its predecessor wrote and returns the columns of documents, the last
one the pieces of packed sequences.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sparrel.llm import ngram_join, packing, quality, secrets, substrings
from sparrel.llm.queries import tokenizer
from sparrel.llm.scratch import materialize, quoted

#: Window functions, sampling and hashes of whole texts have no equivalent in the oracle's SQL; tests hold run() against brute force.
ORACLE_SQL = None


def quality_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that importance resampling draws; the others, junk and toxic text, go."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    return quality.importance_resample(docs, labels).where("kept").select("row.*")


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near copies, one row: that with the smallest doc_id, nulls last; rows without words are no copies."""
    return ngram_join.first_of_copies(docs)


def substring_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Without the passages that an earlier document has; documents of which nothing is left go."""
    others = [c for c in docs.columns if c not in ("doc_id", "text")]
    kept = substrings.keep_first(docs, others=others).where("n_removed = 0 or n_removed < n_words")
    made = [F.col("doc_id"), F.col("kept").alias("text"), *(F.col("others").getField(c).alias(c) for c in others)]
    return _with_text(kept.select(*made), docs)


def secret_scan(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """With every secret replaced by a mark."""
    return _with_text(secrets.redacted(docs), docs)


def curve_packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of sequences of at most 2048 tokens."""
    return packing.pack(docs, tokenizer("byte_bpe_50k.json"))


def _with_text(table: DataFrame, docs: DataFrame) -> DataFrame:
    """The columns of docs, with the length of the new text."""
    length = F.coalesce(F.length("text"), F.lit(0)).cast("long").alias("n_chars")
    return table.select(*(length if c == "n_chars" else quoted(c) for c in docs.columns))


STAGES = [
    ("quality classifier", quality_classifier),
    ("n-gram join", near_duplicates),
    ("substring dedup", substring_dedup),
    ("secret scans", secret_scan),
    ("packing", curve_packing),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents, each written as Parquet and read again by the next."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for number, (_, stage) in enumerate(STAGES, 1):
        docs = stage(spark, docs, sf_dir)
        if number < len(STAGES):
            docs = materialize(docs, f"stage-{number}")
    return docs

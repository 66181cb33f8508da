"""The corpus pipeline: documents in a known language, of sound quality, one of each near-duplicate group, without secrets, packed.

Each stage takes (spark, docs, sf_dir) and gives a DataFrame that is written as Parquet and read again as the next
stage's documents. All but the last return the columns of ``documents``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from chronoweave.llm import common, language_crf, quality_rules, secret_scan, sequence_packing, simhash_dedup


def known_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the language model assigns to no language go."""
    return language_crf.keep_known(docs)


def sound_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that fail the base limits or the compression bands go."""
    return quality_rules.keep_good(docs)


def without_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near duplicates the document of smallest id stays."""
    return simhash_dedup.keep_one_of_each(docs)


def without_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents stay; their secrets are replaced by a mark, and ``n_chars`` follows."""
    return secret_scan.redact_secrets(docs, length_col="n_chars")


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The places of the documents' pieces in sequences of fixed length."""
    return sequence_packing.pack(docs)


STAGES = [
    ("language_id", known_language),
    ("quality_rules", sound_quality),
    ("simhash_dedup", without_copies),
    ("secret_scan", without_secrets),
    ("best_fit_packing", packed),
]
#: The trained language model and the tokenizer have no counterpart in SQL; tests compare with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = common.table(spark, sf_dir, "documents")
    for at, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if at < len(STAGES) - 1:
            docs = common.written(docs, f"pipeline-{name}")
    return docs

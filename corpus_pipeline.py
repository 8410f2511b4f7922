"""Corpus pipeline: quality rules, exact dedup, SimHash near-dedup, secret scans, packing.

Each stage but the last keeps the columns of documents, and any others, whatever their names.
Nulls: a null text is empty; it fails the quality rules. A null doc_id stays null and counts as the least in exact dedup, as the last
in near-dedup; a null source is a source of its own in packing.
Empty texts fail the quality rules; very long ones go through every stage whole. Ties: of equal texts the largest doc_id stays, of a
component the least doc_id, and of equal ids there the least text hash. Repeated rows (same id and text) share one verdict in every stage, so
they stay or go together. Rows of one doc_id with different texts are decided each by its own text. Empty tables give an empty result.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lumencov.llm import common, exact_dedup, packing, quality, secrets_scan, simhash


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the rules or the likelihood ratio reject go."""
    return quality.keep_good(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def exact_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts, the row with the largest doc_id stays."""
    return exact_dedup.drop_exact_duplicates(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each component of SimHash links, the row with the least doc_id stays."""
    return simhash.drop_near_duplicates(docs)


def secret_scans(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Secrets are replaced in the text; n_chars follows."""
    return secrets_scan.redact_secrets(docs).withColumn("n_chars", F.length("text").cast("long"))


def mixture_packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of all documents in sequences that hold the sources' shares."""
    return packing.pack_documents(docs, public_tokenizers.path("byte_bpe_50k.json"), 1)


STAGES = [("quality rules", quality_rules), ("exact dedup", exact_duplicates), ("SimHash near-dedup", near_duplicates), ("secret scans", secret_scans), ("packing", mixture_packing)]

#: SQL can't express the model of the first stage, nor tokenizing; tests hold run() against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages over documents, each written to the shared folder and read again."""
    docs, folder = spark.read.parquet(f"{sf_dir}/documents.parquet"), common.shared_dir(spark)
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k + 1 < len(STAGES):
            docs = common.materialise(docs, folder, f"stage{k}")
    return docs

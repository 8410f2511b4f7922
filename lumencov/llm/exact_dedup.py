"""Operator 3 [native]: exact duplicates, found by skew-safe combining.

Texts are equal when identical. Three stages, each grouping by the whole text besides its digest:

1. each task deduplicates its own rows (the partial aggregate);
2. the local winners meet by (digest, salt, text), where the salt comes from doc_id, so that one
   text with any number of copies is spread over as many keys as there are shuffle partitions;
3. the salt winners of a text, one for each salt at most, meet by (digest, text).

These stages decide what is equal. A document then learns its group by (SHA-256, 64-bit hash, length, salt), so this join is as even
as stage 2; to compare texts here too would shuffle every text a third time, and two texts would have to agree in all three.

Nulls: a null text is the empty text; a null doc_id ranks below every other, so it stays only
where its group has no other id (keep_id is then null and kept true). Repeated rows (same id and text)
count in group_size and get the same answer: all of them are kept if their id is the largest.
Empty texts are equal to each other. An empty table gives an empty result. Extra columns are ignored; the filter keeps them, whatever their
names, and decides row by row: of two rows of one id, each stays or goes by its own text.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import common

_KEY = ["digest", "hash", "length", "salt"]


def _keyed(docs: DataFrame, id_col: str, text_col: str, *more: Column) -> DataFrame:
    own = docs.select(F.col(f"`{id_col}`").cast("long").alias("doc_id"), common.whole_text(text_col).alias("text"), *more)
    kept = [c for c in own.columns if c != "text"]
    return own.select(*kept, "text", F.unhex(F.sha2("text", 256)).alias("digest"), F.xxhash64("text").alias("hash"), F.length("text").alias("length"), F.pmod(F.hash("doc_id"), F.lit(common.salts(docs.sparkSession))).alias("salt"))


def salt_winners(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """A row for each text and salt: the salt's largest id (top), the text's (keep_id) and its rows (group_size)."""
    merged = _keyed(docs, id_col, text_col).groupBy(*_KEY, "text").agg(F.max("doc_id").alias("top"), F.count(F.lit(1)).alias("n"))
    whole = Window.partitionBy("digest", "text")
    return merged.select(*_KEY, "text", "top", F.max("top").over(whole).alias("keep_id"), F.sum("n").over(whole).alias("group_size"))


def exact_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """A row for each document: doc_id, keep_id, group_size, kept, text_sha256."""
    groups = salt_winners(docs, id_col, text_col).select(*_KEY, "keep_id", "group_size")
    rows = _keyed(docs, id_col, text_col).select("doc_id", *_KEY)
    return rows.join(groups, _KEY).select(
        "doc_id", "keep_id", F.col("group_size").cast("long").alias("group_size"), F.col("doc_id").eqNullSafe(F.col("keep_id")).alias("kept"), F.lower(F.hex("digest")).alias("text_sha256")
    )


def drop_exact_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of docs that stay, all columns."""
    groups = salt_winners(docs, id_col, text_col).select(*_KEY, "keep_id")
    rows = _keyed(docs, id_col, text_col, common.whole_row()).drop("text")
    return rows.join(groups, _KEY).where(F.col("doc_id").eqNullSafe(F.col("keep_id"))).select("row.*")


def op3_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_groups(common.documents(spark, sf_dir))


OP3_SQL = """
SELECT doc_id, max(doc_id) OVER g AS keep_id, CAST(count(*) OVER g AS BIGINT) AS group_size,
       doc_id IS NOT DISTINCT FROM max(doc_id) OVER g AS kept, sha256(coalesce(text, '')) AS text_sha256
FROM documents WINDOW g AS (PARTITION BY coalesce(text, ''))
"""

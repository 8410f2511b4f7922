"""Tables, texts and Arrow batches of the llm operators.

Operators with Python tasks set the session's Arrow batch limits (`small_batches`) and leave them so: the limits are read
when a lazy frame is planned, which is after the operator has returned.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..plans.staging import materialise, shared_dir

__all__ = ["documents", "map_arrow", "materialise", "salts", "shared_dir", "small_batches", "whole_row", "whole_text", "with_group"]

#: Rows and bytes of one Arrow batch handed to Python, so that very long texts don't pile up in a worker.
BATCH_ROWS, BATCH_BYTES = 512, 8 << 20


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def whole_text(column: str = "text") -> Column:
    """Null counts as the empty text."""
    return F.coalesce(F.col(f"`{column}`").cast("string"), F.lit(""))


def small_batches(spark: SparkSession) -> None:
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", BATCH_ROWS)
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", BATCH_BYTES)


def map_arrow(df: DataFrame, function: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], schema: str) -> DataFrame:
    """mapInArrow with batches of bounded size."""
    small_batches(df.sparkSession)
    return df.mapInArrow(function, schema)


def whole_row() -> Column:
    """All columns in one, `row`, so that an operator's own columns can't clash with them; select("row.*") gives them back."""
    return F.struct("*").alias("row")


def salts(spark: SparkSession) -> int:
    """Keys over which a hot group is dealt: as many as there are shuffle partitions."""
    return max(16, int(spark.conf.get("spark.sql.shuffle.partitions")))


def with_group(rows: DataFrame, keys: list[str], by: str, part: Column, whole: Callable[[str], Column], name: str) -> DataFrame:
    """rows with `name`, an aggregate of each row's group, where a group may hold a third of all rows.

    A group is dealt over salted keys by the column `by`; `part` aggregates each salt, `whole` the salts of a group. Only one row for each
    salt meets in one place, and rows are joined by (keys, salt).
    """
    salted = rows.withColumn("salt", F.pmod(F.xxhash64(by), F.lit(salts(rows.sparkSession))).cast("int"))
    parts = salted.groupBy(*keys, "salt").agg(part.alias("part"))
    folded = parts.select(*keys, "salt", whole("part").over(Window.partitionBy(*keys)).alias(name))
    return salted.join(folded, [*keys, "salt"]).drop("salt")

"""What a sample says of its line, with its method's complexity."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..plans.store import CoverageStore
from .lists import SAMPLE_KEY

HIT, PARTIAL, MISS, SKIPPED = 2, 1, 0, -1


def is_hit() -> Column:
    return (F.col("hits") > 0) | (F.col("hit_branches") >= F.col("total_branches"))


def is_miss() -> Column:
    return (F.col("hits") == 0) | (F.col("hit_branches") == 0)


def is_partial() -> Column:
    return (F.col("hit_branches") > 0) & (F.col("hit_branches") < F.col("total_branches"))


def status() -> Column:
    """The first that holds of hit, miss and partial; comparisons with null don't hold."""
    return F.when(is_hit(), HIT).when(is_miss(), MISS).when(is_partial(), PARTIAL).otherwise(SKIPPED).cast("long")


def with_complexity(store: CoverageStore) -> DataFrame:
    """Samples with the complexity of their method; a total without paths counts as the paths."""
    method = store.method_data.select(*SAMPLE_KEY, F.col("hit_complexity_paths").alias("__paths"), F.col("total_complexity").alias("__total"))
    return store.coverage_sample.join(method, SAMPLE_KEY, "left").select(
        *store.coverage_sample.columns, F.coalesce("__paths", "__total").alias("hit_complexity_paths"), F.when(F.col("__paths").isNotNull(), F.col("__total")).alias("total_complexity")
    )


def line_status(store: CoverageStore) -> DataFrame:
    """Samples with their status (2 hit, 1 partial, 0 miss, -1 skipped) and complexity."""
    return with_complexity(store).select(*SAMPLE_KEY, "source_file_id", "line_no", "coverage_type", status().alias("coverage_status"), "hit_complexity_paths", "total_complexity")


def count_if(condition: Column) -> Column:
    return F.coalesce(F.count_if(condition), F.lit(0)).cast("long")


def total(value: Column | str) -> Column:
    return F.coalesce(F.sum(value), F.lit(0)).cast("long")

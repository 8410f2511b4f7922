"""Totals of each file."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.formats import coverage_pct
from ..plans.numbering import indexed
from ..plans.store import CoverageStore
from .status import HIT, MISS, PARTIAL, count_if, line_status, total


def chunk_index(store: CoverageStore) -> DataFrame:
    """Files with their place in the order of ids, from 0, whether or not they have samples."""
    return indexed(store.source_file, "chunk_index").select("chunk_index", "id", "path")


def flattened_lines(store: CoverageStore) -> DataFrame:
    """One row for each (file, line, type): the best status and largest complexity of any upload."""
    return line_status(store).groupBy("source_file_id", "line_no", "coverage_type").agg(
        F.max("coverage_status").alias("coverage_status"), F.max("hit_complexity_paths").alias("hit_complexity_paths"), F.max("total_complexity").alias("total_complexity")
    )


def file_totals(store: CoverageStore) -> DataFrame:
    """Totals of each file with samples. Lines are summed by file id before the files' names are joined."""
    status, kind = F.col("coverage_status"), F.col("coverage_type")
    summed = flattened_lines(store).groupBy(F.col("source_file_id").alias("id")).agg(
        F.count(F.lit(1)).alias("file_lines"), count_if(status == HIT).alias("file_hits"), count_if(status == MISS).alias("file_misses"), count_if(status == PARTIAL).alias("file_partials"),
        count_if(kind == "b").alias("file_branches"), count_if(kind == "m").alias("file_methods"), total("hit_complexity_paths").alias("file_hit_complexity_paths"), total("total_complexity").alias("file_total_complexity"),
    )
    return summed.join(chunk_index(store), "id").select("chunk_index", "id", "path", *summed.columns[1:])


def file_coverage(store: CoverageStore) -> DataFrame:
    """Path and coverage percentage of each file."""
    return file_totals(store).select("chunk_index", "path", coverage_pct(F.col("file_hits"), F.col("file_lines")).alias("coverage_pct"))

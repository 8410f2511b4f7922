"""Totals of each upload."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..plans.numbering import indexed
from ..plans.schema import columns
from ..plans.store import CoverageStore
from .status import count_if, is_hit, is_miss, is_partial, total, with_complexity


def session_index(store: CoverageStore) -> DataFrame:
    """Uploads with their place in the order of ids, from 0, whether or not they have samples."""
    return indexed(store.raw_upload.select("id"), "session_index").select("session_index", "id")


def session_totals(store: CoverageStore) -> DataFrame:
    """Totals of each upload with samples, and its attributes.

    Samples are counted by (upload, file) first: this spreads an upload that holds a large part of all
    samples over its files, and makes the number of distinct files a plain count.
    """
    kind = F.col("coverage_type")
    by_file = with_complexity(store).groupBy("raw_upload_id", "source_file_id").agg(
        F.count(F.lit(1)).alias("lines"), count_if(is_hit()).alias("hits"), count_if(is_miss()).alias("misses"), count_if(is_partial()).alias("partials"), count_if(kind == "b").alias("branches"),
        count_if(kind == "m").alias("methods"), total("hit_complexity_paths").alias("paths"), total("total_complexity").alias("complexity"),
    )
    summed = by_file.groupBy(F.col("raw_upload_id").alias("id")).agg(
        F.count("source_file_id").alias("session_files"), total("lines").alias("session_lines"), total("hits").alias("session_hits"), total("misses").alias("session_misses"), total("partials").alias("session_partials"),
        total("branches").alias("session_branches"), total("methods").alias("session_methods"), total("paths").alias("session_hit_complexity_paths"), total("complexity").alias("session_total_complexity"),
    )
    named = session_index(store).join(store.raw_upload, "id")
    return summed.join(named, "id").select(F.col("session_index").cast("string").alias("session_index"), "id", *summed.columns[1:], *columns("raw_upload")[1:])

"""Totals of a whole store in one row."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..plans.store import CoverageStore
from .lists import SAMPLE_KEY
from .status import count_if, total


def totals(store: CoverageStore) -> DataFrame:
    """Counts of files, uploads and contexts, and sums over samples; zeros for an empty store.

    Samples and methods are summed apart: a sum over the methods of method samples is what their
    left join would give, so only those samples meet their methods.
    """
    kind = F.col("coverage_type")
    samples = store.coverage_sample.agg(
        count_if((kind == "l") & (F.col("hits") > 0)).alias("hit_lines"), count_if(kind == "l").alias("total_lines"),
        total(F.when(kind == "b", F.col("hit_branches"))).alias("hit_branches"), total(F.when(kind == "b", F.col("total_branches"))).alias("total_branches"), count_if(kind == "b").alias("total_branch_roots"),
    )
    methods = (
        store.coverage_sample.where(kind == "m").select(*SAMPLE_KEY, "hits").join(store.method_data.select(*SAMPLE_KEY, "hit_complexity_paths", "total_complexity"), SAMPLE_KEY, "left")
        .agg(count_if(F.col("hits") > 0).alias("hit_methods"), count_if(F.lit(True)).alias("total_methods"), total("hit_complexity_paths").alias("hit_complexity_paths"), total("total_complexity").alias("total_complexity"))
    )
    counts = [df.agg(F.count(F.lit(1)).alias(name)) for df, name in ((store.source_file, "file_count"), (store.raw_upload, "upload_count"), (store.context, "test_case_count"))]
    out = counts[0]
    for one_row in (*counts[1:], samples, methods):
        out = out.crossJoin(one_row)  # one row each
    return out

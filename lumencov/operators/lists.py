"""Listings and look-ups. Look-ups take a frame of keys, so that any number is one join."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..plans.schema import columns
from ..plans.store import CoverageStore

SAMPLE_KEY = ["raw_upload_id", "local_sample_id"]


def list_files(store: CoverageStore) -> DataFrame:
    return store.source_file.select("id", "path")


def list_contexts(store: CoverageStore) -> DataFrame:
    return store.context.select("id", "name")


def list_raw_uploads(store: CoverageStore) -> DataFrame:
    return store.raw_upload.select(*columns("raw_upload"))


def list_coverage_samples(store: CoverageStore) -> DataFrame:
    """All samples by (local_sample_id, source_file_id)."""
    return store.coverage_sample.select(*columns("coverage_sample")).orderBy("local_sample_id", "source_file_id")


def _of_samples(table: DataFrame, samples: DataFrame) -> DataFrame:
    return table.join(samples.select(*SAMPLE_KEY).distinct(), SAMPLE_KEY, "left_semi")


def branches_for_samples(store: CoverageStore, samples: DataFrame) -> DataFrame:
    return _of_samples(store.branches_data, samples).select(*columns("branches_data"))


def methods_for_samples(store: CoverageStore, samples: DataFrame) -> DataFrame:
    """At most one method row for each sample: that of the least local_method_id."""
    rows = _of_samples(store.method_data, samples)
    first = F.min_by(F.struct(*[F.col(c) for c in columns("method_data")]), "local_method_id")
    return rows.groupBy(*SAMPLE_KEY).agg(first.alias("m")).select("m.*")


def spans_for_samples(store: CoverageStore, samples: DataFrame) -> DataFrame:
    return _of_samples(store.span_data, samples).select(*columns("span_data"))


def contexts_for_samples(store: CoverageStore, samples: DataFrame) -> DataFrame:
    """The contexts of each sample: its key, id and name."""
    assoc = _of_samples(store.context_assoc, samples).select(*SAMPLE_KEY, F.col("context_id").alias("id"))
    return assoc.join(store.context, "id").select(*SAMPLE_KEY, "id", "name")


def samples_for_files(store: CoverageStore, files: DataFrame) -> DataFrame:
    """Samples of the files (by id) that the store knows."""
    known = store.source_file.join(files.select("id").distinct(), "id", "left_semi").select(F.col("id").alias("source_file_id"))
    return store.coverage_sample.join(known, "source_file_id", "left_semi").select(*columns("coverage_sample"))

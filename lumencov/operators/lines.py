"""Detail of each line and upload, with the line's totals over uploads."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..plans.store import CoverageStore
from .files import chunk_index
from .lists import SAMPLE_KEY
from .sessions import session_index


def missing_branches(store: CoverageStore) -> DataFrame:
    """JSON list of the branches that a sample missed, sorted; samples that missed none have no row."""
    return store.branches_data.where("hits = 0").groupBy(*SAMPLE_KEY).agg(F.to_json(F.array_sort(F.collect_list("branch"))).alias("missing_branches"))


def line_partials(store: CoverageStore) -> DataFrame:
    """JSON list of a sample's spans, [start column, end column, hits], in the order of their ids."""
    span = F.struct("local_span_id", F.array("start_col", "end_col", "hits").alias("s"))
    ordered = F.transform(F.array_sort(F.collect_list(span)), lambda x: x["s"])
    return store.span_data.where("local_sample_id IS NOT NULL").groupBy(*SAMPLE_KEY).agg(F.to_json(ordered).alias("partials"))


def line_labels(store: CoverageStore) -> DataFrame:
    """JSON list of the names of a sample's contexts, sorted, each once."""
    named = store.context_assoc.where("local_sample_id IS NOT NULL").join(store.context, F.col("context_id") == F.col("id"))
    return named.groupBy(*SAMPLE_KEY).agg(F.to_json(F.array_sort(F.collect_set("name"))).alias("labels"))


def present_sessions(store: CoverageStore) -> DataFrame:
    """JSON list of the indices of the uploads that cover each file."""
    pairs = store.coverage_sample.select("source_file_id", "raw_upload_id").distinct()
    seen = pairs.join(session_index(store), F.col("raw_upload_id") == F.col("id")).groupBy("source_file_id").agg(F.array_sort(F.collect_list("session_index")).alias("s"))
    files = chunk_index(store).join(seen, F.col("id") == F.col("source_file_id"), "left")
    return files.select("chunk_index", F.col("id").alias("source_file_id"), F.coalesce(F.to_json("s"), F.lit("[]")).alias("present_sessions"))


_SUMMED = ["hits", "hit_branches", "total_branches", "hit_complexity_paths", "total_complexity"]


def samples_with_children(store: CoverageStore) -> DataFrame:
    """Samples, each of their children brought down to one value before it is joined."""
    method = store.method_data.groupBy(*SAMPLE_KEY).agg(F.max("hit_complexity_paths").alias("hit_complexity_paths"), F.max("total_complexity").alias("total_complexity"))
    rows = store.coverage_sample
    for child in (method, missing_branches(store), line_partials(store), line_labels(store)):
        rows = rows.join(child, SAMPLE_KEY, "left")
    return rows


def sessions_of_lines(store: CoverageStore) -> DataFrame:
    """A row for each (file, line, upload), each of a sample's children brought down to one value before it is joined.

    Of several samples there, the one with the least id counts. Sums over a line's uploads are windows over the rows
    themselves, on the same partitioning that the choice of samples uses.
    """
    rows = samples_with_children(store)
    line = Window.partitionBy("source_file_id", "line_no")
    first = F.row_number().over(Window.partitionBy("source_file_id", "line_no", "raw_upload_id").orderBy("local_sample_id"))
    placed = rows.repartition("source_file_id", "line_no").withColumn("__n", first).where("__n = 1")
    summed = placed.select("*", *[F.sum(c).over(line).alias(f"report_line_{c}") for c in _SUMMED])
    sessions = session_index(store).withColumnRenamed("id", "raw_upload_id")
    files = chunk_index(store).select("chunk_index", F.col("id").alias("source_file_id"))
    return summed.join(files, "source_file_id").join(sessions, "raw_upload_id").select(
        "chunk_index", "line_no", "coverage_type", *[f"report_line_{c}" for c in _SUMMED], "session_index", *_SUMMED, "missing_branches", "partials", "labels"
    )


def line_sessions(store: CoverageStore) -> DataFrame:
    """sessions_of_lines with the list of the file's uploads in every row."""
    present = present_sessions(store).select("chunk_index", "present_sessions")
    return sessions_of_lines(store).join(present, "chunk_index").select(
        "chunk_index", "line_no", "coverage_type", *[f"report_line_{c}" for c in _SUMMED], "session_index", "present_sessions", *_SUMMED, "missing_branches", "partials", "labels"
    )


def report_line_totals(store: CoverageStore) -> DataFrame:
    """Sums over the uploads of each line."""
    return sessions_of_lines(store).select("chunk_index", "line_no", *[F.col(f"report_line_{c}").alias(c) for c in _SUMMED]).distinct()

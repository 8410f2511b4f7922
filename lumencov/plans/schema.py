"""Tables of a coverage store. All ids and counters are signed 64-bit integers."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

TABLES = {
    "source_file": "id long, path string",
    "raw_upload": "id long, timestamp long, raw_upload_url string, flags string, provider string, build string, name string, job_name string, ci_run_url string, state string, env string, session_type string, session_extras string",
    "context": "id long, name string",
    "context_assoc": "context_id long, raw_upload_id long, local_sample_id long, local_span_id long",
    "coverage_sample": "raw_upload_id long, local_sample_id long, source_file_id long, line_no long, coverage_type string, hits long, hit_branches long, total_branches long",
    "branches_data": "raw_upload_id long, local_sample_id long, local_branch_id long, source_file_id long, hits long, branch_format string, branch string",
    "method_data": "raw_upload_id long, local_sample_id long, local_method_id long, source_file_id long, line_no long, hit_branches long, total_branches long, hit_complexity_paths long, total_complexity long",
    "span_data": "raw_upload_id long, local_sample_id long, local_span_id long, source_file_id long, hits long, start_line long, start_col long, end_line long, end_col long",
}

#: Key columns of each table; where one is null (context_assoc), rows may repeat.
KEYS = {
    "source_file": ["id"],
    "raw_upload": ["id"],
    "context": ["id"],
    "context_assoc": ["context_id", "raw_upload_id", "local_sample_id", "local_span_id"],
    "coverage_sample": ["raw_upload_id", "local_sample_id"],
    "branches_data": ["raw_upload_id", "local_branch_id"],
    "method_data": ["raw_upload_id", "local_method_id"],
    "span_data": ["raw_upload_id", "local_span_id"],
}

# Fixed values of the stored enumerations.
COVERAGE_TYPES = {"l": "line", "b": "branch", "m": "method"}
BRANCH_FORMATS = {"l": "line", "c": "condition", "bb": "block and branch"}

DIMENSIONS = ("source_file", "raw_upload", "context")
FACTS = ("coverage_sample", "branches_data", "method_data", "span_data", "context_assoc")


def columns(table: str) -> list[str]:
    return [c.split()[0] for c in TABLES[table].split(", ")]


def conform(df: DataFrame, table: str) -> DataFrame:
    """The table's columns in order and type; columns that df lacks are null."""
    kinds = dict(c.split() for c in TABLES[table].split(", "))
    return df.select(*[(F.col(c) if c in df.columns else F.lit(None)).cast(k).alias(c) for c, k in kinds.items()])


def violations(df: DataFrame, table: str) -> DataFrame:
    """Keys that occur more than once (all parts non-null), as a frame of key columns and n."""
    keys = KEYS[table]
    whole = df
    for k in keys:
        whole = whole.where(F.col(k).isNotNull())
    return whole.groupBy(*keys).agg(F.count(F.lit(1)).alias("n")).where("n > 1")


def unknown_codes(df: DataFrame, table: str) -> DataFrame:
    """Rows whose enumeration column holds a value that isn't one of its codes."""
    if table == "coverage_sample":
        return df.where(~F.col("coverage_type").isin(*COVERAGE_TYPES) | F.col("coverage_type").isNull())
    if table == "branches_data":
        return df.where(~F.col("branch_format").isin(*BRANCH_FORMATS) | F.col("branch_format").isNull())
    return df.limit(0)

"""A coverage store seen in the tables part, supplier, orders and lineitem."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..plans.numbering import dense_numbers
from ..plans.staging import staged
from ..plans.store import CoverageStore

_ORDER = ["l_orderkey", "l_linenumber", "l_partkey", "l_quantity", "l_extendedprice", "l_discount", "l_tax", "l_shipdate"]


def _lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """lineitem as samples: one for each row, numbered within its supplier in ranges of orders, so that a large supplier is no single task's work."""
    numbered = dense_numbers(spark.read.parquet(f"{sf_dir}/lineitem.parquet"), "l_suppkey", F.expr("l_orderkey div 65536"), _ORDER, "local_sample_id")
    line = F.col("l_linenumber").cast("long")
    kind = F.when(F.col("l_returnflag") == "N", "l").when(F.col("l_returnflag") == "A", "b").otherwise("m")
    return numbered.select(
        "l_orderkey", line.alias("n"), F.col("l_suppkey").cast("long").alias("raw_upload_id"), "local_sample_id", F.col("l_partkey").cast("long").alias("source_file_id"), F.col("l_quantity").cast("long").alias("line_no"),
        kind.alias("coverage_type"), F.when(kind != "b", line - 1).alias("hits"), F.when(kind == "b", F.least(line - 1, F.lit(4).cast("long"))).alias("hit_branches"), F.when(kind == "b", F.lit(4).cast("long")).alias("total_branches"),
    )


def load(spark: SparkSession, sf_dir: str, staging: str | None = None) -> CoverageStore:
    """The store. With `staging`, a folder, the numbered lines are written there once, for work that reads them many times."""
    lines, null = staged(_lines(spark, sf_dir), staging, "lines"), F.lit(None).cast("long")
    samples = lines.drop("l_orderkey", "n")
    branches = lines.where("coverage_type = 'b'").select("*", F.explode(F.array(*[F.lit(k).cast("long") for k in range(4)])).alias("k"))
    orders = spark.read.parquet(f"{sf_dir}/orders.parquet")
    part, supplier = spark.read.parquet(f"{sf_dir}/part.parquet"), spark.read.parquet(f"{sf_dir}/supplier.parquet")
    context = F.substring("o_orderpriority", 1, 1).cast("long")
    return CoverageStore.of(
        source_file=part.select(F.col("p_partkey").cast("long").alias("id"), F.concat(F.lit("src/"), F.lower("p_type"), F.lit("/"), F.col("p_partkey").cast("string"), F.lit(".rs")).alias("path")),
        raw_upload=supplier.select(
            F.col("s_suppkey").cast("long").alias("id"), (F.lit(1_700_000_000) + F.col("s_suppkey")).cast("long").alias("timestamp"), F.concat(F.lit('["nation-'), F.col("s_nationkey").cast("string"), F.lit('"]')).alias("flags"),
            F.col("s_name").alias("name"), F.concat(F.lit("job-"), (F.col("s_suppkey") % 7).cast("string")).alias("job_name"), F.lit("uploaded").alias("session_type"), F.lit("{}").alias("session_extras"),
        ),
        context=orders.select("o_orderpriority").distinct().select(context.alias("id"), F.col("o_orderpriority").alias("name")),
        context_assoc=lines.join(orders.select("o_orderkey", "o_orderpriority"), F.col("l_orderkey") == F.col("o_orderkey")).select(context.alias("context_id"), "raw_upload_id", "local_sample_id"),
        coverage_sample=samples,
        branches_data=branches.select(
            "raw_upload_id", "local_sample_id", (F.col("local_sample_id") * 4 + F.col("k")).alias("local_branch_id"), "source_file_id", (F.col("k") < F.col("hit_branches")).cast("long").alias("hits"), F.lit("l").alias("branch_format"), F.col("k").cast("string").alias("branch")
        ),
        method_data=lines.where("coverage_type = 'm' AND n % 5 <> 0").select(
            "raw_upload_id", "local_sample_id", F.col("local_sample_id").alias("local_method_id"), "source_file_id", "line_no", F.when(F.col("n") % 3 != 0, F.col("n") - 1).alias("hit_complexity_paths"), (F.col("n") + 1).alias("total_complexity")
        ),
        span_data=lines.where("coverage_type = 'l' AND n % 3 = 0").select(
            "raw_upload_id", "local_sample_id", F.col("local_sample_id").alias("local_span_id"), "source_file_id", "hits", F.col("line_no").alias("start_line"), F.col("n").alias("start_col"), F.col("line_no").alias("end_line"), F.when(F.col("n") % 2 != 0, F.col("n") + 10).otherwise(null).alias("end_col")
        ),
    )


#: The same mapping as common table expressions of DuckDB.
SQL = """
lines AS (
  SELECT l_orderkey, CAST(l_linenumber AS BIGINT) AS n, CAST(l_suppkey AS BIGINT) AS raw_upload_id,
    row_number() OVER (PARTITION BY l_suppkey ORDER BY l_orderkey, l_linenumber, l_partkey, l_quantity, l_extendedprice, l_discount, l_tax, l_shipdate) - 1 AS local_sample_id,
    CAST(l_partkey AS BIGINT) AS source_file_id, CAST(l_quantity AS BIGINT) AS line_no,
    CASE l_returnflag WHEN 'N' THEN 'l' WHEN 'A' THEN 'b' ELSE 'm' END AS coverage_type,
    CASE WHEN l_returnflag <> 'A' THEN CAST(l_linenumber AS BIGINT) - 1 END AS hits,
    CASE WHEN l_returnflag = 'A' THEN least(CAST(l_linenumber AS BIGINT) - 1, 4) END AS hit_branches,
    CASE WHEN l_returnflag = 'A' THEN CAST(4 AS BIGINT) END AS total_branches
  FROM lineitem),
coverage_sample AS (SELECT raw_upload_id, local_sample_id, source_file_id, line_no, coverage_type, hits, hit_branches, total_branches FROM lines),
source_file AS (SELECT CAST(p_partkey AS BIGINT) AS id, 'src/' || lower(p_type) || '/' || p_partkey || '.rs' AS path FROM part),
raw_upload AS (
  SELECT CAST(s_suppkey AS BIGINT) AS id, CAST(1700000000 + s_suppkey AS BIGINT) AS "timestamp", CAST(NULL AS VARCHAR) AS raw_upload_url, '["nation-' || s_nationkey || '"]' AS flags, CAST(NULL AS VARCHAR) AS provider,
    CAST(NULL AS VARCHAR) AS build, s_name AS name, 'job-' || (s_suppkey % 7) AS job_name, CAST(NULL AS VARCHAR) AS ci_run_url, CAST(NULL AS VARCHAR) AS state, CAST(NULL AS VARCHAR) AS env, 'uploaded' AS session_type, '{}' AS session_extras
  FROM supplier),
context AS (SELECT DISTINCT CAST(substr(o_orderpriority, 1, 1) AS BIGINT) AS id, o_orderpriority AS name FROM orders),
context_assoc AS (
  SELECT CAST(substr(o_orderpriority, 1, 1) AS BIGINT) AS context_id, raw_upload_id, local_sample_id, CAST(NULL AS BIGINT) AS local_span_id
  FROM lines JOIN orders ON l_orderkey = o_orderkey),
branches_data AS (
  SELECT raw_upload_id, local_sample_id, local_sample_id * 4 + k AS local_branch_id, source_file_id, CAST(k < hit_branches AS BIGINT) AS hits, 'l' AS branch_format, CAST(k AS VARCHAR) AS branch
  FROM lines, (SELECT CAST(range AS BIGINT) AS k FROM range(4)) WHERE coverage_type = 'b'),
method_data AS (
  SELECT raw_upload_id, local_sample_id, local_sample_id AS local_method_id, source_file_id, line_no, CAST(NULL AS BIGINT) AS hit_branches, CAST(NULL AS BIGINT) AS total_branches,
    CASE WHEN n % 3 <> 0 THEN n - 1 END AS hit_complexity_paths, n + 1 AS total_complexity
  FROM lines WHERE coverage_type = 'm' AND n % 5 <> 0),
span_data AS (
  SELECT raw_upload_id, local_sample_id, local_sample_id AS local_span_id, source_file_id, hits, line_no AS start_line, n AS start_col, line_no AS end_line, CASE WHEN n % 2 <> 0 THEN n + 10 END AS end_col
  FROM lines WHERE coverage_type = 'l' AND n % 3 = 0)
"""

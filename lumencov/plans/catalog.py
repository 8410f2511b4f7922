"""Queries of the coverage engine over the driver's tables, by name."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import formats, parsing
from ..operators import files, labels, lines, lists, sessions, status, totals
from ..sources import report_reader, report_writer, star_schema
from . import numbering, schema
from .staging import discard, shared_dir, staged
from .store import CoverageStore

Query = Callable[[SparkSession, str], DataFrame]


def _on(operator: Callable[[CoverageStore], DataFrame]) -> Query:
    return lambda spark, sf_dir: operator(star_schema.load(spark, sf_dir))


def _of_all_samples(operator: Callable[[CoverageStore, DataFrame], DataFrame]) -> Query:
    """A look-up for every sample of the store."""
    return _on(lambda store: operator(store, store.coverage_sample))


def _merged(table: str) -> Query:
    """The store cut in two by upload and merged again; both halves know all files and every fifth upload."""

    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        own = star_schema.load(spark, sf_dir)
        half = lambda odd: CoverageStore(**{n: df.where(F.col("id" if n == "raw_upload" else "raw_upload_id") % 2 == odd) if n not in ("source_file", "context", "raw_upload") else df.where((F.col("id") % 2 == odd) | (F.col("id") % 5 == 0)) for n, df in own.tables().items()})
        return getattr(half(0).merge(half(1)), table)

    return query


def _written(table: str) -> Query:
    """A table written by the store's atomic write and read back."""

    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        own = getattr(star_schema.load(spark, sf_dir), table)
        return getattr(CoverageStore.of(**{table: own}).write(f"{shared_dir(spark)}/store"), table)

    return query


def _appended(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Samples of one half of the uploads written, those of the other appended, and all read back."""
    own, path = star_schema.load(spark, sf_dir), f"{shared_dir(spark)}/store"
    half = lambda odd: CoverageStore.of(raw_upload=own.raw_upload.where(F.col("id") % 2 == odd), source_file=own.source_file, coverage_sample=own.coverage_sample.where(F.col("raw_upload_id") % 2 == odd))
    first = half(0).write(path)
    first.append(half(1), path)
    again = CoverageStore.read(spark, path)
    return again.coverage_sample.join(again.source_file.select(F.col("id").alias("source_file_id")), "source_file_id").select(*own.coverage_sample.columns)  # a file that was added twice would double its samples


def _inserted(table: str, column: str) -> Query:
    """Files or contexts inserted into an empty store by name, with hashed ids."""

    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        names = getattr(star_schema.load(spark, sf_dir), table).select(column).distinct()
        empty = CoverageStore.empty(spark)
        return getattr(empty.insert_files(names) if column == "path" else empty.insert_contexts(names), table).select(column)

    return query


def _chunk_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The chunks that the writer makes of the store, as a parser's input: (report, chunk_index, chunk)."""
    folder = shared_dir(spark)
    return report_writer.chunks_text(star_schema.load(spark, sf_dir, folder), folder).select(F.lit("r").alias("report"), "chunk_index", "chunk")


def _parsed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return report_reader.parse_line_sessions(report_reader.parse_report_lines(_chunk_texts(spark, sf_dir))).where("error IS NULL")


_SESSION = ["chunk_index", "line_no", "session_index"]


def _parse_line_sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _parsed(spark, sf_dir).select(*_SESSION, "coverage_type", "hits", "hit_branches", "total_branches", "hit_complexity_paths", "total_complexity")


def _parse_missing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return report_reader.exploded_branches(_parsed(spark, sf_dir)).select(*_SESSION, "branch_format", "branch")


def _parse_partials(spark: SparkSession, sf_dir: str) -> DataFrame:
    return report_reader.exploded_partials(_parsed(spark, sf_dir)).select(*_SESSION, "span.start_col", "span.end_col", "span.hits")


def _header_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    head = labels.labels_header(star_schema.load(spark, sf_dir))
    return head.select(F.lit("r").alias("report"), F.concat("header", F.lit(report_reader.HEADER_END), F.lit("null")).alias("value"))


def _parse_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    index = staged(report_reader.parse_labels_index(_header_text(spark, sf_dir)), shared_dir(spark), "labels")
    return report_reader.exploded_labels(_parsed(spark, sf_dir), index).select(*_SESSION, "label")


def _json_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return report_writer.report_json(star_schema.load(spark, sf_dir)).select(F.lit("r").alias("report"), F.col("report_json").alias("value"))


def _parse_sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return report_reader.parse_report_sessions(_json_text(spark, sf_dir)).select("session_index", "timestamp", "flags", "name", "job_name", "session_type", "session_extras")


def _written_report(spark: SparkSession, sf_dir: str) -> tuple[str, str]:
    """Folders of the store's two documents, as files."""
    folder = shared_dir(spark)
    steps = f"{folder}/steps"
    report_writer.write_report(star_schema.load(spark, sf_dir, steps), f"{folder}/json", f"{folder}/chunks", staging=steps, compression="gzip")
    discard(spark, steps)
    return f"{folder}/json", f"{folder}/chunks"


def _read_again(spark: SparkSession, sf_dir: str) -> CoverageStore:
    """The store written as a report's files and read again."""
    return report_reader.parse_report(spark, *_written_report(spark, sf_dir), staging=shared_dir(spark)).store


def _parse_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Totals of the store that was read again."""
    again = _read_again(spark, sf_dir)
    keep = ["hit_lines", "total_lines", "hit_branches", "total_branches", "hit_methods", "total_methods"]
    complexity = again.method_data.agg(status.total("hit_complexity_paths").alias("hit_complexity_paths"), status.total("total_complexity").alias("total_complexity"))
    return totals.totals(again).select(F.col("file_count").alias("files"), *keep).crossJoin(complexity)


def _explode_models(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows of each fact table that was read again."""
    again = _read_again(spark, sf_dir)
    counts = [getattr(again, t).agg(F.lit(t).alias("table"), F.count(F.lit(1)).alias("n")) for t in schema.FACTS]
    out = counts[0]
    for df in counts[1:]:
        out = out.unionByName(df)
    return out


#: What a fact says besides where it stands.
_SAID = {
    "coverage_sample": ["coverage_type", "hits", "hit_branches", "total_branches"], "branches_data": ["hits", "branch_format", "branch"], "method_data": ["hit_complexity_paths", "total_complexity"],
    "span_data": ["hits", "start_line", "start_col", "end_line", "end_col"], "context_assoc": ["label"],
}


def _reread(table: str) -> Query:
    """Every row of a fact table that was read again, by path, name of the upload and line, as ids are new."""

    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        again = _read_again(spark, sf_dir)
        files = again.source_file.select(F.col("id").alias("source_file_id"), "path")
        uploads = again.raw_upload.select(F.col("id").alias("raw_upload_id"), F.col("name").alias("upload"))
        samples = again.coverage_sample.join(files, "source_file_id").join(uploads, "raw_upload_id")
        if table == "coverage_sample":
            return samples.select("path", "upload", "line_no", *_SAID[table])
        facts = getattr(again, table)
        if table == "context_assoc":
            facts = facts.join(again.context.select(F.col("id").alias("context_id"), F.col("name").alias("label")), "context_id")
        placed = samples.select(*lists.SAMPLE_KEY, "path", "upload", "line_no").join(facts.select(*lists.SAMPLE_KEY, *_SAID[table]), lists.SAMPLE_KEY)
        return placed.drop(*lists.SAMPLE_KEY)

    return query


def _parse_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Chunks of the written files, but for the line feed that ends the last."""
    return report_reader.read_chunks(spark, _written_report(spark, sf_dir)[1], F.lit("r")).select("chunk_index", F.regexp_replace("chunk", r"\n$", "").alias("chunk"))


def _to_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = star_schema.load(spark, sf_dir)
    return report_writer.report_json(own).crossJoin(report_writer.chunks_document(own).select(F.col("value").alias("chunks")))


def _assign_local_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Samples numbered within their upload in buckets of the first sort key."""
    order = ["l_orderkey", "l_linenumber", "l_partkey", "l_quantity", "l_extendedprice", "l_discount", "l_tax", "l_shipdate"]
    rows = numbering.dense_numbers(spark.read.parquet(f"{sf_dir}/lineitem.parquet"), "l_suppkey", F.expr("l_orderkey div 1024"), order, "local_sample_id")
    return rows.select(F.col("l_suppkey").cast("long").alias("raw_upload_id"), "local_sample_id", F.col("l_partkey").cast("long").alias("source_file_id"), F.col("l_quantity").cast("long").alias("line_no"))


def _parse_value(text: Callable[[CoverageStore], DataFrame], parse: Callable) -> Query:
    """A value written as JSON and read again: the sample's key and the parsed fields."""

    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        rows = text(star_schema.load(spark, sf_dir)).select(*lists.SAMPLE_KEY, parse(F.get(parsing.slots(parsing.mark_strings(F.concat(F.lit("["), F.col("value"), F.lit("]")))), 0)).alias("x"))
        return rows.select(*lists.SAMPLE_KEY, "x.*") if rows.schema["x"].dataType.typeName() == "struct" else rows.withColumnRenamed("x", "coverage_type")

    return query


def _normalize(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every kind of coverage value against every type."""
    samples = star_schema.load(spark, sf_dir).coverage_sample
    kind = F.element_at(F.array(F.lit("hits"), F.lit("branches"), F.lit("partial")), (F.col("local_sample_id") % 3 + 1).cast("int"))
    value = F.when((F.col("coverage_type") == "b") & (kind == "hits"), F.col("line_no") % 3).otherwise(F.col("line_no"))
    cov = F.struct(kind.alias("kind"), value.alias("a"), F.lit(4).cast("long").alias("b"))
    return samples.select(*lists.SAMPLE_KEY, parsing.normalized(cov, F.col("coverage_type")).alias("n")).select(*lists.SAMPLE_KEY, "n.coverage_type", "n.hits", "n.hit_branches", "n.total_branches")


def queries() -> dict[str, Query]:
    out: dict[str, Query] = {f"scan_{t}": _on(lambda s, t=t: getattr(s, t)) for t in schema.TABLES}
    out |= {
        "list_files": _on(lists.list_files), "list_contexts": _on(lists.list_contexts), "list_raw_uploads": _on(lists.list_raw_uploads), "list_coverage_samples": _on(lists.list_coverage_samples),
        "branches_for_samples": _of_all_samples(lists.branches_for_samples), "methods_for_samples": _of_all_samples(lists.methods_for_samples), "spans_for_samples": _of_all_samples(lists.spans_for_samples), "contexts_for_samples": _of_all_samples(lists.contexts_for_samples),
        "samples_for_files": _on(lambda s: lists.samples_for_files(s, s.source_file)),
        "totals": _on(totals.totals), "line_status": _on(status.line_status), "flattened_lines": _on(files.flattened_lines), "chunk_index": _on(files.chunk_index), "file_totals": _on(files.file_totals), "coverage_pct": _on(files.file_coverage),
        "session_index": _on(sessions.session_index), "session_totals": _on(sessions.session_totals),
        "line_sessions": _on(lines.line_sessions), "report_line_totals": _on(lines.report_line_totals), "present_sessions": _on(lines.present_sessions), "missing_branches": _on(lines.missing_branches), "line_partials": _on(lines.line_partials), "line_labels": _on(lines.line_labels),
        "label_index": _on(labels.label_index), "labels_index": _on(labels.labels_header),
        "merge_dims": _merged("raw_upload"), "merge_facts": _merged("coverage_sample"), **{f"merge_{t}": _merged(t) for t in schema.TABLES if t not in ("raw_upload", "coverage_sample")},
        **{f"write_{t}": _written(t) for t in schema.TABLES}, "append_store": _appended, "insert_files": _inserted("source_file", "path"), "insert_contexts": _inserted("context", "name"),
        "format_coverage": _on(lambda s: s.coverage_sample.select(*lists.SAMPLE_KEY, formats.format_coverage(F.col("hits"), F.col("hit_branches"), F.col("total_branches")).alias("coverage"), formats.format_type(F.col("coverage_type")).alias("type"))),
        "format_complexity": _on(lambda s: s.method_data.select(*lists.SAMPLE_KEY, formats.format_complexity(F.col("hit_complexity_paths"), F.col("total_complexity")).alias("complexity"))),
        "strip_trailing_nulls": _on(lambda s: s.span_data.select(*lists.SAMPLE_KEY, formats.trimmed_array([F.col("start_col").cast("string"), F.col("hits").cast("string"), F.lit("null"), F.col("end_col").cast("string")]).alias("trimmed"))),
        "normalize_coverage": _normalize,
        "report_json_files": _on(report_writer.report_json_files), "report_json_sessions": _on(report_writer.report_json_sessions), "report_json": _on(report_writer.report_json),
        "report_lines": _on(lambda s: report_writer.report_lines(s).select("chunk_index", "line_no", "line")), "chunks_text": _on(report_writer.chunks_text),
        "parse_line_sessions": _parse_line_sessions, "parse_missing_branches": _parse_missing, "parse_partials": _parse_partials, "parse_labels": _parse_labels,
        "parse_labels_index": lambda spark, d: report_reader.parse_labels_index(_header_text(spark, d)).select("label", "name"),
        "parse_report_json": lambda spark, d: report_reader.parse_report_files(_json_text(spark, d)).select("chunk_index", "path"), "parse_sessions": _parse_sessions,
        "parse_report": _parse_report, "explode_models": _explode_models, "parse_chunks": _parse_chunks, "to_report": _to_report, "assign_local_ids": _assign_local_ids,
        **{f"reread_{t}": _reread(t) for t in _SAID}, "reread_source_file": lambda spark, d: _read_again(spark, d).source_file.select("path"), "reread_context": lambda spark, d: _read_again(spark, d).context.select("name"),
        "reread_raw_upload": lambda spark, d: _read_again(spark, d).raw_upload.drop("id"),
        "parse_report_lines": lambda spark, d: report_reader.parse_report_lines(_chunk_texts(spark, d)).select("chunk_index", "line_no", "raw"),
        "parse_coverage": _parse_value(lambda s: s.coverage_sample.withColumn("value", formats.format_coverage(F.col("hits"), F.col("hit_branches"), F.col("total_branches"))), parsing.coverage),
        "parse_coverage_type": _parse_value(lambda s: s.coverage_sample.withColumn("value", formats.format_type(F.col("coverage_type"))), parsing.coverage_type),
        "parse_complexity": _parse_value(lambda s: s.method_data.withColumn("value", formats.format_complexity(F.col("hit_complexity_paths"), F.col("total_complexity"))), parsing.complexity),
    }
    return out

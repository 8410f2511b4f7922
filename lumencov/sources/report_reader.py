"""Reads two-part reports, any number at once, into a store.

A report is a JSON document of files and sessions and a chunks file. Documents come as whole texts keyed by `report`. Chunks
files are read chunk by chunk (`read_chunks`): a file of any size is cut into splits that many tasks read, as long as one chunk fits a
row; texts that are already in a frame are cut by `parse_chunks`. Everything after is by line.
Lines and chunk headers that break the grammar are kept apart (`errors`), or raise with fail_fast.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import parsing as P
from ..functions.seahash import seahash_id
from ..plans.numbering import dense_numbers
from ..plans.staging import staged
from ..plans.store import CoverageStore
from .formats import CHUNK_END, EMPTY_CHUNK, HEADER_END, SESSION_KEYS


def read_texts(spark: SparkSession, path: str, report: Column | None = None) -> DataFrame:
    """(report, value) of whole files; a report is named by its path unless an expression over `path` is given."""
    own = spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("path"), "value")
    return own.select((F.col("path") if report is None else report).alias("report"), "value")


def read_chunks(spark: SparkSession, path: str, report: Column | None = None) -> DataFrame:
    """report, chunk_index, header (on the first chunk of a file that has one) and chunk of chunks files, read in splits.

    A chunk's number is its place in its split and the chunks of the report's splits before; these counts, one row for each
    split (a file's bytes over spark.sql.files.maxPartitionBytes), are broadcast. Files that `report` gives one name are parts of one
    report, in the order of their paths.
    """
    name = F.col("path") if report is None else report
    rows = spark.read.text(path, lineSep=CHUNK_END).select(F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("row"), "value")
    counts = rows.groupBy("path", "block").agg(F.min("row").alias("first"), F.count(F.lit(1)).alias("n")).withColumn("report", name)
    before = Window.partitionBy("report").orderBy("path", "block").rowsBetween(Window.unboundedPreceding, -1)
    starts = counts.select("path", "block", "report", "first", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("earlier"))
    numbered = rows.join(F.broadcast(starts), ["path", "block"]).select("report", (F.col("earlier") + F.col("row") - F.col("first")).alias("chunk_index"), "value")
    at = F.when(F.col("chunk_index") == 0, F.instr("value", HEADER_END)).otherwise(0)
    header = F.when(at > 0, F.substring("value", F.lit(1), at - 1))
    body = F.when(at > 0, F.substring(F.col("value"), at + len(HEADER_END), F.length("value"))).otherwise(F.col("value"))
    return numbered.select("report", "chunk_index", header.alias("header"), body.alias("chunk")).repartition("report", "chunk_index")


# --- report JSON ---------------------------------------------------------------------------------


def _document(texts: DataFrame) -> DataFrame:
    parsed = F.from_json("value", "files MAP<STRING, VARIANT>, sessions MAP<STRING, VARIANT>")
    bad = F.raise_error(F.lit("a report needs the objects files and sessions"))
    return texts.select("report", parsed.alias("d")).select("report", F.when(F.col("d.files").isNotNull() & F.col("d.sessions").isNotNull(), F.col("d")).otherwise(bad).alias("d"))


def parse_report_files(texts: DataFrame) -> DataFrame:
    """report, chunk_index and path of each file; its entry must be an array of four."""
    rows = _document(texts).select("report", F.explode("d.files").alias("path", "entry"))
    slots = F.try_variant_get("entry", "$", "array<variant>")
    index = F.when(F.size(slots) == 4, F.try_variant_get("entry", "$[0]", "long"))
    return rows.select("report", F.coalesce(index, F.raise_error(F.lit("a file's entry must be an array of four with a chunk index")).cast("long")).alias("chunk_index"), "path")


def parse_report_sessions(texts: DataFrame) -> DataFrame:
    """report, session_index and the upload's attributes; unknown keys and totals are ignored."""
    rows = _document(texts).select("report", F.explode("d.sessions").alias("key", "s"))
    index = F.when(F.col("key").rlike("^[0-9]+$"), F.col("key").try_cast("long"))
    out = [F.coalesce(index, F.raise_error(F.lit("a session's key must be an unsigned number")).cast("long")).alias("session_index")]
    for key, column in SESSION_KEYS.items():
        value = F.try_variant_get("s", f"$.{key}", "variant")
        if column == "timestamp":
            out.append(F.try_variant_get("s", f"$.{key}", "long").alias(column))
        elif column in ("flags", "session_extras"):
            out.append(F.when(~F.coalesce(F.is_variant_null(value), F.lit(True)), F.to_json(value)).alias(column))
        else:
            out.append(F.try_variant_get("s", f"$.{key}", "string").alias(column))
    return rows.select("report", *out)


# --- chunks --------------------------------------------------------------------------------------


def split_header(texts: DataFrame) -> DataFrame:
    """report, header (null where there is none) and body."""
    at = F.instr("value", HEADER_END)
    return texts.select("report", F.when(at > 0, F.substring("value", F.lit(1), at - 1)).alias("header"), F.when(at > 0, F.substring(F.col("value"), at + len(HEADER_END), F.length("value"))).otherwise(F.col("value")).alias("body"))


def parse_labels_index(texts: DataFrame) -> DataFrame:
    """report, label and name of the header's label index; names must be strings. `texts` are whole, or chunks with their headers."""
    parsed = F.try_parse_json("header")
    index = F.from_json(F.to_json(F.try_variant_get(parsed, "$.labels_index", "variant")), "map<string, variant>")
    name = F.when(F.schema_of_variant("v") == "STRING", F.try_variant_get("v", "$", "string"))
    headers = texts if "header" in texts.columns else split_header(texts)
    rows = headers.where("header IS NOT NULL").select("report", F.explode(index).alias("label", "v"))
    return rows.select("report", "label", F.coalesce(name, F.raise_error(F.lit("a label's name must be a string"))).alias("name"))


def parse_chunks(texts: DataFrame, partitions: int | None = None) -> DataFrame:
    """report, chunk_index and chunk, spread over the cluster."""
    pieces = split_header(texts).select("report", F.posexplode(F.split("body", CHUNK_END)).alias("i", "chunk"))
    rows = pieces.select("report", F.col("i").cast("long").alias("chunk_index"), "chunk")
    return rows.repartition(partitions, "report", "chunk_index") if partitions else rows.repartition("report", "chunk_index")


def parse_report_lines(chunks: DataFrame) -> DataFrame:
    """report, chunk_index, line_no and raw text of every line with data; a chunk's first line is its header."""
    lines = chunks.where(~F.col("chunk").rlike(rf"^\s*{EMPTY_CHUNK}\s*$")).select("report", "chunk_index", F.posexplode(F.split("chunk", "\n")).alias("line_no", "raw"))
    return lines.where((F.col("line_no") > 0) & (F.trim("raw") != "")).withColumn("line_no", F.col("line_no").cast("long"))


def chunk_errors(chunks: DataFrame) -> DataFrame:
    """Chunks that are neither empty nor begin with a JSON object on a line of its own: report, chunk_index, line_no 0, raw and error."""
    first = F.substring_index("chunk", "\n", 1)
    empty = F.col("chunk").rlike(rf"^\s*{EMPTY_CHUNK}\s*$")
    header = F.coalesce(F.try_variant_get(F.try_parse_json(first), "$", "map<string, variant>").isNotNull(), F.lit(False))
    return chunks.where(~empty & ~header).select("report", "chunk_index", F.lit(0).cast("long").alias("line_no"), first.alias("raw"), F.lit("malformed chunk header").alias("error"))


def parse_line_sessions(lines: DataFrame) -> DataFrame:
    """A row for each session of each line, with its coverage normalized, and `error` where it breaks the grammar.

    Columns: report, chunk_index, line_no, place, session_index, coverage_type, hits, hit_branches, total_branches,
    hit_complexity_paths, total_complexity, branches (struct), partials (struct), labels (array), raw, error.

    Lines that are written plainly (`parsing.PLAIN`) take a short way of their own; the whole grammar is for the others.
    """
    plain = F.coalesce(F.col("raw").rlike(P.PLAIN), F.lit(False))
    return _plain_line_sessions(lines.where(plain)).unionByName(_any_line_sessions(lines.where(~plain)))


def _plain_line_sessions(lines: DataFrame) -> DataFrame:
    """parse_line_sessions of plain lines. Their slots are cut out as text; only a branch's hit count can still be wrong."""
    cut = lines.select("report", "chunk_index", "line_no", "raw", P.slots(F.col("raw")).alias("v"))
    line_type = F.coalesce(F.get("v", 1), F.when(F.get("v", 0).contains("/"), "b").otherwise("l"))
    line = cut.select("report", "chunk_index", "line_no", "raw", line_type.alias("line_type"), P.rows_of(F.get("v", 2)).alias("sessions"), P.rows_of(F.get("v", 5)).alias("points"))
    rows = line.select("report", "chunk_index", "line_no", "raw", "line_type", "points", F.posexplode("sessions").alias("place", "s"))
    number = F.get("s", 0)
    mine = F.filter("points", lambda x: F.get(x, 0) == number)
    read = rows.select(
        "report", "chunk_index", "line_no", "place", "raw", "line_type", number.cast("long").alias("session_index"), P.plain_coverage(F.get("s", 1)).alias("cov"), P.plain_branches(F.get("s", 2)).alias("branches"),
        P.plain_spans(F.get("s", 3)).alias("partials"), P.plain_complexity(F.get("s", 4)).alias("complexity"), mine.alias("mine"),
    )
    normal = read.select("*", P.normalized(F.col("cov"), F.col("line_type")).alias("n"))
    return normal.select(
        "report", "chunk_index", "line_no", "place", "session_index", F.col("line_type").alias("coverage_type"), "n.hits", "n.hit_branches", "n.total_branches", F.col("complexity.paths").alias("hit_complexity_paths"), F.col("complexity.total").alias("total_complexity"),
        "branches", "partials", P.plain_labels(F.get(F.get("mine", F.size("mine") - 1), 3)).alias("labels"), "raw", F.when(~F.col("n.valid"), "malformed session").alias("error"),
    )


def _any_line_sessions(lines: DataFrame) -> DataFrame:
    """parse_line_sessions by the whole grammar.

    Lines of a chunk often read like others of it, so each distinct text of a chunk is parsed once, with the numbers of its
    lines beside it. Chunks are whole in their partitions, so that this needs no shuffle. A text's JSON is read once, into a VARIANT.
    """
    lines = lines.groupBy("report", "chunk_index", "raw").agg(F.collect_list("line_no").alias("line_no"))
    own = lines.select("report", "chunk_index", "line_no", "raw", P.items(F.try_parse_json("raw")).alias("v"))
    line = own.select(
        "report", "chunk_index", "line_no", "raw", F.size("v").alias("n_slots"), P.slot_of(F.get("v", 0)).alias("s0"), P.slot_of(F.get("v", 1)).alias("s1"), P.items(F.get("v", 2)).alias("sessions"),
        P.slot_of(F.get("v", 4)).alias("cx"), P.slots_of(F.get("v", 4)).alias("cxs"), F.get("v", 5).alias("v5"), F.transform(P.items(F.get("v", 5)), P.items).alias("points"),
    )
    typed = line.select("*", P.kind_of(F.col("s0")).alias("kind"), P.coverage_type(F.col("s1")).alias("type"), F.transform("points", P.datapoint).alias("p5"))
    points = F.when(F.col("p5").isNull(), F.col("v5").isNull() | F.is_variant_null("v5")).otherwise(F.forall("p5", lambda p: p["valid"]))
    fine = F.col("n_slots").between(3, 6) & F.col("kind").isNotNull() & F.col("type").isNotNull() & F.col("sessions").isNotNull() & (F.col("cx").isNull() | P.complexity(F.col("cx"), F.col("cxs"))["valid"]) & points
    judged = typed.select("*", F.coalesce(fine, F.lit(False)).alias("fine"), P.normalized_type(F.col("kind"), F.col("type")).alias("line_type"))
    rows = judged.select("report", "chunk_index", "line_no", "raw", "fine", "line_type", "p5", F.posexplode_outer(F.when(F.col("fine"), F.col("sessions"))).alias("place", "s")).where("s IS NOT NULL OR NOT fine")
    cut = rows.select("*", P.items(F.col("s")).alias("p"))
    arrays = cut.select("*", P.slots_of(F.get("p", 2)).alias("a2"), F.transform(P.items(F.get("p", 3)), P.slots_of).alias("a3"), P.slots_of(F.get("p", 4)).alias("a4"))
    slots = arrays.select(
        "report", "chunk_index", "line_no", "place", "raw", "fine", "line_type", "p5", F.size("p").between(2, 5).alias("arity"), P.slot_of(F.get("p", 0)).alias("s0"), P.slot_of(F.get("p", 1)).alias("s1"),
        *[P.slot_beside(F.get("p", k), F.col(f"a{k}")).alias(f"s{k}") for k in (2, 3, 4)], "a2", "a3", "a4",
    )
    read = slots.select(
        "report", "chunk_index", "line_no", "place", "raw", "fine", "line_type", "p5", "arity", P.number(F.col("s0")).alias("session_index"),
        P.coverage(F.col("s1")).alias("cov"), P.missing_branches(F.col("s2"), F.col("a2")).alias("branches"), P.partial_spans(F.col("s3"), F.col("a3")).alias("partials"), P.complexity(F.col("s4"), F.col("a4")).alias("complexity"),
    )
    normal = read.select("*", P.normalized(F.col("cov"), F.col("line_type")).alias("n"))
    valid = F.col("arity") & F.col("session_index").isNotNull() & F.col("n.valid") & F.col("branches.valid") & F.col("partials.valid") & F.col("complexity.valid")
    error = F.when(~F.col("fine"), "malformed line").when(~F.coalesce(valid, F.lit(False)), "malformed session")
    mine = F.filter("p5", lambda x: x["session_index"] == F.col("session_index"))
    labels = F.when(F.col("p5").isNotNull(), F.get(mine, F.size(mine) - 1)["labels"])  # of two datapoints of a session the last counts
    return normal.select(
        "report", "chunk_index", F.explode("line_no").alias("line_no"), "place", "session_index", F.col("line_type").alias("coverage_type"), "n.hits", "n.hit_branches", "n.total_branches", F.col("complexity.paths").alias("hit_complexity_paths"), F.col("complexity.total").alias("total_complexity"),
        "branches", "partials", labels.alias("labels"), "raw", error.alias("error"),
    )


def exploded_branches(samples: DataFrame) -> DataFrame:
    return samples.select("*", F.posexplode("branches.branches").alias("nth", "branch")).withColumn("branch_format", F.col("branches.branch_format"))


def exploded_partials(samples: DataFrame) -> DataFrame:
    return samples.select("*", F.posexplode("partials.spans").alias("nth", "span"))


def exploded_labels(samples: DataFrame, index: DataFrame) -> DataFrame:
    """A row for each label of a sample: a string or number that the header's index knows is the name there, else itself."""
    label = F.coalesce(P.string_of(F.col("l")), F.col("l"))
    rows = samples.select("*", F.explode("labels").alias("l")).withColumn("label", label)
    named = index.select("report", "label", F.col("name").alias("__name"))
    return rows.join(named, ["report", "label"], "left").withColumn("label", F.coalesce("__name", "label")).drop("__name", "l")


# --- whole reports -------------------------------------------------------------------------------


@dataclass(frozen=True)
class ParsedReports:
    store: CoverageStore
    errors: DataFrame  # report, chunk_index, line_no, raw, error


def upload_id() -> Column:
    """Deterministic, so that reading a report again gives the same ids."""
    return F.xxhash64("report", "session_index", F.coalesce("raw_upload_url", F.lit("")), F.coalesce("job_name", F.lit("")), F.coalesce("timestamp", F.lit(0)))


#: Uploads whose ids are broadcast, where they are staged and so counted.
BROADCAST_UPLOADS = 1_000_000


def parse_reports(report_jsons: DataFrame, chunks: DataFrame, staging: str | None = None, fail_fast: bool = False) -> ParsedReports:
    """(report, value) of the JSON documents, and the chunks files as whole texts (report, value) or cut (`read_chunks`), as a store.

    Five tables come from the parsed lines. With `staging`, a folder, the parsed lines are written there once
    and read again, so that they are not parsed five times.
    """
    files = staged(parse_report_files(report_jsons).withColumn("source_file_id", seahash_id("path")), staging, "files")
    uploads = staged(parse_report_sessions(report_jsons).withColumn("raw_upload_id", upload_id()), staging, "uploads")
    index = staged(parse_labels_index(chunks), staging, "labels")
    cut = chunks if "chunk_index" in chunks.columns else parse_chunks(chunks)
    headers = chunk_errors(cut)
    ids = uploads.select("report", "session_index", "raw_upload_id")
    if staging and uploads.count() <= BROADCAST_UPLOADS:
        ids = F.broadcast(ids)
    # a chunk learns its file before it is cut, and its lines carry the id beside the report's name
    named = cut.select("report", "chunk_index", "chunk").join(files.select("report", "chunk_index", "source_file_id"), ["report", "chunk_index"], "left")
    lines = parse_report_lines(named.select(F.struct("report", "source_file_id").alias("report"), "chunk_index", "chunk"))
    placed = parse_line_sessions(lines).withColumns({"report": F.col("report.report"), "source_file_id": F.col("report.source_file_id")}).join(ids, ["report", "session_index"], "left")
    unknown = F.when(F.col("source_file_id").isNull(), "unknown chunk").when(F.col("raw_upload_id").isNull(), "unknown session")
    placed = placed.withColumn("error", F.coalesce("error", unknown))
    if fail_fast:
        if (broken := headers.first()) is not None:
            raise ValueError(f"{broken.error}: {broken.raw}")
        placed = placed.withColumn("error", F.when(F.col("error").isNotNull(), F.raise_error(F.concat(F.col("error"), F.lit(": "), F.col("raw")))))
    placed = staged(placed.withColumn("raw", F.when(F.col("error").isNotNull(), F.col("raw"))), staging, "samples")
    own = placed.where("error IS NULL").drop("chunk_index", "session_index", "raw", "error")
    # hashed ids are cut into 64 ranges: the first of the order, and far fewer buckets than files
    good = staged(dense_numbers(own, "raw_upload_id", F.shiftright("source_file_id", 58), ["source_file_id", "line_no", "place"], "local_sample_id"), staging, "numbered")
    key = ["raw_upload_id", "local_sample_id", "source_file_id"]
    # children take ids from their sample's: unique within the upload, without another shuffle
    child = F.shiftleft("local_sample_id", 20) + F.when(F.col("nth") < 1 << 20, F.col("nth")).otherwise(F.raise_error(F.lit("a line has over 1,048,576 branches or spans")).cast("int"))
    named = exploded_labels(good, index)
    contexts = named.select("label").unionByName(index.select(F.col("name").alias("label"))).distinct().select(seahash_id("label").alias("id"), F.col("label").alias("name"))
    store = CoverageStore.of(
        source_file=files.select(F.col("source_file_id").alias("id"), "path").dropDuplicates(["id"]),
        raw_upload=uploads.withColumnRenamed("raw_upload_id", "id"),
        context=contexts,
        context_assoc=named.select(seahash_id("label").alias("context_id"), "raw_upload_id", "local_sample_id").distinct(),
        coverage_sample=good,
        branches_data=exploded_branches(good).select(*key, child.alias("local_branch_id"), F.lit(0).alias("hits"), "branch_format", "branch"),
        method_data=good.where("total_complexity IS NOT NULL").select(*key, F.col("local_sample_id").alias("local_method_id"), "line_no", "hit_complexity_paths", "total_complexity"),
        span_data=exploded_partials(good).select(*key, child.alias("local_span_id"), "span.hits", F.col("line_no").alias("start_line"), "span.start_col", F.col("line_no").alias("end_line"), "span.end_col"),
    )
    return ParsedReports(store, placed.where("error IS NOT NULL").select("report", "chunk_index", "line_no", "raw", "error").unionByName(headers))


def parse_report(spark: SparkSession, report_json_path: str, chunks_path: str, staging: str | None = None, fail_fast: bool = False) -> ParsedReports:
    """One report from its two files."""
    name = F.lit("report")
    return parse_reports(read_texts(spark, report_json_path, name), read_chunks(spark, chunks_path, name), staging, fail_fast)

"""Reports read as they arrive, by Structured Streaming.

An extension: reports land in a folder as NAME.json and, after it, NAME.chunks. Each micro-batch of new
chunks files is parsed with its JSON documents and written under its own batch number, so that a batch that
is run again after a failure replaces itself. Ids are hashes, so batches need no knowledge of each other.
"""

from __future__ import annotations

import re
from urllib.parse import unquote

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..plans import schema
from ..plans.staging import shared_dir
from ..plans.store import CoverageStore
from ..sources.report_reader import parse_reports

#: Characters that a path pattern reads as more than themselves.
_GLOB = re.compile(r"([*?{}\[\]\\])")


def _reports(batch: DataFrame) -> DataFrame:
    return batch.select(F.regexp_replace("path", r"\.chunks$", "").alias("report"), "value")


def ingest(spark: SparkSession, folder: str, store_path: str, checkpoint: str, max_files: int = 1000, once: bool = True) -> StreamingQuery:
    """Starts the stream; with `once` it ends when all reports that are there have been read."""
    source = spark.readStream.format("text").option("wholetext", True).option("maxFilesPerTrigger", max_files).load(f"{folder}/*.chunks").select(F.col("_metadata.file_path").alias("path"), "value")

    def write(batch: DataFrame, number: int) -> None:
        chunks = _reports(batch)
        session = batch.sparkSession
        names = [r.report for r in chunks.select("report").distinct().collect()]  # max_files at most
        if not names:
            return
        documents = session.read.format("text").option("wholetext", True).load([_GLOB.sub(r"\\\1", unquote(n)) + ".json" for n in names])
        new = documents.select(F.regexp_replace(F.col("_metadata.file_path"), r"\.json$", "").alias("report"), "value")
        parsed = parse_reports(new, chunks, staging=shared_dir(session))
        for name, table in parsed.store.tables().items():
            table.write.mode("overwrite").parquet(f"{store_path}/{name}/batch={number}")
        parsed.errors.write.mode("overwrite").parquet(f"{store_path}/errors/batch={number}")

    writer = source.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer.trigger(processingTime="30 seconds")).start()


def read_ingested(spark: SparkSession, store_path: str) -> CoverageStore:
    """The batches as one store; a dimension row that several batches brought counts once."""
    tables = {}
    for name, columns in schema.TABLES.items():
        rows = spark.read.schema(columns).parquet(f"{store_path}/{name}").select(*schema.columns(name))
        tables[name] = rows.dropDuplicates(["id"]) if name in schema.DIMENSIONS else rows
    return CoverageStore(**tables)

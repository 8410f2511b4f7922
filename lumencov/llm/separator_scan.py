"""Operator 4: tokens of each document, counted in flat token files without an index.

A flat file is nothing but ids of a fixed width, each document followed by the end-of-document
id. Blocks of a file are scanned apart: numpy finds all end ids of a block at once. What a block
can't know, how many documents ended before it and where the last one did, comes from a
prefix scan (running count and running maximum) over one row for each block.

Nulls: a null text is an empty document (0 tokens); a null doc_id is kept. Repeated rows are
documents of their own. An empty table gives an empty result. Extra columns are ignored.
The end id is never an id of a text: its string in a text is encoded as ordinary text.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import public_tokenizers
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import common, files
from .encoder import encoder

BLOCK_IDS = 1 << 20


def id_width(vocab_size: int) -> int:
    return 2 if vocab_size <= 1 << 16 else 4


def write_flat_files(docs: DataFrame, folder: str, tokenizer: str, end_id: int, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """A file for each partition, documents in the order they come; a row for each document: file, place in it, doc_id, and in the last row of a file its ids."""

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        code = encoder(tokenizer, specials=False)
        kind = f"<u{id_width(max(code.vocab_size, end_id + 1))}"
        end, path, place, total = np.array([end_id], kind).tobytes(), None, 0, 0
        for batch in batches:
            if not batch.num_rows:
                continue
            if path is None:
                path, stream = files.open_new(folder, "flat")
            for i in range(0, batch.num_rows, 64):
                part = batch.slice(i, 64)
                for raw in code.encode(part.column(1).to_pylist()):
                    ids = np.frombuffer(raw, "<u4").astype(kind).tobytes()
                    stream.write(ids + end)
                    total += len(ids) // len(end) + 1
            n = batch.num_rows
            yield pa.RecordBatch.from_arrays([pa.array([path] * n), pa.array(np.arange(place, place + n)), batch.column(0).cast(pa.int64()), pa.array([None] * n, pa.int64()), pa.array([None] * n, pa.int32())], ["file", "place", "doc_id", "n_ids", "width"])
            place += n
        if path is not None:
            stream.close()
            yield pa.RecordBatch.from_pydict({"file": [path], "place": pa.array([-1], pa.int64()), "doc_id": pa.array([None], pa.int64()), "n_ids": pa.array([total], pa.int64()), "width": pa.array([len(end)], pa.int32())})

    own = docs.select(F.col(f"`{id_col}`").cast("long").alias("doc_id"), common.whole_text(text_col).alias("text"))
    return common.map_arrow(own, write, "file string, place long, doc_id long, n_ids long, width int")


def _read(path: str, width: int, block: int, size: int) -> np.ndarray:
    with files.open_read(path) as stream:
        stream.seek(block * size * width)
        return np.frombuffer(stream.read(size * width), f"<u{width}")


def count_tokens(listed: DataFrame, end_id: int, block_ids: int = BLOCK_IDS) -> DataFrame:
    """(file, place, n_tokens) of every document of the flat files in `listed` (file, n_ids, width), without its end id."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for file, width, block in zip(*(batch.column(c).to_pylist() for c in ("file", "width", "block"))):
                at = np.flatnonzero(_read(file, width, block, block_ids) == end_id)
                yield pa.RecordBatch.from_pydict({"file": [file], "width": pa.array([width], pa.int32()), "block": pa.array([block], pa.int64()), "ends": pa.array([len(at)], pa.int64()), "last_end": pa.array([block * block_ids + int(at[-1]) if len(at) else None], pa.int64())})

    def lengths(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for file, width, block, before, previous in zip(*(batch.column(c).to_pylist() for c in ("file", "width", "block", "before", "previous"))):
                at = np.flatnonzero(_read(file, width, block, block_ids) == end_id) + block * block_ids
                n = np.diff(at, prepend=previous) - 1
                for i in range(0, len(at), 8192):
                    part = n[i : i + 8192]
                    yield pa.RecordBatch.from_arrays([pa.array([file] * len(part)), pa.array(np.arange(before + i, before + i + len(part))), pa.array(part)], ["file", "place", "n_tokens"])

    blocks = listed.select("file", "width", F.explode(F.sequence(F.lit(0).cast("long"), F.expr(f"(n_ids - 1) div {block_ids}"))).alias("block")).repartition("file", "block")
    scanned = common.map_arrow(blocks, scan, "file string, width int, block long, ends long, last_end long")
    earlier = Window.partitionBy("file").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    stitched = scanned.select("file", "width", "block", F.coalesce(F.sum("ends").over(earlier), F.lit(0)).alias("before"), F.coalesce(F.max("last_end").over(earlier), F.lit(-1)).alias("previous"))
    return common.map_arrow(stitched.repartition("file", "block"), lengths, "file string, place long, n_tokens long")


def token_counts(docs: DataFrame, tokenizer: str, end_id: int, folder: str | None = None, block_ids: int = BLOCK_IDS, **columns) -> DataFrame:
    """Writes docs as flat files and counts each document's tokens in them: doc_id, n_tokens."""
    folder = folder or common.shared_dir(docs.sparkSession)
    listed = common.materialise(write_flat_files(docs, folder + "/flat", tokenizer, end_id, **columns), folder, "listed")
    counts = count_tokens(listed.where("place < 0").select("file", "n_ids", "width"), end_id, block_ids)
    # both sides have a row for each document, which their small Parquet files don't show: no broadcast
    return listed.where("place >= 0").select("file", "place", "doc_id").hint("merge").join(counts, ["file", "place"]).select("doc_id", "n_tokens")


def op4_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts(common.documents(spark, sf_dir), public_tokenizers.path("byte_bpe_50k.json"), 50256)

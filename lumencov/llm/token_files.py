"""Operator 2: token ids in files of fixed-width packed bits, with block offsets.

A file holds the ids of a run of documents. Each id takes the least number of bits that the
vocabulary needs. Blocks of `block_tokens` ids are packed apart and start at a byte, so the
offsets of blocks give random access, and a block is unpacked by numpy at once.

Layout, little-endian: header (magic, version u16, bits u16, block_tokens u32); blocks; offsets of
blocks and of the end (u64 each); document ids (i64 each); tokens of each document (u64 each);
validity of document ids (u8 each); trailer (n_blocks, n_docs, n_tokens, offset of the offsets, u64 each).

Nulls: a null text is empty (it has the end id alone); a null doc_id sorts first and is kept as
null. Repeated rows are documents of their own, in an arbitrary order among themselves. An
empty table gives an empty result. Extra columns are ignored. The string of a special token in a text gets its special
id, as the library's plain call gives it; lengths come from the file's own table, so an id may be any.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common, files
from .encoder import encoder

MAGIC, HEAD, TAIL = b"LCTP", struct.Struct("<4sHHI"), struct.Struct("<QQQQ")
BLOCK_TOKENS = 1 << 16


def bits_for(vocab_size: int) -> int:
    return max(1, int(vocab_size - 1).bit_length())


def pack(ids: np.ndarray, bits: int) -> bytes:
    """Bit k of the stream is bit k % bits of id k // bits; the last byte is filled with zeros."""
    if bits in (8, 16, 32):
        return ids.astype(f"<u{bits // 8}").tobytes()
    spread = (ids.astype(np.uint32)[:, None] >> np.arange(bits, dtype=np.uint32)) & 1
    return np.packbits(spread.astype(np.uint8).ravel(), bitorder="little").tobytes()


def unpack(data: bytes, bits: int, count: int) -> np.ndarray:
    if bits in (8, 16, 32):
        return np.frombuffer(data, f"<u{bits // 8}", count).astype("<u4")
    spread = np.unpackbits(np.frombuffer(data, np.uint8), count=count * bits, bitorder="little").reshape(count, bits)
    padded = np.zeros((count, 32), np.uint8)
    padded[:, :bits] = spread
    return np.packbits(padded, axis=1, bitorder="little").view("<u4").ravel()


class PackedWriter:
    """Appends documents; holds one block of ids and 17 bytes for each document."""

    def __init__(self, stream, vocab_size: int, block_tokens: int = BLOCK_TOKENS):
        self.out, self.bits, self.block = stream, bits_for(vocab_size), block_tokens
        self.offsets, self.doc_ids, self.lengths = [HEAD.size], [], []
        self.pending: list[np.ndarray] = []
        self.held = self.total = 0
        self.out.write(HEAD.pack(MAGIC, 1, self.bits, block_tokens))

    def add(self, doc_id: int | None, ids: np.ndarray) -> None:
        self.doc_ids.append(doc_id)
        self.lengths.append(len(ids))
        self.total += len(ids)
        self.pending.append(ids)
        self.held += len(ids)
        if self.held >= self.block:
            self._flush(False)

    def _flush(self, last: bool) -> None:
        ids = np.concatenate(self.pending) if self.pending else np.zeros(0, "<u4")
        end = len(ids) if last else len(ids) // self.block * self.block
        for i in range(0, end, self.block):
            data = pack(ids[i : min(i + self.block, end)], self.bits)
            self.out.write(data)
            self.offsets.append(self.offsets[-1] + len(data))
        self.pending, self.held = [ids[end:]], len(ids) - end

    def close(self) -> None:
        self._flush(True)
        at = self.offsets[-1]
        self.out.write(np.array(self.offsets, "<u8").tobytes())
        self.out.write(np.array([d or 0 for d in self.doc_ids], "<i8").tobytes())
        self.out.write(np.array(self.lengths, "<u8").tobytes())
        self.out.write(np.array([d is not None for d in self.doc_ids], "u1").tobytes())
        self.out.write(TAIL.pack(len(self.offsets) - 1, len(self.doc_ids), self.total, at))
        self.out.close()


class PackedReader:
    def __init__(self, stream):
        self.file = stream
        size = stream.size()
        magic, version, self.bits, self.block = HEAD.unpack(self._at(0, HEAD.size))
        if magic != MAGIC or version != 1:
            raise ValueError("not a packed token file")
        self.n_blocks, self.n_docs, self.n_tokens, at = TAIL.unpack(self._at(size - TAIL.size, TAIL.size))
        self.offsets = np.frombuffer(self._at(at, 8 * (self.n_blocks + 1)), "<u8")
        at += 8 * (self.n_blocks + 1)
        ids = np.frombuffer(self._at(at, 8 * self.n_docs), "<i8")
        self.lengths = np.frombuffer(self._at(at + 8 * self.n_docs, 8 * self.n_docs), "<u8").astype(np.int64)
        valid = np.frombuffer(self._at(at + 16 * self.n_docs, self.n_docs), "u1")
        self.doc_ids = [int(d) if v else None for d, v in zip(ids, valid)]
        self.starts = np.cumsum(self.lengths) - self.lengths

    def _at(self, offset: int, length: int) -> bytes:
        self.file.seek(offset)
        return self.file.read(length)

    def read_block(self, k: int) -> np.ndarray:
        count = min(self.block, self.n_tokens - k * self.block)
        return unpack(self._at(int(self.offsets[k]), int(self.offsets[k + 1] - self.offsets[k])), self.bits, count)

    def read(self, start: int, stop: int) -> np.ndarray:
        """Ids start to stop (exclusive) of the file, from the blocks that hold them alone."""
        first, last = start // self.block, (max(stop, start + 1) - 1) // self.block
        parts = [self.read_block(k) for k in range(first, min(last + 1, self.n_blocks))]
        return np.concatenate(parts)[start - first * self.block : stop - first * self.block] if parts and stop > start else np.zeros(0, "<u4")


def write_token_files(docs: DataFrame, folder: str, tokenizer: str, end_id: int, id_col: str = "doc_id", text_col: str = "text", block_tokens: int = BLOCK_TOKENS) -> DataFrame:
    """One file for each range of document ids; a row for each file: shard, path, n_tokens, n_docs."""

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        code, end = encoder(tokenizer), np.array([end_id], "<u4").tobytes()
        writer = None
        for batch in batches:
            for i in range(0, batch.num_rows, 64):
                part = batch.slice(i, 64)
                for doc_id, raw in zip(part.column(0).to_pylist(), code.encode(part.column(1).to_pylist())):
                    if writer is None:
                        path, stream = files.open_new(folder, "tokens")
                        writer = PackedWriter(stream, max(code.vocab_size, end_id + 1), block_tokens)
                    writer.add(doc_id, np.frombuffer(raw + end, "<u4"))
        if writer is not None:
            writer.close()
            yield pa.RecordBatch.from_pydict({"shard": [TaskContext.get().partitionId()], "path": [path], "n_tokens": [writer.total], "n_docs": [len(writer.lengths)]})

    own = docs.select(F.col(f"`{id_col}`").cast("long").alias("doc_id"), common.whole_text(text_col).alias("text"))
    ordered = own.repartitionByRange("doc_id").sortWithinPartitions("doc_id")
    return common.map_arrow(ordered, write, "shard long, path string, n_tokens long, n_docs long")


def read_token_files(shards: DataFrame) -> DataFrame:
    """A row for each document of the files, in blocks: doc_id, start, n_tokens, ids_crc32.

    `shards` has a row for each file with `first`, the ids in all files before it.
    """

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, first in zip(batch.column("path").to_pylist(), batch.column("first").to_pylist()):
                with files.open_read(path) as stream:
                    packed = PackedReader(stream)
                    crc = np.zeros(packed.n_docs, np.int64)
                    doc = 0
                    for k in range(packed.n_blocks):
                        ids, at = packed.read_block(k), k * packed.block
                        raw = memoryview(ids.astype("<u4").tobytes())
                        while doc < packed.n_docs:
                            a, b = int(packed.starts[doc]), int(packed.starts[doc] + packed.lengths[doc])
                            crc[doc] = zlib.crc32(raw[4 * max(a - at, 0) : 4 * (b - at)], int(crc[doc]))
                            if b > at + len(ids):
                                break
                            doc += 1
                    for i in range(0, packed.n_docs, 8192):
                        part = slice(i, i + 8192)
                        yield pa.RecordBatch.from_arrays(
                            [pa.array(packed.doc_ids[part], pa.int64()), pa.array(packed.starts[part] + first, pa.int64()), pa.array(packed.lengths[part], pa.int64()), pa.array(crc[part], pa.int64())],
                            ["doc_id", "start", "n_tokens", "ids_crc32"],
                        )

    return common.map_arrow(shards, read, "doc_id long, start long, n_tokens long, ids_crc32 long")


def encode_to_files(docs: DataFrame, tokenizer: str, end_id: int = 0, folder: str | None = None, **columns) -> DataFrame:
    """Writes the files and returns what is read back from them.

    The list of files (a few numbers for each) is a table too; the ids before each file are a
    running sum over that list, which has one row for each partition of the input.
    """
    spark = docs.sparkSession
    folder = folder or common.shared_dir(spark)
    common.materialise(write_token_files(docs, folder + "/files", tokenizer, end_id, **columns), folder, "shards")
    listed = spark.read.parquet(f"{folder}/shards").orderBy("shard").collect()  # one row for each file
    first, rows = 0, []
    for r in listed:
        rows.append((r.path, first))
        first += r.n_tokens
    if not rows:
        return spark.createDataFrame([], "doc_id long, start long, n_tokens long, ids_crc32 long")
    shards = spark.createDataFrame(rows, "path string, first long").repartition(len(rows))
    return read_token_files(shards)


def op2_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encode_to_files(common.documents(spark, sf_dir), public_tokenizers.path("byte_bpe_50k.json"), 0)

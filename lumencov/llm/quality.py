"""Operator 10: quality rules, and a hashed n-gram log-likelihood ratio.

Base rules count words, symbols, repeated lines and repeated word triples of a whole text. The
method scores each document with the log-likelihood ratio of its hashed byte n-grams between two
multinomials, of trusted documents and of the raw corpus, divided by the number of n-grams. The raw
counts cover all documents. A text is read in parts that share no n-gram. The trusted side is fitted on labelled documents of good quality,
TRUSTED_ROWS of them at most (those of the least hash of doc_id). The threshold is read from the scores of all labelled
documents: of the steps that keep at least KEEP_GOOD of the good ones, the lowest with the least cost, where a good
document lost counts as GOOD_WEIGHT bad ones kept. A document at or above it passes; without labels of both kinds all do.

Nulls: a null text has no words (and fails the base rules); labels with nulls don't count; a null
doc_id has no label. Repeated rows count as often as they come. Texts without an n-gram score 0.
An empty table gives an empty result. Extra columns are ignored (the filter keeps them, whatever their names).

Documents are read twice: for the bucket counts, and for rules and scores together. These are written to the shared folder, so that
the threshold comes from the labelled ones among them and no text is scored twice. The rules hold a text's words at once, about ten times its size.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common

BUCKETS, ORDERS, TRUSTED_ROWS, KEEP_GOOD, GOOD_WEIGHT = 1 << 14, (3, 4), 20_000, 0.995, 10
SCORE_STEP, SCORE_LEAST, THRESHOLDS = 1 / 512, -8.0, 8192
SMOOTH = 0.5
_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
_SYMBOL = np.zeros(256, bool)
_SYMBOL[list(b"#*$%&|<>")] = True


def rule_counts(raw: bytes) -> tuple[int, int, int, int, int]:
    """n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words of a text in UTF-8."""
    data = np.frombuffer(raw, np.uint8)
    chars = int((((data & 0xC0) != 0x80) & ~_SPACE[data]).sum())
    symbols = int(_SYMBOL[data].sum())
    seen: set[bytes] = set()
    copies = 0
    for line in raw.split(b"\n"):
        if line and not line.isspace():
            copies += line in seen
            seen.add(line)
    words = raw.split()
    number: dict[bytes, int] = {}
    ids = np.fromiter([number.setdefault(w, len(number)) for w in words], np.int64, len(words))
    repeated = 0
    if len(ids) > 3:
        pairs = np.unique(ids[:-1] * len(number) + ids[1:], return_inverse=True)[1]
        _, which, count = np.unique(pairs[:-1] * len(number) + ids[2:], return_inverse=True, return_counts=True)
        again = count[which] > 1
        covered = np.zeros(len(ids), bool)
        for k in range(3):
            covered[k : len(again) + k] |= again
        repeated = int(covered.sum())
    return len(words), chars, symbols, copies, repeated


def grams(raw: bytes, buckets: int = BUCKETS, starts: int | None = None) -> np.ndarray:
    """Buckets of a text's byte n-grams, all orders; with `starts`, of those that begin in its first bytes."""
    data = np.frombuffer(raw, np.uint8).astype(np.uint32)
    out = []
    for n in ORDERS:
        count = len(data) - n + 1 if starts is None else min(len(data) - n + 1, starts)
        if count > 0:
            code = np.zeros(count, np.uint32)
            for k in range(n):
                code = (code << np.uint32(8)) | data[k : count + k]
            code = (code + np.uint32(n)) * np.uint32(2654435761)
            out.append((code >> np.uint32(32 - (buckets - 1).bit_length())).astype(np.int64))
    return np.concatenate(out) if out else np.zeros(0, np.int64)


def gram_parts(raw: bytes, step: int = 1 << 18) -> Iterator[np.ndarray]:
    """The same buckets in parts, each n-gram in the part where it begins."""
    for at in range(0, len(raw), step):
        yield grams(raw[at : at + step + max(ORDERS) - 1], starts=step)


@dataclass
class QualityModel:
    ratio: np.ndarray  # log(trusted / raw) of each bucket
    threshold: float

    def score(self, raw: bytes) -> float:
        """Mean log ratio of the text's n-grams."""
        total, count = 0.0, 0
        for own in gram_parts(raw):
            total += float(self.ratio[own].sum())
            count += len(own)
        return round(total / count, 9) if count else 0.0


def _utf8(texts) -> list[bytes]:
    return [t.encode("utf-8", "surrogatepass") for t in texts]


def trusted_ids(labels: DataFrame, most: int = TRUSTED_ROWS) -> DataFrame:
    good = labels.where("quality = 1 AND doc_id IS NOT NULL").select(F.col("doc_id").cast("long").alias("__id")).distinct()
    return good.orderBy(F.xxhash64("__id"), "__id").limit(most)


def bucket_counts(docs: DataFrame, labels: DataFrame, id_col: str, text_col: str, most: int = TRUSTED_ROWS) -> DataFrame:
    """(bucket, raw, trusted) over all documents."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        raw, trusted = np.zeros(BUCKETS, np.int64), np.zeros(BUCKETS, np.int64)
        for batch in batches:
            for text, known in zip(_utf8(batch.column(0).to_pylist()), batch.column(1).to_pylist()):
                for part in gram_parts(text):
                    own = np.bincount(part, minlength=BUCKETS)
                    raw += own
                    if known:
                        trusted += own
        some = np.flatnonzero(raw)
        yield pa.RecordBatch.from_arrays([pa.array(some, pa.int32()), pa.array(raw[some]), pa.array(trusted[some])], ["bucket", "raw", "trusted"])

    own = docs.select(F.col(f"`{id_col}`").cast("long").alias("__id"), common.whole_text(text_col).alias("text"))
    marked = own.join(F.broadcast(trusted_ids(labels, most).withColumn("known", F.lit(True))), "__id", "left")  # `most` rows of 9 bytes
    counted = common.map_arrow(marked.select("text", "known"), run, "bucket int, raw long, trusted long")
    return counted.groupBy("bucket").agg(F.sum("raw").alias("raw"), F.sum("trusted").alias("trusted"))


def threshold_from(histogram: list[tuple[int, int, int]], keep_good: float = KEEP_GOOD) -> float:
    """histogram: (step, good, bad) documents whose score falls in a step."""
    good, bad = np.zeros(THRESHOLDS + 1), np.zeros(THRESHOLDS + 1)
    for step, g, b in histogram:
        good[step], bad[step] = g, b
    if not good.sum() or not bad.sum():
        return float("-inf")
    kept_good = good.sum() - np.concatenate([[0], np.cumsum(good)[:-1]])  # at or above each step
    kept_bad = bad.sum() - np.concatenate([[0], np.cumsum(bad)[:-1]])
    allowed = np.flatnonzero(kept_good >= keep_good * good.sum())
    cost = GOOD_WEIGHT * (good.sum() - kept_good[allowed]) + kept_bad[allowed]
    return SCORE_LEAST + SCORE_STEP * float(allowed[cost.argmin()])


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", most: int = TRUSTED_ROWS) -> QualityModel:
    """The ratios, from one pass over docs; BUCKETS rows at most come to the driver. The threshold isn't set yet."""
    counts = bucket_counts(docs, labels, id_col, text_col, most).collect()
    raw, trusted = np.zeros(BUCKETS), np.zeros(BUCKETS)
    for r in counts:
        raw[r.bucket], trusted[r.bucket] = r.raw, r.trusted
    if not trusted.sum():
        return QualityModel(np.zeros(BUCKETS), float("-inf"))
    ratio = np.log((trusted + SMOOTH) / (trusted.sum() + SMOOTH * BUCKETS)) - np.log((raw + SMOOTH) / (raw.sum() + SMOOTH * BUCKETS))
    return QualityModel(np.round(ratio, 9), float("-inf"))


def fit_threshold(scored: DataFrame, labels: DataFrame) -> float:
    """From doc_id and score of all documents; only those with a label are joined, THRESHOLDS rows at most come to the driver."""
    marks = labels.where("doc_id IS NOT NULL AND quality IS NOT NULL").groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.min("quality").alias("quality"))
    step = F.greatest(F.lit(0), F.least(F.lit(THRESHOLDS), F.floor((F.col("score") - F.lit(SCORE_LEAST)) / F.lit(SCORE_STEP)).cast("int")))
    histogram = scored.join(marks, "doc_id").groupBy(step.alias("step")).agg(F.sum((F.col("quality") == 1).cast("long")).alias("good"), F.sum((F.col("quality") != 1).cast("long")).alias("bad")).collect()
    return threshold_from([(r.step, r.good, r.bad) for r in histogram])


def measured(model: QualityModel, text: Column) -> Column:
    """Struct of the counts, base_failed and score of a text."""

    @F.pandas_udf("n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean, score double")
    def measure(texts: pd.Series) -> pd.DataFrame:
        rows = []
        for raw in _utf8(texts):
            n, chars, symbols, copies, repeated = rule_counts(raw)
            rows.append((n, chars, symbols, copies, repeated, n < 50 or 100 * repeated > 50 * n, model.score(raw)))
        return pd.DataFrame(rows, columns=["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "score"])

    return measure(text)


def _judged(docs: DataFrame, labels: DataFrame, id_col: str, text_col: str, *more: Column) -> DataFrame:
    """doc_id, further columns, the counts, base_failed, score and kept of each document."""
    model = fit(docs, labels, id_col, text_col)
    common.small_batches(docs.sparkSession)
    own = docs.select(F.col(f"`{id_col}`").cast("long").alias("doc_id"), *more, measured(model, common.whole_text(text_col)).alias("v"))
    scored = common.materialise(own.select("doc_id", *own.columns[1:-1], "v.*"), common.shared_dir(docs.sparkSession), "scored")
    threshold = fit_threshold(scored.select("doc_id", "score"), labels)
    return scored.withColumn("kept", ~F.col("base_failed") & (F.col("score") >= F.lit(threshold)))


def quality_report(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id with counts, base_failed, score and kept."""
    return _judged(docs, labels, id_col, text_col)


def keep_good(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of docs that pass, all columns."""
    return _judged(docs, labels, id_col, text_col, common.whole_row()).where("kept").select("row.*")


def op10_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_report(common.documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/labels.parquet"))

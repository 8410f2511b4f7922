"""Operator 9: mixture-controlled packing by deficit round-robin.

Every source is a queue of its documents' ids. In each window (one sequence of 2048 ids) a queue
is served its share of the window; the fraction of an id it is still owed, its deficit, goes on to the next
window. Shares are those of the whole corpus unless targets are given, so that all queues end
together and every window holds the corpus's mixture.

What a queue has been served before a window is a closed form of the window's number, so tasks
need not wait for each other: the ids of all queues are split over a binary tree of the queues, at each
node floor(x * left / both) of the first x ids to the left and the rest to the right. This is exact,
grows with x on either side, serves each queue to its last id, and leaves a deficit of at most one id
for each level of the tree. The same tree read upwards gives an id's window from its place in the queue.

With targets, some queues end before others; the corpus is then packed in phases, one for each targeted
queue that ends, over a tree of the targeted queues; what no target names is packed after them in its own proportions.

Every source is a queue of its own, at any number of sources. Up to `most_queues` the driver holds their
totals and tasks get the whole tree. Beyond, totals are a table, the tree is built in subtrees of at most `most_queues`
leaves, and each document is joined to its queue's way through the tree; the pieces are the same. The join is by
(partition, queue), so a hot queue is as spread as its ranges. The driver gets one row for each partition, and totals of targeted queues.

Nulls: a null text is empty (its end id alone); a null source is a queue; a null doc_id sorts first.
Repeated rows are documents of their own. An empty table gives an empty result. Extra columns are ignored.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import public_tokenizers
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common
from .encoder import encoder, in_blocks

WINDOW, MOST_QUEUES = 2048, 4096


def mul_div(x: np.ndarray, a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """floor(x * a / b) and the remainder, for 0 <= a <= b < 2**46 and 0 <= x < 2**48, in 64-bit integers."""
    quotient, rest = np.zeros_like(x), np.zeros_like(x)
    for shift in (32, 16, 0):
        step = (rest << 16) + ((x >> shift) & 0xFFFF) * a
        quotient, rest = (quotient << 16) + step // b, step % b
    return quotient, rest


class Ways:
    """The ways of queues from a tree's root to their leaves."""

    depth: int
    total: int

    def step(self, d: int, queue: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """At the queue's node of level d: ids of its left child, ids of both, and whether the queue is to the right."""
        raise NotImplementedError

    def served(self, queue: np.ndarray, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Of the first x ids of all: how many are the queue's, and how many are those of queues before it."""
        before = np.zeros_like(x)
        for d in range(self.depth):
            left, both, right = self.step(d, queue)
            first = mul_div(x, left, np.maximum(both, 1))[0]
            before = np.where(right, before + first, before)
            x = np.where(right, x - first, first)
        return x, before

    def place(self, queue: np.ndarray, k: np.ndarray) -> np.ndarray:
        """Place among all ids of the queue's id number k."""
        for d in range(self.depth - 1, -1, -1):
            left, both, right = self.step(d, queue)
            own = np.maximum(np.where(right, both - left, left), 1)
            # the least number x of the node's ids of which k + 1 are the child's, less one
            whole, rest = _unscale(np.where(right, k, k + 1), both, own)
            k = np.where(right, whole, whole + (rest > 0) - 1)
        return k


class Tree(Ways):
    """Balanced binary tree over the totals of queues, as arrays by level from the root."""

    def __init__(self, totals: list[int]):
        size = 1 << max(0, (len(totals) - 1).bit_length())
        level = np.array([*totals, *[0] * (size - len(totals))], np.int64)
        self.levels = [level]
        while len(level) > 1:
            level = level[0::2] + level[1::2]
            self.levels.insert(0, level)
        self.depth, self.total = len(self.levels) - 1, int(level[0])

    def step(self, d: int, queue: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        node = queue >> (self.depth - d)
        return self.levels[d + 1][2 * node], self.levels[d][node], ((queue >> (self.depth - d - 1)) & 1).astype(bool)


class Rows(Ways):
    """Ways of a batch's rows, which stand for their queues: of a tree that the task has, or of columns (levels by rows)."""

    def __init__(self, number: np.ndarray, tree: Tree | None = None, left: np.ndarray | None = None, both: np.ndarray | None = None, total: int = 0):
        self.number, self.tree, self.left, self.both = number, tree, left, both
        self.depth, self.total = (tree.depth, tree.total) if tree else (len(left), total)

    def step(self, d: int, row: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        number = self.number[row]
        if self.tree:
            return self.tree.step(d, number)
        return self.left[d][row], self.both[d][row], ((number >> (self.depth - d - 1)) & 1).astype(bool)


def _unscale(k: np.ndarray, both: np.ndarray, own: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """floor(k * both / own) and the remainder, for k <= own <= both < 2**46."""
    whole, part = both // own, both % own
    quotient, rest = mul_div(k, part, own)
    return k * whole + quotient, rest


@dataclass
class Phase:
    begins: int  # ids packed before it
    taken: np.ndarray  # ids of each queue packed before it
    tree: Ways


def phases(totals: list[int], targets: list[float] | None = None) -> list[Phase]:
    """One phase for the corpus's own mixture; with targets, one for each queue that ends."""
    left, taken, out = list(totals), np.zeros(len(totals), np.int64), []
    while any(left):
        if targets is None:
            take = list(left)
        else:
            alive = [q for q in range(len(left)) if left[q] and targets[q] > 0]
            if not alive:
                take = list(left)
            else:
                rounds, ends = min((left[q] / targets[q], q) for q in alive)
                take = [min(left[q], round(targets[q] * rounds)) if q in alive else 0 for q in range(len(left))]
                take[ends] = left[ends]
        out.append(Phase(int(taken.sum()), taken.copy(), Tree(take)))
        taken += np.array(take, np.int64)
        left = [a - b for a, b in zip(left, take)]
    return out


def cut(plan: list[Phase], queue: np.ndarray, start: np.ndarray, length: np.ndarray, window: int = WINDOW) -> tuple[np.ndarray, ...]:
    """Pieces of many documents at once, each the ids start to start + length of a queue.

    Arrays, by document and then by place: document, place in the queue, length, sequence, offset.
    """
    out = []
    for phase, following in zip(plan, [*plan[1:], None]):
        taken = phase.taken[queue]
        first = np.maximum(start, taken) - taken
        last = (np.minimum(start + length, following.taken[queue]) if following else start + length) - taken
        doc = np.flatnonzero(first < last)
        if not len(doc):
            continue
        q, first, last = queue[doc], first[doc], last[doc]
        w_first = (phase.tree.place(q, first) + phase.begins) // window
        n = (phase.tree.place(q, last - 1) + phase.begins) // window - w_first + 1
        at = np.repeat(np.arange(len(doc)), n)
        w = w_first[at] + np.arange(len(at)) - (np.cumsum(n) - n)[at]
        x, until = np.maximum(w * window - phase.begins, 0), np.minimum((w + 1) * window - phase.begins, phase.tree.total)
        mine, ahead = phase.tree.served(q[at], x)
        mine_then, ahead_then = phase.tree.served(q[at], until)
        begin, end = np.maximum(mine, first[at]), np.minimum(mine_then, last[at])
        # in a window, queues stand one after the other; a window that two phases share has the first one's ids before
        offset = x + phase.begins - w * window + (ahead_then - ahead) + (begin - mine)
        some = end > begin
        out.append([v[some] for v in (doc[at], begin + taken[doc][at], end - begin, w, offset)])
    columns = [np.concatenate(v) for v in zip(*out)] if out else [np.zeros(0, np.int64)] * 5
    order = np.lexsort((columns[1], columns[0]))
    return tuple(c[order] for c in columns)


def encode_queues(docs: DataFrame, tokenizer: str, end_id: int, id_col: str, text_col: str, source_col: str) -> DataFrame:
    """Documents by ranges of (queue, doc_id) with their ids, the queue's place in its partition, and each document's start within both."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        code, end = encoder(tokenizer), np.array([end_id], "<u4").tobytes()
        kind = "<u2" if max(code.vocab_size, end_id + 1) <= 1 << 16 else "<u4"
        part, queue, nth, total = TaskContext.get().partitionId(), object(), -1, 0
        for batch in in_blocks(batches):
            places, starts, sizes, ids = [], [], [], []
            for q, raw in zip(batch.column(0).to_pylist(), code.encode_blocks(batch.column(2).to_pylist())):
                if q != queue:
                    queue, nth, total = q, nth + 1, 0
                places.append(nth)
                starts.append(total)
                sizes.append(len(raw) // 4 + 1)
                total += sizes[-1]
                ids.append(np.frombuffer(raw + end, "<u4").astype(kind).tobytes())
            yield pa.RecordBatch.from_arrays(
                [pa.array([part] * batch.num_rows, pa.int32()), batch.column(0), pa.array(places, pa.int64()), batch.column(1), pa.array(starts, pa.int64()), pa.array(sizes, pa.int64()), pa.array(ids, pa.binary())],
                ["part", "queue", "nth", "doc_id", "start", "n", "ids"],
            )

    own = docs.select(F.col(f"`{source_col}`").cast("string").alias("queue"), F.col(f"`{id_col}`").cast("long").alias("doc_id"), common.whole_text(text_col).alias("text"))
    ordered = own.repartitionByRange("queue", "doc_id").sortWithinPartitions("queue", "doc_id")
    return common.map_arrow(ordered, run, "part int, queue string, nth long, doc_id long, start long, n long, ids binary")


def number_queues(coded: DataFrame) -> tuple[dict[int, tuple[int, int]], int]:
    """By partition: the number of its first queue, and that queue's ids in partitions before it; and how many queues there are.

    Partitions are ranges, so only the first queue of one can go on from those before.
    """
    last = F.max(F.struct("nth", (F.col("start") + F.col("n")).alias("n")))
    parts = coded.groupBy("part").agg(F.min_by("queue", "nth").alias("first"), F.max_by("queue", "nth").alias("last"), last.alias("end")).orderBy("part").collect()
    out, number, queue, total = {}, -1, None, 0
    for r in parts:
        goes_on = number >= 0 and r.first == queue
        base, before = (number, total) if goes_on else (number + 1, 0)
        out[r.part] = base, before
        number, queue, total = base + r.end.nth, r.last, r.end.n + (before if r.end.nth == 0 else 0)
    return out, number + 1


def ways(totals: DataFrame, count: int, bits: int) -> DataFrame:
    """Of (number, n), numbers from 0 to count: number, and on its way from the root the ids of left children and of nodes.

    Queues are taken in blocks of 2**bits, each a subtree made in one group; the blocks are the queues of the tree above.
    """
    root, columns = count <= 1 << bits, "number long, block long, left array<long>, both array<long>"

    def run(table: pa.Table) -> pa.Table:
        number, n = (table.column(c).to_numpy() for c in ("number", "n"))
        leaves = np.zeros(count if root else 1 << bits, np.int64)
        own = number & ((1 << bits) - 1)
        leaves[own] = n
        tree = Tree(leaves.tolist())
        steps = [tree.step(d, own) for d in range(tree.depth)]
        lists = [[list(map(int, x)) for x in zip(*(s[c] for s in steps))] if steps else [[]] * len(own) for c in (0, 1)]
        return pa.table([pa.array(number, pa.int64()), pa.array(number >> bits, pa.int64()), *(pa.array(x, pa.list_(pa.int64())) for x in lists)], ["number", "block", "left", "both"])

    blocks = totals.select("number", "n", F.shiftright("number", bits).alias("block"))
    own = blocks.groupBy("block").applyInArrow(run, columns)
    if root:
        return own.drop("block")
    above = ways(blocks.groupBy("block").agg(F.sum("n").alias("n")).withColumnRenamed("block", "number"), (count + (1 << bits) - 1) >> bits, bits)
    above = above.select(F.col("number").alias("block"), F.col("left").alias("l"), F.col("both").alias("b"))
    return own.join(above, "block").select("number", F.concat("l", "left").alias("left"), F.concat("b", "both").alias("both"))


def pack_documents(
    docs: DataFrame, tokenizer: str, end_id: int, window: int = WINDOW, targets: dict[str | None, float] | None = None, most_queues: int = MOST_QUEUES, keep_ids: bool = False, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source"
) -> DataFrame:
    """A row for each piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset, and with keep_ids its ids.

    targets: share of each source in a window (any scale; 0 or none: packed after the others).
    most_queues: beyond so many sources, their totals and the tree are tables.
    """
    spark = docs.sparkSession
    folder = common.shared_dir(spark)
    coded = common.materialise(encode_queues(docs, tokenizer, end_id, id_col, text_col, source_col), folder, "coded")
    parts, count = number_queues(coded)  # a row for each partition
    bases = F.broadcast(spark.createDataFrame([(p, base) for p, (base, _) in parts.items()], "part int, base long"))
    totals = coded.select("part", "nth", "queue", "n").join(bases, "part").groupBy((F.col("base") + F.col("nth")).alias("number")).agg(F.sum("n").alias("n"), F.first("queue").alias("queue"))
    wide = count > most_queues
    if wide:
        totals = common.materialise(totals, folder, "totals")
    wanted = {q: float(t) for q, t in (targets or {}).items() if t > 0}
    named = totals
    if wide:
        names = [q for q in wanted if q is not None]
        named = totals.where(F.col("queue").isin(names) | (F.col("queue").isNull() & F.lit(None in wanted))) if wanted else totals.limit(0)
    held = sorted((r.number, r.n, r.queue) for r in named.collect()) if wanted or not wide else []
    first = [r for r in held if r[2] in wanted]
    of_target = {number: i for i, (number, _, _) in enumerate(first)}
    plan = phases([n for _, n, _ in first], [wanted[q] for _, _, q in first])
    packed, ended = sum(n for _, n, _ in first), np.array([*[n for _, n, _ in first], 0], np.int64)
    tree, rest = None, 0
    if wide:
        left = F.when(F.col("number").isin(list(of_target)), F.lit(0)).otherwise(F.col("n")) if of_target else F.col("n")
        others = totals.select("number", left.cast("long").alias("n"))
        rest = others.agg(F.sum("n")).first()[0]
        runs = coded.select("part", "nth").distinct().join(bases, "part").withColumn("number", F.col("base") + F.col("nth"))
        own = ways(others, count, max(1, most_queues.bit_length() - 1))
        coded = coded.join(runs.join(own, "number").select("part", "nth", "left", "both"), ["part", "nth"])
    else:
        tree = Tree([0 if number in of_target else n for number, n, _ in held])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            raws = batch.column("ids").to_pylist()
            part, nth, start, n = (batch.column(c).to_numpy() for c in ("part", "nth", "start", "n"))
            if not len(n):
                continue
            base, before = np.array([parts[p] for p in part.tolist()], np.int64).T
            number, begins = base + nth, start + np.where(nth == 0, before, 0)
            target = np.array([of_target.get(q, -1) for q in number.tolist()], np.int64)
            if wide:
                left, both = (batch.column(c).flatten().to_numpy().reshape(len(n), -1).T for c in ("left", "both"))
                last = Rows(number, left=left, both=both, total=rest)
            else:
                last = Rows(number, tree)
            # rows without a target have no part in the phases before the last
            mine = [Phase(p.begins, np.where(target < 0, 0, np.append(p.taken, 0)[target]), Rows(target, p.tree)) for p in plan] if (target >= 0).any() else []
            mine.append(Phase(packed, ended[target], last))
            doc, place, length, sequence, offset = cut(mine, np.arange(len(n)), begins, n, window)
            at = place - begins[doc]
            kept: list[list[int]] = []
            crc = np.zeros(len(doc), np.int64)
            k = 0
            for d, raw in enumerate(raws):
                ids = memoryview(np.frombuffer(raw, f"<u{len(raw) // int(n[d])}").astype("<u4").tobytes())
                while k < len(doc) and doc[k] == d:
                    own = ids[4 * int(at[k]) : 4 * int(at[k] + length[k])]
                    crc[k] = zlib.crc32(own)
                    if keep_ids:
                        kept.append(np.frombuffer(own, "<u4").tolist())
                    k += 1
            columns = [batch.column("doc_id").take(pa.array(doc)), *map(pa.array, (at, length, crc, n[doc], sequence, offset))]
            labels = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"]
            if keep_ids:
                columns, labels = [*columns, pa.array(kept, pa.list_(pa.int32()))], [*labels, "ids"]
            yield pa.RecordBatch.from_arrays(columns, labels)

    return common.map_arrow(coded, run, "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long" + ", ids array<int>" * keep_ids)


def op9_mixture_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack_documents(common.documents(spark, sf_dir), public_tokenizers.path("byte_bpe_50k.json"), 1)

"""Operator 5: near-duplicates by SimHash, compared bit-sliced.

Fingerprints: a Python task each batch of documents. Links (at most RADIUS differing bits) are
complete: the 64 bits are cut into bands, and fingerprints within the radius must agree in at
least bands - RADIUS of them; every choice of that many bands is a table, and only equal keys of a
table meet. The bands follow from the number of fingerprints, so a key holds few of them
whatever the corpus. Copies of a fingerprint count once.

Within a key, fingerprints stand in lanes of 64-bit words, bit plane by bit plane. For a
fingerprint and a word, the planes are compared one after the other, and bitwise counters (three planes
of carry-save sums and one of overflow) count the differences of 64 lanes at once; pairs of
fingerprint and word of which every lane exceeds the radius are abandoned. A key with more
than CHUNK fingerprints is dealt out as pairs of chunks, so that no task takes a hot key whole.
A task returns a spanning forest of the links it found, not all pairs.

Components: large-star and small-star rounds over the forests, each written to the shared folder.

Wherever rows meet their group (a key of a table, a star's hub, a component, the copies of a fingerprint), the group is dealt
over salted keys. A key of n fingerprints costs n * n / 2 comparisons, 64 at a time; they are spread, not saved.

Nulls: a null text is empty (fingerprint zero, linked like any other); rows with a null doc_id
get a fingerprint and their component, but never name one unless all of it is null. Repeated rows
are returned as often as they come. An empty table gives an empty result. Extra columns are ignored; the filter keeps them, whatever
their names. Of a component it keeps the document of the least doc_id (rows without one come last), and of that id the one of the
least text hash: one document, and its repeated rows if the table has it more than once.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common

RADIUS, SHINGLE, CHUNK = 4, 4, 512
_ALL = np.uint64(0xFFFFFFFFFFFFFFFF)
_SHIFTS = np.arange(64, dtype=np.uint64)


def fingerprint(text: str, shingle: int = SHINGLE) -> int:
    """Unsigned 64-bit SimHash of a whole text."""
    words = text.encode("utf-8", "surrogatepass").lower().split()  # bytes: only A-Z and the ASCII white space
    if not words:
        return 0
    line = b" ".join(words)
    hashed = xxhash.xxh64_intdigest
    if len(words) <= shingle:
        return hashed(line, 42)
    lengths = np.fromiter(map(len, words), np.int64, len(words))
    ends = np.cumsum(lengths + 1) - 1
    starts = (ends - lengths).tolist()
    h = np.fromiter([hashed(line[a:b], 42) for a, b in zip(starts, ends[shingle - 1 :].tolist())], np.uint64, len(words) - shingle + 1)
    ones = np.zeros(64, np.int64)
    for i in range(0, len(h), 4096):
        bits = np.unpackbits(h[i : i + 4096].astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        ones += bits.sum(axis=0, dtype=np.int64)
    return int(((2 * ones > len(h)).astype(np.uint64) << _SHIFTS).sum(dtype=np.uint64))


def fingerprints(docs: DataFrame, shingle: int = SHINGLE, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, fp (the fingerprint as a signed long) and text_hash (64 bits), which tells texts of one doc_id apart."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fp = np.array([fingerprint(t, shingle) for t in batch.column(1).to_pylist()], np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(fp), batch.column(2)], ["doc_id", "fp", "text_hash"])

    own = docs.select(*_key(id_col, text_col))
    return common.map_arrow(own, run, "doc_id long, fp long, text_hash long")


def _key(id_col: str, text_col: str) -> list[Column]:
    text = common.whole_text(text_col)
    return [F.col(f"`{id_col}`").cast("long").alias("doc_id"), text.alias("text"), F.xxhash64(text).alias("text_hash")]


def tables_for(count: int, radius: int = RADIUS, wanted: int = 64) -> list[int]:
    """Masks of the tables: choices of bands, with about `wanted` of count random fingerprints in a key at most."""
    for bands in range(radius + 1, 2 * radius + 5):
        cuts = [64 * i // bands for i in range(bands + 1)]
        chosen = list(combinations(range(bands), bands - radius))
        masks = [sum(((1 << (cuts[b + 1] - cuts[b])) - 1) << cuts[b] for b in own) for own in chosen]
        if count >> min(m.bit_count() for m in masks) <= wanted:
            break
    return masks


def close_lanes(fps: np.ndarray, queries: np.ndarray, words: np.ndarray, base: np.ndarray, fill: np.ndarray, radius: int = RADIUS) -> np.ndarray:
    """For each pair of a query (fingerprint) and a word, the lanes of the word within the radius, as a bit mask.

    Word k holds the fingerprints fps[base[k] : base[k] + fill[k]].
    """
    lanes = np.zeros((len(base), 64), np.uint64)
    inside = np.arange(64)[None, :] < fill[:, None]
    lanes[inside] = fps[(base[:, None] + np.arange(64)[None, :])[inside]]
    planes = np.empty((64, len(base)), np.uint64)
    for bit in range(64):
        planes[bit] = (((lanes >> np.uint64(bit)) & np.uint64(1)) << _SHIFTS).sum(axis=1, dtype=np.uint64)
    valid = (inside.astype(np.uint64) << _SHIFTS).sum(axis=1, dtype=np.uint64)
    result = np.zeros(len(queries), np.uint64)
    live, q, w = np.arange(len(queries)), queries, words
    over, one, two, four = ~valid[w], *np.zeros((3, len(q)), np.uint64)
    for bit in range(64):
        carry = planes[bit][w] ^ (np.uint64(0) - ((q >> np.uint64(bit)) & np.uint64(1)))
        one, carry = one ^ carry, one & carry
        two, carry = two ^ carry, two & carry
        four, carry = four ^ carry, four & carry
        over |= carry  # eight or more
        if bit % 8 == 7:
            exceeded = over | _exceeds(one, two, four, radius)
            keep = exceeded != _ALL
            if not keep.all():
                live, q, w, over, one, two, four = (x[keep] for x in (live, q, w, over, one, two, four))
    result[live] = ~(over | _exceeds(one, two, four, radius))
    return result


def _exceeds(one: np.ndarray, two: np.ndarray, four: np.ndarray, radius: int) -> np.ndarray:
    """Lanes whose count, below 8, is over the radius (below 8)."""
    out = np.zeros_like(one)
    for value in range(radius + 1, 8):
        out |= (one if value & 1 else ~one) & (two if value & 2 else ~two) & (four if value & 4 else ~four)
    return out


def forest(fps: np.ndarray, bounds: np.ndarray, middle: np.ndarray, radius: int = RADIUS, slab: int = 16384) -> tuple[np.ndarray, np.ndarray]:
    """Links within groups of fingerprints, as (fingerprint, root) of a spanning forest.

    Group g is fps[bounds[g] : bounds[g + 1]]. Where middle[g] is above the group's start, only pairs across
    it are compared (two different chunks of one key); else all pairs of the group.
    """
    start, stop = bounds[:-1], bounds[1:]
    cross = middle > start
    queries_stop = np.where(cross, middle, stop)
    lanes_start = np.where(cross, middle, start)
    n_words = -(-(stop - lanes_start) // 64)
    first_word = np.cumsum(n_words) - n_words
    group_of_word = np.repeat(np.arange(len(start)), n_words)
    nth = np.arange(n_words.sum()) - first_word[group_of_word]
    base = lanes_start[group_of_word] + 64 * nth
    fill = np.minimum(stop[group_of_word] - base, 64)
    label = np.arange(len(fps))
    per_group = (queries_stop - start) * n_words
    total = np.cumsum(per_group)
    for at in range(0, int(total[-1]) if len(total) else 0, slab):
        k = np.arange(at, min(at + slab, int(total[-1])))
        g = np.searchsorted(total, k, side="right")
        inner = k - (total[g] - per_group[g])
        q = start[g] + inner // n_words[g]
        w = first_word[g] + inner % n_words[g]
        useful = cross[g] | (base[w] + fill[w] > q)
        q, w = q[useful], w[useful]
        used, local = np.unique(w, return_inverse=True)
        masks = close_lanes(fps, fps[q], local, base[used], fill[used], radius)
        some = np.flatnonzero(masks)
        bits = np.unpackbits(masks[some].astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        row, lane = np.nonzero(bits)
        label = _join(label, q[some][row], base[w[some]][row] + lane)
    moved = np.flatnonzero(label != np.arange(len(fps)))
    return fps[moved], fps[label[moved]]


def _join(label: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Labels (indices of roots, fully compressed) after the links a-b."""
    while True:
        la, lb = label[a], label[b]
        differ = la != lb
        if not differ.any():
            return label
        a, b, la, lb = a[differ], b[differ], la[differ], lb[differ]
        np.minimum.at(label, np.maximum(la, lb), np.minimum(la, lb))
        while (label[label] != label).any():
            label = label[label]


def find_links(distinct: DataFrame, count: int, radius: int = RADIUS, chunk: int = CHUNK) -> DataFrame:
    """Forest edges (u, v), u > v, over distinct fingerprints fp; every link within the radius is inside one tree."""
    masks = [m - (1 << 64) if m >> 63 else m for m in tables_for(count, radius)]
    table = F.posexplode(F.array(*[F.lit(m).cast("long") for m in masks])).alias("t", "mask")
    keyed = distinct.select("fp", table).select("fp", "t", F.col("fp").bitwiseAND(F.col("mask")).alias("key"))
    with_n = common.with_group(keyed, ["t", "key"], "fp", F.count(F.lit(1)), F.sum, "n").where("n > 1")
    chunks = F.ceil(F.col("n") / F.lit(chunk)).cast("int")
    own = with_n.select("t", "key", "fp", chunks.alias("c"), F.pmod(F.xxhash64("fp", "t"), chunks).cast("int").alias("own"))
    dealt = own.select("t", "key", "fp", "own", F.explode(F.sequence(F.lit(0), F.col("c") - 1)).alias("other"))
    groups = dealt.select("t", "key", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), "own", "fp")
    placed = groups.repartition("t", "key", "i", "j").sortWithinPartitions("t", "key", "i", "j", "own")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] = []
        rows = 0

        def work(columns: np.ndarray) -> pa.RecordBatch:
            group, own, fp = columns[:, :4], columns[:, 4], columns[:, 5]
            new = np.flatnonzero(np.any(group[1:] != group[:-1], axis=1)) + 1
            bounds = np.concatenate([[0], new, [len(fp)]])
            lengths = np.diff(bounds)
            first = np.add.reduceat((own == group[:, 2]).astype(np.int64), bounds[:-1])
            middle = bounds[:-1] + np.where(group[bounds[:-1], 2] == group[bounds[:-1], 3], 0, np.minimum(first, lengths))
            # a pair of chunks of which the first is empty has nothing to compare
            empty = (group[bounds[:-1], 2] != group[bounds[:-1], 3]) & (first == 0)
            if empty.any():
                keep = np.repeat(~empty, lengths)
                return work(columns[keep]) if keep.any() else pa.RecordBatch.from_pydict({"u": pa.array([], pa.int64()), "v": pa.array([], pa.int64())})
            a, b = forest(fp.view(np.uint64), bounds, middle, radius)
            a, b = a.view(np.int64), b.view(np.int64)
            return pa.RecordBatch.from_arrays([pa.array(np.maximum(a, b)), pa.array(np.minimum(a, b))], ["u", "v"])

        for batch in batches:
            held.append(np.stack([np.asarray(c).astype(np.int64) for c in batch.columns], axis=1))
            rows += batch.num_rows
            if rows > 100_000:  # whole groups leave; the last may go on in the next batch
                columns = np.concatenate(held)
                last = np.flatnonzero(np.any(columns[:, :4] != columns[-1, :4], axis=1))
                cut = int(last[-1]) + 1 if len(last) else 0
                if cut:
                    yield work(columns[:cut])
                held, rows = [columns[cut:]], len(columns) - cut
        if rows:
            yield work(np.concatenate(held))

    spark = distinct.sparkSession
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 10_000)
    return placed.mapInArrow(run, "u long, v long").distinct()


def connected(edges: DataFrame, folder: str, most_rounds: int = 60) -> DataFrame:
    """(u, root) for every node with an edge but the roots themselves; root is its component's least node.

    `edges` has u > v, without repeats. A round is a large star and a small star; it has
    settled when both leave the edges as they are.
    """
    spark = edges.sparkSession
    edges = common.materialise(edges, folder, "edges")
    mark = None
    for k in range(most_rounds):
        both = edges.select(F.col("u").alias("n"), F.col("v").alias("x")).unionAll(edges.select(F.col("v").alias("n"), F.col("u").alias("x")))
        large = common.with_group(both, ["n"], "x", F.min("x"), F.min, "m").where("x > n").select(F.col("x").alias("u"), F.least("n", "m").alias("v")).distinct()
        small = common.with_group(large, ["u"], "v", F.min("v"), F.min, "m").select(F.explode(F.array(F.struct(F.col("v").alias("u"), F.col("m").alias("v")), F.struct("u", F.col("m").alias("v")))).alias("e")).select("e.*").where("u <> v").distinct()
        edges = common.materialise(small, folder, f"round{k}")
        now = edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if now == mark:
            return edges.select("u", F.col("v").alias("root"))
        mark = now
    raise RuntimeError(f"components did not settle in {most_rounds} rounds")


def _components(docs: DataFrame, radius: int, shingle: int, id_col: str, text_col: str) -> tuple[DataFrame, DataFrame]:
    """(doc_id, fp, text_hash) of each document, and (fp, first) of each fingerprint: the component's first document, as no_id, doc_id, text_hash."""
    folder = common.shared_dir(docs.sparkSession)
    marked = common.materialise(fingerprints(docs, shingle, id_col, text_col), folder, "fingerprints")
    first = F.min(F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "text_hash"))
    distinct = common.materialise(marked.groupBy("fp").agg(first.alias("least")), folder, "distinct")
    roots = connected(find_links(distinct.select("fp"), distinct.count(), radius), folder)
    rooted = distinct.join(roots.withColumnRenamed("u", "fp"), "fp", "left").select("fp", "least", F.coalesce("root", "fp").alias("root"))
    rooted = common.materialise(rooted, folder, "rooted")
    return marked, common.with_group(rooted, ["root"], "fp", F.min("least"), F.min, "first").select("fp", "first")


def _with_first(marked: DataFrame, components: DataFrame) -> DataFrame:
    """marked with its component's first document; the copies of a fingerprint are dealt over salted keys."""
    salted = marked.withColumn("salt", F.pmod(F.xxhash64("doc_id", "text_hash"), F.lit(common.salts(marked.sparkSession))).cast("int"))
    cells = salted.select("fp", "salt").distinct().join(components, "fp")
    return salted.join(cells, ["fp", "salt"])


def near_duplicates(docs: DataFrame, radius: int = RADIUS, shingle: int = SHINGLE, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """A row for each document: doc_id, fingerprint, component_id."""
    marked, components = _components(docs, radius, shingle, id_col, text_col)
    return _with_first(marked, components).select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), F.col("first.doc_id").alias("component_id"))


def drop_near_duplicates(docs: DataFrame, radius: int = RADIUS, shingle: int = SHINGLE, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One document of each component stays, all columns."""
    marked, components = _components(docs, radius, shingle, id_col, text_col)
    mine = F.col("doc_id").eqNullSafe(F.col("first.doc_id")) & (F.col("text_hash") == F.col("first.text_hash"))
    kept = _with_first(marked, components).where(mine).select(F.col("doc_id").alias("id"), F.col("text_hash").alias("hash")).distinct()
    rows = docs.select(common.whole_row(), *_key(id_col, text_col)).drop("text")
    return rows.join(kept, F.col("doc_id").eqNullSafe(F.col("id")) & (F.col("text_hash") == F.col("hash")), "left_semi").select("row.*")


def op5_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(common.documents(spark, sf_dir))

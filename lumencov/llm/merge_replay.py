"""Operator 8: byte-level BPE by corpus-level merge replay, and its decoding.

The distinct words of a block of the corpus are laid out in one array of symbols. An inverted index
leads from a token pair's rank to all positions in the words where that pair stands; ranks are replayed
in ascending order, each over all its positions at once, and a merge touches its two neighbours
only. Words already known to the worker (a bounded cache) are not replayed again.

A word that is itself in the vocabulary is one id, as in the tiktoken library. Within a word the
order of merges is the library's: lowest rank first, leftmost first. So a rank is applied at the first of its
places in each word, and at a word's next place when it comes up again: a pair of lower rank that the
merge brought up goes before.

The index covers a block of the corpus, not the corpus: to replay each word once for all, every occurrence of a word would have
to be shuffled to its ids and back to its place, many times the text itself. A block ends at BLOCK_CHARS characters or at REPLAY_WORDS
words that are new to the worker, which bounds memory also where hardly a word comes twice; texts over LONG_TEXT characters are
read piece by piece. A word of over LONG_WORD bytes is replayed alone, over one heap of (rank, position), in n log n steps.

Nulls: a null text is empty (no ids); a null doc_id is kept. Repeated rows are returned as
often as they come. An empty table gives an empty result. Extra columns are ignored.
"""

from __future__ import annotations

import base64
import hashlib
import heapq
from array import array
from collections.abc import Iterator
from functools import lru_cache
from itertools import islice

import numpy as np
import public_tokenizers
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common
from .encoder import evenly_spaced

#: Pieces and chunks that a worker keeps; new words of a block; characters of a block.
CACHE_WORDS, REPLAY_WORDS, BLOCK_CHARS = 300_000, 400_000, 16 << 20
#: Bytes of a word, and characters of a text, beyond which it is taken alone.
LONG_WORD, LONG_TEXT = 512, 1 << 20


def read_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as lines:
        return {base64.b64decode(a): int(b) for a, b in (line.split() for line in lines if line.strip())}


class MergeReplay:
    def __init__(self, path: str, pattern: str, cache_words: int = CACHE_WORDS):
        self.ranks = read_ranks(path)
        self.bytes_of = {k: t for t, k in self.ranks.items()}
        self.decimal_of = {k: str(k) for k in self.bytes_of}
        self.of_byte = np.array([self.ranks[bytes([b])] for b in range(256)])
        pairs = {}
        for token, rank in self.ranks.items():
            for k in range(1, len(token)):
                if (a := self.ranks.get(token[:k])) is not None and (b := self.ranks.get(token[k:])) is not None:
                    pairs[a << 32 | b] = rank
        self.pair_keys = np.array(sorted(pairs), np.int64)
        self.pair_ranks = np.array([pairs[k] for k in sorted(pairs)], np.int64)
        self.split, self.pieces_of = regex.compile(pattern).findall, regex.compile(pattern).finditer
        self.cache: dict[str, bytes] = {}  # of pieces
        self.chunks: dict[str, bytes] = {}  # of what stands between two spaces, with the first of them
        self.cache_words = cache_words

    def _ranks_of(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Rank of each pair of tokens, -1 where they don't merge (or are no tokens)."""
        keys = (a << 32) | b
        at = np.minimum(np.searchsorted(self.pair_keys, keys), len(self.pair_keys) - 1)
        return np.where((self.pair_keys[at] == keys) & (a >= 0) & (b >= 0), self.pair_ranks[at], -1)

    def replay(self, words: list[bytes]) -> list[list[int]]:
        """Ids of each word."""
        whole = [self.ranks.get(w) for w in words]
        rest = [k for k, w in enumerate(whole) if w is None and 0 < len(words[k]) <= LONG_WORD]
        out: list[list[int]] = [[w] if w is not None else [] for w in whole]
        for k, w in enumerate(words):
            if len(w) > LONG_WORD and whole[k] is None:
                out[k] = self.replay_long(w)
        if not rest:
            return out
        data = np.frombuffer(b"".join(words[k] for k in rest), np.uint8)
        lengths = np.array([len(words[k]) for k in rest])
        # one symbol for each byte, and an end (-1) before the first word and after every word
        word = np.repeat(np.arange(len(rest)), lengths + 1)
        symbol = np.full(len(word) + 1, -1, np.int64)
        inside = np.ones(len(word), bool)
        ends = np.cumsum(lengths + 1) - 1
        inside[ends] = False
        symbol[1:][inside] = self.of_byte[data]
        word = np.concatenate([[-1], word])
        after, before = np.arange(1, len(symbol) + 1), np.arange(-1, len(symbol) - 1)
        pair = np.append(self._ranks_of(symbol[:-1], symbol[1:]), -1)  # rank of the pair that begins at each place
        index: dict[int, list[np.ndarray]] = {}
        heap: list[int] = []

        def enter(places: np.ndarray, ranks: np.ndarray) -> None:
            order = np.argsort(ranks, kind="stable")
            places, ranks = places[order], ranks[order]
            cuts = np.flatnonzero(ranks[1:] != ranks[:-1]) + 1
            edges = [0, *cuts.tolist(), len(ranks)]
            for r, x, y in zip(ranks[edges[:-1]].tolist(), edges, edges[1:]):
                if r in index:
                    index[r].append(places[x:y])
                else:
                    index[r] = [places[x:y]]
                    heapq.heappush(heap, r)

        there = np.flatnonzero(pair >= 0)
        if len(there):
            enter(there, pair[there])
        while heap:
            r = heapq.heappop(heap)
            listed = index.pop(r)
            p = listed[0] if len(listed) == 1 else np.sort(np.concatenate(listed))
            p = p[pair[p] == r]
            if not len(p):
                continue
            if len(p) > 1:
                own = word[p]
                first = np.concatenate([[True], own[1:] != own[:-1]])
                if not first.all():  # a word's second place waits: a pair of lower rank may come first
                    index[r] = [p[~first]]
                    heapq.heappush(heap, r)
                    p = p[first]
            q = after[p]
            n, b = after[q], before[p]
            symbol[p] = r
            symbol[q] = -2
            pair[q] = -1
            after[p] = n
            before[n] = p
            places = np.concatenate([p, b])
            ranks = self._ranks_of(symbol[places], symbol[np.concatenate([n, p])])
            pair[places] = ranks
            new = ranks >= 0
            if new.any():
                enter(places[new], ranks[new])
        kept = symbol >= 0
        ids, owner = symbol[kept], word[kept]
        edges = np.searchsorted(owner, np.arange(len(rest) + 1))
        listed = ids.tolist()
        for k, x, y in zip(rest, edges.tolist(), edges[1:].tolist()):
            out[k] = listed[x:y]
        return out

    def replay_long(self, word: bytes) -> list[int]:
        """Ids of one word; the index is a heap of (rank, position), and a merge enters its two new pairs."""
        symbol = array("i", self.of_byte[np.frombuffer(word, np.uint8)].tolist())
        n = len(symbol)
        after, before = array("i", range(1, n + 1)), array("i", range(-1, n - 1))
        first = self._ranks_of(np.array(symbol[:-1], np.int64), np.array(symbol[1:], np.int64))
        pair = array("i", [*first.tolist(), -1])  # rank of the pair that begins at each place
        places = np.flatnonzero(first >= 0)
        heap = ((first[places] << 32) | places).tolist()
        heapq.heapify(heap)
        rank_of, text_of = self.ranks.get, self.bytes_of
        while heap:
            top = heapq.heappop(heap)
            rank, p = top >> 32, top & 0xFFFFFFFF
            if pair[p] != rank:
                continue
            q = after[p]
            r, b = after[q], before[p]
            symbol[p], symbol[q], pair[q], after[p] = rank, -1, -1, r
            if r < n:
                before[r] = p
            for x, y in ((p, r), (b, p)):
                if x >= 0 and y < n:
                    new = rank_of(text_of[symbol[x]] + text_of[symbol[y]], -1)
                    pair[x] = new
                    if new >= 0:
                        heapq.heappush(heap, new << 32 | x)
                elif x >= 0:
                    pair[x] = -1
        return [x for x in symbol if x >= 0]

    def _known(self, pieces: list[list[str]]) -> list[bytes]:
        """Ids of lists of pieces."""
        missing = list(set().union(*pieces).difference(self.cache))
        for i in range(0, len(missing), REPLAY_WORDS):
            part = missing[i : i + REPLAY_WORDS]
            self.cache.update(zip(part, [array("I", ids).tobytes() for ids in self.replay([w.encode("utf-8") for w in part])]))
        get = self.cache.__getitem__
        return [get(p[0]) if len(p) == 1 else b"".join(map(get, p)) for p in pieces]

    def _trim(self) -> None:
        for kept in (self.cache, self.chunks):
            if len(kept) > self.cache_words:
                early = list(islice(kept.items(), self.cache_words // 2))
                kept.clear()
                kept.update(early)

    def _block(self, heads: list[list[str]], tails: list[list[str]], missing: set[str]) -> Iterator[bytes]:
        new = list(missing)
        found = self._known([*heads, *[[" " + c] if c.isalpha() else self.split(" " + c) for c in new]])
        self.chunks.update(zip(new, found[len(heads) :]))
        get = self.chunks.__getitem__
        for raw, tail in zip(found, tails):
            yield raw + b"".join(map(get, tail))
        self._trim()

    def encode_raw(self, texts: list[str]) -> Iterator[bytes]:
        """Each text's ids, as unsigned 32-bit integers.

        Where single spaces stand between other characters, no piece crosses from before a space to it, so the
        chunks between spaces are looked up; other texts go by their pieces.
        """
        self._trim()
        heads, tails, missing, loose = [], [], set(), 0
        for t in texts:
            if len(t) > LONG_TEXT:
                yield from self._block(heads, tails, missing)
                heads, tails, missing, loose = [], [], set(), 0
                yield self._long(t)
                continue
            head, *tail = t.split(" ") if evenly_spaced(t) else (t,)
            heads.append(self.split(head))
            tails.append(tail)
            missing.update(set(tail).difference(self.chunks))
            loose += len(heads[-1])
            if len(missing) + loose >= REPLAY_WORDS:
                yield from self._block(heads, tails, missing)
                heads, tails, missing, loose = [], [], set(), 0
        yield from self._block(heads, tails, missing)

    def _long(self, text: str) -> bytes:
        out, pieces = [], self.pieces_of(text)
        while part := [m[0] for m in islice(pieces, LONG_TEXT // 8)]:
            out += self._known([part])
            self._trim()
        return b"".join(out)

    def encode(self, texts: list[str]) -> Iterator[list[int]]:
        """Each text's ids."""
        for raw in self.encode_raw(texts):
            yield np.frombuffer(raw, "<u4").tolist()

    def decode(self, ids: list[int]) -> bytes:
        return b"".join(map(self.bytes_of.__getitem__, ids))

    def in_decimal(self, ids: list[int]) -> str:
        return ",".join(map(self.decimal_of.__getitem__, ids))


@lru_cache(2)
def replayer(path: str, pattern: str) -> MergeReplay:
    """One for each worker process."""
    return MergeReplay(path, pattern)


def _in_parts(rows: Iterator, size: int) -> Iterator[tuple[int, list]]:
    """(place of the first, up to `size` rows), lazily."""
    at = 0
    while part := list(islice(rows, size)):
        yield at, part
        at += len(part)


def encode_decode(docs: DataFrame, ranks: str, pattern: str = public_tokenizers.PATTERN, keep_ids: bool = False, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """A row for each document: doc_id, n_tokens, ids_sha256, decoded_sha256, and with keep_ids the ids and the decoded text themselves."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        code = replayer(ranks, pattern)
        def answer(doc_ids: list, texts: list[str]) -> Iterator[pa.RecordBatch]:
            for i, rows in _in_parts(code.encode_raw(texts), 512):
                n, said, back, ids_out, text_out = [], [], [], [], []
                for raw in rows:
                    ids = np.frombuffer(raw, "<u4")
                    decimal, decoded = hashlib.sha256(), hashlib.sha256()
                    for at in range(0, len(ids), 1 << 16):
                        listed = ids[at : at + (1 << 16)].tolist()
                        decimal.update(("," * (at > 0) + code.in_decimal(listed)).encode())
                        decoded.update(code.decode(listed))
                    n.append(len(ids))
                    said.append(decimal.hexdigest())
                    back.append(decoded.hexdigest())
                    if keep_ids:
                        ids_out.append(ids.tolist())
                        text_out.append(code.decode(ids.tolist()).decode("utf-8", "replace"))
                columns = {"doc_id": pa.array(doc_ids[i : i + len(n)], pa.int64()), "n_tokens": pa.array(n, pa.int64()), "ids_sha256": pa.array(said, pa.string()), "decoded_sha256": pa.array(back, pa.string())}
                if keep_ids:
                    columns |= {"ids": pa.array(ids_out, pa.list_(pa.int32())), "decoded": pa.array(text_out, pa.string())}
                yield pa.RecordBatch.from_pydict(columns)

        doc_ids, texts, chars = [], [], 0
        for batch in batches:
            doc_ids += batch.column(0).to_pylist()
            texts += batch.column(1).to_pylist()
            chars += sum(map(len, texts[len(texts) - batch.num_rows :]))
            if chars >= BLOCK_CHARS:
                yield from answer(doc_ids, texts)
                doc_ids, texts, chars = [], [], 0
        if texts:
            yield from answer(doc_ids, texts)

    own = docs.select(F.col(f"`{id_col}`").cast("long").alias("doc_id"), common.whole_text(text_col).alias("text"))
    return common.map_arrow(own, run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string" + ", ids array<int>, decoded string" * keep_ids)


def op8_merge_replay(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encode_decode(common.documents(spark, sf_dir), public_tokenizers.path("byte_bpe_multi_50k.tiktoken"))

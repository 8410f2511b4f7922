"""Encoding of whole texts by the tokenizers library, with a bounded cache of chunks.

Byte-level BPE merges never cross the pieces that the pre-tokenizer cuts, and a piece never crosses from
a character that isn't white space to a space. So where single spaces stand between other
characters, the text between two spaces, with the first of them, is encoded alike everywhere: the library's
model has to see each such chunk once only, its ids are kept, and a text's ids are those of its chunks joined.
`encode_blocks` cuts plainly spaced texts together, as Arrow columns: each distinct chunk of a block of texts is looked up once, and the ids of
all are taken by number. A line feed begins a chunk too, as no piece crosses from another character to it; runs of three, or of
two at the end, are cut otherwise by the pre-tokenizer, and such texts go one by one.
Texts with characters beyond Latin go through the library whole, as its pre-tokenizer and the pattern here may
follow different Unicode versions there.

The strings of special tokens in a text are what the library makes of them by default, their special ids; with
`specials` false they are ordinary text, so that no text can hold such an id.
"""

from __future__ import annotations

import os
import re
from array import array
from collections.abc import Iterator
from functools import lru_cache
from operator import attrgetter

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex

#: Chunks that a worker keeps: about 40 bytes each in columns, 200 as objects.
CACHE_CHUNKS, CACHE_COLUMNS = 800_000, 1_500_000
KEPT_LENGTH = 40  # characters of a chunk that is kept: longer ones rarely come again
BLOCK_BYTES = BLOCK_CHARS = 8 << 20  # of texts that are cut at once
_UNUSUAL = re.compile("[^\t\n\r -~¡-¬®-ɏ]")
_CONTROL = re.compile("[\x00-\x08\x0b\x0c\x0e-\x1f\x7f]")
_ID = attrgetter("id")
_OTHER_SPACE = re.compile(r"[^\S\n ]")
#: In Arrow's syntax: what a plainly spaced text hasn't.
_UNPLAIN = r"[^\n -~¡-¬®-ɏ]|  | \n|\n |\A | \z|\n\n\n|\n\n\z"
_MARKS = pa.array([*",.;:!?"], pa.large_string())
#: Stands before a text's first chunk, which has no space before it.
_HEAD = "\0"


def evenly_spaced(text: str) -> bool:
    """Whether every space stands alone between two characters that are no white space, and no white space but line feeds is there."""
    return not ("  " in text or " \n" in text or "\n " in text or text[:1] == " " or text[-1:] == " " or _OTHER_SPACE.search(text))


def byte_letters() -> dict[int, str]:
    """The letter that byte-level vocabularies write for each byte: itself if it prints, else the next from U+0100 on."""
    own = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in own]
    return {b: chr(b) for b in own} | {b: chr(256 + k) for k, b in enumerate(rest)}


class _Kept(dict):
    """Values by key, made when first asked for; what wasn't asked for through two halves of the bound goes."""

    def __init__(self, make):
        super().__init__()
        self.make, self.older = make, {}

    def __missing__(self, key):
        value = self.older.pop(key, None)
        if value is None:
            value = self.make(key)
        if len(key) <= KEPT_LENGTH:
            self[key] = value
        return value

    def bound(self, most: int) -> None:
        if len(self) > most // 2:
            self.older = dict(self)
            self.clear()


def _thousands(words: list[str]) -> Iterator[list[str]]:
    return (words[i : i + 1000] for i in range(0, len(words), 1000))


def in_blocks(batches: Iterator[pa.RecordBatch], most: int = BLOCK_BYTES) -> Iterator[pa.RecordBatch]:
    """The same rows in batches of about `most` bytes, or of one batch that is longer."""
    held, size = [], 0
    for batch in batches:
        if held and size + batch.nbytes > most:
            yield from pa.Table.from_batches(held).combine_chunks().to_batches()
            held, size = [], 0
        held.append(batch)
        size += batch.nbytes
    if held:
        yield from pa.Table.from_batches(held).combine_chunks().to_batches()


class TextEncoder:
    def __init__(self, path: str, cache_chunks: int = CACHE_CHUNKS, specials: bool = True, cache_columns: int = CACHE_COLUMNS):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        import public_tokenizers
        from tokenizers import Tokenizer
        from tokenizers.pre_tokenizers import WhitespaceSplit

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = not specials
        added = [re.escape(t.content) for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.special = re.compile("|".join(added)).search if specials and added else lambda text: None
        self.unplain = "|".join([_UNPLAIN, *added]) if specials else _UNPLAIN
        self.model = self.tokenizer.model
        self.vocab_size = self.tokenizer.get_vocab_size()
        self.split = regex.compile(public_tokenizers.PATTERN).findall
        self.space = byte_letters()[32]
        self.letters = str.maketrans({chr(b): c for b, c in byte_letters().items()})
        self.pieces, self.chunks = _Kept(self._piece), _Kept(self._chunk)
        self.cache_chunks, self.cache_columns = cache_chunks, cache_columns
        self.known, self.known_ids = pa.array([], pa.large_string()), pa.array([], pa.large_binary())
        #: The model without a pre-tokenizer but for spaces, which byte letters haven't.
        self.bare = Tokenizer(self.model)
        self.bare.pre_tokenizer = WhitespaceSplit()
        self.word_letters = {k: v for k, v in self.letters.items() if k != 32}
        self.spaced, self.feeds = np.zeros(self.vocab_size, bool), np.zeros(self.vocab_size, bool)
        feed = byte_letters()[10]
        for token, i in self.tokenizer.get_vocab().items():
            self.spaced[i], self.feeds[i] = token.startswith(self.space), token == feed

    def _piece(self, piece: str) -> bytes:
        written = piece.encode().decode("latin-1").translate(self.letters)
        return array("I", map(_ID, self.model.tokenize(written))).tobytes()

    def _chunk(self, chunk: str) -> bytes:
        """Ids of a chunk, given without the space before it."""
        if chunk.isalpha():
            written = chunk if chunk.isascii() else chunk.encode().decode("latin-1").translate(self.letters)
            return array("I", map(_ID, self.model.tokenize(self.space + written))).tobytes()
        if chunk[-1] in ",.;:!?" and chunk[:-1].isalpha():  # a word and a mark are two pieces
            return self.chunks[chunk[:-1]] + self.pieces[chunk[-1]]
        return b"".join(map(self.pieces.__getitem__, self.split(" " + chunk)))

    def _whole(self, texts: list[str]) -> list[bytes]:
        return [np.array(e.ids, "<u4").tobytes() for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def _joined(self, tokenizer, texts: list[str], starts: np.ndarray) -> pa.Array:
        """Ids of the chunks that texts are made of, each of which has one id of `starts`, its first."""
        ids = np.concatenate([np.array(e.ids, "<u4") for e in tokenizer.encode_batch_fast(texts, add_special_tokens=False)])
        offsets = np.append(np.flatnonzero(starts[ids]), len(ids)).astype(np.int64) * 4
        return pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(offsets) - 1, [None, pa.py_buffer(offsets), pa.py_buffer(ids)])

    def _words(self, words: list[str]) -> pa.Array:
        """A word of letters is one piece: the model alone sees it, in byte letters."""
        texts = [" ".join(some) for some in _thousands(words)]
        texts = [t if t.isascii() else t.encode().decode("latin-1").translate(self.word_letters) for t in texts]
        return self._joined(self.bare, [self.space + t.replace(" ", " " + self.space) for t in texts], self.spaced)

    def _lines(self, chunks: list[str]) -> pa.Array:
        return self._joined(self.tokenizer, ["".join(some) for some in _thousands(chunks)], self.feeds)

    def _others(self, chunks: list[str]) -> pa.Array:
        return self._joined(self.tokenizer, [" " + " ".join(some) for some in _thousands(chunks)], self.spaced)

    def _heads(self, chunks: list[str]) -> pa.Array:
        return pa.array([b"".join(map(self.pieces.__getitem__, self.split(c.removeprefix(_HEAD)))) for c in chunks], pa.large_binary())

    def _distinct(self, chunks: pa.Array) -> pa.Array:
        """Ids of distinct chunks; the library sees many of a kind as one text."""
        keys, begun, fed = chunks.to_numpy(zero_copy_only=False), pc.starts_with(chunks, _HEAD).to_numpy(zero_copy_only=False), pc.starts_with(chunks, "\n").to_numpy(zero_copy_only=False)
        alone = begun | pc.equal(chunks, "\n").to_numpy(zero_copy_only=False)
        letters = pc.utf8_is_alpha(chunks).to_numpy(zero_copy_only=False)
        parts, order = [pa.array([], pa.large_binary())], []
        for some, make in ((letters, self._words), (alone, self._heads), (fed & ~alone, self._lines), (~(letters | begun | fed), self._others)):
            at = np.flatnonzero(some)
            if len(at):
                parts.append(make(keys[at].tolist()))
                order.append(at)
        place = np.empty(len(keys), np.int64)
        place[np.concatenate(order)] = np.arange(len(keys))
        return pa.concat_arrays(parts).take(pa.array(place))

    def _looked_up(self, chunks: pa.Array) -> pa.Array:
        """Ids of distinct chunks, kept from block to block; beyond the bound those of the last block stay."""
        if 16 * len(chunks) < len(self.known):  # not worth a look at all that is known
            return self._distinct(chunks)
        at = pc.index_in(chunks, self.known)
        new = pc.is_null(at)
        if pc.any(new).as_py():
            unknown = chunks.filter(new)
            first, made = len(self.known), self._distinct(unknown)
            self.known, self.known_ids = pa.concat_arrays([self.known, unknown]), pa.concat_arrays([self.known_ids, made])
            missing = new.to_numpy(zero_copy_only=False)
            at = pa.array(np.where(missing, first + np.cumsum(missing) - 1, at.fill_null(0).to_numpy()))
        ids = self.known_ids.take(at)
        if len(self.known) > self.cache_columns:
            short = pc.less_equal(pc.binary_length(chunks), KEPT_LENGTH)
            self.known, self.known_ids = chunks.filter(short), ids.filter(short)
        return ids

    def _block(self, cuts: list[str]) -> list[bytes]:
        """Ids of each part of plainly spaced texts."""
        self.pieces.bound(self.cache_chunks // 2)
        chunks = pc.split_pattern(pa.array(cuts, pa.large_string()), " ")
        numbered = chunks.flatten().dictionary_encode()
        # a word and a mark are two pieces: such chunks are looked up by the word
        marked = pc.and_(pc.is_in(pc.utf8_slice_codeunits(numbered.dictionary, -1), _MARKS), pc.greater(pc.binary_length(numbered.dictionary), 1))
        stems = pc.utf8_slice_codeunits(numbered.dictionary.filter(marked), 0, -1)
        letters = pc.utf8_is_alpha(stems)
        stems, at = stems.filter(letters), np.flatnonzero(marked.to_numpy(zero_copy_only=False))[letters.to_numpy(zero_copy_only=False)]
        is_rest = np.ones(len(marked), bool)
        is_rest[at] = False
        marks = pc.utf8_slice_codeunits(numbered.dictionary.take(pa.array(at)), -1).dictionary_encode()
        words = pa.concat_arrays([numbered.dictionary.filter(pa.array(is_rest)), stems]).dictionary_encode()
        ids = self._looked_up(words.dictionary).take(words.indices)
        of_marks = pa.array([self.pieces[m] for m in marks.dictionary.to_pylist()], pa.large_binary()).take(marks.indices)
        rest = len(ids) - len(at)
        ids = pa.concat_arrays([ids.slice(0, rest), pc.binary_join_element_wise(ids.slice(rest), of_marks, pa.scalar(b"", pa.large_binary()))])
        place = np.cumsum(is_rest) - 1
        place[at] = rest + np.arange(len(at))
        _, offsets, ids = ids.take(pa.array(place[numbered.indices.to_numpy()])).buffers()
        ends = np.frombuffer(offsets, np.int64)[chunks.offsets.to_numpy()].tolist()
        ids = memoryview(ids or b"")
        return [bytes(ids[a:b]) for a, b in zip(ends, ends[1:])]

    def _plain(self, texts: list[str]) -> list[bytes]:
        """In blocks of bounded size; a longer text is cut at spaces into several."""
        parts: list[list[bytes]] = [[] for _ in texts]
        cuts, owners, held = [], [], 0

        def flush() -> None:
            nonlocal held
            for i, raw in zip(owners, self._block(cuts)):
                parts[i].append(raw)
            cuts.clear()
            owners.clear()
            held = 0

        for i, text in enumerate(texts):
            text, begin = _HEAD + text.replace("\n", " \n"), 0
            while begin <= len(text):
                end = text.find(" ", begin + BLOCK_CHARS) if len(text) - begin > BLOCK_CHARS else -1
                end = len(text) if end < 0 else end
                if cuts and held + end - begin > BLOCK_CHARS:
                    flush()
                cuts.append(text[begin:end])
                owners.append(i)
                held, begin = held + end - begin, end + 1
        if cuts:
            flush()
        return [p[0] if len(p) == 1 else b"".join(p) for p in parts]

    def encode(self, texts: list[str]) -> list[bytes]:
        """For each text its ids as little-endian unsigned 32-bit integers."""
        out, rest = [], []
        for i, text in enumerate(texts):
            if (_CONTROL if text.isascii() else _UNUSUAL).search(text) or self.special(text):
                rest.append(i)
                out.append(b"")
                continue
            self.pieces.bound(self.cache_chunks // 2)
            self.chunks.bound(self.cache_chunks)
            if evenly_spaced(text):
                head, *tail = text.split(" ")
                first = b"".join(map(self.pieces.__getitem__, self.split(head)))
                out.append(first + b"".join(map(self.chunks.__getitem__, tail)))
            else:
                out.append(b"".join(map(self.pieces.__getitem__, self.split(text))))
        for i, raw in zip(rest, self._whole([texts[i] for i in rest]) if rest else ()):
            out[i] = raw
        return out

    def encode_blocks(self, texts: list[str]) -> list[bytes]:
        """As encode, plainly spaced texts together: for many texts at once, some megabytes."""
        unplain = pc.match_substring_regex(pa.array(texts, pa.large_string()), self.unplain).to_pylist()
        plain, rest = ([t for t, u in zip(texts, unplain) if bool(u) is kind] for kind in (False, True))
        sides = iter(self._plain(plain)), iter(self.encode(rest))
        return [next(sides[u]) for u in unplain]


@lru_cache(2)
def encoder(path: str, specials: bool = True) -> TextEncoder:
    """One for each worker process."""
    return TextEncoder(path, specials=specials)

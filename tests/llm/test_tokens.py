import hashlib
import io
import zlib
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from lumencov.llm import files, merge_replay, separator_scan, token_files
from lumencov.llm.encoder import TextEncoder, encoder

from . import frames

JSON, MULTI = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("byte_bpe_multi_50k.tiktoken")


@pytest.fixture(scope="module")
def plain():
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(JSON)
    return lambda text: t.encode(text, add_special_tokens=False).ids


@pytest.fixture(scope="module")
def ordinary():
    """Strings of special tokens are ordinary text."""
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(JSON)
    t.encode_special_tokens = True
    return lambda text: t.encode(text, add_special_tokens=False).ids


@pytest.fixture(scope="module")
def library():
    import tiktoken

    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=merge_replay.read_ranks(MULTI), special_tokens={})


_TEXT = st.lists(st.one_of(st.sampled_from([*"ab 's\n\t\r  é.1!<|>", "<|endoftext|>"]), st.characters(exclude_categories=["Cs"])), max_size=60).map("".join)


@settings(max_examples=300, deadline=None)
@given(st.lists(_TEXT, max_size=5))
def test_encoder_is_the_library(plain, ordinary, texts):
    assert [np.frombuffer(b, "<u4").tolist() for b in encoder(JSON).encode(texts)] == [plain(t) for t in texts]
    assert [np.frombuffer(b, "<u4").tolist() for b in encoder(JSON, specials=False).encode(texts)] == [ordinary(t) for t in texts]


def test_string_of_a_special_token(plain, ordinary):
    text = "hello <|endoftext|> bye"
    (special,), (own,) = encoder(JSON).encode([text]), encoder(JSON, specials=False).encode([text])
    assert np.frombuffer(special, "<u4").tolist() == plain(text) and 50256 in plain(text)
    assert np.frombuffer(own, "<u4").tolist() == ordinary(text) and 50256 not in ordinary(text)


def test_encoder_with_a_tiny_cache(plain):
    code = TextEncoder(JSON, cache_chunks=4)
    texts = [frames.text_of(t) for _, t in frames.TEXTS] * 2
    for k in range(0, len(texts), 3):
        assert [np.frombuffer(b, "<u4").tolist() for b in code.encode(texts[k : k + 3])] == [plain(t) for t in texts[k : k + 3]]


@settings(max_examples=300, deadline=None)
@given(st.lists(_TEXT, max_size=5))
def test_replay_is_the_library(library, texts):
    code = merge_replay.replayer(MULTI, public_tokenizers.PATTERN)
    for t, ids in zip(texts, code.encode(texts)):
        assert ids == library.encode_ordinary(t)
        assert code.in_decimal(ids) == ",".join(map(str, ids)) and code.decode(ids) == t.encode()


def test_replay_where_a_merge_brings_up_a_lower_rank(tmp_path):
    """Ranks out of the order of training: the leftmost least pair of the word still goes first."""
    import base64

    import tiktoken

    ranks = {bytes([b]): b for b in range(256)} | {b"aba": 256, b"ab": 257, b"ba": 300, b"abab": 301, b"aa": 258}
    path = tmp_path / "r"
    path.write_bytes(b"".join(base64.b64encode(k) + b" %d\n" % v for k, v in ranks.items()))
    code, own = merge_replay.MergeReplay(str(path), r"\w+"), tiktoken.Encoding("t", pat_str=r"\w+", mergeable_ranks=ranks, special_tokens={})
    for n in range(1, 9):
        for k in range(2**n):
            word = "".join("ab"[k >> i & 1] for i in range(n))
            assert code.replay([word.encode()])[0] == own.encode_ordinary(word), word
            if word.encode() not in ranks:
                assert code.replay_long(word.encode()) == own.encode_ordinary(word), word


@pytest.mark.parametrize("word", ["ab" * 500_000, "a" * 1_000_000, "".join(np.random.default_rng(5).choice(list("etaoinsr"), 1_000_000))], ids=["ab", "a", "letters"])
def test_replay_of_a_word_of_a_megabyte(word):
    """In n log n steps; tiktoken agrees on a word of 20,000 (its own time grows with the square), and the bytes come back."""
    import time

    import tiktoken

    code = merge_replay.replayer(MULTI, public_tokenizers.PATTERN)
    own = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=code.ranks, special_tokens={})
    assert code.replay([word[:20_000].encode()])[0] == own.encode_ordinary(word[:20_000])
    began = time.time()
    (ids,) = code.encode([word])
    assert code.decode(ids) == word.encode() and time.time() - began < 60


@pytest.mark.parametrize("limit", ["LONG_WORD", "LONG_TEXT", "REPLAY_WORDS"])
def test_limits_of_a_block_change_nothing(library, limit, monkeypatch):
    texts = [frames.text_of(t) for _, t in frames.TEXTS] + ["abab" * 40 + " x", "lower ranks come up: " + "ingtheing" * 30]
    monkeypatch.setattr(merge_replay, limit, 8)
    code = merge_replay.MergeReplay(MULTI, public_tokenizers.PATTERN, cache_words=50)
    assert list(code.encode(texts)) == [library.encode_ordinary(t) for t in texts]


def test_replay_query(spark, library):
    got = {r.doc_id: r for r in merge_replay.encode_decode(frames.documents(spark), MULTI, keep_ids=True).collect()}
    for d, t in frames.TEXTS:
        ids = library.encode_ordinary(frames.text_of(t))
        r = got[d]
        assert (r.n_tokens, r.ids, r.decoded) == (len(ids), ids, frames.text_of(t))
        assert r.ids_sha256 == hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest() and r.decoded_sha256 == hashlib.sha256(frames.text_of(t).encode()).hexdigest()
    assert merge_replay.encode_decode(frames.documents(spark), MULTI).count() == len(frames.TEXTS)
    assert merge_replay.encode_decode(frames.empty(spark), MULTI).count() == 0


@given(st.integers(1, 32), st.integers(0, 200), st.integers(0, 2**32 - 1))
def test_pack_round_trip(bits, count, seed):
    ids = np.random.default_rng(seed).integers(0, 2**bits, count, dtype=np.uint64).astype("<u4")
    data = token_files.pack(ids, bits)
    assert len(data) == -(-bits * count // 8) and token_files.unpack(data, bits, count).tolist() == ids.tolist()


class _Source(io.BytesIO):
    def size(self):
        return len(self.getvalue())


@pytest.mark.parametrize("vocab", [2, 300, 50257, 65536, 100_000])
def test_packed_file_random_access(vocab):
    r = np.random.default_rng(vocab)
    docs = [r.integers(0, vocab, n).astype("<u4") for n in (3, 0, 1000, 64, 1, 777, 64)]
    out = _Source()
    out.close = lambda: None
    writer = token_files.PackedWriter(out, vocab, block_tokens=64)
    for k, d in enumerate(docs):
        writer.add(k if k else None, d)
    writer.close()
    packed, whole = token_files.PackedReader(out), np.concatenate(docs)
    assert packed.bits == (vocab - 1).bit_length() and packed.doc_ids == [None, 1, 2, 3, 4, 5, 6]
    for _ in range(200):
        a, b = sorted(r.integers(0, len(whole) + 1, 2).tolist())
        assert packed.read(a, b).tolist() == whole[a:b].tolist()


@pytest.mark.parametrize("block", [64, 1 << 16])
def test_token_files(spark, plain, tmp_path, block):
    folder = f"file://{tmp_path}"
    shards = token_files.write_token_files(frames.documents(spark), folder, JSON, 0, block_tokens=block).collect()
    first, listed = 0, []
    for s in sorted(shards, key=lambda s: s.shard):
        listed.append((s.path, first))
        first += s.n_tokens
    rows = token_files.read_token_files(spark.createDataFrame(listed, "path string, first long")).collect()
    want = {d: [*plain(frames.text_of(t)), 0] for d, t in frames.TEXTS}
    assert Counter(r.doc_id for r in rows) == Counter(d for d, _ in frames.TEXTS)
    start = 0
    for r in sorted(rows, key=lambda r: r.start):
        ids = want[r.doc_id]
        assert (r.start, r.n_tokens, r.ids_crc32) == (start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))
        start += len(ids)
    order = [r.doc_id for r in sorted(rows, key=lambda r: r.start)]
    assert order == sorted(order, key=lambda d: (d is not None, d))
    assert token_files.encode_to_files(frames.documents(spark), JSON).count() == len(frames.TEXTS)
    assert token_files.encode_to_files(frames.empty(spark), JSON).count() == 0


@pytest.mark.parametrize("block", [1, 7, 64, 1 << 20])
def test_separator_scan(spark, ordinary, block):
    rows = separator_scan.token_counts(frames.documents(spark), JSON, 50256, block_ids=block).collect() if block > 1 else []
    if block == 1:
        small = spark.createDataFrame([(1, "a b"), (2, None), (3, "c"), (4, "")], "doc_id long, text string").coalesce(1)
        assert sorted(map(tuple, separator_scan.token_counts(small, JSON, 50256, block_ids=1).collect())) == [(1, 2), (2, 0), (3, 1), (4, 0)]
        return
    assert Counter((r.doc_id, r.n_tokens) for r in rows) == Counter((d, len(ordinary(frames.text_of(t)))) for d, t in frames.TEXTS)
    assert separator_scan.token_counts(frames.empty(spark), JSON, 50256).count() == 0


def test_files_of_two_attempts_differ(tmp_path):
    a, s = files.open_new(f"file://{tmp_path}", "x")
    b, t = files.open_new(f"file://{tmp_path}", "x")
    s.close(), t.close()
    assert a != b

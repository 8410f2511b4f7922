import numpy as np
import pyarrow as pa
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from lumencov.llm import encoder
from lumencov.llm.encoder import TextEncoder, in_blocks

JSON = public_tokenizers.path("byte_bpe_50k.json")
WORDS = ["alpha", "Beta,", "don't", "'s", "x)", "),", "12", "a1,", "élan", "ça!", "ª", "²", ",", ".", "a\nb", "end.\nThe", "\n", "a\n\nb", "c\n\n\nd", "q\n", "\nq", "Ġ", "ł.", "thndntou", "--", "漢,", "<|endoftext|>", ""]
TEXTS = st.lists(st.sampled_from(WORDS), max_size=12).map(" ".join)


@pytest.fixture(scope="module")
def plain():
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(JSON)
    return lambda text: t.encode(text, add_special_tokens=False).ids


@pytest.fixture(scope="module")
def codes():
    return TextEncoder(JSON), TextEncoder(JSON, cache_columns=3)


@settings(max_examples=400, deadline=None)
@given(st.lists(TEXTS, max_size=6), st.sampled_from([1, 9, 40, 1 << 24]))
def test_blocks_are_the_library(plain, codes, texts, most):
    own, encoder.BLOCK_CHARS = encoder.BLOCK_CHARS, most
    try:
        for code in codes:
            assert [np.frombuffer(b, "<u4").tolist() for b in code.encode_blocks(texts)] == [plain(t) for t in texts]
    finally:
        encoder.BLOCK_CHARS = own


def test_a_word_is_seen_once_in_a_block(plain):
    """Whatever the cache holds: 500 texts of the same new words, also with marks, cost the library each word once."""
    code, seen = TextEncoder(JSON, cache_chunks=2, cache_columns=2), []
    words, letters = code._words, "thndntou whershon ereronor"
    code._words = lambda chunks: seen.extend(chunks) or words(chunks)
    texts = [f"Head {letters}, {letters}. {letters}"] * 500
    assert [np.frombuffer(b, "<u4").tolist() for b in code.encode_blocks(texts)] == [plain(texts[0])] * 500
    assert sorted(seen) == sorted(letters.split())


def test_in_blocks_keeps_rows_and_order():
    batches = [pa.RecordBatch.from_pydict({"n": list(range(k, k + 10)), "t": ["x" * 50] * 10}) for k in range(0, 100, 10)]
    for most in (1, 1500, 1 << 20):
        out = list(in_blocks(iter(batches), most))
        assert [n for b in out for n in b.column(0).to_pylist()] == list(range(100))
        assert all(b.nbytes <= max(most, batches[0].nbytes) for b in out)
    assert len(out) == 1 and list(in_blocks(iter([]))) == []

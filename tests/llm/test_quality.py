import math
import re
from collections import Counter

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from lumencov.llm import quality

from . import frames


def _counts(text):
    """As the contract says it."""
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    seen, copies = set(), 0
    for line in text.split("\n"):
        if re.search(r"[^\x20\x09-\x0D]", line):
            copies += line in seen
            seen.add(line)
    triples = [tuple(words[i : i + 3]) for i in range(len(words) - 2)]
    covered = {i + k for i, t in enumerate(triples) if triples.count(t) > 1 for k in range(3)}
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), copies, len(covered)


@settings(max_examples=400, deadline=None)
@given(st.lists(st.sampled_from(["a", "b", "c", "é", " ", " ", "\n", "\t", "\x0b", "#", "|", "<>", " ", "😀", "\x1c", "\r"]), max_size=40).map("".join))
def test_counts(text):
    assert quality.rule_counts(text.encode()) == _counts(text)


def test_grams():
    data = b"abcde"
    got = quality.grams(data)
    assert len(got) == 3 + 2 and (got >= 0).all() and (got < quality.BUCKETS).all() and len(quality.grams(b"ab")) == 0
    assert quality.grams(b"xabc")[1] == quality.grams(b"abc")[0]


def test_a_text_over_a_mebibyte_by_a_plain_loop():
    """Every n-gram once, also at the edges of the parts it is read in; counts as the contract says."""
    r = np.random.default_rng(1)
    text = " ".join("".join(r.choice(list("abcdeé#"), 5)) for _ in range(190_000)) + "\n" + "same line\n" * 3
    raw = text.encode()
    assert len(raw) > 1 << 20
    whole = np.bincount(quality.grams(raw), minlength=quality.BUCKETS)
    assert (sum(np.bincount(p, minlength=quality.BUCKETS) for p in quality.gram_parts(raw)) == whole).all()
    plain = np.zeros(quality.BUCKETS, np.int64)
    for n in quality.ORDERS:
        for i in range(len(raw) - n + 1):
            code = (int.from_bytes(raw[i : i + n], "big") + n) * 2654435761 % 2**32
            plain[code >> 18] += 1
    assert (plain == whole).all() and whole.sum() == 2 * len(raw) - 5
    ratio = r.normal(size=quality.BUCKETS)
    assert quality.QualityModel(ratio, 0.0).score(raw) == pytest.approx(float((ratio * whole).sum() / whole.sum()), abs=1e-7)
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    triples = Counter(zip(words, words[1:], words[2:]))
    covered = {i + k for i, t in enumerate(zip(words, words[1:], words[2:])) if triples[t] > 1 for k in range(3)}
    assert quality.rule_counts(raw) == (len(words), sum(map(len, words)), text.count("#"), 2, len(covered))


def test_columns_named_like_helpers_and_equal_ids(spark):
    rows = [(d, t, q) for d, t, q in _rows()]
    frame = spark.createDataFrame([(d % 7 if d >= 300 else d, t, "x", "y") for d, t, _ in rows], "doc_id long, text string, __verdict string, kept string").withColumn("row", F.lit(1)).withColumn("score", F.lit("s"))
    labels = spark.createDataFrame([(d, q, 0) for d, _, q in rows if q is not None], "doc_id long, quality int, toxic int")
    kept = quality.keep_good(frame, labels)
    assert kept.columns == frame.columns and {r["kept"] for r in kept.collect()} == {"y"} and {r["score"] for r in kept.collect()} == {"s"}
    assert quality.keep_good(frame.limit(0), labels).count() == 0


def test_threshold():
    assert quality.threshold_from([(10, 0, 50), (20, 100, 0)]) == quality.SCORE_LEAST + 11 * quality.SCORE_STEP
    assert quality.threshold_from([(10, 5, 0)]) == -math.inf and quality.threshold_from([]) == -math.inf


def _brute(rows, labels):
    """Ratio of every bucket and scores, document by document."""
    good = {d for d, q in labels if q == 1}
    raw, trusted = [0] * quality.BUCKETS, [0] * quality.BUCKETS
    for d, t in rows:
        for g in quality.grams((t or "").encode()):
            raw[g] += 1
            trusted[g] += d in good
    ratio = [round(math.log((t + 0.5) / (sum(trusted) + 0.5 * quality.BUCKETS)) - math.log((r + 0.5) / (sum(raw) + 0.5 * quality.BUCKETS)), 9) for r, t in zip(raw, trusted)]
    scores = {}
    for d, t in rows:
        own = quality.grams((t or "").encode())
        scores[d] = sum(ratio[g] for g in own) / len(own) if len(own) else 0.0
    return scores


def _rows():
    base = " ".join(f"word{k} and" for k in range(90))  # no word triple comes twice
    good = [(k, f"{base} {k} some plain words here", 1) for k in range(40)]
    bad = [(100 + k, " ".join(f"w{j + k}$$$ x{j}%%%" for j in range(60)), 0) for k in range(20)]
    return good + bad + [(300 + k, f"{base} unlabelled {k}", None) for k in range(10)] + [(400, "short text", None), (401, "again and again " * 40, None), (402, None, None)]


def test_report_by_brute_force(spark):
    rows = _rows()
    docs = spark.createDataFrame([(d, t) for d, t, _ in rows], "doc_id long, text string").repartition(5)
    marks = [(d, q, 0) for d, _, q in rows if q is not None] + [(None, 1, 0), (7, None, 0), (99999, 0, 0)]
    labels = spark.createDataFrame(marks, "doc_id long, quality int, toxic int")
    scores = _brute([(d, t) for d, t, _ in rows], [(d, q) for d, q, _ in marks if d is not None and d != 99999])
    got = {r.doc_id: r for r in quality.quality_report(docs, labels).collect()}
    for d, t, q in rows:
        r = got[d]
        n, chars, symbols, copies, repeated = _counts(t or "")
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == (n, chars, symbols, copies, repeated)
        assert r.base_failed == (n < 50 or 100 * repeated > 50 * n)
        assert r.score == pytest.approx(scores[d], abs=1e-6)
        assert not (r.kept and r.base_failed)
    assert all(got[d].kept for d, _, q in rows if q == 1 or (q is None and d < 400)) and not any(got[d].kept for d, _, q in rows if q == 0)
    kept = quality.keep_good(docs, labels)
    assert kept.columns == ["doc_id", "text"] and {r.doc_id for r in kept.collect()} == {d for d, r in got.items() if r.kept}


def test_awkward_documents_and_no_labels(spark):
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    rows = quality.quality_report(frames.documents(spark), none).collect()
    assert len(rows) == len(frames.TEXTS)
    for r in rows:
        text = next(t or "" for d, t in frames.TEXTS if d == r.doc_id)
        if r.doc_id == 4:  # every word but the last two stands in a triple of equal words
            assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == (30_002, 120_006, 0, 0, 30_000)
        else:
            assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == _counts(text)
    assert quality.quality_report(frames.empty(spark), none).count() == 0
    some = spark.createDataFrame([(0, 1, 0), (0, 1, 0), (4, 0, 0)], "doc_id long, quality int, toxic int")
    assert quality.keep_good(frames.documents(spark), some).columns == frames.documents(spark).columns

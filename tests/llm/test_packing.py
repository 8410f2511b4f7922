import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from lumencov.llm import packing
from lumencov.llm.encoder import encoder

from . import frames

JSON = public_tokenizers.path("byte_bpe_50k.json")


@settings(deadline=None)
@given(st.integers(0, 2**48 - 1), st.integers(0, 2**46 - 1), st.integers(1, 2**46 - 1))
def test_mul_div_is_exact(x, a, b):
    a = min(a, b)
    q, r = packing.mul_div(np.array([x]), np.array([a]), np.array([b]))
    assert (int(q[0]), int(r[0])) == divmod(x * a, b)


@settings(deadline=None)
@given(st.lists(st.integers(0, 60), min_size=1, max_size=9))
def test_tree_serves_every_id_once_and_evenly(totals):
    tree, n = packing.Tree(totals), sum(totals)
    queues = np.arange(len(totals))
    last = np.zeros(len(totals), np.int64)
    for x in range(n + 1):
        own, before = tree.served(queues, np.full(len(totals), x))
        assert own.sum() == x and (before == np.cumsum(own) - own).all() and (own >= last).all()
        assert (np.abs(own - x * np.array(totals) / max(n, 1)) <= len(tree.levels)).all()  # the deficit is bounded
        if x:
            (q,) = np.flatnonzero(own - last)
            assert tree.place(np.array([q]), np.array([last[q]])).tolist() == [x - 1]
        last = own
    assert last.tolist() == totals


def test_large_totals():
    totals = [2**44 + 12345, 3, 2**43 + 7, 0, 1]
    tree = packing.Tree(totals)
    for q in (0, 1, 2, 4):
        k = np.array([0, totals[q] // 3, totals[q] - 1])
        x = tree.place(np.full(3, q), k)
        assert tree.served(np.full(3, q), x)[0].tolist() == k.tolist() and tree.served(np.full(3, q), x + 1)[0].tolist() == (k + 1).tolist()


def _check(docs, pieces, window, end_id=1):
    """Every id in one piece, windows full and without gaps; returns ids of each window by document."""
    code = encoder(JSON)
    ids = {d: [*np.frombuffer(code.encode([t or ""])[0], "<u4").tolist(), end_id] for d, t in docs}
    windows, covered = defaultdict(list), Counter()
    for p in pieces:
        own = ids[p.doc_id][p.start : p.start + p.length]
        assert p.length == len(own) > 0 and p.doc_tokens == len(ids[p.doc_id]) and p.ids_crc32 == zlib.crc32(np.array(own, "<u4").tobytes())
        for k in range(p.start, p.start + p.length):
            covered[p.doc_id, k] += 1
        windows[p.sequence_id].append((p.offset, p.length, p.doc_id))
    assert covered == sum((Counter((d, k) for k in range(len(ids[d]))) for d, _ in docs), Counter())
    total = sum(len(ids[d]) for d, _ in docs)
    for s, parts in windows.items():
        at = 0
        for offset, length, _ in sorted(parts):
            assert offset == at
            at += length
        assert at == (window if s < total // window else total % window)
    assert sorted(windows) == list(range(-(-total // window)))
    return windows, ids


@pytest.mark.parametrize("window", [16, 64, 2048])
@pytest.mark.parametrize("targets", [None, {"src0": 3.0, "src1": 1.0}])
def test_packing_of_awkward_documents(spark, window, targets):
    pieces = packing.pack_documents(frames.documents(spark), JSON, 1, window=window, targets=targets).collect()
    _check(frames.TEXTS, pieces, window)


def _corpus(spark, n=400):
    rows = [(k, f"text {k} " + "word " * (k % 37), "hot" if k % 3 == 0 else f"s{k % 7}") for k in range(n)]
    return rows, spark.createDataFrame(rows, "doc_id long, text string, source string").repartition(11)


def test_every_window_holds_the_mixture(spark):
    rows, frame = _corpus(spark)
    windows, ids = _check([r[:2] for r in rows], packing.pack_documents(frame, JSON, 1, window=256).collect(), 256)
    source = {k: s for k, _, s in rows}
    total = Counter()
    for d, own in ids.items():
        total[source[d]] += len(own)
    for s, parts in windows.items():
        if s == max(windows):
            continue
        have = Counter()
        for _, length, d in parts:
            have[source[d]] += length
        for q, n in total.items():
            assert abs(have[q] - 256 * n / sum(total.values())) <= 5


def test_targets_hold_while_the_queues_last(spark):
    rows, frame = _corpus(spark)
    windows, _ = _check([r[:2] for r in rows], packing.pack_documents(frame, JSON, 1, window=256, targets={"hot": 0.5, "s1": 0.25, "s2": 0.25}).collect(), 256)
    source = {k: s for k, _, s in rows}
    have = Counter()
    for _, length, d in windows[0]:
        have[source[d]] += length
    assert abs(have["hot"] - 128) <= 3 and abs(have["s1"] - 64) <= 3 and abs(have["s2"] - 64) <= 3


def test_many_sources_share_queues(spark):
    rows, frame = _corpus(spark, 120)
    _check([r[:2] for r in rows], packing.pack_documents(frame, JSON, 1, window=64, most_queues=3).collect(), 64)


def _pieces(frame, **more):
    return sorted(tuple((v is not None, v) for v in r) for r in packing.pack_documents(frame, JSON, 1, window=256, **more).collect())


@pytest.mark.parametrize("targets", [None, {"hot": 0.5, "s1": 0.25, "s2": 0.25}])
def test_pieces_do_not_depend_on_most_queues(spark, targets):
    """Nine sources, a null among them, over 3 and then 5 queues: the tree is a table of several rounds, and its pieces the same."""
    rows, _ = _corpus(spark)
    frame = spark.createDataFrame([(k, t, None if k % 29 == 0 else s) for k, t, s in rows], "doc_id long, text string, source string").repartition(11)
    want = _pieces(frame, targets=targets)
    assert _pieces(frame, targets=targets, most_queues=3) == want == _pieces(frame, targets=targets, most_queues=5)


def test_mixture_holds_above_most_queues(spark):
    rows, frame = _corpus(spark)
    windows, ids = _check([r[:2] for r in rows], packing.pack_documents(frame, JSON, 1, window=256, most_queues=3).collect(), 256)
    source, total = {k: s for k, _, s in rows}, Counter()
    for d, own in ids.items():
        total[source[d]] += len(own)
    for s, parts in windows.items():
        have = Counter()
        for _, length, d in parts:
            have[source[d]] += length
        assert s == max(windows) or all(abs(have[q] - 256 * n / sum(total.values())) <= 5 for q, n in total.items())


def test_targets_hold_above_most_queues(spark):
    rows, frame = _corpus(spark)
    windows, _ = _check([r[:2] for r in rows], packing.pack_documents(frame, JSON, 1, window=256, most_queues=3, targets={"hot": 0.5, "s1": 0.25, "s2": 0.25}).collect(), 256)
    source, have = {k: s for k, _, s in rows}, Counter()
    for _, length, d in windows[0]:
        have[source[d]] += length
    assert abs(have["hot"] - 128) <= 3 and abs(have["s1"] - 64) <= 3 and abs(have["s2"] - 64) <= 3


def test_targets_hold_with_5000_sources(spark):
    """More sources than the driver holds by default: targets 2:1:1 are served exactly, the others after them."""
    rows = [(k, f"text {k} " + "word " * 40, f"t{k % 3}" if k < 300 else f"s{k}") for k in range(5300)]
    frame = spark.createDataFrame(rows, "doc_id long, text string, source string").repartition(8)
    pieces = packing.pack_documents(frame, JSON, 1, window=1024, targets={"t0": 2, "t1": 1, "t2": 1}).collect()
    source = {k: s for k, _, s in rows}
    filled, served, by_window = Counter(), Counter(), defaultdict(Counter)
    for p in pieces:
        filled[p.sequence_id] += p.length
        served[p.doc_id] += p.length
        by_window[p.sequence_id][source[p.doc_id]] += p.length
    assert all(served[p.doc_id] == p.doc_tokens for p in pieces) and len(served) == len(rows)
    assert all(n == 1024 for w, n in filled.items() if w < max(filled))
    for w in range(4):
        have = by_window[w]
        assert abs(have["t0"] - 512) <= 3 and abs(have["t1"] - 256) <= 3 and abs(have["t2"] - 256) <= 3


def test_ids_are_kept_on_request_and_no_rows(spark):
    p = packing.pack_documents(frames.documents(spark), JSON, 1, keep_ids=True).first()
    assert len(p.ids) == p.length
    assert packing.pack_documents(frames.empty(spark), JSON, 1).count() == 0

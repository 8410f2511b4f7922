import hashlib
import random
from collections import Counter, defaultdict

import numpy as np
import pytest
import xxhash

from lumencov.llm import exact_dedup, simhash

from . import frames


def _groups(rows):
    """(doc_id, text) rows as exact_groups has them."""
    by = defaultdict(list)
    for d, t in rows:
        by[t or ""].append(d)
    out = []
    for d, t in rows:
        ids = by[t or ""]
        keep = max((i for i in ids if i is not None), default=None)
        out.append((d, keep, len(ids), d == keep, hashlib.sha256((t or "").encode()).hexdigest()))
    return Counter(out)


def test_exact_groups(spark):
    assert Counter(map(tuple, exact_dedup.exact_groups(frames.documents(spark)).collect())) == _groups(frames.TEXTS)
    assert exact_dedup.exact_groups(frames.empty(spark)).count() == 0


def test_exact_groups_with_a_hot_text(spark):
    rows = [(k, "hot" if k % 3 == 0 else f"cold {k % 400}") for k in range(3000)]
    frame = spark.createDataFrame(rows, "doc_id long, text string").repartition(9)
    assert Counter(map(tuple, exact_dedup.exact_groups(frame).collect())) == _groups(rows)
    kept = exact_dedup.drop_exact_duplicates(frame)
    assert kept.columns == ["doc_id", "text"] and kept.count() == len({t for _, t in rows})


def test_exact_plan_is_native(spark):
    plan = exact_dedup.exact_groups(frames.documents(spark))._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan


def _fingerprint(text):
    """As the contract says it, bit by bit."""
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text)
    words, word = [], ""
    for c in low:
        if c == " " or "\x09" <= c <= "\x0d":
            words, word = words + [word] * bool(word), ""
        else:
            word += c
    words += [word] * bool(word)
    if not words:
        return 0
    shingles = [" ".join(words[i : i + 4]) for i in range(max(1, len(words) - 3))]
    hashes = [xxhash.xxh64(s.encode(), seed=42).intdigest() for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


@pytest.mark.parametrize("text", [t or "" for _, t in frames.TEXTS if t != frames.LONG] + ["one", "one two three four", "one two three four five\x0bsix\x0cseven", "É É É É É", "a b c d"])
def test_fingerprint(text):
    assert simhash.fingerprint(text) == _fingerprint(text)


def _components(fps, radius=4):
    """Least index reachable, by comparing all pairs."""
    root = list(range(len(fps)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(fps)):
        for j in range(i):
            if (fps[i] ^ fps[j]).bit_count() <= radius:
                a, b = sorted((find(i), find(j)))
                root[b] = a
    return [find(i) for i in range(len(fps))]


def _check(spark, fps, count=None):
    frame = spark.createDataFrame([(f - (1 << 64) if f >> 63 else f,) for f in sorted(set(fps))], "fp long").repartition(5)
    from lumencov.plans.staging import shared_dir

    links = simhash.find_links(frame, count or len(set(fps)))
    roots = {r.u: r.root for r in simhash.connected(links, shared_dir(spark)).collect()}
    distinct = sorted(set(fps))
    want = _components(distinct)
    got = [roots.get(s := (f - (1 << 64) if f >> 63 else f), s) for f in distinct]
    assert [[i for i, x in enumerate(want) if x == w] for w in sorted(set(want))] == sorted([i for i, x in enumerate(got) if x == g] for g in set(got))


@pytest.mark.parametrize("count", [None, 10_000_000, 10**10])
def test_links_are_complete(spark, count):
    """Chains at the radius, pairs just beyond it, and noise; for the tables of small and of large corpora."""
    r, fps = random.Random(count), []
    for _ in range(60):
        f = r.getrandbits(64)
        fps.append(f)
        for step in (4, 4, 5, 3, 1):
            for bit in r.sample(range(64), step):
                f ^= 1 << bit
            fps.append(f)
    fps += [r.getrandbits(64) for _ in range(100)] + [0, (1 << 64) - 1]
    _check(spark, fps, count)


def test_a_hot_key_is_dealt_out_in_chunks(spark):
    """Over 1200 near copies of one fingerprint share a key of every table."""
    r, center = random.Random(1), 0xDEADBEEFCAFEF00D
    fps = {center ^ (1 << a) ^ (1 << b) for a in range(50) for b in range(a)}
    fps |= {center ^ (r.getrandbits(20) << 44) for _ in range(60)}
    _check(spark, list(fps))


def test_tables_cover_every_choice_of_bits():
    for count in (100, 10**6, 10**9, 10**11):
        masks = simhash.tables_for(count)
        for bits in ([0, 13, 26, 39], [63, 62, 61, 60], [5, 20, 36, 50], [12, 13, 25, 26]):
            changed = sum(1 << b for b in bits)
            assert any(not m & changed for m in masks)


def test_lanes_by_brute_force():
    r = np.random.default_rng(0)
    fps = r.integers(0, 2**64, 150, dtype=np.uint64)
    for k in range(0, 140, 2):
        fps[k + 1] = fps[k] ^ np.uint64(sum(1 << int(b) for b in r.choice(64, k % 8, replace=False)))
    base, fill = np.array([0, 64, 128]), np.array([64, 64, 22])
    q = np.repeat(fps, 3)
    w = np.tile(np.arange(3), len(fps))
    masks = simhash.close_lanes(fps, q, w, base, fill)
    for x, k, m in zip(q.tolist(), w.tolist(), masks.tolist()):
        assert m == sum(1 << i for i in range(int(fill[k])) if (x ^ int(fps[base[k] + i])).bit_count() <= 4)


def test_near_duplicates(spark):
    rows = simhash.near_duplicates(frames.documents(spark)).collect()
    fps = [_fingerprint(t or "") if t != frames.LONG else simhash.fingerprint(t) for _, t in frames.TEXTS]
    roots = _components(fps)
    ids = [d for d, _ in frames.TEXTS]
    least = {c: min((ids[i] for i in range(len(ids)) if roots[i] == c and ids[i] is not None), default=None) for c in set(roots)}
    assert Counter(map(tuple, rows)) == Counter((d, f"{f:016x}", least[c]) for d, f, c in zip(ids, fps, roots))
    assert simhash.near_duplicates(frames.empty(spark)).count() == 0
    kept = simhash.drop_near_duplicates(frames.documents(spark))
    assert kept.columns == frames.documents(spark).columns


def test_filters_decide_row_by_row(spark):
    """Equal ids with different texts, columns named like helpers: each row stays or goes by its own text."""
    text = "one two three four five six seven eight nine ten"
    rows = [(1, "a", 0), (1, text, 1), (2, text, 2), (3, text + " eleven", 3), (1, "b c d", 4), (None, text, 5), (None, "zz", 6)]
    names = ["doc_id", "text", "__kept_id"]
    frame = spark.createDataFrame(rows, "doc_id long, text string, __kept_id long")
    for name in ("row", "salt", "digest", "hash", "id", "first", "fp", "text_hash", "__verdict"):
        frame = frame.withColumn(name, frame["__kept_id"])
        names.append(name)
    kept = exact_dedup.drop_exact_duplicates(frame)
    assert kept.columns == names and sorted(r["__kept_id"] for r in kept.collect()) == [0, 2, 3, 4, 6]
    kept = simhash.drop_near_duplicates(frame)
    assert kept.columns == names
    fps = [simhash.fingerprint(t) for _, t, _ in rows]
    roots, want = _components(fps), []
    for c in set(roots):
        own = [i for i in range(len(rows)) if roots[i] == c]
        least = min((rows[i][0] is None, rows[i][0] or 0) for i in own)
        same = [i for i in own if (rows[i][0] is None, rows[i][0] or 0) == least]
        want.append(same)
    got = {r["__kept_id"] for r in kept.collect()}
    assert len(got) == len(want) and all(len(got & set(same)) == 1 for same in want)


def test_hot_groups_are_dealt_over_salts(spark):
    """A group of 100,000 rows meets in as many places as there are salts, evenly."""
    from pyspark.sql import functions as F

    from lumencov.llm import common

    rows = spark.range(100_000).select(F.lit(7).cast("long").alias("k"), F.col("id").alias("x"))
    plan = common.with_group(rows, ["k"], "x", F.min("x"), F.min, "m")
    assert plan.agg(F.min("m"), F.max("m"), F.count(F.lit(1))).first()[:] == (0, 0, 100_000)
    salted = rows.groupBy("k", F.pmod(F.xxhash64("x"), F.lit(common.salts(spark))).alias("salt")).count().collect()
    assert len(salted) == common.salts(spark) and max(r["count"] for r in salted) < 1.2 * 100_000 / len(salted)
    assert not any(line.strip().startswith("Window [min(x") for line in plan._jdf.queryExecution().toString().splitlines())


def test_a_text_of_100000_copies(spark):
    from pyspark.sql import functions as F

    frame = spark.range(100_000).select(F.col("id").alias("doc_id"), F.lit("the same text over and over").alias("text")).repartition(6)
    first = simhash.near_duplicates(frame).groupBy("component_id", "fingerprint").count().collect()
    assert [(r.component_id, r["count"]) for r in first] == [(0, 100_000)]

"""The pipeline against plain Python on a small corpus."""

from collections import Counter

import corpus_pipeline
from lumencov.llm import pii, quality, secrets_scan, simhash  # noqa: F401

from .test_dedup import _components, _fingerprint
from .test_packing import _check
from .test_quality import _rows


def _tables(spark, path):
    rows = [(d, t, "en", f"src{(d or 0) % 4}", len(t or ""), q) for d, t, q in _rows()]
    base = rows[0][1]
    rows += [(500, base, "en", "src1", len(base), None), (501, base + " tail", "en", "src0", 0, None), (502, "Different " + " ".join(f"tok{k} is" for k in range(120)) + " token = 'abcdef123456' end", None, None, None, None), (503, None, None, None, None, None)]
    spark.createDataFrame([r[:5] for r in rows], "doc_id long, text string, lang string, source string, n_chars long").repartition(4).write.parquet(f"{path}/documents.parquet")
    marks = [(r[0], r[5], 0) for r in rows if r[5] is not None]
    spark.createDataFrame(marks, "doc_id long, quality int, toxic int").write.parquet(f"{path}/labels.parquet")


def test_stages_by_brute_force(spark, tmp_path):
    path = str(tmp_path)
    _tables(spark, path)
    docs = spark.read.parquet(f"{path}/documents.parquet")
    columns, before = docs.columns, [(r.doc_id, r.text) for r in docs.collect()]
    kept = {r.doc_id for r in quality.quality_report(docs, spark.read.parquet(f"{path}/labels.parquet")).where("kept").collect()}
    want = [r for r in before if r[0] in kept]
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES[:4]):
        docs = stage(spark, docs, path)
        assert docs.columns == columns, name
        docs.write.parquet(f"{path}/out{k}")
        docs = spark.read.parquet(f"{path}/out{k}")
        if k == 1:
            last = {}
            for d, t in sorted(want):
                last[t] = d
            want = [(d, t) for t, d in last.items()]
        elif k == 2:
            want.sort()
            roots = _components([_fingerprint(t) for _, t in want])
            want = [row for i, row in enumerate(want) if roots[i] == i]
        elif k == 3:
            model = secrets_scan.default_model()
            want = [(d, secrets_scan.redact_text(t, secrets_scan.find_all([t], model)[0][1])) for d, t in want]
        got = [(r.doc_id, r.text) for r in docs.collect()]
        assert Counter(got) == Counter(want), name
        assert len(got) > 0
    assert "abcdef123456" not in dict(want)[502] and all(r.n_chars == len(r.text) for r in docs.collect())
    pieces = corpus_pipeline.STAGES[4][1](spark, docs, path).collect()
    _check(want, pieces, 2048)
    whole = corpus_pipeline.run(spark, path).collect()
    assert Counter((p.doc_id, p.start, p.length, p.ids_crc32) for p in whole) == Counter((p.doc_id, p.start, p.length, p.ids_crc32) for p in pieces)


def test_stages_are_the_operators_in_order():
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality rules", "exact dedup", "SimHash near-dedup", "secret scans", "packing"]
    assert simhash.RADIUS == 4 and simhash.SHINGLE == 4


def test_stages_keep_columns_named_like_helpers_and_empty_tables(spark, tmp_path):
    path = str(tmp_path)
    _tables(spark, path)
    docs = spark.read.parquet(f"{path}/documents.parquet")
    for name in ("__kept_id", "__verdict", "row", "kept", "digest", "salt", "fp"):
        docs = docs.withColumn(name, docs["doc_id"])
    docs = docs.unionByName(docs.where("doc_id = 3"))  # a repeated row
    some, none = docs, docs.limit(0)
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES[:4]):
        some, none = stage(spark, some, path), stage(spark, none, path)
        assert some.columns == docs.columns and none.columns == docs.columns, name
        some.write.parquet(f"{path}/some{k}")
        some = spark.read.parquet(f"{path}/some{k}")
        assert all(r["__kept_id"] == r.doc_id for r in some.collect()) and none.count() == 0
        none = docs.limit(0)
    assert corpus_pipeline.STAGES[4][1](spark, some, path).count() > 0 and corpus_pipeline.STAGES[4][1](spark, none, path).count() == 0
    whole = tmp_path / "empty"
    docs.limit(0).write.parquet(f"{whole}/documents.parquet")
    spark.read.parquet(f"{path}/labels.parquet").limit(0).write.parquet(f"{whole}/labels.parquet")
    assert corpus_pipeline.run(spark, str(whole)).count() == 0

import json

import pytest
from pyspark.sql import functions as F

from lumencov.functions import formats
from lumencov.operators import files, labels, lines, lists, sessions, totals
from lumencov.plans.store import CoverageStore
from lumencov.sources import report_reader, report_writer
from lumencov.sources.formats import CHUNK_END, HEADER_END

from . import sample_store


@pytest.fixture(scope="module")
def store(spark):
    return sample_store.build(spark)


def test_totals(store):
    assert totals.totals(store).first().asDict() == dict(
        file_count=2, upload_count=2, test_case_count=2, hit_lines=3, total_lines=4, hit_branches=4, total_branches=6, total_branch_roots=2, hit_methods=2, total_methods=3, hit_complexity_paths=4, total_complexity=8
    )


def test_totals_of_an_empty_store(spark):
    assert set(totals.totals(CoverageStore.empty(spark)).first()) == {0}


def test_report_json(store):
    made = json.loads(report_writer.report_json(store).first()[0])
    assert made["files"] == {"lib/b.rs": [0, [0, 5, 2, 2, 1, "40.00000", 1, 2, 0, 0, 2, 4, 0], None, None], "lib/a.rs": [1, [0, 4, 4, 0, 0, "100", 1, 1, 0, 0, 2, 4, 0], None, None]}
    assert made["sessions"]["0"]["t"] == [2, 7, 6, 0, 1, "85.71429", 2, 2, 0, 0, 2, 4, 0]
    assert made["sessions"]["1"] == {"t": [1, 2, 0, 2, 0, "0", 0, 1, 0, 0, 2, 4, 0], "d": 456, "a": "url two", "f": ["flag two"], "c": "provider two", "n": "build two", "N": "name two", "j": "job two", "u": "run two", "p": "state two", "e": "env two", "st": "type two", "se": {"k": "two"}}


def test_empty_report(spark):
    empty = CoverageStore.empty(spark)
    assert json.loads(report_writer.report_json(empty).first()[0]) == {"files": {}, "sessions": {}}
    assert labels.labels_header(empty).first()[0] == "{}"


def test_chunks(store):
    text = report_writer.chunks_document(store).first()[0]
    header, body = text.split(HEADER_END)
    assert json.loads(header) == {"labels_index": {"1": "case", "2": "case 2"}}
    b, a = (chunk.split("\n") for chunk in body.split(CHUNK_END))
    read = lambda chunk: [json.loads(x) if x else None for x in chunk]
    assert read(b) == [
        {"present_sessions": [0, 1]}, [4, None, [[0, 4]], None, None, [[0, 4, None, ["case", "case 2"]]]], [5, "m", [[0, 5]]], [0, None, [[1, 0]]], None, [0, "m", [[1, 0, None, None, [2, 4]]], None, [2, 4]], ["2/4", "b", [[0, "2/4", ["2", "3"]]]],
    ]
    assert read(a) == [
        {"present_sessions": [0]}, [3, None, [[0, 3]], None, None, [[0, 3, None, ["case", "case 2"]]]], [2, "m", [[0, 2, None, None, [2, 4]]], None, [2, 4], [[0, 2, "m", ["case 2"]]]], ["2/2", "b", [[0, "2/2"]]], None, None, None, None, [3, None, [[0, 3, None, [[3, None, 3]]]]],
    ]


def test_file_without_samples_keeps_its_chunk(spark, store):
    more = spark.createDataFrame([(5, "lib/none.rs")], "id long, path string")
    wider = CoverageStore(**(store.tables() | {"source_file": store.source_file.union(more)}))
    chunks = {r.chunk_index: r.chunk for r in report_writer.chunks_text(wider).collect()}
    assert chunks[1] == "null" and len(chunks) == 3
    assert {r.path for r in files.file_totals(wider).collect()} == {"lib/a.rs", "lib/b.rs"}


def test_upload_without_samples_keeps_its_index(spark, store):
    more = spark.createDataFrame([(7,)], "id long").selectExpr("id", *["CAST(NULL AS STRING) x"]).select("id")
    from lumencov.plans.schema import conform

    wider = CoverageStore(**(store.tables() | {"raw_upload": store.raw_upload.union(conform(more, "raw_upload"))}))
    assert {(r.session_index, r.id) for r in sessions.session_totals(wider).collect()} == {("0", 5), ("2", 10)}


def test_children_do_not_multiply(spark, store):
    """Two labels and two missed branches on one sample: each list holds its entries once."""
    assoc = spark.createDataFrame([(1, 5, 6, None), (2, 5, 6, None)], store.context_assoc.schema)
    wider = CoverageStore(**(store.tables() | {"context_assoc": store.context_assoc.union(assoc)}))
    row = lines.line_sessions(wider).where("line_no = 6").first()
    assert (row.missing_branches, row.labels) == ('["2","3"]', '["case","case 2"]')


def test_two_samples_on_one_line_and_upload(spark, store):
    more = spark.createDataFrame([(5, 99, 7, 1, "l", 50, None, None)], store.coverage_sample.schema)
    wider = CoverageStore(**(store.tables() | {"coverage_sample": store.coverage_sample.union(more)}))
    assert [r.hits for r in lines.line_sessions(wider).where("chunk_index = 1 AND line_no = 1").collect()] == [3]


def test_sessions_of_a_line_are_added(spark, store):
    more = spark.createDataFrame([(10, 98, 3, 6, "b", None, 2, 4)], store.coverage_sample.schema)
    wider = CoverageStore(**(store.tables() | {"coverage_sample": store.coverage_sample.union(more)}))
    line = report_writer.report_lines(wider).where("chunk_index = 0 AND line_no = 6").first().line
    assert json.loads(line) == ["4/8", "b", [[0, "2/4", ["2", "3"]], [1, "2/4"]]]


def test_lookups(store):
    one = store.coverage_sample.where("local_sample_id = 6")
    assert sorted(r.branch for r in lists.branches_for_samples(store, one).collect()) == ["0:jump", "1", "2", "3"]
    assert lists.methods_for_samples(store, one).count() == 0
    assert [r.local_method_id for r in lists.methods_for_samples(store, store.coverage_sample.where("local_sample_id = 11")).collect()] == [12]
    assert [r.start_col for r in lists.spans_for_samples(store, store.coverage_sample.where("local_sample_id = 17")).collect()] == [3]
    assert sorted(r.name for r in lists.contexts_for_samples(store, store.coverage_sample.where("local_sample_id = 0")).collect()) == ["case", "case 2"]
    assert lists.samples_for_files(store, store.source_file.where("path = 'lib/a.rs'")).count() == 4
    assert [r.local_sample_id for r in lists.list_coverage_samples(store).collect()] == [0, 1, 2, 3, 6, 11, 13, 15, 17]


@pytest.mark.parametrize(("hits", "lines_", "said"), [(0, 0, "0"), (0, 9, "0"), (9, 9, "100"), (1, 3, "33.33333"), (100, 256, "39.06250"), (2, 3, "66.66667"), (25, 6400, "0.39062"), (6, 44, "13.63636"), (52, 94, "55.31915")])
def test_percentage(spark, hits, lines_, said):
    assert spark.range(1).select(formats.coverage_pct(F.lit(hits), F.lit(lines_))).first()[0] == said


def test_trimmed_array_and_formats(spark):
    null = F.lit(None).cast("string")
    row = spark.range(1).select(
        formats.trimmed_array([F.lit("1"), null, F.lit("2"), null, F.lit("null")]).alias("a"), formats.trimmed_array([null]).alias("b"), formats.format_complexity(F.lit(None), F.lit(3)).alias("c"), formats.format_complexity(F.lit(2), F.lit(None)).alias("d"),
        formats.format_complexity(F.lit(None), F.lit(None)).alias("e"), formats.quoted(F.lit('a"b\\c\n]')).alias("q"), formats.format_type(F.lit("m")).alias("m"),
    ).first()
    assert (row.a, row.b, row.c, row.d, row.e, row.m) == ("[1,null,2]", "[]", "3", "2", "null", '"m"')
    assert json.loads(row.q) == 'a"b\\c\n]'


def test_neither_hits_nor_branches_is_an_error(spark):
    none = F.lit(None).cast("long")
    with pytest.raises(Exception, match="neither hits nor branches"):
        spark.range(1).select(formats.format_coverage(none, none, none)).collect()


def test_report_written_in_steps_leaves_no_shuffle_files_and_the_same_texts(spark, tmp_path):
    """With a staging folder the documents are the same, also compressed, and the shuffle files of its jobs are gone when it returns."""
    store = sample_store.build(spark)
    report_writer.write_report(store, str(tmp_path / "j"), str(tmp_path / "c"))
    kept = lambda: spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().shuffleManager().shuffleBlockResolver().getStoredShuffles().size()
    before = kept()
    report_writer.write_report(store, str(tmp_path / "j2"), str(tmp_path / "c2"), staging=str(tmp_path / "steps"), compression="gzip")
    assert kept() <= before
    texts = lambda folder, **options: [r.value for r in spark.read.text(str(tmp_path / folder), **options).collect()]
    assert texts("j") == texts("j2")
    assert sorted(texts("c")) == sorted(texts("c2"))
    cut = report_reader.read_chunks(spark, str(tmp_path / "c2"), F.lit("r")).select("chunk_index", F.regexp_replace("chunk", r"\n$", "").alias("chunk"))
    assert sorted(map(tuple, cut.collect())) == sorted(map(tuple, report_writer.chunks_text(store).collect()))  # the header is no chunk
    assert report_reader.parse_report(spark, str(tmp_path / "j2"), str(tmp_path / "c2"), staging=str(tmp_path / "read")).store.coverage_sample.count() == report_reader.parse_report(spark, str(tmp_path / "j"), str(tmp_path / "c")).store.coverage_sample.count()

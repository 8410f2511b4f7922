import json

import pytest
from pyspark.sql import functions as F

from lumencov.functions import parsing
from lumencov.operators import files, sessions, totals
from lumencov.sources import report_reader, report_writer
from lumencov.sources.formats import CHUNK_END, HEADER_END

from . import sample_store


def _values(spark, texts, expression):
    rows = [(i, t) for i, t in enumerate(texts)]
    frame = spark.createDataFrame(rows, "i int, t string").withColumn("v", F.get(parsing.slots(parsing.mark_strings(F.concat(F.lit("["), F.col("t"), F.lit("]")))), 0))
    return [r.x for r in frame.select("i", expression(F.col("v")).alias("x")).orderBy("i").collect()]


def test_coverage_values(spark):
    cases = {
        "1": ("hits", 1, None), "0": ("hits", 0, None), "1e3": ("hits", 1000, None), "3.9": ("hits", 3, None), "-4": ("hits", 0, None), "99999999999": ("hits", 4294967295, None), '"1/2"': ("branches", 1, 2), '"5/4"': ("branches", 5, 4), '"3.7/4e0"': ("branches", 3, 4), "true": ("partial", None, None),
        "false": (None, None, None), '"1"': (None, None, None), '"1/"': (None, None, None), '"a/2"': (None, None, None), "null": (None, None, None), "[1]": (None, None, None),
    }
    assert [tuple(x) for x in _values(spark, list(cases), parsing.coverage)] == list(cases.values())


def test_coverage_types(spark):
    cases = {"null": "l", '"line"': "l", '"b"': "b", '"branch"': "b", '"m"': "m", '"method"': "m", '"x"': None, "1": None}
    assert _values(spark, list(cases), parsing.coverage_type) == list(cases.values())


def test_complexities(spark):
    cases = {"1": (None, 1, True), "[1,2]": (1, 2, True), "null": (None, None, True), "[1]": (None, None, False), '"x"': (None, None, False), '["a",1]': (None, None, False)}
    assert [tuple(x) for x in _values(spark, list(cases), parsing.complexity)] == list(cases.values())


def test_missing_branches(spark):
    cases = {
        '["26","27"]': ("l", ["26", "27"], True), '["0:0","1:1"]': ("bb", ["0:0", "1:1"], True), '["0:jump","1"]': ("c", ["0:jump", "1"], True), "[]": ("c", [], True), "null": (None, None, True), '["1","2"]': ("l", ["1", "2"], True),
        '["0:0","1"]': (None, None, False), '["0:0","0:jump"]': (None, None, False), '["a"]': (None, None, False), "[1]": (None, None, False), '"1"': (None, None, False),
    }
    assert [tuple(x) for x in _values(spark, list(cases), parsing.missing_branches)] == list(cases.values())


def test_partial_spans(spark):
    cases = {"[[1,2,3]]": ([(1, 2, 3)], True), "[[null,10,0],[11,null,1]]": ([(None, 10, 0), (11, None, 1)], True), '[[1,2,"1/2"]]': ([(1, 2, 0)], True), "[[5,2,true]]": ([(5, 2, 0)], True), "[]": ([], True), "null": (None, True), "[[1,2]]": (None, False), "[[1,2,null]]": (None, False), '[["a",2,3]]': (None, False), "7": (None, False)}
    got = [(None if not x.valid or x.spans is None else [(s.start_col, s.end_col, s.hits) for s in x.spans], x.valid) for x in _values(spark, list(cases), parsing.partial_spans)]
    assert got == list(cases.values())


def test_normalization(spark):
    cases = [("partial", None, None, "l", ("l", None, 1, 2, True)), ("partial", None, None, "m", ("m", None, 1, 2, True)), ("branches", 3, 4, "m", ("m", 3, None, None, True)), ("branches", 3, 4, "l", ("b", None, 3, 4, True)), ("branches", 3, 4, "b", ("b", None, 3, 4, True)), ("hits", 1, None, "b", ("b", None, 1, 2, True)), ("hits", 2, None, "b", ("b", None, 2, 2, True)), ("hits", 3, None, "b", ("b", None, 3, 2, False)), ("hits", 9, None, "l", ("l", 9, None, None, True)), ("hits", 9, None, "m", ("m", 9, None, None, True))]
    frame = spark.createDataFrame([c[:4] for c in cases], "kind string, a long, b long, t string")
    got = [tuple(r.n) for r in frame.select(parsing.normalized(F.struct("kind", "a", "b"), F.col("t")).alias("n")).collect()]
    assert got == [c[4] for c in cases]


def _lines(spark, *lines):
    rows = [("r", 0, k + 1, line) for k, line in enumerate(lines)]
    return report_reader.parse_line_sessions(spark.createDataFrame(rows, "report string, chunk_index long, line_no long, raw string"))


def test_line_sessions(spark):
    got = {
        (r.line_no, r.session_index): (r.coverage_type, r.hits, r.hit_branches, r.total_branches, r.hit_complexity_paths, r.total_complexity)
        for r in _lines(spark, "[1,null,[[0,1]]]", '["2/4","b",[[0,"1/4",["1","2"]],[3,"1/4"]]]', '["1/2",null,[[1,"1/2"]],null,null,[[1,"1/2",null,["x",5]]]]', '[3,"m",[[0,3,null,null,[2,4]]],null,[2,4]]', "[true,null,[[0,true]]]", '[2,"b",[[0,2]]]').collect()
    }
    assert got == {
        (1, 0): ("l", 1, None, None, None, None), (2, 0): ("b", None, 1, 4, None, None), (2, 3): ("b", None, 1, 4, None, None), (3, 1): ("b", None, 1, 2, None, None), (4, 0): ("m", 3, None, None, 2, 4), (5, 0): ("l", None, 1, 2, None, None), (6, 0): ("b", None, 2, 2, None, None),
    }


@pytest.mark.parametrize("line", ["[1,null", "[1,]", "nonsense", "[1] x", "{}", "[1,null]", '[1,"z",[[0,1]]]', '["1",null,[[0,1]]]', '[1,null,[["a",1]]]', "[1,null,[[0]]]", '[1,null,[[0,1,[[10,15,1]]]]]', '[5,"b",[[0,5]]]', "[1,null,[[0,1]],null,[1]]", "[1,null,[[0,1,null,null,null,7]]]"])
def test_malformed_lines_are_kept_apart(spark, line):
    rows = _lines(spark, line, "[1,null,[[0,1]]]").collect()
    assert [bool(r.error) for r in sorted(rows, key=lambda r: r.line_no)] == [True, False]


def test_labels(spark):
    samples = _lines(spark, '[1,null,[[0,1],[1,1]],null,null,[[0,1,null,["old"]],[0,1,null,["1","name",7]],[1,1,null,["2"]]]]')
    index = spark.createDataFrame([("r", "1", "first"), ("r", "2", "second")], "report string, label string, name string")
    got = sorted((r.session_index, r.label) for r in report_reader.exploded_labels(samples, index).collect())
    assert got == [(0, "7"), (0, "first"), (0, "name"), (1, "second")]


def _text(spark, value):
    return spark.createDataFrame([("r", value)], "report string, value string")


def test_report_json(spark):
    text = _text(spark, json.dumps({"files": {"a": [1, [], None, None], "b": [0, {}, [], {}]}, "sessions": {"0": {"d": 5, "n": "build", "N": "name", "f": ["x"], "se": {}, "t": [1], "odd": 1}, "12": {}}}))
    assert {(r.chunk_index, r.path) for r in report_reader.parse_report_files(text).collect()} == {(1, "a"), (0, "b")}
    rows = {r.session_index: r for r in report_reader.parse_report_sessions(text).collect()}
    assert (rows[0].timestamp, rows[0].build, rows[0].name, rows[0].flags, rows[0].session_extras, rows[0].job_name) == (5, "build", "name", '["x"]', "{}", None)
    assert set(rows) == {0, 12} and rows[12].flags is None
    empty = _text(spark, '{"files":{},"sessions":{}}')
    assert report_reader.parse_report_files(empty).count() == report_reader.parse_report_sessions(empty).count() == 0


@pytest.mark.parametrize("text", ['{"files":{}}', '{"sessions":{}}', "", "[]", '{"files":{"a":[1,2]},"sessions":{}}', '{"files":{"a":["x",1,2,3]},"sessions":{}}', '{"files":{},"sessions":{"x":{}}}', '{"files":{},"sessions":{"-1":{}}}'])
def test_malformed_report_json(spark, text):
    with pytest.raises(Exception):  # noqa: B017
        report_reader.parse_report_files(_text(spark, text)).collect()
        report_reader.parse_report_sessions(_text(spark, text)).collect()


def test_header_and_chunks(spark):
    with_header = _text(spark, '{"labels_index":{"1":"x"},"other":2}' + HEADER_END + "{}\n\n[1,null,[[0,1]]]" + CHUNK_END + "null" + CHUNK_END + "null\n[2,null,[[0,2]]]")
    assert [(r.label, r.name) for r in report_reader.parse_labels_index(with_header).collect()] == [("1", "x")]
    chunks = report_reader.parse_chunks(with_header)
    assert sorted((r.chunk_index, r.line_no) for r in report_reader.parse_report_lines(chunks).collect()) == [(0, 2), (2, 1)]
    without = _text(spark, "{}\n[1,null,[[0,1]]]")
    assert [(r.chunk_index, r.line_no) for r in report_reader.parse_report_lines(report_reader.parse_chunks(without)).collect()] == [(0, 1)]
    with pytest.raises(Exception, match="must be a string"):
        report_reader.parse_labels_index(_text(spark, '{"labels_index":{"1":5}}' + HEADER_END + "null")).collect()


#: Lines of a real report in the format: (first, last, hits) for each of three files.
RANGES = {
    0: [(17, 25, 3), (39, 43, 2), (45, 49, 1), (51, 53, 1), (55, 59, 1), (61, 78, 1)],
    1: [(5, 5, 0), (12, 12, 0), (22, 22, 0), (33, 33, 0), (45, 45, 1)],
    2: [(3, 3, 0), (10, 16, 0), (18, 27, 0), (29, 39, 0), (41, 48, 0), (50, 50, 0), (51, 52, 5), (53, 54, 6), (55, 56, 5)],
}


def _report():
    chunks = []
    for ranges in RANGES.values():
        hits = {n: h for a, b, h in ranges for n in range(a, b + 1)}
        chunks.append("{}\n" + "\n".join(f"[{hits[n]}, null, [[0, {hits[n]}]]]" if n in hits else "" for n in range(1, max(hits) + 1)))
    paths = {"s/one.rs": [0, [], {}, None], "s/two.rs": [1, [], {}, None], "s/three.rs": [2, [], {}, None]}
    return json.dumps({"files": paths, "sessions": {"0": {"d": 1704827412, "a": "raw/url", "f": [], "j": "CI", "st": "uploaded", "se": {}}}}), "{}" + HEADER_END + CHUNK_END.join(chunks)


def test_whole_report(spark, tmp_path):
    document, chunks = _report()
    (tmp_path / "r.json").write_text(document)
    (tmp_path / "r.chunks").write_text(chunks)
    parsed = report_reader.parse_report(spark, str(tmp_path / "r.json"), str(tmp_path / "r.chunks"), staging=str(tmp_path / "staging"))
    assert parsed.errors.count() == 0 and parsed.store.problems() == {}
    got = {r.path: (r.file_lines, r.file_hits, r.file_misses) for r in files.file_totals(parsed.store).collect()}
    assert got == {"s/one.rs": (45, 45, 0), "s/two.rs": (5, 1, 4), "s/three.rs": (44, 6, 38)}
    row = sessions.session_totals(parsed.store).first()
    assert (row.session_files, row.session_lines, row.session_hits, row.session_misses, row.job_name) == (3, 94, 52, 42, "CI")
    ids = sorted(r.local_sample_id for r in parsed.store.coverage_sample.collect())
    assert ids == list(range(94))
    again = report_reader.parse_report(spark, str(tmp_path / "r.json"), str(tmp_path / "r.chunks"))
    assert again.store.raw_upload.first().id == parsed.store.raw_upload.first().id


def test_unknown_references_and_fail_fast(spark):
    document = _text(spark, '{"files":{"a":[0,[],null,null]},"sessions":{"0":{}}}')
    chunks = _text(spark, "{}\n[1,null,[[0,1],[9,1]]]\nbroken" + CHUNK_END + "{}\n[1,null,[[0,1]]]")
    parsed = report_reader.parse_reports(document, chunks)
    assert sorted(r.error for r in parsed.errors.collect()) == ["malformed line", "unknown chunk", "unknown session"]
    assert parsed.store.coverage_sample.count() == 1
    with pytest.raises(Exception, match="malformed line|unknown"):
        report_reader.parse_reports(document, chunks, fail_fast=True).store.coverage_sample.collect()


def test_round_trip_with_labels_branches_and_spans(spark):
    first = sample_store.build(spark)
    document = report_writer.report_json(first).select(F.lit("r").alias("report"), F.col("report_json").alias("value"))
    chunks = report_writer.chunks_document(first).select(F.lit("r").alias("report"), "value")
    parsed = report_reader.parse_reports(document, chunks)
    assert parsed.errors.count() == 0
    again = parsed.store
    before, after = totals.totals(first).first().asDict(), totals.totals(again).first().asDict()
    assert before == after
    assert sorted(r.branch for r in again.branches_data.collect()) == ["2", "3"]
    assert [(r.start_col, r.end_col, r.hits, r.start_line) for r in again.span_data.collect()] == [(3, None, 3, 8)]
    assert sorted(r.name for r in again.context.collect()) == ["case", "case 2"]
    assert again.context_assoc.count() == 5
    assert again.problems() == {}


def test_written_files_read_back(spark, tmp_path):
    report_writer.write_report(sample_store.build(spark), str(tmp_path / "j"), str(tmp_path / "c"))
    parsed = report_reader.parse_report(spark, str(tmp_path / "j" / "part-*"), str(tmp_path / "c" / "part-*"))
    assert totals.totals(parsed.store).first() == totals.totals(sample_store.build(spark)).first()


@pytest.mark.parametrize("header", ['{"labels_index":{"1":"x"}}' + HEADER_END, ""])
def test_chunks_file_in_many_splits(spark, tmp_path, header):
    """Chunks are numbered by their place in the file, however the file is cut; parts of one report go on from each other."""
    chunks = [f"{{}}\n[{k},null,[[0,{k}]]]" + "\n" * (k % 9) for k in range(500)]
    (tmp_path / "a.chunks").write_text(header + CHUNK_END.join(chunks))
    whole = {r.chunk_index: r.chunk for r in report_reader.parse_chunks(_text(spark, header + CHUNK_END.join(chunks))).collect()}
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    try:
        spark.conf.set("spark.sql.files.maxPartitionBytes", "2000")
        cut = report_reader.read_chunks(spark, str(tmp_path / "a.chunks"), F.lit("r"))
        rows = cut.collect()
        assert {r.chunk_index: r.chunk for r in rows} == whole and len(rows) == 500
        assert spark.read.text(str(tmp_path / "a.chunks"), lineSep=CHUNK_END).rdd.getNumPartitions() > 5
        assert [r.header for r in rows if r.header is not None] == [header.removesuffix(HEADER_END)] * bool(header)
        (tmp_path / "p-0").write_text(header + "".join(c + CHUNK_END for c in chunks[:200]))
        (tmp_path / "p-1").write_text(CHUNK_END.join(chunks[200:]))
        parts = report_reader.read_chunks(spark, str(tmp_path / "p-*"), F.lit("r")).collect()
        assert {r.chunk_index: r.chunk for r in parts} == whole
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)


@pytest.mark.parametrize("point", ["[0]", "[0,1,null]", '[0,1,"z",["a"]]', '["0",1,null,["a"]]', "[0,1,null,[true]]", '[0,"x",null,["a"]]', "7", '[0,1,null,["a"],1]'])
def test_malformed_datapoints(spark, point):
    rows = _lines(spark, f"[1,null,[[0,1]],null,null,[{point}]]", '[1,null,[[0,1]],null,null,[[0,1,null,["a",3]]]]', "[1,null,[[0,1]],null,null,[]]", "[1,null,[[0,1]],null,null,null]").collect()
    assert [bool(r.error) for r in sorted(rows, key=lambda r: r.line_no)] == [True, False, False, False]


def test_malformed_chunk_headers(spark):
    chunks = spark.createDataFrame([("r", k, c) for k, c in enumerate(["{}\n[1,null,[[0,1]]]", "null", '{"present_sessions":[0]}\n', "[1,null,[[0,1]]]", "{\n", "[]\n", ""])], "report string, chunk_index long, chunk string")
    assert sorted(r.chunk_index for r in report_reader.chunk_errors(chunks).collect()) == [3, 4, 5, 6]
    document, texts = _text(spark, '{"files":{"a":[0,[],null,null]},"sessions":{"0":{}}}'), _text(spark, "oops\n[1,null,[[0,1]]]")
    parsed = report_reader.parse_reports(document, texts)
    assert [(r.error, r.line_no) for r in parsed.errors.collect()] == [("malformed chunk header", 0)] and parsed.store.coverage_sample.count() == 1
    with pytest.raises(ValueError, match="malformed chunk header"):
        report_reader.parse_reports(document, texts, fail_fast=True)


def test_plain_lines_read_as_by_the_whole_grammar(spark):
    """Lines as writers put them take the short way, and give what the whole grammar gives; all others do not take it."""
    from lumencov.functions import parsing as P

    plain = [
        "[1,null,[[0,1]]]", '["1/4","b",[[0,"1/4",["1","3"]],[12,"4/4"]]]', '[3,null,[[7,3,null,[[2,null,3],[null,5,0]]]],null,null,[[7,3,null,["2-HIGH","é ]],["]]]]', '[0,"m",[[1,0,null,null,[2,3]],[2,0,null,null,4]],null,[2,7]]',
        '["0/2",null,[[0,"0/2"]],null,null,null]', '[2,"b",[[0,2],[1,3]]]', '["1/2","m",[[0,"1/2"]]]', '[1,null,[[0,1],[0,2]],null,null,[[0,1,null,["a"]],[0,2,null,["b","c"]],[5,1,null,["d"]]]]', "[" + "1,null,[" + ",".join(f"[{k},1]" for k in range(1000)) + "]]",
    ]
    others = ["[01,null,[[0,1]]]", "[1,null,[[0,1]]] ", "[1, null,[[0,1]]]", "[1,null,[]]", "[1,null,[[0,1,[]]]]", '[1,"line",[[0,1]]]', "[true,null,[[0,true]]]", "[1.5,null,[[0,1.5]]]", "[9999999999,null,[[0,1]]]", '[1,null,[[0,1]],null,null,[[0,1,null,["a\\n"]]]]', '["1/4","b",[[0,"1/4",["0:1"]]]]', "[1,null,[[0,1]],null,null,[]]", "x"]
    lines = spark.createDataFrame([("r", 0, k, raw) for k, raw in enumerate(plain + others)], "report string, chunk_index long, line_no long, raw string")
    assert [r.plain for r in lines.orderBy("line_no").select(F.col("raw").rlike(P.PLAIN).alias("plain")).collect()] == [True] * len(plain) + [False] * len(others)
    columns = [F.col(c) if c not in ("branches", "partials") else F.when(F.col("error").isNull(), F.to_json(c)).alias(c) for c in report_reader._any_line_sessions(lines).columns]
    own = lines.where(F.col("line_no") < len(plain))
    got, want = ([tuple(map(str, r)) for r in rows.select(*columns).orderBy("line_no", "place").collect()] for rows in (report_reader._plain_line_sessions(own), report_reader._any_line_sessions(own)))
    assert got == want and len(got) > 1000
    assert [r.error for r in report_reader.parse_line_sessions(lines).where(F.col("line_no") == 5).orderBy("place").collect()] == [None, "malformed session"]

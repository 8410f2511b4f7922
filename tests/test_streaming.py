import json

from lumencov.operators import totals
from lumencov.sources.formats import HEADER_END
from lumencov.streaming import ingest


def _put(folder, name, hits):
    (folder / f"{name}.json").write_text(json.dumps({"files": {"shared.rs": [0, [], None, None]}, "sessions": {"0": {"N": name}}}))
    (folder / f"{name}.chunks").write_text('{"labels_index":{"1":"label"}}' + HEADER_END + f'{{}}\n[{hits},null,[[0,{hits}]],null,null,[[0,{hits},null,["1"]]]]\nbroken')


def test_reports_that_arrive_later_are_added(spark, tmp_path):
    folder, store, checkpoint = tmp_path / "in", str(tmp_path / "store"), str(tmp_path / "checkpoint")
    folder.mkdir()
    _put(folder, "one", 1)
    ingest.ingest(spark, str(folder), store, checkpoint).awaitTermination()
    first = totals.totals(ingest.read_ingested(spark, store)).first()
    assert (first.file_count, first.upload_count, first.total_lines, first.hit_lines, first.test_case_count) == (1, 1, 1, 1, 1)
    _put(folder, "two", 0)
    _put(folder, "three", 2)
    ingest.ingest(spark, str(folder), store, checkpoint).awaitTermination()
    both = totals.totals(ingest.read_ingested(spark, store)).first()
    assert (both.file_count, both.upload_count, both.total_lines, both.hit_lines, both.test_case_count) == (1, 3, 3, 2, 1)
    assert spark.read.parquet(f"{store}/errors").count() == 3

import os

import duckdb
import pytest

import __spark_entry__ as entry

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no tables")


@pytest.fixture(scope="module")
def duck():
    connection = duckdb.connect()
    for name in os.listdir(SF):
        connection.execute(f"CREATE VIEW {name.removesuffix('.parquet')} AS SELECT * FROM '{SF}/{name}'")
    return connection


@pytest.mark.parametrize("name", sorted(entry.oracle_sql()))
def test_query_against_sql(spark, duck, name):
    frame = entry.queries()[name](spark, SF)
    result = duck.execute(entry.oracle_sql()[name])
    names = [d[0] for d in result.description]
    assert sorted(names) == sorted(frame.columns)
    want = [tuple(row[names.index(c)] for c in frame.columns) for row in result.fetchall()]
    key = lambda row: tuple((v is None, str(v)) for v in row)
    assert sorted(map(tuple, frame.collect()), key=key) == sorted(want, key=key)


def test_entry(spark):
    assert entry.entry(spark).count() == 1


def test_every_engine_query_has_sql():
    from lumencov.plans import catalog, oracle

    assert catalog.queries().keys() == oracle.oracle_sql().keys()


@pytest.mark.parametrize(("name", "table"), [("branches_for_samples", "branches_data"), ("methods_for_samples", "method_data"), ("spans_for_samples", "span_data"), ("contexts_for_samples", "context_assoc")])
def test_lookup_covers_every_sample(spark, name, table):
    """The rows of all uploads and samples, as many as the table itself has."""
    queries = entry.queries()
    assert queries[name](spark, SF).count() == queries[f"scan_{table}"](spark, SF).count() > 0


def test_lookup_covers_every_file(spark):
    queries = entry.queries()
    found = {r.source_file_id for r in queries["samples_for_files"](spark, SF).select("source_file_id").distinct().collect()}
    assert found == {r.source_file_id for r in queries["scan_coverage_sample"](spark, SF).select("source_file_id").distinct().collect()}
    assert {k % 20 for k in found} == set(range(20))

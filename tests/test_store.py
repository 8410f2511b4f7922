import pytest
from hypothesis import given
from hypothesis import strategies as st
from pyspark.sql import functions as F

from lumencov.functions import seahash
from lumencov.operators import totals
from lumencov.plans import numbering, schema
from lumencov.plans.store import CoverageStore

from . import sample_store


def test_hash_vector_and_orders():
    assert seahash.seahash(b"to be or not to be") == 1988685042348123509
    assert seahash.signed_id("test case 2") < seahash.signed_id("test case 1")
    assert seahash.signed_id("test-case") < seahash.signed_id("test-case 2")


@given(st.binary(max_size=70))
def test_hash_is_64_bit(data):
    assert 0 <= seahash.seahash(data) < 1 << 64


def test_hash_column(spark):
    got = [r[0] for r in spark.createDataFrame([("a",), (None,)], "x string").select(seahash.seahash_id("x")).collect()]
    assert got == [seahash.signed_id("a"), None]


def test_write_read_append(spark, tmp_path):
    path = str(tmp_path / "store")
    first = sample_store.build(spark).write(path)
    assert totals.totals(first).first() == totals.totals(sample_store.build(spark)).first()
    with pytest.raises(FileExistsError):
        first.write(path)
    other = CoverageStore.of(coverage_sample=spark.createDataFrame([(11, 0, 7, 1, "l", 1, None, None)], schema.TABLES["coverage_sample"]), source_file=spark.createDataFrame([(7, "lib/a.rs"), (8, "lib/c.rs")], "id long, path string"))
    first.append(other, path)
    again = CoverageStore.read(spark, path)
    assert again.source_file.count() == 3 and again.coverage_sample.count() == 10


def test_failed_write_leaves_nothing(spark, tmp_path):
    store = sample_store.build(spark)
    bad = CoverageStore(**(store.tables() | {"span_data": store.span_data.withColumn("hits", F.raise_error(F.lit("no")).cast("long"))}))
    with pytest.raises(Exception):  # noqa: B017
        bad.write(str(tmp_path / "s"))
    assert list(tmp_path.iterdir()) == []


def test_merge(spark):
    left = sample_store.build(spark)
    right = CoverageStore.of(
        source_file=spark.createDataFrame([(7, "other name"), (9, "lib/d.rs")], "id long, path string"),
        context=spark.createDataFrame([(3, "case 3")], "id long, name string"),
        coverage_sample=spark.createDataFrame([(20, k, 9, k, "l", k, None, None) for k in range(3)], schema.TABLES["coverage_sample"]),
    )
    merged = left.merge(right)
    assert {r.id: r.path for r in merged.source_file.collect()} == {7: "lib/a.rs", 3: "lib/b.rs", 9: "lib/d.rs"}
    assert merged.context.count() == 3 and merged.coverage_sample.count() == 12
    a, b, m = (totals.totals(s).first() for s in (left, right, merged))
    assert m.total_lines == a.total_lines + b.total_lines and m.hit_lines == a.hit_lines + b.hit_lines


def test_problems(spark):
    store = sample_store.build(spark)
    assert store.problems() == {}
    assert store.merge(store).problems().keys() == {"coverage_sample", "branches_data", "method_data", "span_data"}
    odd = store.coverage_sample.withColumn("coverage_type", F.lit("z"))
    assert CoverageStore(**(store.tables() | {"coverage_sample": odd})).problems() == {"coverage_sample": 9}


def test_numbering(spark):
    rows = [("hot", x) for x in range(500)] + [("cold", x) for x in range(7)]
    frame = spark.createDataFrame(rows, "k string, x long").repartition(7)
    got = numbering.dense_numbers(frame, "k", F.expr("x div 64"), ["x"], "n")
    assert got.where("n <> x").count() == 0 and got.count() == 507
    ids = spark.createDataFrame([(x,) for x in (-(1 << 62), -5, 0, 3, 1 << 50, (1 << 63) - 1)], "id long")
    assert [r.i for r in numbering.indexed(ids, "i").orderBy("id").collect()] == list(range(6))


def test_known_totals_of_the_star_schema(spark):
    """Regression: totals of the mapped tables at one scale."""
    import os

    from lumencov.sources import star_schema

    if not os.path.isdir("/root/testdata/sf0.01"):
        pytest.skip("no tables")
    assert tuple(totals.totals(star_schema.load(spark, "/root/testdata/sf0.01")).first()) == (2000, 100, 5, 17076, 19926, 51679, 80112, 20028, 17197, 20046, 28399, 82976)


def test_duplicates_are_errors(spark):
    store = sample_store.build(spark)
    paths = lambda *p: spark.createDataFrame([(x,) for x in p], "path string")
    more = store.insert_files(paths("new/a.rs", "new/b.rs"))
    assert more.source_file.count() == store.source_file.count() + 2
    with pytest.raises(ValueError, match="there already"):
        more.insert_files(paths("new/a.rs"))
    with pytest.raises(ValueError, match="there already"):
        store.insert_files(paths("c.rs", "c.rs"))
    names = spark.createDataFrame([("x",)], "name string")
    with pytest.raises(ValueError, match="there already"):
        store.insert_contexts(names).insert_contexts(names)
    with pytest.raises(ValueError, match="coverage_sample has a key twice"):
        store.merge(store, strict=True)
    other = CoverageStore.of(coverage_sample=spark.createDataFrame([(99, 0, 7, 1, "l", 1, None, None)], schema.TABLES["coverage_sample"]))
    assert store.merge(other, strict=True).coverage_sample.count() == 10


def test_a_failed_append_adds_nothing(spark, tmp_path):
    path = str(tmp_path / "store")
    first = sample_store.build(spark).write(path)
    bad = CoverageStore.of(source_file=spark.createDataFrame([(50, "x")], "id long, path string"), span_data=first.span_data.withColumn("hits", F.raise_error(F.lit("no")).cast("long")))
    with pytest.raises(Exception):  # noqa: B017
        first.append(bad, path)
    again = CoverageStore.read(spark, path)
    assert again.source_file.count() == 2 and [p.name for p in tmp_path.iterdir()] == ["store"]


def test_small_and_hashed_ids_are_numbered_in_many_buckets(spark):
    for ids in (list(range(3000)), [(k * 7919**4) % (1 << 63) * (1 if k % 2 else -1) for k in range(3000)], [5], []):
        ids = sorted(set(ids))
        got = numbering.indexed(spark.createDataFrame([(x,) for x in ids], "id long"), "i").orderBy("id").collect()
        assert [(r.id, r.i) for r in got] == [(x, k) for k, x in enumerate(ids)]

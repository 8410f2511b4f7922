"""A coverage store: eight DataFrames, lazily read, built, merged and written."""

from __future__ import annotations

import uuid
from dataclasses import dataclass, fields, replace

from pyspark.sql import DataFrame, SparkSession

from ..functions.seahash import seahash_id
from . import schema


@dataclass(frozen=True)
class CoverageStore:
    source_file: DataFrame
    raw_upload: DataFrame
    context: DataFrame
    context_assoc: DataFrame
    coverage_sample: DataFrame
    branches_data: DataFrame
    method_data: DataFrame
    span_data: DataFrame

    @property
    def spark(self) -> SparkSession:
        return self.source_file.sparkSession

    def tables(self) -> dict[str, DataFrame]:
        return {f.name: getattr(self, f.name) for f in fields(self)}

    @classmethod
    def of(cls, **tables: DataFrame) -> CoverageStore:
        """From any of the tables; the others are empty. Columns are brought to the schema."""
        spark = next(iter(tables.values())).sparkSession
        given = {n: schema.conform(tables[n], n) if n in tables else spark.createDataFrame([], s) for n, s in schema.TABLES.items()}
        return cls(**given)

    @classmethod
    def empty(cls, spark: SparkSession) -> CoverageStore:
        return cls(**{n: spark.createDataFrame([], s) for n, s in schema.TABLES.items()})

    @classmethod
    def read(cls, spark: SparkSession, path: str) -> CoverageStore:
        """The store at `path` with all that was appended to it."""
        fs, target = _filesystem(spark, path)
        folder = target.suffix("/appends")
        parts = sorted(f.getPath().toString() for f in fs.listStatus(folder)) if fs.exists(folder) else []
        return cls(**{n: spark.read.schema(s).parquet(*[f"{p}/{n}" for p in (path, *parts)]) for n, s in schema.TABLES.items()})

    def write(self, path: str, bucket_rows: bool = True) -> CoverageStore:
        """Writes all tables beside the target, then publishes them with one rename.

        Facts are laid out by file, so that queries on a file prune row groups.
        """
        fs, target = _filesystem(self.spark, path)
        if fs.exists(target):
            raise FileExistsError(path)
        self._publish(path, f"{path.rstrip('/')}.staged-{uuid.uuid4().hex}", bucket_rows)
        return CoverageStore.read(self.spark, path)

    def append(self, other: CoverageStore, path: str) -> None:
        """Adds other's rows to the store at `path`: new dimension rows and all facts, in one folder published with one rename, so all or nothing."""
        new = {n: df.join(getattr(self, n).select("id"), "id", "left_anti").select(*df.columns) if n in schema.DIMENSIONS else df for n, df in other.tables().items()}
        name, base = uuid.uuid4().hex, path.rstrip("/")
        fs, target = _filesystem(self.spark, path)
        fs.mkdirs(target.suffix("/appends"))
        CoverageStore(**new)._publish(f"{base}/appends/{name}", f"{base}.staged-{name}", False)

    def _publish(self, path: str, staged: str, bucket_rows: bool) -> None:
        fs, target = _filesystem(self.spark, path)
        _, source = _filesystem(self.spark, staged)
        try:
            for name, df in self.tables().items():
                if bucket_rows and name in ("coverage_sample", "branches_data", "method_data", "span_data"):
                    df = df.repartitionByRange("source_file_id").sortWithinPartitions("source_file_id")
                df.write.parquet(f"{staged}/{name}")
            if not fs.rename(source, target):
                raise OSError(f"could not publish {path}")
        except BaseException:
            fs.delete(source, True)
            raise

    def insert_files(self, paths: DataFrame) -> CoverageStore:
        """With the files of `paths` (path), their ids hashed; a file that is there already, or comes twice, is an error."""
        return self._insert("source_file", paths.select(seahash_id("path").alias("id"), "path"))

    def insert_contexts(self, names: DataFrame) -> CoverageStore:
        """With the contexts of `names` (name), likewise."""
        return self._insert("context", names.select(seahash_id("name").alias("id"), "name"))

    def _insert(self, table: str, rows: DataFrame) -> CoverageStore:
        merged = getattr(self, table).unionByName(rows)
        if (twice := schema.violations(merged, table).first()) is not None:
            raise ValueError(f"{table} {twice.id} is there already")
        return replace(self, **{table: merged})

    def merge(self, other: CoverageStore, strict: bool = False) -> CoverageStore:
        """Dimension rows of either (this store's win), facts of both; with `strict`, a fact's key that both have is an error."""
        merged = {n: merge_dimension(getattr(self, n), getattr(other, n)) for n in schema.DIMENSIONS}
        merged |= {n: merge_facts(getattr(self, n), getattr(other, n)) for n in schema.FACTS}
        out = CoverageStore(**merged)
        if strict:
            for n in schema.FACTS:
                if (clash := schema.violations(getattr(out, n), n).first()) is not None:
                    raise ValueError(f"{n} has a key twice: {clash.asDict()}")
        return out

    def problems(self) -> dict[str, int]:
        """Rows that break a key or an enumeration, by table; empty for a sound store."""
        found = {}
        for name, df in self.tables().items():
            n = schema.violations(df, name).count() + schema.unknown_codes(df, name).count()
            if n:
                found[name] = n
        return found


def _filesystem(spark: SparkSession, path: str):
    """The file system of a path, and the path, as Hadoop objects."""
    target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), target


def merge_dimension(left: DataFrame, right: DataFrame) -> DataFrame:
    return left.unionByName(right.join(left.select("id"), "id", "left_anti").select(*left.columns))


def merge_facts(left: DataFrame, right: DataFrame) -> DataFrame:
    return left.unionByName(right)

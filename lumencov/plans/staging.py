"""A folder that the driver and the executors share, for tables that cut lineage."""

from __future__ import annotations

import atexit
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """A new folder below spark.checkpoint.dir.

    Where the setting is unset, a local session (as in tests) gets a temporary folder; on a
    cluster that would be a machine's own disk, so an error is raised instead.
    """
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not base:
        master = spark.sparkContext.master
        if not master.startswith("local") or master.startswith("local-cluster"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and the executors share")
        base = f"file://{tempfile.gettempdir()}/lumencov-{uuid.uuid4().hex}"
        spark.conf.set("spark.checkpoint.dir", base)
        path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(base)
        fs = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
        atexit.register(lambda: _delete(fs, path))
    return f"{base.rstrip('/')}/{uuid.uuid4().hex}"


def discard(spark: SparkSession, folder: str) -> None:
    """Deletes a folder of staged tables that nothing will read again."""
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
    _delete(path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), path)


def _delete(fs, path) -> None:
    try:
        fs.delete(path, True)
    except Exception:  # the JVM may have gone by then
        pass


@contextmanager
def freed_shuffles(spark: SparkSession) -> Iterator[None]:
    """What is written meanwhile frees its shuffle files as soon as it is done, instead of when the driver collects its garbage."""
    key = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(key, None)
    spark.conf.set(key, "true")
    try:
        yield
    finally:
        spark.conf.set(key, before) if before is not None else spark.conf.unset(key)


def staged(df: DataFrame, folder: str | None, name: str) -> DataFrame:
    """materialise without shuffle files left over; df itself where there is no folder."""
    if not folder:
        return df
    with freed_shuffles(df.sparkSession):
        return materialise(df, folder, name)


def materialise(df: DataFrame, folder: str, name: str) -> DataFrame:
    """Writes df as Parquet in the shared folder and reads it back: lineage ends at a table that outlives executors."""
    df.write.option("compression", "zstd").parquet(f"{folder}/{name}")
    return df.sparkSession.read.schema(df.schema).parquet(f"{folder}/{name}")

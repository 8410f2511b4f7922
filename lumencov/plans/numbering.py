"""Numbers without gaps within a key, also where one key holds a third of all rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def dense_numbers(df: DataFrame, key: str, bucket: Column, order: list[str], name: str) -> DataFrame:
    """df with `name`: 0, 1, 2... within key by (bucket, order).

    Rows are numbered within (key, bucket), which spreads a hot key; what stands before each bucket
    is a running sum over one row for each bucket. `bucket` must grow with the first of `order`.
    """
    own = df.withColumn("__bucket", bucket)
    counts = own.groupBy(key, "__bucket").agg(F.count(F.lit(1)).alias("__n"))
    before = Window.partitionBy(key).orderBy("__bucket").rowsBetween(Window.unboundedPreceding, -1)
    starts = counts.select(key, "__bucket", F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__first"))
    inner = F.row_number().over(Window.partitionBy(key, "__bucket").orderBy(*order))
    return own.withColumn("__inner", inner).join(starts, [key, "__bucket"]).withColumn(name, (F.col("__first") + F.col("__inner") - 1).cast("long")).drop("__bucket", "__inner", "__first")


#: Buckets of an id range.
BUCKETS = 65_536


def indexed(dimension: DataFrame, name: str, first: int = 0, by: str = "id") -> DataFrame:
    """A dimension with its place in the order of signed ids, from `first`.

    The range from the least to the largest id is cut into BUCKETS even buckets, be the ids hashes or small numbers. Each is
    numbered apart; only the counts of the buckets meet in one task, for their running sum.
    """
    ends = dimension.agg(F.min(by).cast("double").alias("__low"), F.max(by).cast("double").alias("__high"))
    part = (F.col(by).cast("double") - F.col("__low")) / (F.col("__high") - F.col("__low") + 1)
    own = dimension.crossJoin(F.broadcast(ends)).withColumn("__bucket", F.floor(part * BUCKETS)).drop("__low", "__high")  # one row
    counts = own.groupBy("__bucket").agg(F.count(F.lit(1)).alias("__n"))
    before = Window.orderBy("__bucket").rowsBetween(Window.unboundedPreceding, -1)
    starts = counts.select("__bucket", F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__first"))
    inner = F.row_number().over(Window.partitionBy("__bucket").orderBy(by))
    return own.withColumn("__inner", inner).join(starts, "__bucket").withColumn(name, (F.col("__first") + F.col("__inner") - 1 + first).cast("long")).drop("__bucket", "__inner", "__first")

"""Index of labels."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..plans.numbering import indexed
from ..plans.store import CoverageStore


def label_index(store: CoverageStore) -> DataFrame:
    """Contexts with their place in the order of ids, from 1."""
    return indexed(store.context, "label_index", first=1).select("label_index", "id", "name")


def labels_header(store: CoverageStore) -> DataFrame:
    """One row, header: {"labels_index": {"1": name, ...}}, or {} without contexts."""
    entry = F.struct(F.col("label_index").cast("string").alias("k"), F.col("name").alias("v"))
    listed = label_index(store).agg(F.array_sort(F.collect_list(F.struct("label_index", entry.alias("e")))).alias("l"))
    index = F.map_from_entries(F.transform("l", lambda x: x["e"]))
    return listed.select(F.when(F.size("l") == 0, "{}").otherwise(F.to_json(F.struct(index.alias("labels_index")))).alias("header"))

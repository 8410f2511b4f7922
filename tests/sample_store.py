"""A store of two files, two uploads and two contexts, with every kind of data."""

from lumencov.plans import schema
from lumencov.plans.store import CoverageStore

A, B = 7, 3  # ids of lib/a.rs and lib/b.rs: b comes first
FIRST, SECOND = 5, 10


def _upload(k, number, attributes):
    return (k, number, f"url {attributes}", f'["flag {attributes}"]', f"provider {attributes}", f"build {attributes}", f"name {attributes}", f"job {attributes}", f"run {attributes}", f"state {attributes}", f"env {attributes}", f"type {attributes}", f'{{"k":"{attributes}"}}')


ROWS = {
    "source_file": [(A, "lib/a.rs"), (B, "lib/b.rs")],
    "raw_upload": [_upload(FIRST, 123, "one"), _upload(SECOND, 456, "two")],
    "context": [(1, "case"), (2, "case 2")],
    "context_assoc": [(1, FIRST, 0, None), (1, FIRST, 1, None), (2, FIRST, 0, None), (2, FIRST, 1, None), (2, FIRST, 11, None)],
    "coverage_sample": [
        (FIRST, 0, A, 1, "l", 3, None, None),
        (FIRST, 1, B, 1, "l", 4, None, None),
        (SECOND, 2, B, 3, "l", 0, None, None),
        (FIRST, 3, A, 3, "b", None, 2, 2),
        (FIRST, 6, B, 6, "b", None, 2, 4),
        (FIRST, 11, A, 2, "m", 2, None, None),
        (FIRST, 13, B, 2, "m", 5, None, None),
        (SECOND, 15, B, 5, "m", 0, None, None),
        (FIRST, 17, A, 8, "l", 3, None, None),
    ],
    "branches_data": [
        (FIRST, 3, 4, A, 1, "c", "0:jump"),
        (FIRST, 3, 5, A, 1, "c", "1"),
        (FIRST, 6, 7, B, 1, "c", "0:jump"),
        (FIRST, 6, 8, B, 1, "c", "1"),
        (FIRST, 6, 9, B, 0, "c", "2"),
        (FIRST, 6, 10, B, 0, "c", "3"),
    ],
    "method_data": [(FIRST, 11, 12, A, 2, 2, 4, 2, 4), (FIRST, 13, 14, B, 2, 2, 4, None, None), (SECOND, 15, 16, B, 5, None, None, 2, 4)],
    "span_data": [(FIRST, 17, 18, A, 3, 8, 3, 8, None)],
}


def build(spark) -> CoverageStore:
    return CoverageStore(**{t: spark.createDataFrame(ROWS[t], s) for t, s in schema.TABLES.items()})

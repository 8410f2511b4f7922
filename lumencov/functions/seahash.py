"""SeaHash, a published 64-bit hash, read as a signed integer: ids of files and contexts."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql.types import LongType

# Fixed values of the published algorithm.
_SEEDS = (0x16F11FE89B0D677C, 0xB480A793D8E6C86C, 0x6FE2E5AAF078EBC9, 0x14F994A4C5259381)
_PRIME = 0x6EED0E9DA4D94A4F
_MASK = (1 << 64) - 1


def _mix(x: int) -> int:
    x = x * _PRIME & _MASK
    x ^= (x >> 32) >> (x >> 60)
    return x * _PRIME & _MASK


def seahash(data: bytes) -> int:
    """Unsigned hash of the bytes."""
    lanes = list(_SEEDS)
    for k, at in enumerate(range(0, len(data), 8)):
        lanes[k % 4] = _mix(lanes[k % 4] ^ int.from_bytes(data[at : at + 8], "little"))
    return _mix(lanes[0] ^ lanes[1] ^ lanes[2] ^ lanes[3] ^ len(data))


def signed_id(name: str) -> int:
    h = seahash(name.encode())
    return h - (1 << 64) if h >> 63 else h


@F.pandas_udf(LongType())
def seahash_id(names: pd.Series) -> pd.Series:
    """The signed id of a path or context name; null for null. Each distinct name of a batch is hashed once."""
    codes, distinct = pd.factorize(names)
    ids = pd.array([*map(signed_id, distinct), None], dtype="Int64")
    return pd.Series(ids.take(codes))

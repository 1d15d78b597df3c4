"""Column functions over byte strings, and the hashes of the file filter."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T


def compare(a: Column, b: Column) -> Column:
    """-1, 0 or 1: unsigned byte order, in which a proper prefix comes first; null if either is."""
    return F.when(a < b, F.lit(-1)).when(a == b, F.lit(0)).when(a > b, F.lit(1))


def record_length(key: Column, value: Column) -> Column:
    """Bytes of a record: key, value and one length byte for each; a tombstone has no value."""
    return (F.octet_length(key) + F.coalesce(F.octet_length(value), F.lit(0)) + F.lit(2)).cast("long")


def ordered_text(key: Column) -> Column:
    """Text that sorts as the bytes do."""
    return F.hex(key)


def fnv32(data: bytes, xor_first: bool) -> int:
    h = 2166136261
    for b in data:
        h = ((h ^ b) * 16777619) & 0xFFFFFFFF if xor_first else ((h * 16777619) & 0xFFFFFFFF) ^ b
    return h


def _fnv(keys: pd.Series, xor_first: bool) -> np.ndarray:
    """32-bit hashes of many keys, one byte place at a time."""
    n = len(keys)
    size = np.array([len(k) if k is not None else 0 for k in keys], np.int64)
    raw = np.frombuffer(b"".join(k for k in keys if k), np.uint8)
    start = np.cumsum(size) - size
    h = np.full(n, 2166136261, np.uint64)
    for place in range(int(size.max()) if n else 0):
        on = np.flatnonzero(size > place)
        b = raw[start[on] + place].astype(np.uint64)
        x = h[on]
        x = ((x ^ b) * np.uint64(16777619)) & np.uint64(0xFFFFFFFF) if xor_first else ((x * np.uint64(16777619)) & np.uint64(0xFFFFFFFF)) ^ b
        h[on] = x
    return h


@F.pandas_udf(T.LongType())
def fnv1(keys: pd.Series) -> pd.Series:
    """FNV-1, 32 bits, of a binary column."""
    return pd.Series(_fnv(keys, False).astype(np.int64)).where(keys.notna().to_numpy(), None)


@F.pandas_udf(T.LongType())
def fnv1a(keys: pd.Series) -> pd.Series:
    """FNV-1a, 32 bits, of a binary column."""
    return pd.Series(_fnv(keys, True).astype(np.int64)).where(keys.notna().to_numpy(), None)


def bloom_places(key: Column, bits: int) -> Column:
    """The two bits that a key sets in a filter of ``bits`` bits."""
    return F.array((fnv1(key) % F.lit(bits)), (fnv1a(key) % F.lit(bits)))

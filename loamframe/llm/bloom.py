"""Bloom filters of bounded size, to leave rows out before the costly part of a task.

A filter only spares work: what it lets through is joined exactly afterwards.  Its
size follows the number of keys up to MAX_BITS; beyond that more rows pass.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loamframe.llm.kernels import mix

#: 8 MB at most.
MAX_BITS = 1 << 26
BITS_PER_KEY = 16
_SALTS = (np.uint64(0x8CB92BA72F3D8DD7), np.uint64(0x2545F4914F6CDD1D), np.uint64(0x9E3779B97F4A7C15))


def place(keys: np.ndarray, salt: np.uint64, bits: int) -> np.ndarray:
    """Bit numbers of int64 or uint64 keys; bits is a power of two."""
    return (mix(keys.view(np.uint64) ^ salt) & np.uint64(bits - 1)).astype(np.int64)


def size_for(n: int) -> int:
    bits = 1 << 13
    while bits < min(BITS_PER_KEY * n, MAX_BITS):
        bits *= 2
    return bits


def build(keys: DataFrame, column: str, n: int) -> np.ndarray:
    """The filter of a column of longs as packed bits; n is their number.

    Tasks send the 64-bit words of the filter that they fill; these are united by
    a grouping, and at most MAX_BITS / 64 rows reach the driver.
    """
    bits = size_for(n)

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            own = batch.column(0).to_numpy(zero_copy_only=False).astype(np.int64)
            at = np.sort(np.concatenate([place(own, salt, bits) for salt in _SALTS]))
            words, first = np.unique(at >> 6, return_index=True)
            filled = np.bitwise_or.reduceat(np.uint64(1) << (at & 63).astype(np.uint64), first) if len(at) else np.zeros(0, np.uint64)
            yield pa.RecordBatch.from_arrays([pa.array(words), pa.array(filled.view(np.int64))], names=["word", "filled"])

    rows = keys.select(F.col(column).cast("long")).where(F.col(column).isNotNull()).mapInArrow(partial, "word long, filled long")
    found = rows.groupBy("word").agg(F.bit_or("filled").alias("filled")).toPandas()
    out = np.zeros(bits >> 6, dtype=np.int64)
    out[found["word"].to_numpy(dtype=np.int64)] = found["filled"].to_numpy(dtype=np.int64)
    return out.view(np.uint64)


def may_hold(words: np.ndarray, keys: np.ndarray) -> np.ndarray:
    """Indices of the keys that may be in the filter, among them all that are."""
    left = np.arange(len(keys))
    for salt in _SALTS:
        at = place(keys[left], salt, len(words) * 64)
        left = left[(words[at >> 6] >> (at & 63).astype(np.uint64)) & np.uint64(1) == 1]
    return left


def free_name(df: DataFrame, name: str = "_key") -> str:
    """A column name that df does not have."""
    taken = {c.lower() for c in df.columns}
    while name in taken:
        name = "_" + name
    return name

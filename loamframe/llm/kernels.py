"""Vectorised text kernels over Arrow string columns.

A text column is handled as one flat UTF-8 byte buffer plus offsets, so that
splitting and hashing words costs a few numpy passes instead of one Python
object per word.  Nulls count as empty texts.  Long columns are cut into
pieces of bounded size; a single longer text forms a piece of its own, whose
words are hashed in runs of bounded size.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame

#: Small enough for the arrays of a piece to stay in a core's cache and a task's memory to stay low.
PIECE_BYTES = 1 << 18
#: Bytes of a batch of rows on its way to Python, at most, but for a single larger row.
BATCH_BYTES = 4 << 20
_U = np.uint64

_rng = np.random.Generator(np.random.PCG64(20240611))
BYTE_CODES = _rng.integers(1, 1 << 63, 256, dtype=np.uint64) * _U(2) + _U(1)
_BASE = _U(0x9E3779B97F4A7C15)
_powers = np.ones(1, dtype=np.uint64)
_inverse_powers = np.ones(1, dtype=np.uint64)

IS_SPACE = np.zeros(256, dtype=bool)
IS_SPACE[[0x20, 9, 10, 11, 12, 13]] = True

ASCII_LOWER = np.arange(256, dtype=np.uint8)
ASCII_LOWER[65:91] += 32


def mix(h: np.ndarray) -> np.ndarray:
    """Bijective finaliser on uint64 values; every input bit reaches every output bit."""
    h = (h ^ (h >> _U(30))) * _U(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> _U(27))) * _U(0x94D049BB133111EB)
    return h ^ (h >> _U(31))


def powers(n: int) -> np.ndarray:
    """The first n powers of the hash base."""
    global _powers
    if len(_powers) < n:
        size = max(n, 2 * len(_powers), 1024)
        full = np.full(size, _BASE, dtype=np.uint64)
        full[0] = 1
        _powers = np.multiply.accumulate(full)
    return _powers[:n]


def inverse_powers(n: int) -> np.ndarray:
    """The first n powers of the hash base's inverse."""
    global _inverse_powers
    if len(_inverse_powers) < n:
        full = np.full(max(n, 2 * len(_inverse_powers), 1024), pow(int(_BASE), -1, 1 << 64), dtype=np.uint64)
        full[0] = 1
        _inverse_powers = np.multiply.accumulate(full)
    return _inverse_powers[:n]


def in_batches(df: DataFrame, work: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], schema) -> DataFrame:
    """mapInArrow with small batches: from here on the session's batches hold at most BATCH_BYTES."""
    conf, name = df.sparkSession.conf, "spark.sql.execution.arrow.maxBytesPerBatch"
    size, unit = re.fullmatch(r"(-?\d+)([bkmg]?)b?", conf.get(name).lower()).groups()
    if not 0 < int(size) << {"k": 10, "m": 20, "g": 30}.get(unit, 0) <= BATCH_BYTES:
        conf.set(name, str(BATCH_BYTES))
    return df.mapInArrow(work, schema)


def pieces(texts: pa.Array, limit: int = PIECE_BYTES, prepare: Callable[[pa.Array], pa.Array] | None = None) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, end row, bytes, offsets) of consecutive pieces of a string column, each prepared by itself."""
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    n = len(texts)
    ends = np.cumsum(pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False).astype(np.int64))
    i = 0
    while i < n:
        before = int(ends[i - 1]) if i else 0
        j = min(n, max(i + 1, int(np.searchsorted(ends, before + limit, side="right"))))
        piece = pc.fill_null(texts.slice(i, j - i).cast(pa.large_string()), "")
        if prepare is not None:
            piece = prepare(piece)
        _, offsets, data = piece.buffers()
        offs = np.frombuffer(offsets, dtype=np.int64)[piece.offset : piece.offset + j - i + 1]
        buf = np.frombuffer(data, dtype=np.uint8) if data is not None and data.size else np.zeros(0, dtype=np.uint8)
        yield i, j, buf[offs[0] : offs[-1]], offs - offs[0]
        i = j


def word_bounds(buf: np.ndarray, offs: np.ndarray, is_word: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts, ends and row of every word; rows cut words, so none spans two texts."""
    inside = ~IS_SPACE[buf] if is_word is None else is_word
    if not len(buf):
        z = np.zeros(0, dtype=np.int64)
        return z, z, z
    first = inside.copy()
    first[1:] &= ~inside[:-1]
    last = inside.copy()
    last[:-1] &= ~inside[1:]
    cuts = offs[1:-1]
    cuts = cuts[(cuts > 0) & (cuts < len(buf))]
    first[cuts] = inside[cuts]
    last[cuts - 1] = inside[cuts - 1]
    starts, ends = np.flatnonzero(first), np.flatnonzero(last) + 1
    return starts, ends, np.searchsorted(offs, starts, side="right") - 1


def span_hashes(buf: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of the bytes of each non-empty, disjoint, ascending span."""
    if not len(starts):
        return np.zeros(0, dtype=np.uint64)
    lens = ends - starts
    so_far = np.cumsum(lens)
    out = np.empty(len(starts), dtype=np.uint64)
    i = 0
    while i < len(starts):
        before = so_far[i - 1] if i else 0
        j = max(i + 1, int(np.searchsorted(so_far, before + PIECE_BYTES, side="right")))
        own, first = lens[i:j], so_far[i:j] - lens[i:j] - before
        at = np.arange(so_far[j - 1] - before) - np.repeat(first, own)
        codes = BYTE_CODES[buf[at + np.repeat(starts[i:j], own)]] * powers(int(own.max()))[at]
        out[i:j] = mix(np.add.reduceat(codes, first) ^ (own.astype(np.uint64) * _U(0xD6E8FEB86659FD93)))
        i = j
    return out


def window_hashes(words: np.ndarray, rows: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all runs of `width` words inside one row, and the index of each run's first word."""
    n = len(words) - width + 1
    if n <= 0:
        return np.zeros(0, dtype=np.uint64), np.zeros(0, dtype=np.int64)
    at = np.flatnonzero(rows[:n] == rows[width - 1 :])
    h = np.zeros(len(at), dtype=np.uint64)
    for k in range(width):
        h = mix(h * _BASE + words[at + k])
    return h, at


def counts_by_row(rows: np.ndarray, n: int) -> np.ndarray:
    return np.bincount(rows, minlength=n).astype(np.int64)


def ragged(values: np.ndarray, counts: np.ndarray, kind: pa.DataType | None = None) -> pa.Array:
    """A list column from concatenated values and the length of each list."""
    offs = np.zeros(len(counts) + 1, dtype=np.int32)
    np.cumsum(counts, out=offs[1:])
    return pa.ListArray.from_arrays(pa.array(offs), values if isinstance(values, pa.Array) else pa.array(values, type=kind))

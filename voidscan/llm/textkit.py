"""Vectorised text kernels that the operators share.

Spark hands string columns to Python as Arrow buffers.  The kernels below work on those UTF-8 bytes with numpy, a bounded
number of bytes at a time, so the cost of a word is a few dozen machine instructions and no Python object is made for it.

A *word* is a maximal run of bytes other than blank, tab, LF, VT, FF and CR.  Hashes of spans come from prefix sums of a
polynomial modulo 2**64 with a random odd base, followed by a finaliser; every span of a chunk is hashed in O(1).
"""

from __future__ import annotations

import contextlib
import ctypes
import gc
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa

U = np.uint64
#: Bytes of text that are looked at together.  A longer document is a chunk of its own.
CHUNK_BYTES = 1 << 20

_rng = np.random.Generator(np.random.PCG64(20240229))
_BYTE = _rng.integers(0, 2**64, 256, dtype=np.uint64)
BLANK = np.zeros(256, bool)
BLANK[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[ord("A"): ord("Z") + 1] += 32
_BASE = int(0x9E3779B97F4A7C15)
_INVERSE = pow(_BASE, -1, 1 << 64)
_powers: dict[str, np.ndarray] = {}


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """base**i and base**-i for i < n, kept between calls up to a few chunks."""
    if "p" in _powers and len(_powers["p"]) >= n:
        return _powers["p"][:n], _powers["q"][:n]
    size = max(n, 2 * CHUNK_BYTES)
    up, down = np.full(size, _BASE, np.uint64), np.full(size, _INVERSE, np.uint64)
    up[0] = down[0] = 1
    up, down = np.cumprod(up, dtype=np.uint64), np.cumprod(down, dtype=np.uint64)
    if size <= 8 * CHUNK_BYTES:
        _powers.update(p=up, q=down)
    return up[:n], down[:n]


def mix(x: np.ndarray) -> np.ndarray:
    """Finaliser: a bijection of 64-bit values that spreads every bit (constants of splitmix64)."""
    x = x ^ (x >> U(30))
    x = x * U(0xBF58476D1CE4E5B9)
    x ^= x >> U(27)
    x *= U(0x94D049BB133111EB)
    return x ^ (x >> U(31))


class Spans:
    """Hashes of any span of a sequence of 64-bit codes, in O(1) each."""

    def __init__(self, codes: np.ndarray):
        up, self.down = powers(len(codes) + 1)
        self.sums = np.zeros(len(codes) + 1, np.uint64)
        np.cumsum(codes * up[: len(codes)], out=self.sums[1:])

    def hash(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        """Hash of codes[start:end]; spans of different lengths differ as well."""
        h = (self.sums[end] - self.sums[start]) * self.down[start]
        return mix(h + (end - start).astype(np.uint64) * U(0xD6E8FEB86659FD93))


@dataclass
class Chunk:
    """Rows lo..hi of a batch: their bytes, and where each row's bytes begin (one more entry than rows)."""

    lo: int
    hi: int
    data: np.ndarray
    starts: np.ndarray

    @property
    def rows(self) -> int:
        return self.hi - self.lo


def strings(column) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Bytes, offsets and validity of an Arrow string or binary column; null is an empty string."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if not (pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type) or pa.types.is_string(column.type) or pa.types.is_binary(column.type)):
        column = column.cast(pa.large_string())
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    _, offsets, data = column.buffers()
    offsets = np.frombuffer(offsets, np.int64 if wide else np.int32)[column.offset: column.offset + len(column) + 1].astype(np.int64) if offsets is not None and offsets.size else np.zeros(len(column) + 1, np.int64)
    data = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    valid = np.asarray(column.is_valid())
    return data, offsets, valid


def chunks(column, limit: int = CHUNK_BYTES) -> Iterator[Chunk]:
    """The rows of a column in pieces of about `limit` bytes; a longer row stands alone."""
    data, offsets, valid = strings(column)
    if not valid.all():  # the bytes under a null are undefined
        sizes = np.where(valid, np.diff(offsets), 0)
        if (sizes != np.diff(offsets)).any():
            data = np.concatenate([data[offsets[i]: offsets[i + 1]] for i in np.flatnonzero(valid)] or [data[:0]])
            offsets = np.concatenate([[0], np.cumsum(sizes)])
    lo, n = 0, len(offsets) - 1
    while lo < n:
        hi = int(np.searchsorted(offsets, offsets[lo] + limit, "right")) - 1
        hi = min(n, max(lo + 1, hi))
        yield Chunk(lo, hi, data[offsets[lo]: offsets[hi]], offsets[lo: hi + 1] - offsets[lo])
        lo = hi


@dataclass
class Words:
    """Where the words of a chunk begin and end, and which of them each row holds: first[r]..first[r + 1]."""

    start: np.ndarray
    end: np.ndarray
    first: np.ndarray
    hash: np.ndarray | None = None

    @property
    def row(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.first) - 1), np.diff(self.first))


def words(chunk: Chunk, hashed: bool = True, lower: bool = False, between: np.ndarray = BLANK) -> Words:
    """Words of a chunk; none spans two rows.  lower: A-Z count as a-z.  between: the bytes that separate words."""
    data = LOWER[chunk.data] if lower else chunk.data
    n = len(data)
    inside = ~between[data]
    cut = np.zeros(n + 1, bool)
    cut[chunk.starts] = True
    cut[n] = True
    begins = inside.copy()
    begins[1:] &= ~inside[:-1] | cut[1:n]
    ends = inside.copy()
    ends[:-1] &= ~inside[1:] | cut[1:n]
    start, end = np.flatnonzero(begins), np.flatnonzero(ends) + 1
    first = np.searchsorted(start, chunk.starts)
    w = Words(start, end, first)
    if hashed:
        w.hash = Spans(_BYTE[data]).hash(start, end)
    return w


def byte_codes(data: np.ndarray) -> np.ndarray:
    return _BYTE[data]


def grams(codes: np.ndarray, first: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all runs of k codes inside a row, in order, and their bounds by row as `first` has them for codes."""
    n = np.diff(first)
    many = np.maximum(n - k + 1, 0)
    bounds = np.concatenate([[0], np.cumsum(many)])
    if not len(codes) or not bounds[-1]:
        return np.zeros(0, np.uint64), bounds
    at = np.repeat(first[:-1] - bounds[:-1], many) + np.arange(bounds[-1])
    h = np.zeros(len(codes) - k + 1, np.uint64) if len(codes) >= k else np.zeros(0, np.uint64)
    for j in range(k):
        h = h * U(0xD1342543DE82EF95) + codes[j: len(codes) - k + 1 + j]
    return mix(h[at]), bounds


def points(data: np.ndarray) -> np.ndarray:
    """Code points before each byte (one more entry than bytes)."""
    out = np.zeros(len(data) + 1, np.int64)
    np.cumsum((data & 0xC0) != 0x80, out=out[1:])
    return out


def span_sums(values: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """Sums of values[bounds[i]:bounds[i + 1]]; 0 for empty rows."""
    total = np.concatenate([np.zeros(1, values.dtype if values.dtype.kind == "f" else np.int64), np.cumsum(values, dtype=None if values.dtype.kind == "f" else np.int64)])
    return total[bounds[1:]] - total[bounds[:-1]]


def covered(starts: np.ndarray, ends: np.ndarray, n: int) -> np.ndarray:
    """Which of n positions lie in any [start, end)."""
    edge = np.zeros(n + 1, np.int64)
    np.add.at(edge, starts, 1)
    np.subtract.at(edge, ends, 1)
    return np.cumsum(edge[:-1]) > 0


def joined(chunk: Chunk, w: Words, keep: np.ndarray) -> list[bytes]:
    """For each row the kept words joined by one blank, as UTF-8."""
    start, end = w.start[keep], w.end[keep]
    first = np.concatenate([[0], np.cumsum(keep)])[w.first]
    size = end - start + 1
    out_at = np.concatenate([[0], np.cumsum(size)])
    total = int(out_at[-1])
    src = np.repeat(start - out_at[:-1], size) + np.arange(total)
    text = np.full(total, 0x20, np.uint8)
    inside = np.ones(total, bool)
    inside[out_at[1:] - 1] = False
    text[inside] = chunk.data[src[inside]]
    whole = text.tobytes()
    return [whole[out_at[a]: max(out_at[a], out_at[b] - 1)] for a, b in zip(first[:-1], first[1:], strict=True)]


def column(batch: pa.RecordBatch, name: str):
    return batch.column(batch.schema.get_field_index(name))


def release() -> None:
    """Give memory that is free again back to the system, after work on the driver that needed much of it for a while."""
    gc.collect()
    with contextlib.suppress(OSError, AttributeError):
        ctypes.CDLL(None).malloc_trim(0)

"""Vectorised text kernels on Arrow buffers: words, hashes, windows.

A word is a run of bytes outside 0x20 and 0x09-0x0D. UTF-8 never uses those bytes inside
a longer character, so working on bytes gives the same words as working on characters.
"""

from __future__ import annotations

import ctypes
import functools
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa

#: Bytes handled at once; a longer document is handled alone.
SLAB = 1 << 20

_WS = np.zeros(256, bool)
_WS[[0x20, 9, 10, 11, 12, 13]] = True
_RNG = np.random.Generator(np.random.PCG64(20240229))
_CODE = _RNG.integers(0, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_CODE_LOWER = _CODE.copy()
_CODE_LOWER[65:91] = _CODE[97:123]
_BASE = np.uint64(0x9E3779B97F4A7C15 | 5)
_BASE_INV = np.uint64(pow(int(_BASE), -1, 1 << 64))
_STEP = np.uint64(0xD1342543DE82EF95)
_powers: dict[str, np.ndarray] = {}


def _power(which: str, n: int) -> np.ndarray:
    """which to the powers 0..n-1 modulo 2**64; only the common sizes are kept."""
    have = _powers.get(which)
    if have is None or len(have) < n:
        base = _BASE if which == "base" else _BASE_INV
        have = np.full(max(n, SLAB + 1), base)
        have[0] = 1
        have = np.multiply.accumulate(have)
        if n <= SLAB + 1:
            _powers[which] = have  # 8 MB
    return have


def release() -> None:
    """Give freed memory back to the system, so that an idle worker keeps little."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL("libc.so.6").malloc_trim(0)
    except (OSError, AttributeError):  # another C library
        return


def tidy(step: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """A mapInArrow function that releases what its task has freed."""

    @functools.wraps(step)
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from step(batches)
        finally:
            release()

    return run


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective scrambling of 64-bit values (the splitmix64 finaliser)."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def buffers(col: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """The bytes and the offsets of a string column; null counts as empty."""
    if isinstance(col, pa.ChunkedArray):
        col = col.combine_chunks() if col.num_chunks != 1 else col.chunk(0)
    if col.null_count:
        col = col.fill_null(b"" if pa.types.is_binary(col.type) or pa.types.is_large_binary(col.type) else "")
    wide = pa.types.is_large_string(col.type) or pa.types.is_large_binary(col.type)
    _, offs, data = col.buffers()
    if len(col) == 0 or offs is None:
        return np.zeros(0, np.uint8), np.zeros(len(col) + 1, np.int64)
    offs = np.frombuffer(offs, np.int64 if wide else np.int32)[col.offset : col.offset + len(col) + 1].astype(np.int64)
    if data is None:
        return np.zeros(0, np.uint8), np.zeros(len(col) + 1, np.int64)
    return np.frombuffer(data, np.uint8)[offs[0] : offs[-1]], offs - offs[0]


def slabs(offs: np.ndarray, limit: int = SLAB) -> Iterator[tuple[int, int]]:
    """Ranges of whole documents of up to limit bytes, or one longer document."""
    lo, n = 0, len(offs) - 1
    while lo < n:
        hi = max(lo + 1, int(np.searchsorted(offs, offs[lo] + limit, "right")) - 1)
        yield lo, min(hi, n)
        lo = min(hi, n)


def bounded(batches: Iterator[pa.RecordBatch], column: int, limit: int = 4 * SLAB) -> Iterator[pa.RecordBatch]:
    """The same rows in batches whose text column has up to limit bytes, or one longer text."""
    for batch in batches:
        _, offs = buffers(batch.column(column))
        for lo, hi in slabs(offs, limit):
            yield batch.slice(lo, hi - lo)


@dataclass
class Words:
    """The words of some documents: byte ranges, and words before each document."""

    start: np.ndarray
    end: np.ndarray
    first: np.ndarray  # of length documents + 1

    @property
    def count(self) -> np.ndarray:
        return np.diff(self.first)

    @property
    def doc(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.first) - 1), self.count)


#: Bytes outside ASCII letters, ASCII digits and non-ASCII characters.
PLAIN_BLANK = np.ones(256, bool)
PLAIN_BLANK[48:58] = PLAIN_BLANK[65:91] = PLAIN_BLANK[97:123] = PLAIN_BLANK[128:] = False


def find_words(data: np.ndarray, offs: np.ndarray, blank: np.ndarray = _WS) -> Words:
    ws = blank[data]
    start = ~ws
    end = start.copy()
    if len(data):
        start[1:] &= ws[:-1]
        end[:-1] &= ws[1:]
        inner = offs[1:-1]
        inner = inner[(inner > 0) & (inner < len(data))]
        start[inner] = ~ws[inner]
        end[inner - 1] = ~ws[inner - 1]
    s = np.flatnonzero(start)
    return Words(s, np.flatnonzero(end) + 1, np.searchsorted(s, offs))


def span_hash(data: np.ndarray, start: np.ndarray, end: np.ndarray, lower: bool = False) -> np.ndarray:
    """A 64-bit hash of each byte range (A-Z as a-z if lower)."""
    n = len(data)
    total = np.zeros(n + 1, np.uint64)
    np.cumsum((_CODE_LOWER if lower else _CODE)[data] * _power("base", n)[:n], out=total[1:])
    return mix((total[end] - total[start]) * _power("inverse", n)[start] + (end - start).astype(np.uint64) * _STEP)


def window_hash(words: np.ndarray, k: int, seed: int = 0) -> np.ndarray:
    """A 64-bit hash of words[i:i+k] for every i; windows over document ends are included."""
    n = len(words) - k + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    factor = np.uint64((0xC2B2AE3D27D4EB4F + 2 * seed * 0x632BE59BD9B4E019) & (2**64 - 1) | 1)
    acc = words[:n].copy()
    for j in range(1, k):
        acc *= factor
        acc += words[j : j + n]
    return mix(acc)


def window_starts(first: np.ndarray, k: int) -> np.ndarray:
    """The indices of words at which a window of k words of one document starts."""
    n = int(first[-1])
    ok = np.zeros(max(n, 1) + 1, np.int8)
    count = np.diff(first)
    some = count >= k
    np.add.at(ok, first[:-1][some], 1)
    np.add.at(ok, (first[1:] - k + 1)[some], -1)
    return np.flatnonzero(np.cumsum(ok[:n]) > 0)


def spread(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """starts[i], starts[i]+1, ... lengths[i] of each, one after another."""
    total = int(lengths.sum())
    if not total:
        return np.zeros(0, np.int64)
    before = np.cumsum(lengths) - lengths
    return np.repeat(starts - before, lengths) + np.arange(total)


def pack_binary(values: np.ndarray, bounds: np.ndarray) -> pa.Array:
    """A binary array whose items are slices of a numpy array."""
    raw = np.ascontiguousarray(values)
    offs = (np.asarray(bounds, np.int64) * raw.itemsize).astype(np.int64)
    if offs[-1] < 2**31 - 1:
        return pa.Array.from_buffers(pa.binary(), len(offs) - 1, [None, pa.py_buffer(offs.astype(np.int32)), pa.py_buffer(raw)])
    return pa.Array.from_buffers(pa.large_binary(), len(offs) - 1, [None, pa.py_buffer(offs), pa.py_buffer(raw)])

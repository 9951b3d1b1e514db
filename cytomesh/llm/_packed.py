"""Sorted 64-bit keys as compact bytes: differences, split into byte planes."""

from __future__ import annotations

import numpy as np


def pack_sorted(keys: np.ndarray) -> bytes:
    """Ascending unsigned 64-bit keys as bytes: the first byte says how many planes follow."""
    if not len(keys):
        return b"\0"
    steps = np.diff(keys, prepend=np.uint64(0)).astype("<u8")
    first, steps[0] = int(steps[0]), 0
    planes = max(1, (int(steps.max()).bit_length() + 7) // 8)
    return bytes([planes]) + first.to_bytes(8, "little") + steps.view(np.uint8).reshape(-1, 8)[:, :planes].T.tobytes()


def unpack_sorted(raw: bytes | memoryview) -> np.ndarray:
    planes = raw[0]
    if not planes:
        return np.zeros(0, np.uint64)
    body = np.frombuffer(raw, np.uint8, offset=9).reshape(planes, -1)
    steps = np.zeros((body.shape[1], 8), np.uint8)
    steps[:, :planes] = body.T
    out = steps.view("<u8").ravel()
    out[0] = int.from_bytes(raw[1:9], "little")
    return np.cumsum(out, dtype=np.uint64)


class Filter:
    """Quick membership in a set of 64-bit values: a bit table first, then a search."""

    def __init__(self, values: np.ndarray, bits: int = 22):
        self.values = np.unique(values)
        self.shift = np.uint64(64 - bits)
        self.seen = np.zeros(1 << bits, bool)
        self.seen[self._slot(self.values)] = True

    def _slot(self, values: np.ndarray) -> np.ndarray:
        return ((values * np.uint64(0x9E3779B97F4A7C15)) >> self.shift).astype(np.int64)

    def members(self, keys: np.ndarray) -> np.ndarray:
        """Indices of the keys that are in the set."""
        if not len(self.values) or not len(keys):
            return np.zeros(0, np.int64)
        maybe = np.flatnonzero(self.seen[self._slot(keys)])
        at = np.minimum(np.searchsorted(self.values, keys[maybe]), len(self.values) - 1)
        return maybe[self.values[at] == keys[maybe]]

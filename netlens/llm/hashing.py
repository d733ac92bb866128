"""Hashes of words and word sequences in numpy, over whole Arrow batches."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa

MULTIPLIER = np.uint64(0x9E3779B97F4A7C15)
INVERSE = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))
LENGTH = np.uint64(0xC2B2AE3D27D4EB4F)
_POWERS: dict[int, np.ndarray] = {}


def mix(h: np.ndarray) -> np.ndarray:
    """Spread the bits of 64-bit values (a bijection)."""
    h = h ^ (h >> np.uint64(32))
    h = h * np.uint64(0xD6E8FEB86659FD93)
    return h ^ (h >> np.uint64(32))


def powers(n: int, base: np.uint64 = MULTIPLIER) -> np.ndarray:
    """1, base, base squared, ... modulo 2^64; remembered up to the longest asked for."""
    known = _POWERS.get(int(base))
    if known is None or len(known) < n:
        known = np.full(max(n, 4096), base, dtype=np.uint64)
        known[0] = 1
        known = _POWERS[int(base)] = np.cumprod(known, dtype=np.uint64)
    return known[:n]


def grams(hashes: np.ndarray, n: int) -> np.ndarray:
    """Hash of each run of n values, in order."""
    m = max(0, len(hashes) - n + 1)
    out = np.full(m, np.uint64(n), dtype=np.uint64)
    for i in range(n):
        out = out * MULTIPLIER + hashes[i : i + m]
    return mix(out)


@dataclass(frozen=True)
class Words:
    """The words of the texts of a batch, one after another."""

    data: np.ndarray  # UTF-8 bytes of all texts
    start: np.ndarray  # of each word in the bytes
    end: np.ndarray
    first: np.ndarray  # first word of each text, and the number of words at the end
    hashes: np.ndarray

    def of(self) -> np.ndarray:
        """The text that each word belongs to."""
        return np.repeat(np.arange(len(self.first) - 1), np.diff(self.first))


def batch_words(texts: pa.Array, lower: bool = False) -> Words:
    """Words between ASCII white space of all texts; null has none. ``lower``: A to Z lowered."""
    texts = texts.cast(pa.string())
    n = len(texts)
    offsets = np.frombuffer(texts.buffers()[1], dtype=np.int32, count=n + 1 + texts.offset)[texts.offset :].astype(np.int64)
    size = int(offsets[-1] - offsets[0]) if n else 0
    buffer = texts.buffers()[2]
    data = np.frombuffer(buffer, dtype=np.uint8, count=size, offset=int(offsets[0])) if size and buffer is not None else np.zeros(0, np.uint8)
    offsets = offsets - offsets[0] if n else offsets
    if texts.null_count:  # the bytes under a null are whatever they are
        null = texts.is_null().to_numpy(zero_copy_only=False)
        if (np.diff(offsets)[null] > 0).any():
            return batch_words(pa.array(texts.to_pylist(), pa.string()), lower)
    empty = np.zeros(0, dtype=np.int64)
    if not len(data):
        return Words(data, empty, empty, np.zeros(n + 1, np.int64), empty.astype(np.uint64))
    if lower:
        data = np.where((data >= 65) & (data <= 90), data + np.uint8(32), data)
    space = (data == 32) | ((data >= 9) & (data <= 13))
    edge = np.zeros(len(data) + 1, dtype=bool)
    edge[offsets] = True
    word = ~space
    start = np.flatnonzero(word & (np.r_[True, space[:-1]] | edge[:-1]))
    end = np.flatnonzero(word & (np.r_[space[1:], True] | edge[1:])) + 1
    if not len(start):
        return Words(data, empty, empty, np.zeros(n + 1, np.int64), empty.astype(np.uint64))
    place = np.arange(start[0], len(data)) - np.repeat(start, np.diff(np.r_[start, len(data)]))
    value = (data[start[0] :].astype(np.uint64) + np.uint64(1)) * powers(int(place.max()) + 1)[place]
    value[space[start[0] :]] = 0
    sums = np.add.reduceat(value, start - start[0])
    hashes = mix(sums + (end - start).astype(np.uint64) * LENGTH)
    return Words(data, start, end, np.searchsorted(start, offsets), hashes)

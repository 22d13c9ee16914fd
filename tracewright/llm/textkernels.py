"""Numpy kernels over batches of whole texts.

A batch is laid out as one byte buffer in which every document ends in a line feed, so no word crosses a
document. Words are maximal runs of bytes outside ``[\\x20\\x09-\\x0D]``. Everything works on bounded chunks of
documents (`chunks`), so a task holds a few megabytes whatever the partition holds; a single text larger than a
chunk is a chunk of its own and is hashed in bounded blocks.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa

CHUNK_BYTES = 1 << 21
_BLOCK = 1 << 20
_ODD = np.uint64(0x9E3779B97F4A7C15)
_BASE = 0xD6E8FEB86659FD93
_M64 = (1 << 64) - 1

WHITE = np.zeros(256, bool)
WHITE[[9, 10, 11, 12, 13, 32]] = True
ASCII_LOWER = np.arange(256, dtype=np.uint8)
ASCII_LOWER[65:91] += 32


def mix(x: np.ndarray) -> np.ndarray:
    """The splitmix64 finaliser."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _powers(base: int, n: int) -> np.ndarray:
    out = np.full(n, np.uint64(base))
    out[0] = 1
    return np.multiply.accumulate(out)


_POW: list[np.ndarray] = []


def _pow(n: int) -> tuple[np.ndarray, np.ndarray]:
    if not _POW or len(_POW[0]) < n:
        size = max(n, _BLOCK + (1 << 16))
        _POW[:] = [_powers(_BASE, size), _powers(pow(_BASE, -1, 1 << 64), size)]
    return _POW[0], _POW[1]


def hash_ranges(buf: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit hashes of the byte ranges, which ascend and don't overlap."""
    out = np.empty(len(starts), np.uint64)
    i = 0
    while i < len(starts):
        j = max(i + 1, int(np.searchsorted(ends, starts[i] + _BLOCK, "right")))
        lo, hi = int(starts[i]), int(ends[j - 1])
        power, inverse = _pow(hi - lo + 1)
        sums = np.zeros(hi - lo + 1, np.uint64)
        np.cumsum((buf[lo:hi].astype(np.uint64) + np.uint64(1)) * power[: hi - lo], out=sums[1:])
        s, e = starts[i:j] - lo, ends[i:j] - lo
        out[i:j] = (sums[e] - sums[s]) * inverse[s] + (e - s).astype(np.uint64) * _ODD
        i = j
    return mix(out)


@dataclass
class Words:
    """Words of some documents: byte ranges in buf, and for each document the number of words before it."""

    buf: np.ndarray
    starts: np.ndarray
    ends: np.ndarray
    first: np.ndarray
    bounds: np.ndarray

    @property
    def counts(self) -> np.ndarray:
        return np.diff(self.first)

    @property
    def doc(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.first) - 1), self.counts)

    def hashes(self, lower: bool = False) -> np.ndarray:
        return hash_ranges(ASCII_LOWER[self.buf] if lower else self.buf, self.starts, self.ends)


def words_of(texts: list[bytes], white: np.ndarray = WHITE) -> Words:
    buf = np.frombuffer(b"\n".join(texts) + b"\n", np.uint8)
    solid = np.zeros(len(buf) + 1, np.int8)
    np.logical_not(white[buf], out=solid[1:], casting="unsafe")
    step = np.diff(solid)
    starts, ends = np.flatnonzero(step == 1), np.flatnonzero(step == -1)
    bounds = np.zeros(len(texts) + 1, np.int64)
    np.cumsum([len(t) + 1 for t in texts], out=bounds[1:])
    return Words(buf, starts, ends, np.searchsorted(starts, bounds), bounds)


def rolling(hashes: np.ndarray, n: int, seed: int) -> np.ndarray:
    """Hashes of n consecutive hashes each; the last n - 1 places have none."""
    if len(hashes) < n:
        return np.empty(0, np.uint64)
    out = np.zeros(len(hashes) - n + 1, np.uint64)
    factor = seed | 1
    for i in range(n):
        out += hashes[i : len(hashes) - n + 1 + i] * np.uint64(pow(factor, i + 1, 1 << 64))
    return mix(out)


def inside(first: np.ndarray, n: int, total: int) -> np.ndarray:
    """Which of the total - n + 1 windows of n words lie in one document."""
    ok = np.ones(max(0, total - n + 1), bool)
    if len(ok):
        at = (first[1:-1, None] - np.arange(1, n)[None, :]).ravel()
        ok[at[(at >= 0) & (at < len(ok))]] = False
    return ok


def texts_of(column: pa.Array) -> list[bytes]:
    """Whole texts as UTF-8; null counts as empty."""
    return [t or b"" for t in column.cast(pa.binary()).to_pylist()]


def chunks(texts: list[bytes], most: int = CHUNK_BYTES) -> Iterator[tuple[int, int]]:
    """Ranges of documents with about `most` bytes each."""
    return chunks_of_sizes([len(t) for t in texts], most)


def chunks_of_sizes(sizes: Sequence[int], most: int) -> Iterator[tuple[int, int]]:
    """Ranges of documents of these sizes with about `most` bytes each."""
    start = size = 0
    for i, n in enumerate(sizes):
        if size and size + n > most:
            yield start, i
            start, size = i, 0
        size += n + 1
    if start < len(sizes):
        yield start, len(sizes)


def signed(x: np.ndarray) -> np.ndarray:
    return x.view(np.int64)

"""Words and hashes of UTF-8 bytes, vectorised over a batch of texts.

A polynomial hash modulo 2^64 over a random value per byte; its prefix sums give the
hash of any stretch of bytes by one subtraction. Prefixes are kept for a slice of the
bytes at a time, so memory follows the slice and the number of words.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa

SLICE = 1 << 18
_random = np.random.default_rng(20_240_601)
BYTE = _random.integers(1, 2**63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
BASE = 0x9E3779B97F4A7C15 | 1
INVERSE = pow(BASE, -1, 1 << 64)
SPACE = np.zeros(256, bool)
SPACE[[0x20, *range(0x09, 0x0E)]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
PLACE = _random.integers(1, 2**63, 4096, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def _powers(base: int) -> np.ndarray:
    with np.errstate(over="ignore"):
        out = np.full(SLICE + 1, base, np.uint64)
        out[0] = 1
        return np.cumprod(out, dtype=np.uint64)


POWER, POWER_BACK = _powers(BASE), _powers(INVERSE)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection that spreads every bit."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def prefixes_at(data: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Prefix hash of ``data[:p]`` for each ``p`` of the ascending ``at``."""
    out = np.empty(len(at), np.uint64)
    carry = np.uint64(0)
    for first in range(0, len(data) + 1, SLICE):
        part = data[first : first + SLICE]
        scale = np.uint64(pow(BASE, first, 1 << 64))
        sums = np.empty(len(part) + 1, np.uint64)
        sums[0] = carry
        np.cumsum(BYTE[part] * POWER[: len(part)] * scale, out=sums[1:])
        sums[1:] += carry
        lo, hi = np.searchsorted(at, [first, first + SLICE])
        out[lo:hi] = sums[at[lo:hi] - first]
        carry = sums[-1]
    return out


def stretch_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Hash of each ``data[start:end]``; both ascending."""
    sums = prefixes_at(data, ends) - prefixes_at(data, starts)
    large = np.array([pow(INVERSE, i * SLICE, 1 << 64) for i in range(len(data) // SLICE + 1)], np.uint64)
    return mix(sums * POWER_BACK[starts % SLICE] * large[starts // SLICE] + (ends - starts).astype(np.uint64))


class Texts:
    """The bytes of a column of texts; null is empty."""

    def __init__(self, column: pa.Array):
        column = column.cast(pa.large_utf8())
        if column.null_count:
            column = column.fill_null("")
        n = len(column)
        _, offsets, data = column.buffers()
        offsets = np.frombuffer(offsets, np.int64)[column.offset : column.offset + n + 1] if n else np.zeros(1, np.int64)
        data = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
        self.data, self.offsets = data[offsets[0] : offsets[-1]], offsets - offsets[0]

    def __len__(self) -> int:
        return len(self.offsets) - 1

    def runs(self, n_bytes: int = 1 << 21):
        """(first, last) rows of about ``n_bytes`` together, at least one row each."""
        first = 0
        while first < len(self):
            last = int(np.searchsorted(self.offsets, self.offsets[first] + n_bytes, "right")) - 1
            last = max(first + 1, min(last, len(self)))
            yield first, last
            first = last

    def part(self, first: int, last: int) -> tuple[np.ndarray, np.ndarray]:
        offsets = self.offsets[first : last + 1]
        return self.data[offsets[0] : offsets[-1]], offsets - offsets[0]


def words(data: np.ndarray, offsets: np.ndarray, between: np.ndarray = SPACE) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(starts, ends, text) of the runs of other bytes than ``between``, none across two
    texts; by default the words ``[^\\x20\\x09-\\x0D]+``."""
    n = len(data)
    if n == 0:
        return (np.zeros(0, np.int64),) * 3
    space = between[data]
    before, after = np.ones(n, bool), np.ones(n, bool)
    before[1:], after[:-1] = space[:-1], space[1:]
    inner = offsets[(offsets > 0) & (offsets < n)]
    before[inner] = True
    after[inner - 1] = True
    starts = np.flatnonzero(~space & before)
    ends = np.flatnonzero(~space & after) + 1
    return starts, ends, np.searchsorted(offsets, starts, "right") - 1


def windows(hashes: np.ndarray, text: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """(hash, text) of the windows of ``size`` words within a text, by first word."""
    if len(hashes) < size:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    n = len(hashes) - size + 1
    total = np.zeros(n, np.uint64)
    for i in range(size):
        total += hashes[i : i + n] * PLACE[i]
    whole = text[:n] == text[size - 1 :]
    return mix(total)[whole], text[:n][whole]

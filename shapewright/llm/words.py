"""Words of Arrow text columns as numpy arrays: where they stand and 64-bit hashes of them."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

U = np.uint64
_STEP = U(0x9E3779B97F4A7C15)
_MIX1, _MIX2 = U(0xBF58476D1CE4E5B9), U(0x94D049BB133111EB)
_BASE = 0x100000001B3 | 0x5DEECE66D0001  # an odd number; hashes are taken modulo 2**64

_bytes = np.arange(256, dtype=np.uint8)
KEEP = _bytes.copy()
FOLD = np.where((_bytes >= 65) & (_bytes <= 90), _bytes + 32, _bytes).astype(np.uint8)
NOT_SPACE = ~np.isin(_bytes, [0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D])
#: after folding: digits, small letters and everything beyond ASCII
ALNUM = ((_bytes >= 0x30) & (_bytes <= 0x39)) | ((_bytes >= 0x61) & (_bytes <= 0x7A)) | (_bytes >= 0x80)

_powers = np.ones(1, dtype=U)


def mix(x: np.ndarray) -> np.ndarray:
    """Finaliser that spreads every input bit over all output bits; a bijection of 64-bit numbers."""
    x = x.astype(U, copy=True)
    x += _STEP
    x ^= x >> U(30)
    x *= _MIX1
    x ^= x >> U(27)
    x *= _MIX2
    x ^= x >> U(31)
    return x


def _power(n: int) -> np.ndarray:
    global _powers
    if len(_powers) < n:
        size = max(n, 2 * len(_powers))
        _powers = np.cumprod(np.concatenate([[U(1)], np.full(size - 1, _BASE, dtype=U)]), dtype=U)
    return _powers


@dataclass
class Words:
    """Words of a column. ``row``: the row of each; ``at``: words before each row, with the total at the end."""

    row: np.ndarray
    at: np.ndarray
    start: np.ndarray
    end: np.ndarray
    data: np.ndarray

    @property
    def counts(self) -> np.ndarray:
        return np.diff(self.at)

    def hashes(self) -> np.ndarray:
        """A 64-bit hash of each word's bytes."""
        if not len(self.start):
            return np.zeros(0, dtype=U)
        lengths = self.end - self.start
        first = np.concatenate([[0], np.cumsum(lengths)[:-1]])
        offset = np.arange(int(lengths.sum())) - np.repeat(first, lengths)
        value = self.data[offset + np.repeat(self.start, lengths)].astype(U) + U(1)
        value *= _power(int(lengths.max()))[offset]
        return mix(np.add.reduceat(value, first))

    def whole(self, k: int) -> np.ndarray:
        """Positions of the words with which a window of ``k`` words of one row starts."""
        if len(self.row) < k:
            return np.zeros(0, dtype=np.int64)
        return np.flatnonzero(self.row[: len(self.row) - k + 1] == self.row[k - 1 :])


def words_of(column: pa.Array, fold: bool, kind: np.ndarray) -> Words:
    """Maximal runs of bytes of ``kind``, by row, after lower-casing A-Z if ``fold``. Nulls count as empty.

    UTF-8 never uses bytes below 0x80 inside other characters, so classes that hold all or none of
    the bytes from 0x80 on can be looked up by byte.
    """
    column = pc.fill_null(column.cast(pa.large_string()), "")
    _, offsets, data = column.buffers()
    offsets = np.frombuffer(offsets, dtype=np.int64)[column.offset : column.offset + len(column) + 1]
    low, high = int(offsets[0]), int(offsets[-1])
    data = np.frombuffer(data, dtype=np.uint8)[low:high] if high > low else np.zeros(0, dtype=np.uint8)
    bounds = offsets - low
    data = (FOLD if fold else KEEP)[data]
    inside = kind[data]
    starts, ends = inside.copy(), inside.copy()
    starts[1:] &= ~inside[:-1]
    ends[:-1] &= ~inside[1:]
    cuts = bounds[1:-1]
    cuts = cuts[(cuts > 0) & (cuts < len(data))]
    starts[cuts] = inside[cuts]
    ends[cuts - 1] = inside[cuts - 1]
    start = np.flatnonzero(starts)
    end = np.flatnonzero(ends) + 1
    at = np.searchsorted(start, bounds).astype(np.int64)
    row = np.repeat(np.arange(len(column)), np.diff(at))
    return Words(row, at, start, end, data)


def windows(hashes: np.ndarray, starts: np.ndarray, k: int) -> np.ndarray:
    """64-bit hashes of the ``k`` consecutive words from each of ``starts`` on."""
    n = len(hashes) - k + 1
    if n <= 0 or not len(starts):
        return np.zeros(0, dtype=U)
    total = np.zeros(n, dtype=U)
    for j in range(k):
        total *= U(_BASE)
        total += hashes[j : j + n]
    return mix(total[starts])

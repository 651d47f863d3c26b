"""Vectorised helpers over the bytes of Arrow string columns (numpy inside tasks)."""

from __future__ import annotations

import ctypes
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

U = np.uint64
SLICE_BYTES = 1 << 20
_MULT = 0x9E3779B97F4A7C15 | 1
_INV = pow(_MULT, -1, 1 << 64)
_SYMBOLS = np.random.default_rng(20240229).integers(1, 1 << 63, 256, dtype=np.uint64) * U(2) + U(1)

LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
#: words of non-blank bytes; words of letters, digits and non-ASCII bytes
NON_BLANK = np.ones(256, bool)
NON_BLANK[[0x20, 9, 10, 11, 12, 13]] = False
ALNUM = np.zeros(256, bool)
ALNUM[48:58] = ALNUM[65:91] = ALNUM[97:123] = True
ALNUM[128:] = True


def slices(column: pa.Array, limit: int = SLICE_BYTES) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, end row, bytes, offsets) pieces of whole texts, about ``limit`` bytes each; null is empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = pc.fill_null(column.cast(pa.large_string()), "")
    n = len(column)
    if not n:
        return
    off = np.frombuffer(column.buffers()[1], np.int64)[column.offset:column.offset + n + 1]
    buf = column.buffers()[2]
    data = np.frombuffer(buf, np.uint8) if buf is not None else np.zeros(0, np.uint8)
    lo = 0
    while lo < n:
        hi = max(lo + 1, int(np.searchsorted(off, off[lo] + limit, side="right")) - 1)
        hi = min(hi, n)
        yield lo, hi, data[off[lo]:off[hi]], off[lo:hi + 1] - off[lo]
        lo = hi
    give_back()  # Python workers stay for later stages


#: what an operator keeps in a Python worker between its tasks, by operator
KEPT: dict[str, dict] = {}


def keep_only(name: str = "") -> None:
    """At the start of a task: what other operators keep in this worker goes."""
    others = [k for k in KEPT if k != name and KEPT[k]]
    for k in others:
        KEPT[k].clear()
    if others:
        give_back()


def give_back() -> None:
    """Return freed memory of Arrow and of the C library to the machine."""
    pa.default_memory_pool().release_unused()
    if _TRIM is not None:
        _TRIM(0)


try:
    _TRIM = ctypes.CDLL(None).malloc_trim
except (OSError, AttributeError):  # another C library
    _TRIM = None


def words(data: np.ndarray, off: np.ndarray, is_word: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start, end and row of every maximal run of word bytes; runs never cross texts."""
    n = len(data)
    if not n:
        z = np.zeros(0, np.int64)
        return z, z, z
    w = is_word[data]
    begin, last = w.copy(), w.copy()
    begin[1:] &= ~w[:-1]
    last[:-1] &= ~w[1:]
    edge = off[(off > 0) & (off < n)]
    begin[edge] = w[edge]
    last[edge - 1] = w[edge - 1]
    s = np.flatnonzero(begin)
    return s, np.flatnonzero(last) + 1, np.searchsorted(off, s, side="right") - 1


_POW = np.ones(1, np.uint64)
_IPOW = np.ones(1, np.uint64)


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    global _POW, _IPOW
    if len(_POW) < n:
        size = max(n, SLICE_BYTES + 1)
        up, down = np.full(size, U(_MULT)), np.full(size, U(_INV))
        up[0] = down[0] = U(1)
        _POW, _IPOW = np.multiply.accumulate(up), np.multiply.accumulate(down)
    return _POW, _IPOW


class Hasher:
    """Polynomial 64-bit hashes of any byte range of one slice, from one running sum."""

    def __init__(self, data: np.ndarray, lower: bool = True):
        up, self._down = _powers(len(data) + 1)
        self._sum = np.zeros(len(data) + 1, np.uint64)
        np.cumsum((_SYMBOLS[LOWER] if lower else _SYMBOLS)[data] * up[:len(data)], out=self._sum[1:])

    def ranges(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        return mix((self._sum[end] - self._sum[start]) * self._down[start])


def mix(x: np.ndarray) -> np.ndarray:
    """64-bit finaliser (bijective)."""
    x = x ^ (x >> U(32))
    x = x * U(0xD6E8FEB86659FD93)
    x = x ^ (x >> U(32))
    x = x * U(0xD6E8FEB86659FD93)
    return x ^ (x >> U(32))


def signed(x: np.ndarray) -> np.ndarray:
    return np.ascontiguousarray(x).view(np.int64)

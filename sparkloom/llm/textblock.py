"""Words of many texts at once: numpy over the bytes of an Arrow string column.

A block is a run of rows of an Arrow batch of up to about BLOCK_BYTES bytes (a longer text is a block of its own). Words
are maximal runs of non-separator bytes within one row; each gets a 64-bit hash of its folded bytes. Separators and the
folding are tables over single bytes, which is exact for UTF-8 when all separators and folded letters are ASCII.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa

from .common import release

BLOCK_BYTES = 1 << 20
_M = (1 << 64) - 1
_MULT = 0x9E3779B97F4A7C15 | 3  # odd, so that it has an inverse modulo 2^64
_INVERSE = pow(_MULT, -1, 1 << 64)


class Words(NamedTuple):
    start: np.ndarray  # byte offsets in the block
    end: np.ndarray
    hash: np.ndarray  # uint64
    first: np.ndarray  # index of the first word of each row, and the number of words at last


def mix(x: np.ndarray) -> np.ndarray:
    """Finalizer of splitmix64."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def byte_set(*ranges: tuple[int, int]) -> np.ndarray:
    table = np.zeros(256, bool)
    for a, b in ranges:
        table[a : b + 1] = True
    return table


ASCII_FOLD = np.arange(256, dtype=np.uint8)
ASCII_FOLD[65:91] += 32
#: Separators: ASCII white space.
SPACES = byte_set((9, 13), (32, 32))
#: Separators: all ASCII but digits and letters.
NOT_ALNUM = byte_set((0, 0x2F), (0x3A, 0x40), (0x5B, 0x60), (0x7B, 0x7F))

_byte_values = mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(0xD1342543DE82EF95))
_powers: dict[str, np.ndarray] = {}


def _power_tables(n: int) -> tuple[np.ndarray, np.ndarray]:
    if not _powers or len(_powers["up"]) < n:
        size = max(n, BLOCK_BYTES)
        for name, m in (("up", _MULT), ("down", _INVERSE)):
            full = np.full(size, m, np.uint64)
            full[0] = 1
            _powers[name] = np.multiply.accumulate(full)
    return _powers["up"][:n], _powers["down"][:n]


def blocks(column: pa.Array) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(first row, bytes, row offsets) of the blocks of a string column; null counts as empty."""
    release()
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.cast(pa.large_string())
    if column.null_count:
        column = column.fill_null("")
    n = len(column)
    if not n:
        return
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + n + 1]
    data = np.frombuffer(column.buffers()[2], np.uint8) if column.buffers()[2] is not None and column.buffers()[2].size else np.zeros(0, np.uint8)
    row = 0
    while row < n:
        to = max(row + 1, int(np.searchsorted(offsets, offsets[row] + BLOCK_BYTES, "right")) - 1)
        to = min(to, n)
        yield row, data[offsets[row] : offsets[to]], offsets[row : to + 1] - offsets[row]
        row = to


def words(data: np.ndarray, offsets: np.ndarray, separators: np.ndarray = SPACES, fold: np.ndarray = ASCII_FOLD) -> Words:
    n = len(data)
    if not n:
        none = np.zeros(0, np.int64)
        return Words(none, none, none.astype(np.uint64), np.zeros(len(offsets), np.int64))
    inside = ~separators[data]
    edge = np.zeros(n + 1, bool)  # a row begins here
    edge[offsets] = True
    begins = inside.copy()
    begins[1:] &= ~inside[:-1] | edge[1:n]
    ends = inside.copy()
    ends[:-1] &= ~inside[1:] | edge[1:n]
    start, end = np.flatnonzero(begins), np.flatnonzero(ends) + 1
    up, down = _power_tables(n)
    total = np.empty(n + 1, np.uint64)
    total[0] = 0
    np.cumsum(_byte_values[fold[data]] * up, out=total[1:])
    hashed = mix((total[end] - total[start]) * down[start] + (end - start).astype(np.uint64))
    return Words(start, end, hashed, np.searchsorted(start, offsets))


def window_hashes(hashed: np.ndarray, width: int) -> np.ndarray:
    """Hashes of all runs of width words."""
    n = len(hashed) - width + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    out = np.full(n, width, np.uint64)
    for k in range(width):
        out = mix(out * np.uint64(0x2545F4914F6CDD1D) + hashed[k : k + n])
    return out


def row_shingles(hashed: np.ndarray, width: int) -> np.ndarray:
    """Sorted distinct shingles of one text: runs of width words, or all words as one if there are fewer; none without words."""
    if not len(hashed):
        return np.zeros(0, np.uint64)
    return np.unique(window_hashes(hashed, min(width, len(hashed))))

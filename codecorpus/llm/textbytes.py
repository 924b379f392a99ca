"""Vectorised hashing of words and byte ranges in Arrow text columns.

Hashes are 64-bit: a range is a polynomial over a random table of byte values, taken from
prefix sums and finalised, so equal ranges have equal hashes wherever they stand. They serve as
identities of words, shingles and byte strings; n different ones collide with a probability
of about n * n / 2**65.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

U64 = np.uint64
_BASE = U64(0x9E3779B97F4A7C15)
_INVERSE = U64(pow(0x9E3779B97F4A7C15, -1, 2**64))
_TABLE = np.random.default_rng(20240607).integers(1, 2**63, 256, dtype=np.uint64) * U64(2) + U64(1)
SPACE = np.zeros(256, bool)
SPACE[[0x20, *range(0x09, 0x0E)]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
TILE = 1 << 18
_powers: list[np.ndarray] = []


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective finaliser of 64-bit values."""
    x = (x ^ (x >> U64(30))) * U64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U64(27))) * U64(0x94D049BB133111EB)
    return x ^ (x >> U64(31))


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """The first n powers of the base's inverse and of the base."""
    if not _powers or len(_powers[0]) < n:
        size = max(n, TILE + (TILE >> 3))
        _powers[:] = []
        for b in (_INVERSE, _BASE):
            p = np.full(size, b, U64)
            p[0] = 1
            _powers.append(np.cumprod(p, dtype=U64))
    return _powers[0][:n], _powers[1][:n]


def prefix_sums(data: np.ndarray, table: np.ndarray = _TABLE) -> np.ndarray:
    """S with S[0] = 0; range_hash takes any range's hash from it."""
    sums = np.zeros(len(data) + 1, U64)
    np.cumsum(table[data] * powers(len(data))[0], out=sums[1:])
    return sums


def range_hash(sums: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    return mix((sums[end] - sums[start]) * powers(len(sums))[1][start])


def texts_of(column: pa.Array | pa.ChunkedArray) -> tuple[memoryview, np.ndarray]:
    """A string or binary column's bytes and its len + 1 offsets; nulls are empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    raw = pa.types.is_binary(column.type) or pa.types.is_large_binary(column.type)
    column = column.cast(pa.large_binary() if raw else pa.large_string()).fill_null(b"" if raw else "")
    buffers = column.buffers()
    n = len(column)
    offsets = np.frombuffer(buffers[1], np.int64, n + 1, column.offset * 8) if n else np.zeros(1, np.int64)
    return memoryview(buffers[2] if buffers[2] is not None else b""), offsets


def blocks(offsets: np.ndarray, size: int = TILE) -> Iterator[tuple[int, int]]:
    """Consecutive row ranges of about `size` bytes; a longer row stands alone."""
    i, n = 0, len(offsets) - 1
    while i < n:
        j = max(i + 1, int(np.searchsorted(offsets, offsets[i] + size, "right")) - 1)
        yield i, min(j, n)
        i = min(j, n)


def _word_tile(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    word = ~SPACE[data]
    edge = np.flatnonzero(np.diff(word.view(np.int8), prepend=0, append=0))
    start, end = edge[::2], edge[1::2]
    return range_hash(prefix_sums(LOWER[data]), start, end), start


def words(view: memoryview, offsets: np.ndarray, i: int, j: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the words `[^\\x20\\x09-\\x0D]+`, A-Z in lower case, of rows i to j.

    Returns the hashes and j - i + 1 bounds: row k has words bounds[k] to bounds[k + 1].
    """
    data = np.frombuffer(b" ".join(view[offsets[k]:offsets[k + 1]] for k in range(i, j)), np.uint8)
    begins = offsets[i:j + 1] - offsets[i] + np.arange(j - i + 1)
    hashes, starts, at = [], [], 0
    while at < len(data):
        stop = at + TILE
        if stop < len(data):  # a tile ends before white space
            reach = 4096
            gap = np.flatnonzero(SPACE[data[stop:stop + reach]])
            while not len(gap) and stop + reach < len(data):
                reach *= 4
                gap = np.flatnonzero(SPACE[data[stop:stop + reach]])
            stop = stop + int(gap[0]) if len(gap) else len(data)
        h, s = _word_tile(data[at:stop])
        hashes.append(h)
        starts.append(s + at)
        at = stop
    if not hashes:
        return np.zeros(0, U64), np.zeros(j - i + 1, np.int64)
    start = np.concatenate(starts)
    return np.concatenate(hashes), np.searchsorted(start, begins)


def shingles(hashes: np.ndarray, width: int) -> np.ndarray:
    """Hashes of `width` consecutive words; the whole sequence if there are fewer; none of none."""
    if not len(hashes):
        return hashes
    width = min(width, len(hashes))
    n = len(hashes) - width + 1
    total = np.zeros(n, U64)
    for k in range(width):
        total = (total + hashes[k:k + n]) * _BASE
    return mix(total + U64(width))

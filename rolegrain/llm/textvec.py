"""Words and word hashes of a whole Arrow text column at once, with numpy.

Words are runs of bytes other than 0x20 and 0x09-0x0D; in UTF-8 none of these bytes occurs inside a
longer character, so the byte runs are the character runs. Hashes have 64 bits and two different words,
shingles or windows are taken to differ in them.
"""

from __future__ import annotations

import ctypes
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa

CHUNK_BYTES = 1 << 18
SPACE = np.zeros(256, bool)
SPACE[[0x20, 9, 10, 11, 12, 13]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32


def mix(x: np.ndarray) -> np.ndarray:
    """splitmix64's finalizer; changes x and returns it."""
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


BYTE_VALUE = mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))
BASE = 0x9E3779B97F4A7C15 | 1
INVERSE = pow(BASE, -1, 1 << 64)
COMBINE = mix(np.arange(1001, 1129, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)) | np.uint64(1)
_powers: dict[int, np.ndarray] = {}
trim = getattr(ctypes.CDLL(None), "malloc_trim", None)


def powers(base: int, n: int) -> np.ndarray:
    """base ** 0 .. base ** (n - 1) modulo 2 ** 64."""
    have = _powers.get(base)
    if have is None or len(have) < n:
        factors = np.full(max(n, 2 * CHUNK_BYTES), base, np.uint64)
        factors[0] = 1
        have = np.multiply.accumulate(factors)
        if n <= 8 * CHUNK_BYTES:
            _powers[base] = have
    return have[:n]


def give_back() -> None:
    """Memory that a batch is done with goes back to the machine: Arrow's, and what the C library keeps of numpy's."""
    pa.default_memory_pool().release_unused()
    if trim:
        trim(0)


class Words(NamedTuple):
    data: np.ndarray  # bytes of the chunk
    starts: np.ndarray  # first byte of each word
    ends: np.ndarray  # byte after each word
    bounds: np.ndarray  # row i of the chunk has the words bounds[i]:bounds[i + 1]


def text_chunks(column: pa.Array | pa.ChunkedArray, chunk_bytes: int = CHUNK_BYTES) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, last row + 1, bytes, offsets) of runs of rows with about chunk_bytes; a longer text is
    a run of its own. A null text counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.cast(pa.large_binary())
    if column.null_count:
        column = column.fill_null(b"")
    n = len(column)
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + n + 1]
    data = np.frombuffer(column.buffers()[2] or b"", np.uint8)
    lo = 0
    while lo < n:
        hi = max(lo + 1, int(np.searchsorted(offsets, offsets[lo] + chunk_bytes, "right")) - 1)
        yield lo, hi, data[offsets[lo] : offsets[hi]], offsets[lo : hi + 1] - offsets[lo]
        lo = hi
    give_back()


def words_of(data: np.ndarray, offsets: np.ndarray) -> Words:
    inside = ~SPACE[data]
    first, last = inside.copy(), inside.copy()
    first[1:] &= ~inside[:-1]
    last[:-1] &= ~inside[1:]
    at = offsets[:-1][offsets[:-1] < len(data)]
    first[at] = inside[at]
    at = offsets[1:][offsets[1:] > 0] - 1
    last[at] = inside[at]
    starts = np.flatnonzero(first)
    return Words(data, starts, np.flatnonzero(last) + 1, np.searchsorted(starts, offsets))


def word_hashes(words: Words) -> np.ndarray:
    """A 64-bit hash for each word: a polynomial in its bytes, then mixed."""
    data, starts, ends, _ = words
    if not len(starts):
        return np.zeros(0, np.uint64)
    total = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(BYTE_VALUE[data] * powers(BASE, len(data)), out=total[1:])
    h = (total[ends] - total[starts]) * powers(INVERSE, len(data))[starts]
    return mix(h + (ends - starts).astype(np.uint64) * COMBINE[0])


def gram_hashes(words: np.ndarray, k: int) -> np.ndarray:
    """Hash of each run of k word hashes, by its first position; also across rows, so mask those."""
    n = len(words) - k + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    h = np.zeros(n, np.uint64)
    for j in range(k):
        h += words[j : j + n] * COMBINE[j]
    return mix(h)


def whole_hash(words: np.ndarray) -> int:
    """Hash of a sequence shorter than a shingle; unlike that of any shingle."""
    return int(mix((words * COMBINE[64 : 64 + len(words)]).sum(keepdims=True) + COMBINE[127:128] * np.array([len(words)], np.uint64))[0])

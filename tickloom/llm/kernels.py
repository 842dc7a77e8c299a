"""Vectorised text kernels over the byte buffers of Arrow string columns.

Hashes are 64-bit and wrap; a polynomial prefix sum gives the hash of any byte range with two
look-ups, so words, n-grams and shingles of a whole batch come without a Python loop over them.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

BASE = np.uint64(0x9E3779B97F4A7C15 | 1)
INVERSE = np.uint64(pow(int(BASE), -1, 1 << 64))
_powers = [np.ones(1, np.uint64), np.ones(1, np.uint64)]

#: Bytes that belong to a word: ASCII letters and digits, and every byte of a non-ASCII character.
WORD = np.zeros(256, bool)
for _lo, _hi in ((48, 58), (65, 91), (97, 123), (128, 256)):
    WORD[_lo:_hi] = True
SLICE_BYTES = 1 << 20


def text_buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of a string column; nulls are empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if not pa.types.is_large_string(column.type):
        column = column.cast(pa.large_string())
    if column.null_count:
        column = column.fill_null("")
    _, offsets, data = column.buffers()
    off = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1] if len(column) else np.zeros(1, np.int64)
    buf = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return buf[off[0] : off[-1]], off - off[0]


def slices(off: np.ndarray, most: int = SLICE_BYTES) -> Iterator[tuple[int, int]]:
    """Ranges of rows with about ``most`` bytes each; a longer row has a range of its own."""
    i, n = 0, len(off) - 1
    while i < n:
        j = max(i + 1, int(np.searchsorted(off, off[i] + most, "right")) - 1)
        yield i, j
        i = j


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """BASE ** i and BASE ** -i for i < n."""
    if len(_powers[0]) < n:
        size = 1 << max(16, int(n - 1).bit_length())
        for k, b in enumerate((BASE, INVERSE)):
            steps = np.full(size, b, np.uint64)
            steps[0] = 1
            _powers[k] = np.cumprod(steps, dtype=np.uint64)
    return _powers[0][:n], _powers[1][:n]


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: every input bit reaches every output bit."""
    x = x ^ (x >> np.uint64(33))
    x = x * np.uint64(0xFF51AFD7ED558CCD)
    x ^= x >> np.uint64(33)
    x *= np.uint64(0xC4CEB9FE1A85EC53)
    x ^= x >> np.uint64(33)
    return x


def prefix_sums(codes: np.ndarray) -> np.ndarray:
    """S with S[j] - S[i] = sum of (codes[t] + 1) * BASE ** t over i <= t < j."""
    out = np.zeros(len(codes) + 1, np.uint64)
    if len(codes):
        np.cumsum((codes.astype(np.uint64) + np.uint64(1)) * powers(len(codes))[0], out=out[1:])
    return out


def range_hashes(sums: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """A hash of each range of codes that doesn't depend on where the range stands."""
    if not len(start):
        return np.zeros(0, np.uint64)
    inverse = powers(len(sums))[1]
    return mix((sums[end] - sums[start]) * inverse[start] + (end - start).astype(np.uint64))


def wide(a: np.ndarray, b: np.ndarray) -> pa.Array:
    """Pairs of 64-bit hashes as binary values of 16 bytes."""
    data = np.stack([a, b], 1).astype(">u8")
    at = np.arange(len(a) + 1, dtype=np.int32) * 16
    return pa.Array.from_buffers(pa.binary(), len(a), [None, pa.py_buffer(at.tobytes()), pa.py_buffer(data.tobytes())])


def word_spans(buf: np.ndarray, off: np.ndarray, table: np.ndarray = WORD) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(start, end, row) of the maximal runs of word bytes; no run crosses a row."""
    n = len(buf)
    inside = np.zeros(n + 2, bool)
    inside[1 : n + 1] = table[buf]
    cut = off[1:-1]
    cut = cut[(cut > 0) & (cut < n)]
    begins = inside[1:] & ~inside[:-1]
    ends = inside[:-1] & ~inside[1:]
    joined = cut[inside[cut] & inside[cut + 1]]  # a run that goes on over the row's end
    begins[joined] = True
    ends[joined] = True
    start, end = np.flatnonzero(begins[: n + 1]), np.flatnonzero(ends[: n + 1])
    row = np.searchsorted(off, start, "right") - 1
    return start, end, row


def word_hashes(buf: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(hash, row) of every word of every row, in order."""
    start, end, row = word_spans(buf, off)
    return range_hashes(prefix_sums(buf), start, end), row


def row_bounds(row: np.ndarray, n: int) -> np.ndarray:
    """Where each of n rows starts in a sorted array of row numbers."""
    return np.searchsorted(row, np.arange(n + 1))


GRAM = [np.uint64(x | 1) for x in (0x8CB92BA72F3D8DD7, 0xD1B54A32D192ED03, 0xAEF17502108EF2D9, 0xDB4F0B9175AE2165, 0xBBE0563303A4615F, 0xA0F2EC75A1FE1575, 0x89E182857D9ED689, 0xF1357AEA2E62A9C5)]


def ngrams(words: np.ndarray, n: int) -> np.ndarray:
    """Hashes of the word n-grams of one row; fewer than n words make one gram, none make none."""
    if not len(words):
        return words
    n = min(n, len(words))
    size = len(words) - n + 1
    acc = np.full(size, n, np.uint64)
    for k in range(n):
        acc += words[k : k + size] * GRAM[k]
    return mix(acc)

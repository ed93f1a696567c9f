"""Words of many texts at once: boundaries and 64-bit hashes from an Arrow buffer, in numpy.

A word is a run of bytes other than ASCII white space; A-Z count as a-z. The hash of a
word is a polynomial over its bytes, taken from running sums as Karp and Rabin do, so no
word becomes a Python object.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

SLICE_BYTES = 2 << 20

_U = np.uint64
_BASE = 0x9E3779B97F4A7C15 | 1
_BASE_INVERSE = pow(_BASE, -1, 1 << 64)
_STEP = 0xD6E8FEB86659FD93 | 1

LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
SPACE = np.zeros(256, bool)
SPACE[[0x20, *range(0x09, 0x0E)]] = True


def mix(x: np.ndarray) -> np.ndarray:
    """Spreads every input bit over all 64 output bits."""
    x = (x ^ (x >> _U(30))) * _U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> _U(27))) * _U(0x94D049BB133111EB)
    return x ^ (x >> _U(31))


_BYTE = mix(np.arange(1, 257, dtype=np.uint64) * _U(_BASE))
_powers: dict[int, np.ndarray] = {}


def powers(base: int, n: int) -> np.ndarray:
    """base ** i modulo 2 ** 64 for i below ``n``, kept per process."""
    have = _powers.get(base)
    if have is None or len(have) < n:
        with np.errstate(over="ignore"):
            have = np.cumprod(np.r_[_U(1), np.full(max(n, SLICE_BYTES) - 1, base, np.uint64)])
        if n <= 2 * SLICE_BYTES:
            _powers[base] = have
    return have[:n]


def text_slices(column: pa.Array, most: int = SLICE_BYTES) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(first row, bytes, offsets) for runs of rows of about ``most`` bytes; null is empty.

    A longer text is a run of its own.
    """
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    column = column.cast(pa.large_string()).fill_null("")
    _, offsets, data = column.buffers()
    ends = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1]
    data = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    row = 0
    while row < len(column):
        stop = max(row + 1, int(np.searchsorted(ends, ends[row] + most, "right")) - 1)
        yield row, data[ends[row] : ends[stop]], ends[row : stop + 1] - ends[row]
        row = stop


def word_spans(data: np.ndarray, offsets: np.ndarray, space: np.ndarray = SPACE) -> tuple[np.ndarray, np.ndarray]:
    """Byte positions where words start and end; no word goes over a text's end."""
    if not len(data):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    inside = ~space[data]
    edge = np.zeros(len(data) + 1, bool)
    edge[offsets] = True
    before = np.r_[False, inside[:-1]] & ~edge[:-1]
    after = np.r_[inside[1:], False] & ~edge[1:]
    return np.flatnonzero(inside & ~before), np.flatnonzero(inside & ~after) + 1


def word_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit hash of each span, the same wherever the word stands."""
    if not len(starts):
        return np.zeros(0, np.uint64)
    with np.errstate(over="ignore"):
        sums = np.cumsum(_BYTE[LOWER[data]] * powers(_BASE, len(data)))
        total = sums[ends - 1] - np.where(starts > 0, sums[starts - 1], _U(0))
        return mix(total * powers(_BASE_INVERSE, len(data))[starts] + (ends - starts).astype(np.uint64))


def shingles(hashes: np.ndarray, size: int) -> np.ndarray:
    """Hash of each run of ``size`` words; of the whole sequence if it is shorter."""
    n = len(hashes)
    if not n:
        return hashes
    width = min(size, n)
    step = powers(_STEP, size)
    with np.errstate(over="ignore"):
        total = np.full(n - width + 1, width, np.uint64)
        for i in range(width):
            total = total + hashes[i : n - width + 1 + i] * step[i]
        return mix(total)


def texts_of_words(column: pa.Array, size: int) -> Iterator[tuple[int, int, np.ndarray]]:
    """(row, words, sorted distinct shingle hashes) of every text."""
    for row, data, offsets in text_slices(column):
        starts, ends = word_spans(data, offsets)
        hashes = word_hashes(data, starts, ends)
        cuts = np.searchsorted(starts, offsets)
        for i in range(len(offsets) - 1):
            own = hashes[cuts[i] : cuts[i + 1]]
            yield row + i, len(own), np.unique(shingles(own, size))

"""Whole texts of an Arrow column as numpy arrays: words, hashes of windows, window minima.

Texts are read straight from the Arrow buffers as UTF-8 bytes. Hashes are
polynomials over random 64-bit values modulo 2**64, so the hash of any run of
values is a difference of two prefix sums.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Bytes of text that are worked on at once; a longer document comes alone.
SLICE_BYTES = 4 << 20

#: The multiplier of the polynomials: odd, and 3 modulo 4, so that 1 - BASE is divisible by 2 once only.
BASE = 0x9E3779B97F4A7C17 | 3
_MASK = (1 << 64) - 1
_INVERSE = pow(BASE, -1, 1 << 64)

#: The white space that separates words: space and tab to carriage return.
WHITE = np.zeros(256, bool)
WHITE[[0x20, *range(0x09, 0x0E)]] = True

#: A-Z as a-z, all other bytes as they are.
LOWER = np.arange(256, dtype=np.uint8)
LOWER[ord("A") : ord("Z") + 1] += 32


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values that spreads every bit."""
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


_VALUES = mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(0xD1342543DE82EF95))


@lru_cache(maxsize=8)
def _powers(base: int, n: int) -> np.ndarray:
    out = np.full(n, base, np.uint64)
    out[:1] = 1
    return np.cumprod(out, dtype=np.uint64)


def powers(base: int, n: int) -> np.ndarray:
    """base ** 0 .. base ** (n - 1) modulo 2**64."""
    return _powers(base, 1 << max(10, int(n - 1).bit_length()))[:n]


def prefix_sums(values: np.ndarray) -> np.ndarray:
    """S with S[e] - S[s] = the polynomial of values[s:e], times BASE ** s."""
    out = np.zeros(len(values) + 1, np.uint64)
    np.cumsum(values * powers(BASE, len(values)), out=out[1:])
    return out


def run_hash(sums: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Hashes of the runs start:end; equal runs have equal hashes wherever they start."""
    shift = powers(_INVERSE, len(sums))
    return (sums[end] - sums[start]) * shift[start]


def byte_sums(data: np.ndarray) -> np.ndarray:
    return prefix_sums(_VALUES[data])


def gram_hash(values: np.ndarray, k: int) -> np.ndarray:
    """Mixed hash of every k consecutive values."""
    if len(values) < k:
        return np.empty(0, np.uint64)
    n = len(values)
    out, length = values, 1
    for bit in bin(k)[3:]:
        step = np.uint64(pow(BASE, length, 1 << 64))
        out = out[: len(out) - length] * step + out[length:]
        length *= 2
        if bit == "1":
            out = out[: len(out) - 1] * np.uint64(BASE) + values[length:]
            length += 1
    return mix(out[: n - k + 1])


def byte_values(data: np.ndarray) -> np.ndarray:
    return _VALUES[data]


def window_minima(values: np.ndarray, width: int) -> np.ndarray:
    """For every window of ``width`` values the place of its leftmost smallest, by the upper half of the values."""
    if len(values) < width:
        return np.empty(0, np.int64)
    # The place stands in the lower half, so one minimum finds value and place.
    best = (values & np.uint64(0xFFFFFFFF00000000)) | np.arange(len(values), dtype=np.uint64)
    length = 1
    while length < width:
        s = min(length, width - length)
        best = np.minimum(best[s:], best[: len(best) - s])
        length += s
    return (best & np.uint64(0xFFFFFFFF)).astype(np.int64)


def slices(column: pa.Array, limit: int = SLICE_BYTES) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(first row, bytes, offsets) of runs of rows with about ``limit`` bytes; null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = pc.fill_null(column.cast(pa.large_string()), "")
    if not len(column):
        return
    _, offsets, data = column.buffers()
    offsets = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1]
    data = np.frombuffer(data or b"", np.uint8)
    row = 0
    while row < len(column):
        end = max(row + 1, int(np.searchsorted(offsets, offsets[row] + limit, "right")) - 1)
        end = min(end, len(column))
        yield row, data[offsets[row] : offsets[end]], offsets[row : end + 1] - offsets[row]
        row = end


def word_bounds(
    data: np.ndarray, offsets: np.ndarray, separator: np.ndarray = WHITE
) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of all words, and for each document the number of words before it."""
    apart = separator[data]
    before = np.ones(len(data), bool)
    before[1:] = apart[:-1]
    after = np.ones(len(data), bool)
    after[:-1] = apart[1:]
    edges = offsets[(offsets > 0) & (offsets < len(data))]
    before[edges] = True
    after[edges - 1] = True
    starts = np.flatnonzero(~apart & before)
    return starts, np.flatnonzero(~apart & after) + 1, np.searchsorted(starts, offsets)


def word_hashes(
    data: np.ndarray, starts: np.ndarray, ends: np.ndarray, fold: np.ndarray | None = None, limit: int = SLICE_BYTES
) -> np.ndarray:
    """A 64-bit hash of each word; long texts are hashed in pieces of about ``limit`` bytes."""
    hashes = np.empty(len(starts), np.uint64)
    first = 0
    while first < len(starts):
        last = max(first + 1, int(np.searchsorted(ends, starts[first] + limit, "right")))
        part = data[starts[first] : ends[last - 1]]
        sums = byte_sums(part if fold is None else fold[part])
        s, e = starts[first:last] - starts[first], ends[first:last] - starts[first]
        hashes[first:last] = mix(run_hash(sums, s, e) + (e - s).astype(np.uint64))
        first = last
    return hashes


def document_words(
    column: pa.Array, separator: np.ndarray = WHITE, fold: np.ndarray | None = None, limit: int = 1 << 18
) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """Per row: (row, its bytes, word starts, word ends, 64-bit hash of each word)."""
    for row, data, offsets in slices(column, limit):
        starts, ends, counts = word_bounds(data, offsets, separator)
        hashes = word_hashes(data, starts, ends, fold)
        for i in range(len(offsets) - 1):
            a, b = counts[i], counts[i + 1]
            yield (
                row + i,
                data[offsets[i] : offsets[i + 1]],
                starts[a:b] - offsets[i],
                ends[a:b] - offsets[i],
                hashes[a:b],
            )

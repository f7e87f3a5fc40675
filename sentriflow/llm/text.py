"""Vectorised hashing of Arrow text columns: slices of bounded size, words and rolling hashes.

A polynomial hash over a slice is kept as prefix sums modulo 2**64; multiplying by the inverse power of the (odd) base
moves any window to the same origin, so hashes of words and k-grams need no loop.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash

#: Texts are worked on in slices of about so many bytes; a longer text is a slice of its own.
SLICE_BYTES = 1 << 20

U = np.uint64
_BASE = 0x9E3779B97F4A7C15 | 1
_powers: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijective scrambling of 64-bit integers."""
    x = (x ^ (x >> U(30))) * U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U(27))) * U(0x94D049BB133111EB)
    return x ^ (x >> U(31))


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """base**i and base**-i modulo 2**64 for i up to n."""
    size = 1 << max(20, int(n).bit_length())
    if size not in _powers:
        found = []
        for base in (_BASE, pow(_BASE, -1, 1 << 64)):
            p = np.full(size + 1, base, U)
            p[0] = 1
            found.append(np.cumprod(p, dtype=U))
        if size > 1 << 20:  # not kept: only very long texts need them
            return found[0], found[1]
        _powers[size] = (found[0], found[1])
    return _powers[size]


def prefix_hashes(data: np.ndarray) -> np.ndarray:
    """P with P[j] - P[i] = sum of (byte + 1) * base**position over i <= position < j."""
    out = np.zeros(len(data) + 1, U)
    np.cumsum((data.astype(U) + U(1)) * powers(len(data))[0][: len(data)], out=out[1:])
    return out


def window_hashes(prefix: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    return mix64((prefix[end] - prefix[start]) * powers(len(prefix))[1][start] + (end - start).astype(U))


def utf8_column(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and offsets of a text column; null is empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.fill_null("").cast(pa.large_string())
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
    data = column.buffers()[2]
    data = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return data, offsets


def slices(column: pa.Array, limit: int = SLICE_BYTES) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, end row, bytes, offsets from 0) for runs of rows of about `limit` bytes together."""
    data, offsets = utf8_column(column)
    first, n = 0, len(column)
    while first < n:
        end = max(first + 1, int(np.searchsorted(offsets, offsets[first] + limit, "right")) - 1)
        end = min(end, n)
        yield first, end, data[offsets[first] : offsets[end]], offsets[first : end + 1] - offsets[first]
        first = end


_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_IS_WORD = np.ones(256, bool)
_IS_WORD[[32, 9, 10, 11, 12, 13]] = False


def words(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of the words [^\\x20\\x09-\\x0D]+, and the first word of each row with a last entry for the end.

    No word crosses a row.
    """
    inside = _IS_WORD[data]
    before = np.zeros(len(data), bool)
    before[1:] = inside[:-1]
    cut = offsets[:-1][offsets[:-1] < len(data)]
    before[cut] = False
    starts = np.flatnonzero(inside & ~before)
    after = np.zeros(len(data), bool)
    after[:-1] = inside[1:]
    ends_at = offsets[1:][offsets[1:] > 0] - 1
    after[ends_at] = False
    ends = np.flatnonzero(inside & ~after) + 1
    return starts, ends, np.searchsorted(starts, offsets)


def lower_ascii(data: np.ndarray) -> np.ndarray:
    return _LOWER[data]


def word_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    return window_hashes(prefix_hashes(data), starts, ends)


def _packed_bytes(data: np.ndarray, at: np.ndarray, size: np.ndarray) -> np.ndarray:
    """The first 8 bytes at each place, of which `size` count (none below 1), as numbers; `data` has 8 bytes more at its end."""
    eight = np.ndarray((len(data) - 7,), np.dtype("<u8"), data, strides=(1,))[np.minimum(at, len(data) - 8)]
    gone = (U(64) - U(8) * np.clip(size, 1, 8).astype(U))
    return np.where(size > 0, (eight << gone) >> gone, U(0))


def exact_word_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit hashes of words that no algebra of long words makes equal: up to 16 bytes two numbers are scrambled one after the other, longer ones go through XXH3."""
    size = ends - starts
    padded = np.concatenate((data, np.zeros(16, np.uint8)))
    low, high = _packed_bytes(padded, starts, size), _packed_bytes(padded, starts + 8, size - 8)
    out = mix64(mix64(low + size.astype(U) * U(0x9E3779B97F4A7C15)) + high * U(0xC2B2AE3D27D4EB4F))
    for i in np.flatnonzero(size > 16):
        out[i] = xxhash.xxh3_64_intdigest(data[starts[i] : ends[i]])
    return out

"""Words of many texts at once, as NumPy arrays over the UTF-8 bytes of an Arrow column."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Texts are handled some bytes at a time, so that temporary arrays stay small; one longer text is one piece.
PIECE_BYTES = 1 << 20

_WHITE = np.zeros(256, dtype=bool)
_WHITE[[0x20, *range(0x09, 0x0E)]] = True
_M1, _M2, _BASE = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB), 0x9E3779B97F4A7C55 | 1
_POWERS = np.ones(1, dtype=np.uint64)


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads every bit."""
    x = x ^ (x >> np.uint64(30))
    x = x * _M1
    x = x ^ (x >> np.uint64(27))
    x = x * _M2
    return x ^ (x >> np.uint64(31))


def utf8(column: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of a string column; a null is an empty text."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks() if column.num_chunks != 1 else column.chunk(0)
    if isinstance(column, pa.ChunkedArray):
        column = pa.concat_arrays(column.chunks) if column.num_chunks else pa.array([], column.type)
    if column.null_count:
        column = pc.fill_null(column, "")
    column = column.cast(pa.large_string()) if not pa.types.is_large_string(column.type) else column
    n = len(column)
    if not n:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, at, data = column.buffers()
    offsets = np.frombuffer(at, np.int64)[column.offset : column.offset + n + 1]
    raw = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return raw[offsets[0] : offsets[-1]], offsets - offsets[0]


def pieces(data: np.ndarray, offsets: np.ndarray, most: int = PIECE_BYTES) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first text, text after the last, their bytes, their offsets) for runs of texts of about ``most`` bytes."""
    i, n = 0, len(offsets) - 1
    while i < n:
        j = max(i + 1, int(np.searchsorted(offsets, offsets[i] + most, "right")) - 1)
        yield i, j, data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i]
        i = j


def spans(inside: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(starts, ends, text) of the longest runs of true bytes, none of which crosses from a text to the next."""
    n = len(inside)
    if not n:
        z = np.zeros(0, np.int64)
        return z, z, z
    first = np.zeros(n + 1, dtype=bool)
    first[offsets] = True
    before = np.empty(n, dtype=bool)
    before[0], before[1:] = False, inside[:-1]
    after = np.empty(n, dtype=bool)
    after[-1], after[:-1] = False, inside[1:]
    starts = np.flatnonzero(inside & (~before | first[:-1]))
    ends = np.flatnonzero(inside & (~after | first[1:])) + 1
    return starts, ends, np.searchsorted(offsets, starts, "right") - 1


def words(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    return spans(~_WHITE[data], offsets)


def _bytes_of_words(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(sizes, first byte of each word among all words' bytes, place of each byte in its word, byte + 1)."""
    size = ends - starts
    first = np.zeros(len(size), np.int64)
    np.cumsum(size[:-1], out=first[1:])
    within = np.arange(int(size.sum()), dtype=np.int64) - np.repeat(first, size)
    return size, first, within, data[within + np.repeat(starts, size)].astype(np.uint64) + np.uint64(1)


def word_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of the bytes of each word: a polynomial in an odd base modulo 2^64, then mixed with the length."""
    global _POWERS
    if not len(starts):
        return np.zeros(0, np.uint64)
    size, first, within, value = _bytes_of_words(data, starts, ends)
    while len(_POWERS) < size.max():
        _POWERS = np.concatenate([_POWERS, _POWERS * np.uint64(pow(_BASE, len(_POWERS), 1 << 64))])
    return mix64(np.add.reduceat(value * _POWERS[within], first) + size.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))


def word_marks(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Another 64-bit hash of each word, by another rule: the sum of its bytes, each mixed with its place.

    Words whose polynomials collide (there are such for any base) do not collide here for that reason.
    """
    if not len(starts):
        return np.zeros(0, np.uint64)
    size, first, within, value = _bytes_of_words(data, starts, ends)
    return mix64(np.add.reduceat(mix64(value * _M1 + within.astype(np.uint64) * _M2), first) + size.astype(np.uint64))

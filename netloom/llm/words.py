"""Vectorised word and shingle hashing over Arrow text columns.

Works on the raw UTF-8 buffer of a batch: word spans come from a byte mask, word
hashes from one prefix sum of byte codes weighted by powers of an odd base
(modulo 2**64), so no Python object is made for a word.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

#: White space of the word rule ``[^\x20\x09-\x0D]+``.
SPACE = np.zeros(256, bool)
SPACE[[0x20, *range(0x09, 0x0E)]] = True
#: Lower-cases A-Z and nothing else.
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32

CHUNK_BYTES = 1 << 20
_BASE = np.uint64(0x9E3779B97F4A7C15)
_INVERSE = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))
_powers = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def mix(x: np.ndarray, seed: int = 0) -> np.ndarray:
    """A bijective 64-bit finaliser (xor-shift-multiply), keyed by ``seed``."""
    x = x + np.uint64((0x9E3779B97F4A7C15 * (seed + 1)) & 0xFFFFFFFFFFFFFFFF)
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


_CODES = mix(np.arange(256, dtype=np.uint64), 77)


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    if len(_powers[0]) < n:
        m = max(n, 1 << 16)
        for k, base in enumerate((_BASE, _INVERSE)):
            p = np.full(m, base, np.uint64)
            p[0] = 1
            _powers[k] = np.multiply.accumulate(p)
    return _powers[0], _powers[1]


def span_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each byte span; equal bytes give equal hashes."""
    power, inverse = powers(len(data) + 1)
    total = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(_CODES[data] * power[: len(data)], out=total[1:])
    return mix((total[ends] - total[starts]) * inverse[starts] + (ends - starts).astype(np.uint64))


def text_buffer(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of a string column; nulls count as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.fill_null("") if column.null_count else column
    wide = pa.types.is_large_string(column.type)
    _, offsets, data = column.buffers()
    kind = np.int64 if wide else np.int32
    at = np.frombuffer(offsets, kind, len(column) + 1, column.offset * np.dtype(kind).itemsize).astype(np.int64)
    raw = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return raw[at[0] : at[-1]], at - at[0]


def chunks(column: pa.Array, most: int = CHUNK_BYTES) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, end row, bytes, offsets): whole texts, about ``most`` bytes at a time.

    A longer text is a chunk of its own.
    """
    data, at = text_buffer(column)
    row, n = 0, len(at) - 1
    while row < n:
        end = max(row + 1, int(np.searchsorted(at, at[row] + most, "right")) - 1)
        yield row, end, data[at[row] : at[end]], at[row : end + 1] - at[row]
        row = end


def word_spans(data: np.ndarray, at: np.ndarray, space: np.ndarray = SPACE) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(starts, ends, bounds): words of row i are bounds[i]:bounds[i + 1]. No word crosses a row."""
    if not len(data):
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(len(at), np.int64)
    inside = ~space[data]
    edge = np.zeros(len(data) + 1, bool)
    edge[at] = True
    first, last = inside.copy(), inside.copy()
    first[1:] &= ~inside[:-1] | edge[1:-1]
    last[:-1] &= ~inside[1:] | edge[1:-1]
    starts, ends = np.flatnonzero(first), np.flatnonzero(last) + 1
    return starts, ends, np.searchsorted(starts, at)


def shingle_hashes(words: np.ndarray, bounds: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """(hashes, bounds) of the ``width``-word shingles of each row.

    A row with fewer words has its whole sequence as one shingle, a row without words none.
    """
    counts = np.diff(bounds)
    made = np.where(counts >= width, counts - width + 1, np.minimum(counts, 1))
    out = np.zeros(len(counts) + 1, np.int64)
    np.cumsum(made, out=out[1:])
    if not len(words):
        return np.zeros(0, np.uint64), out
    step = np.uint64(0xD6E8FEB86659FD93)
    padded = np.concatenate([words, np.zeros(width, np.uint64)])
    full = np.zeros(len(words), np.uint64)
    for k in range(width):
        full = full * step + padded[k : k + len(words)]
    rows = np.repeat(np.arange(len(counts)), made)
    where = np.arange(out[-1]) - out[rows] + bounds[:-1][rows]
    hashes = mix(full[where], 1)
    for row in np.flatnonzero((counts > 0) & (counts < width)):
        short = np.uint64(counts[row])
        for x in words[bounds[row] : bounds[row + 1]]:
            short = short * step + x
        hashes[out[row]] = mix(np.array([short]), 2)[0]
    return hashes, out


def shingle_sets(column: pa.Array, width: int, lower: bool = True) -> Iterator[np.ndarray]:
    """The sorted distinct shingle hashes of each row."""
    with np.errstate(over="ignore"):
        for _, _, data, at in chunks(column):
            data = LOWER[data] if lower else data
            starts, ends, bounds = word_spans(data, at)
            hashes, out = shingle_hashes(span_hashes(data, starts, ends), bounds, width)
            for row in range(len(at) - 1):
                yield np.unique(hashes[out[row] : out[row + 1]])

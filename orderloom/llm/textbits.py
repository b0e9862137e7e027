"""Array helpers for texts inside tasks: slices of Arrow batches, words and their hashes.

Words are maximal runs of bytes other than space and 0x09 to 0x0D, after lower-casing A-Z. All
functions work on one slice of a batch, so their memory follows the slice (``PIECE_BYTES``, or the
longest single text).
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

PIECE_BYTES = 1 << 20

LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
SPACE = np.zeros(256, bool)
SPACE[[9, 10, 11, 12, 13, 32]] = True


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit integers that spreads every bit (constants of splitmix64)."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


BYTE_VALUES = mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))
_BASE = 0x9E3779B97F4A7C15 | 1
_INVERSE = pow(_BASE, -1, 1 << 64)
_powers: list[np.ndarray] = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """The first ``n`` powers of an odd base modulo 2**64, and of its inverse."""
    if len(_powers[0]) < n:
        size = max(n, PIECE_BYTES + 1)
        for i, base in enumerate((_BASE, _INVERSE)):
            steps = np.full(size, base, np.uint64)
            steps[0] = 1
            _powers[i] = np.multiply.accumulate(steps)
    return _powers[0][:n], _powers[1][:n]


def texts(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of all texts one after the other, and where each begins (one entry more than texts)."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = pc.fill_null(column, b"" if pa.types.is_binary(column.type) else "")
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    _, where, data = column.buffers()
    if not len(column):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    offsets = np.frombuffer(where, np.int64 if wide else np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    flat = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return flat[offsets[0] : offsets[-1]], offsets - offsets[0]


def pieces(batches: Iterator[pa.RecordBatch], column: str, limit: int = PIECE_BYTES) -> Iterator[pa.RecordBatch]:
    """Slices of the batches with at most ``limit`` bytes of text, or one longer text alone."""
    for batch in batches:
        _, offsets = texts(batch.column(batch.schema.get_field_index(column)))
        start = 0
        while start < batch.num_rows:
            end = int(np.searchsorted(offsets, offsets[start] + limit, side="right")) - 1
            end = min(max(end, start + 1), batch.num_rows)
            yield batch.slice(start, end - start)
            start = end


def word_bounds(low: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of the words, and the first word of each text (one entry more than texts)."""
    if not len(low):
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(len(offsets), np.int64)
    inside = ~SPACE[low]
    cut = np.zeros(len(low) + 1, bool)
    cut[offsets] = True
    begins = inside.copy()
    begins[1:] &= ~inside[:-1] | cut[1:-1]
    ends = inside.copy()
    ends[:-1] &= ~inside[1:] | cut[1:-1]
    starts = np.flatnonzero(begins)
    return starts, np.flatnonzero(ends) + 1, np.searchsorted(starts, offsets)


def span_hashes(low: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each byte range, equal for equal bytes wherever they stand."""
    up, down = powers(len(low) + 1)
    sums = np.zeros(len(low) + 1, np.uint64)
    np.cumsum(BYTE_VALUES[low] * up[:-1], out=sums[1:])
    return mix((sums[ends] - sums[starts]) * down[starts] + (ends - starts).astype(np.uint64))


def shingle_sets(column: pa.Array, words: int) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct shingle hashes of each text one after the other, and where each set begins.

    A text with fewer words than ``words`` gives its whole sequence as one shingle; a text without
    words gives the empty set.
    """
    data, offsets = texts(column)
    low = LOWER[data]
    starts, ends, first = word_bounds(low, offsets)
    hashes = span_hashes(low, starts, ends)
    counts = np.diff(first)
    n = np.where(counts == 0, 0, np.maximum(counts - words + 1, 1))
    at = np.concatenate([[0], np.cumsum(n)])
    doc = np.repeat(np.arange(len(n)), n)
    place = np.arange(at[-1]) - at[:-1][doc] + first[:-1][doc]
    last = first[1:][doc]
    out = np.zeros(len(doc), np.uint64)
    for k in range(words):
        there = place + k < last
        out = np.where(there, mix(out + hashes[np.minimum(place + k, max(len(hashes) - 1, 0))] + np.uint64(k)) if len(hashes) else out, out)
    order = np.lexsort((out, doc))
    out, doc = out[order], doc[order]
    new = np.ones(len(out), bool)
    new[1:] = (out[1:] != out[:-1]) | (doc[1:] != doc[:-1])
    out, doc = out[new], doc[new]
    return out, np.searchsorted(doc, np.arange(len(n) + 1))


def per_text(values: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """Sums of the values of each text."""
    total = np.concatenate([np.zeros(1, np.float64), np.cumsum(values, dtype=np.float64)])
    return total[bounds[1:]] - total[bounds[:-1]]


class Runs:
    """Hashes of runs of values (words of a text), of any run in constant time."""

    def __init__(self, values: np.ndarray):
        self.up, self.down = powers(len(values) + 1)
        self.sums = np.zeros(len(values) + 1, np.uint64)
        np.cumsum(values * self.up[:-1], out=self.sums[1:])

    def raw(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Hashes of the runs from a to b."""
        return (self.sums[b] - self.sums[a]) * self.down[a]

    def without(self, a: np.ndarray, b: np.ndarray, skip: np.ndarray) -> np.ndarray:
        """Hashes of the runs from a to b less the value at ``skip``."""
        return self.raw(a, skip) + self.raw(skip + 1, b) * self.up[skip - a]

"""Counts of hashed character n-grams, as one stage of a pipeline.

The vectors are those of ``RegexTokenizer`` with an empty pattern, ``NGram`` and ``HashingTF`` one after another: a
gram is n letters with blanks between them, lower case, a letter beyond 16 bits counts as two question marks, and the
place is the gram's Murmur3 hash with seed 42. Here no text is made of a gram but once for all equal ones that a
worker meets: as long as the letters are few, every possible gram has a cell for its place, kept from batch to batch.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import keyword_only
from pyspark.ml import Transformer
from pyspark.ml.linalg import VectorUDT
from pyspark.ml.param import Param, Params, TypeConverters
from pyspark.ml.param.shared import HasInputCol, HasNumFeatures, HasOutputCol
from pyspark.ml.util import DefaultParamsReadable, DefaultParamsWritable
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Letters that are taken apart at a time, so that their arrays stay near the processor, and cells of a table of places.
_BLOCK, _CELLS = 1 << 17, 1 << 22
_BEYOND = re.compile("[\U00010000-\U0010ffff]")
_VECTOR = pa.struct([("type", pa.int8()), ("size", pa.int32()), ("indices", pa.list_(pa.int32())), ("values", pa.list_(pa.float64()))])


def murmur3(rows: np.ndarray, seed: int = 42) -> np.ndarray:
    """32-bit Murmur3 of each row of bytes."""

    def turned(x: np.ndarray, by: int) -> np.ndarray:
        return (x << np.uint32(by)) | (x >> np.uint32(32 - by))

    def mixed(k: np.ndarray) -> np.ndarray:
        return turned(k * np.uint32(0xCC9E2D51), 15) * np.uint32(0x1B873593)

    n, size = rows.shape
    whole = size // 4 * 4
    h = np.full(n, seed, np.uint32)
    for word in np.ascontiguousarray(rows[:, :whole]).view("<u4").astype(np.uint32).T:
        h = turned(h ^ mixed(word), 13) * np.uint32(5) + np.uint32(0xE6546B64)
    rest = np.zeros(n, np.uint32)
    for i in range(whole, size):
        rest |= rows[:, i].astype(np.uint32) << np.uint32(8 * (i - whole))
    h = h ^ mixed(rest) ^ np.uint32(size)
    h = (h ^ (h >> np.uint32(16))) * np.uint32(0x85EBCA6B)
    h = (h ^ (h >> np.uint32(13))) * np.uint32(0xC2B2AE35)
    return h ^ (h >> np.uint32(16))


def _places(letters: np.ndarray, width: int) -> np.ndarray:
    """The place of each gram, a row of letters of 16 bits."""
    n = letters.shape[1]
    text = letters.astype("<u2").tobytes().decode("utf-16-le")
    said = [" ".join(text[i : i + n]).encode() for i in range(0, len(text), n)]
    sizes = np.array([len(g) for g in said], np.int64)
    out = np.zeros(len(said), np.int64)
    for size in np.unique(sizes).tolist():
        at = np.flatnonzero(sizes == size)
        rows = np.frombuffer(b"".join([said[i] for i in at.tolist()]), np.uint8).reshape(len(at), size)
        out[at] = murmur3(rows).view(np.int32).astype(np.int64) % width
    return out


class _Cells:
    """A cell for the place of every gram of some letters, filled when the gram is first met."""

    def __init__(self, kinds: np.ndarray, n: int, width: int):
        self.kinds, self.n, self.width = kinds, n, width
        self.short = np.full(1 << 16, -1, np.int32)
        self.short[kinds] = np.arange(len(kinds))
        self.place = np.full(len(kinds) ** n, -1, np.int32)

    def places(self, short: np.ndarray) -> np.ndarray:
        size, length = len(self.kinds), len(short) - self.n + 1
        code = short[:length].copy()
        for i in range(1, self.n):
            code *= size
            code += short[i : i + length]
        found = self.place[code]
        new = code[found < 0]
        if len(new):
            new = np.unique(new)
            powers = size ** np.arange(self.n - 1, -1, -1)
            self.place[new] = _places(self.kinds[new[:, None] // powers % size], self.width)
            found = self.place[code]
        return found


#: The table of a worker for each (n, width).
_tables: dict[tuple[int, int], _Cells] = {}


def _gram_places(letters: np.ndarray, n: int, width: int) -> np.ndarray:
    """The place of the gram at every letter; equal grams are hashed once."""
    table = _tables.get((n, width))
    short = table.short[letters] if table else None
    if short is None or short.min() < 0:
        present = np.zeros(1 << 16, bool)
        present[letters] = True
        own = np.flatnonzero(present)
        if len(own) ** n > _CELLS:
            rows = np.ascontiguousarray(np.lib.stride_tricks.sliding_window_view(letters, n))
            _, first, at = np.unique(rows.view(np.dtype((np.void, 2 * n))).reshape(-1), return_index=True, return_inverse=True)
            return _places(rows[first], width)[at.reshape(-1)]
        if table:
            present[table.kinds] = True
        both = np.flatnonzero(present)
        # Letters of other alphabets are forgotten when all of them would need too many cells.
        table = _tables[n, width] = _Cells(both if len(both) ** n <= _CELLS else own, n, width)
        short = table.short[letters]
    return table.places(short)


def gram_counts(texts: list[str], n: int, width: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Sizes, places and counts of the sparse vectors of lower-case texts."""
    sizes = np.array([len(t) for t in texts], np.int64)
    letters = np.frombuffer("".join(texts).encode("utf-16-le"), "<u2")
    if len(letters) != sizes.sum():
        return gram_counts([_BEYOND.sub("??", t) for t in texts], n, width)
    ends = np.cumsum(sizes)
    held = np.maximum(sizes - n + 1, 0)
    if not held.sum():
        return np.zeros(len(texts), np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64)
    text = np.repeat(np.arange(len(texts)), held)
    at = np.arange(len(text)) + np.repeat(ends - sizes - (np.cumsum(held) - held), held)
    key = text * width + _gram_places(letters, n, width)[at]
    if len(texts) * width <= 8 * len(key):
        dense = np.bincount(key, minlength=len(texts) * width)
        key = np.flatnonzero(dense)
        counts = dense[key]
    else:
        key, counts = np.unique(key, return_counts=True)
    return np.bincount(key // width, minlength=len(texts)), key % width, counts


def _vectors(texts: list[str], n: int, width: int) -> pa.StructArray:
    """Sparse vectors of texts, some letters at a time."""
    parts, low = [], 0
    while low < len(texts):
        high, letters = low, 0
        while high < len(texts) and (high == low or letters + len(texts[high]) <= _BLOCK):
            letters += len(texts[high])
            high += 1
        parts.append(gram_counts(texts[low:high], n, width))
        low = high
    held, places, counts = (np.concatenate(x) for x in zip(*parts, strict=True))
    offsets = pa.array(np.concatenate([np.zeros(1, np.int64), np.cumsum(held)]), pa.int32())
    lists = [pa.ListArray.from_arrays(offsets, pa.array(places, pa.int32())), pa.ListArray.from_arrays(offsets, pa.array(counts.astype(np.float64)))]
    head = [pa.array(np.zeros(len(held), np.int8)), pa.array(np.full(len(held), width, np.int32))]
    return pa.StructArray.from_arrays([*head, *lists], fields=list(_VECTOR))


class GramCounts(Transformer, HasInputCol, HasOutputCol, HasNumFeatures, DefaultParamsReadable, DefaultParamsWritable):
    """Sparse counts of the character n-grams of ``inputCol``, hashed to ``numFeatures`` places."""

    n = Param(Params._dummy(), "n", "letters of a gram", typeConverter=TypeConverters.toInt)

    @keyword_only
    def __init__(self, *, inputCol: str | None = None, outputCol: str | None = None, n: int = 3, numFeatures: int = 1 << 12):
        super().__init__()
        self._setDefault(n=3, numFeatures=1 << 12)
        self._set(**self._input_kwargs)

    def _transform(self, dataset: DataFrame) -> DataFrame:
        n, width = self.getOrDefault(self.n), self.getNumFeatures()

        @F.arrow_udf(VectorUDT())
        def counted(pieces: Iterator[pa.Array]) -> Iterator[pa.Array]:
            for piece in pieces:
                yield _vectors(piece.to_pylist(), n, width) if len(piece) else pa.array([], _VECTOR)

        # Vectors are larger than their texts, so a batch has few rows.
        dataset.sparkSession.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "1000")
        return dataset.withColumn(self.getOutputCol(), counted(F.lower(F.col(f"`{self.getInputCol()}`"))))

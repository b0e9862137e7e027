"""Benchmark decontamination: n-gram seeds join passages to test items, then Smith-Waterman.

Texts become words: A-Z lower-cased, ASCII punctuation taken as space. All word trigrams of a test item
are its seeds, common ones too: an edited copy may hold no other. Documents that hold a seed are
candidates for the item, and the passage around their seeds is aligned with the whole item (match 2,
mismatch and gap -1), unless even all words that they share fall short. A document is contaminated by
an item when the score reaches half of a full match. A copy that keeps no three adjacent words of the
item has no seed and is not found.

Test items are taken in blocks of a stated size, each of which is broadcast; training texts are not
shuffled. Items or texts that are null or have fewer than three words match nothing. Rows without
doc_id are aligned like others. Repeated items give a row each per document, repeated documents too.
Empty tables give an empty result. Other columns play no part.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from orderloom.llm import textbits as tb
from orderloom.llm.store import text_batches

SEED_WORDS = 3
BLOCK_BYTES = 4 << 20
MATCH, MISS, GAP = 2, -1, 1
_TABLE = 1 << 22
#: Cells of a block of passages that are aligned together, and places in items that are looked up at a time.
CELLS, ENTRIES = 1 << 19, 1 << 20

PLAIN = tb.LOWER.copy()
for _first, _last in ((0x21, 0x2F), (0x3A, 0x40), (0x5B, 0x60), (0x7B, 0x7E)):
    PLAIN[_first : _last + 1] = 32


def _words(column: pa.Array):
    """Word hashes of each text, their byte bounds, and the first word of each text."""
    data, offsets = tb.texts(column)
    low = PLAIN[data]
    starts, ends, first = tb.word_bounds(low, offsets)
    return tb.span_hashes(low, starts, ends), starts, ends, first, offsets


def _seeds(hashes: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the word trigrams and the word where each begins."""
    if len(hashes) < SEED_WORDS:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    seed = hashes[: len(hashes) - SEED_WORDS + 1]
    for k in range(1, SEED_WORDS):
        seed = tb.mix(seed + hashes[k : len(hashes) - SEED_WORDS + 1 + k])
    whole = np.ones(len(hashes), bool)
    for k in range(1, SEED_WORDS):
        cut = first[1:] - k
        whole[cut[cut >= 0]] = False
    at = np.flatnonzero(whole[: len(seed)])
    return seed[at], at


class Seeds:
    """A sorted set of seeds with the places in items where each occurs."""

    def __init__(self, seeds: np.ndarray, item: np.ndarray, place: np.ndarray):
        order = np.argsort(seeds, kind="stable")
        self.seeds, self.item, self.place = seeds[order], item[order], place[order]
        self.distinct, self.first = np.unique(self.seeds, return_index=True)
        self.count = np.diff(np.append(self.first, len(self.seeds)))
        self.table = np.zeros(_TABLE, bool)
        self.table[(self.distinct % np.uint64(_TABLE)).astype(np.int64)] = True

    def find(self, seeds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Which of the given seeds are in the set, and their numbers in it."""
        maybe = np.flatnonzero(self.table[(seeds & np.uint64(_TABLE - 1)).astype(np.int64)])
        number = np.searchsorted(self.distinct, seeds[maybe])
        number[number == len(self.distinct)] = 0
        there = self.distinct[number] == seeds[maybe] if len(self.distinct) else np.zeros(len(maybe), bool)
        return maybe[there], number[there]


def aligned(item: np.ndarray, passage: np.ndarray) -> int:
    """The Smith-Waterman score of two word sequences, row by row."""
    best = 0
    above = np.zeros(len(passage) + 1, np.int64)
    slope = np.arange(len(passage) + 1) * GAP
    for word in item:
        here = np.zeros_like(above)
        np.maximum(above[:-1] + np.where(passage == word, MATCH, MISS), above[1:] - GAP, out=here[1:])
        np.maximum(here, 0, out=here)
        # Gaps along the row: each cell takes the best of those before it, less their distance.
        above = np.maximum.accumulate(here + slope) - slope
        best = max(best, int(above.max()))
    return best


def aligned_many(items: list[np.ndarray], passages: list[np.ndarray], share: float) -> np.ndarray:
    """``aligned`` of each item with its passage, all together, as shares of a full match; 0 where it is below ``share``."""
    out = np.zeros(len(items))
    size = np.array([len(p) for p in passages], np.int64)
    # Passages of like length share a block, which holds a bounded number of cells.
    order = np.argsort(size, kind="stable")[::-1]
    at = 0
    while at < len(order):
        some = order[at : at + max(1, CELLS // max(int(size[order[at]]), 1))]
        at += len(some)
        wide, tall = max(int(size[some[0]]), 1), max(len(items[i]) for i in some)
        # What fills up a row or column matches nothing, so it never raises a score.
        texts, wanted = np.zeros((len(some), wide), np.uint64), np.ones((len(some), tall), np.uint64)
        for row, i in enumerate(some.tolist()):
            texts[row, : len(passages[i])], wanted[row, : len(items[i])] = passages[i], items[i]
        full = MATCH * np.array([len(items[i]) for i in some], np.int64)
        held = np.zeros(len(some), np.int64)
        for word in wanted.T:
            held += (texts == word[:, None]).any(axis=1)
        enough = np.flatnonzero(MATCH * held >= share * full)  # else not even all common words would do
        texts, wanted, some, full = texts[enough], wanted[enough], some[enough], full[enough]
        best = np.zeros(len(some), np.int32)
        above = np.zeros((len(some), wide + 1), np.int32)
        slope = np.arange(wide + 1, dtype=np.int32) * GAP
        for word in wanted.T:
            here = np.zeros_like(above)
            step = np.where(texts == word[:, None], np.int32(MATCH), np.int32(MISS))
            np.maximum(above[:, :-1] + step, above[:, 1:] - GAP, out=here[:, 1:])
            np.maximum(here, 0, out=here)
            # Gaps along the row: each cell takes the best of those before it, less their distance.
            above = np.maximum.accumulate(here + slope, axis=1) - slope
            np.maximum(best, above.max(axis=1), out=best)
        score = best / np.maximum(full, 1)
        out[some] = np.where(score >= share, score, 0.0)
    return out


def _parts(doc: np.ndarray, entries: np.ndarray) -> Iterator[slice]:
    """Ranges of hits of whole documents that stand for a bounded number of places in items, or one document."""
    if not len(doc):
        return
    ends = np.append(np.flatnonzero(doc[1:] != doc[:-1]) + 1, len(doc))
    total = np.cumsum(entries)
    start, before = 0, 0
    for i, end in enumerate(ends):
        if i + 1 == len(ends) or total[ends[i + 1] - 1] - before > ENTRIES:
            yield slice(start, int(end))
            start, before = int(end), int(total[end - 1])


def _passages(hit: np.ndarray, number: np.ndarray, at: np.ndarray, first: np.ndarray, seeds: Seeds, lengths: np.ndarray):
    """Candidate passages: document, item, first and last word, number of seeds."""
    n = seeds.count[number]
    entry = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n) + np.repeat(seeds.first[number], n)
    word = np.repeat(at[hit], n)
    item = seeds.item[entry]
    begin = word - seeds.place[entry]
    doc = np.searchsorted(first, word, side="right") - 1
    length = lengths[item]
    slack = np.maximum(8, length // 2)
    order = np.lexsort((begin, item, doc))
    doc, item, begin, length, slack = (x[order] for x in (doc, item, begin, length, slack))
    new = np.ones(len(doc), bool)
    new[1:] = (doc[1:] != doc[:-1]) | (item[1:] != item[:-1]) | (begin[1:] - begin[:-1] > slack[1:])
    s = np.flatnonzero(new)
    e = np.append(s[1:], len(doc))
    low = np.maximum(begin[s] - slack[s], first[doc[s]])
    high = np.minimum(begin[e - 1] + length[s] + slack[s], first[doc[s] + 1])
    return doc[s], item[s], low, high, e - s


def contaminated(docs: DataFrame, benchmark: DataFrame, share: float = 0.5, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """Pairs of a document and a test item found in it.

    ``doc_id, item_id, score`` (share of a full match), ``n_seeds`` and the bytes ``start`` to ``end``
    of the passage that was aligned; one row per pair, the best passage.
    """
    spark = docs.sparkSession
    docs = text_batches(docs).select("doc_id", "text")
    items = benchmark.select("item_id", "text").filter("text IS NOT NULL")
    size = items.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    blocks = max(1, math.ceil(size / block_bytes))
    schema = "doc_id long, item_id long, score double, n_seeds long, start long, end long"
    found = spark.createDataFrame([], schema)
    for block in range(blocks):
        rows = items.filter(F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks)) == block).collect()
        if rows:
            found = found.union(_block(docs, [r["item_id"] for r in rows], [r["text"] for r in rows], share, schema))
    return found


def _block(docs: DataFrame, ids: list[int], item_texts: list[str], share: float, schema: str) -> DataFrame:
    spark = docs.sparkSession
    hashes, _, _, first, _ = _words(pa.array(item_texts))
    words = [hashes[a:b] for a, b in zip(first[:-1], first[1:], strict=True)]
    seeds, at = _seeds(hashes, first)
    item = np.searchsorted(first, at, side="right") - 1
    place = at - first[item]
    shared = spark.sparkContext.broadcast((Seeds(seeds, item, place), words, ids))  # of one block

    def align(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seeds, words, ids = shared.value
        lengths = np.array([len(w) for w in words], np.int64)
        for piece in tb.pieces(batches, "text"):
            hashes, starts, ends, first, offsets = _words(piece.column(1))
            found, at = _seeds(hashes, first)
            hit, number = seeds.find(found)
            doc_of = np.searchsorted(first, at[hit], side="right") - 1
            best: dict[tuple[int, int], tuple] = {}
            for part in _parts(doc_of, seeds.count[number]):
                doc, item, low, high, n = _passages(hit[part], number[part], at, first, seeds, lengths)
                scores = aligned_many([words[i] for i in item.tolist()], [hashes[a:b] for a, b in zip(low.tolist(), high.tolist(), strict=True)], share)
                for i in np.flatnonzero(scores).tolist():
                    key = (int(doc[i]), int(item[i]))
                    if scores[i] > best.get(key, (0.0,))[0]:
                        place = int(starts[low[i]] - offsets[doc[i]]), int(ends[high[i] - 1] - offsets[doc[i]])
                        best[key] = (float(scores[i]), int(n[i]), *place)
            if best:
                doc_ids = piece.column(0).to_pylist()
                out = [(doc_ids[doc], ids[item], *rest) for (doc, item), rest in best.items()]
                yield pa.record_batch([pa.array(c, t) for c, t in zip(zip(*out, strict=True), kinds, strict=True)], names)

    names = ["doc_id", "item_id", "score", "n_seeds", "start", "end"]
    kinds = [pa.int64(), pa.int64(), pa.float64(), pa.int64(), pa.int64(), pa.int64()]
    return docs.mapInArrow(align, schema)

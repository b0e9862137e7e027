"""Spelling variants grouped by a reduced alphabet and one-edit neighbourhoods.

Letters are hashed to a few symbols. Two words that differ by one inserted, deleted or replaced code
point have reduced words that are equal or differ by one such edit, so the edits of a reduced word need
only a few symbols in place of every letter of every script.

1. ``word_counts`` counts the words of all texts, folded before they are shuffled.
2. Each word emits the one-edit neighbourhood of its reduced word as hashed keys: itself, every
   deletion, every insertion and replacement. An insertion into x that gives y is a deletion from y
   that gives x, and a replacement is undone by one, so each pair of neighbours is emitted by one side
   only: the longer, or the one with the lower symbol at the edited place.
3. The keys join the reduced vocabulary. Letter masks of the original words, of which an edit changes
   at most two bits, thin the pairs inside the join.
4. The pairs left are verified on the original strings by edit distance.
5. A word's form is its most frequent near word, if that is frequent enough; forms are followed to
   their end by doubling steps. Frequencies grow along the way, so there are no circles.

Words of any length take part: keys are 64-bit hashes of any length of word, and only identifiers
travel with them. Null and empty texts have no words; a null doc_id is written as nothing. Repeated rows
count again. An empty table gives an empty result. Other columns play no part. Among equally frequent
near words the smallest in code-point order is the form.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from orderloom.llm import textbits as tb
from orderloom.llm.store import stored, text_batches

#: Fixed value: the runs of letters that are words.
RUNS = "[A-Za-zÀ-ÿ]+"
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Symbols of the reduced alphabet.
SYMBOLS = 8
_STEP = np.uint64(0x9E3779B97F4A7C15)


def word_counts(docs: DataFrame, min_length: int = 5, min_count: int = 3, drop_every: int | None = None) -> DataFrame:
    """``word, n`` of the words (A-Z lower-cased) of ``docs`` (``doc_id, text``) that are long and frequent enough.

    With ``drop_every`` a run whose checksum with its doc_id is a multiple of it loses one code point
    before it is counted, which plants misspellings at known places.
    """
    low = F.translate("text", _UPPER, _LOWER)
    runs = docs.select("doc_id", F.explode(F.regexp_extract_all(low, F.lit(RUNS), F.lit(0))).alias("word"))
    if drop_every:
        seen = F.crc32(F.concat(F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.lit(":"), F.col("word")))
        at = F.expr("CAST(seen % char_length(word) AS INT)")
        shorter = F.concat(F.substring("word", F.lit(1), at), F.expr("substring(word, CAST(seen % char_length(word) AS INT) + 2)"))
        runs = runs.withColumn("seen", seen).select(F.when(F.col("seen") % drop_every == 0, shorter).otherwise(F.col("word")).alias("word"))
    counts = runs.select("word").filter(F.char_length("word") >= min_length).groupBy("word").agg(F.count("*").alias("n"))
    return counts.filter(F.col("n") >= min_count)


class Reduced:
    """The reduced words of a batch: hashes of any of their edits in constant time."""

    def __init__(self, words: list[str], symbols: int):
        self.points = np.frombuffer("".join(words).encode("utf-32-le"), np.uint32).astype(np.uint64)
        self.b = np.cumsum(np.array([len(w) for w in words], np.int64)) if words else np.zeros(0, np.int64)
        self.a = np.concatenate([np.zeros(1, np.int64), self.b])[:-1]
        self.symbol = (tb.mix(self.points * _STEP + np.uint64(1)) % np.uint64(symbols)).astype(np.int64)
        self.values = tb.mix(np.arange(1, symbols + 1, dtype=np.uint64) * _STEP)
        self.runs = tb.Runs(self.values[self.symbol])
        self.symbols = symbols

    def own(self) -> np.ndarray:
        return _key(self.runs.raw(self.a, self.b), self.b - self.a)

    def masks(self) -> np.ndarray:
        """A bit for each letter of the word, 64 kinds."""
        bits = np.uint64(1) << (tb.mix(self.points + _STEP) & np.uint64(63))
        return np.bitwise_or.reduceat(bits, self.a) if len(self.a) else np.zeros(0, np.uint64)

    def neighbours(self) -> tuple[np.ndarray, np.ndarray]:
        """Word and key of every deletion, and of every replacement by a higher symbol."""
        n = self.b - self.a
        word = np.repeat(np.arange(len(n)), n)
        place = np.arange(len(word))
        rows, keys = [word], [_key(self.runs.without(self.a[word], self.b[word], place), n[word] - 1)]
        whole, up = self.runs.raw(self.a, self.b), self.runs.up
        for more in range(1, self.symbols):
            some = np.flatnonzero(self.symbol + more < self.symbols)
            w, old = word[some], self.symbol[some]
            change = (self.values[old + more] - self.values[old]) * up[some - self.a[w]]
            rows.append(w)
            keys.append(_key(whole[w] + change, n[w]))
        row, key = np.concatenate(rows), np.concatenate(keys)
        order = np.lexsort((key, row))
        row, key = row[order], key[order]
        new = np.ones(len(row), bool)
        new[1:] = (row[1:] != row[:-1]) | (key[1:] != key[:-1])
        return row[new], key[new]


def _key(raw: np.ndarray, n: np.ndarray) -> np.ndarray:
    return tb.mix(tb.mix(raw) + n.astype(np.uint64))


def _reduced(words: DataFrame, symbols: int) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for piece in tb.pieces(batches, "word"):
            reduced = Reduced(piece.column(1).to_pylist(), symbols)
            yield pa.record_batch(
                [piece.column(0), piece.column(1), piece.column(2), pa.array(reduced.own().view(np.int64)), pa.array(reduced.masks().view(np.int64))],
                ["id", "word", "n", "key", "mask"],
            )

    return words.mapInArrow(run, "id long, word string, n long, key long, mask long")


def _neighbourhood(reduced: DataFrame, symbols: int) -> DataFrame:
    """``id, key, mask, own``: the keys that each word looks up."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # A word has several keys for each letter, so slices are small.
        for piece in tb.pieces(batches, "word", tb.PIECE_BYTES >> 4):
            row, key = Reduced(piece.column(1).to_pylist(), symbols).neighbours()
            own = np.arange(piece.num_rows)
            at = pa.array(np.concatenate([own, row]))
            keys = np.concatenate([piece.column(2).to_numpy(), key.view(np.int64)])
            flags = np.arange(len(keys)) < len(own)
            yield pa.record_batch([piece.column(0).take(at), pa.array(keys), piece.column(3).take(at), pa.array(flags)], ["id", "key", "mask", "own"])

    return reduced.select("id", "word", "key", "mask").mapInArrow(run, "id long, key long, mask long, own boolean")


def near_words(vocabulary: DataFrame, symbols: int = SYMBOLS) -> DataFrame:
    """``a, b``: identifiers of words (``id, word, n``) that differ by exactly one code point, each pair once."""
    reduced = stored(_reduced(vocabulary.select("id", "word", "n"), symbols))
    keys = _neighbourhood(reduced, symbols)
    there = reduced.select(F.col("key").alias("there"), F.col("id").alias("b"), F.col("mask").alias("other"))
    alike = F.bit_count(F.col("mask").bitwiseXOR(F.col("other"))) <= 2
    # Words with one reduced form see each other; of the others only one side looks the other up.
    once = ~F.col("own") | (F.col("id") < F.col("b"))
    pairs = keys.join(there, (F.col("key") == F.col("there")) & alike & once).select(F.col("id").alias("a"), "b")
    x, y = reduced.select(F.col("id").alias("a"), F.col("word").alias("x")), reduced.select(F.col("id").alias("b"), F.col("word").alias("y"))
    return pairs.join(x, "a").join(y, "b").filter(F.levenshtein("x", "y", 1) == 1).select("a", "b").distinct()


def _roots(forms: DataFrame) -> DataFrame:
    """``id, root`` of ``id, form`` (null at an end), by doubling the steps."""
    steps = stored(forms.select("id", F.coalesce("form", "id").alias("root")))
    while True:
        target = steps.select(F.col("id").alias("root"), F.col("root").alias("next"))
        jumped = stored(steps.join(target, "root").select("id", F.col("next").alias("root"), (F.col("next") != F.col("root")).alias("moved")))
        if jumped.filter("moved").isEmpty():
            return jumped.select("id", "root")
        steps = jumped.select("id", "root")


def group_variants(counts: DataFrame, ratio: int = 2, symbols: int = SYMBOLS) -> DataFrame:
    """``word, form, root, n, n_near, form_n`` for each row of ``counts`` (distinct ``word``, ``n``).

    ``form`` is the near word of largest n, if that is at least ``ratio`` times the word's own.
    """
    words = stored(counts.select("word", "n"))
    vocabulary = stored(words.select(F.monotonically_increasing_id().alias("id"), "word", "n"))
    pairs = stored(near_words(vocabulary, symbols))
    both = pairs.union(pairs.select(F.col("b").alias("a"), F.col("a").alias("b")))
    other = vocabulary.select(F.col("id").alias("b"), F.struct((-F.col("n")).alias("order"), "word", "id").alias("other"))
    best = both.join(other, "b").groupBy("a").agg(F.count("*").alias("n_near"), F.min("other").alias("best"))
    enough = -F.col("best.order") >= ratio * F.col("n")
    found = vocabulary.join(best.withColumnRenamed("a", "id"), "id", "left").select(
        "id", "word", "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"),
        F.when(enough, F.col("best.id")).alias("form_id"),
        F.when(enough, F.col("best.word")).alias("form"),
        F.when(enough, -F.col("best.order")).alias("form_n"),
    )
    found = stored(found)
    roots = _roots(found.select("id", F.col("form_id").alias("form")))
    ends = vocabulary.select(F.col("id").alias("root"), F.col("word").alias("end"))
    out = found.join(roots.join(ends, "root").select("id", "end"), "id")
    return out.select("word", "form", F.col("end").alias("root"), "n", "n_near", "form_n")


def spelling_variants(
    docs: DataFrame, min_length: int = 5, min_count: int = 3, ratio: int = 2, drop_every: int | None = None, symbols: int = SYMBOLS
) -> DataFrame:
    """``group_variants`` of the words of all texts of ``docs`` (``doc_id, text``)."""
    counts = word_counts(text_batches(docs), min_length, min_count, drop_every)
    return group_variants(counts, ratio, symbols)

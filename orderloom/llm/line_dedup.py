"""Line deduplication within one edit by a deletion-neighbourhood join.

A line is a sequence of words (A-Z lower-cased, split at white space); an edit inserts, deletes or
replaces one word. A line goes when an earlier line, by (doc_id, line number), is within one edit of
it; lines are judged on the input, not on what is left. One edit says little about lines of fewer than
``min_words`` words: with ``short_repeats`` they go when an earlier line is equal, else they stay. Blank
lines stay.

1. Equal lines become one class, known by its first occurrence.
2. Classes of at least ``min_words`` words: with one edit between two lines, all but one of ``PARTS`` parts agree. Classes that share no such
   key with another class need no variants.
3. The others emit their variants with one word of the disagreeing part deleted, as hashed keys. Two
   lines of equal length are within one edit when the variants without the word at the same place are
   equal; otherwise when one line equals a variant of the other. Only the earliest line of each key is
   looked up, so a key shared by very many lines never forms pairs.
4. The found pairs are fetched and their edit distance is verified on the words.

Rows with one doc_id and different texts are versions of one document: lines at the same place are neither
the earlier, and each version loses its own lines only. Rows without doc_id keep all their lines and
remove none; a null text stays null. An empty table gives an empty result. Other columns stay, whatever
their names; ``text`` and the two counts (``n_lines`` and ``n_removed``, or the names asked for) are set.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from orderloom.llm import textbits as tb
from orderloom.llm.store import free_name, likely, stored, text_batches, versioned

MIN_WORDS = 5
PARTS = 3
_SECOND = np.uint64(0xD6E8FEB86659FD93)
_FULL, _SHORTER, _SAME = 0, 1, 2
PLACE = ("doc_id", "line", "version")
_PLACE_TYPES = "doc_id long, line int, version long"


class Lines:
    """The lines of a slice of texts: their words, as hashes, and their places."""

    def __init__(self, column: pa.Array):
        data, offsets = tb.texts(column)
        low = tb.LOWER[data]
        starts, ends, _ = tb.word_bounds(low, offsets)
        self.words = tb.span_hashes(low, starts, ends)
        breaks = np.flatnonzero(data == 10)
        self.doc = np.concatenate([np.arange(len(offsets) - 1), np.searchsorted(offsets, breaks, side="right") - 1])
        begin = np.concatenate([offsets[:-1], breaks + 1])
        order = np.lexsort((begin, self.doc))
        self.doc, begin = self.doc[order], begin[order]
        last = np.append(self.doc[1:] != self.doc[:-1], True) if len(self.doc) else np.zeros(0, bool)
        self.begin, self.end = begin - offsets[self.doc], np.append(begin[1:] - 1, 0) - offsets[self.doc]
        self.end[last] = np.diff(offsets)[self.doc[last]]
        # An empty text begins where the next one does, so words are found by byte, not by line.
        self.a = np.searchsorted(starts, begin)
        self.b = np.searchsorted(starts, self.end + offsets[self.doc])
        self.number = np.arange(len(self.doc)) - np.searchsorted(self.doc, self.doc)

    def keep(self, at: np.ndarray) -> None:
        for name in ("doc", "begin", "end", "a", "b", "number"):
            setattr(self, name, getattr(self, name)[at])


def _part_bounds(n: np.ndarray, part: int) -> tuple[np.ndarray, np.ndarray]:
    return part * n // PARTS, (part + 1) * n // PARTS


def _part_keys(lines: Lines) -> list[np.ndarray]:
    """For each length that a partner's words may have and each part, a hash of the other parts."""
    runs = tb.Runs(lines.words)
    keys = []
    for less in (0, 1):
        n = lines.b - lines.a - less
        for part in range(PARTS):
            low, high = _part_bounds(n, part)
            ends = tb.mix(runs.raw(lines.a, lines.a + low) + n.astype(np.uint64)) + runs.raw(lines.b - (n - high), lines.b)
            keys.append(tb.mix(ends + np.uint64(part)))
    return keys


def _variants(lines: Lines, wanted: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Line, hashed key and role of each variant; ``wanted`` has a bit for each part key."""
    runs = tb.Runs(lines.words)
    rows, keys, roles = [], [], []

    def add(row: np.ndarray, raw: np.ndarray, n: np.ndarray, place: np.ndarray, role: int) -> None:
        rows.append(row)
        salt = (place + 1).astype(np.uint64) * _SECOND
        keys.append(tb.mix(tb.mix(raw + n.astype(np.uint64)) + salt))
        roles.append(np.full(len(row), role, np.int8))

    size = lines.b - lines.a
    for less in (0, 1):
        n = size - less
        for part in range(PARTS):
            row = np.flatnonzero(wanted >> (less * PARTS + part) & 1)
            low, high = _part_bounds(n[row], part)
            counts = high - low + less
            skip = np.arange(counts.sum()) - np.repeat(np.cumsum(counts) - counts, counts) + np.repeat(low, counts)
            line = np.repeat(row, counts)
            raw = runs.without(lines.a[line], lines.b[line], lines.a[line] + skip)
            if less:
                add(line, raw, n[line], np.full(len(line), -1), _SHORTER)
            else:
                add(line, raw, n[line], skip, _SAME)
    row = np.flatnonzero(wanted & ((1 << PARTS) - 1))
    add(row, runs.raw(lines.a[row], lines.b[row]), size[row], np.full(len(row), -1), _FULL)
    return np.concatenate(rows), np.concatenate(keys), np.concatenate(roles)


def _place(piece: pa.RecordBatch, lines: Lines) -> list[pa.Array]:
    doc = pa.array(lines.doc)
    return [piece.column(0).take(doc), pa.array(lines.number.astype(np.int32)), piece.column(1).take(doc)]


def _read_lines(docs: DataFrame, min_words: int, short_repeats: bool) -> DataFrame:
    names = [f"k{i}" for i in range(2 * PARTS)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for piece in tb.pieces(batches, "text"):
            lines = Lines(piece.column(2))
            lines.keep(np.flatnonzero(lines.b - lines.a >= (1 if short_repeats else min_words)))
            other = tb.Runs(tb.mix(lines.words ^ _SECOND))
            runs = tb.Runs(lines.words)
            n = (lines.b - lines.a).astype(np.uint64)
            h1, h2 = tb.mix(runs.raw(lines.a, lines.b) + n), tb.mix(other.raw(lines.a, lines.b) + n)
            columns = [h1, h2, *_part_keys(lines)]
            yield pa.record_batch(
                [*_place(piece, lines), pa.array(n >= min_words), *(pa.array(c.view(np.int64)) for c in columns)],
                [*PLACE, "long", "h1", "h2", *names],
            )

    return docs.mapInArrow(run, _PLACE_TYPES + ", long boolean, h1 long, h2 long, " + ", ".join(f"{n} long" for n in names))


def _emit(docs: DataFrame) -> DataFrame:
    """Texts and variants of the wanted lines; ``wanted`` has (line, bits of its part keys)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for piece in tb.pieces(batches, "text"):
            lines = Lines(piece.column(2))
            texts = [t.encode() for t in piece.column(2).to_pylist()]
            bits = np.zeros(len(lines.doc), np.int64)
            first = np.searchsorted(lines.doc, np.arange(len(texts)))
            for doc, wanted in enumerate(piece.column(3).to_pylist()):
                for w in wanted:
                    bits[first[doc] + w["line"]] |= w["bits"]
            at = np.flatnonzero(bits)
            lines.keep(at)
            row, key, role = _variants(lines, bits[at])
            order = np.argsort(row, kind="stable")
            bounds = pa.array(np.searchsorted(row[order], np.arange(len(at) + 1)), pa.int32())
            said = [texts[d][a:b].decode() for d, a, b in zip(lines.doc, lines.begin, lines.end, strict=True)]
            variants = pa.StructArray.from_arrays([pa.array(key[order].view(np.int64)), pa.array(role[order])], ["key", "role"])
            yield pa.record_batch(
                [*_place(piece, lines), pa.array(said, pa.string()), pa.ListArray.from_arrays(bounds, variants)],
                [*PLACE, "said", "variants"],
            )

    return docs.mapInArrow(run, _PLACE_TYPES + ", said string, variants array<struct<key: long, role: tinyint>>")


def _within_one_edit(pairs: DataFrame) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = []
            for a, b in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True):
                x, y = a.encode().lower().split(), b.encode().lower().split()
                most = min(len(x), len(y))
                front = next((i for i in range(most) if x[i] != y[i]), most)
                back = next((i for i in range(most - front) if x[-1 - i] != y[-1 - i]), most - front)
                keep.append(max(len(x), len(y)) - front - back <= 1)
            yield batch.filter(pa.array(keep, pa.bool_())).select(["place"])

    return pairs.mapInArrow(run, f"place struct<{_PLACE_TYPES}>")


def removed_lines(docs: DataFrame, min_words: int = MIN_WORDS, short_repeats: bool = False) -> DataFrame:
    """``doc_id, line, version`` of every line that an earlier line is within one edit of, or equal to if it is short.

    Lines count from 0; ``docs`` has ``doc_id, version, text``.
    """
    texts = docs.select("doc_id", "version", "text").filter("doc_id IS NOT NULL AND text IS NOT NULL")
    lines = stored(_read_lines(texts, min_words, short_repeats))
    names = [f"k{i}" for i in range(2 * PARTS)]
    place = F.struct(*PLACE)
    classes = stored(lines.groupBy("h1", "h2").agg(F.min(place).alias("place"), F.count("*").alias("n"), *(F.first(c).alias(c) for c in ("long", *names))))

    # Classes that share a key with another class, with a bit for each shared key.
    keys = classes.filter("long").select(F.posexplode(F.array(*names)).alias("bit", "key"), "place")
    keys = keys.withColumn("bit", F.expr("shiftleft(1L, bit)"))
    # A key of a shorter partner (second half of the names) meets the same key of its full length.
    shared = keys.groupBy("key").agg(F.count("*").alias("n")).filter("n > 1").select("key")
    hits = keys.join(shared, "key", "left_semi").groupBy("place").agg(F.bit_or("bit").alias("bits"))
    wanted = stored(hits.select("place.doc_id", "place.version", F.struct(F.col("place.line").alias("line"), "bits").alias("w")))
    by_doc = wanted.groupBy("doc_id", "version").agg(F.collect_list("w").alias("wanted"))
    emitted = stored(_emit(likely(texts, wanted, "doc_id").join(by_doc, ["doc_id", "version"]).select("doc_id", "version", "text", "wanted")))

    variants = emitted.select(place.alias("place"), F.explode("variants").alias("v")).select("place", "v.key", "v.role")
    earliest = variants.groupBy("key").agg(
        F.count("*").alias("n"),
        F.min(F.when(F.col("role") == _FULL, F.col("place"))).alias("full"),
        F.min(F.when(F.col("role") != _FULL, F.col("place"))).alias("variant"),
    )
    met = variants.join(earliest.filter("n > 1").drop("n"), "key")
    witness = F.when(F.col("role") == _SHORTER, F.col("full")).otherwise(F.col("variant"))
    earlier = F.expr("witness.doc_id < place.doc_id OR witness.doc_id = place.doc_id AND witness.line < place.line")
    pairs = met.select("place", witness.alias("witness")).filter(earlier).groupBy("place").agg(F.collect_set("witness").alias("w"))
    pairs = pairs.select("place", F.explode("w").alias("witness"))
    said = emitted.select(place.alias("place"), "said").distinct()
    fetched = pairs.join(said, "place").join(said.select(F.col("place").alias("witness"), F.col("said").alias("other")), "witness")
    near = _within_one_edit(fetched.select("place", "said", "other")).distinct().withColumn("near", F.lit(True))

    gone = classes.select("h1", "h2", "place", "n").join(near, "place", "left").filter("n > 1 OR near")
    gone = lines.select(*PLACE, "h1", "h2").join(gone, ["h1", "h2"])
    # Equal lines at one place of several versions are one line.
    return gone.filter("near OR place.doc_id <> doc_id OR place.line <> line").select(*PLACE).distinct()


def dedup_lines(
    docs: DataFrame, min_words: int = MIN_WORDS, short_repeats: bool = False, counts: tuple[str, str] = ("n_lines", "n_removed")
) -> DataFrame:
    """``docs`` with the removed lines taken out of ``text``, and two columns ``counts``: lines and removed lines."""
    docs = text_batches(docs.drop(*counts))
    version, lines_gone = free_name(docs, "_version"), free_name(docs, "_gone")
    versions = versioned(docs, version)
    gone = stored(removed_lines(versions.select("doc_id", F.col(version).alias("version"), "text"), min_words, short_repeats))
    by_doc = gone.groupBy("doc_id", F.col("version").alias(version)).agg(F.collect_list("line").alias(lines_gone))
    columns = docs.columns
    n_lines = F.coalesce(F.size(F.split("text", "\n", -1)), F.lit(0)).cast("long")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n, kept = [], []
            for text, lines in zip(batch.column("text").to_pylist(), batch.column(lines_gone).to_pylist(), strict=True):
                each = text.split("\n") if text is not None else []
                n.append(len(each))
                gone = set(lines or ())
                kept.append("\n".join(x for i, x in enumerate(each) if i not in gone) if text is not None else None)
            out = [pa.array(kept, pa.string()) if c == "text" else batch.column(c) for c in columns]
            removed = [len(x or ()) for x in batch.column(lines_gone).to_pylist()]
            yield pa.record_batch([*out, pa.array(n, pa.int64()), pa.array(removed, pa.int64())], [*columns, *counts])

    def whole(df: DataFrame) -> DataFrame:
        return df.withColumn(counts[0], n_lines).withColumn(counts[1], F.lit(0).cast("long"))

    touched = likely(versions.filter("doc_id IS NOT NULL"), gone, "doc_id").join(by_doc, ["doc_id", version], "left").select(*columns, lines_gone)
    return touched.mapInArrow(run, whole(docs).schema).union(whole(likely(docs, gone, "doc_id", inside=False)))

"""Removal of repeated byte strings by a distributed merge sort of suffixes.

A byte goes when it lies in a string of ``WINDOW`` bytes that also starts earlier: in a document with a
smaller doc_id, or earlier in the same document. Strings never cross documents, overlaps count, and all
is judged on the input.

1. Of the ``SEED``-byte strings in a window, the one with the smallest hash (the leftmost of equals) is
   its anchor. Equal windows have equal anchors at equal places, so only suffixes that start at anchors
   need sorting, one in some thirty-five. Hashes of the anchors' seeds are exchanged, and an anchor
   whose seed occurs once is dropped: its prefix already tells it from every other suffix.
2. Each slice of documents sorts its remaining anchors by their right context, the suffix as far as
   the anchor's windows reach. Equal contexts are folded to the earliest, the others being repeats.
   The sorted runs are front-coded and exchanged by seed.
3. Runs are merged by a loser tree that keeps, for each head, the length of the prefix it shares with
   the last string put out; known prefixes are never compared again. The merged order brings the
   common prefix lengths of neighbours, and the left contexts are ordered within each seed.
4. A window with ``o`` bytes left of its anchor equals another exactly when the right contexts share
   ``WINDOW - o`` bytes and the left ones ``o``. For each ``o`` both give a number of the class, so the
   earliest window of each class is found by sorting numbers: no pairs are formed.

A seed with more than ``HOT`` different contexts is not sent as one group: its windows go one by one,
spread by their own hash.

Null and empty texts have no bytes. Rows without doc_id are kept whole and repeat nothing. Rows with one
doc_id and different texts are versions of one document: their equal places are one place, and each
version loses its own bytes only. An empty table gives an empty result. Other columns play no part.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from orderloom.llm import textbits as tb
from orderloom.llm.store import key_buckets, likely, packed, stored, text_batches, unpacked, versioned

WINDOW, SEED = 100, 32
HOT = 16_384
_REACH = WINDOW - SEED
_LOW32 = np.uint64(0xFFFFFFFF)


def _least(values: np.ndarray, width: int) -> np.ndarray:
    """The minimum of each ``width`` values in a row, by running minima of blocks from both ends."""
    n = len(values)
    filled = np.full(-(-n // width) * width, np.uint64(0xFFFFFFFFFFFFFFFF))
    filled[:n] = values
    blocks = filled.reshape(-1, width)
    ahead = np.minimum.accumulate(blocks, axis=1).ravel()
    behind = np.minimum.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(behind[: n - width + 1], ahead[width - 1 : n])


class Anchors:
    """Anchors of the windows of a slice of texts: place, first and last window, and seed hash."""

    def __init__(self, column: pa.Array):
        self.data, self.offsets = data, offsets = tb.texts(column)
        none = np.zeros(0, np.int64)
        self.at = self.low = self.high = self.doc = none
        self.hash = self.context = np.zeros(0, np.uint64)
        if len(data) < WINDOW:
            return
        runs = tb.Runs(tb.BYTE_VALUES[data])
        place = np.arange(len(data) - SEED + 1)
        hashes = tb.mix(runs.raw(place, place + SEED))
        least = _least(hashes & ~_LOW32 | place.astype(np.uint64), _REACH + 1)
        inside = np.ones(len(least), bool)  # windows within one document
        cut = np.zeros(len(data) + 1, np.int64)
        np.add.at(cut, np.maximum(offsets[1:] - WINDOW + 1, offsets[:-1]), 1)
        np.add.at(cut, offsets[1:], -1)
        inside &= np.cumsum(cut)[: len(least)] == 0
        windows = np.flatnonzero(inside)
        if not len(windows):
            return
        anchor = (least[windows] & _LOW32).astype(np.int64)
        new = np.flatnonzero(np.append(True, anchor[1:] != anchor[:-1]))
        self.at, self.low = anchor[new], windows[new]
        self.high = windows[np.append(new[1:], len(windows)) - 1]
        self.doc = np.searchsorted(offsets, self.at, side="right") - 1
        self.hash = hashes[self.at]
        spread = ((self.at - self.low) * WINDOW + self.high - self.low).astype(np.uint64)
        self.context = tb.mix(runs.raw(self.low, self.high + WINDOW) + spread)


def _seed_counts(texts: DataFrame, buckets: int, hot: int) -> DataFrame:
    """``doc_id, version, anchor`` of the anchors whose seed occurs elsewhere, and whether the seed is hot."""
    bits = buckets.bit_length() - 1

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for piece in tb.pieces(batches, "text"):
            found = Anchors(piece.column(2))
            if not len(found.at):
                continue
            ids, versions = piece.column(0).to_numpy(), piece.column(1).to_numpy()
            bucket = (found.hash >> np.uint64(64 - bits)).astype(np.int64)
            order = np.argsort(bucket, kind="stable")
            edges = np.searchsorted(bucket[order], np.arange(buckets + 1))
            rest = (found.hash >> np.uint64(32 - bits)).astype(np.uint32)
            context = (found.context & np.uint64(0xFFFF)).astype(np.uint16)
            place = (found.at - found.offsets[found.doc]).astype(np.int64)
            rows = []
            for b in np.flatnonzero(np.diff(edges)):
                some = order[edges[b] : edges[b + 1]]
                docs = np.diff(ids[found.doc[some]], prepend=0)
                rows.append((int(b), packed(docs), packed(versions[found.doc[some]]), packed(place[some].astype(np.uint32)), packed(rest[some]), packed(context[some])))
            columns = list(zip(*rows, strict=True))
            yield pa.record_batch([pa.array(columns[0], pa.int32()), *(pa.array(c, pa.binary()) for c in columns[1:])], ["bucket", "docs", "versions", "place", "rest", "context"])

    def match(table: pa.Table) -> pa.Table:
        kinds = {"docs": np.int64, "versions": np.int64, "place": np.uint32, "rest": np.uint32, "context": np.uint16}
        cells = {name: [unpacked(b, kind) for b in table.column(name).to_pylist()] for name, kind in kinds.items()}
        docs = np.concatenate([np.cumsum(d) for d in cells["docs"]])
        versions, place, rest, context = (np.concatenate(cells[c]) for c in ("versions", "place", "rest", "context"))
        order = np.argsort(rest.astype(np.uint64) << np.uint64(16) | context, kind="stable")
        rest, context = rest[order], context[order]
        new = np.append(True, rest[1:] != rest[:-1])
        group = np.cumsum(new) - 1
        fresh = new | np.append(True, context[1:] != context[:-1])
        size, kinds_seen = np.bincount(group), np.bincount(group, fresh)
        some = np.flatnonzero(size[group] > 1)
        seeds_hot = kinds_seen[group[some]] > hot
        return pa.table({
            "doc_id": docs[order][some], "version": versions[order][some], "anchor": (place[order][some].astype(np.int64) << 1) | seeds_hot,
        })

    sent = texts.mapInArrow(send, "bucket int, docs binary, versions binary, place binary, rest binary, context binary")
    return sent.groupBy("bucket").applyInArrow(match, "doc_id long, version long, anchor long")


def shared_prefix(a: bytes, b: bytes, known: int) -> int:
    """How many leading bytes are equal, when the first ``known`` are."""
    n = min(len(a), len(b))
    if a[known:n] == b[known:n]:
        return n
    step = 16
    while a[known : known + step] == b[known : known + step]:
        known += step
    while a[known] == b[known]:
        known += 1
    return known


def merged(runs: list[tuple[list[bytes], list[int]]]) -> Iterator[tuple[int, int, int]]:
    """Merges sorted runs with a loser tree: run, place in it, prefix shared with the one before.

    A run is its strings and the prefix that each shares with the one before it in the run.
    """
    leaves = 1 << max(len(runs) - 1, 0).bit_length()
    heads: list[bytes | None] = [run[0][0] if run[0] else None for run in runs] + [None] * (leaves - len(runs))
    place = [0] * leaves
    # Prefix that a head shares with the last string put out; -1 for an empty run.
    prefix = [0 if head is not None else -1 for head in heads]
    losers = [0] * leaves

    def play(c: int, l: int) -> tuple[int, int]:
        """Winner and loser; the loser's prefix becomes the one it shares with the winner."""
        if prefix[l] > prefix[c]:
            return l, c
        if prefix[l] < prefix[c] or prefix[c] < 0:
            return c, l
        x, y = heads[c], heads[l]
        shared = shared_prefix(x, y, prefix[c])
        if shared < len(y) and (shared == len(x) or x[shared] < y[shared]) or shared == len(x) == len(y):
            prefix[l] = shared
            return c, l
        prefix[c] = shared
        return l, c

    winners = list(range(leaves))
    while len(winners) > 1:
        level = len(winners) // 2
        for i in range(level):
            winners[i], losers[level + i] = play(winners[2 * i], winners[2 * i + 1])
        winners = winners[:level]
    best = winners[0]
    while prefix[best] >= 0:
        yield best, place[best], prefix[best]
        strings, own = runs[best]
        place[best] += 1
        if place[best] < len(strings):
            heads[best], prefix[best] = strings[place[best]], own[place[best]]
        else:
            heads[best], prefix[best] = None, -1
        node = (leaves + best) >> 1
        while node:
            best, losers[node] = play(best, losers[node])
            node >>= 1


def neighbour_prefixes(strings: list[bytes]) -> np.ndarray:
    """Bytes that each string shares with the one before it."""
    out = np.zeros(len(strings), np.int64)
    for i in range(1, len(strings)):
        out[i] = shared_prefix(strings[i - 1], strings[i], 0)
    return out


def _front_coded(strings: list[bytes]) -> tuple[np.ndarray, bytes, np.ndarray]:
    shared = neighbour_prefixes(strings)
    rest = [s[p:] for s, p in zip(strings, shared, strict=True)]
    return shared.astype(np.uint8), b"".join(rest), np.array([len(r) for r in rest], np.uint8)


def _decoded(shared: np.ndarray, rest: bytes, lengths: np.ndarray) -> list[bytes]:
    out, before, at = [], b"", 0
    for p, n in zip(shared.tolist(), lengths.tolist(), strict=True):
        before = before[:p] + rest[at : at + n]
        at += n
        out.append(before)
    return out


_SPAN_NAMES = ["doc_id", "version", "start", "end"]
_SPAN = ", ".join(f"{name} long" for name in _SPAN_NAMES)
_RUN = "bucket int, ids binary, versions binary, at binary, shared binary, rest binary, lengths binary, left binary, lefts binary"
_RUN_KINDS = {"ids": np.int64, "versions": np.int64, "at": np.int64, "shared": np.uint8, "rest": np.uint8, "lengths": np.uint8, "left": np.uint8, "lefts": np.uint8}


def _spans(ids: np.ndarray, versions: np.ndarray, start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, ...]:
    """Joins spans of a text that touch or overlap."""
    order = np.lexsort((start, versions, ids))
    ids, versions, start, end = ids[order], versions[order], start[order], end[order]
    if not len(ids):
        return ids, versions, start, end
    other = (ids[1:] != ids[:-1]) | (versions[1:] != versions[:-1])
    base = np.cumsum(np.append(False, other)) * (int(end.max()) + 1)
    reach = np.maximum.accumulate(end + base)
    new = np.flatnonzero(np.append(True, (start + base)[1:] > reach[:-1]))
    last = np.append(new[1:], len(ids)) - 1
    return ids[new], versions[new], start[new], (reach - base)[last]


def _runs(docs: DataFrame, buckets: int) -> DataFrame:
    """Sorted, front-coded runs by bucket; a bucket of -1 holds the spans that are settled already."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for piece in tb.pieces(batches, "text"):
            found = Anchors(piece.column(2))
            data, offsets = found.data.tobytes(), found.offsets
            ids, versions = piece.column(0).to_numpy(), piece.column(1).to_numpy()
            lists = piece.column(3)
            counts = np.diff(lists.offsets.to_numpy())
            values = lists.flatten().to_numpy()
            wanted = (values >> 1) + np.repeat(offsets[:-1], counts)
            hot = dict(zip(wanted.tolist(), (values & 1).tolist(), strict=True))
            earliest: dict[tuple[bytes, bytes, int], tuple[int, int, int, int]] = {}
            settled = []
            for at, low, high, doc, seed in zip(found.at.tolist(), found.low.tolist(), found.high.tolist(), found.doc.tolist(), found.hash.tolist(), strict=True):
                is_hot = hot.get(at)
                if is_hot is None:
                    continue
                key, version, begin = int(ids[doc]), int(versions[doc]), int(offsets[doc])
                for place, first, last in ((p, p, p) for p in range(low, high + 1)) if is_hot else ((at, low, high),):
                    entry = (data[place : last + WINDOW], data[first:place][::-1], version)
                    before = earliest.setdefault(entry, (key, place - begin, seed, is_hot))
                    if before[:2] == (key, place - begin):
                        continue
                    if before[:2] > (key, place - begin):
                        earliest[entry] = (key, place - begin, seed, is_hot)
                        key_, place_ = before[:2]
                    else:
                        key_, place_ = key, place - begin
                    settled.append((key_, version, place_ - (place - first), place_ + (last - place) + WINDOW))
            if settled:
                of, own, start, end = _spans(*(np.array(c, np.int64) for c in zip(*settled, strict=True)))
                row = {c: b"" for c in _RUN_KINDS} | {"bucket": -1, "ids": packed(of), "versions": packed(own), "at": packed(start), "left": packed(end)}
                yield pa.RecordBatch.from_pylist([row], schema)
            split: dict[int, list] = {}
            for entry, (key, place, seed, is_hot) in earliest.items():
                bucket = zlib.crc32(entry[0]) % buckets if is_hot else seed % buckets
                split.setdefault(bucket, []).append((*entry, key, place))
            out = []
            for bucket, entries in split.items():
                entries.sort()
                shared, rest, lengths = _front_coded([e[0] for e in entries])
                cells = {
                    "ids": np.array([e[3] for e in entries], np.int64), "at": np.array([e[4] for e in entries], np.int64),
                    "versions": np.array([e[2] for e in entries], np.int64),
                    "shared": shared, "rest": np.frombuffer(rest, np.uint8), "lengths": lengths,
                    "left": np.frombuffer(b"".join(e[1] for e in entries), np.uint8), "lefts": np.array([len(e[1]) for e in entries], np.uint8),
                }
                out.append({"bucket": bucket, **{c: packed(x) for c, x in cells.items()}})
            if out:
                yield pa.RecordBatch.from_pylist(out, schema)

    schema = pa.schema([("bucket", pa.int32()), *((c, pa.binary()) for c in _RUN_KINDS)])
    return docs.mapInArrow(run, _RUN)


def _repeats(runs: DataFrame) -> DataFrame:
    """Spans of the windows that start earlier elsewhere, from the merged runs of each bucket."""

    def resolve(table: pa.Table) -> pa.Table:
        cells = {c: [unpacked(b, kind) for b in table.column(c).to_pylist()] for c, kind in _RUN_KINDS.items()}
        strings = [_decoded(a, b.tobytes(), c) for a, b, c in zip(cells["shared"], cells["rest"], cells["lengths"], strict=True)]
        base = np.cumsum([0, *(len(s) for s in strings)])
        order = np.empty(base[-1], np.int64)
        right = np.empty(base[-1], np.int64)
        runs = [(s, p.tolist()) for s, p in zip(strings, cells["shared"], strict=True)]
        for i, (run, place, shared) in enumerate(merged(runs)):
            order[i], right[i] = base[run] + place, shared
        lefts = np.concatenate(cells["lefts"]).astype(np.int64)
        left_end = np.cumsum(lefts)
        left_bytes = np.concatenate(cells["left"]).tobytes()
        right[:1] = -1
        group = np.cumsum(right < SEED)
        shared_seed = np.bincount(group)[group] > 1
        order, right, group = order[shared_seed], right[shared_seed], group[shared_seed]
        ids, versions, at = (np.concatenate(cells[c])[order] for c in ("ids", "versions", "at"))
        size = np.concatenate([np.array([len(x) for x in s], np.int64) for s in strings])[order]
        reach = lefts[order]
        left = [left_bytes[e - n : e] for e, n in zip(left_end[order].tolist(), reach.tolist(), strict=True)]
        n = len(order)
        by_left = np.array(sorted(range(n), key=lambda i: (group[i], left[i])), np.int64)
        shared_left = neighbour_prefixes([left[i] for i in by_left])
        shared_left[np.append(True, group[by_left][1:] != group[by_left][:-1])[:n]] = -1
        by_place = np.lexsort((at, ids))
        moved = (np.diff(ids[by_place], prepend=0) != 0) | (np.diff(at[by_place], prepend=0) != 0)
        rank = np.empty(n, np.int64)
        rank[by_place] = np.cumsum(moved)
        of, own, start = [], [], []
        left_class = np.empty(n, np.int64)
        for o in range(_REACH + 1):
            some = by_place[((reach >= o) & (size >= WINDOW - o))[by_place]]
            if len(some) < 2:
                continue
            left_class[by_left] = np.cumsum(shared_left < o)
            key = np.cumsum(right < WINDOW - o)[some] * (n + 1) + left_class[some]
            _, first, which = np.unique(key, return_index=True, return_inverse=True)
            later = some[rank[some] > rank[some[first[which]]]]
            of.append(ids[later])
            own.append(versions[later])
            start.append(at[later] - o)
        none = np.zeros(0, np.int64)
        of, own, start = (np.concatenate([none, *x]) for x in (of, own, start))
        return pa.table(dict(zip(_SPAN_NAMES, _spans(of, own, start, start + WINDOW), strict=True)))

    return runs.groupBy("bucket").applyInArrow(resolve, _SPAN)


def repeated_spans(docs: DataFrame, hot: int = HOT) -> DataFrame:
    """``doc_id, version, start, end`` of bytes to remove from ``docs`` (``doc_id, version, text``); spans may overlap."""
    texts = docs.select("doc_id", "version", "text").filter(F.col("doc_id").isNotNull() & (F.octet_length("text") >= WINDOW))
    buckets = key_buckets(docs.sparkSession)
    anchors = stored(_seed_counts(texts, buckets, hot))
    by_doc = anchors.groupBy("doc_id", "version").agg(F.collect_list("anchor").alias("anchors"))
    wanted = likely(texts, anchors, "doc_id").join(by_doc, ["doc_id", "version"])
    runs = stored(_runs(wanted.select("doc_id", "version", "text", "anchors"), buckets))

    def settled(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                yield pa.record_batch([pa.array(unpacked(row[c], np.int64)) for c in ("ids", "versions", "at", "left")], _SPAN_NAMES)

    known = runs.filter("bucket < 0").select("ids", "versions", "at", "left").mapInArrow(settled, _SPAN)
    return _repeats(runs.filter("bucket >= 0")).union(known)


def without_repeats(docs: DataFrame, hot: int = HOT) -> DataFrame:
    """``doc_id, n_bytes, spans, n_removed, kept`` for every row of ``docs`` (``doc_id, text``).

    ``spans`` are the maximal runs of removed bytes, ``kept`` the remaining bytes one after the other.
    """
    docs = text_batches(docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")))
    versions = versioned(docs)
    found = stored(repeated_spans(versions, hot))
    by_doc = found.groupBy("doc_id", "version").agg(F.collect_list(F.struct("start", "end")).alias("found"))

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for text, spans in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True):
                data = text.encode()
                start, end = (np.array([s[c] for s in spans or ()], np.int64) for c in ("start", "end"))
                none = np.zeros(len(start), np.int64)
                _, _, start, end = _spans(none, none, start, end)
                edges = [0, *np.stack([start, end], axis=1).ravel().tolist(), len(data)]
                kept = b"".join(data[a:b] for a, b in zip(edges[::2], edges[1::2], strict=True))
                runs = [{"start": a, "end": b} for a, b in zip(start.tolist(), end.tolist(), strict=True)]
                rows.append((len(data), runs, len(data) - len(kept), kept))
            columns = list(zip(*rows, strict=True)) or [()] * 4
            yield pa.record_batch([batch.column(0), *(pa.array(c, t) for c, t in zip(columns, kinds, strict=True))], names)

    names = ["doc_id", "n_bytes", "spans", "n_removed", "kept"]
    span = pa.struct([("start", pa.int64()), ("end", pa.int64())])
    kinds = [pa.int64(), pa.list_(span), pa.int64(), pa.binary()]
    schema = "doc_id long, n_bytes long, spans array<struct<start: long, end: long>>, n_removed long, kept binary"
    touched = likely(versions.filter("doc_id IS NOT NULL"), found, "doc_id").join(by_doc, ["doc_id", "version"], "left")
    whole = F.encode("text", "UTF-8")
    rest = likely(docs, found, "doc_id", inside=False).select(
        "doc_id", F.octet_length("text").cast("long").alias("n_bytes"),
        F.array().cast("array<struct<start: bigint, end: bigint>>").alias("spans"), F.lit(0).cast("long").alias("n_removed"), whole.alias("kept"),
    )
    return touched.select("doc_id", "text", "found").mapInArrow(cut, schema).union(rest)

"""Byte-level BPE encoding and decoding with a rank queue on a hierarchical bitmap.

Each merge rank has a bucket of positions in the linked list of tokens. Two levels of bitmaps mark the
ranks with a filled bucket, and find-first-set gives the lowest of them, so the next merge costs the
same for a pre-token of ten bytes or ten million. A position whose pair has changed since it was put
into a bucket is skipped when it comes up.

The result equals the tiktoken library's: each match of the pattern is encoded by itself, the pair with
the lowest rank is merged first, the leftmost of equals before the others. A null or empty text has no
tokens. Every document is encoded for itself, so repeated rows and other columns play no part.

A worker remembers recent pre-tokens with their ids written out and the bytes decoded from them, so a text
joins pre-tokens and not tokens. Both the number of them and their length are bounded.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator, Sequence
from heapq import heappop, heappush

import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession

from orderloom.llm.store import text_batches

#: Pre-tokens remembered by a Python worker in each of two generations, and the letters each may have.
REMEMBERED = 400_000
_LONGEST = 64
#: Ranks are marked in groups of 2**_GROUP.
_GROUP = 8
_LAST = (1 << _GROUP) - 1


def read_ranks(spark: SparkSession, path: str) -> list[bytes]:
    """Tokens in order of rank from a file of lines ``base64 rank`` (a vocabulary has a fixed size)."""
    with open(path, "rb") as file:
        pairs = [line.split() for line in file if line.strip()]
    tokens = {int(rank): base64.b64decode(token) for token, rank in pairs}
    if sorted(tokens) != list(range(len(tokens))):
        raise ValueError("ranks must be gapless from 0")
    return [tokens[i] for i in range(len(tokens))]


class Encoder:
    """Encodes pre-tokens with given tokens in order of rank."""

    def __init__(self, tokens: list[bytes], pattern: str, remembered: int = REMEMBERED):
        self.tokens = tokens
        self.remembered = remembered
        self.texts = [str(i) for i in range(len(tokens))]
        rank = {token: i for i, token in enumerate(tokens)}
        self.rank = rank
        self.bytes = [rank[bytes([i])] for i in range(256)]
        self.shift = max(1, (len(tokens) - 1).bit_length())
        # Every pair of tokens whose bytes together are a token: merging it gives that token.
        self.pairs = {}
        for merged, token in enumerate(tokens):
            for cut in range(1, len(token)):
                left, right = rank.get(token[:cut]), rank.get(token[cut:])
                if left is not None and right is not None:
                    self.pairs[left << self.shift | right] = merged
        self.split = regex.compile(pattern).findall
        self.buckets: list[list[int]] = [[] for _ in tokens]
        self.low = [0] * ((len(tokens) >> _GROUP) + 1)
        # Pre-token: its number of tokens, their ids joined by commas after a comma, their bytes.
        self.young: dict[str, tuple[int, str, bytes]] = {}
        self.old: dict[str, tuple[int, str, bytes]] = {}

    def merge(self, data: bytes) -> tuple[int, ...]:
        """The tokens of one pre-token."""
        whole = self.rank.get(data)
        if whole is not None:
            return (whole,)
        find, shift, buckets, low = self.pairs.get, self.shift, self.buckets, self.low
        start = self.bytes
        ids = [start[b] for b in data]
        n = len(ids)
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        ranks = [-1] * n  # of the pair that begins here
        high = live = 0  # live: positions with a pair to merge; all other entries are stale
        filled = []
        left = ids[0]
        for i in range(n - 1):
            right = ids[i + 1]
            r = find(left << shift | right)
            left = right
            if r is not None:
                ranks[i] = r
                live += 1
                bucket = buckets[r]
                if not bucket:
                    filled.append(r)
                    low[r >> _GROUP] |= 1 << (r & _LAST)
                    high |= 1 << (r >> _GROUP)
                bucket.append(i)  # in order, so the list is a heap
        while live:
            group = (high & -high).bit_length() - 1
            bits = low[group]
            r = (group << _GROUP) + (bits & -bits).bit_length() - 1
            bucket = buckets[r]
            if len(bucket) > 1:
                i = heappop(bucket)
            else:
                i = bucket.pop()
                bits &= bits - 1
                low[group] = bits
                if not bits:
                    high &= high - 1
            if ranks[i] != r:
                continue  # stale
            j = after[i]
            k = after[j]
            ids[i] = r
            live -= 1 if ranks[j] < 0 else 2
            ids[j] = ranks[j] = ranks[i] = -1
            after[i] = k
            if k < n:
                before[k] = i
                s = find(r << shift | ids[k])
                if s is not None:
                    ranks[i] = s
                    live += 1
                    bucket = buckets[s]
                    if not bucket:
                        filled.append(s)
                        low[s >> _GROUP] |= 1 << (s & _LAST)
                        high |= 1 << (s >> _GROUP)
                        bucket.append(i)
                    else:
                        heappush(bucket, i)
            h = before[i]
            if h >= 0:
                s = find(ids[h] << shift | r)
                if s is None:
                    if ranks[h] >= 0:
                        live -= 1
                        ranks[h] = -1
                elif ranks[h] != s:
                    if ranks[h] < 0:
                        live += 1
                    ranks[h] = s
                    bucket = buckets[s]
                    if not bucket:
                        filled.append(s)
                        low[s >> _GROUP] |= 1 << (s & _LAST)
                        high |= 1 << (s >> _GROUP)
                        bucket.append(h)
                    else:
                        heappush(bucket, h)
        for r in filled:
            buckets[r].clear()
            low[r >> _GROUP] = 0
        return tuple([i for i in ids if i >= 0])

    def _remember(self, word: str) -> tuple[int, str, bytes]:
        known = self.old.get(word)
        if known is None:
            ids = self.merge(word.encode())
            known = (len(ids), "," + ",".join(map(self.texts.__getitem__, ids)), self.decode(ids))
        if len(word) <= _LONGEST:
            if len(self.young) >= self.remembered:
                self.old, self.young = self.young, {}
            self.young[word] = known
        return known

    def coded(self, text: str) -> tuple[int, str, bytes]:
        """Number of tokens of a text, their ids joined by commas, and the bytes decoded from them."""
        get, remember = self.young.get, self._remember
        out = []
        for word in self.split(text):
            known = get(word)
            if known is None:
                known = remember(word)
                get = self.young.get
            out.append(known)
        if not out:
            return 0, "", b""
        counts, said, data = zip(*out, strict=True)
        return sum(counts), "".join(said)[1:], b"".join(data)

    def decode(self, ids: Sequence[int]) -> bytes:
        return b"".join(map(self.tokens.__getitem__, ids))


_encoders: dict[tuple, Encoder] = {}


def shared_encoder(tokens: list[bytes], pattern: str, remembered: int = REMEMBERED) -> Encoder:
    """The encoder of this Python worker, with the pre-tokens it remembers from earlier tasks."""
    key = (pattern, remembered, tuple(tokens))
    if key not in _encoders:
        _encoders.clear()
        _encoders[key] = Encoder(tokens, pattern, remembered)
    return _encoders[key]


def with_tokens(docs: DataFrame, tokens: list[bytes], pattern: str, arrays: bool = True, remembered: int = REMEMBERED) -> DataFrame:
    """Encodes and decodes every text: ``doc_id, n_tokens, ids_sha256, decoded_sha256`` and the ids.

    ``ids_sha256`` is the hash of the decimal ids joined by commas, ``decoded_sha256`` that of the
    bytes decoded from the ids. ``arrays`` adds the ids themselves as ``ids`` (array<int>). ``remembered``
    pre-tokens of at most 64 letters, some 300 bytes each, are kept by a worker in each of two generations.
    """
    shared = docs.sparkSession.sparkContext.broadcast((tokens, pattern, remembered))  # a vocabulary: fixed size

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = shared_encoder(*shared.value)
        for batch in batches:
            column = batch.column(1)
            for start in range(0, batch.num_rows, 256):
                rows = []
                for text in column.slice(start, 256).to_pylist():
                    n, ids, data = encoder.coded(text or "")
                    digest = hashlib.sha256(ids.encode()).hexdigest()
                    listed = ([int(i) for i in ids.split(",")] if n else []) if arrays else None
                    rows.append((n, digest, hashlib.sha256(data).hexdigest(), listed))
                part = batch.column(0).slice(start, 256)
                out = [part, pa.array([r[0] for r in rows], pa.int64()), pa.array([r[1] for r in rows]), pa.array([r[2] for r in rows])]
                names_out = ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"]
                if arrays:
                    out.append(pa.array([r[3] for r in rows], pa.list_(pa.int32())))
                    names_out.append("ids")
                yield pa.record_batch(out, names_out)

    schema = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string" + (", ids array<int>" if arrays else "")
    return text_batches(docs).select("doc_id", "text").mapInArrow(run, schema)


def decoded(encoded: DataFrame, tokens: list[bytes]) -> DataFrame:
    """The bytes of each row's ``ids`` (null: none), as column ``data``."""
    shared = encoded.sparkSession.sparkContext.broadcast(tokens)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data = [b"".join(map(shared.value.__getitem__, ids or ())) for ids in batch.column(1).to_pylist()]
            yield pa.record_batch([batch.column(0), pa.array(data, pa.binary())], ["doc_id", "data"])

    return encoded.select("doc_id", "ids").mapInArrow(run, "doc_id long, data binary")

"""SimHash near-duplicates by deletion-variant signatures.

A text's fingerprint has 64 bits: bit b is 1 when it is set in over half of the hashes of the text's word
shingles. Texts whose fingerprints differ in at most ``distance`` bits are linked.

A fingerprint is cut into so few segments that in one of them two linked ones differ by at most a single
bit (three for four bits; five would be needed for an equal segment). Each segment is indexed once for
every one of its bits, with that bit as a wildcard, so two segments within one bit share the entry of
the differing bit. Entries are joined on equality and verified on the whole fingerprint.

1. Rows with equal fingerprints are one class.
2. The members of a bucket of two or three are compared at once. In a larger bucket each member is
   compared with one hub only, drawn by hash, so a fingerprint meets another hub in each of its
   buckets; the links found give first components. In buckets that hold several components this is
   done ``TURNS`` more times.
3. Buckets that still hold several components are searched whole for links between different ones, from
   the members outside the bucket's largest component. A bucket of near copies that are already linked
   costs nothing more, so no pairs within a group are formed; no link between components is lost.

A null text, or one without words, has fingerprint zero and is linked like any other. A row without
doc_id has a fingerprint but no component, and links nothing. Rows with one doc_id are versions of one
document, each linked for itself; an empty table gives an empty result. Other columns play no part.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from orderloom.llm import textbits as tb
from orderloom.llm.components import components
from orderloom.llm.store import stored, text_batches

BITS = 64
#: Shingles hashed at a time, so memory does not follow the longest text.
_BLOCK = 1 << 15
_HASH_SEED = 42
#: Further turns with other hubs before the search between components; they only save it work.
TURNS = 1


def _joined(column: pa.Array) -> tuple[bytes, np.ndarray, np.ndarray, np.ndarray]:
    """All words with one blank after each, their starts and ends there, and the first word of each text."""
    data, offsets = tb.texts(column)
    low = tb.LOWER[data]
    starts, ends, first = tb.word_bounds(low, offsets)
    size = ends - starts
    to = np.concatenate([np.zeros(1, np.int64), np.cumsum(size + 1)])
    out = np.full(to[-1], 32, np.uint8)
    word = np.repeat(np.arange(len(size)), size)
    inside = np.arange(len(word)) - np.repeat(np.cumsum(size) - size, size)
    out[to[word] + inside] = low[starts[word] + inside]
    return out.tobytes(), to[:-1], to[:-1] + size, first


def fingerprints(column: pa.Array, words: int = 4) -> np.ndarray:
    """The fingerprint of each text: majority bits of the XXH64 hashes of its shingles, repeats included."""
    data, starts, ends, first = _joined(column)
    counts = np.diff(first)
    n = np.where(counts == 0, 0, np.maximum(counts - words + 1, 1))
    until = np.cumsum(n)
    total = int(until[-1]) if len(until) else 0
    ones = np.zeros((len(n), BITS), np.int64)
    digest = xxhash.xxh64_intdigest
    for low in range(0, total, _BLOCK):
        at = np.arange(low, min(low + _BLOCK, total))
        doc = np.searchsorted(until, at, side="right")
        a = first[doc] + at - (until - n)[doc]
        b = np.minimum(a + words, first[doc + 1]) - 1
        said = [digest(data[x:y], _HASH_SEED) for x, y in zip(starts[a].tolist(), ends[b].tolist(), strict=True)]
        bits = np.unpackbits(np.array(said, np.uint64).astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        new = np.flatnonzero(np.append(True, doc[1:] != doc[:-1]))
        ones[doc[new]] += np.add.reduceat(bits, new, axis=0, dtype=np.int64)
    set_bits = (2 * ones > n[:, None]).astype(np.uint8)
    return np.packbits(set_bits, axis=1, bitorder="little").reshape(-1).view("<u8").astype(np.uint64)


def with_fingerprints(docs: DataFrame, words: int = 4) -> DataFrame:
    """``doc_id, fp`` (the fingerprint as a signed number) for every row of ``docs`` (``doc_id, text``)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for piece in tb.pieces(batches, "text"):
            yield pa.record_batch([piece.column(0), pa.array(fingerprints(piece.column(1), words).view(np.int64))], ["doc_id", "fp"])

    return text_batches(docs).select("doc_id", "text").mapInArrow(run, "doc_id long, fp long")


def _segments(distance: int) -> list[tuple[int, int]]:
    """Lowest bit and width of each segment: so many that one holds at most one of the differing bits."""
    n = distance // 2 + 1
    edges = [BITS * i // n for i in range(n + 1)]
    return [(a, b - a) for a, b in zip(edges, edges[1:], strict=False)]


def _variants(fps: DataFrame, distance: int) -> DataFrame:
    """``fp, key``: an entry for each bit of each segment, with that bit as a wildcard."""
    keys = []
    for low, width in _segments(distance):
        for wild in range(width):
            mask = ((1 << width) - 1) & ~(1 << wild)
            signed = mask - (1 << BITS) if mask >> (BITS - 1) else mask
            segment = F.shiftrightunsigned("fp", low).bitwiseAND(F.lit(signed).cast("long"))
            # The segment and its wildcard are part of the key. Below 33 bits of width this is exact.
            keys.append(segment.bitwiseOR(F.shiftleft(F.lit(low + wild).cast("long"), 33)))
    return fps.select("fp", F.explode(F.array(*keys)).alias("key"))


def _close(a: str, b: str, distance: int):
    return F.bit_count(F.col(a).bitwiseXOR(F.col(b))) <= distance


def _drawn(turn: int, *more: str):
    """The member of a bucket with the smallest hash, another one in every bucket and turn."""
    return F.min(F.struct(F.xxhash64("key", "fp", F.lit(turn)).alias("draw"), "fp", *more))


def _by_key(rows: DataFrame, buckets: DataFrame, on="key") -> DataFrame:
    """Inner join of ``rows``, one for every bucket and member, that never broadcasts them.

    Spark takes their size from the fingerprints before they are exploded, or from files in which keys and
    hubs repeat and so take next to no room; it would send many times what it expects through the driver.
    """
    return rows.join(buckets.hint("merge"), on)


def linked(fps: DataFrame, distance: int = 4) -> DataFrame:
    """``fp, component`` for the distinct ``fp`` that have links; equal components are connected."""
    entries = _variants(fps, distance)
    buckets = entries.groupBy("key").agg(
        F.count("*").alias("size"), F.min("fp").alias("x"), F.max("fp").alias("y"), F.bit_xor("fp").alias("all"), _drawn(0).alias("first")
    )
    buckets = stored(buckets.filter("size > 1").select("key", "size", "x", "y", "all", F.col("first.fp").alias("hub")))
    # Up to three members are known from the bucket itself: the smallest, the largest, and what is left of all.
    few = buckets.filter("size <= 3").withColumn("z", F.when(F.col("size") == 3, F.expr("all ^ x ^ y")))
    pairs = F.array(*[F.struct(F.col(a).alias("a"), F.col(b).alias("b")) for a, b in ("xy", "xz", "yz")])
    near = F.filter(pairs, lambda p: F.coalesce(F.bit_count(p["a"].bitwiseXOR(p["b"])) <= distance, F.lit(False)))
    small = few.select(F.explode(near).alias("p")).select("p.*")
    hubs = buckets.filter("size > 3").select("key", "hub")
    members = stored(_by_key(entries, hubs))
    first = members.filter(F.col("fp") != F.col("hub")).filter(_close("fp", "hub", distance))
    links = stored(small.union(first.select("fp", "hub")).distinct())
    labels = components(links).withColumnRenamed("id", "fp")
    grouped = stored(members.select("key", "fp").join(labels, "fp", "left").select("key", "fp", F.coalesce("component", "fp").alias("group")))
    for turn in range(1, TURNS + 1):
        # Only links between components are rows; a bucket within one component has no hub, so it meets none.
        drawn = grouped.groupBy("key").agg(F.min("group").alias("low"), F.max("group").alias("high"), _drawn(turn, "group").alias("first"))
        hub = drawn.filter("low <> high").select("key", F.col("first.fp").alias("hub"), F.col("first.group").alias("there"))
        met = _by_key(grouped, hub).filter(F.col("group") != F.col("there")).filter(_close("fp", "hub", distance))
        # A component is named by one of its fingerprints, so links of components are links as well.
        found = stored(met.select(F.col("group").alias("a"), F.col("there").alias("b")).distinct())
        links = links.union(found)
        merged = components(found).select(F.col("id").alias("group"), F.col("component").alias("next"))
        grouped = stored(grouped.join(merged, "group", "left").select("key", "fp", F.coalesce("next", "group").alias("group")))
    sizes = grouped.groupBy("key", "group").agg(F.count("*").alias("size"))
    most = F.max(F.struct("size", "group")).alias("most")
    several = sizes.groupBy("key").agg(F.count("*").alias("groups"), most).filter("groups > 1").select("key", F.col("most.group").alias("major"))
    minor = _by_key(grouped, stored(several)).filter(F.col("group") != F.col("major"))
    minor = minor.select(F.col("key").alias("at"), F.col("fp").alias("x"), F.col("group").alias("mine"))
    unlike = (F.col("key") == F.col("at")) & (F.col("mine") != F.col("group")) & _close("x", "fp", distance)
    more = stored(_by_key(grouped, minor, unlike).select(F.col("mine").alias("a"), F.col("group").alias("b")).distinct())
    return components(links.union(more)).withColumnRenamed("id", "fp")


def near_duplicates(docs: DataFrame, words: int = 4, distance: int = 4) -> DataFrame:
    """``doc_id, fingerprint, component_id`` for every row of ``docs`` (``doc_id, text``).

    ``fingerprint`` has 16 lowercase hex digits; ``component_id`` is the smallest doc_id reachable.
    """
    rows = stored(with_fingerprints(docs, words))
    classes = stored(rows.filter("doc_id IS NOT NULL").groupBy("fp").agg(F.min("doc_id").alias("id")))
    labels = classes.join(linked(classes.select("fp"), distance), "fp", "left").select("fp", "id", F.coalesce("component", "fp").alias("component"))
    labels = stored(labels)
    smallest = labels.groupBy("component").agg(F.min("id").alias("component_id"))
    heads = labels.join(smallest, "component").select("fp", "component_id")
    out = rows.join(heads, "fp", "left")
    component = F.when(F.col("doc_id").isNotNull(), F.col("component_id"))
    return out.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), component.alias("component_id"))

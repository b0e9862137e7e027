"""Near-duplicate documents by SuperMinHash, banding, exact verification and union-find grouping.

SuperMinHash gives each element of a set one random permutation of the signature's positions, drawn
step by step; the value of step j lies in [j, j + 1). A position takes the smallest value it is given,
so nothing can improve it after the step that first filled it, and drawing stops once all positions of
the document are filled. The draws of one step are made for all elements of a slice at once.

Documents with equal sets form one class before any comparison. Classes that share a band are
candidates. A bucket of candidates never forms all its pairs: its members are compared with one hub, the
smallest. Of the others only links with members outside the hub's group are still to be found. Such a
member x differs from the hub h by more than a link allows, and two members are linked only if their
differences from the hub overlap: with D = x ^ h, a link of x and y needs

    |x ^ y| = |Dx| + |Dy| - 2 * |Dx & Dy| <= (|x| + |y|) * (1 - s) / (1 + s)

so they meet on a shingle of both differences, early enough in an order by frequency for the rest to hold
the overlap. Each link is confirmed on the full sets.

Rows with one doc_id are one document in several rows. Texts that are null or without words have the
empty set and are linked with nothing; so are rows without doc_id, whose component is null and which
are kept. An empty table gives an empty result. Other columns play no part.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from orderloom.llm import textbits as tb
from orderloom.llm.components import components
from orderloom.llm.store import likely, stored, text_batches

#: 30 bands of 5 values miss a pair of similarity 0.8 with probability 7e-6.
BANDS, BAND_ROWS = 30, 5
#: Shingles that are ranked by their frequency in differences; all others come before them. The result is
#: the same for any order, and so for any number.
RANKED = 65_536
_LOW32 = np.uint64(0xFFFFFFFF)
_STEP = np.uint64(0x9E3779B97F4A7C15)
_EMPTY = np.uint64(0xFFFFFFFFFFFFFFFF)


def superminhash(elements: np.ndarray, bounds: np.ndarray, size: int) -> np.ndarray:
    """Signatures of sets that follow one another in ``elements``; ``size`` is at most 256."""
    n = np.diff(bounds)
    out = np.full(len(n) * size, _EMPTY, np.uint64)
    doc = np.repeat(np.arange(len(n)), n)
    permutation = None
    for j in range(size):
        z = tb.mix(elements + np.uint64((j + 1) * int(_STEP) % (1 << 64)))
        k = j + (((z & _LOW32) * np.uint64(size - j)) >> np.uint64(32)).astype(np.int64)
        if permutation is None:
            place = k
        else:
            row = np.arange(len(k))
            place = permutation[row, k].astype(np.int64)
            permutation[row, k] = permutation[row, j]
            permutation[row, j] = place
        np.minimum.at(out, doc * size + place, (z >> np.uint64(32)) | np.uint64(j << 32))
        unfilled = (out.reshape(len(n), size) == _EMPTY).any(axis=1)
        more = unfilled[doc]
        if not more.any():
            break
        elements, doc = elements[more], doc[more]
        if permutation is None:
            permutation = np.tile(np.arange(size, dtype=np.uint8), (len(doc), 1))
            first = k[more]
            row = np.arange(len(first))
            permutation[row, first] = 0
            permutation[row, 0] = first
        else:
            permutation = permutation[more]
    return out.reshape(len(n), size)


def _sums(values: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    total = np.concatenate([np.zeros(1, np.uint64), np.cumsum(values, dtype=np.uint64)])
    return total[bounds[1:]] - total[bounds[:-1]]


def _features(docs: DataFrame, words: int, bands: int, rows: int) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for piece in tb.pieces(batches, "text"):
            sets, bounds = tb.shingle_sets(piece.column(1), words)
            n = np.diff(bounds)
            values = superminhash(sets, bounds, bands * rows).reshape(len(n), bands, rows)
            key = np.broadcast_to(np.arange(1, bands + 1, dtype=np.uint64) * _STEP, (len(n), bands)).copy()
            for i in range(rows):
                key = tb.mix(key + values[:, :, i])
            s1, s2 = _sums(tb.mix(sets), bounds), _sums(tb.mix(sets * _STEP + np.uint64(1)), bounds)
            yield pa.record_batch(
                [piece.column(0), pa.array(n), pa.array(s1.view(np.int64)), pa.array(s2.view(np.int64)),
                 pa.FixedSizeListArray.from_arrays(pa.array(key.reshape(-1).view(np.int64)), bands).cast(pa.list_(pa.int64()))],
                ["doc_id", "n_shingles", "s1", "s2", "bands"],
            )

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, n_shingles long, s1 long, s2 long, bands array<long>")


def _sets(docs: DataFrame, words: int) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for piece in tb.pieces(batches, "text"):
            sets, bounds = tb.shingle_sets(piece.column(1), words)
            lists = pa.ListArray.from_arrays(pa.array(bounds, pa.int32()), pa.array(sets.view(np.int64)))
            yield pa.record_batch([piece.column(0), lists], ["id", "shingles"])

    return docs.select("doc_id", "text").mapInArrow(run, "id long, shingles array<long>")


def _confirmed(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs whose full sets are similar enough."""
    x = sets.select(F.col("id").alias("a"), F.col("shingles").alias("x"))
    y = sets.select(F.col("id").alias("b"), F.col("shingles").alias("y"))
    common = F.size(F.array_intersect("x", "y"))
    held = pairs.join(x, "a").join(y, "b").withColumn("common", common)
    return held.filter(100 * F.col("common") >= percent * (F.size("x") + F.size("y") - F.col("common"))).select("a", "b")


def _difference_entries(differences: DataFrame, percent: int) -> DataFrame:
    """The rarer shingles of each member's difference from its hub, as far as a link may first meet."""
    seen = differences.select(F.explode("diff").alias("token")).groupBy("token").agg(F.count("*").alias("f")).filter("f > 1")
    common = [r["token"] for r in seen.orderBy(F.desc("f"), "token").limit(RANKED).select("token").collect()]
    by_token = np.argsort(np.array(common, np.int64))
    ranks = differences.sparkSession.sparkContext.broadcast((np.array(common, np.int64)[by_token], len(common) - by_token))
    names = ["hub", "id", "n", "group", "minor"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokens, rank = ranks.value
        for batch in batches:
            lists = batch.column(len(names))
            d = np.diff(lists.offsets.to_numpy())
            values = lists.flatten().to_numpy()
            member = np.repeat(np.arange(len(d)), d)
            place = np.minimum(np.searchsorted(tokens, values), max(len(tokens) - 1, 0))
            own = np.where(tokens[place] == values, rank[place], 0) if len(tokens) else np.zeros(len(values), np.int64)
            order = np.lexsort((values, own, member))
            at = np.arange(len(values)) - np.repeat(np.cumsum(d) - d, d)
            # The partner has at most 100 / percent times as many shingles.
            most = batch.column(2).to_numpy() * (100 + percent) * (100 - percent) // (percent * (100 + percent))
            some = at <= most[member]
            take = pa.array(member[some])
            yield pa.record_batch(
                [*(batch.column(i).take(take) for i in range(len(names))), pa.array(values[order][some]), pa.array(at[some]), pa.array(d[member[some]].astype(np.int64))],
                [*names, "token", "at", "d"],
            )

    return differences.select(*names, "diff").mapInArrow(run, "hub long, id long, n long, group long, minor boolean, token long, at long, d long")


def near_duplicates(docs: DataFrame, words: int = 5, percent: int = 80, bands: int = BANDS, band_rows: int = BAND_ROWS) -> DataFrame:
    """``doc_id, n_shingles, component_id, kept`` for every row of ``docs`` (``doc_id, text``)."""
    docs = text_batches(docs)
    features = stored(_features(docs, words, bands, band_rows))
    sized = features.filter("n_shingles > 0 AND doc_id IS NOT NULL")
    classes = sized.groupBy("s1", "s2", "n_shingles").agg(F.min("doc_id").alias("id"), F.first("bands").alias("bands"))
    classes = stored(classes)
    entries = classes.select(F.explode("bands").alias("key"), "id", F.col("n_shingles").alias("n"))
    hub = F.min(F.struct("id", "n"))
    buckets = entries.groupBy("key").agg(F.count("*").alias("size"), hub.alias("hub")).filter("size > 1")
    members = stored(entries.join(buckets.select("key", "hub"), "key"))

    def fitting(n: str, m: str):
        return F.expr(f"100 * least({n}, {m}) >= {percent} * greatest({n}, {m})")

    wanted = members.filter("id <> hub.id").filter(fitting("n", "hub.n"))
    tested = stored(wanted.select(F.col("id").alias("a"), F.col("hub.id").alias("b")).distinct())
    # A member whose hubs all have sets of other sizes may still match another member.
    needed = members.select(F.col("id").alias("doc_id")).distinct()
    sets = stored(_sets(likely(docs.select("doc_id", "text"), needed, "doc_id").join(needed, "doc_id", "left_semi"), words))
    links = stored(_confirmed(tested, sets, percent))

    labels = components(links)
    families = members.select(F.col("hub.id").alias("hub"), "id", "n").distinct().filter("id <> hub")
    group = F.coalesce("component", "id").alias("group")
    hub_group = labels.select(F.col("id").alias("hub"), F.col("component").alias("hub_group"))
    families = families.join(labels, "id", "left").select("hub", "id", "n", group).join(hub_group, "hub", "left")
    families = stored(families.withColumn("minor", F.col("group") != F.coalesce("hub_group", "hub")).drop("hub_group"))
    mixed = families.groupBy("hub").agg(F.count("*").alias("size"), F.max("minor").alias("any")).filter("size > 1 AND any").select("hub")
    x = sets.select("id", F.col("shingles").alias("x"))
    h = sets.select(F.col("id").alias("hub"), F.col("shingles").alias("h"))
    differences = families.join(mixed, "hub", "left_semi").join(x, "id").join(h, "hub")
    differences = stored(differences.withColumn("diff", F.concat(F.array_except("x", "h"), F.array_except("h", "x"))).drop("x", "h"))
    if not differences.isEmpty():
        entries = stored(_difference_entries(differences, percent))
        others = entries.select("hub", "token", *(F.col(c).alias(f"{c}2") for c in ("id", "n", "group", "at", "d")))
        meets = F.expr(
            f"group <> group2 AND 2 * {100 + percent} * least(d - at, d2 - at2) >= {100 + percent} * (d + d2) - {100 - percent} * (n + n2)"
        )
        pairs = entries.filter("minor").join(others, ["hub", "token"]).filter(meets).filter(fitting("n", "n2"))
        pairs = pairs.select(F.greatest("id", "id2").alias("a"), F.least("id", "id2").alias("b")).distinct()
        links = links.union(stored(_confirmed(pairs.join(tested, ["a", "b"], "left_anti"), sets, percent)))

    labels = components(links)
    heads = classes.join(labels, "id", "left").select("s1", "s2", "n_shingles", F.coalesce("component", "id").alias("head"))
    out = features.drop("bands").join(heads, ["s1", "s2", "n_shingles"], "left")
    # Sets of rows without doc_id may equal others', but such rows stand alone.
    component = F.when(F.col("n_shingles") > 0, F.col("head")).otherwise(F.col("doc_id"))
    out = out.withColumn("component_id", F.when(F.col("doc_id").isNotNull(), component))
    return out.select("doc_id", "n_shingles", "component_id", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)).alias("kept"))

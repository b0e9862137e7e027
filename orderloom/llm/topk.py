"""Exact top-k search by inner product, one term at a time over the whole candidate set.

Candidates are packed into blocks that hold, for each term (dimension), its postings: the rows with a
weight other than zero, and the weights. Every block of queries meets every block of candidates once.
For each pair of blocks a dense score array is filled term by term from the postings; the best k of
each query are picked by partition selection. Blocks are dealt to groups of candidates and shares of
queries, each pair of which is one task: it merges the picks of its blocks, and a last step those of all
groups. The pairs are a Cartesian product, so no side is broadcast and each is shuffled once.

Weights are integers. Vectors that are null or hold a null or non-finite component take no part, nor do
rows without an identifier. Components that a shorter vector lacks count as zero. All rows with a
query's own identifier are left out of its candidates; a repeated query row counts once (the smallest
vector), repeated candidate rows count each. An empty table gives an empty result.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from orderloom.session import materialise

BLOCK_ROWS = 8192
QUERY_ROWS = 256
CELLS = 1 << 20
#: Candidates are dealt to so many groups, or to more if one would hold more bytes; groups times shares of queries are at most TASKS.
GROUPS, GROUP_BYTES, TASKS = 16, 1 << 25, 4096
#: Blocks whose picks are kept side by side before they are merged.
PICKS = 64
_KINDS = (np.int8, np.int16, np.int32, np.int64)


def quantised(vector: Column, scale: int = 64) -> Column:
    """floor(scale * x) for each component, as whole numbers.

    An inner product has to fit in 64 bits, or it would be wrong without a word: a vector whose squared
    length could exceed 2**62 ends the query with an error.
    """
    whole = F.transform(vector, lambda x: F.floor(x.cast("double") * scale))
    largest = F.aggregate(vector, F.lit(0.0), lambda a, x: F.greatest(a, F.abs(x.cast("double") * scale) + 1))
    fits = largest * largest * F.size(vector) < float(1 << 62)
    message = F.lit("a component is too large for whole scores of 64 bits")
    return F.when(fits, F.transform(whole, lambda x: x.cast("long"))).otherwise(F.raise_error(message).cast("array<bigint>"))


def usable(vector: Column) -> Column:
    """True for a vector without null or non-finite components."""
    fine = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(math.inf)))
    return F.coalesce(vector.isNotNull() & fine, F.lit(False))


def _packed(rows: DataFrame, blocks: int, name: str) -> DataFrame:
    """One row per block: its identifiers and its vectors as a dense matrix of small numbers, by a hash of the row."""

    def pack(table: pa.Table) -> pa.Table:
        ids = table.column("id").to_numpy()
        lists = table.column("v").combine_chunks()
        lengths = np.diff(lists.offsets.to_numpy())
        width = int(lengths.max()) if len(lengths) else 0
        matrix = np.zeros((len(ids), width), np.int64)
        row = np.repeat(np.arange(len(ids)), lengths)
        matrix[row, np.arange(len(row)) - np.repeat(np.cumsum(lengths) - lengths, lengths)] = lists.flatten().to_numpy()
        low, high = matrix.min(initial=0), matrix.max(initial=0)
        cells = matrix.astype(next(kind for kind in _KINDS if np.iinfo(kind).min <= low and high <= np.iinfo(kind).max))
        numbers = {"width": pa.array([width], pa.int32()), "bytes": pa.array([cells.itemsize], pa.int32())}
        return pa.table({name: table.column("block")[:1], "ids": [ids.tobytes()], "cells": [cells.tobytes()], **numbers})

    # The salt spreads rows that share an identifier.
    block = F.pmod(F.xxhash64("id", F.monotonically_increasing_id()), F.lit(blocks)).cast("int")
    schema = f"{name} int, ids binary, cells binary, width int, bytes int"
    return materialise(rows.withColumn("block", block).groupBy("block").applyInArrow(pack, schema))


def scored(queries: np.ndarray, matrix: np.ndarray) -> np.ndarray:
    """Scores of all rows for all queries, accumulated term by term from the postings."""
    width = min(queries.shape[1], matrix.shape[1])
    most = (int(np.abs(queries).max(initial=0)) * int(np.abs(matrix).max(initial=0))) * max(width, 1)
    kind = np.int32 if most < 2**31 else np.int64
    scores = np.zeros((len(queries), len(matrix)), kind)
    queries, terms = queries.astype(kind), np.ascontiguousarray(matrix.T.astype(kind))
    part = np.empty_like(scores)
    for term in range(width):
        using = np.flatnonzero(queries[:, term])
        postings = np.flatnonzero(terms[term])
        if not len(using) or not len(postings):
            continue
        if 2 * len(postings) > len(matrix) and 2 * len(using) > len(queries):
            # Nearly every row is in the postings: add the list with its zeros, without indexing.
            np.multiply(queries[:, term, None], terms[term], out=part)
            scores += part
        else:
            scores[np.ix_(using, postings)] += queries[using, term, None] * terms[term][postings]
    return scores


def _best(scores: np.ndarray, ids: np.ndarray, own: int, k: int) -> np.ndarray:
    """Positions of the k best other rows, ties to the smaller identifier."""
    at = np.flatnonzero(ids != own)
    if len(at) > k:
        values = scores[at]
        bar = np.partition(values, len(values) - k)[len(values) - k]
        at = at[values >= bar]
    return at[np.lexsort((ids[at], -scores[at].astype(np.int64)))[:k]]


def _matrix(cells: bytes, width: int, size: int, n: int) -> np.ndarray:
    return np.frombuffer(cells, f"i{size}").astype(np.int64).reshape(n, width)


def _picked(wanted: np.ndarray, q_ids: np.ndarray, matrix: np.ndarray, ids: np.ndarray, k: int) -> list[tuple[np.ndarray, ...]]:
    """Queries, rows and scores of the k best rows of one block for each of ``wanted``."""
    out = []
    step = max(1, CELLS // max(len(ids), 1))
    for start in range(0, len(q_ids), step):
        some = q_ids[start : start + step]
        scores = scored(wanted[start : start + step], matrix)
        picks = [_best(scores[i], ids, own, k) for i, own in enumerate(some)]
        line = np.repeat(np.arange(len(some)), [len(p) for p in picks])
        at = np.concatenate([*picks, np.zeros(0, np.int64)]).astype(np.int64)
        out.append((some[line], ids[at], scores[line, at].astype(np.int64)))
    return out


def _merged(picks: list[tuple[np.ndarray, ...]], k: int) -> tuple[np.ndarray, ...]:
    """The k best of each query among the picks of several blocks, ties to the smaller identifier."""
    query, ids, scores = (np.concatenate(x) for x in zip(*picks, strict=True))
    order = np.lexsort((ids, -scores, query))
    new = np.append(True, np.diff(query[order]) != 0)[: len(order)]
    place = np.arange(len(order)) - np.flatnonzero(new)[np.cumsum(new) - 1]
    top = order[place < k]
    return query[top], ids[top], scores[top]


def _listed(picks: tuple[np.ndarray, ...]) -> pa.RecordBatch:
    return pa.record_batch([pa.array(x) for x in picks], ["query_id", "vec_id", "score"])


def top_k(queries: DataFrame, candidates: DataFrame, k: int, block_rows: int = BLOCK_ROWS, query_rows: int = QUERY_ROWS) -> DataFrame:
    """The k best candidates of each query: ``query_id, rank, vec_id, score``.

    Both inputs have ``id`` (long) and ``v`` (array<long>).
    """
    queries = queries.filter("id IS NOT NULL AND v IS NOT NULL").groupBy("id").agg(F.min("v").alias("v"))
    candidates = candidates.filter("id IS NOT NULL AND v IS NOT NULL").select("id", "v")
    n_candidates, n_queries = candidates.count(), queries.count()
    blocks = max(1, math.ceil(n_candidates / block_rows))
    query_blocks = max(1, math.ceil(n_queries / query_rows))
    rows = _packed(candidates, blocks, "block")
    asked = _packed(queries, query_blocks, "query_block")
    held = rows.agg(F.sum(F.length("cells"))).first()[0] or 0
    groups = min(blocks, max(GROUPS, math.ceil(held / GROUP_BYTES)))
    shares = min(query_blocks, max(1, TASKS // groups))

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block, picks = None, []
        for batch in batches:
            for at in range(batch.num_rows):
                row = {name: batch.column(name)[at].as_py() for name in batch.schema.names}
                # All candidates of the group follow one another for a block of queries.
                if row["query_block"] != block and picks:
                    yield _listed(_merged(picks, k))
                    picks = []
                block = row["query_block"]
                ids, q_ids = (np.frombuffer(row[c], np.int64) for c in ("ids", "q_ids"))
                matrix, wanted = _matrix(row["cells"], row["width"], row["bytes"], len(ids)), _matrix(row["q_cells"], row["q_width"], row["q_bytes"], len(q_ids))
                picks += _picked(wanted, q_ids, matrix, ids, k)
                if len(picks) > PICKS:
                    picks = [_merged(picks, k)]
        if picks:
            yield _listed(_merged(picks, k))

    # Spark takes the size of a pair from the files, which are compressed, and would broadcast a side.
    asked = asked.repartitionById(shares, "query_block").select("query_block", *(F.col(c).alias(f"q_{c}") for c in ("ids", "cells", "width", "bytes")))
    pairs = asked.hint("shuffle_replicate_nl").crossJoin(rows.repartitionById(groups, "block").drop("block"))
    found = pairs.mapInArrow(search, "query_id long, vec_id long, score long")
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")

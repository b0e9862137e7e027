"""Intermediate tables in the shared folder, compressed for columns of packed arrays."""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from orderloom.session import shared_path


_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
_made: list[list[tuple[str, DataFrame]]] = []


def stored(df: DataFrame, by: str | None = None) -> DataFrame:
    """Writes ``df`` below the checkpoint folder and reads it back; it outlives any executor.

    With ``by``, a column of few whole numbers, there is a folder for each.
    """
    path = shared_path(df.sparkSession, "llm")
    writer = df.write.option("compression", "zstd")
    (writer.partitionBy(by) if by else writer).parquet(path)
    back = df.sparkSession.read.schema(df.schema).parquet(path).select(*df.columns)
    if _made:
        _made[-1].append((path, back))
    return back


@contextmanager
def scratch(spark: SparkSession) -> Iterator[list[DataFrame]]:
    """What ``stored`` writes inside is emptied at the end, but for the tables put into the list that this gives.

    Inside, Spark removes the shuffle files of each query when it ends.
    """
    before = spark.conf.get(_CLEANUP, None)
    spark.conf.set(_CLEANUP, "true")
    kept: list[DataFrame] = []
    _made.append([])
    try:
        yield kept
    finally:
        for path, df in _made.pop():
            if not any(df is k for k in kept):
                # An overwrite by nothing takes the files away, in any file system.
                spark.createDataFrame([], df.schema).coalesce(1).write.mode("overwrite").parquet(path)
            elif _made:
                _made[-1].append((path, df))
        if before is None:
            spark.conf.unset(_CLEANUP)
        else:
            spark.conf.set(_CLEANUP, before)


def text_batches(docs: DataFrame) -> DataFrame:
    """``docs``, after asking the session for batches of few rows, so a batch of long texts fits in memory."""
    docs.sparkSession.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "1000")
    return docs


def key_buckets(spark: SparkSession) -> int:
    """How many key ranges to exchange: a power of two that follows the session's shuffle partitions."""
    wanted = max(64, int(spark.conf.get("spark.sql.shuffle.partitions")))
    return 1 << (wanted - 1).bit_length()


def packed(array: np.ndarray) -> bytes:
    raw = np.ascontiguousarray(array).tobytes()
    return len(raw).to_bytes(8, "little") + (pa.compress(raw, codec="zstd", asbytes=True) if raw else b"")


def unpacked(blob: bytes, kind) -> np.ndarray:
    size = int.from_bytes(blob[:8], "little")
    return np.frombuffer(pa.decompress(blob[8:], size, codec="zstd", asbytes=True) if size else b"", kind)


def summed(parts: DataFrame) -> DataFrame:
    """Adds up vectors of doubles (``part string, sums binary``) by part, in two steps.

    First the vectors of some tasks are added, then those sums, so no task gets the vectors of all.
    """

    def add(table: pa.Table) -> pa.Table:
        total = sum(np.frombuffer(b, np.float64) for b in table.column("sums").to_pylist())
        return pa.table({"part": table.column("part")[:1], "sums": pa.array([total.tobytes()], pa.binary())})

    salted = parts.withColumn("salt", F.spark_partition_id() % 64)
    some = salted.groupBy("part", "salt").applyInArrow(lambda t: add(t.select(["part", "sums"])), "part string, sums binary")
    return some.groupBy("part").applyInArrow(add, "part string, sums binary")


#: Codes that stand for documents in ``likely``; a broadcast has at most so many rows.
CODES = 1 << 18


def _code(key: str):
    # xxhash64(null) is a number like any other; a null key must not share the code of a real one.
    return F.when(F.col(key).isNotNull(), F.pmod(F.xxhash64(key), F.lit(CODES)).cast("int"))


def likely(rows: DataFrame, keys: DataFrame, key: str, inside: bool = True) -> DataFrame:
    """Rows whose key may be among ``keys`` (or, with ``inside=False``, certainly is not).

    A null key is among none, so such rows come with ``inside=False`` only.
    Keys are reduced to a fixed number of codes, so what is broadcast is bounded. It saves shuffling
    the texts of rows that a later join would drop; with very many keys it merely saves less.
    """
    codes = stored(keys.select(_code(key).alias("code")).distinct())
    # A semi-join adds no column, so none of the rows' own can clash.
    return rows.join(F.broadcast(codes), _code(key) == codes["code"], "left_semi" if inside else "left_anti")


def free_name(df: DataFrame, wanted: str) -> str:
    """``wanted``, with underscores before it as long as a column has that name in any case."""
    taken = {c.lower() for c in df.columns}
    while wanted.lower() in taken:
        wanted = f"_{wanted}"
    return wanted


def versioned(docs: DataFrame, name: str = "version") -> DataFrame:
    """Adds a number that tells rows with one doc_id and different texts apart; 0 where there is but one text.

    Rows are changed by (doc_id, number), never by doc_id alone. The ids of several texts are written,
    so the planner sees how few they are.
    """
    digest = F.xxhash64("text")
    several = docs.filter("doc_id IS NOT NULL").groupBy("doc_id").agg(F.min(digest).alias("low"), F.max(digest).alias("high"))
    several = stored(several.filter("low <> high").select(F.col("doc_id").alias("_several")))
    joined = docs.join(several, docs["doc_id"] == several["_several"], "left")
    return joined.select(*(docs[c] for c in docs.columns), F.when(several["_several"].isNotNull(), digest).otherwise(F.lit(0)).cast("long").alias(name))

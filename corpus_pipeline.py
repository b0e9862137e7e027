"""From raw documents to tokens: five stages, each over all rows that the one before it kept.

Every stage takes ``(spark, docs, sf_dir)`` and returns a table; all but the last return the columns
they were given. Rows without doc_id cannot be named by a decision and stay; rows with one doc_id share
their fate.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from orderloom.llm import bpe, contamination, language, line_dedup, near_dups
from orderloom.llm.store import free_name, likely, stored

#: Pre-tokens remembered by a worker: fewer than where encoding is all that a worker does.
REMEMBERED = 30_000


def _without(docs: DataFrame, ids: DataFrame) -> DataFrame:
    """``docs`` less the rows with one of the ids; most of the other texts are not shuffled."""
    ids = stored(ids.select("doc_id").filter("doc_id IS NOT NULL").distinct())
    return likely(docs, ids, "doc_id", inside=False).union(likely(docs, ids, "doc_id").join(ids, "doc_id", "left_anti").select(*docs.columns))


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents of no known language."""
    judged = language.identify(docs.select("doc_id", "text", F.col("lang").alias("declared"), F.col("source").alias("host")))
    return _without(docs, judged.filter(~F.col("kept")))


def dedup_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Takes repeated lines out of the texts, and drops documents of which nothing is left."""
    lines, removed = free_name(docs, "_lines"), free_name(docs, "_removed")
    out = line_dedup.dedup_lines(docs, short_repeats=True, counts=(lines, removed)).filter((F.col(removed) == 0) | (F.col("text") != ""))
    n_chars = F.when(F.col(removed) > 0, F.length("text").cast("long")).otherwise(F.col("n_chars"))
    return out.withColumn("n_chars", n_chars).select(*docs.columns)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one document of each group of near copies (five words, similarity 0.8)."""
    return _without(docs, near_dups.near_duplicates(docs).filter(~F.col("kept")))


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents that hold a test item."""
    return _without(docs, contamination.contaminated(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet")))


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of every text, with the hashes of the ids and of the bytes decoded from them."""
    ranks = bpe.read_ranks(spark, public_tokenizers.path("byte_bpe_multi_50k.tiktoken"))
    return bpe.with_tokens(docs, ranks, public_tokenizers.PATTERN, remembered=REMEMBERED)


STAGES = [
    ("language_id", identify_language),
    ("line_dedup", dedup_lines),
    ("near_duplicates", drop_near_duplicates),
    ("decontamination", drop_contaminated),
    ("byte_bpe", encode),
]

#: Trained models, alignment and merges are beyond SQL; tests hold the stages against plain Python.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; the tables between them are written and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)

"""Table and file sources."""

from __future__ import annotations

import datetime as dt
from collections.abc import Iterable, Mapping

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from orderloom.schemas import SCHEMAS
from orderloom.session import materialise


def read_table(spark: SparkSession, name: str) -> DataFrame:
    return spark.table(name)


def read_folder(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)


def read_csv(
    spark: SparkSession, path: str, schema: T.StructType | str, multi_line: bool = True
) -> DataFrame:
    """CSV with a header row; ``schema`` may name a logical table. Empty text reads as null.

    Quoted text may hold line breaks, which ties one file to one task; pass
    ``multi_line=False`` for large files without them, so that they can be split.
    """
    if isinstance(schema, str):
        schema = SCHEMAS[schema]
    return (
        spark.read.schema(schema)
        .option("header", True)
        .option("multiLine", multi_line)
        .option("escape", '"')
        .csv(path)
    )


def split_csv(spark: SparkSession, path: str, schema: T.StructType | str, multi_line: bool = False, header: bool = True) -> tuple[DataFrame, DataFrame]:
    """Good rows of a CSV, and the lines that do not fit the schema, as ``file, line``.

    A line is bad when it has too few or too many values, or one of the wrong type; nothing is dropped. The
    lines are parsed once and written, so both parts come from one reading.
    """
    if isinstance(schema, str):
        schema = SCHEMAS.get(schema) or T.StructType.fromDDL(schema)
    marked = T.StructType([*schema.fields, T.StructField("_line", T.StringType())])
    parsed = (
        spark.read.schema(marked)
        .option("header", header)
        .option("multiLine", multi_line)
        .option("escape", '"')
        .option("mode", "PERMISSIVE")
        .option("columnNameOfCorruptRecord", "_line")
        .csv(path)
        .select("*", F.col("_metadata.file_path").alias("_file"))
    )
    parsed = materialise(parsed)
    good = parsed.filter(F.col("_line").isNull()).select(*schema.names)
    return good, parsed.filter(F.col("_line").isNotNull()).select(F.col("_file").alias("file"), F.col("_line").alias("line"))


def query_sql(spark: SparkSession, text: str, tables: Mapping[str, DataFrame], **params: object) -> DataFrame:
    """SQL over DataFrames, named in braces, with named parameters (``:name``).

    Parameters are values, never text of the query: numbers, texts, dates and times, and lists of them as
    arrays (``array_contains(:countries, country)``).
    """
    args = {name: F.array(*[F.lit(v) for v in value]) if isinstance(value, (list, tuple)) else value for name, value in params.items()}
    return spark.sql(text, args=args, **tables)


def write_snapshots(df: DataFrame, path: str, day: str = "p_snapshot_date") -> None:
    """Daily snapshots, a folder for each day; only the days of ``df`` are replaced.

    Rows of a day go together, but a day too large for one task is split.
    """
    df.hint("rebalance", day).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(day).parquet(path)


def on_days_of(snapshots: DataFrame, events: DataFrame, day: Column, until: dt.date, column: str = "p_snapshot_date") -> DataFrame:
    """Snapshots of the days (up to ``until``) on which any of ``events`` lies.

    The days are found first, at most one row for each, and choose the folders that are read: a dynamic
    filter on the partition column.
    """
    days = events.select(day.cast("date").alias(column)).filter(F.col(column) <= F.lit(until)).distinct()
    return snapshots.join(F.broadcast(days), column, "left_semi")  # at most one row per calendar day


def snapshot_of(df: DataFrame, day: dt.date, column: str = "p_date") -> DataFrame:
    """Rows of one daily snapshot; a filter on the partition column, so other days are not read."""
    return df.filter(F.col(column) == F.lit(day))


def yesterday_of(df: DataFrame, as_of: dt.date, column: str = "p_date") -> DataFrame:
    return snapshot_of(df, as_of - dt.timedelta(days=1), column)


def current_rows(df: DataFrame, end_column: str = "p_end_date") -> DataFrame:
    """Open versions of a slowly changing table."""
    return df.filter(F.col(end_column).isNull())


def for_values(df: DataFrame, column: str, values: Iterable[str] | None) -> DataFrame:
    """One scan for a list of countries or cities; ``None`` keeps all."""
    return df if values is None else df.filter(F.col(column).isin(list(values)))


def stack(*frames: DataFrame) -> DataFrame:
    """Union of inputs with the same columns in any order."""
    out = frames[0]
    for frame in frames[1:]:
        out = out.unionByName(frame)
    return out

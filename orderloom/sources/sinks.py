"""Report, CSV and map-feed sinks."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.utils import AnalysisException

from orderloom.functions.numbers import finite_columns

_POINTERS = "version long, folder string"


def write_csv(df: DataFrame, path: str) -> None:
    """CSV with a header row; blanks around a text are part of it."""
    (
        df.write.mode("overwrite")
        .option("header", True)
        .option("escape", '"')
        .option("ignoreLeadingWhiteSpace", False)
        .option("ignoreTrailingWhiteSpace", False)
        .csv(path)
    )


def _pointers(spark: SparkSession, root: str, report: str) -> DataFrame | None:
    try:
        return spark.read.schema(_POINTERS).parquet(f"{root.rstrip('/')}/{report}/pointers")
    except AnalysisException:  # nothing was published yet
        return None


def publish(df: DataFrame, root: str, report: str, by: str | None = None) -> str:
    """Full replace of one named report; NaN and infinities are written as null.

    Every version has a folder of its own. Only when it is whole, one small file that names it is added,
    so a reader sees the old report or the new one, never a part, and a failed write changes
    nothing. ``by`` gives a folder for each of its values. Returns the folder of the new version.
    """
    home = f"{root.rstrip('/')}/{report}"
    known = _pointers(df.sparkSession, root, report)
    last = known.agg(F.max("version")).first()[0] if known is not None else None
    folder = f"{home}/versions/{uuid.uuid4().hex}"
    writer = finite_columns(df).write
    (writer.partitionBy(by) if by else writer).parquet(folder)
    row = [((last or 0) + 1, folder)]
    df.sparkSession.createDataFrame(row, _POINTERS).coalesce(1).write.mode("append").parquet(f"{home}/pointers")
    return folder


def read_report(spark: SparkSession, root: str, report: str, version: int | None = None) -> DataFrame:
    """The last published version of a report, or a given one; of two writers at once the same one wins for all."""
    known = _pointers(spark, root, report)
    if known is not None and version is not None:
        known = known.filter(F.col("version") == version)
    last = known.orderBy(F.desc("version"), F.desc("folder")).head() if known is not None else None
    if last is None:
        raise FileNotFoundError(f"no version {version or ''} of report {report} below {root}")
    return spark.read.parquet(last.folder)


def write_feed(df: DataFrame, root: str, feed: str = "feed", by: str = "metric") -> str:
    """Map feed: one folder per metric or partner, published as a whole."""
    return publish(df, root, feed, by)

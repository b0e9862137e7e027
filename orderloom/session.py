"""Session settings and durable lineage cuts."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

DEFAULTS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.ui.showConsoleProgress": "false",
    # Without the call-site record of every column expression, plans are built faster.
    "spark.python.sql.dataFrameDebugging.enabled": "false",
}


def build_session(app: str, master: str | None = None, **conf: str) -> SparkSession:
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    for key, value in {**DEFAULTS, **conf}.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """Return the checkpoint folder, taking ``spark.checkpoint.dir`` when the cluster names one.

    A temporary folder is used in local mode only: on a cluster it would not be
    visible to the other machines.
    """
    sc = spark.sparkContext
    current = sc.getCheckpointDir()
    if current:
        return current
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if not configured:
        if not sc.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder shared by all executors")
        configured = tempfile.mkdtemp(prefix="orderloom-checkpoint-")
    sc.setCheckpointDir(configured)
    return configured


def shared_path(spark: SparkSession, kind: str) -> str:
    """A new path below the checkpoint folder."""
    return f"{ensure_checkpoint_dir(spark).rstrip('/')}/{kind}/{uuid.uuid4().hex}"


def materialise(df: DataFrame, by: str | None = None) -> DataFrame:
    """Write ``df`` below the checkpoint folder and read it back.

    The table survives the loss of executors, is read column by column, and its known
    size lets the planner broadcast it when it is small. With ``by``, a column of few whole
    numbers, there is a folder for each, and a filter on it reads its folder only.
    """
    path = shared_path(df.sparkSession, "tables")
    (df.write.partitionBy(by) if by else df.write).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path).select(*df.columns)

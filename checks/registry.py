"""Registration of queries with their SQL twins."""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from checks.logical_sql import twin
from checks.testbed import Testbed

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
TWINS: dict[str, str] = {}


def query(sql: str | None = None, uses: Sequence[str] = (), recursive: bool = False):
    """Registers a function of the testbed under its own name, with its twin if it has one."""

    def register(fn: Callable[[Testbed], DataFrame]):
        def run(spark: SparkSession, folder: str) -> DataFrame:
            return fn(Testbed(spark, folder))

        run.__name__, run.__doc__ = fn.__name__, fn.__doc__
        QUERIES[fn.__name__] = run
        if sql is not None:
            TWINS[fn.__name__] = twin(uses, sql, recursive)
        return fn

    return register


def rounded(df: DataFrame, places: Mapping[str, int] | int = 6) -> DataFrame:
    """Rounds floating columns, as sums of floats depend on the order of addition."""
    doubles = [f.name for f in df.schema.fields if f.dataType.simpleString() == "double"]
    wanted = {c: places for c in doubles} if isinstance(places, int) else places
    return df.withColumns({c: F.round(F.col(c), p) for c, p in wanted.items()})

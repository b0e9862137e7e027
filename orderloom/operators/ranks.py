"""Exact quantiles, ranks and modes that never gather one group in one task.

``percentile`` and an ordered window both hold a whole group in a single task. Here equal values of a
group are folded to one row, and the rows are dealt out by ranges of (group, value): a large group is
spread over many tasks, many small groups share one. Counts per task tell how many values lie
before its own, so only the rows of one task are ever put in order. There is one way for every size of group.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from orderloom.session import materialise


def melt(df: DataFrame, columns: Sequence[str], keep: Sequence[str] = ()) -> DataFrame:
    """Long form ``(keep..., metric, value)`` of numeric columns; a map-side step."""
    pairs = ", ".join(f"struct('{c}' AS metric, CAST(`{c}` AS DOUBLE) AS value)" for c in columns)
    return df.select(*keep, F.expr(f"inline(array({pairs}))"))


def _same(keys: Sequence[str], prefix: str) -> list[Column]:
    return [F.col(k).eqNullSafe(F.col(f"{prefix}{i}")) for i, k in enumerate(keys)]


def _renamed(keys: Sequence[str], prefix: str) -> list[Column]:
    return [F.col(k).alias(f"{prefix}{i}") for i, k in enumerate(keys)]


def _dealt(counts: DataFrame, keys: Sequence[str], value: str) -> DataFrame:
    """Adds ``_part``, the number of the range that a (group, value) lies in, ascending with both.

    The table is written, so a task that runs again sees the same ranges.
    """
    ranged = counts.repartitionByRange(*[F.col(k) for k in keys], F.col(value))
    return materialise(ranged.withColumn("_part", F.spark_partition_id()))


def _interval_totals(placed: DataFrame, keys: Sequence[str], count: Column) -> DataFrame:
    """Per group and range its ``_total``, the ``_shift`` of ranges before it, and the group's ``n``."""
    whole = Window.partitionBy(*keys)
    earlier = whole.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    totals = placed.groupBy(*keys, "_part").agg(F.sum(count).alias("_total"))
    return totals.select(
        *_renamed(keys, "_t"),
        F.col("_part").alias("_at"),
        "_total",
        F.coalesce(F.sum("_total").over(earlier), F.lit(0)).alias("_shift"),
        F.sum("_total").over(whole).alias("n"),
    )


def _before(keys: Sequence[str], value: str, count: str) -> Column:
    """Values smaller than this one in its group: those of earlier ranges and of its own."""
    inside = Window.partitionBy(*keys, "_part").orderBy(value).rowsBetween(Window.unboundedPreceding, -1)
    return F.col("_shift") + F.coalesce(F.sum(count).over(inside), F.lit(0))


def exact_quantiles(
    df: DataFrame, groups: Sequence[str], value: str, probs: Sequence[float], name: str = "quantiles"
) -> DataFrame:
    """Linear-interpolated quantiles per group as one array column, and their count ``n``.

    Nulls and NaN are left out. Only values of the ranges that hold a wanted position are
    put in order; a group without values gives no row.
    """
    keys = [f"_g{i}" for i in range(len(groups) or 1)]
    sources = [F.col(g) for g in groups] or [F.lit(0)]
    number = F.col(value).cast("double")
    rows = df.filter(number.isNotNull() & ~F.isnan(number)).select(
        *[c.alias(k) for c, k in zip(sources, keys)], number.alias("_v")
    )
    spots = [f"({float(p)!r}D * (n - 1))" for p in probs]
    ends = [(f"_{end}{i}", f"{end}({s})") for i, s in enumerate(spots) for end in ("floor", "ceil")]
    placed = _dealt(rows.groupBy(*keys, "_v").agg(F.count(F.lit(1)).alias("_c")), keys, "_v")
    holds = " OR ".join(f"(_shift <= {at} AND {at} < _shift + _total)" for _, at in ends)
    wanted = _interval_totals(placed, keys, F.col("_c")).filter(holds)
    near = placed.join(wanted, [*_same(keys, "_t"), F.col("_part") == F.col("_at")])
    ranked = near.withColumn("before", _before(keys, "_v", "_c"))
    found = ranked.groupBy(*keys, "n").agg(
        *[F.expr(f"max(CASE WHEN before <= {at} AND {at} < before + _c THEN _v END) AS {end}") for end, at in ends]
    )
    results = ", ".join(f"_floor{i} + (_ceil{i} - _floor{i}) * ({s} - floor({s}))" for i, s in enumerate(spots))
    named = [F.col(k).alias(g) for k, g in zip(keys, groups)]
    return found.select(*named, "n", F.expr(f"array({results}) AS {name}"))


def value_ranks(counts: DataFrame, groups: Sequence[str], value: str, count: str) -> DataFrame:
    """Average rank of each distinct value inside its group, as ``avg_rank``.

    ``counts`` holds one row per (group, value).
    """
    keys = list(groups)
    placed = _dealt(counts, keys, value)
    totals = _interval_totals(placed, keys, F.col(count))
    shifted = placed.join(totals, [*_same(keys, "_t"), F.col("_part") == F.col("_at")])
    rank = _before(keys, value, count) + (F.col(count) + 1) / F.lit(2.0)
    return shifted.select(*counts.columns, rank.alias("avg_rank"))


def group_mode(df: DataFrame, groups: Sequence[str], value: str, name: str = "mode") -> DataFrame:
    """Most frequent non-null value per group; the smallest of equally frequent ones."""
    keys = list(groups)
    counts = df.filter(F.col(value).isNotNull()).groupBy(*keys, value).agg(F.count(F.lit(1)).alias("_n"))
    best = F.min(F.struct((-F.col("_n")).alias("order"), F.col(value).alias("value")))
    return counts.groupBy(*keys).agg(best.alias("_best")).select(*keys, F.col("_best.value").alias(name))


def null_profile(df: DataFrame) -> DataFrame:
    """Null count of each column, in one pass."""
    sums = df.agg(*[F.sum(F.col(f"`{c}`").isNull().cast("long")).alias(c) for c in df.columns])
    return sums.unpivot([], df.columns, "column_name", "null_count")


def value_counts(df: DataFrame, column: str) -> DataFrame:
    return df.groupBy(column).agg(F.count(F.lit(1)).alias("n"))

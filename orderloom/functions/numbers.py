"""Ratios, rounding, fences and number hygiene."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


def ratio_or_zero(numerator: Column, divisor: Column) -> Column:
    """0 where the divisor is 0 or unknown."""
    quotient = F.try_divide(numerator.cast("double"), divisor.cast("double"))
    return F.when(divisor != 0, quotient).otherwise(F.lit(0.0))


def ratio_or_null(numerator: Column, divisor: Column) -> Column:
    return F.try_divide(numerator.cast("double"), divisor.cast("double"))


def stable_round(value: Column, places: int = 2) -> Column:
    """Round half up, after removing the last-digit noise a distributed sum leaves."""
    return F.round(F.round(value, places + 6), places)


def number_or_zero(value: Column) -> Column:
    number = value.try_cast("double")
    return F.coalesce(F.when(~F.isnan(number), number), F.lit(0.0))


def finite_or_null(value: Column) -> Column:
    bad = F.isnan(value) | (F.abs(value) == F.lit(float("inf")))
    return F.when(~bad, value)


def finite_columns(df: DataFrame) -> DataFrame:
    """NaN and infinities become null in every floating column."""
    floats = [f.name for f in df.schema.fields if isinstance(f.dataType, (T.DoubleType, T.FloatType))]
    tests = {c: f"CASE WHEN NOT isnan(`{c}`) AND abs(`{c}`) <> double('Infinity') THEN `{c}` END" for c in floats}
    return df.withColumns({c: F.expr(test) for c, test in tests.items()})


def blank_columns(df: DataFrame) -> DataFrame:
    """Text form for display: null, NaN and infinities become the empty text."""
    clean = finite_columns(df)
    return clean.select(*[F.coalesce(F.col(f.name).cast("string"), F.lit("")).alias(f.name) for f in clean.schema.fields])


def fences(q1: Column, q3: Column, reach: float = 1.5) -> tuple[Column, Column]:
    spread = q3 - q1
    return q1 - spread * reach, q3 + spread * reach


def sum_or_zero(value: Column) -> Column:
    return F.coalesce(F.sum(value), F.lit(0.0))


def total_of(*terms: Column) -> Column:
    """Plain addition: null as soon as one term is null."""
    return reduce(lambda a, b: a + b, terms)


def total_without_nulls(*terms: Column) -> Column:
    return reduce(lambda a, b: a + b, [F.coalesce(t, F.lit(0.0)) for t in terms])

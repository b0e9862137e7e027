"""Panels kept up to date day by day, and distinct counts that can be added up.

A day's orders are folded to partial sums once and kept in a folder of that day. A panel over any window is
the sum of its days, so a daily run reads one day of orders and the small partial sums, not the
history. A day that is refreshed replaces its folder; it has a marker row, so a day of which
nothing is left replaces its folder, too.
"""

from __future__ import annotations

import datetime as dt
from collections.abc import Iterable, Mapping, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from orderloom.functions.dates import between_days, last_year_start
from orderloom.operators.orders import delivered, one_row_per_order, pnl_per_order, scored_cohort
from orderloom.sources.tables import for_values, write_snapshots

TIME = "order_activated_local_at"
DAILY_SCHEMA = """country string, customer_id bigint, value_sum double, value_n bigint, orders bigint, qcomm_orders bigint,
    first_at timestamp_ntz, last_at timestamp_ntz, margin_sum double, rpo_sum double, cpo_sum double, day date"""


def daily_value(
    order_facts: DataFrame, order_pnl: DataFrame, since: dt.date, until: dt.date, countries: Iterable[str] | None = None
) -> DataFrame:
    """Partial sums per customer and day of the days from ``since`` to ``until``, with a marker row for each day.

    Only orders of these days are read, and only the margins of those orders are aggregated.
    """
    rows = for_values(order_facts, "order_country_code", countries).filter(delivered() & between_days(F.col(TIME), since, until))
    orders = one_row_per_order(
        rows.withColumn("qcommerce", F.expr("order_vertical = 'QCommerce'")),
        ["order_country_code", "customer_id"],
        ["qcommerce", TIME, "order_is_first_delivered_order", "order_transacted_value_eur"],
    )
    margins = pnl_per_order(order_pnl.join(orders.select("order_id"), "order_id", "left_semi"))
    sums = (
        orders.join(margins, "order_id", "left")
        .groupBy(F.col("order_country_code").alias("country"), "customer_id", F.to_date(TIME).alias("day"))
        .agg(
            F.sum("order_transacted_value_eur").alias("value_sum"),
            F.count("order_transacted_value_eur").alias("value_n"),
            F.count("order_id").alias("orders"),
            F.count_if("qcommerce").alias("qcomm_orders"),
            F.min(F.when(F.col("order_is_first_delivered_order"), F.col(TIME))).alias("first_at"),
            F.max(TIME).alias("last_at"),
            F.sum("contribution_margin_eur").alias("margin_sum"),
            F.sum("rpo").alias("rpo_sum"),
            F.sum("cpo").alias("cpo_sum"),
        )
    )
    days = [(since + dt.timedelta(days=i),) for i in range((until - since).days + 1)]
    markers = order_facts.sparkSession.createDataFrame(days, "day date")
    return sums.unionByName(markers, allowMissingColumns=True)


def refresh_days(
    path: str, order_facts: DataFrame, order_pnl: DataFrame, since: dt.date, until: dt.date, countries: Iterable[str] | None = None
) -> None:
    """Works the given days out anew and replaces their folders below ``path``; other days are not touched."""
    write_snapshots(daily_value(order_facts, order_pnl, since, until, countries), path, "day")


def read_days(spark: SparkSession, path: str) -> DataFrame:
    """The kept partial sums, without the marker rows."""
    return spark.read.schema(DAILY_SCHEMA).parquet(path).filter(F.col("orders").isNotNull())


def customer_value_of_days(
    days: DataFrame, customer_ltv: DataFrame, customer_lto: DataFrame, as_of: dt.date, keep_unscored: bool = False
) -> DataFrame:
    """The value panel of ``customer_value`` from kept days; folders outside the window are not read."""
    window = days.filter(F.col("day").between(F.lit(last_year_start(as_of)), F.lit(as_of)))
    per_customer = window.groupBy("country", "customer_id").agg(
        F.expr("try_divide(sum(value_sum), sum(value_n)) AS aov"),
        F.expr("sum(orders) AS total_orders"),
        F.expr("sum(qcomm_orders) AS total_qcomm_orders"),
        F.expr("min(first_at) AS _from"),
        F.expr("max(last_at) AS _to"),
        F.expr("sum(margin_sum) AS contribution_margin_eur"),
        F.expr("sum(rpo_sum) AS rpo"),
        F.expr("sum(cpo_sum) AS cpo"),
    )
    return scored_cohort(per_customer, customer_ltv, customer_lto, as_of, keep_unscored)


def distinct_bitmaps(df: DataFrame, keys: Sequence[str], identity: str, conditions: Mapping[str, Column]) -> DataFrame:
    """One row per group and range of 32,768 ids, with a bitmap for each condition; a mergeable distinct count.

    All conditions are met in one aggregate over the rows as they are, without copying rows for each. For
    groups of many ids (days, cities, partners). Null ids count nowhere.
    """
    kept = df.filter(F.col(identity).isNotNull())
    held = [
        F.bitmap_construct_agg(F.bitmap_bit_position(F.when(test, F.col(identity)))).alias(name) for name, test in conditions.items()
    ]
    return kept.groupBy(*keys, F.bitmap_bucket_number(F.col(identity)).alias("bucket")).agg(*held)


def merge_bitmaps(parts: DataFrame, keys: Sequence[str], names: Iterable[str]) -> DataFrame:
    """Bitmaps of coarser groups: an id that several parts hold counts once."""
    return parts.groupBy(*keys, "bucket").agg(*[F.bitmap_or_agg(name).alias(name) for name in names])


def bitmap_counts(parts: DataFrame, keys: Sequence[str], names: Iterable[str]) -> DataFrame:
    """Distinct ids per group and condition, from bitmaps."""
    names = list(names)
    merged = merge_bitmaps(parts, keys, names)
    return merged.groupBy(*keys).agg(*[F.sum(F.bitmap_count(name)).alias(name) for name in names])

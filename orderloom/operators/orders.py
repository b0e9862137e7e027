"""Order panels: customer value, prime orders, top partners, order lines."""

from __future__ import annotations

import datetime as dt
from collections.abc import Iterable, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from orderloom.functions.dates import full_months, since_days, since_last_year
from orderloom.functions.numbers import total_of, total_without_nulls
from orderloom.schemas import COST_TERMS, check
from orderloom.session import materialise
from orderloom.sources.tables import for_values, yesterday_of


def delivered(root_only: bool = True) -> Column:
    """Delivered orders; by default without orders that hang on a parent order."""
    test = F.col("order_final_status") == "DeliveredStatus"
    return test & F.col("order_parent_relationship_type").isNull() if root_only else test


def pnl_per_order(order_pnl: DataFrame) -> DataFrame:
    """Margin, revenue terms and cost terms, one row per order.

    The revenue of a row is null when one of its terms is null; missing cost terms count as 0.
    """
    plain = ("tcorev", "adve", "totbdr", "bwsrev", "mbsrsu", "serfig", "deacsu")
    revenue = total_of(*[F.col(f"{t}_eur") for t in plain], F.col("mfcgso_eur") - F.col("qmcogs_eur"))
    costs = total_without_nulls(*[F.col(f"{t}_eur") for t in COST_TERMS])
    return order_pnl.groupBy("order_id").agg(
        F.sum("contribution_margin_eur").alias("contribution_margin_eur"),
        F.sum(revenue).alias("rpo"),
        F.sum(costs).alias("cpo"),
    )


def one_row_per_order(rows: DataFrame, keys: Sequence[str], values: Sequence[str]) -> DataFrame:
    """Counts and averages over orders see each order once, also when its row is repeated.

    Texts are keys and numbers, flags and times are maxima, which keeps the aggregate on
    hashes; the one shuffle by order also serves the joins on orders that follow.
    """
    return rows.repartition("order_id").groupBy("order_id", *keys).agg(
        *[F.expr(f"max({c}) AS {c}") for c in values]
    )


def customer_value(
    order_facts: DataFrame,
    order_pnl: DataFrame,
    customer_ltv: DataFrame,
    customer_lto: DataFrame,
    as_of: dt.date,
    countries: Iterable[str] | None = None,
    keep_unscored: bool = False,
) -> DataFrame:
    """Value panel of customers whose first delivered order lies in the window.

    The cohort test is a flag of the same rows that are summed, so it is a condition on
    the finished group instead of a self-join. Customers without a prediction of
    yesterday are left out unless ``keep_unscored``.
    """
    check(customer_ltv, "customer_ltv")
    check(order_facts, "order_facts")
    rows = for_values(order_facts, "order_country_code", countries).filter(
        delivered() & since_last_year(F.col("order_activated_local_at"), as_of)
    )
    orders = one_row_per_order(
        rows.withColumn("qcommerce", F.expr("order_vertical = 'QCommerce'")),
        ["order_country_code", "customer_id"],
        ["qcommerce", "order_activated_local_at", "order_is_first_delivered_order", "order_transacted_value_eur"],
    )
    per_customer = (
        orders.join(pnl_per_order(order_pnl), "order_id", "left")
        .groupBy(F.col("order_country_code").alias("country"), "customer_id")
        .agg(
            F.expr("avg(order_transacted_value_eur) AS aov"),
            F.expr("count(order_id) AS total_orders"),
            F.expr("count_if(qcommerce) AS total_qcomm_orders"),
            F.expr("min(CASE WHEN order_is_first_delivered_order THEN order_activated_local_at END) AS _from"),
            F.expr("max(order_activated_local_at) AS _to"),
            F.expr("sum(contribution_margin_eur) AS contribution_margin_eur"),
            F.expr("sum(rpo) AS rpo"),
            F.expr("sum(cpo) AS cpo"),
        )
    )
    return scored_cohort(per_customer, customer_ltv, customer_lto, as_of, keep_unscored)


def scored_cohort(
    per_customer: DataFrame, customer_ltv: DataFrame, customer_lto: DataFrame, as_of: dt.date, keep_unscored: bool = False
) -> DataFrame:
    """Customers with a first order in the window, their active months, and the predictions for them."""
    cohort = (
        per_customer.filter(F.col("_from").isNotNull())
        .withColumn("active_months", full_months(F.col("_from"), F.col("_to")) + 1)
        .drop("_from", "_to")
    )
    ltv = customer_ltv.groupBy("customer_id").agg(
        *[F.max(c).alias(c) for c in ("pltv_1y", "pltv_3y", "pltv_5y")]
    )
    lto = (
        yesterday_of(customer_lto, as_of)
        .groupBy("customer_id")
        .agg(
            F.max("predicted_orders_12mo").alias("plto_1y"),
            F.max("predicted_orders_36mo").alias("plto_3y"),
            F.max("predicted_orders_60mo").alias("plto_5y"),
        )
    )
    return cohort.join(lto, "customer_id", "left" if keep_unscored else "inner").join(
        ltv, "customer_id", "left"
    )


def prime_orders(
    order_facts: DataFrame,
    order_pnl: DataFrame,
    as_of: dt.date,
    countries: Iterable[str] | None = None,
    vertical: str = "QCommerce",
    store: str | None = None,
) -> DataFrame:
    """One row per prime order of a vertical (and store), with value and margin."""
    rows = for_values(order_facts, "order_country_code", countries).filter(
        delivered()
        & F.col("order_is_prime")
        & (F.col("order_vertical") == vertical)
        & since_last_year(F.col("order_activated_local_at"), as_of)
    )
    if store is not None:
        rows = rows.filter(F.col("store_name") == store)
    margin = order_pnl.groupBy("order_id").agg(F.sum("contribution_margin_eur").alias("contribution_margin_eur"))
    return rows.join(margin, "order_id", "left").select(
        F.col("order_country_code").alias("country"),
        "order_id",
        F.col("order_transacted_value_eur").alias("aov"),
        "contribution_margin_eur",
    )


def first_rows(df: DataFrame, groups: Sequence[str], order: Sequence[Column], n: int) -> DataFrame:
    """The first ``n`` rows of each group; the rank limit also runs before the shuffle."""
    rank = F.row_number().over(Window.partitionBy(*groups).orderBy(*order))
    return df.withColumn("rank", rank).filter(F.col("rank") <= n)


def spread_key(key: str, *others: str) -> Column:
    """The key as text; a row without one gets a text made of its other columns.

    An outer join on it matches what a join on the key does, but does not send all rows
    without a key to one task. No number as text begins with the mark.
    """
    return F.coalesce(F.col(key).cast("string"), F.concat(F.lit("#"), F.xxhash64(*others).cast("string")))


def top_partners(
    order_facts: DataFrame,
    as_of: dt.date,
    days: int = 90,
    n: int = 100,
    countries: Iterable[str] | None = None,
    vertical: str | None = "Food",
) -> DataFrame:
    """The ``n`` stores of each country with most distinct delivered orders."""
    rows = for_values(order_facts, "order_country_code", countries).filter(
        delivered()
        & F.col("store_name").isNotNull()
        & since_days(F.col("order_activated_local_at"), as_of, days)
    )
    if vertical is not None:
        rows = rows.filter(F.col("order_vertical") == vertical)
    counts = rows.groupBy("order_country_code", "store_name").agg(F.countDistinct("order_id").alias("orders"))
    return first_rows(counts, ["order_country_code"], [F.desc("orders"), F.asc("store_name")], n)


def order_lines(
    order_facts: DataFrame,
    bought_products: DataFrame,
    partners: DataFrame,
    as_of: dt.date,
    days: int = 90,
    countries: Iterable[str] | None = None,
    vertical: str = "Food",
) -> DataFrame:
    """Delivered orders of the window with their products; ``top_partner`` marks listed stores.

    The partner list is written first, so its size is known when the orders are marked.
    """
    rows = for_values(order_facts, "order_country_code", countries).filter(
        delivered()
        & (F.col("order_vertical") == vertical)
        & since_days(F.col("order_activated_local_at"), as_of, days)
    )
    listed = materialise(partners.select("order_country_code", "store_name").distinct())
    listed = listed.withColumn("top_partner", F.lit(True))
    return (
        rows.select(
            "order_id",
            "order_city_code",
            "order_country_code",
            "store_name",
            "order_transacted_value_local",
            "order_transacted_value_eur",
        )
        .join(listed, ["order_country_code", "store_name"], "left")
        .join(bought_products, "order_id", "left")
        .withColumn("top_partner", F.coalesce("top_partner", F.lit(False)))
    )

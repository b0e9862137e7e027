"""Customer profile: first order, habits, shares, user type, favourite stores."""

from __future__ import annotations

import datetime as dt
from collections.abc import Iterable, Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from orderloom.functions.dates import DAY_PARTS, WEEK_DAYS, days_back, days_between, months_back_start, since_months
from orderloom.functions.geo import h3_parent, h3_to_long
from orderloom.operators.orders import delivered, first_rows, one_row_per_order, spread_key
from orderloom.schemas import check
from orderloom.session import materialise
from orderloom.sources.tables import current_rows, for_values

# Days since the first order, payment methods, store segments.
DAY_WINDOWS = {
    "num_orders_days_1_to_7": (0, 6),
    "num_orders_days_8_to_14": (7, 13),
    "num_orders_days_15_to_21": (14, 20),
    "num_orders_days_22_to_28": (21, 27),
    "num_orders_days_1_to_30_total": (0, 29),
    "num_orders_days_31_to_60": (30, 59),
    "num_orders_days_61_to_90": (60, 89),
    "num_orders_days_91_to_120": (90, 119),
    "num_orders_days_121_to_150": (120, 149),
    "num_orders_days_151_to_180": (150, 179),
    "num_orders_days_1_to_365_total": (0, 364),
}
PAYMENT_METHODS = ("CREDIT_CARD", "CASH", "APPLE_PAY", "GOOGLE_PAY", "BANK_TRANSFER", "KASPI", "BLIK")
SEGMENTS = ("Top City", "Top Country", "Local Selection", "Long Tail", "Big Chain")
TOP_PARTNERS = 10
# Mean monthly orders above / below which a customer is of type A / C.
TYPE_A_ABOVE, TYPE_C_BELOW = 6.0, 3.0
#: An order's checkout, and the session of it, lie at most so many days before the order.
SESSION_DAYS = 7


def base_orders(
    order_facts: DataFrame, as_of: dt.date, months: int = 24, countries: Iterable[str] | None = None
) -> DataFrame:
    return for_values(order_facts, "order_country_code", countries).filter(
        delivered() & since_months(F.col("order_activated_local_at"), as_of, months)
    )


def first_orders(orders: DataFrame) -> DataFrame:
    """The first delivered order of each customer, as a minimum that folds before the shuffle."""
    first = F.min(
        F.struct("order_activated_local_at", "order_id", "order_country_code", "order_city_code")
    )
    return (
        orders.filter("order_is_first_delivered_order")
        .groupBy("customer_id")
        .agg(first.alias("f"))
        .select(
            "customer_id",
            "f.order_id",
            "f.order_country_code",
            "f.order_city_code",
            F.col("f.order_activated_local_at").alias("customer_first_delivered_at"),
        )
    )


def first_order_location(
    orders: DataFrame,
    checkout_events: DataFrame,
    sessions: DataFrame,
    resolution: int = 7,
    since: dt.date | None = None,
) -> DataFrame:
    """First order per customer with the parent hexagon of the session it was placed in.

    Checkouts are narrowed to first orders, and sessions to those checkouts, before
    anything is aggregated. An order with several sessions takes the greatest parent id.
    With ``since``, the first day of the orders, checkouts are read from ``SESSION_DAYS``
    before it, and sessions from as many days before those.
    """
    if since is not None:
        checkout_events = checkout_events.filter(F.col("p_creation_date") >= F.lit(days_back(since, SESSION_DAYS)))
        earliest = F.lit(days_back(since, 2 * SESSION_DAYS)).cast("timestamp_ntz")
        sessions = sessions.filter(F.col("session_start_time_local") >= earliest)
    first = materialise(first_orders(orders))
    placed = checkout_events.select("order_id", "dynamic_session_id").join(first.select("order_id"), "order_id")
    parent = h3_parent(h3_to_long(F.col("h8_hexagon")), resolution)
    located = (
        sessions.select("dynamic_session_id", parent.alias("parent_hexagon"))
        .join(placed, "dynamic_session_id")
        .groupBy("order_id")
        .agg(F.max("parent_hexagon").alias("parent_hexagon"))
    )
    return first.join(located, "order_id", "left")


def _monthly_rate(orders: DataFrame) -> DataFrame:
    month = F.trunc(F.to_date("order_activated_local_at"), "MM")
    return (
        orders.groupBy("customer_id", month.alias("month"))
        .agg(F.countDistinct("order_id").alias("n"))
        .groupBy("customer_id")
        .agg(F.avg("n").alias("avg_monthly_orders"))
    )


def type_of(rate: Column, high: float = TYPE_A_ABOVE, low: float = TYPE_C_BELOW) -> Column:
    return F.when(rate > high, "A").when(rate < low, "C").otherwise("B")


def user_type(orders: DataFrame, high: float = TYPE_A_ABOVE, low: float = TYPE_C_BELOW) -> DataFrame:
    """Mean distinct orders over the months with orders, and the type read from it."""
    return _monthly_rate(orders).withColumn("user_type", type_of(F.col("avg_monthly_orders"), high, low))


def monthly_stores(orders: DataFrame) -> DataFrame:
    """Distinct stores per customer and month."""
    month = F.trunc(F.to_date("order_activated_local_at"), "MM")
    return orders.groupBy("customer_id", month.alias("month")).agg(
        F.countDistinct("store_name").alias("stores")
    )


def favourite_stores(orders: DataFrame, n: int = 3) -> DataFrame:
    """The customer's ``n`` stores with most orders, as columns ``top_1_store`` and on."""
    counts = orders.groupBy("order_country_code", "customer_id", "store_name").agg(
        F.countDistinct("order_id").alias("orders")
    )
    ranked = first_rows(
        counts,
        ["order_country_code", "customer_id"],
        [F.desc("orders"), F.asc_nulls_last("store_name")],
        n,
    )
    return ranked.groupBy("order_country_code", "customer_id").agg(
        *[F.max(F.when(F.col("rank") == i, F.col("store_name"))).alias(f"top_{i}_store") for i in range(1, n + 1)]
    )


def leading_stores(orders: DataFrame, n: int = TOP_PARTNERS) -> DataFrame:
    """Stores with most distinct orders per country."""
    counts = (
        orders.filter(F.col("store_name").isNotNull())
        .groupBy("order_country_code", "store_name", "store_id")
        .agg(F.countDistinct("order_id").alias("orders"))
    )
    return first_rows(
        counts, ["order_country_code"], [F.desc("orders"), F.asc("store_name"), F.asc("store_id")], n
    )


def leading_cities(orders: DataFrame, n: int = 1) -> DataFrame:
    counts = orders.groupBy("order_country_code", "order_city_code").agg(
        F.countDistinct("order_id").alias("orders")
    )
    return first_rows(counts, ["order_country_code"], [F.desc("orders"), F.asc("order_city_code")], n)


def _slug(text: str) -> str:
    return text.lower().replace(" ", "_")


def share_tests(week_style: str = "sunday") -> dict[str, str]:
    """Name and condition of each share of a customer's orders, as SQL over an order row."""
    t = "order_activated_local_at"
    day = f"dayofweek({t})" if week_style == "sunday" else f"weekday({t}) + 1"
    tests = {f"pct_orders_{p}": f"hour({t}) BETWEEN {lo} AND {hi}" for p, (lo, hi) in DAY_PARTS.items()}
    tests["pct_orders_weekday"] = f"{day} BETWEEN 2 AND 6"
    for number, name in enumerate(WEEK_DAYS, start=1):
        tests[f"pct_orders_{name}"] = f"{day} = {number}"
    tests["pct_prime_orders"] = "order_is_prime"
    tests["pct_qcommerce_orders"] = "order_vertical = 'QCommerce'"
    tests["pct_promo_orders"] = "promoted"
    tests.update({f"pct_{_slug(m)}_orders": f"paid_{_slug(m)}" for m in PAYMENT_METHODS})
    tests.update({f"pct_{_slug(s)}_orders": f"in_{_slug(s)}" for s in SEGMENTS})
    tests["pct_top_partner_orders"] = "is_top_partner"
    return tests


def orders_with_context(
    orders: DataFrame,
    payments: DataFrame,
    discounts: DataFrame,
    order_pnl: DataFrame,
    segmentation: DataFrame,
    promotion: str,
    countries: Iterable[str] | None = None,
) -> DataFrame:
    """One row per order with its payment, promotion, margin, segment and partner marks.

    The side tables are folded to one row per key, so no join repeats an order; the three
    order-level joins share one partitioning. Orders without a store are spread out.
    """
    paid = payments.groupBy("order_id").agg(
        *[F.expr(f"bool_or(payment_method = '{m}') AS paid_{_slug(m)}") for m in PAYMENT_METHODS]
    )
    promoted = (
        discounts.filter(F.col("discount_type") == promotion)
        .groupBy("order_id")
        .agg(F.lit(True).alias("promoted"))
    )
    margin = order_pnl.groupBy("order_id").agg(
        F.sum("contribution_margin_eur").alias("contribution_margin_eur")
    )
    segments = (
        for_values(current_rows(segmentation), "country_code", countries)
        .groupBy("store_id")
        .agg(*[F.expr(f"bool_or(segmentation = '{s}') AS in_{_slug(s)}") for s in SEGMENTS])
    )
    # At most TOP_PARTNERS stores per country; written, so their size is known when they are joined.
    partners = materialise(leading_stores(orders).select("order_country_code", "store_id").distinct())
    unique = one_row_per_order(
        orders,
        ["customer_id", "order_country_code", "order_city_code", "order_vertical", "store_id"],
        ["order_activated_local_at", "order_is_prime", "order_transacted_value_eur"],
    )
    store = F.col("store_id").cast("string").alias("_store")
    partners = partners.select("order_country_code", store, F.lit(True).alias("is_top_partner"))
    return (
        unique.join(paid, "order_id", "left")
        .join(promoted, "order_id", "left")
        .join(margin, "order_id", "left")
        .withColumn("_store", spread_key("store_id", "order_id"))
        .join(materialise(segments.withColumn("_store", store).drop("store_id")), "_store", "left")
        .join(partners, ["order_country_code", "_store"], "left")
        .drop("_store")
    )


def _days(context: DataFrame, week_style: str) -> DataFrame:
    """Orders folded to (customer, day, city): the form every later sum reads."""
    if week_style not in ("sunday", "iso"):
        raise ValueError(f"unknown week style {week_style!r}")
    tests = share_tests(week_style)
    return context.groupBy("customer_id", F.expr("to_date(order_activated_local_at) AS day"), "order_city_code").agg(
        F.expr("count(order_id) AS orders"),
        F.expr("sum(order_transacted_value_eur) AS value_sum"),
        F.expr("count(order_transacted_value_eur) AS value_n"),
        F.expr("sum(contribution_margin_eur) AS margin_sum"),
        F.expr("count(contribution_margin_eur) AS margin_n"),
        *[F.expr(f"count_if({test}) AS {name}") for name, test in tests.items()],
        F.expr("max(order_activated_local_at) AS last_order"),
        F.expr("min(CASE WHEN order_vertical = 'QCommerce' THEN order_activated_local_at END) AS first_qcommerce"),
        F.expr("min(CASE WHEN order_is_prime THEN order_activated_local_at END) AS first_prime"),
    )


def install_sources(installs: DataFrame, networks: Mapping[str, str]) -> DataFrame:
    """One row per customer: organic flag and one flag per install network.

    ``networks`` names each flag and the network's name, or its beginning and a ``*``.
    """
    name = F.col("app_install_network_name")

    def test(pattern: str) -> Column:
        return name.startswith(pattern[:-1]) if pattern.endswith("*") else name == pattern

    return (
        installs.filter(F.col("app_install_user_id").isNotNull())
        .groupBy(F.col("app_install_user_id").alias("customer_id"))
        .agg(
            F.bool_or("app_install_is_organic").alias("organic_installs"),
            *[F.bool_or(test(p)).alias(flag) for flag, p in networks.items()],
        )
    )


def customer_profile(
    order_facts: DataFrame,
    payments: DataFrame,
    checkout_events: DataFrame,
    sessions: DataFrame,
    installs: DataFrame,
    discounts: DataFrame,
    order_pnl: DataFrame,
    segmentation: DataFrame,
    as_of: dt.date,
    promotion: str,
    networks: Mapping[str, str],
    months: int = 24,
    countries: Iterable[str] | None = None,
    levels: DataFrame | None = None,
    high: float = TYPE_A_ABOVE,
    low: float = TYPE_C_BELOW,
    week_style: str = "sunday",
) -> DataFrame:
    """One row per customer whose first delivered order lies in the window.

    ``promotion`` is the discount type that marks a promoted order, ``networks`` those of
    ``install_sources``. The orders of the window are written once, as every part reads them,
    and so are the first orders. Shares count each
    order once. ``levels`` (first order in vertical) overrides the first
    QCommerce date computed from the orders. ``week_style="iso"`` keeps the day numbers of
    a Monday-first calendar under the same column names.
    """
    check(order_facts, "order_facts")
    orders = materialise(base_orders(order_facts, as_of, months, countries))
    context = orders_with_context(orders, payments, discounts, order_pnl, segmentation, promotion, countries)
    first = first_order_location(orders, checkout_events, sessions, since=months_back_start(as_of, months))
    # A customer has at most one row per day and city, so this window is bounded by the calendar.
    per_day = _days(context, week_style).join(
        first.select("customer_id", "customer_first_delivered_at"), "customer_id"
    )
    per_day = per_day.withColumn("age", days_between(F.col("customer_first_delivered_at"), F.col("day")))
    sums = per_day.groupBy("customer_id").agg(
        F.expr("sum(orders) AS total_orders"),
        *[
            F.expr(f"sum(CASE WHEN age BETWEEN {lo} AND {hi} THEN orders ELSE 0 END) AS {c}")
            for c, (lo, hi) in DAY_WINDOWS.items()
        ],
        F.expr("try_divide(sum(value_sum), sum(value_n)) AS avg_transacted_value_eur"),
        F.expr("try_divide(sum(margin_sum), sum(margin_n)) AS avg_contribution_margin_eur"),
        *[F.expr(f"try_divide(sum({c}), sum(orders)) AS {c}") for c in share_tests(week_style)],
        F.expr("to_date(min(first_qcommerce)) AS first_qcommerce_date"),
        F.expr("to_date(min(first_prime)) AS first_prime_date"),
        F.expr("max(last_order) AS last_order_date"),
        F.expr("count(DISTINCT order_city_code) AS num_distinct_cities"),
        F.expr("size(collect_set(year(day) * 12 + month(day))) AS _months"),
    )
    if levels is not None:
        dates = (
            orders.filter(F.col("order_vertical") == "QCommerce")
            .select("order_id", "customer_id")
            .join(levels, "order_id", "left")
            .groupBy("customer_id")
            .agg(F.max("first_order_in_vertical_date").alias("first_qcommerce_date"))
        )
        sums = sums.drop("first_qcommerce_date").join(dates, "customer_id", "left")
    first_day = F.to_date("customer_first_delivered_at")
    age = F.datediff(F.lit(as_of), F.col("customer_first_delivered_date"))
    rate = F.col("total_orders") / F.col("_months")
    out = (
        first.join(sums, "customer_id")
        .withColumnsRenamed({"order_city_code": "customer_city", "parent_hexagon": "h7_hexagon"})
        .withColumn("customer_first_delivered_date", first_day)
        .withColumn("avg_monthly_orders", rate)
        .withColumn("user_type", type_of(F.col("avg_monthly_orders"), high, low))
        .withColumn("days_since_first_order", age)
        .withColumn("days_until_first_qcommerce", F.datediff("first_qcommerce_date", "customer_first_delivered_date"))
        .withColumn("days_until_first_prime", F.datediff("first_prime_date", "customer_first_delivered_date"))
        .withColumn(
            "avg_monthly_orders_since_active",
            F.when(age == 0, F.col("total_orders").cast("double")).otherwise(
                F.try_divide(F.col("total_orders").cast("double"), age / F.lit(30.0))
            ),
        )
        .drop("_months", "order_id", "customer_first_delivered_at")
        .join(install_sources(installs, networks), "customer_id", "left")
        .join(favourite_stores(orders), ["order_country_code", "customer_id"], "left")
    )
    return out.withColumns({flag: F.coalesce(flag, F.lit(False)) for flag in networks})

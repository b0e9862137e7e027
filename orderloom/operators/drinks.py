"""Category report over order lines: KPIs per country, partners, brands, names."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from orderloom.functions.numbers import ratio_or_null, ratio_or_zero, stable_round
from orderloom.functions.text import matches_any, normalise_name
from orderloom.operators.catalogue import is_drink, with_category

# Spellings of two brands.
COLA_PATTERNS = (
    "coca", "koka", "kokakola", "კოკა", "კოკაკოლა", "კოლა", "кока", "кола", "կոկա", "կոկակոլա", "կոլա",
    "Cola", "Coca",
)
PEPSI_PATTERNS = ("pepsi", "პეპსი", "пепси", "փեփսի", "пепсi", "Պեպսի", "Пепсi")


def order_summary(lines: DataFrame) -> DataFrame:
    """One row per order out of lines that carry ``predicted_category`` (null when unlabelled).

    ``has_drink``, ``only_drinks`` and the order value look at labelled lines only, as the
    report does; ``labelled`` and ``unlabelled`` count lines of both kinds.
    """
    category = F.col("predicted_category")
    known = category.isNotNull() & (category != "")
    drink = is_drink(category)
    return lines.groupBy("order_country_code", "store_name", "order_id").agg(
        F.max("order_city_code").alias("order_city_code"),
        F.bool_or("top_partner").alias("top_partner"),
        F.count_if(known).alias("labelled"),
        F.count_if(~known & F.col("product_id").isNotNull()).alias("unlabelled"),
        F.bool_or(drink).alias("has_drink"),
        F.bool_and(F.when(known, drink)).alias("only_drinks"),
        F.max("order_transacted_value_local").alias("value_local"),
        F.max("order_transacted_value_eur").alias("value_eur"),
    )


def _average(value: str, test: Column | None = None) -> Column:
    shown = F.col(value) if test is None else F.when(test, F.col(value))
    return stable_round(F.avg(shown), 2)


def drinks_kpis(lines: DataFrame, predictions: DataFrame) -> DataFrame:
    """One row per country: orders, orders with drinks, average values, label coverage, shares.

    Orders fold to stores and stores to countries, so partner shares need no distinct count.
    """
    orders = order_summary(with_category(lines, predictions, keep_unlabelled=True))
    seen = F.col("labelled") > 0
    kinds = {"": seen, "_drinks": seen & F.col("has_drink"), "_no_drinks": seen & ~F.col("has_drink")}
    values = ("value_local", "value_eur")
    stores = orders.groupBy("order_country_code", "store_name").agg(
        *[F.count_if(test).alias(f"orders{kind}") for kind, test in kinds.items()],
        *[F.sum(F.when(test, F.col(v))).alias(f"{v}{kind}") for v in values for kind, test in kinds.items()],
        *[F.count(F.when(test, F.col(v))).alias(f"{v}{kind}_n") for v in values for kind, test in kinds.items()],
        F.count_if(kinds["_drinks"] & F.col("only_drinks")).alias("only_drinks"),
        F.sum("unlabelled").alias("unlabelled"),
        F.sum("labelled").alias("labelled"),
        F.bool_or(F.col("top_partner") & seen).alias("partner"),
    )
    averages = [
        stable_round(ratio_or_null(F.sum(f"{v}{kind}"), F.sum(f"{v}{kind}_n")), 2).alias(
            v.replace("value", "aov") + kind
        )
        for v in values
        for kind in kinds
    ]
    with_drinks = F.count_if(F.col("partner") & (F.col("orders_drinks") > 0))
    return stores.groupBy("order_country_code").agg(
        F.sum("orders").alias("orders"),
        F.sum("orders_drinks").alias("orders_with_drinks"),
        *averages,
        F.sum("unlabelled").alias("unlabelled_lines"),
        F.sum("labelled").alias("labelled_lines"),
        stable_round(ratio_or_zero(with_drinks * 100, F.count_if("partner")), 2).alias(
            "pct_partners_with_drinks"
        ),
        stable_round(ratio_or_zero(F.sum("only_drinks") * 100, F.sum("orders_drinks")), 2).alias(
            "pct_only_drinks"
        ),
    )


def partner_drinks(lines: DataFrame, predictions: DataFrame) -> DataFrame:
    """Listed partners with their orders and average values, with and without drinks."""
    orders = order_summary(with_category(lines, predictions)).filter("top_partner")
    drinks = F.col("has_drink")
    return (
        orders.groupBy("order_country_code", "store_name")
        .agg(
            F.count_if(drinks).alias("orders_with_drinks"),
            F.count("order_id").alias("total_orders"),
            _average("value_eur", drinks).alias("aov_eur_drinks"),
            _average("value_eur", ~drinks).alias("aov_eur_no_drinks"),
            _average("value_eur").alias("aov_eur_all"),
        )
        .orderBy(F.desc("orders_with_drinks"), "order_country_code", "store_name")
    )


def partners_without_brand(
    lines: DataFrame, predictions: DataFrame, patterns: Sequence[str] = COLA_PATTERNS + PEPSI_PATTERNS
) -> DataFrame:
    """Listed partners none of whose sold products match the patterns, with their orders.

    One grouping answers both questions; no list of matching stores is built.
    """
    labelled = with_category(lines, predictions).filter("top_partner")
    return (
        labelled.groupBy("order_country_code", "store_name", "order_id")
        .agg(F.bool_or(matches_any(F.col("product_name"), patterns)).alias("hit"))
        .groupBy("order_country_code", "store_name")
        .agg(F.bool_or("hit").alias("hit"), F.count("order_id").alias("orders_count"))
        .filter(~F.col("hit"))
        .drop("hit")
    )


def stores_without_drinks(catalogue: DataFrame, predictions: DataFrame, lines: DataFrame) -> DataFrame:
    """Stores per city whose name offers no drink in any city, with their order counts.

    ``catalogue`` holds country, city, store and product; ``orders_count`` is null for a
    store that sold nothing in the window.
    """
    offers = with_category(catalogue, predictions, keep_unlabelled=True).groupBy(
        "order_country_code", "order_city_code", "store_name"
    ).agg(F.bool_or(is_drink(F.col("predicted_category"))).alias("has_drink"))
    names = offers.groupBy("store_name").agg(F.bool_or("has_drink").alias("any_drink"))
    dry = names.filter(~F.col("any_drink")).select("store_name")
    sold = (
        with_category(lines, predictions)
        .groupBy("order_country_code", "order_city_code", "store_name")
        .agg(F.countDistinct("order_id").alias("orders_count"))
    )
    place = ["order_country_code", "order_city_code", "store_name"]
    return offers.select(*place).join(dry, "store_name", "left_semi").join(sold, place, "left").select(
        *place, "orders_count"
    )


def top_product_names(lines: DataFrame, predictions: DataFrame, n: int = 50) -> DataFrame:
    """Most sold drink names after normalisation.

    Quantities are summed per product and name before the category join, so a best seller
    reaches it as one row and each name is normalised once.
    """
    sold = lines.groupBy("product_id", "product_name").agg(F.sum("bought_product_quantity").alias("q"))
    drinks = with_category(sold, predictions).filter(is_drink(F.col("predicted_category")))
    return (
        drinks.groupBy(normalise_name(F.col("product_name")).alias("normalized_product_name"))
        .agg(F.sum("q").alias("bought_product_quantity"))
        .orderBy(F.desc("bought_product_quantity"), "normalized_product_name")
        .limit(n)
    )

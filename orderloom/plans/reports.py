"""The four analyses from tables to report DataFrames."""

from __future__ import annotations

import datetime as dt
from collections.abc import Iterable, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from orderloom.operators import buckets, catalogue, drinks, features, hexes, models, orders, profile
from orderloom.session import materialise
from orderloom.sources.tables import stack

DEMAND_METRICS = ("orders", "sessions", "cvr_rows")


def customer_value_report(
    order_facts: DataFrame,
    order_pnl: DataFrame,
    customer_ltv: DataFrame,
    customer_lto: DataFrame,
    as_of: dt.date,
    countries: Iterable[str] | None = None,
) -> DataFrame:
    """Value panel, buckets by order value, one row per country and bucket.

    The panel is written once: the bucket limits and the report both read it.
    """
    panel = materialise(
        orders.customer_value(order_facts, order_pnl, customer_ltv, customer_lto, as_of, countries)
    )
    return buckets.bucket_report_customers(buckets.kmeans_buckets(panel, "country", "aov"))


def prime_order_report(
    order_facts: DataFrame,
    order_pnl: DataFrame,
    as_of: dt.date,
    countries: Iterable[str] | None = None,
    store: str | None = None,
) -> DataFrame:
    """The same report over single prime orders."""
    rows = materialise(orders.prime_orders(order_facts, order_pnl, as_of, countries, store=store))
    return buckets.bucket_report_orders(buckets.kmeans_buckets(rows, "country", "aov"))


def drinks_reports(
    order_facts: DataFrame,
    bought_products: DataFrame,
    availability: DataFrame,
    predictions: DataFrame,
    as_of: dt.date,
    days: int = 90,
    countries: Iterable[str] | None = None,
    n_partners: int = 100,
) -> dict[str, DataFrame]:
    """The drinks report's tables by name; predictions are relabelled by the keyword rules first."""
    relabelled = materialise(catalogue.one_category(catalogue.apply_rules(predictions)))
    partners = orders.top_partners(order_facts, as_of, days, n_partners, countries)
    lines = materialise(
        orders.order_lines(order_facts, bought_products, partners, as_of, days, countries)
    )
    offered = catalogue.available_products(
        order_facts, availability, as_of, days, countries, with_city=True
    )
    return {
        "kpis": drinks.drinks_kpis(lines, relabelled),
        "partners": drinks.partner_drinks(lines, relabelled),
        "partners_without_brand": drinks.partners_without_brand(lines, relabelled),
        "stores_without_drinks": drinks.stores_without_drinks(offered, relabelled, lines),
        "top_products": drinks.top_product_names(lines, relabelled),
        "uncategorised": catalogue.uncategorised(lines, relabelled),
    }


def hexagon_priorities(demand: DataFrame, metrics: Sequence[str]) -> DataFrame:
    """Density bucket, index and number of each metric next to the demand."""
    out = buckets.density_buckets(materialise(demand), metrics)
    for metric in metrics:
        out = buckets.bucket_number(out, metric)
    return out


def hexagon_feeds(priorities: DataFrame, metrics: Sequence[str], partner: str | None = None) -> DataFrame:
    """Map features of all metrics, to be written by metric or, with its name, by partner."""
    return stack(*[hexes.hex_feed(priorities, metric, partner) for metric in metrics])


def partner_feeds(
    hexagons: DataFrame,
    sessions: DataFrame,
    checkout_events: DataFrame,
    order_facts: DataFrame,
    partners: Sequence[str],
    start: dt.date,
    end: dt.date,
    metrics: Sequence[str] = DEMAND_METRICS,
    countries: Iterable[str] | None = None,
    cities: Iterable[str] | None = None,
) -> DataFrame:
    """Map features of the demand for each of a few partners, with buckets of its own."""
    feeds = []
    for partner in partners:
        demand = hexes.hex_demand_partner(
            hexagons, sessions, checkout_events, order_facts, partner, start, end, countries, cities
        )
        feeds.append(hexagon_feeds(hexagon_priorities(demand, metrics), metrics, partner))
    return stack(*feeds)


def coverage_reports(
    hexagons: DataFrame,
    sessions: DataFrame,
    checkout_events: DataFrame,
    order_facts: DataFrame,
    store_addresses: DataFrame,
    stores: DataFrame,
    start: dt.date,
    end: dt.date,
    partner: str | None = None,
    metrics: Sequence[str] = DEMAND_METRICS,
    countries: Iterable[str] | None = None,
    cities: Iterable[str] | None = None,
) -> dict[str, DataFrame]:
    """A city's demand against the delivery radii of its stores, or of one partner's.

    ``hexagons`` has the demand, its buckets and the number of stores that reach each
    hexagon, ``stores`` the hexagons and demand that each store reaches; ``points`` and
    ``feed`` are what a map shows of both.
    """
    demand = hexes.hex_demand_city(hexagons, sessions, checkout_events, order_facts, start, end, countries, cities)
    priorities = materialise(hexagon_priorities(demand, metrics))
    radii = materialise(hexes.store_radii(store_addresses, stores, hexagons, partner, cities))
    return {
        "hexagons": hexes.hexagon_coverage(priorities, radii),
        "stores": hexes.store_coverage(priorities, radii),
        "points": hexes.store_points(radii),
        "feed": hexagon_feeds(priorities, metrics),
    }


def category_reports(
    training: DataFrame, products: DataFrame, identity: str, trees: int = 100, test_fraction: float = 0.2
) -> dict[str, DataFrame]:
    """Category models by country, from labelled products to the relabelled catalogue.

    ``labels`` counts the labelled products, ``tested`` has the held-out predictions,
    ``report`` their scores by country, and ``catalogue`` the category of every product of
    ``products`` after the keyword rules.
    """
    fitted, tested = models.fit_by_country(training, identity, trees, test_fraction=test_fraction)
    tested = materialise(tested)
    scores = [
        models.classification_metrics(
            tested.filter(F.col("order_country_code") == country), "Category", "predicted_category"
        ).withColumn("order_country_code", F.lit(country))
        for country in sorted(fitted)
    ]
    return {
        "labels": catalogue.label_distribution(training, ["order_country_code", "Category"]),
        "tested": tested,
        "report": stack(*scores),
        "catalogue": catalogue.apply_rules(models.predict_by_country(products, fitted)),
    }


def user_type_features(customer_profiles: DataFrame, keep_leaking: bool = False) -> tuple[DataFrame, list[str]]:
    """Imputed, one-hot coded features with the ordinal target, and their names."""
    numeric, text = features.feature_columns(customer_profiles, keep_leaking=keep_leaking)
    filled = features.impute(customer_profiles, numeric, text)
    coded = features.one_hot(filled, text) if text else filled
    ordinal = F.when(F.col("user_type") == "A", 3).when(F.col("user_type") == "B", 2).otherwise(1)
    names = [c for c in coded.columns if c in numeric or any(c.startswith(f"{t}_") for t in text)]
    return coded.withColumn("user_type_ordinal", ordinal), names


def user_type_model(
    customer_profiles: DataFrame, trees: int = 200, test_fraction: float = 0.25
) -> dict[str, DataFrame]:
    """Correlations, held-out report, confusion counts and importances of the user-type forest."""
    coded, names = user_type_features(materialise(customer_profiles))
    ready = materialise(features.stratified_split(coded, "user_type", "customer_id", test_fraction))
    fitted = models.fit_forest(ready.filter(~F.col("is_test")), names, "user_type", trees)
    tested = fitted.transform(ready.filter("is_test"))
    return {
        "correlations": features.spearman(ready, names, "user_type_ordinal"),
        "report": models.classification_metrics(tested, "user_type", "predicted"),
        "confusion": models.confusion(tested, "user_type", "predicted"),
        "importances": models.importances(fitted, names, ready),
    }

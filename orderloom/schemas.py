"""Logical tables: column names and types every operator relies on."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import DataFrame
from pyspark.sql import types as T

REVENUE_TERMS = ("tcorev", "adve", "totbdr", "bwsrev", "mbsrsu", "serfig", "deacsu", "mfcgso", "qmcogs")
COST_TERMS = ("bcomfr", "dicofr", "wacofr", "bundfr", "rubcfr", "rabcfr", "otbcfr", "caocfr")

_DDL = {
    "order_facts": """order_id bigint, customer_id bigint, order_country_code string,
        order_city_code string, order_activated_local_at timestamp_ntz, order_final_status string,
        order_parent_relationship_type string, order_is_first_delivered_order boolean,
        order_is_prime boolean, order_vertical string, order_transacted_value_eur double,
        order_transacted_value_local double, store_name string, store_id bigint,
        store_address_id bigint""",
    "order_pnl": "order_id bigint, contribution_margin_eur double, "
    + ", ".join(f"{t}_eur double" for t in REVENUE_TERMS + COST_TERMS),
    "customer_ltv": "customer_id bigint, pltv_1y double, pltv_3y double, pltv_5y double",
    "customer_lto": """customer_id bigint, predicted_orders_12mo double,
        predicted_orders_36mo double, predicted_orders_60mo double, p_date date""",
    "bought_products": """order_id bigint, product_id bigint, product_name string,
        bought_product_quantity bigint""",
    "product_availability": """store_address_id bigint, product_id bigint, product_name string,
        product_is_available boolean, p_snapshot_date date""",
    "product_predictions": """order_country_code string, store_name string, product_id bigint,
        product_name string, predicted_category string""",
    "training_products": "order_country_code string, product_name string, Category string",
    "hexagons": """city_code string, h3_8_hash string, h3_8_center_lat double,
        h3_8_center_lon double, h3_8_polygon_wkt string""",
    "sessions": """dynamic_session_id string, h8_hexagon string, country_code string,
        city_code string, session_start_time_local timestamp_ntz,
        visited_store_address_ids array<bigint>, count_ce__order_created bigint""",
    "checkout_events": """order_id bigint, dynamic_session_id string, store_name string,
        country string, city string, p_creation_date date""",
    "store_addresses": """store_address_id bigint, store_id bigint, h3_hash_8 string,
        store_address_maximum_delivery_distance_meters double,
        store_address_is_deleted boolean, p_end_date date""",
    "stores": """store_id bigint, store_name string, city_code string, store_is_enabled boolean,
        store_maximum_delivery_distance double, p_end_date date""",
    "payments": "order_id bigint, payment_method string",
    "installs": """app_install_user_id bigint, app_install_network_name string,
        app_install_is_organic boolean""",
    "pricing_discounts": "order_id bigint, discount_type string",
    "store_segmentation": """store_id bigint, segmentation string, country_code string,
        p_end_date date""",
    "first_order_levels": "order_id bigint, first_order_in_vertical_date date",
}

_TYPES = {
    "bigint": T.LongType(),
    "string": T.StringType(),
    "double": T.DoubleType(),
    "boolean": T.BooleanType(),
    "date": T.DateType(),
    "timestamp_ntz": T.TimestampNTZType(),
    "array<bigint>": T.ArrayType(T.LongType()),
}


def _struct(ddl: str) -> T.StructType:
    return T.StructType([T.StructField(n, _TYPES[t]) for n, t in (field.split() for field in ddl.split(","))])


SCHEMAS: dict[str, T.StructType] = {name: _struct(ddl) for name, ddl in _DDL.items()}

# A type on the left may stand in for the type on the right without a cast.
_ACCEPTED = {
    ("timestamp", "timestamp_ntz"),
    ("int", "bigint"),
    ("float", "double"),
}


def check(df: DataFrame, table: str, columns: Iterable[str] | None = None) -> DataFrame:
    """Raise when ``df`` lacks a column of ``table`` or holds it with another type."""
    wanted = {f.name: f.dataType.simpleString() for f in SCHEMAS[table].fields}
    have = {f.name: f.dataType.simpleString() for f in df.schema.fields}
    problems = []
    for name in columns or wanted:
        if name not in have:
            problems.append(f"{name} is missing")
        elif have[name] != wanted[name] and (have[name], wanted[name]) not in _ACCEPTED:
            problems.append(f"{name} is {have[name]}, expected {wanted[name]}")
    if problems:
        raise ValueError(f"{table}: " + "; ".join(problems))
    return df

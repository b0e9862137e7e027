"""The driver's tables seen as the logical tables of ``schemas``.

Expressions kept as SQL text are valid in Spark and in ANSI engines alike, so that
the checks can state the same mapping once.
"""

from __future__ import annotations

import datetime as dt
from functools import cached_property

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

AS_OF = dt.date(1996, 12, 31)
COUNTRIES = ("AFRICA", "AMERICA", "ASIA", "EUROPE", "MIDDLE EAST")
CITIES = tuple(f"NATION_{i}" for i in range(25))
SESSION_START, SESSION_END = dt.date(2024, 1, 1), dt.date(2024, 1, 28)
PARTNER = "Supplier#000000003"

# Order dates are whole days, so (day, key) fits one number and its minimum is the first order.
FIRST_ORDER = "shiftleft(CAST(unix_date(to_date(o_orderdate)) AS BIGINT), 40) | o_orderkey"
# Order-level margin and cost terms out of the order's lines; several may be null.
PNL_TERMS = {
    "contribution_margin_eur": "sum(l_extendedprice * (1 - l_discount)) * 0.1",
    "tcorev_eur": "sum(l_extendedprice * 0.2)",
    "adve_eur": "sum(l_extendedprice * l_tax)",
    "totbdr_eur": "sum(l_extendedprice * 0.01)",
    "bwsrev_eur": "sum(l_extendedprice * 0.005)",
    "mbsrsu_eur": "CAST(count(*) AS DOUBLE)",
    "serfig_eur": "sum(l_quantity)",
    "deacsu_eur": "min(nullif(l_discount, 0)) * 100",
    "mfcgso_eur": "sum(l_extendedprice * 0.03)",
    "qmcogs_eur": "sum(l_extendedprice * 0.02)",
    "bcomfr_eur": "sum(l_extendedprice * l_discount) * 0.1",
    "dicofr_eur": "min(nullif(l_discount, 0))",
    "wacofr_eur": "sum(l_quantity) * 0.01",
    "bundfr_eur": "min(nullif(l_tax, 0))",
    "rubcfr_eur": "CAST(sum(CASE WHEN l_returnflag = 'R' THEN 1 END) AS DOUBLE)",
    "rabcfr_eur": "CAST(count(*) AS DOUBLE) * 0.5",
    "otbcfr_eur": "max(nullif(l_tax, 0))",
    "caocfr_eur": "CAST(sum(CASE WHEN l_linestatus = 'O' THEN 1 END) AS DOUBLE)",
}
STATUS = "CASE WHEN o_orderstatus <> 'O' THEN 'DeliveredStatus' ELSE 'CanceledStatus' END"
PARENT = "CASE WHEN o_orderpriority = '5-LOW' THEN 'CHILD' END"
VERTICAL = "CASE WHEN o_orderpriority IN ('1-URGENT', '2-HIGH') THEN 'QCommerce' ELSE 'Food' END"
PAYMENT = """CASE substr(o_orderpriority, 1, 1) WHEN '1' THEN 'CREDIT_CARD' WHEN '2' THEN 'CASH'
    WHEN '3' THEN 'APPLE_PAY' WHEN '4' THEN 'GOOGLE_PAY' ELSE 'BANK_TRANSFER' END"""
SEGMENT = """CASE s_suppkey % 5 WHEN 0 THEN 'Top City' WHEN 1 THEN 'Top Country'
    WHEN 2 THEN 'Local Selection' WHEN 3 THEN 'Long Tail' ELSE 'Big Chain' END"""
NETWORK = """CASE c_custkey % 5 WHEN 0 THEN 'Google Ads ACI' WHEN 1 THEN 'Apple Search Ads'
    WHEN 2 THEN 'Aura ironSource' WHEN 3 THEN 'Untrusted Devices' ELSE 'Tiktok SAN' END"""
CATEGORY = """CASE WHEN p_name LIKE '%bolt' OR p_name LIKE '%ring' OR p_name LIKE '%widget'
        OR p_name LIKE '%gizmo' THEN ' Drink '
    WHEN p_name LIKE '%gear' OR p_name LIKE '%plate' OR p_name LIKE '%rod' THEN 'other' END"""

# Product names in the scripts of six countries, one per noun of the part names.
LOCAL_COUNTRIES = ("PL", "UA", "KZ", "KG", "GE", "AM")
LOCAL_NAMES = {
    "anvil": ("Ciacho z kremem", "Соус сирний", "Хлеб тандырный", "Соус острый", "პურის Roll", "դոլմա տնական"),
    "bolt": ("Woda mineralna", "Вода газована", "Вода без газа", "Компот домашний", "მინერალური წყალი", "Հանքային ջուր"),
    "gear": ("Lody waniliowe", "Хліб житній", "Картофель фри", "Popcorn сладкий", "ხაჭაპური", "Սուրճ սև"),
    "gizmo": ("Pepsi Max", "Пепсі 0.5л", "Пепси", "ПЕПСИ Блэк", "პეპსი", "Փեփսի"),
    "plate": ("Frytki duże", "Картопля по-селянськи", "Плов", "Лагман", "ხინკალი", "Խորոված"),
    "ring": ("Sok jabłkowy", "Узвар", "Лимонад тархун", "Чай зелёный", "ლიმონათი", "Լիմոնադ"),
    "rod": ("Coca-Cola lody", "Пепероні", "Кебаб", "Шашлык", "მწვადი", "Լավաշ"),
    "widget": ("Coca-Cola 500 ml", "Кока-Кола 1 л", "Кока Кола 0.5", "Coca Cola Zero", "კოკა-კოლა", "Կոկա-Կոլա"),
}


def cell_sql(key: str) -> str:
    """A resolution-8 cell id text made out of an integer key: its base-7 digits."""
    head = (1 << 59) | (8 << 52) | (15 << 45) | ((1 << 21) - 1)
    digits = " + ".join(f"({key} div {7**i}) % 7 * {1 << (21 + 3 * i)}" for i in range(8))
    return f"lower(hex({head} + {digits}))"


class Testbed:
    __test__ = False

    def __init__(self, spark: SparkSession, folder: str):
        self.spark = spark
        self.folder = folder

    def raw(self, table: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.folder.rstrip('/')}/{table}.parquet")

    @cached_property
    def places(self) -> DataFrame:
        nation, region = self.raw("nation"), self.raw("region")
        return nation.join(region, nation.n_regionkey == region.r_regionkey).select(
            "n_nationkey", F.col("n_name").alias("city"), F.col("r_name").alias("country")
        )

    def order_facts(self, stores: bool = True) -> DataFrame:
        """``stores=False`` leaves the store columns null and the order lines unread."""
        orders = self.raw("orders")
        customers = self.raw("customer").join(self.places, F.col("c_nationkey") == F.col("n_nationkey"))
        first = (
            orders.filter("o_orderstatus <> 'O'")
            .groupBy("o_custkey")
            .agg(F.expr(f"min({FIRST_ORDER}) AS first"))
            .selectExpr("first & 1099511627775 AS first_key", "true AS is_first")
        )
        out = orders.join(customers, F.col("o_custkey") == F.col("c_custkey")).join(
            first, F.col("o_orderkey") == F.col("first_key"), "left"
        )
        if stores:
            chosen = self.raw("lineitem").groupBy("l_orderkey").agg(F.min("l_suppkey").alias("store_id"))
            names = self.raw("supplier").select("s_suppkey", F.col("s_name").alias("store_name"))
            out = out.join(chosen, F.col("o_orderkey") == F.col("l_orderkey"), "left").join(
                names, F.col("store_id") == F.col("s_suppkey"), "left"
            )
        else:
            out = out.withColumns(
                {"store_id": F.lit(None).cast("long"), "store_name": F.lit(None).cast("string")}
            )
        return out.selectExpr(
            "o_orderkey AS order_id",
            "o_custkey AS customer_id",
            "country AS order_country_code",
            "city AS order_city_code",
            "o_orderdate AS order_activated_local_at",
            f"{STATUS} AS order_final_status",
            f"{PARENT} AS order_parent_relationship_type",
            "coalesce(is_first, false) AS order_is_first_delivered_order",
            "o_orderpriority = '1-URGENT' AS order_is_prime",
            f"{VERTICAL} AS order_vertical",
            "o_totalprice AS order_transacted_value_eur",
            "o_totalprice * 4 AS order_transacted_value_local",
            "store_name",
            "store_id",
            "store_id AS store_address_id",
        )

    def order_pnl(self) -> DataFrame:
        return (
            self.raw("lineitem")
            .groupBy(F.col("l_orderkey").alias("order_id"))
            .agg(*[F.expr(f"{sql} AS {name}") for name, sql in PNL_TERMS.items()])
        )

    def customer_ltv(self) -> DataFrame:
        base = "CASE WHEN c_acctbal > 0 THEN c_acctbal END"
        return self.raw("customer").selectExpr(
            "c_custkey AS customer_id", *[f"{base} * {years} AS pltv_{years}y" for years in (1, 3, 5)]
        )

    def customer_lto(self) -> DataFrame:
        base = "CASE WHEN c_acctbal > 0 THEN c_acctbal END / 100"
        day = f"date_sub(DATE '{AS_OF}', CAST(1 + c_custkey % 2 AS INT))"
        return self.raw("customer").selectExpr(
            "c_custkey AS customer_id",
            *[f"{base} * {m // 12} AS predicted_orders_{m}mo" for m in (12, 36, 60)],
            f"{day} AS p_date",
        )

    def _sold(self) -> DataFrame:
        lines, parts = self.raw("lineitem"), self.raw("part")
        return lines.join(parts, lines.l_partkey == parts.p_partkey)

    def bought_products(self) -> DataFrame:
        return self._sold().selectExpr(
            "l_orderkey AS order_id",
            "l_partkey AS product_id",
            "p_name AS product_name",
            "CAST(l_quantity AS BIGINT) AS bought_product_quantity",
        )

    def product_availability(self) -> DataFrame:
        return self._sold().selectExpr(
            "l_suppkey AS store_address_id",
            "l_partkey AS product_id",
            "p_name AS product_name",
            "l_returnflag <> 'R' AS product_is_available",
            "to_date(l_shipdate) AS p_snapshot_date",
        )

    def product_predictions(self) -> DataFrame:
        """One row per product and country, as predictions repeat a product over stores."""
        countries = ", ".join(f"'{c}'" for c in COUNTRIES)
        return self.raw("part").selectExpr(
            f"explode(array({countries})) AS order_country_code",
            "'any' AS store_name",
            "p_partkey AS product_id",
            "p_name AS product_name",
            f"{CATEGORY} AS predicted_category",
        )

    def local_products(self) -> DataFrame:
        """Products named in six languages, with a guessed category."""

        def pick(words: tuple[str, ...]) -> str:
            return "element_at(array(" + ", ".join(f"'{w}'" for w in words) + "), CAST(p_partkey % 6 + 1 AS INT))"

        nouns = " ".join(f"WHEN '{noun}' THEN {pick(names)}" for noun, names in LOCAL_NAMES.items())
        return self.raw("part").selectExpr(
            f"{pick(LOCAL_COUNTRIES)} AS order_country_code",
            "'store ' || p_brand AS store_name",
            "p_partkey AS product_id",
            f"CASE substring_index(p_name, ' ', -1) {nouns} END || ' ' || p_size || ' ml' AS product_name",
            "CASE p_size % 3 WHEN 0 THEN ' Drink' WHEN 1 THEN 'OTHER ' END AS predicted_category",
        )

    def training_products(self) -> DataFrame:
        return (
            self.raw("documents")
            .join(self.raw("labels"), "doc_id")
            .selectExpr(
                "doc_id",
                "lang AS order_country_code",
                "text AS product_name",
                "CASE WHEN quality = 1 THEN 'drink' ELSE 'other' END AS Category",
            )
        )

    def hexagons(self) -> DataFrame:
        steps = ((-0.005, -0.005), (0.005, -0.005), (0.005, 0.005), (-0.005, 0.005), (-0.005, -0.005))
        ring = " || ', ' || ".join(
            f"format_string('%.3f %.3f', lon + CAST({dx} AS DOUBLE), lat + CAST({dy} AS DOUBLE))" for dx, dy in steps
        )
        return (
            self.raw("events")
            .select("user_id")
            .distinct()
            .selectExpr(
                "user_id",
                "round(40.0D + 0.01D * (user_id % 37), 6) AS lat",
                "round(20.0D + 0.01D * (user_id div 37), 6) AS lon",
            )
            .selectExpr(
                "'NATION_' || (user_id % 25) AS city_code",
                f"{cell_sql('user_id')} AS h3_8_hash",
                "lat AS h3_8_center_lat",
                "lon AS h3_8_center_lon",
                f"CASE WHEN user_id % 10 <> 9 THEN 'POLYGON ((' || {ring} || '))' END AS h3_8_polygon_wkt",
            )
        )

    def _events(self) -> DataFrame:
        events = self.raw("events").selectExpr(
            "*", "CAST(get_json_object(props, '$.k') AS BIGINT) AS k", "CAST(user_id % 25 AS INT) AS nation"
        )
        return events.join(self.places, F.col("nation") == F.col("n_nationkey"))

    def sessions(self) -> DataFrame:
        return self._events().selectExpr(
            "CAST(event_id AS STRING) AS dynamic_session_id",
            f"{cell_sql('user_id')} AS h8_hexagon",
            "country AS country_code",
            "city AS city_code",
            "ts AS session_start_time_local",
            "array(k % 10, (k * 7) % 10) AS visited_store_address_ids",
            "CAST(CASE WHEN event_type = 'purchase' THEN 1 ELSE 0 END AS BIGINT) AS count_ce__order_created",
        )

    def checkout_events(self) -> DataFrame:
        return (
            self._events()
            .filter("event_type = 'purchase'")
            .selectExpr(
                "event_id AS order_id",
                "CAST(event_id AS STRING) AS dynamic_session_id",
                "'Supplier#' || lpad(CAST(k % 10 AS STRING), 9, '0') AS store_name",
                "country",
                "city",
                "to_date(ts) AS p_creation_date",
            )
        )

    def store_addresses(self) -> DataFrame:
        return self.raw("supplier").selectExpr(
            "s_suppkey AS store_address_id",
            "s_suppkey AS store_id",
            f"{cell_sql('s_suppkey')} AS h3_hash_8",
            """CASE WHEN s_suppkey % 3 <> 0 THEN CAST(s_suppkey % 500 * 5 + 900 AS DOUBLE) END
                AS store_address_maximum_delivery_distance_meters""",
            "s_suppkey % 11 = 5 AS store_address_is_deleted",
            f"CASE WHEN s_suppkey % 7 = 0 THEN DATE '{AS_OF}' END AS p_end_date",
        )

    def stores(self) -> DataFrame:
        return self.raw("supplier").selectExpr(
            "s_suppkey AS store_id",
            "s_name AS store_name",
            "'NATION_' || (s_suppkey % 25) AS city_code",
            "s_suppkey % 13 <> 4 AS store_is_enabled",
            "CAST(s_suppkey % 500 * 10 + 1000 AS DOUBLE) AS store_maximum_delivery_distance",
            "CAST(NULL AS DATE) AS p_end_date",
        )

    def payments(self) -> DataFrame:
        return self.raw("orders").selectExpr("o_orderkey AS order_id", f"{PAYMENT} AS payment_method")

    def installs(self) -> DataFrame:
        return self.raw("customer").selectExpr(
            "CASE WHEN c_custkey % 9 <> 0 THEN c_custkey END AS app_install_user_id",
            f"{NETWORK} AS app_install_network_name",
            "c_custkey % 2 = 0 AS app_install_is_organic",
        )

    def pricing_discounts(self) -> DataFrame:
        return self.raw("orders").selectExpr(
            "o_orderkey AS order_id",
            "CASE WHEN o_orderkey % 4 = 0 THEN 'PROMOTOOL' ELSE 'OTHER' END AS discount_type",
        )

    def store_segmentation(self) -> DataFrame:
        return self.raw("supplier").selectExpr(
            "s_suppkey AS store_id",
            f"{SEGMENT} AS segmentation",
            "'EUROPE' AS country_code",
            f"CASE WHEN s_suppkey % 7 = 0 THEN DATE '{AS_OF}' END AS p_end_date",
        )

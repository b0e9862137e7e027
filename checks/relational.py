"""Scans, expressions, joins, aggregates and windows over whole tables."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from checks.logical_sql import AS_OF as AS_OF_SQL
from checks.logical_sql import contains_any, normalised
from checks.registry import query, rounded
from orderloom.functions import dates, geo, numbers, text
from orderloom.operators import buckets, catalogue, drinks, hexes, orders, profile, ranks
from orderloom.session import shared_path
from orderloom.sources import tables
from checks.testbed import AS_OF, COUNTRIES, PARTNER, SESSION_END, SESSION_START, Testbed

TIME = "order_activated_local_at"


@query(
    """SELECT order_id, customer_id, order_country_code, order_city_code, order_final_status,
        order_parent_relationship_type, order_is_first_delivered_order, order_is_prime, order_vertical,
        order_transacted_value_local, store_name, store_id FROM order_facts""",
    ["order_facts"],
)
def order_facts_scan(tb: Testbed) -> DataFrame:
    return tables.for_values(tb.order_facts(), "order_country_code", COUNTRIES).select(
        "order_id", "customer_id", "order_country_code", "order_city_code", "order_final_status",
        "order_parent_relationship_type", "order_is_first_delivered_order", "order_is_prime",
        "order_vertical", "order_transacted_value_local", "store_name", "store_id",
    )


@query("SELECT order_country_code, store_name, orders, rank FROM partners", ["partners"])
def top_partners(tb: Testbed) -> DataFrame:
    return orders.top_partners(tb.order_facts(), AS_OF, 90, 5, COUNTRIES)


@query(
    """SELECT * FROM (SELECT order_country_code, store_name, count(DISTINCT order_id) AS orders,
            row_number() OVER (PARTITION BY order_country_code ORDER BY count(DISTINCT order_id) DESC, store_name) AS rank
        FROM recent_food WHERE order_parent_relationship_type IS NULL AND store_name IS NOT NULL GROUP BY 1, 2) WHERE rank <= 100""",
    ["recent_food"],
)
def top_partners_of_a_country(tb: Testbed) -> DataFrame:
    """With the operator's own number of partners."""
    return orders.top_partners(tb.order_facts(), AS_OF, 90, countries=COUNTRIES)


@query(
    """SELECT order_country_code AS country, o.order_id, order_transacted_value_eur AS aov,
        round(contribution_margin_eur, 6) AS contribution_margin_eur
    FROM value_orders o LEFT JOIN pnl USING (order_id)
    WHERE order_is_prime AND order_vertical = 'QCommerce'""",
    ["value_orders", "pnl"],
)
def prime_orders(tb: Testbed) -> DataFrame:
    rows = orders.prime_orders(tb.order_facts(stores=False), tb.order_pnl(), AS_OF, COUNTRIES)
    return rounded(rows, {"contribution_margin_eur": 6})


@query(
    f"""SELECT order_id,
        order_activated_local_at >= DATE '1995-01-01' AND order_activated_local_at < {AS_OF_SQL} + 1 AS in_years,
        order_activated_local_at >= date_trunc('month', {AS_OF_SQL} - INTERVAL 24 MONTH)
            AND order_activated_local_at < {AS_OF_SQL} + 1 AS in_months,
        order_activated_local_at >= {AS_OF_SQL} - 90 AND order_activated_local_at < {AS_OF_SQL} + 1 AS in_days,
        CAST(order_activated_local_at AS DATE) BETWEEN DATE '1997-03-01' AND DATE '1998-02-28' AS in_range,
        order_activated_local_at BETWEEN DATE '1997-03-01' AND DATE '1998-02-28' AS in_raw_range
    FROM order_facts""",
    ["order_facts"],
)
def calendar_windows(tb: Testbed) -> DataFrame:
    t = F.col(TIME)
    start, end = dt.date(1997, 3, 1), dt.date(1998, 2, 28)
    return tb.order_facts(stores=False).select(
        "order_id",
        dates.since_last_year(t, AS_OF).alias("in_years"),
        dates.since_months(t, AS_OF, 24).alias("in_months"),
        dates.since_days(t, AS_OF, 90).alias("in_days"),
        dates.between_days(t, start, end).alias("in_range"),
        dates.between_days(t, start, end, inclusive_end=False).alias("in_raw_range"),
    )


@query(
    """SELECT datesub('month', o_orderdate, l_shipdate) AS months, count(*) AS n, bool_or(l_shipdate < o_orderdate) AS backward
    FROM lineitem JOIN orders ON l_orderkey = o_orderkey GROUP BY 1"""
)
def month_diff(tb: Testbed) -> DataFrame:
    lines = tb.raw("lineitem").join(tb.raw("orders"), F.col("l_orderkey") == F.col("o_orderkey"))
    months = dates.full_months(F.col("o_orderdate"), F.col("l_shipdate")).cast("long")
    return lines.groupBy(months.alias("months")).agg(
        F.count(F.lit(1)).alias("n"), F.bool_or(F.expr("l_shipdate < o_orderdate")).alias("backward")
    )


@query(
    """SELECT event_type, CASE WHEN hour(ts) <= 6 THEN 'night' WHEN hour(ts) <= 12 THEN 'morning'
        WHEN hour(ts) <= 18 THEN 'afternoon' ELSE 'evening' END AS part, count(*) AS n
    FROM events GROUP BY 1, 2"""
)
def day_parts(tb: Testbed) -> DataFrame:
    return tb.raw("events").groupBy("event_type", dates.day_part(F.col("ts")).alias("part")).agg(
        F.count(F.lit(1)).alias("n")
    )


@query("SELECT isodow(ts) AS day, count(*) AS n FROM events GROUP BY 1")
def dow_iso(tb: Testbed) -> DataFrame:
    day = dates.week_day(F.col("ts"), "iso").cast("long")
    return tb.raw("events").groupBy(day.alias("day")).agg(F.count(F.lit(1)).alias("n"))


@query("SELECT dayofweek(ts) + 1 AS day, count(*) AS n FROM events GROUP BY 1")
def dow_sunday(tb: Testbed) -> DataFrame:
    day = dates.week_day(F.col("ts")).cast("long")
    return tb.raw("events").groupBy(day.alias("day")).agg(F.count(F.lit(1)).alias("n"))


@query(
    """SELECT l_suppkey, l_returnflag,
        round(CASE WHEN o <> 0 THEN q / o ELSE 0 END, 6) AS zero_ratio,
        round(q / nullif(o, 0), 6) AS null_ratio, round(o / nullif(o, 0), 6) AS same_ratio
    FROM (SELECT l_suppkey, l_returnflag, sum(l_quantity) AS q,
        sum(CASE WHEN l_linestatus = 'O' AND l_discount = 0.1 THEN l_quantity ELSE 0 END) AS o
        FROM lineitem GROUP BY 1, 2)"""
)
def guarded_ratios(tb: Testbed) -> DataFrame:
    part = F.when((F.col("l_linestatus") == "O") & (F.col("l_discount") == 0.1), F.col("l_quantity")).otherwise(0.0)
    sums = tb.raw("lineitem").groupBy("l_suppkey", "l_returnflag").agg(
        F.sum("l_quantity").alias("q"), F.sum(part).alias("o")
    )
    return rounded(
        sums.select(
            "l_suppkey",
            "l_returnflag",
            numbers.ratio_or_zero(F.col("q"), F.col("o")).alias("zero_ratio"),
            numbers.ratio_or_null(F.col("q"), F.col("o")).alias("null_ratio"),
            numbers.ratio_or_null(F.col("o"), F.col("o")).alias("same_ratio"),
        )
    )


@query(
    """SELECT o_custkey, CAST(trunc(lo) AS BIGINT) || ' - ' || CAST(trunc(hi) AS BIGINT) AS label,
        CAST(trunc(hi) AS BIGINT) AS upper, CAST(trunc(lo) AS BIGINT) + 1 AS open_upper
    FROM (SELECT o_custkey, min(o_totalprice) AS lo, max(o_totalprice) AS hi FROM orders GROUP BY 1)"""
)
def range_labels(tb: Testbed) -> DataFrame:
    limits = tb.raw("orders").groupBy("o_custkey").agg(
        F.min("o_totalprice").alias("lo"), F.max("o_totalprice").alias("hi")
    )
    label = text.range_label(F.col("lo"), F.col("hi"))
    opened = F.concat(F.lit(">"), F.col("lo").cast("long").cast("string"))
    return limits.select(
        "o_custkey", label.alias("label"), text.upper_limit(label).alias("upper"),
        text.upper_limit(opened).alias("open_upper"),
    )


@query(
    f"""SELECT h3_8_hash AS cell, lower(to_hex(((('0x' || h3_8_hash)::BIGINT & {~(15 << 52)})
        | {7 << 52}) | {(1 << 24) - 1})) AS parent, count(*) AS n
    FROM hexagons JOIN sessions ON h8_hexagon = h3_8_hash GROUP BY 1, 2""",
    ["hexagons", "sessions"],
)
def h3_parent(tb: Testbed) -> DataFrame:
    cells = tb.sessions().groupBy(F.col("h8_hexagon").alias("cell")).agg(F.count(F.lit(1)).alias("n"))
    return cells.select("cell", geo.h3_text(geo.h3_parent(geo.h3_to_long(F.col("cell")), 7)).alias("parent"), "n")


RING_SQL = """SELECT h3_8_hash, unnest(string_split(regexp_extract(h3_8_polygon_wkt, '\\(\\(([^()]*)\\)', 1), ', ')) AS p,
        generate_subscripts(string_split(regexp_extract(h3_8_polygon_wkt, '\\(\\(([^()]*)\\)', 1), ', '), 1) - 1 AS pos
    FROM hexagons WHERE h3_8_polygon_wkt IS NOT NULL"""


@query(
    f"""SELECT h3_8_hash, pos, CAST(split_part(p, ' ', 1) AS DOUBLE) AS lon,
        CAST(split_part(p, ' ', 2) AS DOUBLE) AS lat FROM ({RING_SQL})""",
    ["hexagons"],
)
def wkt_points(tb: Testbed) -> DataFrame:
    ring = tb.hexagons().select("h3_8_hash", F.posexplode(geo.wkt_ring(F.col("h3_8_polygon_wkt"))))
    return ring.select("h3_8_hash", F.col("pos").cast("long").alias("pos"), "col.lon", "col.lat")


@query(
    f"""SELECT h.h3_8_hash, CASE WHEN g IS NOT NULL THEN '{{"type":"Polygon","coordinates":[[' || g || ']]}}' END AS geometry
    FROM hexagons h LEFT JOIN (SELECT h3_8_hash, string_agg('[' || CAST(split_part(p, ' ', 1) AS DOUBLE) || ','
        || CAST(split_part(p, ' ', 2) AS DOUBLE) || ']', ',' ORDER BY pos) AS g FROM ({RING_SQL}) GROUP BY 1) USING (h3_8_hash)""",
    ["hexagons"],
)
def wkt_geojson(tb: Testbed) -> DataFrame:
    return tb.hexagons().select(
        "h3_8_hash", geo.ring_geojson(geo.wkt_ring(F.col("h3_8_polygon_wkt"))).alias("geometry")
    )


AREA_RINGS = """SELECT s_suppkey, i AS polygon, j AS ring, k AS pos, s_suppkey % 180 + i + k % 2 + j / 4.0 AS lon,
        s_suppkey % 70 + k / 2 + j / 4.0 AS lat, CASE WHEN s_suppkey % 3 = 1 THEN CAST(10 * i + j - k AS DOUBLE) END AS alt
    FROM supplier, range(2) a(i), range(2) b(j), range(4) c(k) WHERE i = 0 OR s_suppkey % 2 = 0"""


def area_texts(tb: Testbed) -> DataFrame:
    """Areas of one or two polygons with a hole each, some with heights, some with measures, some broken."""
    def position(i: int, j: int, k: int) -> str:
        third = f"' ' || (CASE s_suppkey % 3 WHEN 1 THEN {10 * i + j - k} ELSE 7 END)"
        lon, lat = f"(s_suppkey % 180 + {i + k % 2 + j / 4}D)", f"(s_suppkey % 70 + {k // 2 + j / 4}D)"
        return f"{lon} || '  ' || {lat} || CASE WHEN s_suppkey % 3 = 0 THEN '' ELSE {third} END"

    def polygon(i: int) -> str:
        rings = " || '),(' || ".join(" || ' , ' || ".join(position(i, j, k) for k in range(4)) for j in range(2))
        return f"'((' || {rings} || '))'"

    flag = "CASE s_suppkey % 3 WHEN 0 THEN '' WHEN 1 THEN ' Z ' ELSE ' m' END"
    area = f"CASE WHEN s_suppkey % 2 = 0 THEN 'MULTIPOLYGON' || {flag} || '(' || {polygon(0)} || ',' || {polygon(1)} || ')' ELSE 'polygon' || {flag} || {polygon(0)} END"
    broken = "CASE WHEN s_suppkey % 11 = 0 THEN replace(area, '))', ')') WHEN s_suppkey % 13 = 0 THEN replace(area, '.25', ',x') ELSE area END"
    return tb.raw("supplier").select("s_suppkey", F.expr(area).alias("area")).select("s_suppkey", F.expr(broken).alias("area"))


@query(
    f"""SELECT s_suppkey, CAST(polygon AS INT) AS polygon, CAST(ring AS INT) AS ring, CAST(pos AS INT) AS pos,
        CAST(lon AS DOUBLE) AS lon, CAST(s_suppkey % 70 + pos // 2 + ring / 4.0 AS DOUBLE) AS lat, alt
    FROM ({AREA_RINGS}) WHERE s_suppkey % 11 <> 0 AND s_suppkey % 13 <> 0""",
    [],
)
def wkt_areas(tb: Testbed) -> DataFrame:
    """Every position of every ring of every polygon."""
    rows = area_texts(tb).select("s_suppkey", F.posexplode(geo.wkt_polygons(F.col("area"))).alias("polygon", "p"))
    rows = rows.select("s_suppkey", "polygon", F.posexplode("p").alias("ring", "r"))
    return rows.select("s_suppkey", "polygon", "ring", F.posexplode("r").alias("pos", "x")).select("s_suppkey", "polygon", "ring", "pos", "x.*")


@query(
    """SELECT s_suppkey, CASE WHEN s_suppkey % 2 = 0 THEN 'MultiPolygon' ELSE 'Polygon' END AS type,
        CAST(s_suppkey % 180 + 1 + (s_suppkey % 2 = 0)::INT + 0.25 AS DOUBLE) AS lon, CAST(s_suppkey % 70 + 1.25 AS DOUBLE) AS lat FROM supplier
    WHERE s_suppkey % 11 <> 0 AND s_suppkey % 13 <> 0""",
    [],
)
def area_geojson(tb: Testbed) -> DataFrame:
    """The kind of each feature and the last position of its last hole, read back from the GeoJSON text."""
    shown = area_texts(tb).select("s_suppkey", geo.wkt_geojson(F.col("area")).alias("g")).filter("g IS NOT NULL")
    at = F.when(F.col("s_suppkey") % 2 == 0, F.get_json_object("g", "$.coordinates[1][1][3]")).otherwise(F.get_json_object("g", "$.coordinates[1][3]"))
    last = F.from_json(at, "array<double>")
    return shown.select("s_suppkey", F.get_json_object("g", "$.type").alias("type"), last[0].alias("lon"), last[1].alias("lat"))


@query(
    """SELECT CAST(s_suppkey AS VARCHAR) AS h8_hexagon, CASE WHEN s_suppkey % 11 = 0 THEN 'brackets' ELSE 'number' END AS problem
    FROM supplier WHERE s_suppkey % 11 = 0 OR s_suppkey % 13 = 0""",
    [],
)
def unreadable_areas(tb: Testbed) -> DataFrame:
    cells = area_texts(tb).select(F.col("s_suppkey").cast("string").alias("h8_hexagon"), F.col("area").alias("h3_geom"))
    return hexes.unreadable_areas(cells).select("h8_hexagon", "problem")


GLOBE = """p AS (SELECT c_custkey AS h8_hexagon, CASE c_custkey % 3 WHEN 0 THEN 90 - (c_custkey % 50) / 100.0 WHEN 1 THEN (c_custkey % 50) / 100.0 - 90
        ELSE (c_custkey % 40) / 100.0 END AS lat, CASE c_custkey % 3 WHEN 2 THEN 180 - (c_custkey % 37) / 50.0 ELSE c_custkey * 7 % 360 - 180 END AS lon FROM customer),
    c AS (SELECT s_suppkey, CASE s_suppkey % 3 WHEN 0 THEN 89.75 WHEN 1 THEN -89.8 ELSE 0.15 END AS lat,
        CASE s_suppkey % 3 WHEN 2 THEN 0.3 - 180 ELSE s_suppkey * 11 % 360 - 180 END AS lon, CASE WHEN s_suppkey % 10 = 0 THEN 2e7 ELSE 977.0 * (s_suppkey % 90) END AS radius_m FROM supplier)"""


@query(
    f"""WITH {GLOBE} SELECT h8_hexagon, CAST(count(s_suppkey) AS BIGINT) AS n_stores FROM p LEFT JOIN c ON
        2 * 6371008.8 * asin(sqrt(least(1.0, pow(sin(radians(p.lat - c.lat) / 2), 2)
        + cos(radians(c.lat)) * cos(radians(p.lat)) * pow(sin(radians(p.lon - c.lon) / 2), 2)))) <= radius_m GROUP BY 1""",
    [],
)
def coverage_of_the_globe(tb: Testbed) -> DataFrame:
    """Circles over both poles, across the 180th meridian, and almost around the Earth."""
    places = tb.raw("customer").selectExpr(
        "c_custkey AS h8_hexagon",
        "CAST(CASE c_custkey % 3 WHEN 0 THEN 90 - (c_custkey % 50) / 100D WHEN 1 THEN (c_custkey % 50) / 100D - 90 ELSE (c_custkey % 40) / 100D END AS DOUBLE) AS h3_8_lat",
        "CAST(CASE c_custkey % 3 WHEN 2 THEN 180 - (c_custkey % 37) / 50D ELSE c_custkey * 7 % 360 - 180 END AS DOUBLE) AS h3_8_lon",
    )
    circles = tb.raw("supplier").selectExpr(
        "s_suppkey AS store_address_id", "CASE s_suppkey % 3 WHEN 0 THEN 89.75D WHEN 1 THEN -89.8D ELSE 0.15D END AS h3_8_lat",
        "CAST(CASE s_suppkey % 3 WHEN 2 THEN 0.3D - 180 ELSE s_suppkey * 11 % 360 - 180 END AS DOUBLE) AS h3_8_lon",
        "CASE WHEN s_suppkey % 10 = 0 THEN 2e7D ELSE 977D * (s_suppkey % 90) END AS radius_m",
    )
    return hexes.hexagon_coverage(places, circles).select("h8_hexagon", "n_stores")


@query(
    f"""SELECT order_country_code, {normalised('product_name')} AS name, count(*) AS n
    FROM local_products GROUP BY 1, 2""",
    ["local_products"],
)
def normalised_names(tb: Testbed) -> DataFrame:
    return tb.local_products().groupBy(
        "order_country_code", text.normalise_name(F.col("product_name")).alias("name")
    ).agg(F.count(F.lit(1)).alias("n"))


@query(
    f"""SELECT doc_id, {contains_any('text', catalogue.POLISH_DRINKS)} AS polish,
        {contains_any('text', catalogue.LATIN_FOOD)} AS food FROM documents"""
)
def keyword_match(tb: Testbed) -> DataFrame:
    return tb.raw("documents").select(
        "doc_id",
        text.contains_any("text", catalogue.POLISH_DRINKS).alias("polish"),
        text.contains_any("text", catalogue.LATIN_FOOD).alias("food"),
    )


@query(
    f"""SELECT product_id,
        coalesce(regexp_matches(product_name, '(?i)({'|'.join(drinks.COLA_PATTERNS)})'), false) AS cola,
        coalesce(regexp_matches(product_name, '(?i)({'|'.join(drinks.PEPSI_PATTERNS)})'), false) AS pepsi
    FROM local_products""",
    ["local_products"],
)
def pattern_match(tb: Testbed) -> DataFrame:
    name = F.col("product_name")
    return tb.local_products().select(
        "product_id",
        text.matches_any(name, drinks.COLA_PATTERNS).alias("cola"),
        text.matches_any(name, drinks.PEPSI_PATTERNS).alias("pepsi"),
    )


@query(
    """SELECT store_address_id, coalesce(store_address_maximum_delivery_distance_meters,
        store_maximum_delivery_distance) AS radius_m
    FROM store_addresses a JOIN stores s USING (store_id)""",
    ["store_addresses", "stores"],
)
def coalesce_radius(tb: Testbed) -> DataFrame:
    return tb.store_addresses().join(tb.stores(), "store_id").select(
        "store_address_id",
        F.coalesce("store_address_maximum_delivery_distance_meters", "store_maximum_delivery_distance").alias("radius_m"),
    )


@query(
    """SELECT p_partkey, coalesce(TRY_CAST(p_name AS DOUBLE), 0) AS from_name,
        coalesce(TRY_CAST(substr(p_brand, 7) AS DOUBLE), 0) AS from_brand FROM part"""
)
def numeric_coerce(tb: Testbed) -> DataFrame:
    return tb.raw("part").select(
        "p_partkey",
        numbers.number_or_zero(F.col("p_name")).alias("from_name"),
        numbers.number_or_zero(F.substring("p_brand", 7, 20)).alias("from_brand"),
    )


@query(
    """SELECT CAST(customer_id AS VARCHAR) AS customer_id, coalesce(CAST(pltv_1y AS VARCHAR), '') AS pltv_1y,
        CASE WHEN pltv_1y > 100 THEN 'yes' ELSE '' END AS finite
    FROM customer_ltv""",
    ["customer_ltv"],
)
def sanitised(tb: Testbed) -> DataFrame:
    ltv = F.col("pltv_1y")
    odd = F.when(ltv > 100, F.lit(1.0)).when(ltv > 50, F.lit(float("nan"))).otherwise(F.lit(float("inf")))
    shown = numbers.blank_columns(
        tb.customer_ltv().select("customer_id", "pltv_1y", odd.alias("odd"))
    )
    return shown.select("customer_id", "pltv_1y", F.when(F.col("odd") == "1.0", "yes").otherwise("").alias("finite"))


@query(
    """SELECT order_id, order_country_code, CASE WHEN order_country_code = 'ASIA' THEN 'moved'
        WHEN order_is_prime THEN 'prime' ELSE order_vertical END AS order_vertical FROM order_facts""",
    ["order_facts"],
)
def masked_update(tb: Testbed) -> DataFrame:
    vertical = F.when(F.col("order_is_prime"), "prime").otherwise(F.col("order_vertical"))
    return (
        tb.order_facts(stores=False)
        .withColumn("order_vertical", vertical)
        .withColumn("order_vertical", F.when(F.col("order_country_code") == "ASIA", "moved").otherwise(F.col("order_vertical")))
        .select("order_id", "order_country_code", "order_vertical")
    )


@query(
    """SELECT order_id, customer_id FROM value_orders JOIN (SELECT DISTINCT customer_id FROM value_orders
        WHERE order_is_first_delivered_order) USING (customer_id)""",
    ["value_orders"],
)
def cohort_inner(tb: Testbed) -> DataFrame:
    rows = tb.order_facts(stores=False).filter(orders.delivered() & dates.since_last_year(F.col(TIME), AS_OF))
    cohort = rows.filter("order_is_first_delivered_order").select("customer_id").distinct()
    return rows.join(cohort, "customer_id").select("order_id", "customer_id")


@query(
    """SELECT o.order_id, payment_method, round(contribution_margin_eur, 6) AS contribution_margin_eur
    FROM order_facts o LEFT JOIN payments USING (order_id) LEFT JOIN pnl ON pnl.order_id = o.order_id""",
    ["order_facts", "payments", "pnl"],
)
def left_enrich(tb: Testbed) -> DataFrame:
    margin = tb.order_pnl().select("order_id", "contribution_margin_eur")
    rows = tb.order_facts(stores=False).select("order_id")
    return rounded(rows.join(tb.payments(), "order_id", "left").join(margin, "order_id", "left"))


@query(
    """SELECT o.order_country_code, o.store_name, n, rank FROM (SELECT order_country_code, store_name, count(*) AS n
        FROM order_facts WHERE store_name IS NOT NULL GROUP BY 1, 2) o
    LEFT JOIN partners p ON p.order_country_code = o.order_country_code AND p.store_name = o.store_name""",
    ["order_facts", "partners"],
)
def two_key_join(tb: Testbed) -> DataFrame:
    facts = tb.order_facts()
    counts = facts.filter(F.col("store_name").isNotNull()).groupBy("order_country_code", "store_name").agg(
        F.count(F.lit(1)).alias("n")
    )
    best = orders.top_partners(facts, AS_OF, 90, 5, COUNTRIES).drop("orders")
    return counts.join(best, ["order_country_code", "store_name"], "left")


@query(
    """SELECT order_id, customer_id, stores FROM profile_orders o JOIN (
        SELECT customer_id AS c, date_trunc('month', order_activated_local_at) AS month,
            count(DISTINCT store_name) AS stores FROM profile_orders GROUP BY 1, 2) s
    ON s.c = o.customer_id AND s.month = date_trunc('month', order_activated_local_at)""",
    ["profile_orders"],
)
def month_key_join(tb: Testbed) -> DataFrame:
    rows = profile.base_orders(tb.order_facts(), AS_OF)
    month = F.trunc(F.to_date(TIME), "MM")
    return rows.withColumn("month", month).join(
        profile.monthly_stores(rows), ["customer_id", "month"], "left"
    ).select("order_id", "customer_id", "stores")


@query(
    f"""SELECT dynamic_session_id, h8_hexagon FROM sessions WHERE list_has_any(visited_store_address_ids,
        (SELECT array_agg(DISTINCT store_address_id) FROM order_facts WHERE store_name = '{PARTNER}'))""",
    ["sessions", "order_facts"],
)
def partner_sessions(tb: Testbed) -> DataFrame:
    return hexes.sessions_at_partner(tb.sessions(), tb.order_facts(), PARTNER).select(
        "dynamic_session_id", "h8_hexagon"
    )


@query(
    """SELECT dynamic_session_id, list_has_any(visited_store_address_ids, [1, 3]) AS overlap FROM sessions""",
    ["sessions"],
)
def array_overlap(tb: Testbed) -> DataFrame:
    wanted = F.array(F.lit(1).cast("long"), F.lit(3).cast("long"))
    return tb.sessions().select(
        "dynamic_session_id", geo.shares_element(F.col("visited_store_address_ids"), wanted).alias("overlap")
    )


@query(
    """SELECT store_address_id, product_id, p_snapshot_date FROM product_availability
    WHERE product_is_available AND p_snapshot_date IN (SELECT CAST(order_activated_local_at AS DATE)
        FROM order_facts WHERE order_is_prime AND order_final_status = 'DeliveredStatus')""",
    ["product_availability", "order_facts"],
)
def semi_snapshot(tb: Testbed) -> DataFrame:
    """Snapshots in a folder per day; the days of prime orders choose the folders."""
    path = shared_path(tb.spark, "snapshots")
    tables.write_snapshots(tb.product_availability(), path)
    prime = tb.order_facts(stores=False).filter(F.col("order_is_prime") & (F.col("order_final_status") == "DeliveredStatus"))
    kept = tables.on_days_of(tables.read_folder(tb.spark, path), prime, F.col(TIME), dt.date(2030, 1, 1))
    return kept.filter("product_is_available").select("store_address_id", "product_id", "p_snapshot_date")


BROKEN = """SELECT c_custkey, CASE WHEN c_custkey % 7 = 0 THEN c_custkey || ',x' || c_nationkey || ',1.5'
        WHEN c_custkey % 11 = 0 THEN c_custkey || ',1' WHEN c_custkey % 13 = 0 THEN c_custkey || ',1,2.5,more'
        ELSE c_custkey || ',' || c_nationkey || ',' || c_custkey || '.25' END AS line FROM customer"""
BROKEN_SCHEMA = "k bigint, n int, v double"


def broken_csv(tb: Testbed) -> str:
    path = shared_path(tb.spark, "csv")
    key = F.col("c_custkey")
    line = (
        F.when(key % 7 == 0, F.concat(key, F.lit(",x"), "c_nationkey", F.lit(",1.5")))
        .when(key % 11 == 0, F.concat(key, F.lit(",1")))
        .when(key % 13 == 0, F.concat(key, F.lit(",1,2.5,more")))
        .otherwise(F.concat(key, F.lit(","), "c_nationkey", F.lit(","), key, F.lit(".25")))
    )
    tb.raw("customer").select(line.alias("line")).write.text(path)
    return path


@query(
    """SELECT c_custkey AS k, c_nationkey AS n, c_custkey + 0.25::DOUBLE AS v FROM customer
    WHERE c_custkey % 7 <> 0 AND c_custkey % 11 <> 0 AND c_custkey % 13 <> 0"""
)
def csv_good_rows(tb: Testbed) -> DataFrame:
    return tables.split_csv(tb.spark, broken_csv(tb), BROKEN_SCHEMA, header=False)[0]


@query(f"SELECT line FROM ({BROKEN}) WHERE c_custkey % 7 = 0 OR c_custkey % 11 = 0 OR c_custkey % 13 = 0")
def csv_bad_lines(tb: Testbed) -> DataFrame:
    return tables.split_csv(tb.spark, broken_csv(tb), BROKEN_SCHEMA, header=False)[1].select("line")


ASKED = """SELECT order_country_code, count(*) AS n, round(sum(order_transacted_value_local), 2) AS value FROM {facts}
    WHERE order_activated_local_at >= {since} AND {listed} AND order_final_status <> {status} GROUP BY 1"""


@query(
    ASKED.format(facts="order_facts", since="DATE '1996-03-01'", listed="order_country_code IN ('ASIA', 'EUROPE')", status="'it''s done'"),
    ["order_facts"],
)
def sql_parameters(tb: Testbed) -> DataFrame:
    """A date, a list and a text with a quote, given as parameters."""
    asked = ASKED.format(facts="{facts}", since=":since", listed="array_contains(:listed, order_country_code)", status=":status")
    return tables.query_sql(
        tb.spark, asked, {"facts": tb.order_facts(stores=False)}, since=dt.date(1996, 3, 1), listed=["ASIA", "EUROPE"], status="it's done"
    )


@query(
    """SELECT order_id, order_country_code FROM order_facts WHERE order_id NOT IN (SELECT order_id
        FROM bought_products JOIN categories USING (product_id) WHERE predicted_category IN ('drink', 'drinks'))""",
    ["order_facts", "bought_products", "categories"],
)
def anti_orders(tb: Testbed) -> DataFrame:
    sold = catalogue.with_category(tb.bought_products(), tb.product_predictions())
    wet = sold.filter(catalogue.is_drink(F.col("predicted_category"))).select("order_id")
    return tb.order_facts(stores=False).select("order_id", "order_country_code").join(wet, "order_id", "left_anti")


@query(
    """SELECT o.order_id, p.store_name IS NOT NULL AS top_partner FROM order_facts o
    LEFT JOIN partners p ON p.store_name = o.store_name AND p.order_country_code = o.order_country_code""",
    ["order_facts", "partners"],
)
def flag_join(tb: Testbed) -> DataFrame:
    facts = tb.order_facts()
    best = orders.top_partners(facts, AS_OF, 90, 5, COUNTRIES).select(
        "order_country_code", "store_name", F.lit(True).alias("top_partner")
    )
    return facts.join(best, ["order_country_code", "store_name"], "left").select(
        "order_id", F.coalesce("top_partner", F.lit(False)).alias("top_partner")
    )


@query(
    """SELECT DISTINCT o.store_name FROM order_facts o WHERE o.store_name IS NOT NULL EXCEPT
    SELECT DISTINCT o.store_name FROM order_facts o JOIN bought_products b USING (order_id)
    WHERE product_name LIKE 'old%widget' OR product_name LIKE 'new%gizmo'""",
    ["order_facts", "bought_products"],
)
def set_difference(tb: Testbed) -> DataFrame:
    facts = tb.order_facts().select("order_id", "store_name").filter(F.col("store_name").isNotNull())
    sold = facts.join(tb.bought_products(), "order_id")
    either = text.matches_any(F.col("product_name"), ["^old.*widget$", "^new.*gizmo$"])
    return facts.select("store_name").distinct().join(
        sold.filter(either).select("store_name"), "store_name", "left_anti"
    )


@query(
    """SELECT 'sold' AS origin, product_id, product_name FROM bought_products
    UNION ALL SELECT 'offered', product_id, product_name FROM product_availability""",
    ["bought_products", "product_availability"],
)
def country_union(tb: Testbed) -> DataFrame:
    sold = tb.bought_products().select(F.lit("sold").alias("origin"), "product_id", "product_name")
    offered = tb.product_availability().select("product_name", "product_id", F.lit("offered").alias("origin"))
    return tables.stack(sold, offered)


@query(
    """SELECT DISTINCT store_address_id, pltv_1y FROM order_facts JOIN customer_ltv USING (customer_id)
    WHERE store_address_id IS NOT NULL AND pltv_1y IS NOT NULL""",
    ["order_facts", "customer_ltv"],
)
def distinct_rows(tb: Testbed) -> DataFrame:
    return (
        tb.order_facts()
        .join(tb.customer_ltv(), "customer_id")
        .select("store_address_id", "pltv_1y")
        .dropna(subset=["store_address_id", "pltv_1y"])
        .distinct()
    )


@query("SELECT store_address_id, h3_hash_8 FROM store_addresses WHERE p_end_date IS NULL", ["store_addresses"])
def current_rows(tb: Testbed) -> DataFrame:
    return tables.current_rows(tb.store_addresses()).select("store_address_id", "h3_hash_8")


@query(
    f"SELECT customer_id, p_date FROM customer_lto WHERE p_date = {AS_OF_SQL} - 1",
    ["customer_lto"],
)
def latest_snapshot(tb: Testbed) -> DataFrame:
    return tables.yesterday_of(tb.customer_lto(), AS_OF).select("customer_id", "p_date")


@query(
    """SELECT order_city_code, count(DISTINCT order_id) AS orders,
        count(DISTINCT CASE WHEN order_vertical = 'QCommerce' THEN order_id END) AS qcommerce,
        count(DISTINCT CASE WHEN order_final_status = 'DeliveredStatus' THEN customer_id END) AS served
    FROM order_facts GROUP BY 1""",
    ["order_facts"],
)
def conditional_distinct(tb: Testbed) -> DataFrame:
    """One row per (city, customer) first: the order counts then add up without a second distinct."""
    delivered = F.col("order_final_status") == "DeliveredStatus"
    unique = orders.one_row_per_order(
        tb.order_facts(stores=False),
        ["order_city_code", "customer_id", "order_vertical", "order_final_status"],
        ["order_is_prime"],
    )
    return (
        unique.groupBy("order_city_code", "customer_id")
        .agg(
            F.count("order_id").alias("orders"),
            F.count_if(F.col("order_vertical") == "QCommerce").alias("qcommerce"),
            F.bool_or(delivered).alias("served"),
        )
        .groupBy("order_city_code")
        .agg(
            F.sum("orders").alias("orders"),
            F.sum("qcommerce").alias("qcommerce"),
            F.count_if("served").alias("served"),
        )
    )


@query(
    """SELECT order_id, round(contribution_margin_eur, 6) AS contribution_margin_eur, round(rpo, 6) AS rpo,
        round(cpo, 6) AS cpo FROM pnl""",
    ["pnl"],
)
def margin_terms(tb: Testbed) -> DataFrame:
    return rounded(orders.pnl_per_order(tb.order_pnl()))


@query(
    """SELECT customer_id, round(avg(n), 6) AS avg_monthly_orders FROM (SELECT customer_id,
        date_trunc('month', order_activated_local_at) AS m, count(DISTINCT order_id) AS n
        FROM order_facts GROUP BY 1, 2) GROUP BY 1""",
    ["order_facts"],
)
def two_level_avg(tb: Testbed) -> DataFrame:
    return rounded(profile.user_type(tb.order_facts(stores=False)).drop("user_type"))


@query(
    """SELECT order_country_code, customer_id, max(CASE WHEN r = 1 THEN store_name END) AS top_1_store,
        max(CASE WHEN r = 2 THEN store_name END) AS top_2_store, max(CASE WHEN r = 3 THEN store_name END) AS top_3_store
    FROM (SELECT order_country_code, customer_id, store_name, row_number() OVER (
            PARTITION BY order_country_code, customer_id
            ORDER BY count(DISTINCT order_id) DESC, store_name ASC NULLS LAST) AS r
        FROM order_facts GROUP BY 1, 2, 3) WHERE r <= 3 GROUP BY 1, 2""",
    ["order_facts"],
)
def rank_pivot(tb: Testbed) -> DataFrame:
    return profile.favourite_stores(tb.order_facts())


@query(
    """SELECT order_country_code, round(avg(v), 4) AS aov FROM (SELECT order_country_code, order_id,
        max(order_transacted_value_eur) AS v FROM order_facts JOIN bought_products USING (order_id)
        GROUP BY 1, 2) GROUP BY 1""",
    ["order_facts", "bought_products"],
)
def order_dedup_avg(tb: Testbed) -> DataFrame:
    lines = tb.order_facts(stores=False).join(tb.bought_products(), "order_id")
    single = orders.one_row_per_order(lines, ["order_country_code"], ["order_transacted_value_eur"])
    return rounded(single.groupBy("order_country_code").agg(F.avg("order_transacted_value_eur").alias("aov")), 4)


@query(
    """SELECT order_id, bool_and(d) AS all_drinks, bool_or(d) AS any_drink FROM (SELECT order_id,
        coalesce(predicted_category IN ('drink', 'drinks'), false) AS d
        FROM bought_products LEFT JOIN categories USING (product_id)) GROUP BY 1""",
    ["bought_products", "categories"],
)
def all_any_flags(tb: Testbed) -> DataFrame:
    lines = catalogue.with_category(tb.bought_products(), tb.product_predictions(), keep_unlabelled=True)
    drink = catalogue.is_drink(F.col("predicted_category"))
    return lines.groupBy("order_id").agg(
        F.bool_and(drink).alias("all_drinks"), F.bool_or(drink).alias("any_drink")
    )


@query(
    """SELECT l_returnflag AS returnflag, round(quantile_cont(l_extendedprice, 0.25), 6) AS q1,
        round(quantile_cont(l_extendedprice, 0.5), 6) AS q2, round(quantile_cont(l_extendedprice, 0.75), 6) AS q3,
        round(quantile_cont(l_extendedprice, 0.95), 6) AS q95
    FROM lineitem GROUP BY 1"""
)
def quartiles(tb: Testbed) -> DataFrame:
    found = ranks.exact_quantiles(tb.raw("lineitem"), ["l_returnflag"], "l_extendedprice", [0.25, 0.5, 0.75, 0.95], "q")
    names = ("q1", "q2", "q3", "q95")
    return found.select(
        F.col("l_returnflag").alias("returnflag"), *[F.round(F.col("q")[i], 6).alias(n) for i, n in enumerate(names)]
    )


@query(
    """SELECT l_suppkey, v AS mode FROM (SELECT l_suppkey, l_quantity AS v, row_number() OVER (
        PARTITION BY l_suppkey ORDER BY count(*) DESC, l_quantity) AS r FROM lineitem GROUP BY 1, 2) WHERE r = 1"""
)
def group_mode(tb: Testbed) -> DataFrame:
    return ranks.group_mode(tb.raw("lineitem"), ["l_suppkey"], "l_quantity")


@query(
    """SELECT unnest(['pltv_1y', 'pltv_3y', 'pltv_5y', 'customer_id']) AS column_name, unnest([
        count(*) - count(pltv_1y), count(*) - count(pltv_3y), count(*) - count(pltv_5y), 0]) AS null_count
    FROM customer_ltv""",
    ["customer_ltv"],
)
def null_profile(tb: Testbed) -> DataFrame:
    return ranks.null_profile(tb.customer_ltv())


@query("SELECT lang, count(*) AS n FROM documents GROUP BY 1")
def value_counts(tb: Testbed) -> DataFrame:
    return ranks.value_counts(tb.raw("documents"), "lang")


@query(
    """SELECT customer_id, order_id, order_country_code, order_city_code FROM (SELECT *, row_number() OVER (
        PARTITION BY customer_id ORDER BY order_activated_local_at, order_id) AS r FROM order_facts
        WHERE order_is_first_delivered_order) WHERE r = 1""",
    ["order_facts"],
)
def first_order(tb: Testbed) -> DataFrame:
    return profile.first_orders(tb.order_facts(stores=False)).drop("customer_first_delivered_at")


@query(
    """SELECT 'store' AS kind, order_country_code, store_name AS name, orders, rank FROM (
        SELECT order_country_code, store_name, store_id, count(DISTINCT order_id) AS orders, row_number() OVER (
            PARTITION BY order_country_code ORDER BY count(DISTINCT order_id) DESC, store_name, store_id) AS rank
        FROM order_facts WHERE store_name IS NOT NULL GROUP BY 1, 2, 3) WHERE rank <= 10
    UNION ALL SELECT 'city', order_country_code, order_city_code, orders, rank FROM (
        SELECT order_country_code, order_city_code, count(DISTINCT order_id) AS orders, row_number() OVER (
            PARTITION BY order_country_code ORDER BY count(DISTINCT order_id) DESC, order_city_code) AS rank
        FROM order_facts GROUP BY 1, 2) WHERE rank = 1""",
    ["order_facts"],
)
def ranked_aggregate(tb: Testbed) -> DataFrame:
    facts = tb.order_facts()
    stores = profile.leading_stores(facts).select(
        F.lit("store").alias("kind"), "order_country_code", F.col("store_name").alias("name"), "orders", "rank"
    )
    cities = profile.leading_cities(facts).select(
        F.lit("city").alias("kind"), "order_country_code", F.col("order_city_code").alias("name"), "orders", "rank"
    )
    return tables.stack(stores, cities)


@query(
    """SELECT order_country_code AS country, order_vertical, n,
        round(n / sum(n) OVER (PARTITION BY order_country_code), 6) AS share
    FROM (SELECT order_country_code, order_vertical, count(*) AS n FROM order_facts GROUP BY 1, 2)""",
    ["order_facts"],
)
def group_share(tb: Testbed) -> DataFrame:
    counts = tb.order_facts(stores=False).groupBy(F.col("order_country_code").alias("country"), "order_vertical").agg(
        F.count(F.lit(1)).alias("n")
    )
    return rounded(counts.withColumn("share", buckets.share_of_country("n")))


@query(
    """SELECT product_name, sum(bought_product_quantity) AS q FROM bought_products GROUP BY 1
    ORDER BY 2 DESC, 1 LIMIT 50""",
    ["bought_products"],
)
def top_n_sum(tb: Testbed) -> DataFrame:
    return (
        tb.bought_products()
        .groupBy("product_name")
        .agg(F.sum("bought_product_quantity").alias("q"))
        .orderBy(F.desc("q"), "product_name")
        .limit(50)
    )


@query(
    f"""SELECT dynamic_session_id, h8_hexagon, country_code, city_code, count_ce__order_created FROM sessions
    WHERE CAST(session_start_time_local AS DATE) BETWEEN DATE '{SESSION_START}' AND DATE '{SESSION_END}'""",
    ["sessions"],
)
def session_window(tb: Testbed) -> DataFrame:
    return (
        tb.sessions()
        .filter(dates.between_days(F.col("session_start_time_local"), SESSION_START, SESSION_END))
        .select("dynamic_session_id", "h8_hexagon", "country_code", "city_code", "count_ce__order_created")
    )

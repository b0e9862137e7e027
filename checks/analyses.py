"""Value buckets, products, hexagons, profiles, features, models and sinks."""

from __future__ import annotations

from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from checks.logical_sql import AS_OF as AS_OF_SQL
from checks.logical_sql import contains_any, normalised, twin
from checks.registry import TWINS, query, rounded
from orderloom.functions.dates import days_back, last_year_start
from orderloom.operators import buckets, catalogue, daily, drinks, features, hexes, models, orders, profile, rules, vectors
from orderloom.plans import reports
from orderloom.session import materialise, shared_path
from orderloom.sources import sinks, tables
from checks.testbed import (
    AS_OF,
    CITIES,
    COUNTRIES,
    LOCAL_COUNTRIES,
    PARTNER,
    SESSION_END,
    SESSION_START,
    Testbed,
)

PARTNERS_SHOWN = 5
# The test orders are few per customer, so the type limits are near one order a month.
TYPE_HIGH, TYPE_LOW = 1.15, 1.05


def panel(tb: Testbed) -> DataFrame:
    return orders.customer_value(
        tb.order_facts(stores=False), tb.order_pnl(), tb.customer_ltv(), tb.customer_lto(), AS_OF, COUNTRIES
    )


PANEL_COLUMNS = """country, customer_id, pltv_1y, pltv_3y, pltv_5y, round(plto_1y, 6) AS plto_1y,
    round(plto_3y, 6) AS plto_3y, round(plto_5y, 6) AS plto_5y, round(aov, 6) AS aov, total_orders,
    total_qcomm_orders, active_months, round(contribution_margin_eur, 6) AS contribution_margin_eur,
    round(rpo, 6) AS rpo, round(cpo, 6) AS cpo"""


@query(f"SELECT {PANEL_COLUMNS} FROM customer_panel", ["customer_panel"])
def customer_value(tb: Testbed) -> DataFrame:
    out = rounded(panel(tb), {c: 6 for c in ("plto_1y", "plto_3y", "plto_5y", "aov", "contribution_margin_eur", "rpo", "cpo")})
    return out.withColumn("active_months", F.col("active_months").cast("long"))


UNSCORED = twin(["customer_panel"], f"SELECT {PANEL_COLUMNS} FROM customer_panel").replace("JOIN customer_lto lto", "LEFT JOIN customer_lto lto")


@query()
def customer_value_unscored(tb: Testbed) -> DataFrame:
    """The value panel with customers that have no prediction of yesterday."""
    out = orders.customer_value(
        tb.order_facts(stores=False), tb.order_pnl(), tb.customer_ltv(), tb.customer_lto(), AS_OF, COUNTRIES, keep_unscored=True
    )
    out = rounded(out, {c: 6 for c in ("plto_1y", "plto_3y", "plto_5y", "aov", "contribution_margin_eur", "rpo", "cpo")})
    return out.withColumn("active_months", F.col("active_months").cast("long"))


TWINS["customer_value_unscored"] = UNSCORED


@query(f"SELECT {PANEL_COLUMNS} FROM customer_panel", ["customer_panel"])
def customer_value_daily(tb: Testbed) -> DataFrame:
    """The value panel from kept days: the history once, then the last day alone."""
    path = shared_path(tb.spark, "days")
    facts, pnl = tb.order_facts(stores=False), tb.order_pnl()
    yesterday = days_back(AS_OF, 1)
    daily.refresh_days(path, facts, pnl, last_year_start(AS_OF), yesterday, COUNTRIES)
    daily.refresh_days(path, facts, pnl, AS_OF, AS_OF, COUNTRIES)
    kept = daily.read_days(tb.spark, path)
    out = daily.customer_value_of_days(kept, tb.customer_ltv(), tb.customer_lto(), AS_OF)
    out = rounded(out, {c: 6 for c in ("plto_1y", "plto_3y", "plto_5y", "aov", "contribution_margin_eur", "rpo", "cpo")})
    return out.withColumn("active_months", F.col("active_months").cast("long"))


@query(
    """SELECT order_country_code, count(DISTINCT customer_id) AS customers, count(DISTINCT customer_id) FILTER (WHERE order_is_prime) AS prime,
        count(DISTINCT customer_id) FILTER (WHERE order_vertical = 'QCommerce') AS qcommerce,
        count(DISTINCT customer_id) FILTER (WHERE order_final_status <> 'DeliveredStatus') AS cancelled FROM order_facts GROUP BY 1""",
    ["order_facts"],
)
def distinct_customers(tb: Testbed) -> DataFrame:
    """Distinct customers under four conditions, from bitmaps of each city and quarter that are then united."""
    tests = {
        "customers": F.lit(True),
        "prime": F.col("order_is_prime"),
        "qcommerce": F.col("order_vertical") == "QCommerce",
        "cancelled": F.col("order_final_status") != "DeliveredStatus",
    }
    rows = tb.order_facts(stores=False).withColumn("quarter", F.date_trunc("quarter", "order_activated_local_at"))
    parts = materialise(daily.distinct_bitmaps(rows, ["order_country_code", "order_city_code", "quarter"], "customer_id", tests))
    return daily.bitmap_counts(parts, ["order_country_code"], tests)


FENCES_SQL = """SELECT country, count(aov) AS n, quantile_cont(aov, 0.25) AS q1, quantile_cont(aov, 0.75) AS q3
        FROM customer_panel GROUP BY 1"""


@query(
    f"""SELECT country, n, round(q1, 6) AS q1, round(q3, 6) AS q3,
        round(q1 - 1.5 * (q3 - q1), 6) AS lower_fence, round(q3 + 1.5 * (q3 - q1), 6) AS upper_fence
    FROM ({FENCES_SQL})""",
    ["customer_panel"],
)
def iqr_fences(tb: Testbed) -> DataFrame:
    return rounded(buckets.iqr_fences(materialise(panel(tb)), "country", "aov"))


def kmeans_sql(relation: str, columns: str) -> str:
    """Lloyd's iteration by hand: the centres of one round feed the next."""
    points = [(2 * i + 1) / 1000 for i in range(500)]
    starts = ", ".join(f"quantile_disc(aov, {(2 * i + 1) / 8}) AS c{i}" for i in range(4))
    place = "(CASE WHEN aov > (c0 + c1) / 2 THEN 1 ELSE 0 END + CASE WHEN aov > (c1 + c2) / 2 THEN 1 ELSE 0 END + CASE WHEN aov > (c2 + c3) / 2 THEN 1 ELSE 0 END)"
    means = ", ".join(f"coalesce(avg(aov) FILTER (WHERE {place} = {i}), c{i})" for i in range(4))
    return f"""WITH vals AS MATERIALIZED (SELECT country, aov FROM {relation} WHERE aov IS NOT NULL),
    fences AS MATERIALIZED (SELECT country, quantile_cont(aov, 0.25) AS q1, quantile_cont(aov, 0.75) AS q3 FROM vals GROUP BY 1),
    kept AS MATERIALIZED (SELECT v.* FROM vals v JOIN fences USING (country)
        WHERE aov BETWEEN q1 - 1.5 * (q3 - q1) AND q3 + 1.5 * (q3 - q1)),
    grid AS MATERIALIZED (SELECT country, unnest(quantile_disc(aov, {points})) AS aov FROM kept GROUP BY 1),
    rough AS (SELECT 0 AS i, country, {starts} FROM grid GROUP BY country
        UNION ALL SELECT i + 1, country, {means} FROM rough JOIN grid USING (country) WHERE i < 60
        GROUP BY i, country, c0, c1, c2, c3),
    rounds AS (SELECT 0 AS i, country, c0, c1, c2, c3 FROM rough WHERE i = 60
        UNION ALL SELECT i + 1, country, {means} FROM rounds JOIN kept USING (country) WHERE i < 60
        GROUP BY i, country, c0, c1, c2, c3),
    bucketed AS (SELECT p.*, CASE WHEN aov IS NULL THEN NULL WHEN aov > q3 + 1.5 * (q3 - q1) THEN '4. High'
            WHEN aov >= q1 - 1.5 * (q3 - q1)
                THEN ['1. Low', '2. Medium Low', '3. Medium High', '4. High'][{place} + 1] END AS bucket
        FROM {relation} p JOIN fences USING (country) JOIN (SELECT * FROM rounds WHERE i = 60) USING (country))
    {columns}"""


@query(
    kmeans_sql("customer_panel", "SELECT country, customer_id, bucket FROM bucketed"),
    ["customer_panel"],
    recursive=True,
)
def kmeans_buckets(tb: Testbed) -> DataFrame:
    rows = materialise(panel(tb).select("country", "customer_id", "aov"))
    return buckets.kmeans_buckets(rows, "country", "aov").select("country", "customer_id", "bucket")


@query(
    kmeans_sql("customer_panel", "SELECT country, customer_id, coalesce(bucket, '1. Low') AS bucket FROM bucketed WHERE aov IS NOT NULL"),
    ["customer_panel"],
    recursive=True,
)
def kmeans_low_outliers(tb: Testbed) -> DataFrame:
    """Values below the lower fence are of the lowest bucket."""
    rows = materialise(panel(tb).select("country", "customer_id", "aov"))
    out = buckets.kmeans_buckets(rows, "country", "aov", low_outliers="lowest")
    return out.filter("aov IS NOT NULL").select("country", "customer_id", "bucket")


PREDICTED = ("pltv_1y", "pltv_3y", "pltv_5y", "plto_1y", "plto_3y", "plto_5y")
SUMMED = ("contribution_margin_eur", "rpo_total", "cpo_total", "aov_min", "aov_max", *[f"{c}_sum" for c in PREDICTED])
REPORT_SQL = f"""SELECT country, bucket, cluster_customers, total_orders, total_qcomm_orders, active_months,
    round(contribution_margin_eur, 6) AS contribution_margin_eur, round(rpo_total, 6) AS rpo_total,
    round(cpo_total, 6) AS cpo_total,
    {', '.join(f'round({c}_sum, 6) AS {c}_sum, {c}_count, round({c}_sum / nullif({c}_count, 0), 8) AS {c}_avg' for c in PREDICTED)},
    round(aov_min, 6) AS aov_min, round(aov_max, 6) AS aov_max,
    CAST(trunc(aov_min) AS BIGINT) || ' - ' || CAST(trunc(aov_max) AS BIGINT) AS aov_interval,
    round(total_orders / sum(total_orders) OVER w, 8) AS orders_ratio,
    round(cluster_customers / sum(cluster_customers) OVER w, 8) AS customers_ratio,
    round(total_qcomm_orders / sum(total_orders) OVER w, 8) AS qcomm_ratio,
    round(CASE WHEN active_months <> 0 THEN total_orders / active_months ELSE 0 END, 8) AS frequency,
    round(contribution_margin_eur / total_orders, 8) AS cm, round(rpo_total / total_orders, 8) AS rpo,
    round(cpo_total / total_orders, 8) AS cpo
FROM (SELECT country, bucket, count(customer_id) AS cluster_customers, CAST(sum(total_orders) AS BIGINT) AS total_orders,
    CAST(sum(total_qcomm_orders) AS BIGINT) AS total_qcomm_orders, CAST(sum(active_months) AS BIGINT) AS active_months,
    coalesce(sum(contribution_margin_eur), 0) AS contribution_margin_eur, coalesce(sum(rpo), 0) AS rpo_total,
    coalesce(sum(cpo), 0) AS cpo_total,
    {', '.join(f'coalesce(sum({c}), 0) AS {c}_sum, count({c}) AS {c}_count' for c in PREDICTED)},
    min(aov) AS aov_min, max(aov) AS aov_max
    FROM bucketed WHERE bucket IS NOT NULL GROUP BY 1, 2) WINDOW w AS (PARTITION BY country)"""


@query(kmeans_sql("customer_panel", REPORT_SQL), ["customer_panel"], recursive=True)
def bucket_report_customers(tb: Testbed) -> DataFrame:
    report = reports.customer_value_report(
        tb.order_facts(stores=False), tb.order_pnl(), tb.customer_ltv(), tb.customer_lto(), AS_OF, COUNTRIES
    )
    return rounded(rounded(report, 8), {c: 6 for c in report.columns if c in SUMMED})


ORDER_REPORT_SQL = """SELECT country, bucket, total_orders, round(margin, 6) AS contribution_margin_eur,
    round(lo, 6) AS aov_min, round(hi, 6) AS aov_max,
    CAST(trunc(lo) AS BIGINT) || ' - ' || CAST(trunc(hi) AS BIGINT) AS aov_interval,
    round(total_orders / sum(total_orders) OVER (PARTITION BY country), 6) AS orders_ratio,
    round(margin / total_orders, 8) AS cm
FROM (SELECT country, bucket, count(order_id) AS total_orders, coalesce(sum(contribution_margin_eur), 0) AS margin,
    min(aov) AS lo, max(aov) AS hi FROM bucketed WHERE bucket IS NOT NULL GROUP BY 1, 2)"""
PRIME_SQL = """WITH prime AS MATERIALIZED (SELECT order_country_code AS country, o.order_id,
        order_transacted_value_eur AS aov, contribution_margin_eur
    FROM value_orders o LEFT JOIN pnl USING (order_id) WHERE order_is_prime AND order_vertical = 'QCommerce'),
    """


@query(PRIME_SQL + kmeans_sql("prime", ORDER_REPORT_SQL)[5:], ["value_orders", "pnl"], recursive=True)
def bucket_report_orders(tb: Testbed) -> DataFrame:
    report = reports.prime_order_report(tb.order_facts(stores=False), tb.order_pnl(), AS_OF, COUNTRIES)
    return rounded(report, {"contribution_margin_eur": 6, "aov_min": 6, "aov_max": 6, "orders_ratio": 6, "cm": 8})


# ---------------------------------------------------------------------------- hexagons

IN_WINDOW = f"CAST(session_start_time_local AS DATE) BETWEEN DATE '{SESSION_START}' AND DATE '{SESSION_END}'"
CELLS = "cells AS (SELECT DISTINCT h3_8_hash, h3_8_polygon_wkt, h3_8_center_lat, h3_8_center_lon FROM hexagons)"
# An order counts in the cell of the session that its checkout names.
ORDERED = f"""ordered AS (SELECT h8_hexagon, count(*) AS orders FROM (
        SELECT DISTINCT h8_hexagon, order_id FROM checkout_events SEMI JOIN (
            SELECT order_id FROM order_facts
            WHERE order_parent_relationship_type IS NULL AND order_final_status = 'DeliveredStatus') USING (order_id)
        JOIN sessions USING (dynamic_session_id)
        WHERE p_creation_date >= DATE '{SESSION_START}' AND p_creation_date <= DATE '{SESSION_END}')
    GROUP BY h8_hexagon)"""
DEMAND_TAIL = """SELECT h3_8_hash AS h8_hexagon, h3_8_polygon_wkt AS h3_geom, h3_8_center_lat AS h3_8_lat,
    h3_8_center_lon AS h3_8_lon, orders, visits.n_rows AS sessions,
    round(100.0 * n_converted / n_sessions, 6) AS cvr_sessions, round(100.0 * n_hits / n_rows, 6) AS cvr_rows
FROM cells LEFT JOIN ordered ON ordered.h8_hexagon = h3_8_hash LEFT JOIN visits ON visits.h8_hexagon = h3_8_hash"""


def demand_sql(own: str, seen: str) -> str:
    """Checkouts per session first, then each session's flags, then one sum per cell."""
    return f"""WITH bought AS (SELECT dynamic_session_id, count(*) AS n, count(*) FILTER (WHERE {own}) AS n_own
        FROM checkout_events GROUP BY dynamic_session_id),
    flags AS (SELECT h8_hexagon, dynamic_session_id, greatest(coalesce(n, 0), 1) AS n_rows,
            CASE WHEN count_ce__order_created > 0 THEN coalesce(n_own, 0) ELSE 0 END AS n_hits
        FROM sessions LEFT JOIN bought USING (dynamic_session_id) WHERE {IN_WINDOW} AND {seen}),
    visits AS (SELECT h8_hexagon, CAST(sum(n_rows) AS BIGINT) AS n_rows, sum(n_hits) AS n_hits, count(*) AS n_sessions,
        count(*) FILTER (WHERE n_hits > 0) AS n_converted FROM flags GROUP BY h8_hexagon), {CELLS}, {ORDERED}"""


VISITED = f"""EXISTS (SELECT 1 FROM order_facts WHERE store_name = '{PARTNER}'
        AND list_contains(visited_store_address_ids, store_address_id))"""
PARTNER_SQL = f"{demand_sql(f"store_name = '{PARTNER}'", VISITED)} {DEMAND_TAIL}"
CITY_SQL = demand_sql("true", "true")
HEX_TABLES = ["hexagons", "sessions", "checkout_events", "order_facts"]


def city_demand(tb: Testbed) -> DataFrame:
    return hexes.hex_demand_city(
        tb.hexagons(), tb.sessions(), tb.checkout_events(), tb.order_facts(stores=False),
        SESSION_START, SESSION_END, COUNTRIES, CITIES,
    )


@query(PARTNER_SQL, HEX_TABLES)
def hex_demand_partner(tb: Testbed) -> DataFrame:
    return rounded(
        hexes.hex_demand_partner(
            tb.hexagons(), tb.sessions(), tb.checkout_events(), tb.order_facts(), PARTNER,
            SESSION_START, SESSION_END, COUNTRIES, CITIES,
        )
    )


@query(f"{CITY_SQL} {DEMAND_TAIL}", HEX_TABLES)
def hex_demand_city(tb: Testbed) -> DataFrame:
    return rounded(city_demand(tb))


def edges_sql(metric: str) -> str:
    """Bucket edges of one metric: the count of buckets depends on the distinct values below the cut."""
    choices = " ".join(f"WHEN {n} THEN quantile_cont(v, {[i / n for i in range(n + 1)]})" for n in range(2, 8))
    return f"""{metric}_kept AS (SELECT coalesce({metric}, 0)::DOUBLE AS v FROM demand WHERE coalesce({metric}, 0)
            <= (SELECT quantile_cont(coalesce({metric}, 0)::DOUBLE, 0.95) FROM demand)),
    {metric}_edges AS (SELECT DISTINCT unnest(CASE greatest(2, least(7, count(DISTINCT v))) {choices} END) AS e
        FROM {metric}_kept),
    {metric}_bins AS (SELECT (row_number() OVER (ORDER BY e) - 1)::INTEGER AS i, e AS lo, lead(e) OVER (ORDER BY e) AS hi
        FROM {metric}_edges),
    {metric}_named AS (SELECT i, lo, CASE WHEN next_last THEN '>' || CAST(trunc(lo) AS BIGINT)
            ELSE CAST(trunc(lo) AS BIGINT) || ' - ' || CAST(trunc(hi) AS BIGINT) END AS base
        FROM (SELECT *, hi = max(hi) OVER () AS next_last FROM {metric}_bins) WHERE hi IS NOT NULL),
    {metric}_labels AS (SELECT i, lo, base || repeat('_dup', (row_number() OVER (PARTITION BY base ORDER BY i) - 1)::INTEGER) AS label
        FROM {metric}_named)"""


METRICS = ("orders", "sessions", "cvr_rows")


def bucketed_sql(columns: str) -> str:
    body = ", ".join(edges_sql(m) for m in METRICS)
    return f"""{CITY_SQL}, demand AS MATERIALIZED ({DEMAND_TAIL.replace('round(100.0 * n_hits / n_rows, 6)', '100.0 * n_hits / n_rows')}),
    {body}, found AS MATERIALIZED (SELECT d.h8_hexagon, {', '.join(f'coalesce({m}, 0)::DOUBLE AS {m}' for m in METRICS)}, h3_geom, h3_8_lat, h3_8_lon,
        {', '.join(f"(SELECT max(i) FROM {m}_labels WHERE lo <= coalesce(d.{m}, 0)) AS {m}_bucket_index" for m in METRICS)}
        FROM demand d)
    {columns}"""


@query(
    bucketed_sql(
        "SELECT h8_hexagon, "
        + ", ".join(f"round({m}, 6) AS {m}, {m}_bucket_index, {m}_labels.label AS {m}_bucket" for m in METRICS)
        + " FROM found "
        + " ".join(f"JOIN {m}_labels ON {m}_labels.i = {m}_bucket_index" for m in METRICS)
    ),
    HEX_TABLES,
)
def density_buckets(tb: Testbed) -> DataFrame:
    out = buckets.density_buckets(materialise(city_demand(tb)), METRICS)
    shown = [c for m in METRICS for c in (m, f"{m}_bucket_index", f"{m}_bucket")]
    return rounded(out.select("h8_hexagon", *shown))


@query(
    bucketed_sql(
        "SELECT h8_hexagon, "
        + ", ".join(f"CAST(dense_rank() OVER (ORDER BY {m}_bucket_index) AS INTEGER) AS {m}_bucket_number" for m in METRICS)
        + " FROM found"
    ),
    HEX_TABLES,
)
def bucket_numbers(tb: Testbed) -> DataFrame:
    out = reports.hexagon_priorities(city_demand(tb), METRICS)
    return out.select("h8_hexagon", *[f"{m}_bucket_number" for m in METRICS])


# The colours expected for one to eight buckets, from low to high.
COLOURS = {
    1: ("#feffbe",),
    2: ("#fdbf6f", "#b7e075"),
    3: ("#f98e52", "#feffbe", "#84ca66"),
    4: ("#f46d43", "#fee08b", "#d9ef8b", "#66bd63"),
    5: ("#ea5739", "#fdbf6f", "#feffbe", "#b7e075", "#4bb05c"),
    6: ("#e34933", "#fca55d", "#fee999", "#e3f399", "#9dd569", "#39a758"),
    7: ("#de402e", "#f98e52", "#fed481", "#feffbe", "#cbe982", "#84ca66", "#2aa054"),
    8: ("#da362a", "#f67a49", "#fdbf6f", "#feeda1", "#e9f6a1", "#b7e075", "#73c264", "#219c52"),
}


def _colours(n_sql: str) -> str:
    rows = ", ".join(f"({n}, {i}, '{c}')" for n, row in COLOURS.items() for i, c in enumerate(row, start=1))
    return f"(SELECT colour FROM (VALUES {rows}) AS ramp(n, p, colour) WHERE ramp.n = {n_sql} AND ramp.p = position)"


LEGEND_SQL = """limits AS (SELECT DISTINCT CASE WHEN label LIKE '>%' THEN regexp_extract(label, '(\\d+)', 1)::BIGINT + 1
        ELSE regexp_extract(label, '- (\\d+)', 1)::BIGINT END AS u
    FROM found JOIN sessions_labels ON i = sessions_bucket_index),
legend AS (SELECT CAST(row_number() OVER (ORDER BY u) AS INTEGER) AS position, coalesce(lag(u) OVER (ORDER BY u), 0) AS lower_limit,
    u + CASE WHEN u = max(u) OVER () THEN 1 ELSE 0 END AS upper_limit, count(*) OVER () AS n FROM limits)"""


@query(
    bucketed_sql(
        f", {LEGEND_SQL} SELECT 'sessions' AS metric, position, lower_limit, upper_limit, {_colours('legend.n')} AS colour FROM legend"
    ).replace("FROM demand d)\n    ,", "FROM demand d),"),
    HEX_TABLES,
)
def bucket_legend(tb: Testbed) -> DataFrame:
    return buckets.bucket_legend(buckets.density_buckets(materialise(city_demand(tb)), ["sessions"]), "sessions")


# The polygon's points, as a map reads them.
GEOMETRY = """'{"type":"Polygon","coordinates":[[' || array_to_string(list_transform(
    string_split(replace(replace(h3_geom, 'POLYGON ((', ''), '))', ''), ', '), lambda p: '[' || CAST(
        CAST(split_part(p, ' ', 1) AS DOUBLE) AS VARCHAR) || ',' || CAST(CAST(split_part(p, ' ', 2) AS DOUBLE) AS VARCHAR) || ']'), ',')
    || ']]}'"""


@query(
    bucketed_sql(
        f""", {LEGEND_SQL}, shown AS (SELECT f.*, label, CASE WHEN label LIKE '>%' THEN regexp_extract(label, '(\\d+)', 1)::BIGINT + 1
            ELSE regexp_extract(label, '- (\\d+)', 1)::BIGINT END AS own
        FROM found f JOIN sessions_labels ON i = sessions_bucket_index WHERE h3_geom IS NOT NULL)
    SELECT 'sessions' AS metric, h8_hexagon, colour AS fill_colour, printf('Hexagon: %s; sessions: %.2f', h8_hexagon, sessions) AS label
    FROM (SELECT s.*, l.position, l.n, {_colours('l.n')} AS colour, row_number() OVER (PARTITION BY h8_hexagon ORDER BY l.upper_limit) AS r
        FROM shown s JOIN legend l ON s.own <= l.upper_limit) WHERE r = 1""".replace("colour AS fill_colour", f"colour AS fill_colour, {GEOMETRY} AS geometry")
    ).replace("FROM demand d)\n    ,", "FROM demand d),"),
    HEX_TABLES,
)
def hex_feed(tb: Testbed) -> DataFrame:
    marked = buckets.density_buckets(materialise(city_demand(tb).filter(F.col("h8_hexagon").isNotNull())), ["sessions"])
    return hexes.hex_feed(marked, "sessions")


@query(
    """SELECT round(avg(h3_8_center_lat), 6) AS lat, round(avg(h3_8_center_lon), 6) AS lon FROM hexagons
    WHERE h3_8_polygon_wkt IS NOT NULL""",
    ["hexagons"],
)
def map_centre(tb: Testbed) -> DataFrame:
    renamed = tb.hexagons().withColumnsRenamed(
        {"h3_8_polygon_wkt": "h3_geom", "h3_8_center_lat": "h3_8_lat", "h3_8_center_lon": "h3_8_lon"}
    )
    return rounded(hexes.map_centre(renamed))


@query("SELECT * FROM radii", ["radii"])
def store_radii(tb: Testbed) -> DataFrame:
    return hexes.store_radii(tb.store_addresses(), tb.stores(), tb.hexagons(), cities=CITIES)


@query(
    "SELECT store_name, store_address_id, h3_8_lat, h3_8_lon, radius_m FROM radii WHERE h3_8_lat IS NOT NULL AND h3_8_lon IS NOT NULL",
    ["radii"],
)
def store_points(tb: Testbed) -> DataFrame:
    return hexes.store_points(hexes.store_radii(tb.store_addresses(), tb.stores(), tb.hexagons()))


DISTANCE = """2 * 6371008.8 * asin(sqrt(least(1.0, pow(sin(radians(r.h3_8_lat - h.h3_8_center_lat) / 2), 2)
    + cos(radians(h.h3_8_center_lat)) * cos(radians(r.h3_8_lat)) * pow(sin(radians(r.h3_8_lon - h.h3_8_center_lon) / 2), 2))))"""


def _demand_hexes(tb: Testbed) -> DataFrame:
    return city_demand(tb).select("h8_hexagon", "h3_8_lat", "h3_8_lon", "sessions")


@query(
    f"""SELECT h.h3_8_hash AS h8_hexagon, count(r.store_address_id) AS n_stores FROM hexagons h
    LEFT JOIN radii r ON {DISTANCE} <= r.radius_m GROUP BY 1""",
    ["hexagons", "radii"],
)
def hexagon_coverage(tb: Testbed) -> DataFrame:
    radii = hexes.store_radii(tb.store_addresses(), tb.stores(), tb.hexagons())
    return hexes.hexagon_coverage(_demand_hexes(tb), materialise(radii)).select("h8_hexagon", "n_stores")


@query(
    f"""{CITY_SQL}, demand AS ({DEMAND_TAIL}) SELECT r.store_address_id, r.radius_m, count(h.h3_8_hash) AS n_hexagons,
        CAST(coalesce(sum(d.sessions), 0) AS BIGINT) AS covered_demand
    FROM radii r LEFT JOIN hexagons h ON {DISTANCE} <= r.radius_m LEFT JOIN demand d ON d.h8_hexagon = h.h3_8_hash
    GROUP BY 1, 2""",
    [*HEX_TABLES, "radii"],
)
def store_coverage(tb: Testbed) -> DataFrame:
    radii = hexes.store_radii(tb.store_addresses(), tb.stores(), tb.hexagons())
    return hexes.store_coverage(_demand_hexes(tb), materialise(radii)).withColumn(
        "covered_demand", F.col("covered_demand").cast("long")
    )


@query(
    f"""{CITY_SQL}, demand AS ({DEMAND_TAIL}), own AS (SELECT * FROM radii WHERE store_name = '{PARTNER}'),
    reached AS (SELECT h.h3_8_hash AS hex, r.store_address_id FROM hexagons h JOIN own r ON {DISTANCE} <= r.radius_m)
    SELECT 'hexagon' AS part, h8_hexagon AS name, (SELECT count(*) FROM reached WHERE hex = h8_hexagon) AS n,
        coalesce(sessions, 0)::BIGINT AS demand FROM demand
    UNION ALL SELECT 'store', CAST(store_address_id AS VARCHAR), (SELECT count(*) FROM reached r WHERE r.store_address_id = o.store_address_id),
        coalesce((SELECT sum(sessions) FROM reached r JOIN demand ON h8_hexagon = hex WHERE r.store_address_id = o.store_address_id), 0)::BIGINT
        FROM own o WHERE h3_8_lat IS NOT NULL
    UNION ALL SELECT 'point', CAST(store_address_id AS VARCHAR), 1, 0 FROM own WHERE h3_8_lat IS NOT NULL
    UNION ALL SELECT 'feature', h8_hexagon, 1, 0 FROM demand WHERE h3_geom IS NOT NULL""",
    [*HEX_TABLES, "radii"],
)
def coverage_plan(tb: Testbed) -> DataFrame:
    """One partner's stores against the city's demand: hexagons, stores, points and map features."""
    out = reports.coverage_reports(
        tb.hexagons(), tb.sessions(), tb.checkout_events(), tb.order_facts(stores=False), tb.store_addresses(), tb.stores(),
        SESSION_START, SESSION_END, PARTNER, ("sessions",), COUNTRIES, CITIES,
    )

    def part(name: str, key: str, n: str, demand: str) -> DataFrame:
        columns = {"part": f"'{name}'", "name": f"CAST({key} AS STRING)", "n": f"CAST({n} AS BIGINT)", "demand": f"CAST({demand} AS BIGINT)"}
        return out[f"{name}s" if name in ("hexagon", "store", "point") else "feed"].selectExpr(*[f"{v} AS {k}" for k, v in columns.items()])

    return tables.stack(
        part("hexagon", "h8_hexagon", "n_stores", "coalesce(sessions, 0)"),
        part("store", "store_address_id", "n_hexagons", "covered_demand"),
        part("point", "store_address_id", "1", "0"),
        part("feature", "h8_hexagon", "1", "0"),
    )


# ---------------------------------------------------------------------------- products


def lines_of(tb: Testbed, facts: DataFrame | None = None) -> DataFrame:
    facts = tb.order_facts() if facts is None else facts
    best = orders.top_partners(facts, AS_OF, 90, PARTNERS_SHOWN, COUNTRIES)
    return orders.order_lines(facts, tb.bought_products(), best, AS_OF, 90, COUNTRIES)


@query("SELECT * FROM lines", ["lines"])
def order_lines(tb: Testbed) -> DataFrame:
    return lines_of(tb)


@query("SELECT * FROM labelled", ["labelled"])
def categorised_lines(tb: Testbed) -> DataFrame:
    return catalogue.with_category(lines_of(tb), tb.product_predictions())


OFFERED = f"""SELECT DISTINCT order_country_code, {{city}} o.store_name, product_id, product_name
    FROM product_availability a JOIN recent_food o ON o.store_address_id = a.store_address_id
    WHERE product_is_available AND product_name IS NOT NULL
        AND p_snapshot_date BETWEEN {AS_OF_SQL} - {{days}} AND {AS_OF_SQL}"""


@query(OFFERED.format(city="", days=90), ["product_availability", "recent_food"])
def available_products(tb: Testbed) -> DataFrame:
    return catalogue.available_products(tb.order_facts(), tb.product_availability(), AS_OF, 90, COUNTRIES)


@query(
    OFFERED.format(city="order_city_code,", days=90)
    + " AND (order_country_code, o.store_name) IN (SELECT order_country_code, store_name FROM partners)",
    ["product_availability", "recent_food", "partners"],
)
def available_products_top(tb: Testbed) -> DataFrame:
    facts = tb.order_facts()
    best = orders.top_partners(facts, AS_OF, 90, PARTNERS_SHOWN, COUNTRIES)
    return catalogue.available_products(
        facts, tb.product_availability(), AS_OF, 90, COUNTRIES, partners=best, with_city=True
    )


PER_ORDER = """per_order AS (SELECT order_country_code, store_name, order_id, bool_or(top_partner) AS top_partner,
    max(order_transacted_value_local) AS vl, max(order_transacted_value_eur) AS ve,
    bool_or(predicted_category IN ('drink', 'drinks')) AS d, bool_and(predicted_category IN ('drink', 'drinks')) AS all_d
    FROM labelled GROUP BY 1, 2, 3)"""


def money(expression: str) -> str:
    return f"round(CAST({expression} AS DECIMAL(28, 8)), 2)::DOUBLE"


@query(
    f"""WITH {PER_ORDER}, coverage AS (SELECT order_country_code, count(*) FILTER (WHERE predicted_category IS NOT NULL) AS labelled_lines,
        count(*) FILTER (WHERE predicted_category IS NULL AND product_id IS NOT NULL) AS unlabelled_lines
        FROM lines LEFT JOIN categories USING (product_id) GROUP BY 1)
    SELECT order_country_code, count(*) AS orders, count(*) FILTER (WHERE d) AS orders_with_drinks,
        {money('avg(vl)')} AS aov_local, {money('avg(ve)')} AS aov_eur,
        {money('avg(vl) FILTER (WHERE d)')} AS aov_local_drinks, {money('avg(ve) FILTER (WHERE d)')} AS aov_eur_drinks,
        {money('avg(vl) FILTER (WHERE NOT d)')} AS aov_local_no_drinks, {money('avg(ve) FILTER (WHERE NOT d)')} AS aov_eur_no_drinks,
        any_value(unlabelled_lines) AS unlabelled_lines, any_value(labelled_lines) AS labelled_lines,
        {money("100.0 * count(DISTINCT store_name) FILTER (WHERE top_partner AND d) / count(DISTINCT store_name) FILTER (WHERE top_partner)")} AS pct_partners_with_drinks,
        {money('100.0 * count(*) FILTER (WHERE d AND all_d) / count(*) FILTER (WHERE d)')} AS pct_only_drinks
    FROM per_order JOIN coverage USING (order_country_code) GROUP BY 1""",
    ["labelled", "lines", "categories"],
)
def drinks_kpis(tb: Testbed) -> DataFrame:
    return drinks.drinks_kpis(lines_of(tb), tb.product_predictions())


@query(
    f"""WITH {PER_ORDER} SELECT order_country_code, store_name, count(*) FILTER (WHERE d) AS orders_with_drinks,
        count(*) AS total_orders, {money('avg(ve) FILTER (WHERE d)')} AS aov_eur_drinks,
        {money('avg(ve) FILTER (WHERE NOT d)')} AS aov_eur_no_drinks, {money('avg(ve)')} AS aov_eur_all
    FROM per_order WHERE top_partner GROUP BY 1, 2""",
    ["labelled"],
)
def partner_drinks(tb: Testbed) -> DataFrame:
    return drinks.partner_drinks(lines_of(tb), tb.product_predictions())


BRAND = ("widget", "gizmo")


@query(
    """SELECT order_country_code, store_name, count(DISTINCT order_id) AS orders_count FROM labelled l
    WHERE top_partner AND (order_country_code, store_name) NOT IN (SELECT order_country_code, store_name FROM labelled
        WHERE store_name IS NOT NULL AND regexp_matches(product_name, '(?i)(widget|gizmo)')) GROUP BY 1, 2""",
    ["labelled"],
)
def partners_without_brand(tb: Testbed) -> DataFrame:
    return drinks.partners_without_brand(lines_of(tb), tb.product_predictions(), BRAND)


@query(
    f"""WITH offered AS ({OFFERED.format(city='order_city_code,', days=90)}),
    wet AS (SELECT DISTINCT store_name FROM offered JOIN categories USING (product_id)
        WHERE predicted_category IN ('drink', 'drinks')),
    sold AS (SELECT order_country_code, order_city_code, store_name, count(DISTINCT order_id) AS orders_count
        FROM labelled GROUP BY 1, 2, 3)
    SELECT DISTINCT o.order_country_code, o.order_city_code, o.store_name, orders_count FROM offered o
    LEFT JOIN sold s ON s.order_country_code = o.order_country_code AND s.order_city_code = o.order_city_code
        AND s.store_name = o.store_name
    WHERE o.store_name NOT IN (SELECT store_name FROM wet)""",
    ["product_availability", "recent_food", "categories", "labelled"],
)
def stores_without_drinks(tb: Testbed) -> DataFrame:
    facts = tb.order_facts()
    offered = catalogue.available_products(
        facts, tb.product_availability(), AS_OF, 90, COUNTRIES, with_city=True, snapshot_days=90
    )
    return drinks.stores_without_drinks(offered, tb.product_predictions(), lines_of(tb, facts))


@query(
    f"""SELECT {normalised('product_name')} AS normalized_product_name,
        CAST(sum(bought_product_quantity) AS BIGINT) AS bought_product_quantity
    FROM labelled WHERE predicted_category IN ('drink', 'drinks') GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 50""",
    ["labelled"],
)
def top_products(tb: Testbed) -> DataFrame:
    return drinks.top_product_names(lines_of(tb), tb.product_predictions())


@query(
    """SELECT DISTINCT product_id FROM lines WHERE product_id IS NOT NULL AND product_id NOT IN (
        SELECT product_id FROM categories) ORDER BY 1 LIMIT 100""",
    ["lines", "categories"],
)
def uncategorised(tb: Testbed) -> DataFrame:
    return catalogue.uncategorised(lines_of(tb), tb.product_predictions())


def rules_sql(rules, columns: str) -> str:
    """The ordered steps spelled out as one nested pass per step, per country."""
    names, categories = "CASE", "CASE"
    for country, steps in rules.items():
        name, category = "product_name", "base"
        for rule in steps:
            hit = contains_any(name, rule.words)
            category = f"(CASE WHEN {hit} THEN '{rule.category}' ELSE {category} END)"
            if rule.rename:
                name = f"(CASE WHEN {hit} THEN '{rule.rename}' ELSE {name} END)"
        names += f" WHEN order_country_code = '{country}' THEN {name}"
        categories += f" WHEN order_country_code = '{country}' THEN {category}"
    return f"""SELECT {columns} FROM (SELECT *, {names} ELSE product_name END AS new_name,
        {categories} ELSE base END AS new_category
        FROM (SELECT *, lower(trim(predicted_category)) AS base FROM local_products))"""


RELABELLED = """order_country_code, store_name, product_id, new_name AS product_name, new_category AS predicted_category,
    new_category IS DISTINCT FROM base AS relabelled"""


@query(rules_sql(catalogue.COUNTRY_RULES, RELABELLED), ["local_products"])
def relabel_rules(tb: Testbed) -> DataFrame:
    return catalogue.apply_rules(tb.local_products())


@query(rules_sql(catalogue.COUNTRY_RULES, RELABELLED), ["local_products"])
def relabel_rule_table(tb: Testbed) -> DataFrame:
    """The same rules, read from a table."""
    return catalogue.apply_rules(tb.local_products(), rules.rule_table(tb.spark, catalogue.COUNTRY_RULES))


@query(
    """WITH said AS (SELECT DISTINCT unnest(string_split(lower(text), ' ')) AS word FROM benchmark),
    r AS (SELECT word, CAST(length(word) % 7 AS INTEGER) AS step FROM said WHERE length(word) >= 2),
    hit AS (SELECT d.doc_id, max(r.step) AS last, bool_or(r.step = 6) AS renamed
        FROM documents d JOIN r ON contains(lower(d.text), r.word) GROUP BY 1)
    SELECT d.doc_id, CASE WHEN renamed THEN 'known item' ELSE text END AS product_name,
        CASE WHEN last IS NULL THEN lower(trim(d.source)) ELSE 'group ' || last END AS predicted_category
    FROM documents d LEFT JOIN hit USING (doc_id)""",
    [],
)
def relabel_corpus_rules(tb: Testbed) -> DataFrame:
    """Thousands of rules made of the words of one table, over the whole texts of another."""
    said = tb.raw("benchmark").select(F.explode(F.split(F.lower("text"), " ")).alias("word")).distinct()
    step = (F.char_length("word") % 7).cast("int")
    known = F.when(step == 6, F.lit("known item"))
    ruled = said.filter(F.char_length("word") >= 2).select(
        F.lit("any").alias("order_country_code"), step.alias("step"), "word",
        F.concat(F.lit("group "), step.cast("string")).alias("category"), known.alias("rename"),
    )
    products = tb.raw("documents").select(
        "doc_id", F.lit("any").alias("order_country_code"), F.col("text").alias("product_name"), F.col("source").alias("predicted_category")
    )
    return catalogue.apply_rules(products, ruled).select("doc_id", "product_name", "predicted_category")


@query(rules_sql(catalogue.FIRST_PASS_RULES, RELABELLED), ["local_products"])
def relabel_first_pass(tb: Testbed) -> DataFrame:
    return catalogue.apply_rules(tb.local_products(), catalogue.FIRST_PASS_RULES)


def _food_words(country: str) -> tuple[str, ...]:
    return tuple(w for rule in catalogue.COUNTRY_RULES[country] if rule.category == "other" for w in rule.words)


def _polish_cola() -> str:
    return contains_any("product_name", catalogue.POLISH_COLA)


@query(
    "SELECT order_country_code, CAST(sum(CASE "
    + " ".join(
        f"WHEN order_country_code = '{c}' AND {contains_any('product_name', _food_words(c))} AND base IS DISTINCT FROM 'other' THEN 1"
        for c in LOCAL_COUNTRIES
        if c != "PL"
    )
    + f""" WHEN order_country_code = 'PL' AND NOT {_polish_cola()} AND {contains_any('product_name', _food_words('PL'))}
            AND ({contains_any('product_name', catalogue.POLISH_DRINKS)} OR base IS DISTINCT FROM 'other') THEN 1
        ELSE 0 END) AS BIGINT) AS changes
    FROM (SELECT *, lower(trim(predicted_category)) AS base FROM local_products) GROUP BY 1""",
    ["local_products"],
)
def rule_change_counts(tb: Testbed) -> DataFrame:
    return catalogue.rule_change_counts(tb.local_products())


@query(
    f"""SELECT DISTINCT coalesce(o.store_name, '') AS store_name, a.product_name, CAST(a.product_id AS VARCHAR) AS product_id,
        coalesce(predicted_category, '') AS predicted_category, order_city_code
    FROM product_availability a JOIN recent_food o ON o.store_address_id = a.store_address_id
    LEFT JOIN categories c ON c.product_id = a.product_id
    WHERE product_is_available AND o.store_name = '{PARTNER}'
        AND p_snapshot_date BETWEEN {AS_OF_SQL} - 90 AND {AS_OF_SQL}""",
    ["product_availability", "recent_food", "categories"],
)
def store_catalogue(tb: Testbed) -> DataFrame:
    return catalogue.store_catalogue(
        tb.order_facts(), tb.product_availability(), tb.product_predictions(), PARTNER, AS_OF, 90, COUNTRIES
    )


# ---------------------------------------------------------------------------- profiles

# The customer's first order, by time and then id, and the greatest parent of the cells it was placed in.
FIRST_SQL = """starts AS (SELECT customer_id, min(struct_pack(at := order_activated_local_at, id := order_id)) AS start
        FROM profile_orders WHERE order_is_first_delivered_order GROUP BY customer_id),
    parents AS (SELECT order_id, max((((('0x' || h8_hexagon)::BIGINT & -67553994410557441) | 31525197391593472) | 16777215)) AS parent_hexagon
        FROM checkout_events JOIN sessions USING (dynamic_session_id) GROUP BY order_id),
    located AS (SELECT starts.customer_id, order_id, order_country_code, order_city_code, start.at AS customer_first_delivered_at, parent_hexagon
        FROM starts JOIN profile_orders ON order_id = start.id LEFT JOIN parents USING (order_id))"""
PROFILE_TABLES = [
    "profile_orders", "checkout_events", "sessions", "payments", "pricing_discounts", "pnl",
    "store_segmentation", "installs",
]


@query(f"WITH {FIRST_SQL} SELECT * FROM located", ["profile_orders", "checkout_events", "sessions"])
def first_order_location(tb: Testbed) -> DataFrame:
    rows = profile.base_orders(tb.order_facts(stores=False), AS_OF, 24, COUNTRIES)
    return profile.first_order_location(rows, tb.checkout_events(), tb.sessions())


@query(
    f"""SELECT customer_id, round(a, 6) AS avg_monthly_orders,
        CASE WHEN a > {TYPE_HIGH} THEN 'A' WHEN a < {TYPE_LOW} THEN 'C' ELSE 'B' END AS user_type
    FROM (SELECT customer_id, avg(n) AS a FROM (SELECT customer_id, date_trunc('month', order_activated_local_at) AS m,
        count(DISTINCT order_id) AS n FROM profile_orders GROUP BY 1, 2) GROUP BY 1)""",
    ["profile_orders"],
)
def user_type(tb: Testbed) -> DataFrame:
    rows = profile.base_orders(tb.order_facts(stores=False), AS_OF, 24, COUNTRIES)
    return rounded(profile.user_type(rows, TYPE_HIGH, TYPE_LOW))


def _order_tests() -> dict[str, str]:
    """Condition of each share, over one row of profile_orders."""
    t = "order_activated_local_at"
    spans = {"night": (0, 6), "morning": (7, 12), "afternoon": (13, 18), "evening": (19, 23)}
    days = ("sunday", "monday", "tuesday", "wednesday", "thursday", "friday", "saturday")
    open_segments = "SELECT store_id FROM store_segmentation WHERE p_end_date IS NULL AND segmentation"
    return {
        **{f"orders_{name}": f"hour({t}) >= {low} AND hour({t}) <= {high}" for name, (low, high) in spans.items()},
        "orders_weekday": f"dayofweek({t}) NOT IN (0, 6)",
        **{f"orders_{name}": f"dayofweek({t}) = {i}" for i, name in enumerate(days)},
        "prime_orders": "order_is_prime",
        "qcommerce_orders": "order_vertical = 'QCommerce'",
        "promo_orders": "order_id IN (SELECT order_id FROM pricing_discounts WHERE discount_type = 'PROMOTOOL')",
        **{f"{m.lower()}_orders": f"order_id IN (SELECT order_id FROM payments WHERE payment_method = '{m}')" for m in profile.PAYMENT_METHODS},
        **{f"{s.lower().replace(' ', '_')}_orders": f"store_id IN ({open_segments} = '{s}')" for s in profile.SEGMENTS},
        "top_partner_orders": "(order_country_code, store_id) IN (SELECT order_country_code, store_id FROM leaders)",
    }


SHARES = tuple(f"pct_{name}" for name in _order_tests())
NO_DAYS = {"days_since_first_order": AS_OF_SQL, "days_until_first_qcommerce": "first_qcommerce_date", "days_until_first_prime": "first_prime_date"}
# Flags of each order first, then one row per customer, then what is read from that row.
PROFILE_SQL = f"""WITH {FIRST_SQL},
    sold AS (SELECT order_country_code, store_name, store_id, count(*) AS n FROM profile_orders
        WHERE store_name IS NOT NULL GROUP BY ALL),
    leaders AS (SELECT order_country_code, store_id FROM sold
        QUALIFY row_number() OVER (PARTITION BY order_country_code ORDER BY n DESC, store_name, store_id) <= 10),
    flags AS (SELECT customer_id, order_id, order_city_code, order_activated_local_at AS placed, order_transacted_value_eur AS worth,
        CASE WHEN order_vertical = 'QCommerce' THEN order_activated_local_at END AS quick_at,
        CASE WHEN order_is_prime THEN order_activated_local_at END AS prime_at,
        {', '.join(f'({test}) AS pct_{name}' for name, test in _order_tests().items())} FROM profile_orders),
    aged AS (SELECT flags.*, contribution_margin_eur AS margin, customer_first_delivered_at::DATE AS first_day,
        placed::DATE - customer_first_delivered_at::DATE AS age
        FROM flags JOIN (SELECT customer_id, customer_first_delivered_at FROM located) USING (customer_id) LEFT JOIN pnl USING (order_id)),
    habits AS (SELECT customer_id, count(*) AS total_orders, any_value(first_day) AS customer_first_delivered_date,
        {', '.join(f'count(*) FILTER (WHERE age >= {lo} AND age <= {hi}) AS {name}' for name, (lo, hi) in profile.DAY_WINDOWS.items())},
        round(avg(worth), 9) AS avg_transacted_value_eur, round(avg(margin), 9) AS avg_contribution_margin_eur,
        {', '.join(f'round(count(*) FILTER (WHERE {c}) / count(*), 9) AS {c}' for c in SHARES)},
        min(quick_at)::DATE AS first_qcommerce_date, min(prime_at)::DATE AS first_prime_date, max(placed) AS last_order_date,
        count(DISTINCT order_city_code) AS num_distinct_cities, count(*) / count(DISTINCT strftime(placed, '%Y-%m')) AS monthly
        FROM aged GROUP BY customer_id),
    liked AS (SELECT order_country_code, customer_id, list(store_name ORDER BY n DESC, store_name NULLS LAST) AS names
        FROM (SELECT order_country_code, customer_id, store_name, count(*) AS n FROM profile_orders GROUP BY ALL) GROUP BY 1, 2),
    came AS (SELECT app_install_user_id AS customer_id, app_install_is_organic, app_install_network_name AS network FROM installs)
    SELECT habits.* EXCLUDE (monthly), order_country_code, order_city_code AS customer_city, parent_hexagon AS h7_hexagon,
        round(monthly, 9) AS avg_monthly_orders,
        CASE WHEN monthly > {TYPE_HIGH} THEN 'A' WHEN monthly >= {TYPE_LOW} THEN 'B' ELSE 'C' END AS user_type,
        {', '.join(f'CAST({day} - customer_first_delivered_date AS INTEGER) AS {name}' for name, day in NO_DAYS.items())},
        round(total_orders / CASE {AS_OF_SQL} - customer_first_delivered_date WHEN 0 THEN 1.0::DOUBLE
            ELSE ({AS_OF_SQL} - customer_first_delivered_date) / 30.0::DOUBLE END, 9) AS avg_monthly_orders_since_active,
        app_install_is_organic AS organic_installs, coalesce(starts_with(network, 'Google Ads'), false) AS google_installs,
        coalesce(network = 'Apple Search Ads', false) AS apple_installs, coalesce(network = 'Aura ironSource', false) AS iron_source_installs,
        coalesce(network = 'Untrusted Devices', false) AS untrusted_devices_installs, coalesce(starts_with(network, 'Tiktok'), false) AS tiktok_installs,
        names[1] AS top_1_store, names[2] AS top_2_store, names[3] AS top_3_store
    FROM habits JOIN located USING (customer_id) LEFT JOIN liked USING (customer_id, order_country_code) LEFT JOIN came USING (customer_id)"""


# The test data's promotion type and install networks.
PROMOTION = "PROMOTOOL"
INSTALL_NETWORKS = {
    "google_installs": "Google Ads*",
    "apple_installs": "Apple Search Ads",
    "iron_source_installs": "Aura ironSource",
    "untrusted_devices_installs": "Untrusted Devices",
    "tiktok_installs": "Tiktok*",
}


def profiles(tb: Testbed) -> DataFrame:
    return profile.customer_profile(
        tb.order_facts(), tb.payments(), tb.checkout_events(), tb.sessions(), tb.installs(),
        tb.pricing_discounts(), tb.order_pnl(), tb.store_segmentation(), AS_OF, PROMOTION, INSTALL_NETWORKS, 24,
        high=TYPE_HIGH, low=TYPE_LOW,
    )


@query(PROFILE_SQL, PROFILE_TABLES)
def customer_profile(tb: Testbed) -> DataFrame:
    return rounded(profiles(tb), 9)


# ---------------------------------------------------------------------------- features


def _ltv_with_segments(tb: Testbed) -> DataFrame:
    segment = F.when(F.col("c_custkey") % 5 != 0, F.col("c_mktsegment"))
    rows = tb.raw("customer").select(F.col("c_custkey").alias("customer_id"), segment.alias("segment"))
    return tb.customer_ltv().join(rows, "customer_id")


LTV_SQL = """ltv AS (SELECT l.*, CASE WHEN c_custkey % 5 <> 0 THEN c_mktsegment END AS segment
    FROM customer_ltv l JOIN customer ON c_custkey = customer_id)"""


@query(
    f"""WITH {LTV_SQL} SELECT customer_id, round(coalesce(pltv_1y, (SELECT quantile_cont(pltv_1y, 0.5) FROM ltv)), 6) AS pltv_1y,
        round(coalesce(pltv_3y, (SELECT quantile_cont(pltv_3y, 0.5) FROM ltv)), 6) AS pltv_3y, pltv_5y,
        coalesce(segment, (SELECT segment FROM ltv WHERE segment IS NOT NULL GROUP BY 1 ORDER BY count(*) DESC, 1 LIMIT 1)) AS segment
    FROM ltv""",
    ["customer_ltv"],
)
def impute(tb: Testbed) -> DataFrame:
    filled = features.impute(_ltv_with_segments(tb), ["pltv_1y", "pltv_3y"], ["segment"], "mode")
    return rounded(filled, {"pltv_1y": 6, "pltv_3y": 6})


@query(
    f"""WITH {LTV_SQL} SELECT customer_id, """
    + ", ".join(
        f"CASE WHEN segment = '{s}' THEN 1 ELSE 0 END AS segment_{s}"
        for s in ("AUTOMOBILE", "BUILDING", "FURNITURE", "HOUSEHOLD", "MACHINERY")
    )
    + " FROM ltv",
    ["customer_ltv"],
)
def one_hot(tb: Testbed) -> DataFrame:
    return features.one_hot(_ltv_with_segments(tb).select("customer_id", "segment"), ["segment"])


def _rank_sql(metric: str) -> str:
    def mean_rank(column: str) -> str:
        return f"rank() OVER (ORDER BY {column}) + (count(*) OVER (PARTITION BY {column}) - 1) / 2.0::DOUBLE"

    return f"""SELECT '{metric}' AS metric, round(corr(a, b), 6) AS spearman FROM (SELECT {mean_rank(metric)} AS a,
        {mean_rank('l_quantity')} AS b FROM lineitem)"""


CORRELATED = ("l_extendedprice", "l_discount", "l_tax", "l_linenumber")


@query(" UNION ALL ".join(_rank_sql(m) for m in CORRELATED))
def spearman(tb: Testbed) -> DataFrame:
    return rounded(features.spearman(tb.raw("lineitem"), CORRELATED, "l_quantity"))


@query(
    """SELECT 'l_extendedprice' AS metric, round(corr(a, b), 6) AS spearman FROM (
        SELECT rank() OVER (ORDER BY l_extendedprice) + (count(*) OVER (PARTITION BY l_extendedprice) - 1) / 2.0::DOUBLE AS a,
            rank() OVER (ORDER BY l_tax) + (count(*) OVER (PARTITION BY l_tax) - 1) / 2.0::DOUBLE AS b
        FROM lineitem WHERE l_linenumber NOT IN (3, 4) AND l_returnflag <> 'R')"""
)
def spearman_with_holes(tb: Testbed) -> DataFrame:
    """NaN and null in either column."""
    price = F.expr("CASE WHEN l_linenumber = 3 THEN double('NaN') WHEN l_linenumber <> 4 THEN l_extendedprice END")
    rows = tb.raw("lineitem").select(price.alias("l_extendedprice"), F.expr("CASE WHEN l_returnflag = 'R' THEN double('NaN') ELSE l_tax END").alias("l_tax"))
    return rounded(features.spearman(rows, ["l_extendedprice"], "l_tax"))


@query(
    """SELECT o_orderkey, o_orderpriority, r <= floor(0.25 * n) AS is_test FROM (SELECT o_orderkey, o_orderpriority,
        row_number() OVER (PARTITION BY o_orderpriority ORDER BY ('0x' || substr(md5(o_orderkey || '-42'), 1, 13))::BIGINT, o_orderkey) AS r,
        count(*) OVER (PARTITION BY o_orderpriority) AS n FROM orders)"""
)
def stratified_split(tb: Testbed) -> DataFrame:
    return features.stratified_split(tb.raw("orders"), "o_orderpriority", "o_orderkey", 0.25).select(
        "o_orderkey", "o_orderpriority", "is_test"
    )


PROFILE_NUMBERS = (
    "total_orders", *profile.DAY_WINDOWS, "avg_transacted_value_eur", "avg_contribution_margin_eur",
    *SHARES, "num_distinct_cities", "days_since_first_order",
    "days_until_first_qcommerce", "days_until_first_prime", "organic_installs", *INSTALL_NETWORKS,
)
FILLED = ", ".join(
    f"coalesce(CAST({c} AS DOUBLE), (SELECT quantile_cont(CAST({c} AS DOUBLE), 0.5) FROM prof)) AS {c}" for c in PROFILE_NUMBERS
)


@query(
    f"""WITH prof AS MATERIALIZED ({PROFILE_SQL}),
    filled AS MATERIALIZED (SELECT CASE user_type WHEN 'A' THEN 3 WHEN 'B' THEN 2 ELSE 1 END AS y, {FILLED} FROM prof),
    long AS (UNPIVOT filled ON {', '.join(PROFILE_NUMBERS)} INTO NAME metric VALUE v),
    ranked AS (SELECT metric, rank() OVER (PARTITION BY metric ORDER BY v) + (count(*) OVER (PARTITION BY metric, v) - 1) / 2.0::DOUBLE AS a,
        rank() OVER (PARTITION BY metric ORDER BY y) + (count(*) OVER (PARTITION BY metric, y) - 1) / 2.0::DOUBLE AS b FROM long),
    found AS (SELECT metric, round(corr(a, b), 6) AS spearman FROM ranked GROUP BY metric HAVING var_pop(a) > 0 AND var_pop(b) > 0)
    SELECT * FROM found QUALIFY row_number() OVER (ORDER BY spearman DESC, metric) <= 15 OR row_number() OVER (ORDER BY spearman, metric) <= 15""",
    PROFILE_TABLES,
)
def profile_correlations(tb: Testbed) -> DataFrame:
    coded, names = reports.user_type_features(materialise(rounded(profiles(tb), 9)))
    return features.strongest(rounded(features.spearman(materialise(coded), names, "user_type_ordinal")), 15)


# ---------------------------------------------------------------------------- models

SHORT_SQL = "CASE WHEN n_chars > 1500 THEN 1 ELSE 0 END"


@query(
    f"""WITH p AS (SELECT quality AS y, {SHORT_SQL} AS g FROM documents JOIN labels USING (doc_id)),
    c AS (SELECT CAST(k AS VARCHAR) AS class, count(*) FILTER (WHERE y = k) AS support, count(*) FILTER (WHERE g = k) AS guessed,
        count(*) FILTER (WHERE y = k AND g = k) AS hits FROM p, (VALUES (0), (1)) v(k) GROUP BY k),
    s AS (SELECT class, hits, support, CASE WHEN guessed > 0 THEN hits / guessed ELSE 0 END AS pr,
        CASE WHEN support > 0 THEN hits / support ELSE 0 END AS re FROM c),
    f AS (SELECT *, CASE WHEN pr + re > 0 THEN 2 * pr * re / (pr + re) ELSE 0 END AS f FROM s)
    SELECT class, round(pr, 6) AS precision, round(re, 6) AS recall, round(f, 6) AS f1, support FROM f
    UNION ALL SELECT 'accuracy', round(sum(hits) / sum(support), 6), round(sum(hits) / sum(support), 6), round(sum(hits) / sum(support), 6), CAST(sum(support) AS BIGINT) FROM f
    UNION ALL SELECT 'macro avg', round(avg(pr), 6), round(avg(re), 6), round(avg(f), 6), CAST(sum(support) AS BIGINT) FROM f
    UNION ALL SELECT 'weighted avg', round(sum(pr * support) / sum(support), 6), round(sum(re * support) / sum(support), 6),
        round(sum(f * support) / sum(support), 6), CAST(sum(support) AS BIGINT) FROM f"""
)
def classification_metrics(tb: Testbed) -> DataFrame:
    rows = tb.raw("documents").join(tb.raw("labels"), "doc_id")
    guessed = rows.withColumn("guess", F.when(F.col("n_chars") > 1500, 1).otherwise(0))
    return rounded(models.classification_metrics(guessed, "quality", "guess"))


@query(
    'SELECT order_country_code, "Category", count(*) AS n FROM training_products GROUP BY 1, 2',
    ["training_products"],
)
def label_distribution(tb: Testbed) -> DataFrame:
    return catalogue.label_distribution(tb.training_products(), ["order_country_code", "Category"])


# A model's scores are not SQL's to say; the twins hold which rows were held out, their true classes and
# supports, and that every row asked got one of the known classes. The unit tests hold the quality.


def held_out(rows: str, strata: str, fraction: float, identity: str = "doc_id") -> str:
    return f"""SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY {strata}
            ORDER BY ('0x' || substr(md5({identity} || '-42'), 1, 13))::BIGINT, {identity}) AS draw,
        count(*) OVER (PARTITION BY {strata}) AS of FROM {rows}) WHERE draw <= floor({fraction}::DOUBLE * of)"""


NAMED = 'training_products WHERE order_country_code IS NOT NULL AND product_name IS NOT NULL AND "Category" IS NOT NULL'
KNOWN = "predicted_category IN ('drink', 'other') AS known"


@query(
    f"""WITH prof AS MATERIALIZED ({PROFILE_SQL}) SELECT 'support' AS part, user_type AS name,
        CAST(floor(0.25::DOUBLE * count(*)) AS BIGINT) AS n FROM prof GROUP BY user_type HAVING floor(0.25::DOUBLE * count(*)) > 0
    UNION ALL SELECT 'importances', 'rows', 30 UNION ALL SELECT 'scores', 'outside 0 to 1', 0""",
    PROFILE_TABLES,
)
def user_type_report(tb: Testbed) -> DataFrame:
    """Supports in the held-out report of the user-type forest, and the size of its list of importances."""
    parts = reports.user_type_model(profiles(tb))
    report = materialise(parts["report"])
    support = report.filter("support > 0").filter(F.col("class").isin("A", "B", "C")).select(
        F.lit("support").alias("part"), F.col("class").alias("name"), F.col("support").alias("n")
    )
    sizes = parts["importances"].agg(F.count("importance").alias("n")).selectExpr("'importances' AS part", "'rows' AS name", "n")
    odd = report.agg(F.count_if(~F.col("f1").between(0, 1)).alias("n")).selectExpr("'scores' AS part", "'outside 0 to 1' AS name", "n")
    return tables.stack(support, sizes, odd)


def chain(tb: Testbed) -> dict[str, DataFrame]:
    rows = tb.raw("documents").select(
        "doc_id", F.col("lang").alias("order_country_code"), F.col("text").alias("product_name")
    )
    return reports.category_reports(tb.training_products(), rows, "doc_id")


@query(
    f'SELECT doc_id, order_country_code, "Category", true AS known FROM ({held_out(NAMED, "order_country_code", 0.2)})',
    ["training_products"],
)
def category_by_country(tb: Testbed) -> DataFrame:
    """Held-out products of one text model per country: their true category, and whether they got a known one."""
    _, tested = models.fit_by_country(tb.training_products(), "doc_id")
    return tested.select("doc_id", "order_country_code", "Category", F.expr(KNOWN))


@query(
    f"""SELECT order_country_code, "Category" AS class, count(*) AS support FROM ({held_out(NAMED, "order_country_code", 0.2)})
    GROUP BY 1, 2""",
    ["training_products"],
)
def category_report(tb: Testbed) -> DataFrame:
    """Supports in the held-out report of each country."""
    report = chain(tb)["report"].filter(F.col("class").isin("drink", "other") & (F.col("support") > 0))
    return report.select("order_country_code", "class", "support")


@query(
    f"""SELECT doc_id, lang AS order_country_code, true AS known, false AS relabelled FROM documents
    WHERE text IS NOT NULL AND lang IN (SELECT order_country_code FROM {NAMED})""",
    ["training_products"],
)
def predicted_catalogue(tb: Testbed) -> DataFrame:
    """Every document with a category by the model of its language; no keyword rule is for these languages."""
    return chain(tb)["catalogue"].select("doc_id", "order_country_code", F.expr(KNOWN), "relabelled")


@query(
    f"""SELECT doc_id, order_country_code, CASE WHEN "Category" = 'drink' THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS label, true AS known
    FROM ({held_out(f"{NAMED} AND order_country_code = 'en'", '"Category"', 0.2)})""",
    ["training_products"],
)
def binary_category(tb: Testbed) -> DataFrame:
    """Held-out products of the drink-or-other model of one country, with their true label."""
    _, tested = models.fit_binary(tb.training_products(), "doc_id", "en")
    return tested.select("doc_id", "order_country_code", "label", F.expr(KNOWN))


@query("SELECT doc_id, 4096 AS width, length(text) >= 3 AS filled FROM documents WHERE text IS NOT NULL")
def text_vectors(tb: Testbed) -> DataFrame:
    """Width of each document's vector, labelled or not, and whether it holds any n-gram."""
    vector = vector_to_array("features")
    vectors = models.text_vectors(tb.raw("documents"), "text").select("doc_id", vector.alias("v"))
    return vectors.select("doc_id", F.size("v").alias("width"), F.exists("v", lambda x: x > 0).alias("filled"))


@query(
    """SELECT label, CAST(floor(0.2::DOUBLE * count(*)) AS BIGINT) AS support FROM embeddings
    WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: isnan(x))) = 0 GROUP BY label
    HAVING floor(0.2::DOUBLE * count(*)) > 0"""
)
def vector_classifier(tb: Testbed) -> DataFrame:
    """Supports of the classes in the held-out part of stored vectors that a forest tells apart."""
    rows = models.valid_vectors(tb.raw("embeddings"), "embedding").withColumn("features", array_to_vector("embedding"))
    parts = materialise(features.stratified_split(rows, "label", "vec_id", 0.2))
    fitted = models.fit_vectors(parts.filter(~F.col("is_test")), "label")
    cells = models.confusion(fitted.transform(parts.filter("is_test")), "label", "prediction")
    return cells.groupBy("label").agg(F.sum("n").alias("support"))


BITS = "('0x' || substr(md5(near), 1, 16))::UBIGINT"


@query(
    f"""WITH t AS (SELECT item_id, regexp_extract_all(lower(text), '[\\p{{L}}\\p{{N}}]+') AS w FROM benchmark),
    p AS (SELECT item_id, i, w[i] AS word, w FROM (SELECT *, unnest(range(1, len(w) + 1)) AS i FROM t)),
    q AS (SELECT word, w[i + d] AS near FROM p, (VALUES (-5), (-4), (-3), (-2), (-1), (1), (2), (3), (4), (5)) v(d) WHERE i + d BETWEEN 1 AND len(w)),
    c AS (SELECT word, near, count(*) AS n FROM q GROUP BY 1, 2), m AS (SELECT word, sum(n) AS total FROM c GROUP BY 1 HAVING sum(n) >= 2),
    k AS (SELECT c.word, a.total, near, greatest(ln(n * (SELECT sum(total) FROM m)::DOUBLE / (a.total * b.total::DOUBLE)), 0) AS weight
        FROM c JOIN m a ON a.word = c.word JOIN m b ON b.word = near),
    v AS (SELECT word, total, i, sum(CASE WHEN ({BITS} >> i) & 1 = 1 THEN weight ELSE -weight END) AS x
        FROM k, range(64) r(i) GROUP BY 1, 2, 3),
    u AS (SELECT word, i, CASE WHEN sqrt(sum(x * x) OVER (PARTITION BY word)) > 0 THEN x / sqrt(sum(x * x) OVER (PARTITION BY word)) ELSE x END AS x FROM v),
    s AS (SELECT doc_id, unnest(regexp_extract_all(lower(text), '[\\p{{L}}\\p{{N}}]+')) AS word FROM documents WHERE text IS NOT NULL),
    f AS (SELECT doc_id, word, count(*) AS times FROM s GROUP BY 1, 2),
    e AS (SELECT doc_id, sum(times) FILTER (WHERE i = 0) AS known, sum(times * x) FILTER (WHERE i = 0) / sum(times) FILTER (WHERE i = 0) AS first,
        sum(times * x) FILTER (WHERE i = 63) / sum(times) FILTER (WHERE i = 0) AS last
        FROM f JOIN (SELECT word, i, x FROM u WHERE i IN (0, 63)) USING (word) GROUP BY 1)
    SELECT doc_id, CAST(coalesce(known, 0) AS BIGINT) AS known_words, known IS NULL AS zero, round(coalesce(first, 0), 6) AS first,
        round(coalesce(last, 0), 6) AS last FROM documents LEFT JOIN e USING (doc_id) WHERE text IS NOT NULL""",
)
def mean_word_vectors(tb: Testbed) -> DataFrame:
    """Vectors learnt from one table's words, averaged over the whole texts of another."""
    learnt = vectors.word_vectors(tb.raw("benchmark"), "text")
    means = vectors.mean_vectors(tb.raw("documents").select("doc_id", "text"), learnt, "text")
    v = vector_to_array("features")
    shown = means.select("doc_id", "known_words", (F.aggregate(v, F.lit(0.0), lambda a, x: a + F.abs(x)) == 0).alias("zero"), v[0].alias("first"), v[63].alias("last"))
    return rounded(shown)


SEPARATE = """(SELECT id, ['A', 'B', 'C'][id % 3 + 1] AS order_country_code,
        CASE flag WHEN 'R' THEN 'drink' WHEN 'A' THEN 'food' ELSE 'other' END AS category
    FROM (SELECT l_orderkey * 10 + l_linenumber AS id, min(l_returnflag) AS flag FROM lineitem GROUP BY 1))"""


@query(
    f"""SELECT id, order_country_code, category AS "Category", category AS predicted_category
    FROM ({held_out(SEPARATE, "order_country_code", 0.2, "id")})"""
)
def separable_categories(tb: Testbed) -> DataFrame:
    """Models on word vectors over names that tell the category: every held-out product gets its own."""
    lines = tb.raw("lineitem").groupBy((F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("id")).agg(F.min("l_returnflag").alias("flag"))
    category = F.when(F.col("flag") == "R", "drink").when(F.col("flag") == "A", "food").otherwise("other")
    said = F.when(category == "drink", "cola juice water").when(category == "food", "bread cheese rice").otherwise("soap paper brush")
    place = (F.col("id") % 3 + 1).cast("int")
    train = lines.select(
        "id", F.element_at(F.array(F.lit("A"), F.lit("B"), F.lit("C")), place).alias("order_country_code"),
        F.concat(F.lit("pack "), F.element_at(F.split(said, " "), place), F.lit(" "), said).alias("product_name"), category.alias("Category"),
    )
    train = materialise(train)
    _, tested = models.fit_by_country(train, "id", trees=10, vectors=vectors.word_vectors(train))
    return tested.select("id", "order_country_code", "Category", "predicted_category")


SPLIT_ORDERS = "(SELECT o_orderkey AS id, o_orderstatus AS kind FROM orders)"


@query(f"SELECT id, kind, kind AS predicted FROM ({held_out(SPLIT_ORDERS, 'kind', 0.25, 'id')})")
def separable_forest(tb: Testbed) -> DataFrame:
    """A weighted forest over numbers that tell the class: every held-out row gets its own."""
    shift = F.when(F.col("o_orderstatus") == "F", 0).when(F.col("o_orderstatus") == "O", 10).otherwise(20)
    rows = tb.raw("orders").select(
        F.col("o_orderkey").alias("id"), F.col("o_orderstatus").alias("kind"), (shift + F.col("o_orderkey") % 7).cast("double").alias("signal"),
        (F.col("o_custkey") % 5).cast("double").alias("noise"),
    )
    parts = materialise(features.stratified_split(rows, "kind", "id", 0.25))
    fitted = models.fit_forest(parts.filter(~F.col("is_test")), ["signal", "noise"], "kind", trees=20)
    return fitted.transform(parts.filter("is_test")).select("id", "kind", "predicted")


SPLIT_PARTS = "(SELECT p_partkey AS id, CASE WHEN p_name LIKE '%bolt%' OR p_name LIKE '%gear%' THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS label FROM part)"


@query(f"SELECT id, label, CASE WHEN label = 1 THEN 'drink' ELSE 'other' END AS predicted_category FROM ({held_out(SPLIT_PARTS, 'label', 0.2, 'id')})")
def separable_binary(tb: Testbed) -> DataFrame:
    """The drink-or-other model over names whose last word tells: every held-out row gets its own."""
    drink = F.col("p_name").contains("bolt") | F.col("p_name").contains("gear")
    train = tb.raw("part").select(
        F.col("p_partkey").alias("id"), F.lit("A").alias("order_country_code"), F.col("p_name").alias("product_name"), F.when(drink, " Drink").otherwise("food").alias("Category")
    )
    _, tested = models.fit_binary(train, "id", "A")
    return tested.select("id", "label", "predicted_category")


@query("SELECT doc_id, true AS same FROM documents WHERE text IS NOT NULL")
def model_round_trip(tb: Testbed) -> DataFrame:
    """Whether a category model says the same of every document after it was saved and loaded."""
    fitted, _ = models.fit_binary(tb.training_products(), "doc_id", "en")
    path = shared_path(tb.spark, "models")
    models.save_model(fitted, path)
    rows = tb.raw("documents").select("doc_id", F.col("text").alias("product_name")).dropna(subset=["product_name"])
    before = fitted.transform(rows).select("doc_id", "product_name", F.col("predicted_category").alias("before"))
    after = models.load_model(path).transform(before)
    return after.select("doc_id", (F.col("before") == F.col("predicted_category")).alias("same"))


# ---------------------------------------------------------------------------- sinks


@query(
    "SELECT order_country_code, store_name, product_id, product_name, predicted_category FROM local_products",
    ["local_products"],
)
def csv_round_trip(tb: Testbed) -> DataFrame:
    path = shared_path(tb.spark, "csv")
    sinks.write_csv(tb.local_products(), path)
    return tables.read_csv(tb.spark, path, "product_predictions")


@query("SELECT order_country_code, store_name, orders, rank FROM partners", ["partners"])
def report_overwrite(tb: Testbed) -> DataFrame:
    root = shared_path(tb.spark, "reports")
    sinks.publish(tb.raw("nation"), root, "partners")
    sinks.publish(orders.top_partners(tb.order_facts(), AS_OF, 90, PARTNERS_SHOWN, COUNTRIES), root, "partners")
    return sinks.read_report(tb.spark, root, "partners")


FEATURES_SQL = f"""SELECT metric, h3_8_hash AS h8_hexagon, {GEOMETRY} AS geometry FROM (
    SELECT DISTINCT h3_8_hash, h3_8_polygon_wkt AS h3_geom, unnest(['orders', 'sessions']) AS metric FROM hexagons
    WHERE h3_8_polygon_wkt IS NOT NULL)"""


@query(FEATURES_SQL, ["hexagons"])
def map_feed_sink(tb: Testbed) -> DataFrame:
    metrics = ("orders", "sessions")
    path = shared_path(tb.spark, "feeds")
    sinks.write_feed(reports.hexagon_feeds(reports.hexagon_priorities(city_demand(tb), metrics), metrics), path)
    written = sinks.read_report(tb.spark, path, "feed")
    return written.select(F.col("metric").cast("string").alias("metric"), "h8_hexagon", "geometry")


FED_PARTNERS = (PARTNER, "Supplier#000000007")


@query(FEATURES_SQL.replace("SELECT metric,", "SELECT partner, metric,").replace("FROM hexagons", f"FROM hexagons, (SELECT unnest({list(FED_PARTNERS)}) AS partner)").replace("SELECT DISTINCT h3_8_hash", "SELECT DISTINCT partner, h3_8_hash"), ["hexagons"])
def partner_feed_sink(tb: Testbed) -> DataFrame:
    path = shared_path(tb.spark, "feeds")
    feeds = reports.partner_feeds(
        tb.hexagons(), tb.sessions(), tb.checkout_events(), tb.order_facts(), FED_PARTNERS,
        SESSION_START, SESSION_END, ("orders", "sessions"), COUNTRIES, CITIES,
    )
    sinks.write_feed(feeds, path, "partners", by="partner")
    written = sinks.read_report(tb.spark, path, "partners")
    return written.select(F.col("partner").cast("string").alias("partner"), "metric", "h8_hexagon", "geometry")



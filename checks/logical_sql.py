"""The logical tables as SQL over the driver's tables, for the DuckDB side of the checks."""

from __future__ import annotations

from orderloom.functions.text import LETTERS, NOISE_PATTERN, SIZE_PATTERN
from checks import testbed as tb

HEAD = (1 << 59) | (8 << 52) | (15 << 45) | ((1 << 21) - 1)


def cell(key: str) -> str:
    digits = " + ".join(f"((({key}) // {7**i}) % 7) * {1 << (21 + 3 * i)}" for i in range(8))
    return f"lower(to_hex(({HEAD} + {digits})::BIGINT))"


def text_list(words) -> str:
    return ", ".join("'" + w.replace("'", "''") + "'" for w in words)


def contains_any(name: str, words) -> str:
    tests = " OR ".join(f"contains(lower({name}), '{w.lower()}')" for w in words)
    return f"coalesce({tests}, false)"


def normalised(name: str) -> str:
    out = f"lower({name})"
    for letter, spelling in LETTERS.items():
        quoted = spelling.replace("'", "''")
        out = f"replace({out}, '{letter}', '{quoted}')"
    out = f"trim({out})"
    for pattern in (SIZE_PATTERN, NOISE_PATTERN):
        quoted = pattern.replace("'", "''")
        out = f"regexp_replace({out}, '{quoted}', '', 'g')"
    return f"CASE WHEN {out} = 'kokakola' THEN 'cocacola' ELSE {out} END"


def _local_name() -> str:
    out = "CASE"
    for noun, names in tb.LOCAL_NAMES.items():
        for i, name in enumerate(names):
            out += f" WHEN split_part(p_name, ' ', -1) = '{noun}' AND p_partkey % 6 = {i} THEN '{name}'"
    return out + " END"


def _corner(dx: float, dy: float) -> str:
    return f"printf('%.3f %.3f', lon + ({dx}), lat + ({dy}))"


RING = " || ', ' || ".join(
    _corner(dx, dy) for dx, dy in ((-0.005, -0.005), (0.005, -0.005), (0.005, 0.005), (-0.005, 0.005), (-0.005, -0.005))
)
AS_OF = f"DATE '{tb.AS_OF}'"

TABLES: dict[str, tuple[tuple[str, ...], str]] = {
    "places": (
        (),
        """SELECT n_nationkey, n_name AS city, r_name AS country
        FROM nation JOIN region ON n_regionkey = r_regionkey""",
    ),
    "order_facts": (
        ("places",),
        f"""SELECT o.o_orderkey AS order_id, o.o_custkey AS customer_id, p.country AS order_country_code,
            p.city AS order_city_code, o.o_orderdate AS order_activated_local_at,
            {tb.STATUS} AS order_final_status, {tb.PARENT} AS order_parent_relationship_type,
            f.o_orderkey IS NOT NULL AS order_is_first_delivered_order,
            o_orderpriority = '1-URGENT' AS order_is_prime, {tb.VERTICAL} AS order_vertical,
            o_totalprice AS order_transacted_value_eur, o_totalprice * 4 AS order_transacted_value_local,
            s.s_name AS store_name, st.store_id, st.store_id AS store_address_id
        FROM orders o JOIN customer c ON o.o_custkey = c.c_custkey
        JOIN places p ON c.c_nationkey = p.n_nationkey
        LEFT JOIN (SELECT o_orderkey FROM (SELECT o_orderkey, row_number() OVER (
                PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS rn
            FROM orders WHERE o_orderstatus <> 'O') WHERE rn = 1) f ON o.o_orderkey = f.o_orderkey
        LEFT JOIN (SELECT l_orderkey, min(l_suppkey) AS store_id FROM lineitem GROUP BY 1) st
            ON st.l_orderkey = o.o_orderkey
        LEFT JOIN supplier s ON s.s_suppkey = st.store_id""",
    ),
    "order_pnl": (
        (),
        "SELECT l_orderkey AS order_id, "
        + ", ".join(f"{sql} AS {name}" for name, sql in tb.PNL_TERMS.items())
        + " FROM lineitem GROUP BY 1",
    ),
    "customer_ltv": (
        (),
        """SELECT c_custkey AS customer_id, b AS pltv_1y, b * 3 AS pltv_3y, b * 5 AS pltv_5y
        FROM (SELECT c_custkey, CASE WHEN c_acctbal > 0 THEN c_acctbal END AS b FROM customer)""",
    ),
    "customer_lto": (
        (),
        f"""SELECT c_custkey AS customer_id, b AS predicted_orders_12mo, b * 3 AS predicted_orders_36mo,
            b * 5 AS predicted_orders_60mo,
            CASE WHEN c_custkey % 2 = 0 THEN {AS_OF} - 1 ELSE {AS_OF} - 2 END AS p_date
        FROM (SELECT c_custkey, CASE WHEN c_acctbal > 0 THEN c_acctbal END / 100 AS b FROM customer)""",
    ),
    "bought_products": (
        (),
        """SELECT l_orderkey AS order_id, l_partkey AS product_id, p_name AS product_name,
            CAST(trunc(l_quantity) AS BIGINT) AS bought_product_quantity
        FROM lineitem JOIN part ON l_partkey = p_partkey""",
    ),
    "product_availability": (
        (),
        """SELECT l_suppkey AS store_address_id, l_partkey AS product_id, p_name AS product_name,
            l_returnflag <> 'R' AS product_is_available, CAST(l_shipdate AS DATE) AS p_snapshot_date
        FROM lineitem JOIN part ON l_partkey = p_partkey""",
    ),
    "product_predictions": (
        (),
        f"""SELECT r_name AS order_country_code, 'any' AS store_name, p_partkey AS product_id,
            p_name AS product_name, {tb.CATEGORY} AS predicted_category FROM part, region""",
    ),
    "categories": (
        ("product_predictions",),
        """SELECT product_id, coalesce(min(c) FILTER (WHERE c IN ('drink', 'drinks')), min(c)) AS predicted_category
        FROM (SELECT product_id, lower(trim(predicted_category)) AS c FROM product_predictions)
        WHERE c <> '' GROUP BY 1""",
    ),
    "local_products": (
        (),
        f"""SELECT [{text_list(tb.LOCAL_COUNTRIES)}][p_partkey % 6 + 1] AS order_country_code,
            'store ' || p_brand AS store_name, p_partkey AS product_id,
            {_local_name()} || ' ' || p_size || ' ml' AS product_name,
            CASE p_size % 3 WHEN 0 THEN ' Drink' WHEN 1 THEN 'OTHER ' END AS predicted_category
        FROM part""",
    ),
    "training_products": (
        (),
        """SELECT doc_id, lang AS order_country_code, text AS product_name,
            CASE WHEN quality = 1 THEN 'drink' ELSE 'other' END AS "Category"
        FROM documents JOIN labels USING (doc_id)""",
    ),
    "hexagons": (
        (),
        f"""SELECT 'NATION_' || (u % 25) AS city_code, {cell('u')} AS h3_8_hash, lat AS h3_8_center_lat,
            lon AS h3_8_center_lon,
            CASE WHEN u % 10 <> 9 THEN 'POLYGON ((' || {RING} || '))' END AS h3_8_polygon_wkt
        FROM (SELECT DISTINCT user_id AS u, round(40.0::DOUBLE + 0.01::DOUBLE * (user_id % 37), 6) AS lat,
            round(20.0::DOUBLE + 0.01::DOUBLE * (user_id // 37), 6) AS lon FROM events)""",
    ),
    "session_events": (
        ("places",),
        """SELECT event_id, ts, user_id, event_type, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k,
            country, city
        FROM events JOIN places ON n_nationkey = user_id % 25""",
    ),
    "sessions": (
        ("session_events",),
        f"""SELECT CAST(event_id AS VARCHAR) AS dynamic_session_id, {cell('user_id')} AS h8_hexagon,
            country AS country_code, city AS city_code, ts AS session_start_time_local,
            [k % 10, (k * 7) % 10] AS visited_store_address_ids,
            CASE WHEN event_type = 'purchase' THEN 1 ELSE 0 END AS count_ce__order_created
        FROM session_events""",
    ),
    "checkout_events": (
        ("session_events",),
        """SELECT event_id AS order_id, CAST(event_id AS VARCHAR) AS dynamic_session_id,
            'Supplier#' || lpad(CAST(k % 10 AS VARCHAR), 9, '0') AS store_name, country, city,
            CAST(ts AS DATE) AS p_creation_date
        FROM session_events WHERE event_type = 'purchase'""",
    ),
    "store_addresses": (
        (),
        f"""SELECT s_suppkey AS store_address_id, s_suppkey AS store_id, {cell('s_suppkey')} AS h3_hash_8,
            CASE WHEN s_suppkey % 3 <> 0 THEN CAST(s_suppkey % 500 * 5 + 900 AS DOUBLE) END
                AS store_address_maximum_delivery_distance_meters,
            s_suppkey % 11 = 5 AS store_address_is_deleted,
            CASE WHEN s_suppkey % 7 = 0 THEN {AS_OF} END AS p_end_date
        FROM supplier""",
    ),
    "stores": (
        (),
        """SELECT s_suppkey AS store_id, s_name AS store_name, 'NATION_' || (s_suppkey % 25) AS city_code,
            s_suppkey % 13 <> 4 AS store_is_enabled,
            CAST(s_suppkey % 500 * 10 + 1000 AS DOUBLE) AS store_maximum_delivery_distance,
            CAST(NULL AS DATE) AS p_end_date
        FROM supplier""",
    ),
    "payments": ((), f"SELECT o_orderkey AS order_id, {tb.PAYMENT} AS payment_method FROM orders"),
    "installs": (
        (),
        f"""SELECT CASE WHEN c_custkey % 9 <> 0 THEN c_custkey END AS app_install_user_id,
            {tb.NETWORK} AS app_install_network_name, c_custkey % 2 = 0 AS app_install_is_organic
        FROM customer""",
    ),
    "pricing_discounts": (
        (),
        """SELECT o_orderkey AS order_id,
            CASE WHEN o_orderkey % 4 = 0 THEN 'PROMOTOOL' ELSE 'OTHER' END AS discount_type FROM orders""",
    ),
    "store_segmentation": (
        (),
        f"""SELECT s_suppkey AS store_id, {tb.SEGMENT} AS segmentation, 'EUROPE' AS country_code,
            CASE WHEN s_suppkey % 7 = 0 THEN {AS_OF} END AS p_end_date FROM supplier""",
    ),
    # Derived relations several checks share.
    "value_orders": (
        ("order_facts",),
        f"""SELECT * FROM order_facts WHERE order_final_status = 'DeliveredStatus'
            AND order_parent_relationship_type IS NULL
            AND order_activated_local_at >= DATE '{tb.AS_OF.year - 1}-01-01'
            AND order_activated_local_at < {AS_OF} + 1""",
    ),
    "pnl": (
        ("order_pnl",),
        """SELECT order_id, sum(contribution_margin_eur) AS contribution_margin_eur,
            sum(tcorev_eur + adve_eur + totbdr_eur + bwsrev_eur + mbsrsu_eur + serfig_eur + deacsu_eur
                + (mfcgso_eur - qmcogs_eur)) AS rpo,
            sum(coalesce(bcomfr_eur, 0) + coalesce(dicofr_eur, 0) + coalesce(wacofr_eur, 0)
                + coalesce(bundfr_eur, 0) + coalesce(rubcfr_eur, 0) + coalesce(rabcfr_eur, 0)
                + coalesce(otbcfr_eur, 0) + coalesce(caocfr_eur, 0)) AS cpo
        FROM order_pnl GROUP BY 1""",
    ),
    "customer_panel": (
        ("value_orders", "pnl", "customer_ltv", "customer_lto"),
        f"""SELECT o.order_country_code AS country, o.customer_id, pltv_1y, pltv_3y, pltv_5y,
            predicted_orders_12mo AS plto_1y, predicted_orders_36mo AS plto_3y, predicted_orders_60mo AS plto_5y,
            avg(order_transacted_value_eur) AS aov, count(DISTINCT o.order_id) AS total_orders,
            count(DISTINCT CASE WHEN order_vertical = 'QCommerce' THEN o.order_id END) AS total_qcomm_orders,
            datesub('month', min(CASE WHEN order_is_first_delivered_order THEN order_activated_local_at END),
                max(order_activated_local_at)) + 1 AS active_months,
            sum(contribution_margin_eur) AS contribution_margin_eur, sum(rpo) AS rpo, sum(cpo) AS cpo
        FROM value_orders o
        JOIN (SELECT DISTINCT customer_id, order_country_code FROM value_orders
            WHERE order_is_first_delivered_order) n USING (customer_id, order_country_code)
        LEFT JOIN pnl ON pnl.order_id = o.order_id
        LEFT JOIN customer_ltv ltv ON ltv.customer_id = o.customer_id
        JOIN customer_lto lto ON lto.customer_id = o.customer_id AND lto.p_date = {AS_OF} - 1
        GROUP BY 1, 2, 3, 4, 5, 6, 7, 8""",
    ),
    "recent_food": (
        ("order_facts",),
        f"""SELECT * FROM order_facts WHERE order_final_status = 'DeliveredStatus' AND order_vertical = 'Food'
            AND order_activated_local_at >= {AS_OF} - 90 AND order_activated_local_at < {AS_OF} + 1""",
    ),
    "partners": (
        ("recent_food",),
        """SELECT * FROM (SELECT order_country_code, store_name, count(DISTINCT order_id) AS orders,
                row_number() OVER (PARTITION BY order_country_code
                    ORDER BY count(DISTINCT order_id) DESC, store_name) AS rank
            FROM recent_food WHERE order_parent_relationship_type IS NULL AND store_name IS NOT NULL
            GROUP BY 1, 2) WHERE rank <= 5""",
    ),
    "lines": (
        ("recent_food", "bought_products", "partners"),
        """SELECT o.order_id, order_city_code, o.order_country_code, o.store_name, product_id, product_name,
            bought_product_quantity, order_transacted_value_local, order_transacted_value_eur,
            p.store_name IS NOT NULL AS top_partner
        FROM recent_food o LEFT JOIN bought_products b ON b.order_id = o.order_id
        LEFT JOIN partners p ON p.store_name = o.store_name AND p.order_country_code = o.order_country_code
        WHERE order_parent_relationship_type IS NULL""",
    ),
    "labelled": (
        ("lines", "categories"),
        "SELECT l.*, predicted_category FROM lines l JOIN categories USING (product_id)",
    ),
    "profile_orders": (
        ("order_facts",),
        f"""SELECT * FROM order_facts WHERE order_final_status = 'DeliveredStatus'
            AND order_parent_relationship_type IS NULL
            AND order_activated_local_at >= date_trunc('month', {AS_OF} - INTERVAL 24 MONTH)
            AND order_activated_local_at < {AS_OF} + 1""",
    ),
    "radii": (
        ("store_addresses", "stores", "hexagons"),
        """SELECT DISTINCT s.store_name, a.store_address_id, a.h3_hash_8, h.h3_8_center_lat AS h3_8_lat,
            h.h3_8_center_lon AS h3_8_lon, h.h3_8_polygon_wkt AS h3_geom,
            coalesce(store_address_maximum_delivery_distance_meters, store_maximum_delivery_distance) AS radius_m
        FROM store_addresses a LEFT JOIN hexagons h ON h.h3_8_hash = a.h3_hash_8
        JOIN stores s ON s.store_id = a.store_id
        WHERE a.p_end_date IS NULL AND s.p_end_date IS NULL AND store_is_enabled
            AND NOT store_address_is_deleted""",
    ),
}


def _needed(names, seen=None) -> list[str]:
    seen = [] if seen is None else seen
    for name in names:
        if name not in seen:
            _needed(TABLES[name][0], seen)
            if name not in seen:
                seen.append(name)
    return seen


def twin(uses, body: str, recursive: bool = False) -> str:
    """``body`` below the definitions of the logical tables it reads."""
    parts = [f"{name} AS MATERIALIZED ({TABLES[name][1]})" for name in _needed(uses)]
    body = body.strip()
    if body[:5].upper() == "WITH ":
        parts.append(body[5:])
        return ("WITH RECURSIVE " if recursive else "WITH ") + ",\n".join(parts)
    return (("WITH " + ",\n".join(parts) + "\n") if parts else "") + body

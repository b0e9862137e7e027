"""Hexagon demand, store radii, map feed and store coverage."""

from __future__ import annotations

import datetime as dt
import math
from collections.abc import Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from orderloom.functions.dates import between_days
from orderloom.functions.geo import EARTH_RADIUS_M, haversine_m, unit_vector, wkt_geojson, wkt_problem
from orderloom.functions.numbers import ratio_or_null
from orderloom.operators.buckets import bucket_colour
from orderloom.operators.orders import delivered
from orderloom.session import materialise
from orderloom.sources.tables import current_rows, for_values

#: A session and the checkouts made in it lie at most so many days apart.
SESSION_DAYS = 7
#: Copies of a cell's hexagons, among which the cell's circles are shared out.
CELL_SALTS = 8
#: Edge of the coarsest cell, in Earth radii, and the finest level (some 24 m); each level halves the edge.
COARSEST, FINEST = 4.0, 20
CELL = ("cell_x", "cell_y", "cell_z")


def sessions_at_partner(
    sessions: DataFrame, order_facts: DataFrame, partner: str, countries=None, cities=None
) -> DataFrame:
    """Sessions that visited an address of the partner, without their visited addresses.

    The visited addresses are exploded and matched by a semi-join, instead of carrying the
    partner's whole address list to every session. The partner's addresses are written
    first: with their size known, a short list is broadcast and only matched rows are
    shuffled, to fold sessions that visited several addresses.
    """
    addresses = materialise(
        for_values(for_values(order_facts, "order_country_code", countries), "order_city_code", cities)
        .filter((F.col("store_name") == partner) & F.col("store_address_id").isNotNull())
        .select("store_address_id")
        .distinct()
    )
    kept = [c for c in sessions.columns if c != "visited_store_address_ids"]
    return (
        sessions.select(*kept, F.explode("visited_store_address_ids").alias("store_address_id"))
        .join(addresses, "store_address_id", "left_semi")
        .select(*kept)
        .distinct()
    )


def _cell_ids(hexagons: DataFrame) -> DataFrame:
    """Ids of the cities' hexagons, written so that their size is known when sessions are filtered."""
    return materialise(hexagons.select(F.col("h3_8_hash").alias("h8_hexagon")).distinct())


def _orders_per_hexagon(
    sessions: DataFrame, checkouts: DataFrame, order_facts: DataFrame, cells: DataFrame
) -> DataFrame:
    here = sessions.select("dynamic_session_id", "h8_hexagon").join(cells, "h8_hexagon", "left_semi")
    return (
        checkouts.select("order_id", "dynamic_session_id")
        .join(here, "dynamic_session_id")
        .join(order_facts.select("order_id"), "order_id", "left_semi")
        .groupBy("h8_hexagon")
        .agg(F.countDistinct("order_id").alias("orders"))
    )


def _demand(
    hexagons: DataFrame,
    session_rows: DataFrame,
    all_sessions: DataFrame,
    checkout_events: DataFrame,
    order_facts: DataFrame,
    cells: DataFrame,
    countries,
    cities,
    partner: str | None,
    orders_scope: str,
    checkouts: DataFrame,
    start: dt.date,
    end: dt.date,
) -> DataFrame:
    reach = dt.timedelta(days=SESSION_DAYS)
    all_sessions = all_sessions.filter(between_days(F.col("session_start_time_local"), start - reach, end + reach))
    checkout_events = checkout_events.filter(F.col("p_creation_date").between(F.lit(start - reach), F.lit(end + reach)))
    own = F.lit(True) if partner is None else F.coalesce(F.col("store_name") == partner, F.lit(False))
    # One row per session, so a session with several checkouts is not repeated by the join.
    per_session = checkout_events.groupBy("dynamic_session_id").agg(
        F.count(F.lit(1)).alias("checkouts"), F.count_if(own).alias("own_checkouts")
    )
    ordered = F.col("count_ce__order_created") > 0
    seen = (
        session_rows.join(cells, "h8_hexagon", "left_semi")
        .join(per_session, "dynamic_session_id", "left")
        .withColumn("rows", F.greatest(F.coalesce("checkouts", F.lit(0)), F.lit(1)))
        .withColumn("hits", F.when(ordered, F.coalesce("own_checkouts", F.lit(0))).otherwise(F.lit(0)))
        .groupBy("h8_hexagon", "dynamic_session_id")
        .agg(F.sum("rows").alias("rows"), F.sum("hits").alias("hits"))
        .groupBy("h8_hexagon")
        .agg(
            F.sum("rows").alias("sessions"),
            (ratio_or_null(F.count_if(F.col("hits") > 0), F.count(F.lit(1))) * 100).alias("cvr_sessions"),
            ratio_or_null(F.sum("hits") * 100, F.sum("rows")).alias("cvr_rows"),
        )
    )
    facts = for_values(for_values(order_facts, "order_country_code", countries), "order_city_code", cities)
    facts = facts.filter(delivered())
    if partner is not None and orders_scope == "partner":
        facts = facts.filter(F.col("store_name") == partner)
    orders = _orders_per_hexagon(all_sessions, checkouts, facts, cells)
    return (
        hexagons.select(
            F.col("h3_8_hash").alias("h8_hexagon"),
            F.col("h3_8_polygon_wkt").alias("h3_geom"),
            F.col("h3_8_center_lat").alias("h3_8_lat"),
            F.col("h3_8_center_lon").alias("h3_8_lon"),
        )
        .distinct()
        .join(orders, "h8_hexagon", "left")
        .join(seen, "h8_hexagon", "left")
    )


def hex_demand_partner(
    hexagons: DataFrame,
    sessions: DataFrame,
    checkout_events: DataFrame,
    order_facts: DataFrame,
    partner: str,
    start: dt.date,
    end: dt.date,
    countries: Iterable[str] | None = None,
    cities: Iterable[str] | None = None,
    inclusive_end: bool = True,
    orders_scope: str = "all",
) -> DataFrame:
    """Per hexagon: sessions that saw the partner, their conversion at the partner, orders.

    ``sessions`` counts session and checkout pairs; ``cvr_sessions`` divides distinct
    sessions, ``cvr_rows`` divides pairs. ``orders`` counts orders of every store, or of
    the partner with ``orders_scope="partner"``. Sessions and checkouts are read from
    ``SESSION_DAYS`` before the window to as many after it.
    """
    cells_here = for_values(hexagons, "city_code", cities)
    cells = _cell_ids(cells_here)
    in_scope = for_values(for_values(sessions, "country_code", countries), "city_code", cities).filter(
        between_days(F.col("session_start_time_local"), start, end, inclusive_end)
    )
    seen = sessions_at_partner(in_scope, order_facts, partner, countries, cities)
    window = F.col("p_creation_date").between(F.lit(start), F.lit(end))
    return _demand(
        cells_here, seen, sessions, checkout_events, order_facts, cells, countries, cities,
        partner, orders_scope, checkout_events.filter(window), start, end,
    )


def hex_demand_city(
    hexagons: DataFrame,
    sessions: DataFrame,
    checkout_events: DataFrame,
    order_facts: DataFrame,
    start: dt.date,
    end: dt.date,
    countries: Iterable[str] | None = None,
    cities: Iterable[str] | None = None,
    inclusive_end: bool = True,
) -> DataFrame:
    """Per hexagon: all sessions, their conversion, and orders checked out in the cities."""
    cells_here = for_values(hexagons, "city_code", cities)
    cells = _cell_ids(cells_here)
    in_scope = for_values(for_values(sessions, "country_code", countries), "city_code", cities).filter(
        between_days(F.col("session_start_time_local"), start, end, inclusive_end)
    )
    window = F.col("p_creation_date").between(F.lit(start), F.lit(end))
    placed = for_values(for_values(checkout_events, "country", countries), "city", cities).filter(window)
    return _demand(
        cells_here, in_scope, sessions, checkout_events, order_facts, cells, countries, cities,
        None, "all", placed, start, end,
    )


def store_radii(
    store_addresses: DataFrame,
    stores: DataFrame,
    hexagons: DataFrame,
    partner: str | None = None,
    cities: Iterable[str] | None = None,
) -> DataFrame:
    """Open addresses of enabled stores with hexagon centre, polygon and delivery radius.

    The address's own radius counts first, else that of its store.
    """
    open_stores = for_values(current_rows(stores).filter("store_is_enabled"), "city_code", cities)
    if partner is not None:
        open_stores = open_stores.filter(F.col("store_name") == partner)
    addresses = current_rows(store_addresses).filter(~F.col("store_address_is_deleted"))
    places = hexagons.select(
        F.col("h3_8_hash").alias("h3_hash_8"),
        F.col("h3_8_center_lat").alias("h3_8_lat"),
        F.col("h3_8_center_lon").alias("h3_8_lon"),
        F.col("h3_8_polygon_wkt").alias("h3_geom"),
    ).distinct()
    return (
        addresses.join(open_stores.select("store_id", "store_name", "store_maximum_delivery_distance"), "store_id")
        .join(places, "h3_hash_8", "left")
        .select(
            "store_name",
            "store_address_id",
            "h3_hash_8",
            "h3_8_lat",
            "h3_8_lon",
            "h3_geom",
            F.coalesce(
                "store_address_maximum_delivery_distance_meters", "store_maximum_delivery_distance"
            ).alias("radius_m"),
        )
        .distinct()
    )


def map_centre(hexes: DataFrame) -> DataFrame:
    """Mean of the centres of hexagons that have a polygon."""
    return hexes.filter(F.col("h3_geom").isNotNull()).agg(
        F.avg("h3_8_lat").alias("lat"), F.avg("h3_8_lon").alias("lon")
    )


def hex_feed(hexes: DataFrame, metric: str, partner: str | None = None) -> DataFrame:
    """One map feature per hexagon with a polygon: geometry, fill colour and text.

    ``hexes`` carries the metric and its density bucket; the colours are those of the
    buckets that occur. With ``partner`` the features carry the partner's name.
    """
    shown = bucket_colour(hexes.filter(F.col("h3_geom").isNotNull()), metric)
    text = F.concat(
        F.lit("Hexagon: "), F.col("h8_hexagon"), F.lit(f"; {metric}: "), F.format_string("%.2f", F.col(metric).cast("double"))
    )
    return shown.select(
        *([F.lit(partner).alias("partner")] if partner is not None else []),
        F.lit(metric).alias("metric"),
        "h8_hexagon",
        wkt_geojson(F.col("h3_geom")).alias("geometry"),
        F.col(f"{metric}_colour").alias("fill_colour"),
        text.alias("label"),
    )


def unreadable_areas(hexes: DataFrame) -> DataFrame:
    """Hexagons whose polygon text cannot be read, with the reason: a feed shows them without geometry."""
    return hexes.select("h8_hexagon", "h3_geom", wkt_problem(F.col("h3_geom")).alias("problem")).filter("problem IS NOT NULL")


def store_points(radii: DataFrame) -> DataFrame:
    """Markers and radii of stores whose hexagon centre is known."""
    return radii.dropna(subset=["h3_8_lat", "h3_8_lon"]).select(
        "store_name", "store_address_id", "h3_8_lat", "h3_8_lon", "radius_m"
    )


def _cell(x: Column, edge: Column) -> Column:
    return F.floor(x / edge).cast("long")


def _circles(stores: DataFrame) -> DataFrame:
    """Stores folded to distinct circles, each with its level and the cells it may reach into.

    Equal circles are one row with a count, so a hexagon full of stores is matched once. Cells are cubes
    around the centre of the Earth, whose edge halves from level to level; on the ground they are patches
    without seam, pole or meridian. A circle is all that lies within a chord of its centre. Its level is
    the finest whose cells are two chords wide, so it reaches into two cells at most along each axis.
    """
    circles = (
        stores.dropna(subset=["h3_8_lat", "h3_8_lon", "radius_m"])
        .groupBy(F.col("h3_8_lat").alias("lat"), F.col("h3_8_lon").alias("lon"), "radius_m")
        .agg(F.count(F.lit(1)).alias("stores_here"))
        .filter("radius_m >= 0")
    )
    half_angle = F.least(F.col("radius_m") / (2 * EARTH_RADIUS_M), F.lit(math.pi / 2))
    # The margin covers rounding.
    chord = 2 * F.sin(half_angle) * 1.001 + 1e-9
    level = F.least(F.greatest(F.floor(F.log2(F.lit(COARSEST) / (2 * chord))), F.lit(0)), F.lit(FINEST)).cast("int")
    placed = circles.withColumn("level", level)
    edge = F.lit(COARSEST) / F.pow(F.lit(2.0), F.col("level"))
    for name, centre in zip(CELL, unit_vector(F.col("lat"), F.col("lon")), strict=True):
        placed = placed.withColumn(name, F.explode(F.sequence(_cell(centre - chord, edge), _cell(centre + chord, edge))))
    return placed


def covered_pairs(hexes: DataFrame, stores: DataFrame) -> DataFrame:
    """Hexagons inside each distinct store circle; ``stores_here`` tells how many stores share it.

    Both sides meet on a cell of a level chosen by the radius, then the exact distance decides. The
    circles of a cell are shared out among ``CELL_SALTS`` tasks, as a dense cell may hold most of
    them; the hexagons, bounded by the cell's area, are copied to each.
    """
    salt = F.pmod(F.xxhash64("lat", "lon", "radius_m"), F.lit(CELL_SALTS)).cast("int")
    circles = _circles(stores).withColumn("salt", salt)
    # At most FINEST + 1 numbers.
    levels = [r.level for r in circles.select("level").distinct().collect()]
    centres = hexes.dropna(subset=["h3_8_lat", "h3_8_lon"])
    edge = F.lit(COARSEST) / F.pow(F.lit(2.0), F.col("level"))
    levelled = centres.withColumn("level", F.explode(F.array(*[F.lit(z) for z in levels or [0]]).cast("array<int>")))
    at = zip(CELL, unit_vector(F.col("h3_8_lat"), F.col("h3_8_lon")), strict=True)
    placed = levelled.withColumns({name: _cell(x, edge) for name, x in at})
    placed = placed.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(CELL_SALTS - 1))))
    distance = haversine_m(F.col("h3_8_lat"), F.col("h3_8_lon"), F.col("lat"), F.col("lon"))
    keys = ["level", *CELL, "salt"]
    return placed.join(circles, keys).filter(distance <= F.col("radius_m")).drop(*keys)


def hexagon_coverage(hexes: DataFrame, stores: DataFrame) -> DataFrame:
    """Every hexagon with the number of stores that reach its centre."""
    reached = (
        covered_pairs(hexes.select("h8_hexagon", "h3_8_lat", "h3_8_lon"), stores)
        .groupBy("h8_hexagon")
        .agg(F.sum("stores_here").alias("n_stores"))
    )
    return hexes.join(reached, "h8_hexagon", "left").withColumn(
        "n_stores", F.coalesce("n_stores", F.lit(0).cast("long"))
    )


def store_coverage(hexes: DataFrame, stores: DataFrame, demand: str = "sessions") -> DataFrame:
    """Every located store with the hexagons its circle reaches and the demand inside."""
    circle = ["lat", "lon", "radius_m"]
    reached = (
        covered_pairs(hexes.select("h8_hexagon", "h3_8_lat", "h3_8_lon", demand), stores)
        .groupBy(*circle)
        .agg(F.count(F.lit(1)).alias("n_hexagons"), F.sum(demand).alias("covered_demand"))
    )
    located = stores.dropna(subset=["h3_8_lat", "h3_8_lon"]).select(
        "store_address_id", F.col("h3_8_lat").alias("lat"), F.col("h3_8_lon").alias("lon"), "radius_m"
    )
    return located.join(reached, circle, "left").select(
        "store_address_id",
        "radius_m",
        F.coalesce("n_hexagons", F.lit(0).cast("long")).alias("n_hexagons"),
        F.coalesce("covered_demand", F.lit(0)).alias("covered_demand"),
    )

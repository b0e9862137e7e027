import datetime as dt
import math
import random

from pyspark.sql import functions as F

from orderloom.operators import hexes
from orderloom.schemas import SCHEMAS
from tests.test_orders import T, fact, facts

START, END = dt.date(2024, 1, 1), dt.date(2024, 1, 31)


def table(spark, name, rows):
    return spark.createDataFrame(rows, SCHEMAS[name])


def sample(spark):
    cells = table(spark, "hexagons", [("X", "h1", 40.0, 20.0, "POLYGON ((0 0, 1 0, 1 1, 0 0))"), ("X", "h2", 40.1, 20.0, None), ("Y", "h3", 50.0, 20.0, None)])
    sessions = table(
        spark,
        "sessions",
        [
            ("a", "h1", "A", "X", T(2024, 1, 5), [1, 7], 1),
            ("b", "h1", "A", "X", T(2024, 1, 31, 10), [1], 0),
            ("c", "h1", "A", "X", T(2024, 1, 6), [7], 1),
            ("d", "h2", "A", "X", T(2024, 1, 6), [None, 2], 1),
            ("e", "h2", "A", "X", T(2024, 1, 6), [], 0),
            ("f", "h3", "A", "Y", T(2024, 1, 6), [1], 1),
            ("g", "h1", "A", "X", T(2024, 2, 1), [1], 1),
        ],
    )
    events = table(
        spark,
        "checkout_events",
        [
            (1, "a", "p", "A", "X", dt.date(2024, 1, 5)),
            (2, "a", "p", "A", "X", dt.date(2024, 1, 5)),
            (3, "c", "q", "A", "X", dt.date(2024, 1, 6)),
            (4, "d", "q", "A", "X", dt.date(2024, 1, 6)),
            (5, "f", "p", "A", "Y", dt.date(2024, 1, 6)),
            (6, "g", "p", "A", "X", dt.date(2024, 2, 1)),
        ],
    )
    rows = [fact(i, 1, T(2024, 1, 5), store_name="p" if i in (1, 2) else "q", store_address_id=1 if i == 1 else 2 if i == 2 else 7) for i in range(1, 7)]
    rows[3]["order_final_status"] = "CanceledStatus"
    return cells, sessions, events, facts(spark, rows)


def test_partner_demand(spark):
    got = {r.h8_hexagon: r for r in hexes.hex_demand_partner(*sample(spark), "p", START, END, ["A"], ["X"]).collect()}
    assert set(got) == {"h1", "h2"}
    # h1: session a twice (two checkouts) and b; c never saw the partner.
    assert (got["h1"].sessions, got["h1"].orders) == (3, 3)
    assert got["h1"].cvr_sessions == 50.0 and abs(got["h1"].cvr_rows - 200 / 3) < 1e-9
    assert (got["h2"].sessions, got["h2"].orders, got["h2"].cvr_rows) == (1, None, 0.0)


def test_partner_demand_counts_partner_orders_on_request(spark):
    got = hexes.hex_demand_partner(*sample(spark), "p", START, END, ["A"], ["X"], orders_scope="partner")
    assert {r.h8_hexagon: r.orders for r in got.collect()} == {"h1": 2, "h2": None}


def test_city_demand_and_raw_end(spark):
    got = {r.h8_hexagon: r for r in hexes.hex_demand_city(*sample(spark), START, END, ["A"], ["X"]).collect()}
    assert (got["h1"].sessions, got["h2"].sessions) == (4, 2)
    assert got["h1"].cvr_rows == 75.0 and got["h2"].cvr_rows == 50.0
    raw = hexes.hex_demand_city(*sample(spark), START, END, ["A"], ["X"], inclusive_end=False)
    assert {r.h8_hexagon: r.sessions for r in raw.collect()}["h1"] == 3


def test_store_radii(spark):
    cells = sample(spark)[0]
    addresses = table(
        spark,
        "store_addresses",
        [(1, 1, "h1", 500.0, False, None), (2, 1, "h1", None, False, None), (3, 1, "h9", 1.0, False, None), (4, 1, "h1", 1.0, True, None), (5, 1, "h1", 1.0, False, END), (6, 2, "h1", 1.0, False, None), (7, 3, "h1", None, False, None)],
    )
    stores = table(
        spark,
        "stores",
        [(1, "p", "X", True, 900.0, None), (1, "p", "X", True, 1.0, END), (2, "p", "X", False, 1.0, None), (3, "r", "X", True, None, None)],
    )
    got = {r.store_address_id: r.radius_m for r in hexes.store_radii(addresses, stores, cells, "p", ["X"]).collect()}
    assert got == {1: 500.0, 2: 900.0, 3: 1.0}
    every = hexes.store_radii(addresses, stores, cells)
    assert {r.store_address_id for r in hexes.store_points(every).collect()} == {1, 2, 7}


def haversine(lat1, lon1, lat2, lon2):
    a = math.sin(math.radians(lat2 - lat1) / 2) ** 2 + math.cos(math.radians(lat1)) * math.cos(math.radians(lat2)) * math.sin(math.radians(lon2 - lon1) / 2) ** 2
    return 2 * 6371008.8 * math.asin(math.sqrt(a))


def test_coverage_against_brute_force(spark):
    rng = random.Random(5)
    cells = [(f"h{i}", rng.uniform(-80, 80) if i % 3 else 60 + rng.uniform(-0.1, 0.1), 10 + rng.uniform(-0.2, 0.2), i) for i in range(300)]
    cells.append(("h_none", None, None, 5))
    places = [(i, rng.choice(cells[:300]), rng.choice([0.0, 50.0, 900.0, 5000.0, 40000.0, 2e6])) for i in range(60)]
    stores = [("s", i, c[0], c[1], c[2], None, r) for i, c, r in places] + [("s", 99, "x", None, None, None, 10.0), ("s", 98, "x", 1.0, 1.0, None, None)]
    hexagons = spark.createDataFrame(cells, "h8_hexagon string, h3_8_lat double, h3_8_lon double, sessions bigint")
    radii = spark.createDataFrame(stores, "store_name string, store_address_id int, h3_hash_8 string, h3_8_lat double, h3_8_lon double, h3_geom string, radius_m double")
    per_hex = {r.h8_hexagon: r.n_stores for r in hexes.hexagon_coverage(hexagons, radii).collect()}
    per_store = {r.store_address_id: (r.n_hexagons, r.covered_demand) for r in hexes.store_coverage(hexagons, radii).collect()}
    assert len(per_hex) == 301 and per_hex["h_none"] == 0 and set(per_store) == {*range(60), 98}
    for name, lat, lon, _ in cells[:300]:
        assert per_hex[name] == sum(haversine(lat, lon, c[1], c[2]) <= r for _, c, r in places)
    for i, c, r in places:
        inside = [x[3] for x in cells[:300] if haversine(x[1], x[2], c[1], c[2]) <= r]
        assert per_store[i] == (len(inside), sum(inside))


def test_coverage_across_the_180th_meridian(spark):
    cells = spark.createDataFrame([("h", 0.0, -179.99)], "h8_hexagon string, h3_8_lat double, h3_8_lon double")
    stores = spark.createDataFrame([(0.0, 179.99, 5000.0)], "h3_8_lat double, h3_8_lon double, radius_m double")
    assert hexes.covered_pairs(cells, stores).count() == 1


def test_coverage_over_the_poles_and_any_circle(spark):
    """Circles from nothing to the whole globe, crowded at both poles and along the 180th meridian."""
    rng = random.Random(11)

    def place():
        kind = rng.randrange(4)
        if kind == 0:
            return rng.choice([-1, 1]) * (90 - rng.random() ** 3), rng.uniform(-180, 180)
        if kind == 1:
            return rng.uniform(-90, 90), rng.choice([-1, 1]) * (180 - rng.random() ** 3)
        return math.degrees(math.asin(rng.uniform(-1, 1))), rng.uniform(-180, 180)

    cells = [(f"h{i}", *place()) for i in range(400)] + [("n", 90.0, 0.0), ("n2", 90.0, 77.0), ("s", -90.0, -180.0), ("e", 0.0, 180.0), ("w", 0.0, -180.0)]
    circles = [(i, *(rng.choice(cells)[1:] if i % 3 else place()), rng.choice([0.0, 1.0, 30.0, 3e3, 5e4, 6e5, 4e6, 1.2e7, 2.01e7, 5e7])) for i in range(150)]
    circles += [(900, 89.99, 90.0, 5000.0), (901, 90.0, 12.0, 0.0), (902, 0.0, 180.0, 10.0), (903, 1.0, 1.0, -5.0)]
    cells.append(("x", 89.995, -90.0))
    hexagons = spark.createDataFrame([(*c, 1) for c in cells], "h8_hexagon string, h3_8_lat double, h3_8_lon double, sessions long").repartition(3)
    stores = spark.createDataFrame(circles, "store_address_id int, h3_8_lat double, h3_8_lon double, radius_m double")
    got = {r.store_address_id: r.n_hexagons for r in hexes.store_coverage(hexagons, stores).collect()}
    # Points within a billionth of the limit may fall on either side.
    for i, lat, lon, radius in circles:
        away = [haversine(lat, lon, c[1], c[2]) for c in cells]
        assert sum(d <= radius * (1 - 1e-9) - 1e-6 for d in away) <= got[i] <= sum(d <= radius * (1 + 1e-9) + 1e-6 for d in away)
    assert got[900] >= 1 and {r.n_stores for r in hexes.hexagon_coverage(hexagons.filter("h8_hexagon = 'x'"), stores.filter("store_address_id = 900")).collect()} == {1}
    reach = hexes._circles(stores).groupBy("lat", "lon", "radius_m").count()
    assert reach.agg(F.max("count")).first()[0] <= 8


def test_unreadable_areas_are_told(spark):
    rows = [("a", "POLYGON ((0 0, 1 0, 1 1, 0 0))"), ("b", "POLYGON ((0 0, 1 0"), ("c", None), ("d", "POINT (1 2)"), ("e", "POLYGON ((0 x, 1 0))")]
    cells = spark.createDataFrame(rows, "h8_hexagon string, h3_geom string")
    assert {(r.h8_hexagon, r.problem) for r in hexes.unreadable_areas(cells).collect()} == {("b", "brackets"), ("d", "type"), ("e", "number")}


def test_demand_reads_only_around_its_window(spark):
    old = dt.date(2019, 1, 5)
    cells, sessions, events, orders = sample(spark)
    sessions = sessions.union(table(spark, "sessions", [("old", "h1", "A", "X", T(2019, 1, 5), [1], 1)]))
    events = events.union(table(spark, "checkout_events", [(1, "old", "p", "A", "X", old)]))
    got = hexes.hex_demand_city(cells, sessions, events, orders, START, END, ["A"], ["X"])
    scans = got._jdf.queryExecution().optimizedPlan().toString()
    assert scans.count("session_start_time_local") and scans.count("2023-12-25") >= 2
    assert {r.h8_hexagon: r.sessions for r in got.collect()} == {"h1": 4, "h2": 2}


def test_dense_tile_is_shared_out(spark):
    cells = spark.createDataFrame([("h", 10.0, 10.0)], "h8_hexagon string, h3_8_lat double, h3_8_lon double")
    stores = spark.range(200).selectExpr("id AS store_address_id", "10.0D AS h3_8_lat", "10.0D AS h3_8_lon", "500.0D + id AS radius_m")
    pairs = hexes.covered_pairs(cells, stores)
    assert pairs.count() == 200
    circles = hexes._circles(stores)
    assert circles.select(*hexes.CELL, "level").distinct().count() < circles.count()


def test_feed_of_a_partner(spark):
    rows = [("h1", "POLYGON ((0 0, 1 0, 1 1, 0 0))", 5.0, "0 - 9"), ("h2", None, 1.0, "0 - 9")]
    marked = spark.createDataFrame(rows, "h8_hexagon string, h3_geom string, orders double, orders_bucket string")
    feed = hexes.hex_feed(marked, "orders", "p").collect()
    assert [(r.partner, r.metric, r.h8_hexagon) for r in feed] == [("p", "orders", "h1")]

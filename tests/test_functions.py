import datetime as dt

import pytest
from pyspark.sql import functions as F

from orderloom.functions import dates, geo, numbers, text


def column(spark, rows, schema, expression):
    return [r[0] for r in spark.createDataFrame(rows, schema).select(expression).collect()]


T = dt.datetime


@pytest.mark.parametrize(
    "start, end, months",
    [
        (T(2024, 1, 31), T(2024, 2, 29), 1),
        (T(2024, 1, 30), T(2024, 2, 29), 1),
        (T(2024, 1, 15, 12), T(2024, 2, 15, 11), 0),
        (T(2024, 1, 15, 12), T(2024, 2, 15, 12), 1),
        (T(2024, 1, 15), T(2024, 1, 31), 0),
        (T(2023, 2, 28), T(2024, 2, 28), 12),
        (T(2024, 3, 31), T(2024, 4, 29), 0),
        (T(2024, 2, 15), T(2024, 1, 15), -1),
        (T(2024, 2, 15), T(2024, 1, 16), 0),
        (T(2024, 5, 5), T(2024, 5, 5), 0),
    ],
)
def test_full_months(spark, start, end, months):
    got = column(spark, [(start, end)], "a timestamp_ntz, b timestamp_ntz", dates.full_months(F.col("a"), F.col("b")))
    assert got == [months]


def test_window_starts():
    as_of = dt.date(2024, 3, 31)
    assert dates.last_year_start(as_of) == dt.date(2023, 1, 1)
    assert dates.months_back_start(as_of, 24) == dt.date(2022, 3, 1)
    assert dates.months_back_start(dt.date(2024, 1, 5), 1) == dt.date(2023, 12, 1)
    assert dates.days_back(as_of, 90) == dt.date(2024, 1, 1)


def test_range_end_is_inclusive_or_raw(spark):
    rows = [(T(2025, 3, 31),), (T(2025, 3, 31, 0, 0, 1),), (T(2025, 4, 1),), (T(2025, 1, 1),)]
    a, b = dt.date(2025, 1, 1), dt.date(2025, 3, 31)
    t = F.col("t")
    assert column(spark, rows, "t timestamp_ntz", dates.between_days(t, a, b)) == [True, True, False, True]
    raw = dates.between_days(t, a, b, inclusive_end=False)
    assert column(spark, rows, "t timestamp_ntz", raw) == [True, False, False, True]


def test_week_days(spark):
    rows = [(dt.date(2024, 1, 1 + i),) for i in range(7)]
    assert column(spark, rows, "d date", dates.week_day(F.col("d"), "iso")) == [1, 2, 3, 4, 5, 6, 7]
    assert column(spark, rows, "d date", dates.week_day(F.col("d"))) == [2, 3, 4, 5, 6, 7, 1]
    with pytest.raises(ValueError):
        dates.week_day(F.col("d"), "other")


def test_day_parts_cover_the_day(spark):
    rows = [(T(2024, 1, 1, h),) for h in range(24)]
    parts = column(spark, rows, "t timestamp_ntz", dates.day_part(F.col("t")))
    assert parts == ["night"] * 7 + ["morning"] * 6 + ["afternoon"] * 6 + ["evening"] * 5


def test_ratios(spark):
    rows = [(6.0, 3.0), (1.0, 0.0), (0.0, 0.0), (None, 2.0), (1.0, None)]
    n, d = F.col("n"), F.col("d")
    assert column(spark, rows, "n double, d double", numbers.ratio_or_zero(n, d)) == [2.0, 0.0, 0.0, None, 0.0]
    assert column(spark, rows, "n double, d double", numbers.ratio_or_null(n, d)) == [2.0, None, None, None, None]


def test_number_hygiene(spark):
    rows = [("3.5",), ("x",), (None,), ("1e2",)]
    assert column(spark, rows, "s string", numbers.number_or_zero(F.col("s"))) == [3.5, 0.0, 0.0, 100.0]
    df = spark.createDataFrame([(1, float("nan")), (2, float("inf")), (3, None), (4, 1.5)], "k int, v double")
    assert [r.v for r in numbers.finite_columns(df).orderBy("k").collect()] == [None, None, None, 1.5]
    assert [r.v for r in numbers.blank_columns(df).orderBy("k").collect()] == ["", "", "", "1.5"]


def test_stable_round_removes_noise(spark):
    rows = [(2.675,), (1.0049999999999999,), (-2.345,)]
    assert column(spark, rows, "v double", numbers.stable_round(F.col("v"))) == [2.68, 1.01, -2.35]
    assert column(spark, [(0.1 + 0.2,)], "v double", numbers.stable_round(F.col("v"), 2)) == [0.3]


def test_keyword_match_in_four_scripts(spark):
    rows = [("КОКА-КОЛА",), ("Zimna LEMONIADA",), ("ბურგერი და კოლა",), ("ԿՈԿԱԿՈԼԱ",), ("хачапури",), (None,)]
    words = ("кола", "Lemoniada", "კოლა", "կոկա")
    assert column(spark, rows, "s string", text.contains_any("s", words)) == [True] * 4 + [False] * 2
    assert column(spark, rows, "s string", text.matches_any(F.col("s"), words)) == [True] * 4 + [False] * 2


def test_normalised_names(spark):
    cases = {
        "Кока-Кола 500 мл": "cocacola",
        "Coca-Cola 500 ml": "cocacola",
        "  FANTA 0.5 l ": "fanta",
        "Pepsi 1l (zero)": "pepsizero",
        "Кока Кола": "cocacola",
        "Щедрик 'Сок' 330ml": "shchedriksok",
        "Oranżada \"Łódź\", 2 g": "oranzadalodz",
        "კოკა კოლა": "cocacola",
        "կոկակոլա": "cocacola",
    }
    got = column(spark, [(k,) for k in cases], "s string", text.normalise_name(F.col("s")))
    assert got == list(cases.values())
    assert column(spark, [(None,)], "s string", text.normalise_name(F.col("s"))) == [None]


def test_labels(spark):
    rows = [(3.9, 12.7), (-3.9, 0.2), (None, 1.0)]
    lo, hi = F.col("lo"), F.col("hi")
    assert column(spark, rows, "lo double, hi double", text.range_label(lo, hi)) == ["3 - 12", "-3 - 0", None]
    labels = [("3 - 12",), (">40",), ("0 - 0_dup",), ("none",), (None,)]
    assert column(spark, labels, "s string", text.upper_limit(F.col("s"))) == [12, 41, 0, None, None]


def test_h3_parent(spark):
    rows = [("881f1d4887fffff",), ("871f1d488ffffff",), (None,), ("881F1D4887FFFFF",)]
    parent = geo.h3_text(geo.h3_parent(geo.h3_to_long(F.col("h")), 7))
    assert column(spark, rows, "h string", parent) == ["871f1d488ffffff", "871f1d488ffffff", None, "871f1d488ffffff"]
    coarse = geo.h3_parent(geo.h3_to_long(F.col("h")), 8)
    assert column(spark, [("871f1d488ffffff",)], "h string", coarse) == [None]


def test_wkt(spark):
    rows = [
        ("POLYGON ((1 2, 3.5 -4, 1 2))",),
        ("polygon((  -1.25   2 ,3 4,-1.25 2 ))",),
        (None,),
        ("POINT (1 2)",),
        ("POLYGON ((0 0, 4 0, 4 4, 0 0), (1 1, 2 1, 2 2, 1 1))",),
    ]
    rings = column(spark, rows, "w string", geo.wkt_ring(F.col("w")))
    assert [(p.lon, p.lat) for p in rings[0]] == [(1.0, 2.0), (3.5, -4.0), (1.0, 2.0)]
    assert [(p.lon, p.lat) for p in rings[1]] == [(-1.25, 2.0), (3.0, 4.0), (-1.25, 2.0)]
    assert rings[2] is None and rings[3] is None and len(rings[4]) == 4
    shown = column(spark, rows, "w string", geo.ring_geojson(geo.wkt_ring(F.col("w"))))
    assert shown[0] == '{"type":"Polygon","coordinates":[[[1.0,2.0],[3.5,-4.0],[1.0,2.0]]]}' and shown[2] is None


def test_whole_areas(spark):
    """Holes, several polygons, heights, measures, empty parts; and texts that cannot be read."""
    rows = [
        ("POLYGON ((0 0, 4 0, 4 4, 0 0), (1 1, 2 1, 2 2, 1 1))", '{"type":"Polygon","coordinates":[[[0.0,0.0],[4.0,0.0],[4.0,4.0],[0.0,0.0]],[[1.0,1.0],[2.0,1.0],[2.0,2.0],[1.0,1.0]]]}', None),
        ("MultiPolygon(((0 0,1 0,1 1,0 0)),((5 5,6 5,6 6,5 5),(5.5 5.1,5.6 5.1,5.6 5.2,5.5 5.1)))", '{"type":"MultiPolygon","coordinates":[[[[0.0,0.0],[1.0,0.0],[1.0,1.0],[0.0,0.0]]],[[[5.0,5.0],[6.0,5.0],[6.0,6.0],[5.0,5.0]],[[5.5,5.1],[5.6,5.1],[5.6,5.2],[5.5,5.1]]]]}', None),
        ("POLYGON Z ((0 0 7, 1 0 8.5, 1 1 -9, 0 0 7))", '{"type":"Polygon","coordinates":[[[0.0,0.0,7.0],[1.0,0.0,8.5],[1.0,1.0,-9.0],[0.0,0.0,7.0]]]}', None),
        (" SRID=4326; POLYGONZM((0 0 7 1, 1 0 8 2, 1 1 9 3, 0 0 7 1))", '{"type":"Polygon","coordinates":[[[0.0,0.0,7.0],[1.0,0.0,8.0],[1.0,1.0,9.0],[0.0,0.0,7.0]]]}', None),
        ("POLYGON M ((0 0 7, +1 .5 8, 1e0 -1.5E0 9, 0 0 7))", '{"type":"Polygon","coordinates":[[[0.0,0.0],[1.0,0.5],[1.0,-1.5],[0.0,0.0]]]}', None),
        ("POLYGON EMPTY", '{"type":"Polygon","coordinates":[]}', None),
        ("MULTIPOLYGON EMPTY", '{"type":"MultiPolygon","coordinates":[]}', None),
        ("MULTIPOLYGON (EMPTY, ((0 0, 1 0, 1 1, 0 0)))", '{"type":"MultiPolygon","coordinates":[[[[0.0,0.0],[1.0,0.0],[1.0,1.0],[0.0,0.0]]]]}', None),
        (None, None, None),
        ("POLYGON ((0 0, 1 0, 1 1, 0 0)", None, "brackets"),
        ("POLYGON ((0 0, 1 0, 1 1, 0 0)))", None, "brackets"),
        ("POLYGON ((0 0, 1 0, 1 1, 0 0)) and more", None, "brackets"),
        ("POLYGON ((0 0, 1 0, 1 1, 0 0)))) ((", None, "brackets"),
        ("POLYGON (0 0, 1 0, 1 1, 0 0)", None, "brackets"),
        ("POLYGON ((0 0, 1 0)), ((2 2, 3 3))", None, "brackets"),
        ("MULTIPOLYGON ((0 0, 1 0, 1 1, 0 0))", None, "brackets"),
        ("POLYGON (((0 0, 1 0, 1 1, 0 0)))", None, "number"),
        ("POLYGON ((0 0, 1 O, 1 1, 0 0))", None, "number"),
        ("POLYGON ((0, 1 0, 1 1, 0 0))", None, "number"),
        ("POLYGON ((0 0 1 2 3, 1 0, 1 1, 0 0))", None, "number"),
        ("POLYGON ((0 0 NaN, 1 0 1, 1 1 1, 0 0 1))", None, "number"),
        ("LINESTRING (0 0, 1 1)", None, "type"),
        ("GEOMETRYCOLLECTION (POLYGON ((0 0, 1 0, 1 1, 0 0)))", None, "type"),
        ("", None, "type"),
    ]
    given = [(w,) for w, _, _ in rows]
    assert column(spark, given, "w string", geo.wkt_geojson(F.col("w"))) == [g for _, g, _ in rows]
    problems = column(spark, given, "w string", geo.wkt_problem(F.col("w")))
    assert [p is not None for p in problems] == [p is not None for _, _, p in rows]
    assert [p for p, (_, _, want) in zip(problems, rows) if want == "type"] == ["type"] * 3
    points = column(spark, given[2:3], "w string", geo.wkt_polygons(F.col("w")))[0]
    assert [(p.lon, p.lat, p.alt) for p in points[0][0]] == [(0.0, 0.0, 7.0), (1.0, 0.0, 8.5), (1.0, 1.0, -9.0), (0.0, 0.0, 7.0)]


def test_array_overlap_with_nulls(spark):
    rows = [([1, 2], [2]), ([], [2]), ([None, 1], [2, None]), ([1], [2]), (None, [1]), ([None, 5], [5])]
    got = column(spark, rows, "a array<bigint>, b array<bigint>", geo.shares_element(F.col("a"), F.col("b")))
    assert got == [True, False, True, False, False, True]


def test_haversine(spark):
    d = column(spark, [(0.0,)], "x double", geo.haversine_m(F.lit(0.0), F.lit(0.0), F.lit(0.0), F.lit(1.0)))[0]
    assert abs(d - 111195) < 1


def test_full_months_keeps_the_clock_at_month_end(spark):
    rows = [(dt.datetime(2020, 1, 31, 12), dt.datetime(2020, 2, 29)), (dt.datetime(2020, 1, 31, 12), dt.datetime(2020, 2, 29, 12))]
    assert column(spark, rows, "a timestamp_ntz, b timestamp_ntz", dates.full_months(F.col("a"), F.col("b"))) == [0, 1]


def test_nan_becomes_zero(spark):
    rows = [("NaN",), ("2",)]
    assert column(spark, rows, "s string", numbers.number_or_zero(F.col("s"))) == [0.0, 2.0]


def test_latin_letters_lose_their_marks(spark):
    """Literal spellings, apart from the library's own tables."""
    df = spark.createDataFrame(
        [("Café Crème",), ("Straße",), ("Żubr ŁÓDŹ",), ("Crème Brûlée 100 ml",), ("Ærø Çay",), ("Кока-кола",), ("Čučoriedka",)], "n string"
    )
    got = [r[0] for r in df.select(text.normalise_name(F.col("n"))).collect()]
    assert got == ["cafecreme", "strasse", "zubrlodz", "cremebrulee", "aerocay", "cocacola", "cucoriedka"]

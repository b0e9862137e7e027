import datetime as dt

import pytest
from pyspark.sql import functions as F

from orderloom.operators import orders, profile
from orderloom.schemas import SCHEMAS, check

AS_OF = dt.date(2024, 6, 30)
FOOD, QC = "Food", "QCommerce"


NETWORKS = {"google_installs": "Google Ads*", "apple_installs": "Apple Search Ads", "tiktok_installs": "Tiktok*"}


def fact(order, customer, when, **other):
    row = {
        "order_id": order, "customer_id": customer, "order_country_code": "A", "order_city_code": "X",
        "order_activated_local_at": when, "order_final_status": "DeliveredStatus",
        "order_parent_relationship_type": None, "order_is_first_delivered_order": False,
        "order_is_prime": False, "order_vertical": FOOD, "order_transacted_value_eur": 10.0,
        "order_transacted_value_local": 40.0, "store_name": "s1", "store_id": 1, "store_address_id": 1,
    }
    return {**row, **other}


def facts(spark, rows):
    schema = SCHEMAS["order_facts"]
    return spark.createDataFrame([tuple(r[f.name] for f in schema.fields) for r in rows], schema)


def pnl(spark, rows):
    schema = SCHEMAS["order_pnl"]
    full = [{f.name: 0.0 for f in schema.fields} | r for r in rows]
    return spark.createDataFrame([tuple(r[f.name] for f in schema.fields) for r in full], schema)


T = dt.datetime


@pytest.fixture(scope="module")
def sample(spark):
    return facts(
        spark,
        [
            fact(1, 1, T(2023, 1, 1), order_is_first_delivered_order=True),
            fact(2, 1, T(2024, 6, 30, 23), order_vertical=QC, order_transacted_value_eur=20.0),
            fact(2, 1, T(2024, 6, 30, 23), order_vertical=QC, order_transacted_value_eur=20.0),
            fact(3, 1, T(2024, 7, 1)),
            fact(4, 1, T(2024, 2, 1), order_parent_relationship_type="CHILD"),
            fact(5, 1, T(2024, 2, 1), order_final_status="CanceledStatus"),
            fact(6, 2, T(2022, 12, 31), order_is_first_delivered_order=True),
            fact(7, 2, T(2024, 1, 1)),
            fact(8, 3, T(2024, 1, 31), order_is_first_delivered_order=True, order_country_code="B"),
            fact(9, 3, T(2024, 2, 29), order_country_code="B"),
        ],
    )


def predictions(spark):
    ltv = spark.createDataFrame([(1, 5.0, 6.0, None), (1, 5.0, 6.0, None)], SCHEMAS["customer_ltv"])
    lto = spark.createDataFrame(
        [(1, 1.0, 2.0, 3.0, dt.date(2024, 6, 29)), (3, 1.0, 2.0, 3.0, dt.date(2024, 6, 28))],
        SCHEMAS["customer_lto"],
    )
    return ltv, lto


def test_customer_value(spark, sample):
    margins = pnl(
        spark,
        [
            {"order_id": 1, "contribution_margin_eur": 1.0, "tcorev_eur": 2.0, "mfcgso_eur": 3.0, "qmcogs_eur": 1.0, "bcomfr_eur": None, "dicofr_eur": 4.0},
            {"order_id": 2, "contribution_margin_eur": 2.0, "adve_eur": None, "caocfr_eur": 5.0},
            {"order_id": 2, "contribution_margin_eur": 2.0, "adve_eur": None},
        ],
    )
    ltv, lto = predictions(spark)
    got = orders.customer_value(sample, margins, ltv, lto, AS_OF).collect()
    assert [r.customer_id for r in got] == [1]
    r = got[0]
    assert (r.total_orders, r.total_qcomm_orders, r.active_months) == (2, 1, 18)
    assert r.aov == 15.0 and r.pltv_1y == 5.0 and r.pltv_5y is None and r.plto_3y == 2.0
    assert r.contribution_margin_eur == 5.0 and r.rpo == 4.0 and r.cpo == 9.0


def test_customers_without_prediction_on_request(spark, sample):
    ltv, lto = predictions(spark)
    got = orders.customer_value(sample, pnl(spark, []), ltv, lto, AS_OF, ["A", "B"], keep_unscored=True)
    rows = {r.customer_id: r for r in got.collect()}
    assert set(rows) == {1, 3} and rows[3].active_months == 2 and rows[3].rpo is None


def test_schema_check_names_the_problem(spark):
    bad = spark.createDataFrame([(1, "x")], "order_id bigint, payment_method string")
    assert check(bad, "payments") is bad
    with pytest.raises(ValueError, match="payment_method is missing"):
        check(bad.drop("payment_method"), "payments")
    with pytest.raises(ValueError, match="payment_method is bigint"):
        check(bad.withColumn("payment_method", F.lit(1).cast("long")), "payments")


def test_top_partners_break_ties_by_name(spark):
    rows = [fact(i, i, T(2024, 6, 1), store_name=s) for i, s in enumerate(["b", "a", "c", "c", None, "d"])]
    rows.append(fact(9, 9, T(2024, 1, 1), store_name="old"))
    rows.append(fact(10, 10, T(2024, 6, 1), store_name="q", order_vertical=QC))
    got = orders.top_partners(facts(spark, rows), AS_OF, 90, 3).orderBy("rank").collect()
    assert [(r.store_name, r.orders) for r in got] == [("c", 2), ("a", 1), ("b", 1)]
    every = orders.top_partners(facts(spark, rows), AS_OF, 90, 9, vertical=None)
    assert "q" in {r.store_name for r in every.collect()}


def test_prime_orders(spark):
    rows = [
        fact(1, 1, T(2024, 6, 1), order_is_prime=True, order_vertical=QC),
        fact(2, 1, T(2024, 6, 1), order_is_prime=True),
        fact(3, 1, T(2024, 6, 1), order_is_prime=True, order_vertical=QC, store_name="s2"),
    ]
    got = orders.prime_orders(facts(spark, rows), pnl(spark, []), AS_OF, store="s1").collect()
    assert [(r.order_id, r.contribution_margin_eur) for r in got] == [(1, None)]


def profile_of(spark, rows, **options):
    empty = lambda name: spark.createDataFrame([], SCHEMAS[name])
    payments = spark.createDataFrame([(1, "CASH"), (1, "BLIK"), (2, "CASH")], SCHEMAS["payments"])
    installs = spark.createDataFrame(
        [(1, "Google Ads X", False), (1, "Google Ads X", False), (1, "Tiktok", True), (None, "x", True)],
        SCHEMAS["installs"],
    )
    discounts = spark.createDataFrame([(1, "PROMOTOOL"), (1, "PROMOTOOL"), (2, "OTHER")], SCHEMAS["pricing_discounts"])
    segments = spark.createDataFrame(
        [(1, "Long Tail", "A", None), (1, "Big Chain", "A", dt.date(2024, 1, 1))], SCHEMAS["store_segmentation"]
    )
    checkout = spark.createDataFrame(
        [(1, "a", "s1", "A", "X", dt.date(2024, 1, 1))], SCHEMAS["checkout_events"]
    )
    session = spark.createDataFrame(
        [("a", "881f1d4887fffff", "A", "X", T(2024, 1, 1), [1], 1)], SCHEMAS["sessions"]
    )
    return profile.customer_profile(
        facts(spark, rows), payments, checkout, session, installs, discounts, empty("order_pnl"), segments, AS_OF,
        "PROMOTOOL", NETWORKS, **options
    ).collect()


def profile_rows():
    return [
        fact(1, 1, T(2024, 1, 1, 5), order_is_first_delivered_order=True),  # a Monday
        fact(2, 1, T(2024, 1, 7, 13), order_vertical=QC, store_name="s2", order_city_code="Y"),  # a Sunday
        fact(3, 1, T(2024, 2, 6, 20), order_is_prime=True),  # a Tuesday
        fact(4, 2, T(2024, 1, 1)),
    ]


def test_customer_profile(spark):
    (r,) = profile_of(spark, profile_rows())
    assert (r.customer_id, r.total_orders, r.customer_city, r.num_distinct_cities) == (1, 3, "X", 2)
    assert r.num_orders_days_1_to_7 == 2 and r.num_orders_days_31_to_60 == 1 and r.num_orders_days_1_to_365_total == 3
    third = pytest.approx(1 / 3)
    assert r.pct_orders_night == third and r.pct_orders_afternoon == third and r.pct_orders_evening == third
    assert r.pct_orders_monday == third and r.pct_orders_sunday == third and r.pct_orders_tuesday == third
    assert r.pct_orders_weekday == pytest.approx(2 / 3) and r.pct_promo_orders == third
    assert r.pct_cash_orders == pytest.approx(2 / 3) and r.pct_blik_orders == third
    assert r.pct_long_tail_orders == 1.0 and r.pct_big_chain_orders == 0.0 and r.pct_top_partner_orders == 1.0
    assert r.avg_monthly_orders == 1.5 and r.user_type == "C"
    assert r.days_until_first_qcommerce == 6 and r.days_until_first_prime == 36
    assert r.days_since_first_order == 181 and r.avg_monthly_orders_since_active == pytest.approx(3 / (181 / 30))
    assert r.google_installs and r.tiktok_installs and not r.apple_installs and r.organic_installs
    assert (r.top_1_store, r.top_2_store, r.top_3_store) == ("s1", "s2", None)
    assert f"{r.h7_hexagon:x}" == "871f1d488ffffff"


def test_profile_with_monday_first_days(spark):
    (r,) = profile_of(spark, profile_rows(), week_style="iso")
    third = pytest.approx(1 / 3)
    assert r.pct_orders_sunday == third and r.pct_orders_monday == third and r.pct_orders_saturday == third


def test_profile_on_the_first_day(spark):
    (r,) = profile_of(spark, [fact(1, 1, T(2024, 6, 30, 9), order_is_first_delivered_order=True)])
    assert r.days_since_first_order == 0 and r.avg_monthly_orders_since_active == 1.0


def test_levels_override_first_qcommerce(spark):
    levels = spark.createDataFrame([(2, dt.date(2024, 1, 3))], SCHEMAS["first_order_levels"])
    (r,) = profile_of(spark, profile_rows(), levels=levels)
    assert r.first_qcommerce_date == dt.date(2024, 1, 3) and r.days_until_first_qcommerce == 2


def test_user_type_limits(spark):
    rows = [fact(i, c, T(2024, 1 + m, 1)) for i, (c, m) in enumerate([(1, 0)] * 7 + [(2, 0)] * 3 + [(3, 0)] * 2 + [(4, 0)] * 6)]
    got = {r.customer_id: r.user_type for r in profile.user_type(facts(spark, rows)).collect()}
    assert got == {1: "A", 2: "B", 3: "C", 4: "B"}


def test_favourite_stores_rank_missing_names_last(spark):
    rows = [fact(i, 1, T(2024, 1, 1), store_name=s) for i, s in enumerate(["b", "a", None, "z", "z"])]
    (r,) = profile.favourite_stores(facts(spark, rows)).collect()
    assert (r.top_1_store, r.top_2_store, r.top_3_store) == ("z", "a", "b")

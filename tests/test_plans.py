from pathlib import Path

import pytest

import __spark_entry__ as entry
from checks.logical_sql import TABLES
from orderloom.plans import reports
from checks.testbed import AS_OF, COUNTRIES, Testbed
from tools.compare import TABLES as RAW
from tools.compare import rows_of

FOLDER = Path("/root/testdata/sf0.001")
pytestmark = pytest.mark.skipif(not FOLDER.exists(), reason="driver tables are not here")

COMPARED = (
    "order_facts_scan", "calendar_windows", "month_diff", "normalised_names", "keyword_match",
    "customer_value", "customer_profile", "drinks_kpis", "hex_demand_city", "hexagon_coverage",
    "relabel_rules", "quartiles", "csv_round_trip", "coverage_of_the_globe", "wkt_areas", "distinct_customers",
    "csv_bad_lines", "sql_parameters", "spearman_with_holes",
)


def test_twins_belong_to_queries():
    assert set(entry.oracle_sql()) <= set(entry.queries())
    assert len(entry.oracle_sql()) >= 80
    assert all(set(uses) <= set(TABLES) for uses, _ in TABLES.values())


@pytest.fixture(scope="module")
def duck():
    duckdb = pytest.importorskip("duckdb")
    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    for table in RAW:
        con.execute(f"CREATE VIEW {table} AS SELECT * FROM '{FOLDER}/{table}.parquet'")
    return con


@pytest.mark.parametrize("name", COMPARED)
def test_query_matches_its_twin(spark, duck, name):
    df = entry.queries()[name](spark, str(FOLDER))
    result = duck.execute(entry.oracle_sql()[name])
    columns = [c[0] for c in result.description]
    assert sorted(columns) == sorted(df.columns)
    assert rows_of(df.columns, df.collect()) == rows_of(columns, result.fetchall())


def test_entry_gives_a_report(spark):
    rows = entry.entry(spark).collect()
    assert rows and {"country", "bucket", "aov_interval"} <= set(rows[0].asDict())


def test_drinks_reports(spark):
    tb = Testbed(spark, str(FOLDER))
    got = reports.drinks_reports(
        tb.order_facts(), tb.bought_products(), tb.product_availability(), tb.product_predictions(),
        AS_OF, 700, COUNTRIES, n_partners=3,
    )
    assert set(got) == {
        "kpis", "partners", "partners_without_brand", "stores_without_drinks", "top_products", "uncategorised",
    }
    kpis = got["kpis"].collect()
    assert kpis and all(r.orders_with_drinks <= r.orders for r in kpis)
    partners = got["partners"].collect()
    assert 0 < len(partners) <= 3 * len(COUNTRIES)
    assert all(got[name].count() >= 0 for name in got)

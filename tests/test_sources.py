import datetime as dt
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from orderloom import session
from orderloom.sources import sinks, tables

PRODUCTS = "order_country_code string, store_name string, product_id bigint, product_name string, predicted_category string"


def test_csv_keeps_text(spark, tmp_path):
    rows = [
        ("UA", "s, 1", 1, 'Сік "яблуко"', " drink "),
        ("GE", "s", 2, "two\nlines", None),
        ("AM", None, 3, "", "other"),
    ]
    df = spark.createDataFrame(rows, PRODUCTS)
    sinks.write_csv(df, str(tmp_path / "c"))
    back = tables.read_csv(spark, str(tmp_path / "c"), "product_predictions")
    empty_is_null = [tuple(v if v != "" else None for v in r) for r in rows]
    assert [tuple(r) for r in back.orderBy("product_id").collect()] == empty_is_null


def test_report_is_replaced_and_clean(spark, tmp_path):
    first = spark.createDataFrame([("x", 1)], "a string, b int")
    second = spark.createDataFrame([(1, float("nan")), (2, float("-inf")), (3, 2.5)], "k int, v double")
    sinks.publish(first, str(tmp_path), "r")
    path = sinks.publish(second, str(tmp_path), "r")
    assert {r.k: r.v for r in tables.read_folder(spark, path).collect()} == {1: None, 2: None, 3: 2.5}
    assert {r.k for r in sinks.read_report(spark, str(tmp_path), "r").collect()} == {1, 2, 3}
    assert [tuple(r) for r in sinks.read_report(spark, str(tmp_path), "r", 1).collect()] == [("x", 1)]
    with pytest.raises(FileNotFoundError):
        sinks.read_report(spark, str(tmp_path), "r", 7)


def test_a_failed_write_keeps_the_old_report(spark, tmp_path):
    with pytest.raises(FileNotFoundError):
        sinks.read_report(spark, str(tmp_path), "r")
    sinks.publish(spark.range(3), str(tmp_path), "r")
    # Some tasks have written their part when another one fails.
    failing = spark.range(0, 100, 1, 4).selectExpr("CASE WHEN id = 99 THEN raise_error('broken') ELSE id END AS id")
    with pytest.raises(Exception, match="broken"):
        sinks.publish(failing, str(tmp_path), "r")
    assert sinks.read_report(spark, str(tmp_path), "r").count() == 3
    during = sinks.read_report(spark, str(tmp_path), "r")
    sinks.publish(spark.range(5), str(tmp_path), "r")
    # A reader that began with the old version still has it whole.
    assert during.count() == 3 and sinks.read_report(spark, str(tmp_path), "r").count() == 5


def test_feed_has_one_folder_per_metric(spark, tmp_path):
    df = spark.createDataFrame([("orders", 1), ("sessions", 2)], "metric string, v int")
    folder = sinks.write_feed(df, str(tmp_path / "f"))
    assert {p.name for p in Path(folder).iterdir() if p.is_dir()} == {"metric=orders", "metric=sessions"}


def test_bad_lines_are_kept_apart(spark, tmp_path):
    lines = ["k,v,t", "1,2.5,a", "2,x,b", "3,1.5", "4,1.5,c,d", ",,", '5,"2.5","e, f"', "6,1e3,", "nothing"]
    (tmp_path / "c.csv").write_text("\n".join(lines))
    good, bad = tables.split_csv(spark, str(tmp_path / "c.csv"), "k int, v double, t string")
    assert {tuple(r) for r in good.collect()} == {(1, 2.5, "a"), (None, None, None), (5, 2.5, "e, f"), (6, 1000.0, None)}
    assert {r.line for r in bad.collect()} == {"2,x,b", "3,1.5", "4,1.5,c,d", "nothing"}
    assert {r.file.endswith("c.csv") for r in bad.collect()} == {True} and good.count() + bad.count() == len(lines) - 1
    (tmp_path / "m.csv").write_text('k,v,t\n1,2,"two\nlines"\nx,2,"three\nmore\nlines"\n')
    good, bad = tables.split_csv(spark, str(tmp_path / "m.csv"), "k int, v double, t string", multi_line=True)
    assert [r.t for r in good.collect()] == ["two\nlines"] and bad.count() == 1


def test_sql_parameters_are_values(spark):
    df = spark.createDataFrame([("O'Neil", dt.date(2024, 1, 1), 1), ("x' OR '1'='1", dt.date(2024, 1, 2), 2), ("y", dt.date(2024, 1, 3), 3)], "n string, d date, k int")
    text = "SELECT k FROM {t} WHERE n = :name"
    assert [r.k for r in tables.query_sql(spark, text, {"t": df}, name="O'Neil").collect()] == [1]
    assert [r.k for r in tables.query_sql(spark, text, {"t": df}, name="x' OR '1'='1").collect()] == [2]
    text = "SELECT k FROM {t} WHERE d >= :since AND array_contains(:names, n) ORDER BY k"
    assert [r.k for r in tables.query_sql(spark, text, {"t": df}, since=dt.date(2024, 1, 2), names=["y", "O'Neil", "x' OR '1'='1"]).collect()] == [2, 3]
    assert tables.query_sql(spark, text, {"t": df}, since=dt.date(2024, 1, 2), names=["'"]).collect() == []


def test_days_choose_the_folders_that_are_read(spark, tmp_path):
    start = dt.date(2024, 1, 1)
    rows = [(day, k, start + dt.timedelta(days=day)) for day in range(30) for k in range(4)]
    path = str(tmp_path / "s")
    tables.write_snapshots(spark.createDataFrame(rows, "d int, k int, p_snapshot_date date"), path)
    at = [(dt.datetime(2024, 1, 3, 5), True), (dt.datetime(2024, 1, 3, 9), True), (dt.datetime(2024, 1, 20), True), (dt.datetime(2024, 1, 9), False)]
    events = spark.createDataFrame(at, "at timestamp_ntz, prime boolean")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        kept = tables.on_days_of(tables.read_folder(spark, path), events.filter("prime"), F.col("at"), dt.date(2024, 6, 1))
        assert sorted(r.d for r in kept.collect()) == [2] * 4 + [19] * 4
        plan = kept._jdf.queryExecution().executedPlan()
        assert "dynamicpruning" in plan.toString().lower()
        leaves = plan.collectLeaves()
        metrics = [leaves.apply(i).metrics() for i in range(leaves.size())]
        assert [m.apply("numPartitions").value() for m in metrics if m.contains("numPartitions")] == [2]
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", "true")
    # Writing one day again leaves the others alone.
    tables.write_snapshots(spark.createDataFrame([(100, 0, start)], "d int, k int, p_snapshot_date date"), path)
    days = [r.d for r in spark.read.parquet(path).collect()]
    assert len(days) == 29 * 4 + 1 and days.count(100) == 1 and 0 not in days


def test_snapshots_and_versions(spark):
    day = dt.date(2024, 5, 1)
    df = spark.createDataFrame([(1, day, None), (2, day - dt.timedelta(days=1), day)], "k int, p_date date, p_end_date date")
    assert [r.k for r in tables.yesterday_of(df, day).collect()] == [2]
    assert [r.k for r in tables.current_rows(df).collect()] == [1]


def test_stack_matches_by_name(spark):
    a = spark.createDataFrame([(1, "x")], "k int, t string")
    b = spark.createDataFrame([("y", 2)], "t string, k int")
    assert sorted(tuple(r) for r in tables.stack(a, b).collect()) == [(1, "x"), (2, "y")]


def test_tables_by_name(spark):
    spark.range(3).createOrReplaceTempView("three")
    assert tables.read_table(spark, "three").count() == 3


def test_materialised_table_reads_back(spark):
    df = session.materialise(spark.range(5).selectExpr("id", "cast(null as string) as t"))
    assert df.count() == 5 and df.columns == ["id", "t"]


def test_checkpoint_folder_must_be_named_on_a_cluster(monkeypatch):
    class Context:
        master = "yarn"

        def getCheckpointDir(self):
            return None

    class Conf:
        def get(self, key, default=None):
            return default

    class Session:
        sparkContext, conf = Context(), Conf()

    with pytest.raises(RuntimeError, match="spark.checkpoint.dir"):
        session.ensure_checkpoint_dir(Session())

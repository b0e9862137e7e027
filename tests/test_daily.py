"""Panels kept by day, and bitmaps that add up, against the whole computation."""

import datetime as dt
import random
from collections import defaultdict

from pyspark.sql import functions as F

from orderloom.operators import daily, orders
from orderloom.schemas import SCHEMAS
from tests.test_orders import AS_OF, QC, T, fact, facts, pnl


def sample(spark, cancelled=()):
    rng = random.Random(7)
    rows, margins = [], []
    for i in range(400):
        when = T(2022, 12, 20) + dt.timedelta(hours=rng.randrange(24 * 560))
        row = fact(
            i, rng.randrange(40), when, order_country_code=rng.choice("AB"), order_is_first_delivered_order=rng.random() < 0.2,
            order_vertical=rng.choice(["Food", QC]), order_transacted_value_eur=rng.choice([None, 10.0, 12.5]),
            order_final_status="CanceledStatus" if i in cancelled or rng.random() < 0.1 else "DeliveredStatus",
        )
        rows += [row] * rng.choice([1, 1, 2])
        margins += [{"order_id": i, "contribution_margin_eur": float(rng.randrange(9))}] * rng.choice([0, 1, 2])
    return facts(spark, rows), pnl(spark, margins), rows


def scores(spark):
    ltv = spark.createDataFrame([(i, 1.0, None, 3.0) for i in range(40)], SCHEMAS["customer_ltv"])
    lto = spark.createDataFrame([(i, 1.0, 2.0, 3.0, AS_OF - dt.timedelta(days=1)) for i in range(0, 40, 2)], SCHEMAS["customer_lto"])
    return ltv, lto


def panel(df):
    return {tuple(round(v, 9) if isinstance(v, float) else v for v in (r[c] for c in sorted(df.columns))) for r in df.collect()}


def test_kept_days_give_the_whole_panel(spark, tmp_path):
    path = str(tmp_path / "days")
    order_facts, order_pnl, rows = sample(spark)
    ltv, lto = scores(spark)
    daily.refresh_days(path, order_facts, order_pnl, dt.date(2023, 1, 1), AS_OF - dt.timedelta(days=1))
    daily.refresh_days(path, order_facts, order_pnl, AS_OF, AS_OF)
    for keep in (False, True):
        got = daily.customer_value_of_days(daily.read_days(spark, path), ltv, lto, AS_OF, keep)
        want = orders.customer_value(order_facts, order_pnl, ltv, lto, AS_OF, keep_unscored=keep)
        assert panel(got) == panel(want) and want.count() > 5
    # Later all orders of a day are cancelled: only that day is worked out again.
    day = next(r["order_activated_local_at"].date() for r in rows if r["order_final_status"] == "DeliveredStatus" and T(2024, 1, 1) < r["order_activated_local_at"] < T(2024, 6, 1))
    gone = F.when(F.to_date("order_activated_local_at") == day, "CanceledStatus").otherwise(F.col("order_final_status"))
    changed = order_facts.withColumn("order_final_status", gone)
    assert daily.read_days(spark, path).filter(F.col("day") == day).count() > 0
    daily.refresh_days(path, changed, order_pnl, day, day)
    assert daily.read_days(spark, path).filter(F.col("day") == day).count() == 0
    got = daily.customer_value_of_days(daily.read_days(spark, path), ltv, lto, AS_OF, True)
    assert panel(got) == panel(orders.customer_value(changed, order_pnl, ltv, lto, AS_OF, keep_unscored=True))


def test_one_day_reads_one_day(spark, tmp_path):
    order_facts, order_pnl, _ = sample(spark)
    order_facts.write.parquet(str(tmp_path / "facts"))
    order_pnl.write.parquet(str(tmp_path / "pnl"))
    one = daily.daily_value(spark.read.parquet(str(tmp_path / "facts")), spark.read.parquet(str(tmp_path / "pnl")), AS_OF, AS_OF)
    # Both readings of the orders, for the sums and for the margins, are bounded by the day.
    plan = one._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count(">= 2024-06-30 00:00:00") == plan.count("< 2024-07-01 00:00:00") == 2
    daily.refresh_days(str(tmp_path / "days"), order_facts, order_pnl, dt.date(2023, 1, 1), dt.date(2023, 12, 31))
    kept = daily.read_days(spark, str(tmp_path / "days")).filter(F.col("day") == dt.date(2023, 5, 5))
    assert "PartitionFilters: [isnotnull(day" in kept._jdf.queryExecution().executedPlan().toString()


def test_bitmaps_count_distinct_ids(spark):
    rng = random.Random(5)
    rows = [(rng.choice(["x", "y", None]), rng.randrange(4), rng.choice([None, 0, 1, 32768, 32769, 2**40, -5, *range(900)]), rng.random() < 0.3) for _ in range(5000)]
    df = spark.createDataFrame(rows, "city string, day int, id long, prime boolean").repartition(5)
    tests = {"every": F.lit(True), "prime": F.col("prime"), "none": F.lit(False)}
    parts = daily.distinct_bitmaps(df, ["city", "day"], "id", tests)
    assert "Expand" not in parts._jdf.queryExecution().optimizedPlan().toString()
    for keys in (["city", "day"], ["city"], ["day"]):
        want = defaultdict(lambda: (set(), set()))
        for row in rows:
            key = tuple({"city": row[0], "day": row[1]}[k] for k in keys)
            if row[2] is not None:
                want[key][0].add(row[2])
                if row[3]:
                    want[key][1].add(row[2])
        got = {tuple(r[k] for k in keys): (r.every, r.prime, r.none) for r in daily.bitmap_counts(parts, keys, tests).collect()}
        assert got == {k: (len(a), len(b), 0) for k, (a, b) in want.items()}

import random
import statistics

import numpy as np
import pytest
from pyspark.sql import functions as F

from orderloom.operators import ranks


def frame(spark, groups):
    rows = [(g, None if v is None else float(v)) for g, values in groups.items() for v in values]
    return spark.createDataFrame(rows, "g string, v double").repartition(3)


@pytest.fixture(params=["4", "60"])
def tasks(spark, request):
    """Few large ranges, and many small ones that are not put together again."""
    spark.conf.set("spark.sql.shuffle.partitions", request.param)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", str(request.param == "4").lower())
    yield
    spark.conf.set("spark.sql.shuffle.partitions", "4")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")


def test_exact_quantiles(spark, tasks):
    """Against numpy."""
    rng = random.Random(7)
    groups = {
        "wide": [rng.lognormvariate(0, 3) for _ in range(3000)],
        "ties": [float(rng.choice([0, 0, 0, 1, 5])) for _ in range(1000)],
        "one": [4.0],
        "two": [1.0, 2.0],
        "none": [None],
    }
    probs = [0, 0.05, 0.25, 1 / 3, 0.5, 0.95, 1]
    got = {r.g: r for r in ranks.exact_quantiles(frame(spark, groups), ["g"], "v", probs, "q").collect()}
    assert "none" not in got
    for g in ("wide", "ties", "one", "two"):
        assert got[g].n == len(groups[g])
        np.testing.assert_allclose(got[g].q, np.quantile(groups[g], probs), rtol=1e-12)


def test_quantiles_without_groups_and_with_null_group(spark):
    df = frame(spark, {"a": [1, 2, 3, 4], None: [10, 20]})
    assert ranks.exact_quantiles(df, [], "v", [0.5], "q").collect()[0].q == [3.5]
    got = {r.g: r.q[0] for r in ranks.exact_quantiles(df, ["g"], "v", [0.5], "q").collect()}
    assert got == {"a": 2.5, None: 15.0}
    assert ranks.exact_quantiles(df.filter("false"), ["g"], "v", [0.5]).collect() == []


@pytest.mark.parametrize("n", [1000, 60000])
def test_quantiles_leave_nan_out_at_every_size(spark, n):
    number = F.when(F.col("id") % 10 == 0, F.lit(float("nan"))).otherwise(F.col("id").cast("double"))
    df = spark.range(n, numPartitions=4).select(number.alias("v"))
    got = ranks.exact_quantiles(df, [], "v", [0.5, 0.98, 1], "q").first()
    known = [i for i in range(n) if i % 10]
    assert got.n == len(known)
    np.testing.assert_allclose(got.q, np.quantile(known, [0.5, 0.98, 1]), rtol=1e-12)


def test_quantiles_of_a_group_with_one_hot_value(spark):
    """One group holds nine tenths of the rows, nearly all of one value; no task sees them one by one."""
    df = spark.range(50000, numPartitions=4).select(
        F.when(F.col("id") % 10 == 0, "cold").otherwise("hot").alias("g"),
        F.when(F.col("id") % 100 == 1, F.col("id")).otherwise(F.lit(7)).cast("double").alias("v"),
    )
    got = {r.g: r for r in ranks.exact_quantiles(df, ["g"], "v", [0, 0.5, 0.999], "q").collect()}
    values = [float(i) if i % 100 == 1 else 7.0 for i in range(50000) if i % 10]
    np.testing.assert_allclose(got["hot"].q, np.quantile(values, [0, 0.5, 0.999]), rtol=1e-12)
    assert got["cold"].q == [7.0, 7.0, 7.0] and got["cold"].n == 5000


def test_value_ranks(spark, tasks):
    rng = random.Random(3)
    values = [float(rng.randint(0, 40)) for _ in range(500)]
    counts = frame(spark, {"x": values, "y": [1.0, 1.0, 2.0]}).groupBy("g", "v").agg(F.count("v").alias("c"))
    got = {(r.g, r.v): r.avg_rank for r in ranks.value_ranks(counts, ["g"], "v", "c").collect()}
    ordered = sorted(values)
    for v in set(values):
        expected = statistics.mean(i + 1 for i, o in enumerate(ordered) if o == v)
        assert got["x", v] == pytest.approx(expected)
    assert got["y", 1.0] == 1.5 and got["y", 2.0] == 3.0


def test_mode_takes_smallest_of_equals(spark):
    df = frame(spark, {"a": [2.0, 1.0, 2.0, 1.0, 3.0], "b": [None, 7.0]})
    assert {r.g: r.mode for r in ranks.group_mode(df, ["g"], "v").collect()} == {"a": 1.0, "b": 7.0}


def test_null_profile(spark):
    df = frame(spark, {"a": [1.0, None], None: [None]})
    assert {r.column_name: r.null_count for r in ranks.null_profile(df).collect()} == {"g": 1, "v": 2}

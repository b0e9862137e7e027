"""Feature preparation: column choice, imputation, one-hot, rank correlation, split."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.ml.feature import OneHotEncoder, StringIndexer
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from orderloom.functions.numbers import finite_columns, ratio_or_null
from orderloom.functions.text import with_missing_level
from orderloom.operators.ranks import exact_quantiles, group_mode, melt, value_ranks
from orderloom.session import materialise

# Columns that are ids, dates, raw geography or the target.
NOT_FEATURES = (
    "customer_id", "user_type", "customer_first_delivered_date", "first_qcommerce_date",
    "first_prime_date", "last_order_date", "order_country_code", "customer_city", "h7_hexagon",
    "top_1_store", "top_2_store", "top_3_store",
)
# Columns the user type is read from: with them a model repeats the rule.
LEAKING = ("avg_monthly_orders", "avg_monthly_orders_since_active")


def feature_columns(
    df: DataFrame, exclude: Sequence[str] = NOT_FEATURES, keep_leaking: bool = False
) -> tuple[list[str], list[str]]:
    """Numeric (with boolean) and text columns, chosen by type."""
    skipped = set(exclude) | (set() if keep_leaking else set(LEAKING))
    fields = [f for f in df.schema.fields if f.name not in skipped]
    numeric = [f.name for f in fields if isinstance(f.dataType, (T.NumericType, T.BooleanType))]
    text = [f.name for f in fields if isinstance(f.dataType, T.StringType)]
    return numeric, text


def impute(
    df: DataFrame, numeric: Sequence[str], text: Sequence[str] = (), text_rule: str = "missing"
) -> DataFrame:
    """Infinities and nulls of numeric columns become the exact median.

    Text nulls become their own level, or the most frequent level with
    ``text_rule="mode"``. Only one value per column passes through the driver.
    """
    clean = finite_columns(df)
    fills: dict[str, Column] = {}
    if numeric:
        long = melt(clean, numeric)
        for r in exact_quantiles(long, ["metric"], "value", [0.5], "q").collect():
            fills[r.metric] = F.expr(f"coalesce(CAST(`{r.metric}` AS DOUBLE), {r.q[0]!r}D)")
    if text and text_rule == "mode":
        pairs = F.array(*[F.struct(F.lit(c).alias("metric"), F.col(f"`{c}`").alias("value")) for c in text])
        long = clean.select(F.explode(pairs).alias("p")).select("p.metric", "p.value")
        for r in group_mode(long, ["metric"], "value").collect():
            fills[r.metric] = F.coalesce(F.col(f"`{r.metric}`"), F.lit(r.mode))
    elif text:
        fills.update({c: with_missing_level(F.col(f"`{c}`")) for c in text})
    return clean.withColumns(fills)


def one_hot(df: DataFrame, columns: Sequence[str], levels: Mapping[str, Sequence[str]] | None = None) -> DataFrame:
    """A 0/1 column per level, none dropped; a null has 0 in all of them.

    Levels not given in ``levels`` are looked up. They become column names, which suits columns of
    few levels; ``one_hot_vectors`` takes any number.
    """
    out = df
    for column in columns:
        found = (levels or {}).get(column)
        if found is None:
            found = [r[0] for r in df.filter(F.col(column).isNotNull()).select(column).distinct().collect()]
        out = out.withColumns(
            {f"{column}_{v}": F.coalesce((F.col(column) == v).cast("int"), F.lit(0)) for v in sorted(found)}
        ).drop(column)
    return out


def one_hot_vectors(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """One sparse 0/1 vector ``<column>_vector`` per column, in its place; a null has 0 everywhere.

    The positions follow the levels in alphabetical order.
    """
    out = df
    for column in columns:
        names = {"inputCol": column, "outputCol": "_level"}
        index = StringIndexer(stringOrderType="alphabetAsc", handleInvalid="keep", **names).fit(out)
        encode = OneHotEncoder(inputCols=["_level"], outputCols=[f"{column}_vector"], dropLast=True)
        # Nulls get the number after the last level; it is the one position dropped.
        marked = index.transform(out)
        out = encode.fit(marked).transform(marked).drop(column, "_level")
    return out


def spearman(df: DataFrame, columns: Sequence[str], target: str) -> DataFrame:
    """Rank correlation of each column with the target, ties at their mean rank.

    Pairs in which either value is null or NaN are left out.
    Equal (value, target) pairs are counted first; ranks are found on distinct values
    and the correlation is a weighted sum, so a value shared by most rows is one row.
    """
    long = melt(df.select(*columns, F.col(target).cast("double").alias("_y")), columns, ["_y"])
    pairs = materialise(
        long.filter(F.col("value").isNotNull() & F.col("_y").isNotNull() & ~F.isnan("value") & ~F.isnan("_y"))
        .groupBy("metric", "value", "_y")
        .agg(F.count(F.lit(1)).alias("w"))
    )
    axes = [
        pairs.groupBy("metric", F.lit(axis).alias("axis"), F.col(c).alias("value")).agg(F.sum("w").alias("c"))
        for axis, c in (("x", "value"), ("y", "_y"))
    ]
    ranks = materialise(value_ranks(axes[0].unionByName(axes[1]), ["metric", "axis"], "value", "c"))
    x_ranks = ranks.filter("axis = 'x'").select("metric", "value", F.col("avg_rank").alias("rx"))
    y_ranks = ranks.filter("axis = 'y'").select("metric", F.col("value").alias("_y"), F.col("avg_rank").alias("ry"))
    # The target's ranks carry the middle rank; written alone, few of them are broadcast by their known size,
    # so the pairs of a hot target value are not shuffled by it.
    sizes = materialise(pairs.groupBy("metric").agg(((F.sum("w") + 1) / F.lit(2.0)).alias("mid")))
    y_ranks = materialise(y_ranks.join(sizes, "metric"))
    ranked = pairs.join(y_ranks, ["metric", "_y"]).join(x_ranks, ["metric", "value"])
    x, y, w = F.col("rx") - F.col("mid"), F.col("ry") - F.col("mid"), F.col("w")
    return (
        ranked.groupBy("metric")
        .agg(
            ratio_or_null(F.sum(w * x * y), F.sqrt(F.sum(w * x * x)) * F.sqrt(F.sum(w * y * y))).alias(
                "spearman"
            )
        )
        .orderBy(F.desc_nulls_last("spearman"), "metric")
    )


def strongest(correlations: DataFrame, n: int = 15) -> DataFrame:
    """The ``n`` highest and the ``n`` lowest correlations."""
    known = materialise(correlations.filter(F.col("spearman").isNotNull()))
    top = known.orderBy(F.desc("spearman"), "metric").limit(n)
    bottom = known.orderBy("spearman", "metric").limit(n)
    return top.unionByName(bottom).distinct()


def split_key(identity: Column, seed: int) -> Column:
    """A reproducible draw in [0, 2**52): the head of a digest of id and seed."""
    digest = F.md5(F.concat(identity.cast("string"), F.lit(f"-{seed}")))
    return F.conv(F.substring(digest, 1, 13), 16, 10).cast("long")


#: Leading bits of a draw by which rows are counted before the row at the limit is looked for.
SLOT_BITS = 13


def stratified_split(
    df: DataFrame, label: str | None, identity: str, fraction: float, seed: int = 42
) -> DataFrame:
    """Adds ``is_test``: exactly ``floor(fraction * n)`` rows of each label, by lowest draw.

    ``identity`` is a unique column. Draws are counted by their leading bits, so the row at the limit is
    found among a small share of its label's rows, by whole positions; equal draws are told apart by
    identity. ``label=None`` splits as a whole. Labels must be few.
    """
    draw = split_key(F.col(identity), seed)
    key = F.lit("") if label is None else F.col(label)
    slim = df.select(key.alias("_label"), draw.alias("_draw"), F.col(identity).alias("_id"))
    slim = materialise(slim.withColumn("_slot", F.shiftright("_draw", 52 - SLOT_BITS)))
    counts = slim.groupBy("_label", "_slot").agg(F.count(F.lit(1)).alias("_c"))
    whole = Window.partitionBy("_label")
    earlier = whole.orderBy("_slot").rowsBetween(Window.unboundedPreceding, -1)
    wanted = F.floor(F.lit(fraction) * F.sum("_c").over(whole))
    placed = counts.select("*", F.coalesce(F.sum("_c").over(earlier), F.lit(0)).alias("_before"), wanted.alias("_wanted"))
    limit = placed.filter("_before < _wanted AND _wanted <= _before + _c").select(
        F.col("_label").alias("_of"), F.col("_slot").alias("_at"), (F.col("_wanted") - F.col("_before")).alias("_need")
    )
    near = slim.join(limit, F.col("_label").eqNullSafe(F.col("_of")) & (F.col("_slot") == F.col("_at")))
    ranked = near.withColumn("_rank", F.row_number().over(whole.orderBy("_draw", "_id")))
    chosen = F.lit(False)
    for last in ranked.filter("_rank = _need").collect():  # one row for each label
        under = (draw < F.lit(last["_draw"])) | ((draw == F.lit(last["_draw"])) & (F.col(identity) <= F.lit(last["_id"])))
        chosen = chosen | (key.eqNullSafe(F.lit(last["_label"])) & under)
    return df.withColumn("is_test", chosen)

"""Models with pyspark.ml: user-type forest, category models per country, metrics."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from concurrent.futures import ThreadPoolExecutor

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import LogisticRegression, RandomForestClassifier
from pyspark.ml.feature import (
    IDF,
    IndexToString,
    SQLTransformer,
    StringIndexer,
    VectorAssembler,
)
from pyspark.ml.functions import array_to_vector, predict_batch_udf
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from orderloom.functions.numbers import ratio_or_zero
from orderloom.functions.text import canonical_category, sql_text
from orderloom.operators.features import stratified_split
from orderloom.operators.grams import GramCounts
from orderloom.operators.vectors import mean_vectors
from orderloom.session import materialise
from orderloom.sources.tables import stack

SEED = 42
#: Models that are fitted at once.
CONCURRENT = 4


def class_weights(df: DataFrame, label: str, name: str = "weight") -> DataFrame:
    """Adds n / (classes * n_class), so every class weighs the same in total."""
    counts = {r[label]: r.n for r in df.groupBy(label).agg(F.count(F.lit(1)).alias("n")).collect()}
    total = sum(counts.values())
    weight = F.lit(None).cast("double")
    for value, n in counts.items():
        weight = F.when(F.col(label).eqNullSafe(F.lit(value)), total / (len(counts) * n)).otherwise(weight)
    return df.withColumn(name, weight)


def fit_forest(
    train: DataFrame, features: Sequence[str], label: str, trees: int = 200, depth: int = 8, seed: int = SEED
) -> PipelineModel:
    """Class-weighted random forest over numeric columns."""
    index = StringIndexer(
        inputCol=label, outputCol="label_index", stringOrderType="alphabetAsc", handleInvalid="skip"
    ).fit(train)
    forest = RandomForestClassifier(
        featuresCol="features", labelCol="label_index", weightCol="weight", numTrees=trees, maxDepth=depth, seed=seed
    )
    stages = [index, VectorAssembler(inputCols=list(features), outputCol="features"), forest]
    back = IndexToString(inputCol="prediction", outputCol="predicted", labels=index.labels)
    return Pipeline(stages=[*stages, back]).fit(class_weights(train, label))


def importances(model: PipelineModel, features: Sequence[str], like: DataFrame, n: int = 30) -> DataFrame:
    """The ``n`` most important columns of a fitted forest."""
    forest = next(s for s in model.stages if hasattr(s, "featureImportances"))
    scores = forest.featureImportances.toArray()
    rows = [(name, float(score)) for name, score in zip(features, scores)]
    return (
        like.sparkSession.createDataFrame(rows, "feature string, importance double")
        .orderBy(F.desc("importance"), "feature")
        .limit(n)
    )


def confusion(pred: DataFrame, label: str, predicted: str) -> DataFrame:
    return pred.groupBy(F.col(label).alias("label"), F.col(predicted).alias("predicted")).agg(
        F.count(F.lit(1)).alias("n")
    )


def classification_metrics(pred: DataFrame, label: str, predicted: str) -> DataFrame:
    """Precision, recall, F1 and support per class, then accuracy and averages.

    A division by zero counts as 0. Everything after the confusion counts is class-sized.
    """
    cells = confusion(pred, label, predicted)
    sides = F.explode(
        F.array(
            F.struct(F.col("label").alias("class"), F.col("n").alias("support"), F.lit(0).cast("long").alias("guessed")),
            F.struct(F.col("predicted").alias("class"), F.lit(0).cast("long").alias("support"), F.col("n").alias("guessed")),
        )
    )
    hit = F.when(F.col("label") == F.col("predicted"), F.col("n")).otherwise(0)
    per_class = (
        cells.withColumn("hit", hit)
        .select("hit", sides.alias("s"))
        .groupBy(F.col("s.class").cast("string").alias("class"))
        .agg(F.sum("hit").alias("hits2"), F.sum("s.support").alias("support"), F.sum("s.guessed").alias("guessed"))
        .withColumn("hits", F.col("hits2") / 2)
        .withColumn("precision", ratio_or_zero(F.col("hits"), F.col("guessed")))
        .withColumn("recall", ratio_or_zero(F.col("hits"), F.col("support")))
        .withColumn(
            "f1",
            ratio_or_zero(F.col("precision") * F.col("recall") * 2, F.col("precision") + F.col("recall")),
        )
    )
    shown = per_class.select("class", "precision", "recall", "f1", "support")
    support = F.sum("support")

    def weighted(c: str) -> Column:
        return ratio_or_zero(F.sum(F.col(c) * F.col("support")), support)

    totals = per_class.agg(
        F.struct(
            F.lit("accuracy").alias("class"),
            *[ratio_or_zero(F.sum("hits"), support).alias(c) for c in ("precision", "recall", "f1")],
            support.alias("support"),
        ).alias("accuracy"),
        F.struct(
            F.lit("macro avg").alias("class"),
            *[F.avg(c).alias(c) for c in ("precision", "recall", "f1")],
            support.alias("support"),
        ).alias("macro"),
        F.struct(
            F.lit("weighted avg").alias("class"),
            *[weighted(c).alias(c) for c in ("precision", "recall", "f1")],
            support.alias("support"),
        ).alias("weighted"),
    )
    summary = totals.select(F.explode(F.array("accuracy", "macro", "weighted")).alias("r")).select("r.*")
    return stack(shown, summary)


def text_stages(column: str = "product_name", n: int = 3, width: int = 1 << 12) -> list:
    """Character n-grams of the whole text, hashed and weighted by rarity."""
    counts = GramCounts(inputCol=column, outputCol="_tf", n=n, numFeatures=width)
    return [counts, IDF(inputCol="_tf", outputCol="features")]


def text_vectors(df: DataFrame, column: str = "product_name", n: int = 3, width: int = 1 << 12) -> DataFrame:
    """Adds ``features`` to rows with a name."""
    rows = df.dropna(subset=[column])
    return Pipeline(stages=text_stages(column, n, width)).fit(rows).transform(rows).drop("_tf")


def encoded_vectors(
    df: DataFrame,
    make_encoder: Callable[[], Callable],
    column: str = "product_name",
    batch_size: int = 16,
) -> DataFrame:
    """Adds ``features`` from an encoder the user brings; rows with a NaN element are dropped.

    ``make_encoder`` runs once per Python worker and returns a function from a batch of
    texts to a two-dimensional array.
    """
    encode = predict_batch_udf(make_encoder, return_type=T.ArrayType(T.FloatType()), batch_size=batch_size)
    coded = df.dropna(subset=[column]).withColumn("_v", encode(F.col(column)))
    return valid_vectors(coded, "_v").withColumn("features", array_to_vector("_v")).drop("_v")


def valid_vectors(df: DataFrame, column: str) -> DataFrame:
    """Rows whose vector is present and free of NaN."""
    return df.filter(F.col(column).isNotNull() & ~F.exists(column, lambda x: F.isnan(x)))


def _category_model(
    learn: DataFrame, label: str, stages: Sequence, learners: Sequence, trees: int, depth: int, seed: int
) -> PipelineModel:
    """A forest on rows that went through ``stages`` already, as one model from the names on."""
    index = StringIndexer(inputCol=label, outputCol="label_index", stringOrderType="alphabetAsc").fit(learn)
    forest = RandomForestClassifier(
        featuresCol="features", labelCol="label_index", numTrees=trees, maxDepth=depth, seed=seed
    )
    back = IndexToString(inputCol="prediction", outputCol="predicted_category", labels=index.labels)
    fitted = Pipeline(stages=[*learners, index, forest, back]).fit(learn)
    return PipelineModel(stages=[*stages, *fitted.stages])


def _at_once(tasks: Sequence[Callable], threads: int = CONCURRENT) -> list:
    """Results of functions that each start Spark jobs, a few at a time; the first failure is raised."""
    with ThreadPoolExecutor(max_workers=max(1, min(threads, len(tasks)))) as pool:
        return list(pool.map(lambda task: task(), tasks))


def _country_folders(df: DataFrame) -> DataFrame:
    """``df``, written once with a folder per country, so each country's branch reads its own rows."""
    return materialise(df.withColumn("_folder", F.xxhash64("order_country_code")), by="_folder")


def _in_country(country: str) -> Column:
    return (F.col("_folder") == F.xxhash64(F.lit(country))) & (F.col("order_country_code") == country)


def _complete(df: DataFrame, *columns: str) -> DataFrame:
    """Rows without a null in these columns. Each is tested by itself, so a test moves below the joins of ``df``
    and a long text is not shuffled where only its presence counts."""
    for column in columns:
        df = df.filter(F.col(column).isNotNull())
    return df


def fit_by_country(
    train: DataFrame,
    identity: str,
    trees: int = 100,
    depth: int = 5,
    test_fraction: float = 0.2,
    seed: int = SEED,
    vectors: DataFrame | None = None,
) -> tuple[dict[str, PipelineModel], DataFrame]:
    """One category model per country, and the held-out rows with their predictions.

    Names are turned into n-gram counts once for all countries (rarity is weighed per country), or, with
    ``vectors`` from ``word_vectors``, into mean word vectors. The fits of the few countries run at
    once, each a distributed job. Rows without a name or category are dropped first.
    """
    clean = _complete(train, "order_country_code", "product_name", "Category")
    parts = stratified_split(clean, "order_country_code", identity, test_fraction, seed)
    *stages, rarity = text_stages()
    if vectors is None:
        ready, learners = PipelineModel(stages=stages).transform(parts), [rarity]
    else:
        ready, stages, learners = mean_vectors(parts, vectors), [], []
    ready = _country_folders(ready)
    learn_rows = ready.filter(~F.col("is_test"))
    levels = {
        r["order_country_code"]: (r.n, r.one)
        for r in learn_rows.groupBy("order_country_code")
        .agg(F.countDistinct("Category").alias("n"), F.min("Category").alias("one"))
        .collect()
    }

    def fit(country: str) -> PipelineModel:
        n, only = levels[country]
        learn = learn_rows.filter(_in_country(country))
        if n == 1:
            return Pipeline(stages=[constant_category(only)]).fit(learn)
        return _category_model(learn, "Category", stages, learners, trees, depth, seed)

    countries = sorted(levels)
    fitted = _at_once([lambda c=c: fit(c) for c in countries])
    models = dict(zip(countries, fitted, strict=True))
    tested = []
    done = "_tf" in ready.columns
    for country, model in models.items():
        # Renamed, so that a category unseen in training is still a row to predict.
        asked = ready.filter(_in_country(country) & F.col("is_test")).withColumnRenamed("Category", "_actual")
        own = PipelineModel(stages=model.stages[len(stages) :]) if done and levels[country][0] > 1 else model
        tested.append(own.transform(asked).select(identity, "order_country_code", F.col("_actual").alias("Category"), "predicted_category"))
    return models, stack(*tested)


def constant_category(category: str) -> SQLTransformer:
    """Stage for a country whose training rows all have one category."""
    return SQLTransformer(statement=f"SELECT *, {sql_text(category)} AS predicted_category FROM __THIS__")


def predict_by_country(products: DataFrame, models: dict[str, PipelineModel], vectors: DataFrame | None = None) -> DataFrame:
    """Predicted category of named products; countries without a model give no rows.

    Models that were fitted on word vectors need the same ``vectors``.
    """
    named = products.dropna(subset=["product_name"]).filter(F.col("order_country_code").isin(list(models)))
    named = _country_folders(named if vectors is None else mean_vectors(named, vectors))
    parts = []
    for country, model in sorted(models.items()):
        applied = model.transform(named.filter(_in_country(country)))
        parts.append(applied.select(*products.columns, "predicted_category"))
    return stack(*parts)


def fit_binary(
    train: DataFrame,
    identity: str,
    country: str | None = None,
    positive: str = "drink",
    test_fraction: float = 0.2,
    seed: int = SEED,
    max_iter: int = 50,
) -> tuple[PipelineModel, DataFrame]:
    """Drink-or-other model of one country with a stratified held-out part.

    Returns the model and the held-out rows with ``label`` and ``predicted_category``.
    """
    rows = _complete(train, "product_name", "Category")
    if country is not None:
        rows = rows.filter(F.col("order_country_code") == country)
    labelled = rows.withColumn("label", (canonical_category(F.col("Category")) == positive).cast("double"))
    parts = materialise(stratified_split(labelled, "label", identity, test_fraction, seed))
    learner = LogisticRegression(featuresCol="features", labelCol="label", maxIter=max_iter, regParam=0.01)
    back = IndexToString(inputCol="prediction", outputCol="predicted_category", labels=["other", positive])
    model = Pipeline(stages=[*text_stages(), learner, back]).fit(parts.filter(~F.col("is_test")))
    tested = model.transform(parts.filter("is_test"))
    return model, tested.select(identity, "order_country_code", "label", "predicted_category")


def save_model(model: PipelineModel, path: str) -> None:
    model.write().overwrite().save(path)


def load_model(path: str) -> PipelineModel:
    return PipelineModel.load(path)


def fit_vectors(train: DataFrame, label: str, trees: int = 100, depth: int = 8, seed: int = SEED) -> PipelineModel:
    """Forest over a ready vector column ``features`` and an integer label."""
    forest = RandomForestClassifier(featuresCol="features", labelCol=label, numTrees=trees, maxDepth=depth, seed=seed)
    return Pipeline(stages=[forest]).fit(train)

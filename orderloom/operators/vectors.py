"""Word vectors learnt from the names themselves, and the mean vector of a name.

Words that stand beside the same words get similar vectors. The counts of neighbouring words are folded per
pair; a pair weighs the positive logarithm of how much more often it occurs than chance would have it,
and a word's vector is the sum of its neighbours' random directions by these weights. A direction is
read from a hash of the neighbour, so there is no table of them, nothing is iterated, and no vocabulary
passes through the driver: learning is three groupings, whatever the number of words.
"""

from __future__ import annotations

from pyspark.ml.functions import array_to_vector
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from orderloom.session import materialise

#: Dimensions, one for each bit of a hash; words on either side that count as neighbours.
SIZE, WINDOW = 64, 5
WORD = r"[\p{L}\p{N}]+"


def words_of(name: Column) -> Column:
    """Lower-case runs of letters and digits."""
    return F.regexp_extract_all(F.lower(name), F.lit(WORD), F.lit(0))


def _counted(names: DataFrame) -> DataFrame:
    """``id, word, times`` of ``names`` (``id, name``), counted within the row: runs of equal words once they are sorted."""
    said = names.select("id", F.array_sort(words_of(F.col("name"))).alias("said")).filter(F.size("said") > 0)
    starts = said.select("id", "said", F.expr("filter(sequence(0, size(said) - 1), i -> i = 0 OR said[i] <> said[i - 1])").alias("starts"))
    runs = F.expr("transform(starts, (i, k) -> struct(said[i] AS word, CAST(coalesce(get(starts, k + 1), size(said)) - i AS BIGINT) AS times))")
    return starts.select("id", F.explode(runs).alias("w")).select("id", "w.word", "w.times")


def _direction(word: Column) -> Column:
    """64 bits of the word's digest, as a whole number."""
    return F.conv(F.substring(F.md5(word), 1, 16), 16, -10).cast("long")


def _bit(number: Column, i: int) -> Column:
    return F.shiftrightunsigned(number, i).bitwiseAND(F.lit(1)) == 1


def word_vectors(df: DataFrame, column: str = "product_name", window: int = WINDOW, size: int = SIZE, min_count: int = 2) -> DataFrame:
    """``word, n, vector`` of words with at least ``min_count`` pairs with a neighbour.

    ``n`` counts those pairs, ``vector`` has unit length (or is zero, when no neighbour tells anything).
    At most 64 dimensions. Null and empty names have no words.
    """
    if not 0 < size <= SIZE:
        raise ValueError(f"size must lie between 1 and {SIZE}")
    beside = ", ".join(str(d) for d in range(-window, window + 1) if d)
    pairs = f"flatten(transform(words, (w, i) -> transform(array({beside}), d -> struct(w AS word, get(words, i + d) AS near))))"
    # Equal names have equal pairs, so each is taken apart once.
    names = df.filter(F.col(column).isNotNull()).groupBy(F.col(column).alias("name")).agg(F.count(F.lit(1)).alias("times"))
    said = names.select(words_of(F.col("name")).alias("words"), "times").select(F.explode(F.expr(pairs)).alias("p"), "times")
    said = said.select("p.*", "times").filter("near IS NOT NULL")
    counts = materialise(said.groupBy("word", "near").agg(F.sum("times").alias("n")))
    # A window looks both ways, so a word has as many pairs as a neighbour as it has as a word.
    totals = materialise(counts.groupBy("word").agg(F.sum("n").alias("total")).filter(F.col("total") >= min_count))
    kept = counts.join(totals, "word").join(totals.select(F.col("word").alias("near"), F.col("total").alias("near_total")), "near")
    everything = totals.agg(F.sum("total").alias("all")).first()["all"] or 0
    weight = F.greatest(F.log(F.col("n") * F.lit(float(everything)) / (F.col("total") * F.col("near_total").cast("double"))), F.lit(0.0))
    weighed = kept.select("word", "total", weight.alias("weight"), _direction(F.col("near")).alias("bits"))
    sums = weighed.groupBy("word", F.col("total").alias("n")).agg(
        *[F.sum(F.when(_bit(F.col("bits"), i), F.col("weight")).otherwise(-F.col("weight"))).alias(f"v{i}") for i in range(size)]
    )
    raw = sums.select("word", "n", F.array(*[f"v{i}" for i in range(size)]).alias("vector"))
    length = F.sqrt(F.aggregate("vector", F.lit(0.0), lambda a, x: a + x * x))
    unit = F.when(length > 0, F.transform("vector", lambda x: x / length)).otherwise(F.col("vector"))
    return materialise(raw.select("word", "n", unit.alias("vector")))


def mean_vectors(df: DataFrame, vectors: DataFrame, column: str = "product_name", size: int = SIZE) -> DataFrame:
    """Adds ``features`` (mean vector of the name's known words) and ``known_words`` to rows with a name.

    A name without known words has the zero vector. Equal names are worked out once. The words of a name are
    counted within its row and its sums begun in the same task, so of a name one row is shuffled when the
    vectors are few enough to be broadcast.
    """
    named = df.filter(F.col(column).isNotNull())
    names = named.select(F.col(column).alias("name")).distinct()
    names = materialise(names.select(F.monotonically_increasing_id().alias("id"), "name"))
    known = _counted(names).join(vectors.select("word", "vector"), "word")
    means = known.groupBy("id").agg(
        F.sum("times").alias("known_words"),
        *[(F.sum(F.col("times") * F.col("vector")[i]) / F.sum("times")).alias(f"v{i}") for i in range(size)],
    )
    means = means.select("id", "known_words", F.array(*[f"v{i}" for i in range(size)]).alias("mean"))
    found = names.join(means, "id").select(F.col("name").alias("_name"), F.col("known_words").alias("_known"), "mean")
    zero = F.array_repeat(F.lit(0.0), size)
    out = named.join(materialise(found), F.col(column) == F.col("_name"), "left")
    return out.select(
        *[F.col(c) for c in df.columns],
        F.coalesce("_known", F.lit(0)).cast("long").alias("known_words"),
        array_to_vector(F.coalesce("mean", zero)).alias("features"),
    )


def nearest_words(vectors: DataFrame, word: str, n: int = 5) -> DataFrame:
    """The ``n`` words of largest cosine with ``word``, ties to the smaller word; no rows for an unknown one."""
    found = vectors.filter(F.col("word") == word).select("vector").head()
    if found is None:
        return vectors.select("word", F.lit(0.0).alias("cosine")).limit(0)
    asked = F.array(*[F.lit(float(x)) for x in found.vector])
    cosine = F.aggregate(F.zip_with("vector", asked, lambda a, b: a * b), F.lit(0.0), lambda a, x: a + x)
    return vectors.filter(F.col("word") != word).select("word", cosine.alias("cosine")).orderBy(F.desc("cosine"), "word").limit(n)

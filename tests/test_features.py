import hashlib
import math
import random
import re
from collections import Counter

import numpy as np
import pytest
from pyspark.ml.feature import HashingTF, NGram, RegexTokenizer
from pyspark.sql import functions as F

from orderloom.operators import features, grams, models, vectors
from orderloom.plans import reports


def test_impute(spark):
    rows = [(1, 1.0, "a"), (2, None, None), (3, float("inf"), "b"), (4, 3.0, "b"), (5, float("nan"), "a"), (6, 8.0, None)]
    df = spark.createDataFrame(rows, "k int, v double, t string")
    got = {r.k: (r.v, r.t) for r in features.impute(df, ["v"], ["t"]).collect()}
    assert [got[k][0] for k in range(1, 7)] == [1.0, 3.0, 3.0, 3.0, 3.0, 8.0]
    assert got[2][1] == "missing"
    modal = {r.k: r.t for r in features.impute(df, ["v"], ["t"], "mode").collect()}
    assert modal[2] == "a" and modal[6] == "a"


def test_one_hot(spark):
    df = spark.createDataFrame([(1, "x"), (2, "y"), (3, None)], "k int, t string")
    rows = features.one_hot(df, ["t"]).orderBy("k").collect()
    assert [(r.t_x, r.t_y) for r in rows] == [(1, 0), (0, 1), (0, 0)]
    given = features.one_hot(df, ["t"], {"t": ["y", "z"]}).orderBy("k").collect()
    assert [(r.t_y, r.t_z) for r in given] == [(0, 0), (1, 0), (0, 0)]


def test_one_hot_vectors_take_any_number_of_levels(spark):
    df = spark.range(1500).select("id", F.when(F.col("id") > 0, F.format_string("l%04d", "id")).alias("t"))
    rows = {r.id: r.t_vector for r in features.one_hot_vectors(df, ["t"]).collect()}
    assert {v.size for v in rows.values()} == {1499}
    assert rows[0].numNonzeros() == 0
    assert all(list(rows[i].indices) == [i - 1] for i in (1, 700, 1499))


def mean_ranks(values):
    order = sorted(values)
    return [np.mean([i for i, o in enumerate(order) if o == v]) for v in values]


def test_spearman_against_numpy(spark):
    rng = random.Random(2)
    rows = [(float(rng.randint(0, 5)), rng.random(), 1.0, rng.randint(1, 3)) for _ in range(200)]
    df = spark.createDataFrame(rows, "a double, b double, flat double, y int")
    got = {r.metric: r.spearman for r in features.spearman(df, ["a", "b", "flat"], "y").collect()}
    columns = list(zip(*rows))
    for i, name in enumerate(["a", "b"]):
        assert got[name] == pytest.approx(np.corrcoef(mean_ranks(columns[i]), mean_ranks(columns[3]))[0, 1])
    assert got["flat"] is None
    assert {r.metric for r in features.strongest(features.spearman(df, ["a", "b", "flat"], "y"), 1).collect()} <= {"a", "b"}


def test_spearman_leaves_out_null_pairs(spark):
    rows = [(1.0, 1), (2.0, 2), (None, 9), (3.0, 3), (9.0, None)]
    df = spark.createDataFrame(rows, "a double, y int")
    assert features.spearman(df, ["a"], "y").first().spearman == pytest.approx(1.0)


@pytest.mark.parametrize("fraction", [0.0, 0.2, 0.25, 1.0])
def test_split_is_exact_and_complete(spark, fraction):
    rows = [(i, "a" if i < 37 else "b" if i < 40 else None) for i in range(48)]
    df = spark.createDataFrame(rows, "id int, label string")
    out = features.stratified_split(df, "label", "id", fraction)
    got = {r.label: (r.n, r.t) for r in out.groupBy("label").agg(F.count("id").alias("n"), F.count_if("is_test").alias("t")).collect()}
    assert {k: v[0] for k, v in got.items()} == {"a": 37, "b": 3, None: 8}
    assert all(t == int(fraction * n) for n, t in got.values())


def test_split_resolves_equal_draws(spark, monkeypatch):
    monkeypatch.setattr(features, "split_key", lambda identity, seed: F.lit(5).cast("long"))
    df = spark.range(40).withColumn("label", (F.col("id") % 2).cast("string"))
    out = features.stratified_split(df, "label", "id", 0.25)
    assert {r.label: r.t for r in out.groupBy("label").agg(F.count_if("is_test").alias("t")).collect()} == {"0": 5, "1": 5}


def test_feature_columns_drop_leaks(spark):
    df = spark.createDataFrame([(1, "A", 1.0, True, "x", 2.0)], "customer_id int, user_type string, avg_monthly_orders double, flag boolean, city_kind string, v double")
    assert features.feature_columns(df) == (["flag", "v"], ["city_kind"])
    assert features.feature_columns(df, keep_leaking=True)[0] == ["avg_monthly_orders", "flag", "v"]


def test_metrics_with_a_class_never_predicted(spark):
    pairs = [("a", "a")] * 4 + [("a", "b")] * 2 + [("b", "b")] * 3 + [("b", "a")] + [("c", "a")] * 2
    got = {r["class"]: r for r in models.classification_metrics(spark.createDataFrame(pairs, "y string, p string"), "y", "p").collect()}
    assert (got["c"].precision, got["c"].recall, got["c"].f1, got["c"].support) == (0.0, 0.0, 0.0, 2)
    assert got["a"].precision == pytest.approx(4 / 7) and got["a"].recall == pytest.approx(4 / 6)
    assert got["accuracy"].f1 == pytest.approx(7 / 12) and got["accuracy"].support == 12
    assert got["macro avg"].recall == pytest.approx((4 / 6 + 3 / 4) / 3)
    assert got["weighted avg"].recall == pytest.approx(7 / 12)


def test_class_weights_balance(spark):
    df = spark.createDataFrame([("a",)] * 6 + [("b",)] * 2, "y string")
    totals = {r.y: r.w for r in models.class_weights(df, "y").groupBy("y").agg(F.sum("weight").alias("w")).collect()}
    assert totals == pytest.approx({"a": 4.0, "b": 4.0})


WORDS = {"drink": ("cola zero", "fanta lemon", "aqua water", "cola light"), "other": ("pizza big", "burger beef", "salad greek", "pizza rucola")}


def training(spark, countries=("A", "B")):
    rows, i = [], 0
    for country in countries:
        for n in range(15):
            for label, names in WORDS.items():
                rows.append((i, country, f"{names[n % 4]} {n % 5}", label))
                i += 1
    rows.append((i, "A", None, "drink"))
    return spark.createDataFrame(rows, "id int, order_country_code string, product_name string, Category string")


def test_models_by_country(spark):
    fitted, tested = models.fit_by_country(training(spark), "id", trees=10)
    assert set(fitted) == {"A", "B"}
    rows = tested.collect()
    assert len(rows) == 12 and sum(r.Category == r.predicted_category for r in rows) > 7
    ask = spark.createDataFrame([("A", "cola light 3"), ("C", "cola"), ("B", None), ("B", "pizza big")], "order_country_code string, product_name string")
    got = models.predict_by_country(ask, fitted).collect()
    assert sorted((r.order_country_code, r.product_name) for r in got) == [("A", "cola light 3"), ("B", "pizza big")]
    assert {r.predicted_category for r in got} <= {"drink", "other"}


def test_gram_counts_are_those_of_the_plain_stages(spark):
    rng = random.Random(9)
    letters = "abcDE é☃ИΣ\n\u2028😀İ字"
    rows = ["", "ab", "Abc", "😀", "x😀", "ΑΣ ΑΣ.", "a" * 3000, *["".join(rng.choices(letters, k=rng.randint(0, 60))) for _ in range(200)]]
    rows.append("".join(chr(rng.randint(0x4E00, 0x9FFF)) for _ in range(500)))
    df = spark.createDataFrame(list(enumerate(rows)), "id int, product_name string").repartition(3)
    for n, width in ((3, 1 << 12), (2, 100), (5, 1 << 18)):
        plain = RegexTokenizer(inputCol="product_name", outputCol="l", pattern="", minTokenLength=1).transform(df)
        plain = HashingTF(numFeatures=width, inputCol="g", outputCol="want").transform(NGram(n=n, inputCol="l", outputCol="g").transform(plain))
        stage, *_ = models.text_stages(n=n, width=width)
        got = stage.transform(plain).collect()
        assert isinstance(stage, grams.GramCounts) and all(r._tf == r.want for r in got)


def test_gram_places_are_kept_between_batches(monkeypatch):
    """A gram is hashed once by a worker, not once in each batch; the tables stay small and the counts are plain ones."""
    hashed = []
    plain = grams._places
    monkeypatch.setattr(grams, "_places", lambda letters, width: hashed.append(len(letters)) or plain(letters, width))
    monkeypatch.setattr(grams, "_tables", {}, raising=False)

    def check(texts, n=3, width=1 << 10):
        held, places, counts = grams.gram_counts(texts, n, width)
        said = ["".join("??" if ord(c) > 0xFFFF else c for c in t) for t in texts]
        for text in said:
            of = [" ".join(text[i : i + n]).encode() for i in range(len(text) - n + 1)]
            at = [int(grams.murmur3(np.frombuffer(g, np.uint8)[None]).view(np.int32)[0]) % width for g in of]
            size, held = held[0], held[1:]
            assert dict(zip(places[:size].tolist(), counts[:size].tolist())) == dict(Counter(at))
            places, counts = places[size:], counts[size:]

    check(["abcabc", "", "ab", "bca cab"])
    check(["abcabc", "bca cab"])
    first = sum(hashed)
    for _ in range(3):
        check(["abcabc", "bca cab"])
    assert first > 0 and sum(hashed) == first
    # New letters, letters beyond 16 bits, and alphabets that have no room in one table or in any.
    for texts in (["abcé", "x\U0001F600y"], ["".join(map(chr, range(0x100, 0x190)))], ["".join(map(chr, range(0x4E00, 0x5000)))], ["abcabc"]):
        check(texts)
    assert all(len(t.place) <= grams._CELLS for t in grams._tables.values())


def test_word_vectors_find_neighbours(spark):
    """Words that stand in the same places are near; the rest is not. Everything against plain sums."""
    rng = random.Random(3)
    rows = [(f"{rng.choice(['cola', 'fanta', 'sprite'])} drink {rng.choice(['cold', 'ice'])} can",) for _ in range(60)]
    rows += [(f"{rng.choice(['pizza', 'burger', 'salad'])} hot {rng.choice(['big', 'box'])} Tomato",) for _ in range(60)]
    rows += [(None,), ("",), ("single",), ("!!",)]
    df = spark.createDataFrame(rows, "product_name string").repartition(3)
    found = vectors.word_vectors(df)
    near = {w: [r.word for r in vectors.nearest_words(found, w, 2).collect()] for w in ("cola", "pizza", "nothing")}
    assert set(near["cola"]) == {"fanta", "sprite"} and set(near["pizza"]) == {"burger", "salad"} and near["nothing"] == []
    counts = Counter()
    for (name,) in rows:
        said = re.findall(r"\w+", (name or "").lower())
        counts.update((said[i], said[j]) for i in range(len(said)) for j in range(max(0, i - 5), min(len(said), i + 6)) if i != j)
    total = Counter()
    for (w, _), n in counts.items():
        total[w] += n
    want = {}
    for w in total:
        v = np.zeros(64)
        for x in total:
            if counts[w, x]:
                weight = max(math.log(counts[w, x] * sum(total.values()) / (total[w] * total[x])), 0.0)
                bits = int(hashlib.md5(x.encode()).hexdigest()[:16], 16)
                v += weight * np.array([1 if bits >> i & 1 else -1 for i in range(64)])
        want[w] = v / (np.linalg.norm(v) or 1)
    got = {r.word: (r.n, r.vector) for r in found.collect()}
    assert {w: n for w, (n, _) in got.items()} == total
    assert all(got[w][1] == pytest.approx(want[w].tolist(), abs=1e-9) for w in want)
    asked = spark.createDataFrame([(1, "Cola cola PIZZA"), (2, "unknown"), (3, ""), (4, None), (5, "Cola cola PIZZA")], "id int, product_name string")
    means = {r.id: (r.known_words, r.features.toArray().tolist()) for r in vectors.mean_vectors(asked, found).collect()}
    assert set(means) == {1, 2, 3, 5} and means[2] == means[3] == (0, [0.0] * 64) and means[1] == means[5]
    assert means[1] == (3, pytest.approx(((2 * want["cola"] + want["pizza"]) / 3).tolist(), abs=1e-9))


def test_equal_names_and_words_are_folded_early(spark, monkeypatch):
    """Equal names are taken apart once; of a name one row is shuffled when the vectors are broadcast."""
    plans = []
    kept = vectors.materialise
    monkeypatch.setattr(vectors, "materialise", lambda df: plans.append(df._jdf.queryExecution()) or kept(df))
    rows = [(i, ["ice cola b a a", "a a", "cola ice"][i % 3]) for i in range(30)]
    df = spark.createDataFrame(rows, "id int, product_name string")
    found = vectors.word_vectors(df)
    assert re.search(r"Generate explode.*Aggregate \[", plans[0].optimizedPlan().toString(), re.S)
    assert {r.word: r.n for r in found.collect()} == {"ice": 10 * 5, "cola": 10 * 5, "b": 10 * 4, "a": 10 * (2 * 4 + 2)}
    plans.clear()
    assert {r.known_words for r in vectors.mean_vectors(df, found).collect()} == {2, 5}
    assert plans and not any(re.search(r"hashpartitioning\([^)]*word#", q.executedPlan().toString()) for q in plans)


def test_models_on_word_vectors(spark):
    """Names of one category share no word with those of the other."""
    train = training(spark).withColumn("product_name", F.regexp_replace("product_name", " [0-9]", ""))
    found = vectors.word_vectors(train)
    fitted, tested = models.fit_by_country(train, "id", trees=10, vectors=found)
    rows = tested.collect()
    assert len(rows) == 12 and all(r.Category == r.predicted_category for r in rows)
    ask = spark.createDataFrame([("A", "cola light"), ("C", "cola"), ("B", None), ("B", "pizza big")], "order_country_code string, product_name string")
    got = {(r.order_country_code, r.product_name): r.predicted_category for r in models.predict_by_country(ask, fitted, found).collect()}
    assert got == {("A", "cola light"): "drink", ("B", "pizza big"): "other"}


def test_country_with_one_category(spark):
    rows = [(i, "A", f"cola {i}", "drink") for i in range(10)]
    df = spark.createDataFrame(rows, "id int, order_country_code string, product_name string, Category string")
    fitted, tested = models.fit_by_country(df, "id", trees=3)
    assert tested.count() == 2
    ask = spark.createDataFrame([("A", "x")], "order_country_code string, product_name string")
    assert models.predict_by_country(ask, fitted).first().predicted_category == "drink"


def test_binary_model_and_reload(spark, tmp_path):
    model, tested = models.fit_binary(training(spark), "id", "A")
    rows = tested.collect()
    assert len(rows) == 6 and {r.label for r in rows} == {0.0, 1.0}
    assert all((r.label == 1) == (r.predicted_category == "drink") for r in rows)
    models.save_model(model, str(tmp_path / "m"))
    ask = spark.createDataFrame([("cola zero",)], "product_name string")
    assert models.load_model(str(tmp_path / "m")).transform(ask).first().predicted_category == "drink"


def make_encoder():
    def encode(texts):
        return np.array([[float(len(t)), float("nan") if "bad" in t else 1.0] for t in texts], dtype=np.float32)

    return encode


def test_encoder_of_the_user(spark):
    df = spark.createDataFrame([("ab",), ("bad",), (None,)], "product_name string")
    rows = models.encoded_vectors(df, make_encoder).collect()
    assert [(r.product_name, list(r.features)) for r in rows] == [("ab", [2.0, 1.0])]


def test_user_type_model(spark):
    rng = random.Random(4)
    rows = []
    for i in range(120):
        kind = "ABC"[i % 3]
        rows.append((i, kind, {"A": 3.0, "B": 2.0, "C": 1.0}[kind] + rng.random() / 2, rng.random(), "web" if i % 2 else None))
    df = spark.createDataFrame(rows, "customer_id int, user_type string, signal double, noise double, origin string")
    parts = reports.user_type_model(df, trees=10)
    top = parts["importances"].first()
    assert top.feature == "signal"
    assert parts["correlations"].first().metric == "signal"
    report = {r["class"]: r.f1 for r in parts["report"].collect()}
    assert report["accuracy"] > 0.8 and {"A", "B", "C"} <= set(report)
    assert sum(r.n for r in parts["confusion"].collect()) == 30


def test_spearman_leaves_nan_pairs_out(spark):
    nan = float("nan")
    df = spark.createDataFrame([(1.0, 1.0), (2.0, 2.0), (3.0, 3.0), (nan, 0.0), (0.0, nan), (None, 5.0)], "a double, y double")
    assert features.spearman(df, ["a"], "y").first().spearman == pytest.approx(1.0)


def test_split_is_exact_for_awkward_sizes(spark):
    for n in (1130, 1171, 1173):
        df = spark.range(n).withColumn("label", F.lit("x"))
        assert features.stratified_split(df, "label", "id", 0.2).filter("is_test").count() == int(0.2 * n)


def test_texts_are_tested_for_nulls_below_the_join(spark, monkeypatch):
    """The split of the rows needs their ids and labels only, so no text may be shuffled for it."""
    seen = []

    def caught(df, *_):
        seen.append(df)
        raise InterruptedError

    monkeypatch.setattr(models, "stratified_split", caught)
    names = spark.createDataFrame([(1, "PL", "a"), (2, "PL", None), (3, None, "b"), (4, "PL", "")], "id long, order_country_code string, product_name string")
    kinds = spark.createDataFrame([(1, "drink"), (2, "drink"), (3, "other"), (4, None), (4, "other")], "id long, Category string")
    for fit, kept in ((lambda df: models.fit_binary(df, "id", "PL"), [1, 4]), (lambda df: models.fit_by_country(df, "id"), [1, 4]), (lambda df: models.fit_binary(df, "id"), [1, 3, 4])):
        with pytest.raises(InterruptedError):
            fit(names.join(kinds, "id"))
        ids = seen[-1].select("id")
        assert sorted(r.id for r in ids.collect()) == kept
        plan = ids._jdf.queryExecution().optimizedPlan().toString().splitlines()
        joined = [line for line in plan if "Join Inner" in line or "Project [" in line]
        assert len(joined) > 2 and not any("product_name" in line for line in joined)

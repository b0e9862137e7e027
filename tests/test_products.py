import datetime as dt
import random

import pytest

from orderloom.operators import catalogue, drinks, rules
from orderloom.operators.orders import spread_key
from orderloom.schemas import SCHEMAS
from tests.test_orders import AS_OF, T, fact, facts


def products(spark, rows):
    return spark.createDataFrame(rows, "order_country_code string, product_id bigint, product_name string, predicted_category string")


def test_rule_order_by_country(spark):
    rows = [
        ("KZ", 1, "Кола и фри", " OTHER"),       # food and drink word: the drink step is later
        ("PL", 2, "Cola i lody", "drink"),        # renamed before the food step: stays a drink
        ("PL", 3, "Sok i lody", None),            # food step is later
        ("AM", 4, "Հանքային ջուր", "other"),      # water stands in both lists: drink wins
        ("UA", 5, "Компот", "other"),             # the compote words are switched off there
        ("KG", 6, "Компот", "other"),
        ("GE", 7, "კოლა", None),
        ("KZ", 8, None, " Drink "),
        ("XX", 9, "cola", " Drink "),
        ("KZ", 10, "Плов", None),
    ]
    got = {r.product_id: (r.product_name, r.predicted_category, r.relabelled) for r in catalogue.apply_rules(products(spark, rows)).collect()}
    assert got[1] == ("cocacola", "drink", True)
    assert got[2] == ("cocacola", "drink", False)
    assert got[3] == ("Sok i lody", "other", True)
    assert got[4][1:] == ("drink", True)
    assert got[5][1:] == ("other", False)
    assert got[6][1:] == ("drink", True)
    assert got[7] == ("cocacola", "drink", True)
    assert got[8] == (None, "drink", False)
    assert got[9] == ("cola", "drink", False)
    assert got[10] == ("Плов", None, False)


def by_steps(name, category, steps, target):
    """One row through ordered steps ``(words, category, rename)``, plainly; and its changes to ``target``."""
    base = now = category.strip().lower() if category is not None else None
    changes = 0
    for words, new, rename in steps:
        if name is not None and any(w and w.lower() in name.lower() for w in words):
            changes += new == target and now != target
            now = new if new is not None else now
            name = rename if rename is not None else name
    return name, now, now != base, changes


def test_rules_of_a_table(spark):
    """Ten thousand words; new texts that later steps look at, in chains; words of one letter; nulls."""
    random.seed(1)
    letters = "abcdeкола "
    table, plain = [], {}
    for country in ("A", "B"):
        plain[country] = []
        for step in range(12):
            words = list({"".join(random.choices(letters, k=random.choice([1, 2, 3, 5, 8, 9]) if n < 3 else 7)) for n in range(420)})
            rename = random.choice([None, "Abc кол", "dead end", "кола"]) if step % 2 else None
            new = random.choice(["drink", "other", None]) if rename else random.choice(["drink", "other"])
            # Short words in few steps only, or they match everywhere.
            words = [w.upper() if len(w) == 5 else w for w in words if len(w) > 2 or step in (3, 8)]
            plain[country].append((words, new, rename))
            table += [(country, step, w, new, rename) for w in words]
    table += [("A", 0, "", plain["A"][0][1], None), ("A", 0, None, plain["A"][0][1], None), (None, 1, "a", "drink", None), ("A", 0, plain["A"][0][0][0], plain["A"][0][1], None)]
    assert len(table) > 10_000
    rows = []
    for i in range(600):
        name = "".join(random.choices(letters + "ABxyz", k=random.randint(0, 30)))
        rows.append((random.choice("ABC"), i, random.choice([name, name, "Abc", None]), random.choice([" Drink", "other", None])))
    df = products(spark, rows).repartition(3)
    ruled = spark.createDataFrame(table, rules.RULE_SCHEMA)
    got = {r.product_id: (r.product_name, r.predicted_category, r.relabelled) for r in catalogue.apply_rules(df, ruled).collect()}
    want = {i: by_steps(name, category, plain.get(country, []), "other") for country, i, name, category in rows}
    assert got == {i: w[:3] for i, w in want.items()}
    assert {w[0] for w in want.values()} & {"Abc кол", "dead end", "кола"}
    changes = {r.order_country_code: r.changes for r in catalogue.rule_change_counts(df, ruled).collect()}
    assert changes == {c: sum(want[i][3] for country, i, _, _ in rows if country == c) for c in "ABC"}


def test_new_texts_follow_one_another(spark):
    steps = [(("x",), None, "yy"), (("Y",), "other", "zz"), (("x", "q"), "drink", "never"), (("z",), "drink", None), (("z",), "other", "ww"), (("w",), "drink", "w2"), (("v",), "other", None)]
    ruled = spark.createDataFrame([("A", i, w, new, text) for i, (words, new, text) in enumerate(steps) for w in words], rules.RULE_SCHEMA)
    rows = [("A", i, name, "other") for i, name in enumerate(["ax", "ay", "aq", "az", "av", "none", None])]
    got = {r.product_id: (r.product_name, r.predicted_category, r.relabelled) for r in catalogue.apply_rules(products(spark, rows), ruled).collect()}
    assert got == {i: by_steps(name, category, steps, "other")[:3] for _, i, name, category in rows} and got[0][0] == "w2"


def test_plan_of_a_rule_table_does_not_grow_with_its_words(spark):
    def size(words):
        ruled = spark.createDataFrame([("A", 0, f"word{i}", "drink", None) for i in range(words)], rules.RULE_SCHEMA)
        out = catalogue.apply_rules(products(spark, [("A", 1, "a word7 b", None)]), ruled)
        assert out.first().predicted_category == "drink"
        return len(out._jdf.queryExecution().optimizedPlan().toString().split("\n"))

    assert size(10) == size(3000)


def test_words_are_looked_for_in_tokens(spark):
    """Plain, pieced and blank words against brute force; without the last two no text is searched."""
    random.seed(5)
    names = [(random.choice("AB"), i, "".join(random.choices("abc \t\n", k=random.randint(0, 40)))) for i in range(300)]
    held = spark.createDataFrame(names, "order_country_code string, id long, name string")
    plain = ["a", "ab", "abc", "cabbc", "zz"]
    for words in (plain, [*plain, "a b", " c", "\tb", "a  c", "ab c a", "zz a", " ", "\n\t"]):
        ruled = [(country, step % 4, word) for country in "A" for step, word in enumerate(words)]
        hits = rules.step_hits(held, spark.createDataFrame(ruled, "order_country_code string, step int, word string"))
        want = {(c, i, step) for c, i, name in names for country, step, word in ruled if c == country and word in name}
        got = [tuple(r) for r in hits.collect()]
        assert len(got) == len(set(got)) and set(got) == want
        assert ("Contains" in hits._jdf.queryExecution().optimizedPlan().toString()) == (words is not plain)


def test_empty_rule_table(spark):
    df = products(spark, [("A", 1, "cola", " Drink"), (None, 2, None, None)])
    for ruled in (spark.createDataFrame([], rules.RULE_SCHEMA), rules.rule_table(spark, {"A": (catalogue.Rule(("",), "other"),)})):
        got = {tuple(r) for r in catalogue.apply_rules(df, ruled).select("product_id", "product_name", "predicted_category", "relabelled").collect()}
        assert got == {(1, "cola", "drink", False), (2, None, None, False)}


def test_change_counts(spark):
    rows = [("KZ", 1, "Кола и фри", "other"), ("KZ", 2, "фри", None), ("KZ", 3, "соус", "drink"), ("PL", 4, "Sok i lody", "other"), ("PL", 5, "cola lody", "drink")]
    got = {r.order_country_code: r.changes for r in catalogue.rule_change_counts(products(spark, rows)).collect()}
    assert got == {"KZ": 2, "PL": 1}
    first = catalogue.rule_change_counts(products(spark, [("KZ", 1, "ЧИКЕН ролл", None)]), catalogue.FIRST_PASS_RULES)
    assert first.first().changes == 1


def predictions(spark, rows):
    return spark.createDataFrame([("A", "any", p, f"n{p}", c) for p, c in rows], SCHEMAS["product_predictions"])


def test_one_category_per_product(spark):
    got = catalogue.one_category(predictions(spark, [(1, "other"), (1, " Drink"), (2, "b"), (2, "a"), (3, None), (4, "  ")]))
    assert {r.product_id: r.predicted_category for r in got.collect()} == {1: "drink", 2: "a"}


LINES = "order_country_code string, order_city_code string, store_name string, order_id bigint, order_transacted_value_local double, order_transacted_value_eur double, product_id bigint, product_name string, bought_product_quantity bigint, top_partner boolean"


@pytest.fixture(scope="module")
def lines(spark):
    rows = [
        ("A", "X", "s1", 1, 40.0, 10.0, 1, "Coca-Cola 500 ml", 2, True),
        ("A", "X", "s1", 1, 40.0, 10.0, 2, "Pizza", 1, True),
        ("A", "X", "s1", 2, 80.0, 20.0, 1, "Coca Cola", 5, True),
        ("A", "X", "s2", 3, 120.0, 30.0, 2, "Pizza", 1, True),
        ("A", "Y", "s2", 4, 4.0, 1.0, 9, "Unknown", 1, True),
        ("A", "Y", "s3", 5, 8.0, 2.0, 3, "Water", 7, False),
        ("A", "Y", None, 6, 8.0, 2.0, None, None, None, False),
        ("B", "Z", "s4", 7, 8.0, 2.0, 9, "Unknown", 1, True),
    ]
    return spark.createDataFrame(rows, LINES)


@pytest.fixture(scope="module")
def labels(spark):
    return predictions(spark, [(1, "drink"), (1, "other"), (2, "other"), (3, "Drinks"), (9, "")])


def test_kpis(lines, labels):
    got = {r.order_country_code: r for r in drinks.drinks_kpis(lines, labels).collect()}
    a, b = got["A"], got["B"]
    assert (a.orders, a.orders_with_drinks, a.labelled_lines, a.unlabelled_lines) == (4, 3, 5, 1)
    assert (a.aov_eur, a.aov_local) == (15.5, 62.0)
    assert (a.aov_eur_drinks, a.aov_eur_no_drinks) == (10.67, 30.0)
    assert a.pct_only_drinks == 66.67 and a.pct_partners_with_drinks == 50.0
    assert (b.orders, b.aov_eur, b.unlabelled_lines, b.pct_only_drinks) == (0, None, 1, 0.0)


def test_partner_report(lines, labels):
    got = [tuple(r) for r in drinks.partner_drinks(lines, labels).collect()]
    assert got == [("A", "s1", 2, 2, 15.0, None, 15.0), ("A", "s2", 0, 1, None, 30.0, 30.0)]


def test_partners_without_brand(lines, labels):
    assert [tuple(r) for r in drinks.partners_without_brand(lines, labels).collect()] == [("A", "s2", 1)]


def test_top_names_fold_spellings(lines, labels):
    got = [tuple(r) for r in drinks.top_product_names(lines, labels).collect()]
    assert got == [("cocacola", 7), ("water", 7)]


def test_uncategorised(lines, labels):
    assert [r.product_id for r in catalogue.uncategorised(lines, labels).collect()] == [9]


def offer(spark, rows):
    return spark.createDataFrame(rows, SCHEMAS["product_availability"])


def test_catalogue_and_dry_stores(spark, lines, labels):
    day = dt.date(2024, 6, 20)
    sold = facts(
        spark,
        [
            fact(1, 1, T(2024, 6, 1), store_name="s1", store_address_id=1),
            fact(2, 1, T(2024, 6, 1), store_name="s2", store_address_id=2),
            fact(3, 1, T(2024, 6, 1), store_name="s2", store_address_id=3, order_city_code="Y", order_parent_relationship_type="CHILD"),
            fact(4, 1, T(2024, 1, 1), store_name="old", store_address_id=4),
        ],
    )
    offers = offer(
        spark,
        [
            (1, 1, "Cola", True, day), (1, 1, "Cola", True, dt.date(2024, 6, 21)), (1, 2, "Pizza", False, day),
            (2, 2, "Pizza", True, day), (3, 2, "Pizza", True, day), (3, 5, None, True, day),
            (2, 8, "Late", True, dt.date(2024, 7, 1)), (4, 1, "Cola", True, day),
        ],
    )
    found = catalogue.available_products(sold, offers, AS_OF, 90, ["A"], with_city=True)
    assert sorted((r.order_city_code, r.store_name, r.product_id) for r in found.collect()) == [
        ("X", "s1", 1), ("X", "s2", 2), ("Y", "s2", 2),
    ]
    dry = drinks.stores_without_drinks(found, labels, lines)
    assert {tuple(r) for r in dry.collect()} == {("A", "X", "s2", 1), ("A", "Y", "s2", None)}
    one = catalogue.store_catalogue(sold, offers, labels, "s2", AS_OF, 90)
    assert {r.predicted_category for r in one.collect()} == {"other"}


def test_rows_without_a_product_are_spread(spark):
    lines = spark.range(1000).selectExpr("id AS order_id", "CASE WHEN id % 10 = 0 THEN id % 20 END AS product_id")
    predictions = spark.createDataFrame([("A", "s", 0, "n", " Drink")], SCHEMAS["product_predictions"])
    got = catalogue.with_category(lines, predictions, keep_unlabelled=True)
    assert set(got.columns) == {"order_id", "product_id", "predicted_category"} and got.count() == 1000
    assert got.filter("predicted_category = 'drink'").count() == got.filter("product_id = 0").count() == 50
    keys = lines.select(spread_key("product_id", "order_id").alias("k"))
    assert max(r["count"] for r in keys.groupBy("k").count().collect()) == 50

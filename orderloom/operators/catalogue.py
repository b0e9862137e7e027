"""Product catalogue, categories and keyword relabelling."""

from __future__ import annotations

import datetime as dt
from collections.abc import Iterable, Mapping, Sequence
from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from orderloom.functions.dates import days_back, since_days
from orderloom.functions.numbers import blank_columns
from orderloom.functions.text import canonical_category, contains_sql, sql_text
from orderloom.operators.orders import delivered, spread_key
from orderloom.operators.rules import apply_rule_table, rule_table_changes
from orderloom.session import materialise
from orderloom.sources.tables import for_values

DRINK_CATEGORIES = ("drink", "drinks")

# Words of food and drink product names, by the country that uses them.
FIRST_PASS_FOOD = ("чикен", "хотдог", "кебаб", "бургер", "попкорн", "ролл")
COMMON_FOOD = (
    "соус", "кисло", "фри", "хлеб", "Пепперони", "peperoni", "Пепероні", "Карбонара", "karbonara",
    "пампушки", "Pampushk", "макпиріг", "прилади", "картопля", "хліб", "твістер", "курячий", "сметана",
)
LATIN_FOOD = (
    "abaidoner", "aitvister", "chickenp", "turkebab", "hotdog", "soussyrnyi", "bigburger", "popcorn",
    "aitvisterboks", "roll", "kostnyibulon", "aitvisterkombo", "taiskiichaiszhemchugom", "filadelfiialiuks",
)
ARMENIAN_FOOD = (
    "լանչ", "դոլմա", "հանքային ջուր", "սուրճ", "աղբյուրի ջուր", "նարնջի բնական հյութ", "աղցան",
    "լոլիկի հյութ", "թան գիգանտ", "հավի կրծքամիս", "կարագով հավ", "ամերիկյան դեղին", "մածնաբրդոշ",
    "հնդկահավի սենդվիչ", "սոուսով խաղցր",
)
POLISH_FOOD = (
    "ciacho", "biala czekolada", "lody", "chikker", "McPops", "smaku waniliowym z polewą ",
    "Карбонара", "karbonara", "пампушки", "Pampushk", "макпиріг", "прилади", "картопля", "хліб",
    "твістер", "курячий", "сметана",
)
CYRILLIC_COLA = ("coca", "кока", "Koka", "Кола", "Kola")
CYRILLIC_DRINKS = ("pepsi", "пепси", "sprite", "спрайт", "fanta", "фанта", "water", "вода")
CENTRAL_ASIAN_DRINKS = (
    "kompot", "компот", "mirinda", "миринда", "redbull", "редбул", "lemonade", "лимонад", "7up",
)
GEORGIAN_COLA = ("კოკა", "კოლა")
GEORGIAN_DRINKS = (
    "პეპსი", "სპრაიტი", "ფანტა", "წყალი", "მთისწყალი", "ბაკურიანისწყალი", "მინერალური", "კომპოტი",
    "მირინდა", "რედბული", "ლიმონათი", "7up",
)
ARMENIAN_COLA = ("կոկա", "կոկակոլա", "կոլա")
ARMENIAN_DRINKS = (
    "փեփսի", "սփրայթ", "ֆանտա", "ջուր", "աղբյուրի ջուր", "հանքային ջուր", "միներալ ջուր", "կոմպոտ",
    "միրինդա", "ռեդբուլ", "լիմոնադ", "7up",
)
POLISH_COLA = ("coca", "cola")
POLISH_DRINKS = (
    "pepsi", "пепси", "sprite", "спрайт", "fanta", "фанта", "water", "вода", "woda", "kompot", "компот",
    "sok", "juice", "сок", "herbata", "ice tea", "чай", "kefir", "кефир", "zbyszko", "oranżada",
    "оранжада", "Lemoniada",
)
UKRAINIAN_DISABLED_DRINKS = ("Kompot", "Компот")
COLA_NAME = "cocacola"


class Rule(NamedTuple):
    """Where a name holds one of ``words``: set the category and, if given, the name."""

    words: tuple[str, ...]
    category: str
    rename: str | None = None


FOOD_THEN_DRINK_LATIN = (
    Rule(COMMON_FOOD + LATIN_FOOD, "other"),
    Rule(CYRILLIC_DRINKS + CENTRAL_ASIAN_DRINKS, "drink"),
    Rule(CYRILLIC_COLA, "drink", COLA_NAME),
)
# Ordered rules: a later rule wins. Cola comes last among drinks, which changes nothing
# but keeps the renamed text out of the other drink tests.
COUNTRY_RULES: dict[str, tuple[Rule, ...]] = {
    "KZ": FOOD_THEN_DRINK_LATIN,
    "KG": FOOD_THEN_DRINK_LATIN,
    "GE": (
        Rule(COMMON_FOOD + LATIN_FOOD, "other"),
        Rule(GEORGIAN_DRINKS, "drink"),
        Rule(GEORGIAN_COLA, "drink", COLA_NAME),
    ),
    "AM": (
        Rule(COMMON_FOOD + ARMENIAN_FOOD, "other"),
        Rule(ARMENIAN_DRINKS, "drink"),
        Rule(ARMENIAN_COLA, "drink", COLA_NAME),
    ),
    "UA": (
        Rule(COMMON_FOOD, "other"),
        Rule(CYRILLIC_DRINKS, "drink"),
        Rule(CYRILLIC_COLA, "drink", COLA_NAME),
    ),
    "PL": (
        Rule(POLISH_DRINKS, "drink"),
        Rule(POLISH_COLA, "drink", COLA_NAME),
        Rule(POLISH_FOOD, "other"),
    ),
}
FIRST_PASS_RULES: dict[str, tuple[Rule, ...]] = {"KZ": (Rule(FIRST_PASS_FOOD, "other"),)}


def available_products(
    order_facts: DataFrame,
    availability: DataFrame,
    as_of: dt.date,
    days: int = 90,
    countries: Iterable[str] | None = None,
    store: str | None = None,
    partners: DataFrame | None = None,
    with_city: bool = False,
    vertical: str = "Food",
    snapshot_days: int | None = None,
) -> DataFrame:
    """Distinct products offered in the window at addresses with delivered orders.

    ``partners`` (``order_country_code``, ``store_name``) keeps listed stores only. The
    addresses are written first, so that with a known size a short list filters the daily
    snapshots by a broadcast, before anything is shuffled. The snapshots of a product at an
    address fold to one row before they meet the places of the address.
    """
    place = ["order_country_code", *(["order_city_code"] if with_city else []), "store_name"]
    rows = for_values(order_facts, "order_country_code", countries).filter(
        delivered(root_only=False)
        & (F.col("order_vertical") == vertical)
        & since_days(F.col("order_activated_local_at"), as_of, days)
    )
    if store is not None:
        rows = rows.filter(F.col("store_name") == store)
    addresses = rows.select(*place, "store_address_id").distinct()
    if partners is not None:
        listed = partners.select("order_country_code", "store_name").distinct()
        addresses = addresses.join(listed, ["order_country_code", "store_name"], "left_semi")
    span = days if snapshot_days is None else snapshot_days
    offered = availability.filter(
        F.col("p_snapshot_date").between(F.lit(days_back(as_of, span)), F.lit(as_of))
        & F.col("product_is_available")
        & F.col("product_name").isNotNull()
    ).select("store_address_id", "product_id", "product_name")
    addresses = materialise(addresses)
    offered = offered.join(addresses.select("store_address_id"), "store_address_id", "left_semi").distinct()
    return (
        offered.join(addresses, "store_address_id")
        .select(*place, "product_id", "product_name")
        .distinct()
    )


def one_category(predictions: DataFrame) -> DataFrame:
    """One category per product: a drink category wins, then the smallest text."""
    category = canonical_category(F.col("predicted_category"))
    return (
        predictions.filter(category != "")
        .groupBy("product_id")
        .agg(
            F.min(F.when(category.isin(*DRINK_CATEGORIES), category)).alias("_drink"),
            F.min(category).alias("_any"),
        )
        .select("product_id", F.coalesce("_drink", "_any").alias("predicted_category"))
    )


def is_drink(category: Column) -> Column:
    return F.coalesce(category.isin(*DRINK_CATEGORIES), F.lit(False))


def with_category(rows: DataFrame, predictions: DataFrame, keep_unlabelled: bool = False) -> DataFrame:
    """Category of each row's product; rows without one are dropped unless asked for.

    The categories are written first: with their size known, a short list is broadcast, and
    else adaptive execution splits the best sellers. Rows without a product are spread out.
    """
    categories = materialise(one_category(predictions))
    if not keep_unlabelled:
        return rows.join(categories, "product_id")
    others = [c for c in rows.columns if c != "product_id"]
    known = categories.select(F.col("product_id").cast("string").alias("_key"), "predicted_category")
    return rows.withColumn("_key", spread_key("product_id", *others)).join(known, "_key", "left").drop("_key")


def uncategorised(lines: DataFrame, predictions: DataFrame, n: int = 100) -> DataFrame:
    """Up to ``n`` ids of sold products that have no category."""
    sold = lines.filter(F.col("product_id").isNotNull()).select("product_id").distinct()
    return sold.join(one_category(predictions), "product_id", "left_anti").orderBy("product_id").limit(n)


def _by_country(cases: Mapping[str, str], otherwise: str) -> Column:
    arms = " ".join(f"WHEN {sql_text(code)} THEN {sql}" for code, sql in cases.items())
    return F.expr(f"CASE order_country_code {arms} ELSE {otherwise} END" if arms else otherwise)


def _steps(
    products: DataFrame, rules: Mapping[str, Sequence[Rule]], target: str | None = None
) -> DataFrame:
    """Adds ``_name``, ``_category`` and ``_changes`` after all steps of the row's country.

    A row meets the words of its own country only, each step once, always on its original
    name. A renamed row has a known name, so what a later step would find in it is decided
    here and not searched again; the plan grows with the words, not with their product.
    ``_changes`` counts the steps of category ``target`` that changed the category.
    """
    depth = max((len(steps) for steps in rules.values()), default=0)
    found = {
        f"_hit{i}": _by_country(
            {code: contains_sql("product_name", steps[i].words) for code, steps in rules.items() if i < len(steps)},
            "false",
        )
        for i in range(depth)
    }
    names, categories, changes = {}, {}, {}
    for code, steps in rules.items():
        name, category, changed = "product_name", "_base", "0"
        renamed: list[tuple[str, str]] = []
        for i, rule in enumerate(steps):
            hit = f"_hit{i}"
            for earlier, text in renamed:
                known = any(word.lower() in text.lower() for word in rule.words)
                hit = f"CASE WHEN {earlier} THEN {str(known).lower()} ELSE {hit} END"
            if rule.category == target:
                changed += f" + CASE WHEN {hit} AND NOT ({category} <=> {sql_text(target)}) THEN 1 ELSE 0 END"
            category = f"CASE WHEN {hit} THEN {sql_text(rule.category)} ELSE {category} END"
            if rule.rename:
                name = f"CASE WHEN {hit} THEN {sql_text(rule.rename)} ELSE {name} END"
                renamed.append((hit, rule.rename))
        names[code], categories[code], changes[code] = name, category, changed
    base = canonical_category(F.col("predicted_category"))
    return (
        products.withColumns({**found, "_base": base})
        .withColumns(
            {
                "_name": _by_country(names, "product_name"),
                "_category": _by_country(categories, "_base"),
                "_changes": _by_country(changes, "0"),
            }
        )
        .drop(*found)
    )


def apply_rules(
    products: DataFrame, rules: Mapping[str, Sequence[Rule]] | DataFrame = COUNTRY_RULES
) -> DataFrame:
    """Relabels products by the ordered keyword rules of their country.

    Adds ``relabelled``: whether the category changed. Countries without rules only get
    the canonical spelling of the category. Rules kept in a table go through its word index.
    """
    if isinstance(rules, DataFrame):
        return apply_rule_table(products, rules)
    done = _steps(products, rules).withColumns(
        {
            "relabelled": ~F.col("_category").eqNullSafe(F.col("_base")),
            "product_name": F.col("_name"),
            "predicted_category": F.col("_category"),
        }
    )
    return done.drop("_name", "_category", "_changes", "_base")


def rule_change_counts(
    products: DataFrame, rules: Mapping[str, Sequence[Rule]] | DataFrame = COUNTRY_RULES, target: str = "other"
) -> DataFrame:
    """Per country, rows a rule of category ``target`` would change when its turn comes."""
    if isinstance(rules, DataFrame):
        return rule_table_changes(products, rules, target)
    return _steps(products, rules, target).groupBy("order_country_code").agg(F.sum("_changes").alias("changes"))


def store_catalogue(
    order_facts: DataFrame,
    availability: DataFrame,
    predictions: DataFrame,
    store: str,
    as_of: dt.date,
    days: int = 7,
    countries: Iterable[str] | None = None,
) -> DataFrame:
    """Catalogue of one store with city and category; missing values shown as empty text."""
    rows = available_products(
        order_facts, availability, as_of, days, countries, store=store, with_city=True
    )
    return blank_columns(
        with_category(rows, predictions, keep_unlabelled=True).select(
            "store_name", "product_name", "product_id", "predicted_category", "order_city_code"
        )
    )


def label_distribution(df: DataFrame, columns: Sequence[str] = ("order_country_code",)) -> DataFrame:
    """Row count per country (and label), largest first."""
    return df.groupBy(*columns).agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), *columns)

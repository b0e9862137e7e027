"""Ordered keyword rules kept in a table, found through an index of short letter runs.

A rule table has ``order_country_code, step, word, category, rename``: in the order of the steps, a name
that holds one of a step's words (whatever the case) gets its category and, if given, its new text. Later
steps look at the new text. Rules can be changed by whoever keeps the table; the plan is the same for ten
words and for ten thousand.

Names are folded to distinct ones and cut at white space; equal tokens of all names are folded to one. A word
without white space lies in a token, so words are looked for in the tokens, once in each, and a name has the
steps of its tokens: no text is searched, and what grows with the texts is one row for each token of a name.
A word of several pieces is looked for in the names that hold its rarest piece.

Among the tokens every word is indexed under one run of up to ``RUN`` letters of it, the one that the fewest
tokens hold. Tokens meet the index by their own runs, and only then is the word itself looked for.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from orderloom.functions.text import canonical_category, sql_text
from orderloom.operators.orders import spread_key
from orderloom.session import materialise

RUN = 3
_SPACE = r"\s+"
RULE_SCHEMA = "order_country_code string, step int, word string, category string, rename string"
_EVENT = "struct<step: int, category: string, rename: string>"


def rule_table(spark: SparkSession, rules: Mapping[str, Sequence]) -> DataFrame:
    """A rule table from steps ``(words, category, rename)`` per country."""
    rows = [
        (country, step, word, rule.category, rule.rename)
        for country, steps in rules.items()
        for step, rule in enumerate(steps)
        for word in rule.words
    ]
    return spark.createDataFrame(rows, RULE_SCHEMA)


def _runs(text: str, sizes: Sequence[int]) -> Column:
    """The distinct runs of the given sizes in a text, as rows; each pattern looks ahead from every letter."""
    each = [F.regexp_extract_all(F.col(text), F.lit(f"(?s)(?=(.{{{n}}}))"), F.lit(1)) for n in sizes]
    return F.explode(F.array_distinct(F.concat(*each)))


def word_hits(names: DataFrame, words: DataFrame) -> DataFrame:
    """``order_country_code, id, word`` wherever a name holds a word of its country; both are lower case already.

    ``names`` has ``order_country_code, id, name``, ``words`` has ``order_country_code, word``, both without
    repeated rows. A long name travels once, its runs with the id only.
    """
    country = "order_country_code"
    # At most RUN different numbers.
    sizes = [r.n for r in words.select(F.least(F.char_length("word"), F.lit(RUN)).alias("n")).distinct().orderBy("n").collect()]
    if not sizes:
        return names.select(country, "id", F.lit(None).cast("string").alias("word")).limit(0)
    own = words.select(country, "word", _runs("word", sizes).alias("run"))
    parts = materialise(own.filter(F.char_length("run") == F.least(F.char_length("word"), F.lit(RUN))))
    wanted = parts.select(country, "run").distinct()
    held = names.select(country, "id", _runs("name", sizes).alias("run"))
    held = materialise(held.join(wanted, [country, "run"], "left_semi"))
    seen = held.groupBy(country, "run").agg(F.count(F.lit(1)).alias("seen"))
    # A word with a run that no name holds is in no name.
    rated = parts.join(seen, [country, "run"], "left")
    probes = (
        rated.groupBy(country, "word")
        .agg(F.min(F.struct(F.coalesce("seen", F.lit(0)).alias("seen"), "run")).alias("best"))
        .filter("best.seen > 0")
        .select(country, "word", F.col("best.run").alias("run"))
    )
    met = held.join(probes, [country, "run"]).select(country, "id", "word")
    return met.join(names.select(country, "id", "name"), [country, "id"]).filter(F.contains("name", "word")).drop("name")


def _pieces(text: str) -> Column:
    """The distinct pieces of a text between white space."""
    return F.array_distinct(F.filter(F.split(F.col(text), _SPACE), lambda piece: piece != ""))


def step_hits(names: DataFrame, words: DataFrame) -> DataFrame:
    """``order_country_code, id, step`` wherever a name holds a word of the step, without repeated rows.

    ``names`` is as in ``word_hits``, ``words`` has ``order_country_code, step, word``.
    """
    country = "order_country_code"
    words = materialise(words.select(country, "step", "word", _pieces("word").alias("pieces"), F.col("word").rlike(_SPACE).alias("spaced")))
    said = names.select(country, "id", F.explode(_pieces("name")).alias("token"))
    tokens = materialise(said.groupBy(country, "token").agg(F.count(F.lit(1)).alias("seen")))
    tokens = materialise(tokens.select(country, F.monotonically_increasing_id().alias("id"), F.col("token").alias("name"), "seen"))
    parts = words.select(country, F.explode("pieces").alias("word")).distinct()
    inside = word_hits(tokens.drop("seen"), parts).join(tokens, [country, "id"])
    inside = materialise(inside.select(country, F.col("name").alias("token"), "seen", F.col("word").alias("piece")))
    whole = words.filter("NOT spaced").select(country, "step", F.col("word").alias("piece"))
    steps = inside.join(whole, [country, "piece"]).groupBy(country, "token").agg(F.collect_set("step").alias("steps"))
    hits = said.join(materialise(steps), [country, "token"]).select(country, "id", F.explode("steps").alias("step"))
    # A null: there are no such words.
    kinds = words.filter("spaced").agg(F.max(F.size("pieces") > 0).alias("pieced"), F.max(F.size("pieces") == 0).alias("blank")).first()
    if kinds.pieced:
        rated = inside.groupBy(country, "piece").agg(F.sum("seen").alias("seen"))
        probes = (
            words.filter("spaced").select(country, "word", F.explode("pieces").alias("piece")).distinct()
            .join(rated, [country, "piece"], "left")
            .groupBy(country, "word")
            .agg(F.min(F.struct(F.coalesce("seen", F.lit(0)).alias("seen"), "piece")).alias("best"))
            .filter("best.seen > 0")
            .select(country, "word", F.col("best.piece").alias("piece"))
        )
        probed = materialise(inside.join(probes, [country, "piece"]).select(country, "token", "word"))
        met = said.join(probed, [country, "token"]).select(country, "id", "word").distinct()
        held = met.join(names.select(country, "id", "name"), [country, "id"]).filter(F.contains("name", "word"))
        hits = hits.union(held.join(words, [country, "word"]).select(country, "id", "step"))
    if kinds.blank:
        blank = words.filter("spaced AND size(pieces) = 0")
        held = word_hits(names, blank.select(country, "word").distinct())
        hits = hits.union(held.join(blank, [country, "word"]).select(country, "id", "step"))
    return hits.distinct()


def _events(hits: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Per key the steps it meets, in order, as ``events``."""
    return hits.groupBy(*keys).agg(F.sort_array(F.collect_set(F.struct("step", "category", "rename"))).alias("events"))


def _until_renamed(events: str) -> str:
    """The events up to the first one that renames, and the step of that one."""
    first = f"array_position(transform({events}, e -> e.rename IS NOT NULL), true)"
    return f"CASE WHEN {first} = 0 THEN {events} ELSE slice({events}, 1, CAST({first} AS INT)) END"


def _last_rename(events: str) -> str:
    return f"CASE WHEN element_at({events}, -1).rename IS NOT NULL THEN element_at({events}, -1).step END"


def _resolved(rules: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The rules with lower-case words, and what follows each renaming step, as ``tail``."""
    country = "order_country_code"
    clean = rules.filter((F.coalesce("word", F.lit("")) != "") & F.col(country).isNotNull() & F.col("step").isNotNull())
    # One category and one new text per step: the smallest, should a table hold several.
    action = clean.groupBy(country, "step").agg(F.min("category").alias("category"), F.min("rename").alias("rename"))
    words = clean.select(country, "step", F.lower("word").alias("word")).distinct().join(action, [country, "step"])
    words = materialise(words)
    sources = materialise(words.filter("rename IS NOT NULL").select(country, F.col("step").alias("id"), F.lower("rename").alias("name")).distinct())
    actions = words.select(country, "step", "category", "rename").distinct()
    found = step_hits(sources, words).filter("step > id").join(actions, [country, "step"])
    later = _events(found, [country, "id"]).withColumnRenamed("id", "source")
    tails = sources.select(country, F.col("id").alias("source")).join(later, [country, "source"], "left")
    tails = tails.select(country, "source", F.coalesce("events", F.expr(f"CAST(array() AS array<{_EVENT}>)")).alias("events"))
    tails = tails.withColumn("tail", F.expr(_until_renamed("events")))
    tails = materialise(tails.select(country, "source", "tail", F.expr(f"CASE WHEN size(tail) > 0 THEN {_last_rename('tail')} END").alias("next")))
    # Steps only grow along a chain of new texts; every round doubles what is known of it.
    while not tails.filter("next IS NOT NULL").isEmpty():
        more = tails.select(country, F.col("source").alias("next"), F.col("tail").alias("rest"), F.col("next").alias("then"))
        both = tails.join(more, [country, "next"], "left")
        tails = materialise(both.select(country, "source", F.concat("tail", F.coalesce("rest", F.expr(f"CAST(array() AS array<{_EVENT}>)"))).alias("tail"), F.col("then").alias("next")))
    return words, tails


def _with_events(products: DataFrame, rules: DataFrame) -> DataFrame:
    """Adds ``_base``, the canonical category, and ``_events``, the steps that apply, in order (null: none)."""
    country = "order_country_code"
    words, tails = _resolved(rules)
    lowered = F.lower("product_name")
    names = materialise(products.filter(F.col("product_name").isNotNull()).select(country, lowered.alias("name")).distinct())
    names = materialise(names.select(country, F.monotonically_increasing_id().alias("id"), "name"))
    hits = step_hits(names, words).join(words.select(country, "step", "category", "rename").distinct(), [country, "step"])
    events = _events(hits, [country, "id"]).withColumn("events", F.expr(_until_renamed("events")))
    events = events.withColumn("source", F.expr(_last_rename("events")))
    # Without a new text there is no source; those names are not part of the join.
    plain = events.filter("source IS NULL").select(country, "id", "events")
    renamed = events.filter("source IS NOT NULL").join(tails, [country, "source"])
    events = materialise(plain.union(renamed.select(country, "id", F.concat("events", "tail"))))
    known = events.join(names, [country, "id"]).select(F.col(country).alias("_country"), F.col("name").alias("_lowered"), F.col("events").alias("_events"))
    # Rows without a name are spread by their other columns.
    others = [c for c in products.columns if c != "product_name"]
    key = F.when(F.col("product_name").isNotNull(), lowered).otherwise(spread_key("product_name", *others))
    same = (F.col(country) == F.col("_country")) & (F.col("_key") == F.col("_lowered")) & F.col("product_name").isNotNull()
    joined = products.withColumn("_key", key).join(known, same, "left")
    return joined.drop("_key", "_country", "_lowered").withColumn("_base", canonical_category(F.col("predicted_category")))


def apply_rule_table(products: DataFrame, rules: DataFrame) -> DataFrame:
    """Relabels products by the rule table; adds ``relabelled``: whether the category changed.

    Countries without rules only get the canonical spelling of the category. Empty and null words
    match nothing; a step without a category keeps the one there is.
    """
    names = F.expr("filter(transform(_events, e -> e.rename), x -> x IS NOT NULL)")
    categories = F.expr("filter(transform(_events, e -> e.category), x -> x IS NOT NULL)")
    done = _with_events(products, rules).withColumns(
        {
            "_category": F.when(F.size(categories) > 0, F.element_at(categories, -1)).otherwise(F.col("_base")),
            "_name": F.when(F.size(names) > 0, F.element_at(names, -1)).otherwise(F.col("product_name")),
        }
    )
    shown = {"predicted_category": "_category", "product_name": "_name"}
    columns = [F.col(shown.get(c, c)).alias(c) for c in products.columns]
    return done.select(*columns, (~F.col("_category").eqNullSafe(F.col("_base"))).alias("relabelled"))


def rule_table_changes(products: DataFrame, rules: DataFrame, target: str = "other") -> DataFrame:
    """Per country, how often a step of category ``target`` would change a row when its turn comes."""
    wanted = sql_text(target)
    turn = f"CASE WHEN e.category = {wanted} AND NOT (a.now <=> {wanted}) THEN 1 ELSE 0 END"
    step = f"(a, e) -> struct(coalesce(e.category, a.now) AS now, a.n + {turn} AS n)"
    changes = F.expr(f"aggregate(_events, struct(_base AS now, 0 AS n), {step}, a -> a.n)")
    return _with_events(products, rules).groupBy("order_country_code").agg(F.sum(F.coalesce(changes, F.lit(0))).alias("changes"))

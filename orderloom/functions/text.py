"""Names: categories, keyword tests, normalisation, interval labels."""

from __future__ import annotations

import unicodedata
from collections.abc import Iterable

from pyspark.sql import Column
from pyspark.sql import functions as F

# Lower-case letters and their Latin spelling.
CYRILLIC = {
    "а": "a", "б": "b", "в": "v", "г": "g", "д": "d", "е": "e", "ё": "io", "ж": "zh", "з": "z",
    "и": "i", "й": "i", "к": "k", "л": "l", "м": "m", "н": "n", "о": "o", "п": "p", "р": "r",
    "с": "s", "т": "t", "у": "u", "ф": "f", "х": "kh", "ц": "ts", "ч": "ch", "ш": "sh",
    "щ": "shch", "ъ": "'", "ы": "y", "ь": "'", "э": "e", "ю": "iu", "я": "ia",
    "є": "ie", "і": "i", "ї": "yi", "ґ": "g", "ә": "a", "ғ": "g", "қ": "k", "ң": "n", "ө": "o",
    "ұ": "u", "ү": "u", "һ": "h",
}
GEORGIAN = {
    "ა": "a", "ბ": "b", "გ": "g", "დ": "d", "ე": "e", "ვ": "v", "ზ": "z", "თ": "t", "ი": "i",
    "კ": "k", "ლ": "l", "მ": "m", "ნ": "n", "ო": "o", "პ": "p", "ჟ": "zh", "რ": "r", "ს": "s",
    "ტ": "t", "უ": "u", "ფ": "p", "ქ": "k", "ღ": "gh", "ყ": "q", "შ": "sh", "ჩ": "ch", "ც": "ts",
    "ძ": "dz", "წ": "ts", "ჭ": "ch", "ხ": "kh", "ჯ": "j", "ჰ": "h",
}
ARMENIAN = {
    "ա": "a", "բ": "b", "գ": "g", "դ": "d", "ե": "e", "զ": "z", "է": "e", "ը": "e", "թ": "t",
    "ժ": "zh", "ի": "i", "լ": "l", "խ": "kh", "ծ": "ts", "կ": "k", "հ": "h", "ձ": "dz", "ղ": "gh",
    "ճ": "ch", "մ": "m", "յ": "y", "ն": "n", "շ": "sh", "ո": "o", "չ": "ch", "պ": "p", "ջ": "j",
    "ռ": "r", "ս": "s", "վ": "v", "տ": "t", "ր": "r", "ց": "ts", "ւ": "w", "փ": "p", "ք": "k",
    "օ": "o", "ֆ": "f", "և": "ev",
}
POLISH = {
    "ą": "a", "ć": "c", "ę": "e", "ł": "l", "ń": "n", "ó": "o", "ś": "s", "ź": "z", "ż": "z",
}
# Letters without a plain letter inside them; the other Latin letters with marks come from their decomposition.
LIGATURES = {"ß": "ss", "æ": "ae", "œ": "oe", "ø": "o", "đ": "d", "ð": "d", "þ": "th", "ı": "i"}


def _marked_letters() -> dict[str, str]:
    letters = (chr(code) for code in range(0xE0, 0x180))
    plain = {c: unicodedata.normalize("NFD", c)[0] for c in letters if c == c.lower()}
    return {c: p for c, p in plain.items() if p != c and "a" <= p <= "z"}


LETTERS = {**_marked_letters(), **LIGATURES, **CYRILLIC, **GEORGIAN, **ARMENIAN, **POLISH}

# What a product name loses when it is normalised, and its brand alias.
SIZE_PATTERN = r"\b\d+\s?(ml|l|g|gr)\b"
NOISE_PATTERN = r"[-,\d.()'\"\s]"
BRAND_ALIASES = {"kokakola": "cocacola"}
# The forms of a range label, closed and open.
CLOSED_LABEL = r"(\d+)\s*-\s*(\d+)"
OPEN_LABEL = r">\s*(\d+)"


def canonical_category(category: Column) -> Column:
    return F.lower(F.trim(category))


def sql_text(value: str) -> str:
    """``value`` as a quoted SQL string."""
    return "'" + value.replace("\\", "\\\\").replace("'", "\\'") + "'"


def contains_sql(column: str, keywords: Iterable[str]) -> str:
    """SQL test whether a column holds one of the words, whatever their case; a null holds none.

    Plain substring tests scan long texts several times faster than one alternation.
    """
    tests = " OR ".join(f"contains(lower(`{column}`), {sql_text(k.lower())})" for k in keywords)
    return f"coalesce({tests}, false)"


def contains_any(column: str, keywords: Iterable[str]) -> Column:
    return F.expr(contains_sql(column, keywords))


def matches_any(name: Column, patterns: Iterable[str]) -> Column:
    """Regular expressions joined as alternatives, ignoring case in every script."""
    return F.coalesce(name.rlike("(?iu)(" + "|".join(patterns) + ")"), F.lit(False))


def to_latin(name: Column) -> Column:
    """Lower-case Latin spelling: long spellings by replacement, the rest letter by letter."""
    out = F.lower(name)
    for letter, spelling in LETTERS.items():
        if len(spelling) > 1:
            out = F.replace(out, F.lit(letter), F.lit(spelling))
    single = {letter: s for letter, s in LETTERS.items() if len(s) == 1}
    return F.translate(out, "".join(single), "".join(single.values()))


def normalise_name(name: Column) -> Column:
    out = F.trim(to_latin(name))
    out = F.regexp_replace(out, SIZE_PATTERN, "")
    out = F.regexp_replace(out, NOISE_PATTERN, "")
    for alias, brand in BRAND_ALIASES.items():
        out = F.when(out == alias, brand).otherwise(out)
    return out


def range_label(low: Column, high: Column) -> Column:
    """``12 - 40``: both limits cut toward zero."""
    return F.when(
        low.isNotNull() & high.isNotNull(),
        F.concat_ws(" - ", low.cast("long").cast("string"), high.cast("long").cast("string")),
    )


def upper_limit(label: Column) -> Column:
    """The upper number of ``a - b``, or a + 1 for the open label ``>a``."""
    closed = F.regexp_extract(label, CLOSED_LABEL, 2)
    opened = F.regexp_extract(label, OPEN_LABEL, 1)
    return F.when(closed != "", closed.try_cast("long")).when(opened != "", opened.try_cast("long") + 1)


def with_missing_level(value: Column, level: str = "missing") -> Column:
    return F.coalesce(value.cast("string"), F.lit(level))

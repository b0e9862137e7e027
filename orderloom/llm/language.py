"""Language identification by Bayesian fusion of evidence.

Four kinds of evidence meet in one posterior for each document:

* the text's likelihood under byte-trigram models, one per language, trained on the declared languages;
* the declared markup language, by how often that declaration goes with each language;
* the address suffix and the host, as priors: the counts of a host are smoothed towards those of its
  suffix, and those towards the counts of all documents (grouped aggregation, joined back by key).

A class ``und`` stands for text of no known language; its model is uniform. A document is kept when a
known language has the largest posterior. The likelihood of a long text weighs like that of
``EVIDENCE`` trigrams, as neighbouring trigrams are not independent.

Evidence that is null is left out, so a null or empty text is judged by its declaration and host. Rows
without any evidence get the most common language. Repeated rows are judged each, rows without doc_id
too. An empty table gives an empty result. Other columns play no part.
"""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from orderloom.llm import textbits as tb
from orderloom.llm.store import stored, summed, text_batches

LANGUAGES = ("de", "en", "es", "fr")
GRAMS = 1 << 15
EVIDENCE = 100
UNKNOWN_PRIOR = 0.01
#: Only letters and bytes outside ASCII tell languages apart; the rest counts as space.
LETTERS = tb.LOWER.copy()
LETTERS[:0x41], LETTERS[0x5B:0x61], LETTERS[0x7B:0x80] = 32, 32, 32
#: Weight, in documents, of the level above in a smoothed prior.
HOST_WEIGHT, SUFFIX_WEIGHT = 20.0, 50.0


def markup_language(html: Column) -> Column:
    """The language that a page declares: ``<html lang="fr">`` gives fr (null without one)."""
    found = F.regexp_extract(html, r"(?i)<html\b[^>]*\blang\s*=\s*[\"']?([a-zA-Z]{2,3})", 1)
    return F.lower(F.when(found != "", found))


def host_of(url: Column) -> Column:
    """The host of an address, in lower case."""
    found = F.regexp_extract(url, r"^[a-zA-Z][a-zA-Z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]+)", 1)
    return F.lower(F.when(found != "", found))


def suffix_of(host: Column) -> Column:
    """The part of a host after its last dot (null without a dot)."""
    return F.when(host.contains("."), F.element_at(F.split(host, r"\."), -1))


def _grams(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Hashed trigrams of the lower-cased letters of each text, and where each text's trigrams begin."""
    data, offsets = tb.texts(column)
    low = LETTERS[data].astype(np.uint32)
    n = np.maximum(np.diff(offsets) - 2, 0)
    if not n.sum():
        return np.zeros(0, np.int64), np.zeros(len(offsets), np.int64)
    gram = ((low[:-2] * np.uint32(961) + low[1:-1] * np.uint32(31) + low[2:]) * np.uint32(2654435761)) >> np.uint32(17)
    inside = np.ones(len(low), bool)
    inside[np.concatenate([offsets[1:] - 1, np.maximum(offsets[1:] - 2, offsets[:-1])])[np.tile(np.diff(offsets) > 0, 2)]] = False
    return gram[inside[: len(gram)]].astype(np.int64), np.concatenate([[0], np.cumsum(n)])


def _text_models(rows: DataFrame, languages: Sequence[str]) -> np.ndarray:
    """Log probabilities of the trigrams, one column per language and a last one for ``und``."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros(len(languages) * GRAMS)
        for piece in tb.pieces(batches, "text"):
            grams, bounds = _grams(piece.column(1))
            declared = np.array([languages.index(x) if x in languages else -1 for x in piece.column(0).to_pylist()])
            of = np.repeat(declared, np.diff(bounds))
            counts += np.bincount((of * GRAMS + grams)[of >= 0], minlength=len(counts))
        yield pa.record_batch([pa.array(languages), pa.array([c.tobytes() for c in np.split(counts, len(languages))], pa.binary())], ["part", "sums"])

    languages = list(languages)
    told = summed(rows.select("declared", "text").mapInArrow(count, "part string, sums binary")).collect()  # one row per language
    table = np.full((GRAMS, len(languages) + 1), -math.log(GRAMS))
    for row in told:
        counts = np.frombuffer(row["sums"]) + 0.05
        table[:, languages.index(row["part"])] = np.log(counts / counts.sum())
    return table


def identify(rows: DataFrame, languages: Sequence[str] = LANGUAGES) -> DataFrame:
    """``doc_id, language, confidence, kept`` for rows of ``doc_id, text, declared, host``.

    ``declared`` is a language code; its part before a hyphen counts. ``host`` may be any name of the
    document's origin; its suffix is what follows the last dot.
    """
    languages = list(languages)
    rows = text_batches(rows).select("doc_id", "text", F.lower(F.split("declared", "[-_]")[0]).alias("declared"), F.lower("host").alias("host"))
    model = rows.sparkSession.sparkContext.broadcast(_text_models(rows, languages))  # GRAMS x languages

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = model.value
        for piece in tb.pieces(batches, "text"):
            grams, bounds = _grams(piece.column(1))
            n = np.maximum(np.diff(bounds), 1)
            weight = np.minimum(n, EVIDENCE) / n
            each = np.stack([tb.per_text(table[:, i][grams], bounds) * weight for i in range(table.shape[1])], axis=1)
            lists = pa.FixedSizeListArray.from_arrays(pa.array(each.reshape(-1)), table.shape[1]).cast(pa.list_(pa.float64()))
            yield pa.record_batch([piece.column(0), piece.column(2), piece.column(3), pa.array(np.diff(bounds)), lists], ["doc_id", "declared", "host", "n_grams", "likelihood"])

    schema = "doc_id long, declared string, host string, n_grams long, likelihood array<double>"
    scored = stored(rows.select("doc_id", "text", "declared", "host").mapInArrow(score, schema))
    classes = [*languages, "und"]
    # What the text alone says; a text too short to say anything counts for its declaration.
    by_text = F.element_at(F.array(*map(F.lit, classes)), F.array_position("likelihood", F.array_max("likelihood")).cast("int"))
    own = F.when(F.col("declared").isin(languages), F.col("declared"))
    guess = F.when(F.col("n_grams") >= 20, by_text).otherwise(F.coalesce(own, by_text))
    known = scored.withColumn("guess", guess).withColumn("suffix", suffix_of(F.col("host")))
    counts = [F.count(F.when(F.col("guess") == c, 1)).cast("double").alias(f"n{i}") for i, c in enumerate(classes)]
    names = [f"n{i}" for i in range(len(classes))]

    total = known.agg(*counts).first()
    most = sum(total) + len(classes)
    prior = [(n + 1) / most for n in total]
    prior[-1] = min(prior[-1], UNKNOWN_PRIOR)
    above = F.array(*map(F.lit, prior))

    def smoothed(above: Column, weight: float) -> Column:
        here = F.array(*names)
        size = F.aggregate(here, F.lit(0.0), lambda a, x: a + x)
        return F.transform(F.arrays_zip(here.alias("here"), above.alias("above")), lambda x: (x["here"] + weight * x["above"]) / (size + weight))

    suffixes = known.filter("suffix IS NOT NULL").groupBy("suffix").agg(*counts)
    suffixes = suffixes.select("suffix", smoothed(above, SUFFIX_WEIGHT).alias("suffix_prior"))
    hosts = known.filter("host IS NOT NULL").groupBy("host", "suffix").agg(*counts).join(suffixes, "suffix", "left")
    hosts = hosts.select("host", smoothed(F.coalesce("suffix_prior", above), HOST_WEIGHT).alias("host_prior"))

    # P(declaration | language) over the declarations that are languages themselves, and one for others.
    kind = F.when(F.col("declared").isin(languages), F.col("declared")).when(F.col("declared").isNotNull(), F.lit("other"))
    seen = {r["kind"]: r for r in known.withColumn("kind", kind).filter("kind IS NOT NULL").groupBy("kind").agg(*counts).collect()}
    column_sums = [sum(r[c] for r in seen.values()) for c in names]
    declares = F.lit(None)
    for k in [*languages, "other"]:
        given = [((seen[k][c] if k in seen else 0.0) + 1) / (column_sums[i] + len(classes)) for i, c in enumerate(names)]
        declares = F.when(F.col("kind") == k, F.array(*(F.lit(math.log(x)) for x in given))).otherwise(declares)

    joined = known.withColumn("kind", kind).join(hosts, "host", "left")
    joined = joined.withColumn("declares", F.coalesce(declares, F.array_repeat(F.lit(0.0), len(classes))))
    evidence = F.arrays_zip("likelihood", "declares", F.coalesce("host_prior", above).alias("prior"))
    logs = F.transform(evidence, lambda x: x["likelihood"] + x["declares"] + F.log(x["prior"]))
    fused = joined.withColumn("logs", logs).withColumn("most", F.array_max("logs"))
    share = F.aggregate("logs", F.lit(0.0), lambda a, x: a + F.exp(x - F.col("most")))
    language = F.element_at(F.array(*map(F.lit, classes)), F.array_position("logs", F.col("most")).cast("int"))
    out = fused.select("doc_id", language.alias("language"), (1 / share).alias("confidence"))
    return out.withColumn("kept", F.col("language") != "und")

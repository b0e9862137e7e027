"""The operators with production parameters over their whole tables, and SQL twins where SQL can say them."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from orderloom.llm import bpe, contamination, fim, hmm, language, line_dedup, near_dups, quality, shards, simhash, spelling, suffix_dedup, topk
from orderloom.session import shared_path

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
TWINS: dict[str, str] = {}

SHARDS = 40
#: The share of each language's trusted documents that op10 keeps.
TRUSTED_QUANTILE = 0.99


def query(fn: Callable[[SparkSession, str], DataFrame]):
    QUERIES[fn.__name__] = fn
    return fn


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def vocabulary(spark: SparkSession) -> list[bytes]:
    return bpe.read_ranks(spark, public_tokenizers.path("byte_bpe_multi_50k.tiktoken"))


@query
def op1_byte_bpe(spark: SparkSession, folder: str) -> DataFrame:
    return bpe.with_tokens(table(spark, folder, "documents"), vocabulary(spark), public_tokenizers.PATTERN, arrays=False)


@query
def op3_exact_top_k(spark: SparkSession, folder: str) -> DataFrame:
    rows = table(spark, folder, "embeddings").filter(topk.usable(F.col("embedding")))
    rows = rows.select(F.col("vec_id").alias("id"), topk.quantised(F.col("embedding")).alias("v"))
    return topk.top_k(rows.filter("id % 20 = 0"), rows, 20)


TWINS["op3_exact_top_k"] = """
WITH v AS (
    SELECT vec_id, list_transform(embedding, lambda x: floor(64 * x::DOUBLE)) AS c FROM embeddings
    WHERE embedding IS NOT NULL AND vec_id IS NOT NULL
      AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), s AS (
    SELECT q.vec_id AS query_id, c.vec_id, CAST(list_inner_product(q.c, c.c) AS BIGINT) AS score
    FROM v q JOIN v c ON q.vec_id <> c.vec_id WHERE q.vec_id % 20 = 0
)
SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank, vec_id, score
FROM s QUALIFY rank <= 20
"""


@query
def op5_virtual_slots(spark: SparkSession, folder: str) -> DataFrame:
    out = shards.shard_documents(table(spark, folder, "documents"), SHARDS, shared_path(spark, "slot-maps"))
    return out.select(
        "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot",
        F.lit(None).cast("int").alias("grown_shard"), "virtual_slot", F.col("version").alias("map_version"),
    )


@query
def op6_superminhash(spark: SparkSession, folder: str) -> DataFrame:
    return near_dups.near_duplicates(table(spark, folder, "documents"), words=2, percent=80)


TWINS["op6_superminhash"] = """
WITH RECURSIVE w AS (
    SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
        'abcdefghijklmnopqrstuvwxyz'), '[\\x20\\x09-\\x0D]+'), lambda x: x <> '') AS t FROM documents
), s AS (
    SELECT doc_id, CASE WHEN len(t) = 0 THEN [] WHEN len(t) = 1 THEN [t[1]]
        ELSE list_distinct(list_transform(range(1, len(t)), lambda i: t[i] || ' ' || t[i + 1])) END AS g FROM w
), e AS (SELECT doc_id, len(g) AS n, unnest(g) AS x FROM s),
p AS (
    SELECT a.doc_id AS a, b.doc_id AS b FROM e a JOIN e b ON a.x = b.x AND a.doc_id < b.doc_id
        AND 100 * least(a.n, b.n) >= 80 * greatest(a.n, b.n)
    GROUP BY 1, 2 HAVING 100 * count(*) >= 80 * (any_value(a.n) + any_value(b.n) - count(*))
), l AS (SELECT a, b FROM p UNION ALL SELECT b, a FROM p),
r AS (SELECT doc_id AS a, doc_id AS b FROM s UNION SELECT r.a, l.b FROM r JOIN l ON r.b = l.a)
SELECT doc_id, len(g)::BIGINT AS n_shingles, m.c AS component_id, doc_id = m.c AS kept
FROM s JOIN (SELECT a, min(b) AS c FROM r GROUP BY 1) m ON m.a = s.doc_id
"""


@query
def op7_hidden_markov(spark: SparkSession, folder: str) -> DataFrame:
    return hmm.score_texts(table(spark, folder, "documents"))


@query
def op8_language_id(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents")
    return language.identify(docs.select("doc_id", "text", F.col("lang").alias("declared"), F.col("source").alias("host")))


def page_texts(pages: DataFrame) -> DataFrame:
    """Pages as ``doc_id, text, declared, host``: the text without tags, scripts and styles, the markup's language, the address."""
    bare = F.regexp_replace("html", r"(?is)<(script|style|head)\b.*?</\1\s*>", " ")
    text = F.regexp_replace(bare, r"<[^>]*>", " ")
    return pages.select(
        F.col("page_id").alias("doc_id"), text.alias("text"), language.markup_language(F.col("html")).alias("declared"), language.host_of(F.col("url")).alias("host")
    )


@query
def pages_language(spark: SparkSession, folder: str) -> DataFrame:
    """Language of raw pages, with all four kinds of evidence: text, markup, address suffix and host."""
    return language.identify(page_texts(table(spark, folder, "pages")))


@query
def op9_decontamination(spark: SparkSession, folder: str) -> DataFrame:
    return contamination.contaminated(table(spark, folder, "documents"), table(spark, folder, "benchmark"))


@query
def op10_quality(spark: SparkSession, folder: str) -> DataFrame:
    return quality.classify(table(spark, folder, "documents"), table(spark, folder, "labels"), quantile=TRUSTED_QUANTILE)


@query
def op4_line_dedup(spark: SparkSession, folder: str) -> DataFrame:
    out = line_dedup.dedup_lines(table(spark, folder, "documents"), short_repeats=True)
    return out.select("doc_id", "n_lines", "n_removed", "text")


TWINS["op4_line_dedup"] = """
WITH l AS (
    SELECT doc_id, unnest(string_split(text, chr(10))) AS said, generate_subscripts(string_split(text, chr(10)), 1) AS line
    FROM documents
), t AS (
    SELECT doc_id, line, said, list_filter(regexp_split_to_array(translate(said, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
        'abcdefghijklmnopqrstuvwxyz'), '[\\x20\\x09-\\x0D]+'), lambda x: x <> '') AS w FROM l
), w AS (SELECT doc_id, line, w, min((doc_id, line)) OVER (PARTITION BY w) AS f FROM t WHERE len(w) >= 1),
c AS (SELECT DISTINCT w, f FROM w WHERE len(w) >= 5),
d AS (SELECT w, f, list_concat(w[1:i - 1], w[i + 1:]) AS x, i FROM (SELECT w, f, unnest(range(1, len(w) + 1)) AS i FROM c)),
near AS (
    SELECT a.w FROM d a JOIN d b ON a.x = b.x AND a.i = b.i AND len(a.w) = len(b.w) WHERE b.f < a.f
    UNION SELECT a.w FROM c a JOIN d b ON a.w = b.x WHERE b.f < a.f
    UNION SELECT a.w FROM d a JOIN c b ON a.x = b.w WHERE b.f < a.f
), gone AS (SELECT doc_id, line FROM w WHERE (doc_id, line) <> f OR w IN (SELECT w FROM near))
SELECT t.doc_id, count(*)::BIGINT AS n_lines, count(gone.line)::BIGINT AS n_removed,
    coalesce(string_agg(t.said, chr(10) ORDER BY t.line) FILTER (WHERE gone.line IS NULL), '') AS text
FROM t LEFT JOIN gone USING (doc_id, line) GROUP BY t.doc_id
"""


@query
def op2_suffix_dedup(spark: SparkSession, folder: str) -> DataFrame:
    out = suffix_dedup.without_repeats(table(spark, folder, "documents"))
    return out.select(
        "doc_id", "n_bytes", "n_removed", F.size("spans").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256")
    )


@query
def op11_spelling_variants(spark: SparkSession, folder: str) -> DataFrame:
    return spelling.spelling_variants(table(spark, folder, "documents"), min_length=5, min_count=3, ratio=2, drop_every=97)


@query
def op12_fill_in_middle(spark: SparkSession, folder: str) -> DataFrame:
    out = fim.rearranged(table(spark, folder, "documents"))
    return out.select(
        "doc_id", "n", "form", "prefix_chars", "middle_chars",
        F.sha2("output", 256).alias("output_sha256"), F.sha2(fim.restored(), 256).alias("restored_sha256"),
    )


TWINS["op12_fill_in_middle"] = """
WITH h AS (
    SELECT doc_id, coalesce(text, '') AS t, sha256('7:' || coalesce(doc_id::VARCHAR, '')) AS x FROM documents
), u AS (
    SELECT doc_id, t, regexp_extract_all(t, '[^\n]*\n|[^\n]+') AS l, ('0x' || x[1:8])::BIGINT AS h1,
        ('0x' || x[9:16])::BIGINT AS h2, ('0x' || x[17:24])::BIGINT AS h3, ('0x' || x[25:32])::BIGINT AS h4 FROM h
), c AS (SELECT *, len(l) AS n, least(h1 % (len(l) + 1), h2 % (len(l) + 1)) AS a, greatest(h1 % (len(l) + 1), h2 % (len(l) + 1)) AS b FROM u),
f AS (
    SELECT *, CASE WHEN t = '' OR contains(t, '<P>') OR contains(t, '<S>') OR contains(t, '<M>') OR h3 % 100 >= 100 THEN 'plain'
        WHEN h4 % 100 < 50 THEN 'spm' ELSE 'psm' END AS form, array_to_string(l[1:a], '') AS p,
        array_to_string(l[a + 1:b], '') AS m, array_to_string(l[b + 1:], '') AS s FROM c
)
SELECT doc_id, n::BIGINT AS n, form, CASE WHEN form <> 'plain' THEN length(p) END::BIGINT AS prefix_chars,
    CASE WHEN form <> 'plain' THEN length(m) END::BIGINT AS middle_chars,
    sha256(CASE form WHEN 'plain' THEN t WHEN 'psm' THEN '<P>' || p || '<S>' || s || '<M>' || m
        ELSE '<S>' || s || '<P>' || p || '<M>' || m END) AS output_sha256, sha256(t) AS restored_sha256 FROM f
"""


@query
def op13_simhash(spark: SparkSession, folder: str) -> DataFrame:
    return simhash.near_duplicates(table(spark, folder, "documents"), words=4, distance=4)

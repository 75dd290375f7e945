"""The queries opN_<name> and the pipeline, and DuckDB's SQL where it can express them."""

from __future__ import annotations

from collections.abc import Callable
from functools import wraps

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidegraph.llm import decontaminate, licences, lm, mixing, pii, repetition, simhash, tokens, toxicity, urls
from tidegraph.llm.common import ship, table

WINDOW = 10
TOKEN_LIMIT = 4096
TOXIC = 0.7
KEY = "tidegraph"  # in production, a secret
RULES = [
    urls.Rule.site("allow", "com", "/"),
    urls.Rule.site("block", "example.com", "/en/"),
    urls.Rule.site("allow", "www.example.com", "/en/"),
    urls.Rule.site("block", "net", "/es/"),
    urls.Rule.site("block", "net", "/fr/"),
]


def op1_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    found = decontaminate.find_hits(docs, table(spark, sf_dir, "benchmark"), WINDOW)
    items = F.col("hits.items")
    listed = F.sha2(F.array_join(F.array_sort(F.transform(items, lambda x: x.cast("string"))), ",").cast("binary"), 256)
    return found.withColumn("n_hit", decontaminate.hit_words(F.col("hits"))).select(
        "doc_id", F.col("hits.n_words").alias("n_words"), "n_hit", F.size(items).cast("long").alias("n_items"), listed.alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated")
    )


OP1 = r"""
WITH item AS (SELECT item_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[0-9a-z\x{80}-\x{10FFFF}]+') AS w FROM benchmark),
win AS (
  SELECT DISTINCT item_id, least(len(w), 10) AS n, array_to_string(w[p:p + least(len(w), 10) - 1], ' ') AS words
  FROM (SELECT item_id, w, unnest(range(1, len(w) - least(len(w), 10) + 2)) AS p FROM item WHERE len(w) > 0)),
doc AS (SELECT doc_id, coalesce(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[0-9a-z\x{80}-\x{10FFFF}]+'), []) AS w FROM documents),
size AS (SELECT DISTINCT n FROM win),
grams AS (SELECT doc_id, n, p, array_to_string(w[p:p + n - 1], ' ') AS words FROM (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS p FROM doc, size WHERE len(w) >= n)),
found AS (SELECT g.doc_id, g.p, g.n, win.item_id FROM grams g JOIN win ON g.n = win.n AND g.words = win.words),
hit AS (SELECT doc_id, count(DISTINCT q) AS n_hit FROM (SELECT doc_id, unnest(range(p, p + n)) AS q FROM (SELECT DISTINCT doc_id, p, n FROM found)) GROUP BY doc_id),
its AS (SELECT doc_id, count(*) AS n_items, string_agg(item_id::VARCHAR, ',' ORDER BY item_id::VARCHAR) AS ids FROM (SELECT DISTINCT doc_id, item_id FROM found WHERE item_id IS NOT NULL) GROUP BY doc_id)
SELECT doc.doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items,
  sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM doc LEFT JOIN hit USING (doc_id) LEFT JOIN its USING (doc_id)
"""


def op2_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    judged = toxicity.toxicity(docs, table(spark, sf_dir, "labels"))
    scored = docs.select("doc_id", (toxicity.fold(F.col("doc_id"), 3) == 1).alias("held_out"), judged(F.col("text")).alias("judged"))
    score = F.col("judged.score")
    return scored.select("doc_id", "held_out", score.alias("score"), (score >= TOXIC).cast("int").alias("predicted"), F.size("judged.passages").alias("n_passages"))


def op3_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.near_duplicates(table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lpad(F.lower(F.hex("print")), 16, "0").alias("fingerprint"), "component_id")


def op4_licences(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = table(spark, sf_dir, "documents").select("doc_id", licences.scan(F.col("text")).alias("found"))
    return found.select("doc_id", F.array_join("found.licences", ",").alias("licences"), "found.allows", "found.n_known", "found.n_unmatched")


def op5_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    found = pii.with_surrogates(docs, KEY, counts="kinds")
    kinds = [F.col("kinds")[kind].alias(f"n_{kind}") for kind in pii.PATTERNS]
    return found.select("doc_id", "text", F.aggregate(F.map_values("kinds"), F.lit(0), lambda a, b: a + b).alias("n_entities"), *kinds)


def op6_lm_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lm.score_texts(table(spark, sf_dir, "documents"))


def op7_urls(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "pages").select("page_id", urls.judge_urls(F.col("url"), RULES).alias("judged")).select("page_id", "judged.*")


OP7 = r"""
WITH part AS (
  SELECT page_id, CASE WHEN contains(url, '://') THEN regexp_extract(substr(url, strpos(url, '://') + 3), '^[^?#]*') ELSE '' END AS rest FROM pages),
p AS (
  SELECT page_id, translate(regexp_extract(coalesce(rest, ''), '^[^/]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host, regexp_extract(coalesce(rest, ''), '/.*$', 0, 's') AS path FROM part),
r(host, path, verdict) AS (VALUES ('com', '/', 'allow'), ('example.com', '/en/', 'block'), ('www.example.com', '/en/', 'allow'), ('net', '/es/', 'block'), ('net', '/fr/', 'block')),
best AS (
  SELECT p.page_id, max_by(r.host || r.path, length(r.host || r.path)) AS rule, max_by(r.verdict, length(r.host || r.path)) AS verdict
  FROM p JOIN r ON (p.host = r.host OR ends_with(p.host, '.' || r.host)) AND starts_with(p.path, r.path) GROUP BY p.page_id)
SELECT p.page_id, p.host, p.path, best.rule, coalesce(best.verdict, 'allow') AS verdict FROM p LEFT JOIN best USING (page_id)
"""


def op8_token_counts(spark: SparkSession, sf_dir: str, model: str = "piece_bpe_32k.model") -> DataFrame:
    import public_tokenizers

    count = tokens.token_counter(spark, public_tokenizers.path(model))
    docs = table(spark, sf_dir, "documents").select("doc_id", F.octet_length(F.coalesce("text", F.lit(""))).cast("long").alias("n_bytes"), count(F.col("text")).alias("n_tokens"))
    return docs.withColumn("over_limit", F.col("n_tokens") > TOKEN_LIMIT)


def op9_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op10_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    judged = table(spark, sf_dir, "documents").select("doc_id", repetition.repetition(F.col("text")).alias("judged"))
    return judged.select("doc_id", "judged.*").drop("longest_repeat")


OP10 = r"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS text, coalesce(regexp_extract_all(text, '[^\x20\x09-\x0D]+'), []) AS w FROM documents),
n AS (SELECT unnest([3, 10, 101]) AS n),
grams AS (SELECT doc_id, n, p, array_to_string(w[p:p + n - 1], ' ') AS words FROM (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS p FROM d, n WHERE len(w) >= n)),
twice AS (SELECT doc_id, n, unnest(list(p)) AS p FROM grams GROUP BY doc_id, n, words HAVING count(*) > 1),
cov AS (
  SELECT doc_id, count(DISTINCT q) FILTER (n = 3) AS r3, count(DISTINCT q) FILTER (n = 10) AS r10, count(DISTINCT q) FILTER (n = 101) AS r101
  FROM (SELECT doc_id, n, unnest(range(p, p + n)) AS q FROM twice) GROUP BY doc_id),
pos AS (SELECT doc_id, w, unnest(range(1, len(w) + 1)) AS p FROM d),
lines AS (SELECT doc_id, unnest(string_split(text, E'\n')) AS line FROM d),
dup AS (SELECT doc_id, (count(*) - count(DISTINCT line))::BIGINT AS n FROM lines WHERE regexp_matches(line, '[^\x20\x09-\x0D]') GROUP BY doc_id),
m AS (
  SELECT d.doc_id, len(w)::BIGINT AS n_words, length(array_to_string(w, ''))::BIGINT AS word_chars, len(regexp_extract_all(text, '[#*$%&|<>]'))::BIGINT AS n_symbols,
    coalesce(dup.n, 0)::BIGINT AS n_dup_lines, coalesce(r3, 0)::BIGINT AS n_repeat_words, coalesce(r10, 0)::BIGINT AS covered_words, coalesce(r101, 0) > 0 AS too_long
  FROM d LEFT JOIN cov ON d.doc_id = cov.doc_id LEFT JOIN dup ON d.doc_id = dup.doc_id),
b AS (SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed FROM m)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, covered_words, base_failed,
  NOT base_failed AND covered_words <= 0.3 * n_words AND NOT too_long AS kept FROM b
"""



def _shipped(query: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    @wraps(query)
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        ship(spark)
        return query(spark, sf_dir)

    return run


_ALL: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_decontamination": op1_decontamination,
    "op2_toxicity": op2_toxicity,
    "op3_simhash": op3_simhash,
    "op4_licences": op4_licences,
    "op5_pii": op5_pii,
    "op6_lm_scores": op6_lm_scores,
    "op7_urls": op7_urls,
    "op8_token_counts": op8_token_counts,
    "op9_mixing": op9_mixing,
    "op10_quality": op10_quality,
}
QUERIES = {name: _shipped(query) for name, query in _ALL.items()}
ORACLES = {"op1_decontamination": OP1, "op4_licences": licences.oracle(), "op7_urls": OP7, "op9_mixing": mixing.ORACLE, "op10_quality": OP10}

"""One registered query per corpus operator, over whole tables, and SQL where SQL can express it."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tablesteps.llm import bpe, embedding_dedup, exact_dedup, lm, mixing, quality_classifier, quality_rules, secrets, simhash_dedup, spelling, suffix_dedup, toxicity, whitening
from tablesteps.llm.common import WORD, documents


def op1_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup.repeated(documents(spark, sf_dir)).withColumn("repeats", F.col("n_removed") > 0)


def op2_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash_dedup.near_duplicates(documents(spark, sf_dir))


def op3_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = public_tokenizers.path("byte_bpe_50k.tiktoken")
    return bpe.round_trip(documents(spark, sf_dir), path, public_tokenizers.PATTERN)


def op4_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.scan(documents(spark, sf_dir))


def op5_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.annotate(documents(spark, sf_dir))


def op8_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.taken(documents(spark, sf_dir), weights=(3, 1, 2), share=1.5, most=2.0)


def op6_lm_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lm.score(documents(spark, sf_dir), toxicity.fold(F.col("doc_id"), 7) == 2)


def op7_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules.judge(documents(spark, sf_dir))


def _scored(scores: DataFrame, held_out: int, parts: int, least: float) -> DataFrame:
    return scores.select(
        "doc_id", (toxicity.fold(F.col("doc_id"), parts) == held_out).alias("held_out"), "score", (F.col("score") >= least).cast("int").alias("predicted")
    )


def op9_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/labels.parquet")
    model = toxicity.fit(docs, labels, toxicity.fold(F.col("doc_id"), 5) != 0, "toxic")
    return _scored(toxicity.score(docs, model), 0, 5, 0.5)


def op10_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/labels.parquet")
    return _scored(quality_classifier.classify(docs, labels, toxicity.fold(F.col("doc_id"), 4) != 2), 2, 4, 0.7)


def embeddings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/embeddings.parquet")


def op11_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    white = whitening.whiten(embeddings(spark, sf_dir))
    return white.withColumn("deviation", F.col("deviation").try_cast("long"))


def op12_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embedding_dedup.near_duplicates(embeddings(spark, sf_dir))


def op13_spelling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling.variants(documents(spark, sf_dir))


QUERIES = {f.__name__: f for f in (
    op1_suffix_dedup, op2_simhash, op3_byte_bpe, op4_secret_scan, op5_exact_dedup, op6_lm_score, op7_quality_rules, op8_mixing, op9_toxicity, op10_quality_classifier, op11_whitening, op12_embedding_dedup, op13_spelling,
)}


def _sql(pattern: str) -> str:
    return pattern.replace("'", "''")


def _spans_sql(number: int, kind: str, pattern: str, group: int, condition: str) -> str:
    """Matches of a pattern with their code-point places, from the pieces between them."""
    return rf"""
 SELECT doc_id, {number} AS k, '{kind}' AS kind, v[j] AS value,
  CAST(list_sum(list_transform(p[1:j], lambda x: length(x))) + coalesce(list_sum(list_transform(m[1:j - 1], lambda x: length(x))), 0) AS BIGINT) AS a,
  length(m[j]) AS size
 FROM (SELECT *, unnest(range(1, len(m) + 1)) AS j FROM (
  SELECT doc_id, regexp_extract_all(t, '{_sql(pattern)}') AS m, regexp_extract_all(t, '{_sql(pattern)}', {group}) AS v,
   regexp_split_to_array(t, '{_sql(pattern)}') AS p FROM d))
 WHERE {condition}"""


_MIXED_SQL = (
    "(regexp_matches(v[j], '[0-9]') AND regexp_matches(v[j], '[a-z]') AND regexp_matches(v[j], '[A-Z]'))"
    f" OR regexp_matches(v[j], '^(?:{secrets.FORMATS})$')"
)

SQL = {
    "op4_secret_scan": rf"""
WITH d AS (SELECT doc_id, source, coalesce(text, '') AS t FROM documents),
base AS ({" UNION ALL ".join(_spans_sql(i, k, secrets.SEARCHED.get(k, p), g, f"length(v[j]) >= {n}") for i, (k, p, g, n) in enumerate(secrets.BASE))}),
more AS ({_spans_sql(len(secrets.BASE), secrets.OWNED, secrets.CANDIDATE, 0, _MIXED_SQL)}),
outside AS (SELECT * FROM more WHERE NOT EXISTS (
 SELECT 1 FROM base b WHERE b.doc_id = more.doc_id AND b.a < more.a + more.size AND more.a < b.a + b.size)),
every AS (SELECT * FROM base UNION ALL SELECT * FROM outside),
owners AS (SELECT value, count(DISTINCT source) AS owners, count(DISTINCT doc_id) AS repos FROM every JOIN d USING (doc_id) GROUP BY value),
told AS (
 SELECT doc_id, string_agg(s, ',' ORDER BY a, k) FILTER (k < 3) AS base, string_agg(s, ',' ORDER BY a, k) FILTER (k < 3 OR live) AS spans,
  count(*) FILTER (kind = 'assign') AS n_assign, count(*) FILTER (kind = 'access') AS n_access, count(*) FILTER (kind = 'hex') AS n_hex,
  count(*) FILTER (live) AS n_live, count(*) FILTER (NOT live) AS n_copied
 FROM (SELECT e.*, owners <= {secrets.MAX_OWNERS} AND repos <= {secrets.MAX_REPOS} AS live, kind || ':' || a || ':' || (a + size) AS s FROM every e JOIN owners USING (value)) GROUP BY doc_id)
SELECT d.doc_id, coalesce(n_assign, 0) AS n_assign, coalesce(n_access, 0) AS n_access, coalesce(n_hex, 0) AS n_hex,
 sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans, coalesce(n_live, 0) AS n_live, coalesce(n_copied, 0) AS n_copied
FROM d LEFT JOIN told USING (doc_id)""",
    "op5_exact_dedup": r"""
SELECT doc_id, min(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size,
 row_number() OVER (PARTITION BY norm ORDER BY doc_id) = 1 AS kept, sha256(norm) AS text_sha256
FROM (SELECT doc_id, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g') AS norm FROM documents)
WINDOW w AS (PARTITION BY norm)""",
    "op7_quality_rules": rf"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '{WORD}') AS w FROM documents),
grams AS (
 SELECT doc_id, i, w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] AS g
 FROM (SELECT doc_id, w, unnest(range(1, len(w) - 1)) AS i FROM d WHERE len(w) > 2)),
twice AS (SELECT doc_id, i FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, g) AS c FROM grams) WHERE c > 1),
again AS (
 SELECT doc_id, count(DISTINCT p) AS n FROM (SELECT doc_id, unnest([i, i + 1, i + 2]) AS p FROM twice) GROUP BY doc_id),
lines AS (SELECT doc_id, l, len(regexp_extract_all(l, '{WORD}')) AS n FROM (SELECT doc_id, unnest(string_split(t, chr(10))) AS l FROM d)),
judged AS (
 SELECT doc_id, l, n,
  len(regexp_extract_all(l, '{_sql(quality_rules.BAD_END)}')) * 100 > n * {quality_rules.BAD_END_PERCENT}
  OR (n < {quality_rules.FRAGMENT_WORDS} AND NOT regexp_matches(l, '{_sql(quality_rules.SENTENCE_MARK)}'))
  OR len(regexp_extract_all(l, '{_sql(quality_rules.NAVIGATION)}')) * 100 > n * {quality_rules.NAVIGATION_PERCENT}
  OR regexp_matches(l, '{_sql(quality_rules.BOILERPLATE)}') AS bad
 FROM lines WHERE n > 0),
per AS (
 SELECT doc_id, count(*) - count(DISTINCT l) AS dup, CAST(sum(n) AS BIGINT) AS n, CAST(coalesce(sum(n) FILTER (bad), 0) AS BIGINT) AS lost
 FROM judged GROUP BY doc_id),
figures AS (
 SELECT d.doc_id, len(w) AS n_words, CAST(coalesce(list_sum(list_transform(w, lambda x: length(x))), 0) AS BIGINT) AS word_chars,
  length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')) AS n_symbols, coalesce(per.dup, 0) AS n_dup_lines,
  coalesce(again.n, 0) AS n_repeat_words, coalesce(per.lost, 0) AS n_lost_words
 FROM d LEFT JOIN again USING (doc_id) LEFT JOIN per USING (doc_id))
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
 NOT base_failed AND n_lost_words * 100 <= n_words * {quality_rules.MAX_LOST_PERCENT} AS kept, n_lost_words
FROM (SELECT *, n_words < {quality_rules.MIN_WORDS} OR 100 * n_repeat_words > {quality_rules.MAX_REPEATED_PERCENT} * n_words AS base_failed FROM figures)""",
}

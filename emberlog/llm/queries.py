"""The registered query of each operator."""

from __future__ import annotations

import os
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from emberlog.llm import chosen_path, filter_audit, kneser_ney, learned_partitions, mixing, ngram_join, packing, pii, quality_rules, secrets, site_templates, source_divergence, token_files
from emberlog.llm.common import table
from emberlog.session import scratch_path

Query = Callable[[SparkSession, str], DataFrame]


def tokenizer_path() -> str:
    """``EMBERLOG_TOKENIZER``, or the public vocabulary file of the test image."""
    if given := os.environ.get("EMBERLOG_TOKENIZER"):
        return given
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def op1_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.find_personal_data(table(spark, sf_dir, "documents"))


def op2_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = scratch_path(spark, "token-files")
    token_files.write_token_files(table(spark, sf_dir, "documents"), path, tokenizer_path())
    return token_files.read_token_files(spark, path)


def op3_learned_partitions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return learned_partitions.search(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 100 == 0)


def op4_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(table(spark, sf_dir, "documents"))


def op5_kneser_ney(spark: SparkSession, sf_dir: str) -> DataFrame:
    return kneser_ney.judge_perplexity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op6_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    mix = mixing.mix_sources(table(spark, sf_dir, "documents"))
    return mix.select(F.col("row.doc_id").alias("doc_id"), "size", "source_size", "target", "taken")


def op7_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.scan_secrets(table(spark, sf_dir, "documents"))


def op8_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules.judge_quality(table(spark, sf_dir, "documents"))


def op9_site_templates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return site_templates.extract_main_text(table(spark, sf_dir, "pages"))


def op10_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.near_duplicates(table(spark, sf_dir, "documents"))


def op11_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filter_audit.audit_filters(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op12_source_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return source_divergence.divergence(table(spark, sf_dir, "documents"))


def op13_chosen_path(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chosen_path.near_duplicates(table(spark, sf_dir, "documents"))


OP6_SQL = """
WITH hashed AS (
  SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+')) AS size,
         ('0x' || substr(md5(coalesce(CAST(doc_id AS VARCHAR), '') || ':' || coalesce(text, '')), 1, 15))::BIGINT AS hash
  FROM documents),
sources AS (
  SELECT source, sum(size)::BIGINT AS source_size, row_number() OVER (ORDER BY source NULLS LAST) AS place
  FROM hashed GROUP BY source),
weighed AS (SELECT source, source_size, CASE place % 3 WHEN 1 THEN 3 WHEN 2 THEN 1 ELSE 2 END AS weight FROM sources),
-- Sources fill up in the order of 2 * size / weight: the first that stays below its cap fixes the level for all others.
ranked AS (
  SELECT *, row_number() OVER (ORDER BY source_size / weight, weight, source NULLS LAST) AS turn,
         1.5::DOUBLE * sum(source_size) OVER () - 2.0::DOUBLE * coalesce(sum(source_size) OVER fuller, 0) AS rest,
         sum(weight) OVER () - coalesce(sum(weight) OVER fuller, 0) AS heft
  FROM weighed
  WINDOW fuller AS (ORDER BY source_size / weight, weight, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
level AS (
  SELECT arg_min(rest, turn) AS rest, arg_min(heft, turn) AS heft
  FROM ranked WHERE rest * weight / heft < 2.0::DOUBLE * source_size),
targets AS (
  SELECT source, source_size, least(2.0::DOUBLE * source_size, coalesce(level.rest * weight / level.heft, 2.0::DOUBLE * source_size)) AS target
  FROM weighed CROSS JOIN level),
budgets AS (
  SELECT *, CASE WHEN source_size > 0 THEN CAST(floor(target / source_size) AS BIGINT) ELSE 0 END AS base FROM targets),
groups AS (
  SELECT source, hash, sum(size) AS held, sum(sum(size)) OVER (PARTITION BY source ORDER BY hash) - sum(size) AS before
  FROM hashed GROUP BY source, hash)
SELECT doc_id, size::BIGINT AS size, source_size, target,
       (size * (base + CASE WHEN target - base * source_size > 0 AND 2 * (target - base * source_size - before) >= held THEN 1 ELSE 0 END))::BIGINT AS taken
FROM hashed
JOIN budgets ON hashed.source IS NOT DISTINCT FROM budgets.source
JOIN groups ON hashed.source IS NOT DISTINCT FROM groups.source AND hashed.hash = groups.hash
"""

OP11_SQL = """
WITH texts AS (
  SELECT doc_id, coalesce(source, '') AS part, coalesce(text, '') AS text,
         regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+') AS words
  FROM documents),
flags AS (
  SELECT doc_id, part,
         CASE WHEN len(words) < 200 THEN 1 ELSE 0 END
         + CASE WHEN 100 * len(list_distinct(words)) < 50 * len(words) THEN 2 ELSE 0 END
         + CASE WHEN 100 * length(regexp_replace(text, '[^A-Z]', '', 'g')) > 2 * length(text) THEN 4 ELSE 0 END
         + CASE WHEN regexp_matches(text, '[#$%&*|]') THEN 8 ELSE 0 END
         + CASE WHEN doc_id > min(doc_id) OVER (PARTITION BY text) THEN 16 ELSE 0 END AS mask
  FROM texts),
marks AS (SELECT doc_id, max(quality = 1) AS good, max(toxic = 1) AS toxic FROM labels GROUP BY doc_id),
counts AS (
  SELECT part, mask, count(*) AS n, count(*) FILTER (WHERE good) AS good, count(*) FILTER (WHERE toxic) AS toxic
  FROM flags LEFT JOIN marks USING (doc_id) GROUP BY part, mask),
letters AS (SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS letter, unnest([1, 2, 4, 8, 16]) AS bit),
orders AS (
  SELECT a.letter || b.letter || c.letter || d.letter || e.letter AS filter_order,
         [a.bit, b.bit, c.bit, d.bit, e.bit] AS bits
  FROM letters a, letters b, letters c, letters d, letters e
  WHERE a.bit | b.bit | c.bit | d.bit | e.bit = 31),
steps AS (
  SELECT filter_order, step::INTEGER AS step, bits[step] AS bit, coalesce(list_sum(bits[1:step - 1]), 0)::INTEGER AS before
  FROM orders, range(1, 6) AS r(step))
SELECT part, filter_order, step,
       coalesce(sum(n) FILTER (WHERE mask & (bit | before) = 0), 0)::BIGINT AS kept,
       coalesce(sum(n) FILTER (WHERE mask & bit <> 0 AND mask & before = 0), 0)::BIGINT AS removed,
       coalesce(sum(n) FILTER (WHERE mask & bit <> 0 AND mask & before <> 0), 0)::BIGINT AS redundant,
       coalesce(sum(n) FILTER (WHERE mask = bit), 0)::BIGINT AS unique_fails,
       coalesce(sum(good) FILTER (WHERE mask & bit <> 0 AND mask & before = 0), 0)::BIGINT AS good_lost,
       coalesce(sum(toxic) FILTER (WHERE mask & bit <> 0 AND mask & before = 0), 0)::BIGINT AS toxic_lost,
       coalesce(sum(n * 120 // greatest(1, bit_count(mask))) FILTER (WHERE mask & bit <> 0), 0)::BIGINT AS shapley
FROM counts, steps GROUP BY part, filter_order, step
"""

OP12_SQL = """
WITH docs AS (
  SELECT row_number() OVER () AS row_id, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
         regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                            '[a-z\\x{80}-\\x{10FFFF}]+') AS terms
  FROM documents),
groups AS (SELECT DISTINCT lang, source FROM docs),
words AS (SELECT row_id, lang, source, unnest(terms) AS term FROM docs),
vocabulary AS (SELECT lang, term, count(*) AS held FROM words GROUP BY lang, term HAVING count(DISTINCT row_id) >= 10),
counts AS (SELECT lang, source, term, count(*) AS held FROM words GROUP BY lang, source, term),
dense AS (
  SELECT lang, source, term, coalesce(counts.held, 0) AS held, vocabulary.held AS in_lang
  FROM groups JOIN vocabulary USING (lang) LEFT JOIN counts USING (lang, source, term)),
shares AS (
  SELECT lang, source, term, held,
         1 + 1000000000::HUGEINT * (held + 2) // (sum(held) OVER own + 2 * count(*) OVER own) AS p,
         1 + 1000000000::HUGEINT * (in_lang + 2) // (sum(in_lang) OVER own + 2 * count(*) OVER own) AS q
  FROM dense WINDOW own AS (PARTITION BY lang, source)),
pairs AS (
  SELECT a.lang, a.source, b.source AS item, sum((a.p - b.p) * (a.p - b.p) // (a.p + b.p)) AS value
  FROM shares a JOIN shares b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY ALL),
found AS (
  SELECT a.lang, a.source, 'pair' AS part, b.source AS item, coalesce(value, 0) AS value
  FROM groups a JOIN groups b ON a.lang = b.lang AND a.source <> b.source
  LEFT JOIN pairs ON pairs.lang = a.lang AND pairs.source = a.source AND pairs.item = b.source
  UNION ALL
  SELECT lang, source, 'term', term, (p - q) * (p - q) // (p + q) FROM shares WHERE held > 0 AND p > q)
SELECT lang, source, part, item, value::BIGINT AS value,
       row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item)::INTEGER AS rank
FROM found QUALIFY part = 'pair' OR rank <= 10
"""

QUERIES: dict[str, Query] = {
    "op1_pii": op1_pii,
    "op2_token_files": op2_token_files,
    "op3_learned_partitions": op3_learned_partitions,
    "op4_packing": op4_packing,
    "op5_kneser_ney": op5_kneser_ney,
    "op6_mixing": op6_mixing,
    "op7_secrets": op7_secrets,
    "op8_quality_rules": op8_quality_rules,
    "op9_site_templates": op9_site_templates,
    "op10_ngram_join": op10_ngram_join,
    "op11_filter_audit": op11_filter_audit,
    "op12_source_divergence": op12_source_divergence,
    "op13_chosen_path": op13_chosen_path,
}

ORACLE_SQL: dict[str, str] = {"op6_mixing": OP6_SQL, "op11_filter_audit": OP11_SQL, "op12_source_divergence": OP12_SQL}

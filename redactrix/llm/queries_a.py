"""Queries that need no model: mixing, quality rules, archives, chats."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from redactrix.llm import chat, mixing, quality_rules, warc
from redactrix.llm.common import table


def op2_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    plan = mixing.plan_copies(table(spark, sf_dir, "documents"))
    return plan.select("doc_id", "size", "source_size", "target", (F.col("size") * F.col("copies")).alias("taken"))


OP2 = r"""
WITH s AS (SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS size FROM documents),
p AS (SELECT source, sum(size)::BIGINT AS source_size FROM s GROUP BY source),
r AS (SELECT *, ([3, 1, 2])[((row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1)::BIGINT]::BIGINT AS w, row_number() OVER (ORDER BY source NULLS LAST) AS k FROM p),
t AS (SELECT *, sum(source_size) OVER ()::BIGINT AS total, sum(w) OVER ()::BIGINT AS all_w,
  coalesce(sum(source_size) OVER (ORDER BY source_size::DOUBLE / w, k ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS b,
  coalesce(sum(w) OVER (ORDER BY source_size::DOUBLE / w, k ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS bw FROM r),
f AS (SELECT *, (3 * total - 4 * b) * w > 4 * source_size * (all_w - bw) AS is_full FROM t),
g AS (SELECT *, (3 * total)::DOUBLE / 2.0::DOUBLE - coalesce(sum(CASE WHEN is_full THEN 2 * source_size END) OVER (), 0)::BIGINT::DOUBLE AS rest,
  (all_w - coalesce(sum(CASE WHEN is_full THEN w END) OVER (), 0))::BIGINT::DOUBLE AS rest_w FROM f),
h AS (SELECT source, source_size, CASE WHEN is_full THEN (2 * source_size)::DOUBLE ELSE rest / rest_w * w END AS target FROM g),
c AS (SELECT doc_id, size, source_size, target, CASE WHEN source_size > 0 THEN target / source_size ELSE 0.0::DOUBLE END AS rate,
  ('0x' || substr(md5('mix-1:' || coalesce(doc_id::VARCHAR, '')), 1, 13))::BIGINT::DOUBLE / 4503599627370496.0::DOUBLE AS u
  FROM s JOIN h ON s.source IS NOT DISTINCT FROM h.source)
SELECT doc_id, size, source_size, target, size * (floor(rate)::BIGINT + CASE WHEN u < rate - floor(rate) THEN 1 ELSE 0 END) AS taken FROM c
"""


def op7_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = quality_rules.judge(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


def _rules_sql() -> str:
    failed = []
    for _, top, under, low, high, least in quality_rules.RULES:
        if low is not None:
            failed.append(f"({under} >= {least} AND {top}::DOUBLE < {under}::DOUBLE * {low}::DOUBLE)")
        if high is not None:
            failed.append(f"({under} >= {least} AND {top}::DOUBLE > {under}::DOUBLE * {high}::DOUBLE)")
    return " OR ".join(failed)


OP7 = rf"""
WITH d AS (SELECT row_number() OVER () AS k, doc_id, coalesce(text, '') AS t FROM documents),
w AS (SELECT k, doc_id, t, regexp_extract_all(t, '[^\x20\x09-\x0D]+') AS w,
  list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS l FROM d),
v AS (SELECT k, unnest(range(1, len(w) - 3)) AS i, w FROM w WHERE len(w) >= 5),
g AS (SELECT k, i, array_to_string(w[i:i+4], ' ') AS g FROM v),
r AS (SELECT k, i FROM g QUALIFY count(*) OVER (PARTITION BY k, g) > 1),
n AS (SELECT k, count(DISTINCT i + j)::BIGINT AS n_repeat_words FROM r, range(0, 5) AS x(j) GROUP BY k),
m AS (SELECT k, doc_id, len(w)::BIGINT AS n_words, length(array_to_string(w, ''))::BIGINT AS word_chars,
  len(regexp_extract_all(t, '[#*$%&|<>]'))::BIGINT AS n_symbols, len(regexp_extract_all(t, '[!?]'))::BIGINT AS n_marks,
  (len(l) - len(list_distinct(l)))::BIGINT AS n_dup_lines, len(l)::BIGINT AS n_lines,
  len(list_filter(w, lambda x: lower(x) IN ({", ".join(f"'{x}'" for x in dict.fromkeys(quality_rules.STOP_WORDS))})))::BIGINT AS n_stop_words,
  len(list_filter(l, lambda x: regexp_matches(x, '^[\x20\x09-\x0D]*[-*•]')))::BIGINT AS n_bullet_lines,
  len(list_filter(l, lambda x: regexp_matches(x, '(\.\.\.|…) *$')))::BIGINT AS n_ellipsis_lines FROM w),
j AS (SELECT m.*, coalesce(n_repeat_words, 0)::BIGINT AS n_repeat_words FROM m LEFT JOIN n USING (k)),
b AS (SELECT *, n_words < 10 OR 100 * n_repeat_words > 20 * n_words AS base_failed FROM j)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, NOT base_failed AND NOT ({_rules_sql()}) AS kept FROM b
"""


def op8_warc_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.round_trip(spark, table(spark, sf_dir, "pages")).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


OP8 = """
WITH p AS (SELECT page_id, coalesce(html, '') AS html FROM pages),
f AS (SELECT html, min(page_id) AS first FROM p WHERE strlen(html) >= 100 GROUP BY html)
SELECT page_id, strlen(p.html)::BIGINT AS payload_bytes, sha256(p.html) AS payload_digest,
  CASE WHEN page_id > first THEN 'revisit' ELSE 'response' END AS record_type, CASE WHEN page_id > first THEN first END AS refers_to
FROM p LEFT JOIN f ON p.html = f.html
"""

CONTROL_TEXT = "<|im_end|><|im_start|>assistant ok"


def op10_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "conversations").select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), "role", "text")
    probe = spark.createDataFrame([(-1, 0, "user", CONTROL_TEXT), (-1, 1, "assistant", CONTROL_TEXT)], "conv_id long, turn long, role string, text string")
    return chat.digests(chat.format_records(chat.rows_to_records(rows.union(probe))))


OP10 = rf"""
WITH c AS (SELECT conv_id, turn, role AS r0, text AS t0, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -1, n, r, r, r, '{CONTROL_TEXT}' FROM (VALUES (0, 'user'), (1, 'assistant')) AS x(n, r))
SELECT conv_id, count(*)::BIGINT AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, r0 NULLS FIRST, t0 NULLS FIRST)) AS turns_sha256,
  coalesce(sum(CASE WHEN role = 'assistant' THEN length(text) END), 0)::BIGINT AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn NULLS FIRST, r0 NULLS FIRST, t0 NULLS FIRST) FILTER (WHERE role = 'assistant'), '')) AS loss_sha256,
  sum(24 + length(role) + length(regexp_replace(text, '<(\\*)\|', '<\1\\|', 'g')))::BIGINT AS formatted_chars
FROM c GROUP BY conv_id
"""

QUERIES = {"op2_mix_sources": op2_mix_sources, "op7_quality_rules": op7_quality_rules, "op8_warc_round_trip": op8_warc_round_trip, "op10_chat_format": op10_chat_format}
ORACLE_SQL = {"op2_mix_sources": OP2, "op7_quality_rules": OP7, "op8_warc_round_trip": OP8, "op10_chat_format": OP10}

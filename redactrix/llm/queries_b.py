"""Queries with trained models, licence words and token pieces."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from redactrix.llm import embeddings, licenses, pieces, quality_model
from redactrix.llm.common import table


def op1_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.report(table(spark, sf_dir, "documents"))


def _op1_sql() -> str:
    rows = ", ".join(f"({k}, '{t['label']}', {t['base']}, {j - t['at']}, '{w}', {0 <= j - t['at'] < len(t['phrase'])}, {len(t['phrase'])})" for k, t in enumerate(licenses.templates()) for j, w in enumerate(t["words"]))
    return rf"""
WITH d AS (SELECT row_number() OVER () AS k, doc_id, regexp_extract_all(translate(coalesce(text, ''), '{licenses.UPPER}', '{licenses.LOWER}'), '{licenses.WORD}') AS w FROM documents),
p(t, label, base, j, tok, in_phrase, n_phrase) AS (VALUES {rows}),
u AS (SELECT k, unnest(w) AS tok, unnest(range(0, len(w))) AS i FROM d),
x AS (SELECT * FROM u WHERE tok IN (SELECT tok FROM p)),
n AS (SELECT count(*) AS n FROM documents),
f AS (SELECT v.tok, greatest(1, floor(1000 * ln((n.n + 1.0::DOUBLE) / (count(DISTINCT x.k) + 1.0::DOUBLE)))::BIGINT) AS weight FROM (SELECT DISTINCT tok FROM p) v CROSS JOIN n LEFT JOIN x ON x.tok = v.tok GROUP BY v.tok, n.n),
tot AS (SELECT t, sum(weight)::BIGINT AS total FROM p JOIN f USING (tok) GROUP BY t),
h AS (SELECT x.k, p.t, p.label, p.base, x.i - p.j AS start, sum(f.weight)::BIGINT AS weight, count(*) FILTER (WHERE in_phrase) AS in_place, any_value(n_phrase) AS n_phrase
  FROM x JOIN p USING (tok) JOIN f USING (tok) GROUP BY ALL),
s AS (SELECT h.k, h.label, h.base, h.start, h.weight::DOUBLE / total::DOUBLE AS score FROM h JOIN tot USING (t) WHERE in_place = n_phrase),
g AS (SELECT k, count(*) FILTER (WHERE base)::BIGINT AS n_base, min(start) FILTER (WHERE base)::BIGINT AS first_word, max(start) FILTER (WHERE base)::BIGINT AS last_word,
  string_agg(DISTINCT label, ',' ORDER BY label) FILTER (WHERE base) AS base_labels, string_agg(DISTINCT label, ',' ORDER BY label) AS labels, max(score) AS score
  FROM s WHERE base OR score >= {licenses.MIN_SCORE}::DOUBLE GROUP BY k)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_base, 0)::BIGINT AS n_base, first_word, last_word, coalesce(base_labels, '') AS base_labels, coalesce(labels, '') AS labels, coalesce(score, 0.0)::DOUBLE AS score
FROM d LEFT JOIN g USING (k)
"""


def model_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


def op9_piece_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pieces.round_trip_digests(table(spark, sf_dir, "documents"), model_path())


def op5_embedding_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embeddings.near_duplicates(table(spark, sf_dir, "embeddings"))


OP5 = """
WITH RECURSIVE v AS (SELECT vec_id, label, embedding::DOUBLE[] AS x FROM embeddings),
g AS (SELECT *, sqrt(list_dot_product(x, x)) AS norm FROM v WHERE label IS NOT NULL AND x IS NOT NULL
  AND len(list_filter(x, lambda e: e IS NULL OR isnan(e) OR isinf(e))) = 0 AND len(list_filter(x, lambda e: e <> 0)) > 0),
l AS (SELECT a.vec_id AS a, b.vec_id AS b FROM g a JOIN g b ON a.label = b.label AND a.vec_id <> b.vec_id AND list_dot_product(a.x, b.x) / (a.norm * b.norm) >= 0.98::DOUBLE),
r AS (SELECT vec_id AS a, vec_id AS b FROM v UNION SELECT r.a, l.b FROM r JOIN l ON r.b = l.a),
c AS (SELECT a AS vec_id, min(b) AS component_id FROM r GROUP BY a),
n AS (SELECT a AS vec_id, count(*)::BIGINT AS n FROM l GROUP BY a)
SELECT vec_id, coalesce(n, 0)::BIGINT AS n_links, component_id, vec_id = component_id AS kept FROM c LEFT JOIN n USING (vec_id)
"""

MIN_SCORE = 0.3


def op6_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    out = quality_model.score(docs, quality_model.train(docs, table(spark, sf_dir, "labels")))
    return out.select("doc_id", "held_out", "score", (F.col("score") >= MIN_SCORE).cast("int").alias("predicted"))


QUERIES = {"op5_embedding_near_dedup": op5_embedding_near_dedup, "op6_quality_classifier": op6_quality_classifier, "op1_license_scan": op1_license_scan, "op9_piece_round_trip": op9_piece_round_trip}
ORACLE_SQL = {"op5_embedding_near_dedup": OP5, "op1_license_scan": _op1_sql()}

"""Queries over shared text: the n-gram join and suffix-array deduplication."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from redactrix.llm import ngram_join, suffix_dedup
from redactrix.llm.common import table


def op4_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.similar_groups(table(spark, sf_dir, "documents"), words=4, percent=85)


OP4 = r"""
WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS (SELECT doc_id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 4 THEN [array_to_string(w, ' ')] ELSE list_distinct(list_transform(range(1, len(w) - 2), lambda i: array_to_string(w[i:i+3], ' '))) END AS s FROM w),
g AS (SELECT doc_id, len(s) AS n, unnest(s) AS g FROM s),
p AS (SELECT a.doc_id AS a, b.doc_id AS b, any_value(a.n) AS na, any_value(b.n) AS nb, count(*) AS k FROM g a JOIN g b ON a.g = b.g AND a.doc_id <> b.doc_id GROUP BY ALL),
l AS (SELECT a, b FROM p WHERE 100 * k >= 85 * (na + nb - k)),
r AS (SELECT doc_id AS a, doc_id AS b FROM s UNION SELECT r.a, l.b FROM r JOIN l ON r.b = l.a),
c AS (SELECT a AS doc_id, min(b) AS component_id FROM r GROUP BY a)
SELECT doc_id, len(s)::BIGINT AS n_shingles, component_id FROM s JOIN c USING (doc_id)
"""

def op3_suffix_array_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup.dedup_digests(table(spark, sf_dir, "documents"))


OP3 = """
WITH d AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS h, strlen(coalesce(text, ''))::BIGINT AS n FROM documents),
x AS (SELECT doc_id, h, unnest(range(0, (n + 999) // 1000)) AS c FROM d),
c1 AS (SELECT doc_id, c, substr(h, 2000 * c + 1, 2198) AS h FROM x),
y AS (SELECT doc_id, c, h, unnest(range(0, least(1000, strlen(h) // 2 - 99))) AS j FROM c1 WHERE strlen(h) >= 200),
v AS (SELECT doc_id, 1000 * c + j AS s, md5(substr(h, 2 * j + 1, 200)) AS g FROM y),
f AS (SELECT doc_id, s FROM v QUALIFY row_number() OVER (PARTITION BY g ORDER BY doc_id, s) > 1),
i AS (SELECT doc_id, s, CASE WHEN s <= lag(s) OVER (PARTITION BY doc_id ORDER BY s) + 100 THEN 0 ELSE 1 END AS new FROM f),
k AS (SELECT doc_id, s, sum(new) OVER (PARTITION BY doc_id ORDER BY s) AS run FROM i),
r AS (SELECT doc_id, run, min(s) AS b, max(s) + 100 AS e FROM k GROUP BY ALL),
p AS (SELECT doc_id, coalesce(lag(e) OVER (PARTITION BY doc_id ORDER BY b), 0) AS x, b AS y FROM r UNION ALL SELECT doc_id, max(e), NULL FROM r GROUP BY doc_id),
t AS (SELECT doc_id, string_agg(substr(h, 2 * x + 1, 2 * (coalesce(y, n) - x)), '' ORDER BY x) AS kept FROM p JOIN d USING (doc_id) GROUP BY doc_id),
c AS (SELECT doc_id, sum(e - b)::BIGINT AS n_removed, count(*)::BIGINT AS n_spans FROM r GROUP BY doc_id)
SELECT doc_id, n AS n_bytes, coalesce(n_removed, 0)::BIGINT AS n_removed, coalesce(n_spans, 0)::BIGINT AS n_spans, sha256(unhex(coalesce(kept, h))) AS kept_sha256
FROM d LEFT JOIN c USING (doc_id) LEFT JOIN t USING (doc_id)
"""

QUERIES = {"op3_suffix_array_dedup": op3_suffix_array_dedup, "op4_ngram_jaccard_join": op4_ngram_jaccard_join}
ORACLE_SQL = {"op3_suffix_array_dedup": OP3, "op4_ngram_jaccard_join": OP4}

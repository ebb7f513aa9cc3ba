"""The registered queries of this subpackage, and their SQL where SQL can express them."""

from __future__ import annotations

from redactrix.llm import queries_a, queries_b, queries_c

QUERIES = {**queries_a.QUERIES, **queries_b.QUERIES, **queries_c.QUERIES}
ORACLE_SQL = {**queries_a.ORACLE_SQL, **queries_b.ORACLE_SQL, **queries_c.ORACLE_SQL}

"""Registered queries of the de-identification engine and their SQL."""

from redactrix.plans import constructed, real_text, results, states

QUERIES = {**real_text.QUERIES, **constructed.QUERIES, **results.QUERIES, **states.QUERIES}
ORACLE_SQL = {**real_text.ORACLE_SQL, **constructed.ORACLE_SQL, **results.ORACLE_SQL, **states.ORACLE_SQL}

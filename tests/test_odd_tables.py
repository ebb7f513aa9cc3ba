"""Queries against their SQL on small tables with odd rows."""

import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).parent.parent / "tools"))
from compare import compare  # noqa: E402

from redactrix.plans import registry  # noqa: E402

SF = Path("/root/testdata/sf0.001")


@pytest.fixture
def held(spark, tmp_path):
    """Is a query equal to its SQL where one table holds other rows?"""

    def run(name, table, rows, schema):
        for other in SF.glob("*.parquet"):
            (tmp_path / other.name).symlink_to(other)
        (tmp_path / f"{table}.parquet").unlink()
        spark.createDataFrame(rows, schema).coalesce(1).write.parquet(str(tmp_path / f"{table}.parquet"))
        return compare(spark, str(tmp_path), name, registry.QUERIES[name], registry.ORACLE_SQL[name])

    return run


#: A valid social number before letters, alone and before a passport; line ends other than line feeds.
TOKENS = [(1, 'one\ntoken = "15369567102e9c3"'), (2, "15369567102e9c3 and 12 34 567890"), (3, "a\rb 8 900 123-45-67\x0bc\nx@y.org"), (4, ""), (5, None), (6, "+44 20 7946 0958 1")]


@pytest.mark.parametrize("name", ["audit_first_match_lines", "audit_kind_counts"])
def test_audit_knows_the_kinds_of_its_sql(held, name):
    assert " OK " in held(name, "documents", TOKENS, "doc_id long, text string")


def test_audit_of_pages_knows_the_kinds_of_its_sql(held):
    assert " OK " in held("audit_pages_kind_counts", "pages", TOKENS, "page_id long, html string")


def test_line_stats_of_odd_line_ends(held):
    rows = [(1, ""), (2, None), (3, "\n"), (4, "a\rb\r\nc"), (5, "x\x0by z\u0085\n\n"), (6, "\t\n  \n​"), (7, "last\n \n")]
    assert " OK " in held("line_explode_stats", "documents", rows, "doc_id long, text string")


def test_labelled_social_numbers_that_look_like_phones(held):
    """From key 75,767 on the numbers begin with 7 or 8, as phones do."""
    assert " OK " in held("mask_snils_docnum_guard", "customer", [(k,) for k in (0, 1, 75_768, 75_769, 88_398, 88_399, 101_000, 900_000, 2_000_001)], "c_custkey long")

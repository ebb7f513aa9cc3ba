"""Every registered query of the engine against its SQL on the smallest tables."""

import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).parent.parent / "tools"))
from compare import compare  # noqa: E402

import __spark_entry__  # noqa: E402
from redactrix.plans import registry  # noqa: E402

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(registry.QUERIES))
def test_query_equals_sql(spark, name):
    assert " OK " in compare(spark, SF, name, registry.QUERIES[name], registry.ORACLE_SQL[name])


def test_entry(spark):
    assert __spark_entry__.entry(spark).count() > 0
    assert set(registry.QUERIES) <= set(__spark_entry__.queries())

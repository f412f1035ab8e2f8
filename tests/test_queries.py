"""Every registered query beside its SQL on the smallest tables."""

import pytest

import __spark_entry__ as entry
from checks.compare import compare
from checks.queries import ORACLES, QUERIES

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query_equals_its_sql(spark, name):
    ok, text = compare(spark, SF, name)
    assert ok, text


def test_registry():
    assert set(entry.oracle_sql()) <= set(entry.queries())
    assert set(QUERIES) <= set(entry.queries()) and set(ORACLES) <= set(entry.oracle_sql())


def test_entry(spark):
    df = entry.entry(spark)
    assert {"id", "fragments_count", "text_length", "dublincore.title"} <= set(df.columns)
    assert df.count() == 200

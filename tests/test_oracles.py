"""Every registered query with a SQL equivalent gives its rows."""

import pytest

import __spark_entry__ as entry
from oracle import from_duckdb, from_spark

NAMES = sorted(entry.oracle_sql())


@pytest.mark.parametrize("name", NAMES)
def test_query_equals_sql(spark, sf_dir, name):
    columns, rows = from_spark(entry.queries()[name](spark, sf_dir))
    want_columns, want = from_duckdb(entry.oracle_sql()[name], sf_dir)
    assert columns == want_columns
    assert len(rows) == len(want)
    differing = [(a, b) for a, b in zip(rows, want) if not same(a, b)]
    assert not differing, differing[:3]


def same(a, b):
    return all(x == y or (isinstance(x, float) and isinstance(y, float) and abs(x - y) <= 2e-5 * max(1.0, abs(y))) for x, y in zip(a, b))


def test_every_query_is_registered_once():
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_entry_runs(spark):
    assert entry.entry(spark).count() == 1000

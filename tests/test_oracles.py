"""Every archive query against its SQL, and those without SQL for rows and a stable schema."""

import pytest

from talespan import catalog

from .conftest import DATA, rows_of


@pytest.mark.parametrize("name", sorted(catalog.ORACLES))
def test_matches_sql(spark, duck, name):
    got, want = catalog.QUERIES[name](spark, DATA).toPandas(), duck.sql(catalog.ORACLES[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    assert rows_of(got) == rows_of(want)


@pytest.mark.parametrize("name", sorted(set(catalog.QUERIES) - set(catalog.ORACLES)))
def test_runs_without_sql(spark, name):
    frame = catalog.QUERIES[name](spark, DATA)
    assert frame.schema == catalog.QUERIES[name](spark, DATA).schema
    rows = frame.collect()
    assert rows and sorted(map(str, rows)) == sorted(map(str, catalog.QUERIES[name](spark, DATA).collect()))


def test_entry_contract(spark):
    import __spark_entry__ as e

    assert e.entry(spark).count() == 15
    assert set(e.oracle_sql()) <= set(e.queries())

"""Every registered query against its SQL at the smallest scale."""

import oracle
import pytest

import __spark_entry__ as entry
from datavigil.plans import catalog

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    return oracle.duck(SF)


@pytest.mark.parametrize("name", sorted(entry.queries()))
def test_query(spark, con, name):
    ok, note = oracle.compare(spark, con, name, entry.queries()[name], entry.oracle_sql().get(name), SF)
    assert ok, note


def test_entry_runs(spark):
    assert entry.entry(spark).count() > 0


def test_every_query_has_sql():
    assert set(catalog.QUERIES) == set(catalog.ORACLE)

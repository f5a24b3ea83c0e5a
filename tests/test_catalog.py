"""Every catalogue query against its SQL; those without SQL must run and give rows."""

import pytest

import __spark_entry__ as entry
import compare
from lodestream.plans.catalog import QUERIES
from lodestream.plans.oracles import ORACLES


@pytest.fixture(scope="session")
def con(sf):
    return compare.duck(sf)


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_equals_sql(spark, con, sf, name):
    assert compare.difference(spark, con, sf, name) is None


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLES)))
def test_runs(spark, sf, name):
    assert entry.queries()[name](spark, sf).count() > 0


def test_every_oracle_has_a_query():
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_entry(spark):
    assert entry.entry(spark).count() > 0

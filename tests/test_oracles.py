"""Every query with SQL gives the rows and types of that SQL; the others give rows."""

import pytest

from check_oracles import compare, connect, types_of
from chatloom.plans.oracles import ORACLES
from chatloom.plans.registry import QUERIES

SF_DIR = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    return connect(SF_DIR)


def test_every_oracle_has_a_query():
    assert set(ORACLES) <= set(QUERIES)


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_equals_sql(spark, con, name):
    assert compare(spark, con, SF_DIR, name, QUERIES[name], ORACLES[name]) is None
    assert types_of(QUERIES[name](spark, SF_DIR), con, ORACLES[name]) == {}


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLES)))
def test_gives_rows(spark, name):
    assert QUERIES[name](spark, SF_DIR).count() > 0


def test_entry(spark):
    from __spark_entry__ import entry

    assert entry(spark).count() > 0

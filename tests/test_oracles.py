"""Every registered query against its SQL on the smallest test tables."""

import os

import pytest

from __spark_entry__ import entry, oracle_sql, queries
from checks.verify import connect, differences

SF_DIR = os.environ.get("CHECK_SF_DIR", "/root/testdata/sf0.001")
pytestmark = pytest.mark.skipif(not os.path.isdir(SF_DIR), reason="test tables not there")


@pytest.fixture(scope="module")
def con():
    return connect(SF_DIR)


@pytest.mark.parametrize("name", sorted(queries()))
def test_query(spark, con, name):
    df = queries()[name](spark, SF_DIR)
    if name in oracle_sql():
        assert differences(df, con, oracle_sql()[name]) == []
    else:
        assert df.count() > 0


def test_entry(spark):
    assert entry(spark).count() == 25


def test_every_oracle_has_a_query():
    assert set(oracle_sql()) <= set(queries())

"""Every registered check against its SQL oracle on sf0.001 (the driver runs
the same comparison at sf0.01)."""

import os

import pytest

import __spark_entry__ as E
from tests.conftest import SF_SMALL
from tests.harness import compare, duck

KEYS = list(E.BASE_KEYS)


@pytest.fixture(scope="module")
def con():
    return duck(SF_SMALL)


def test_every_check_has_an_oracle():
    missing = [k for k in KEYS if k not in E.oracle_sql()]
    assert missing == []


@pytest.mark.skipif(not os.path.isdir(SF_SMALL), reason="driver test data not present")
@pytest.mark.parametrize("key", KEYS)
def test_check_matches_oracle(spark, con, key):
    ok, msg = compare(spark, key, SF_SMALL, con)
    assert ok, msg


@pytest.mark.skipif(not os.path.isdir(SF_SMALL), reason="driver test data not present")
def test_entry(spark):
    df = E.entry(spark)
    assert df.columns == ["o_custkey", "order_list"]
    assert df.count() > 0

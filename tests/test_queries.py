"""Every registered query against its comparison SQL."""

from __future__ import annotations

import os

import pytest
from oracle import TESTDATA, compare, connect

from __spark_entry__ import entry, oracle_sql, queries

SF = f"{TESTDATA}/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="test tables not present")


@pytest.fixture(scope="module")
def con():
    return connect(SF)


@pytest.mark.parametrize("name", sorted(oracle_sql()))
def test_query(spark, con, name):
    problem = compare(queries()[name](spark, SF), con, oracle_sql()[name])
    assert problem is None


def test_entry(spark):
    df = entry(spark)
    assert "cv_total" in df.columns and df.count() > 0

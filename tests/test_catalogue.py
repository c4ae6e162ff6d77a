"""Every catalogue query against its SQL; those without SQL give rows."""

import pytest

from lumenframe.plans.scripted import ORACLE_SQL, QUERIES
from tests.oracle import assert_same

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_matches_sql(spark, name):
    assert_same(QUERIES[name](spark, SF), ORACLE_SQL[name], SF)


@pytest.mark.parametrize("name", sorted(QUERIES.keys() - ORACLE_SQL.keys()))
def test_gives_rows(spark, name):
    assert QUERIES[name](spark, SF).count() == 500

"""Corpus queries against their SQL on the smallest tables."""

import pytest

from lumenframe.llm.queries import ORACLE_SQL, QUERIES
from tests.oracle import assert_same

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_matches_sql(spark, name):
    assert_same(QUERIES[name](spark, SF), ORACLE_SQL[name], SF)


def test_every_numbered_operator_has_a_query():
    assert sorted(int(n[2:].split("_")[0]) for n in QUERIES) == list(range(1, 14))

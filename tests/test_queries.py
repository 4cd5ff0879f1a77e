"""Every query of the reference's operators against its SQL on the smallest tables."""

import os

import pytest

from tests.oracle import connect, same
from trackyard import registry

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables here")


@pytest.fixture(scope="module")
def duck():
    return connect(SF)


@pytest.mark.parametrize("name", sorted(registry.ORACLE_SQL))
def test_query(spark, duck, name):
    same(registry.QUERIES[name](spark, SF), duck.sql(registry.ORACLE_SQL[name]))


def test_all_have_sql():
    assert set(registry.QUERIES) == set(registry.ORACLE_SQL)

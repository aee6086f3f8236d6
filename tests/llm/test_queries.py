"""Every query of the subpackage over the smallest test tables, against its SQL where it has one."""

import os

import pytest

from sievewright.llm.oracles import ORACLES
from sievewright.llm.queries import QUERIES
from tests.compare import database, rows

DATA = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="no test tables here")


@pytest.fixture(scope="module")
def duck():
    return database(DATA)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, duck, name):
    got = QUERIES[name](spark, DATA).toPandas()
    assert len(set(got.columns)) == len(got.columns)
    if name in ORACLES:
        want = duck.sql(ORACLES[name]).df()
        assert sorted(got.columns) == sorted(want.columns)
        assert rows(got) == rows(want)

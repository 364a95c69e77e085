import os

import pytest
from compare import TESTDATA, assert_same, connection

from weftline.operators.oracle import oracle_sql
from weftline.operators.queries import queries

SF = "sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(f"{TESTDATA}/{SF}"), reason="no test data")


@pytest.fixture(scope="module")
def con():
    return connection(SF)


@pytest.mark.parametrize("name", sorted(oracle_sql()))
def test_query_matches_sql(spark, con, name):
    assert_same(queries()[name](spark, f"{TESTDATA}/{SF}"), con, oracle_sql()[name])


def test_every_sql_has_a_query():
    assert set(oracle_sql()) <= set(queries())

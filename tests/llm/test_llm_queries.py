import os

import pytest
from compare import TESTDATA, assert_same, connection

from weftline.llm.oracle import oracle_sql
from weftline.llm.queries import queries

SF = "sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(f"{TESTDATA}/{SF}"), reason="no test data")


@pytest.mark.parametrize("name", sorted(oracle_sql()))
def test_query_matches_sql(spark, name):
    assert_same(queries()[name](spark, f"{TESTDATA}/{SF}"), connection(SF), oracle_sql()[name])


@pytest.mark.parametrize("name", sorted(set(queries()) - set(oracle_sql())))
def test_other_queries_run(spark, name):
    assert queries()[name](spark, f"{TESTDATA}/{SF}").columns

import os

import pytest
from compare import TESTDATA

from weftline.llm import queries

SF = f"{TESTDATA}/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no test data")


def test_p6_found_is_read_from_the_ranking(spark, monkeypatch):
    calls = []
    ranking = queries.borda_ranking
    monkeypatch.setattr(queries, "borda_ranking", lambda *a, **k: calls.append(1) or ranking(*a, **k))
    found = [r.rule_id for r in queries.p6_found(spark, SF).collect()]
    assert calls
    places = {r.rule_id: r.position for r in queries.p6_ranking(spark, SF).collect()}
    assert found and [places[x] for x in found] == sorted(places[x] for x in found)

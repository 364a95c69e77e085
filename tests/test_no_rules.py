"""Queries on rules where no pair is frequent: they end, without rows."""

import pytest

from weftline.operators.mining import METRICS
from weftline.operators.queries import queries


@pytest.fixture
def folder(spark, tmp_path):
    spark.createDataFrame([(i, i % 2, None) for i in range(4)], "l_orderkey long, l_partkey long, l_shipdate timestamp_ntz").write.parquet(f"{tmp_path}/lineitem.parquet")
    spark.createDataFrame([(0, "Brand#11"), (1, "Brand#12")], "p_partkey long, p_brand string").write.parquet(f"{tmp_path}/part.parquet")
    return str(tmp_path)


def test_no_rules_recommend_by_archetype(spark, folder):
    found = queries()["recommend_by_archetype"](spark, folder)
    assert found.columns == ["item_id", "score", "cluster_id", "dominant_metric", "rule"] and found.count() == 0


def test_no_rules_rule_profiles(spark, folder):
    found = queries()["rule_profiles"](spark, folder)
    assert found.columns == ["cluster_id", "label", "dominant_metric", "size", *METRICS] and found.count() == 0


def test_no_rules_item_profiles(spark, folder):
    found = queries()["item_profiles"](spark, folder)
    assert found.columns[:4] == ["cluster_id", "label", "dominant_metric", "size"] and found.columns[-2:] == ["rule_count", "members"] and found.count() == 0


def test_no_rules_recommend_by_profile(spark, folder):
    found = queries()["recommend_by_profile"](spark, folder)
    assert found.columns == ["item_id", "score", "cluster_id", "dominant_metric", "rule"] and found.count() == 0

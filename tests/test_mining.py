import pytest
from pyspark.sql import functions as F

from weftline.operators import mining


def test_supports(baskets):
    got = {r.itemset: round(r.support, 6) for r in mining.frequent_itemsets(baskets, 0.1).collect()}
    assert got == {"milk": 0.6, "bread": 0.7, "beer": 0.3, "diapers": 0.3, "bread|milk": 0.4, "beer|diapers": 0.3, "beer|bread": 0.2, "bread|diapers": 0.2}


def test_triples_only_when_asked_for(baskets):
    assert {r.itemset for r in mining.frequent_itemsets(baskets, 0.1, 3).where("length = 3").collect()} == {"beer|bread|diapers"}


def test_rule_measures(baskets):
    rules = mining.association_rules(mining.frequent_itemsets(baskets, 0.1), 0.1)
    r = rules.where("antecedents = 'milk' AND consequents = 'bread'").first()
    assert [round(r[m], 5) for m in ("confidence", "lift", "leverage", "conviction", "zhang")] == [0.66667, 0.95238, -0.02, 0.9, -0.14286]


def test_repeated_rows_raise_support(baskets):
    twice = baskets.unionByName(baskets.where("set_id = 'T10'"))
    pair = {r.itemset: r.support for r in mining.frequent_itemsets(twice, 0.1).collect()}
    assert pair["beer|diapers"] == pytest.approx(0.6)
    assert {r.itemset: r.support for r in mining.frequent_itemsets(twice, 0.1, distinct=True).collect()}["beer|diapers"] == pytest.approx(0.3)


@pytest.mark.parametrize("bad", [0, -1, 1.5])
def test_support_range(baskets, bad):
    with pytest.raises(ValueError):
        mining.frequent_itemsets(baskets, bad)


def test_empty_relation(spark):
    none = spark.createDataFrame([], "set_id string, node_id string, event_time timestamp")
    assert mining.frequent_itemsets(none, 0.1).count() == 0
    assert mining.association_rules(mining.frequent_itemsets(none, 0.1)).count() == 0
    assert mining.sequential_patterns(none).count() == 0


@pytest.fixture(scope="module")
def series(spark):
    rows = [("T1", "A", 0), ("T1", "B", 5), ("T1", "C", 10), ("T2", "A", 0), ("T2", "B", 3), ("T3", "A", 0), ("T3", "C", 7), ("T4", "B", 0), ("T4", "C", 4), ("T5", "A", 0), ("T5", "B", 2), ("T5", "C", 8)]
    return spark.createDataFrame(rows, "set_id string, node_id string, m int").withColumn("event_time", F.timestamp_seconds(F.col("m") * 60 + 1704103200))


def test_sequences(series):
    got = {r.pattern: r.support for r in mining.sequential_patterns(series, min_support=0.1).collect()}
    assert got == {"A -> B": 0.6, "A -> C": 0.6, "B -> C": 0.6}


def test_sequences_with_gap(series):
    got = {r.pattern: r.support for r in mining.sequential_patterns(series, min_support=0.1, max_gap=0).collect()}
    assert got == {"A -> B": 0.6, "B -> C": 0.6, "A -> C": 0.2}


def test_missing_time_column(baskets):
    with pytest.raises(ValueError):
        mining.sequential_patterns(baskets)


def test_recommend_by_rules(baskets):
    rules = mining.association_rules(mining.frequent_itemsets(baskets, 0.1), 0.1)
    best = mining.recommend_by_rules(rules, ["beer"]).first()
    assert (best.item_id, best.rule) == ("diapers", "beer -> diapers")
    assert mining.recommend_by_rules(rules, []).count() == 0
    with pytest.raises(ValueError):
        mining.recommend_by_rules(rules, ["beer"], metric="nonsense")

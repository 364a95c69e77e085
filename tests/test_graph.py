import random

import pytest

from weftline.operators import components, recommend
from weftline.operators.graph import GraphModel


def table(df, key, *cols):
    return {r[key]: tuple(round(r[c], 5) if isinstance(r[c], float) else r[c] for c in cols) for r in df.collect()}


def test_two_hops_by_frequency(baskets):
    got = table(GraphModel(baskets).recommend(["milk"]), "recommended_item", "total_strength", "min_hops")
    assert got == {"beer": (8.0, 2), "diapers": (8.0, 2), "bread": (4.0, 1)}


def test_two_hops_by_probability(baskets):
    got = table(GraphModel(baskets).recommend(["milk"], scoring="probability"), "recommended_item", "total_strength")
    assert got == {"bread": (0.66667,), "beer": (0.19048,), "diapers": (0.19048,)}


def test_two_seeds_weigh_by_their_rows(baskets):
    assert table(GraphModel(baskets).recommend(["milk", "beer"]), "recommended_item", "total_strength") == {"diapers": (7.66667,), "bread": (5.33333,)}
    assert table(GraphModel(baskets).recommend(["milk", "beer"], scoring="path"), "recommended_item", "total_strength") == {"diapers": (0.11111,), "bread": (0.07407,)}


def test_unknown_and_no_seeds(baskets):
    assert GraphModel(baskets).recommend(["nothing"]).count() == 0
    assert GraphModel(baskets).recommend([]).count() == 0


def test_score_basket(baskets):
    assert GraphModel(baskets).score_basket([]).first().score == 1.0
    assert GraphModel(baskets).score_basket(["milk", "bread"]).first().score > 0.66


def test_adjacency_and_neighbours(baskets):
    assert {r.neighbor: r.weight for r in GraphModel(baskets).neighbors("beer").collect()} == {"bread": 2, "diapers": 3}
    row = GraphModel(baskets).adjacency().where("source = 'beer'").first()
    assert (row.neighbors, row.weights) == (["bread", "diapers"], [2, 3])


def test_similarities(baskets):
    s = recommend.ItemSimilarity(baskets)
    assert s.table.where("item_a = 'beer' AND item_b = 'diapers'").first().score == 1.0
    assert s.similar("beer", 1).first().item_id == "diapers"
    with pytest.raises(ValueError):
        recommend.ItemSimilarity(baskets, "nonsense")


def test_popularity(baskets):
    top = recommend.recommend_popular(recommend.popularity(baskets), 4).collect()
    assert (top[0].item_id, round(top[0].score, 6), [r["rank"] for r in top]) == ("bread", round(7 / 19, 6), [1, 2, 3, 3])
    assert "bread" not in {r.item_id for r in recommend.recommend_popular(recommend.popularity(baskets), 9, ["bread"]).collect()}
    with pytest.raises(ValueError):
        recommend.popularity(baskets, "trending")


def test_merging(spark):
    a = spark.createDataFrame([("Pasta", 3.0), ("Wine", 1.0)], "recommended_item string, total_strength double")
    b = spark.createDataFrame([("Coffee", 4.0), ("Pasta", 2.0)], "recommended_item string, total_strength double")
    assert [tuple(r) for r in recommend.merge_tables([a, b]).collect()] == [("Pasta", 5.0), ("Coffee", 4.0), ("Wine", 1.0)]
    assert {r.recommended_item for r in recommend.merge_tables([a, b], "best").collect()} == {"Coffee", "Pasta"}
    assert [r.recommended_item for r in recommend.merge_tables([a, b], "first").collect()] == ["Pasta", "Wine"]
    with pytest.raises(ValueError):
        recommend.merge_tables([])


def test_sinks(spark):
    rows = [r for _ in range(10) for r in (("S1", "A"), ("S1", "B"), ("S2", "C"), ("S2", "D"))] + [("SE", "E"), ("SE", "A"), ("SF", "F"), ("SF", "C")]
    got = components.sink_components(spark.createDataFrame(rows, "set_id string, node_id string"), 1, 0.2)
    assert {r.members for r in got.collect()} == {"A|B", "C|D"}
    assert {(r.node, r.scc_id) for r in got.collect()} == {("A", 0), ("B", 0), ("C", 1), ("D", 1)}


def brute_components(pairs):
    nodes = {x for p in pairs for x in p}
    reach = {n: {n} for n in nodes}
    for _ in nodes:
        for s, t in pairs:
            for n in nodes:
                if s in reach[n]:
                    reach[n] |= {t}
    return {n: min(m for m in nodes if m in reach[n] and n in reach[m]) for n in nodes}


def test_components_against_brute_force(spark):
    random.seed(3)
    for _ in range(40):
        pairs = list({(f"n{random.randrange(9)}", f"n{random.randrange(9)}") for _ in range(random.randint(1, 18))})
        assert components.tarjan(pairs) == brute_components(pairs)


def test_colouring_gives_the_same_components(spark):
    random.seed(4)
    pairs = [(w, f"n{random.randrange(12)}", f"n{random.randrange(12)}") for w in (0, 1) for _ in range(22)]
    edges = spark.createDataFrame(pairs, "win int, source string, target string").distinct()
    small = {(r.win, r.node, r.component) for r in components.strong_components(edges, ("win",)).collect()}
    large = {(r.win, r.node, r.component) for r in components.strong_components(edges, ("win",), small=0).collect()}
    assert small == large
    for w in (0, 1):
        assert {(n, c) for x, n, c in small if x == w} == set(brute_components([(s, t) for x, s, t in pairs if x == w]).items())


def test_no_edges(spark):
    none = spark.createDataFrame([], "set_id string, node_id string")
    assert components.sink_components(none).count() == 0

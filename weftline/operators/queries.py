"""Queries of the core operators, each over the whole of its tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weftline.operators import aggregates, evaluation, facets, mining, profiling, recommend, temporal
from weftline.operators.components import sink_components
from weftline.operators.graph import GraphModel
from weftline.operators.skew import detect_heavy_keys, key_counts, key_profile
from weftline.operators.views import basket_brand, basket_facet, basket_part, event_session, event_type, interactions, table
from weftline.plans.shared import cut
from weftline.sources.interactions import canonical, from_matrix

KEY_FIELDS = ["node_id", "set_id"]
BRAND_SEEDS = ["Brand#11", "Brand#23"]
EVENT_SEED = ["click_1"]
EVENT_SEEDS = ["click_1", "view_2"]
DIGITS = 6


def rounded(df: DataFrame, *names: str) -> DataFrame:
    """Floating results to six decimals, as sums depend on their order."""
    return df.withColumns({c: F.round(c, DIGITS) for c in names})


def p7_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = table(spark, sf_dir, "interactions")
    heavy = detect_heavy_keys(df, KEY_FIELDS)
    totals = spark.createDataFrame(list(heavy.totals.items()), "field_name string, total long")
    counts = key_counts(df, KEY_FIELDS, heavy).join(F.broadcast(totals), "field_name")
    return counts.where(F.col("n_rows") * 100 >= F.col("total")).select("field_name", "key_value")


def p7_per_key(spark: SparkSession, sf_dir: str) -> DataFrame:
    return key_profile(table(spark, sf_dir, "interactions"), KEY_FIELDS, "sort_column").drop("is_heavy")


def interactions_load(spark: SparkSession, sf_dir: str) -> DataFrame:
    loaded = canonical(table(spark, sf_dir, "interactions"), "set_id", "node_id", "sort_column")
    return loaded.groupBy("node_id").agg(F.count(F.lit(1)).alias("n_rows"), F.count_distinct("set_id").alias("n_sets"), F.max("sort_column").alias("last_time"))


def session_load(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sessions as delivered, with times in several formats."""
    raw = table(spark, sf_dir, "session_items")
    time = F.expr("try_cast(rtrim('Z', event_time) as timestamp_ntz)")
    loaded = canonical(raw.withColumn("t", time), "session_id", "item_id", "t")
    return loaded.groupBy("node_id").agg(F.count(F.lit(1)).alias("n_rows"), F.count("sort_column").alias("n_timed"))


def matrix_unpivot(spark: SparkSession, sf_dir: str) -> DataFrame:
    brands = [f"Brand#{i}" for i in range(1, 26)]
    wide = basket_brand(spark, sf_dir).groupBy("set_id").pivot("node_id", brands).count()
    return from_matrix(wide).groupBy("node_id").agg(F.count(F.lit(1)).alias("n_sets"))


def _itemsets(spark: SparkSession, sf_dir: str, max_len: int | None = None) -> DataFrame:
    return mining.frequent_itemsets(basket_brand(spark, sf_dir), 0.03, max_len)


def _rules(spark: SparkSession, sf_dir: str, min_lift: float = 0.0) -> DataFrame:
    return mining.association_rules(_itemsets(spark, sf_dir), 0.1, min_lift)


def frequent_itemsets(spark, sf_dir):
    return rounded(_itemsets(spark, sf_dir).drop("items"), "support")


def frequent_itemsets_len1(spark, sf_dir):
    return rounded(_itemsets(spark, sf_dir, 1).drop("items"), "support")


def frequent_itemsets_len3(spark, sf_dir):
    return rounded(mining.frequent_itemsets(event_session(spark, sf_dir), 0.0005, 3, distinct=True).drop("items"), "support")


def association_rules(spark, sf_dir):
    return rounded(_rules(spark, sf_dir).drop("antecedent_items"), *mining.METRICS)


def association_rules_min_lift(spark, sf_dir):
    return rounded(_rules(spark, sf_dir, 0.9).drop("antecedent_items"), *mining.METRICS)


def recommend_rules(spark, sf_dir):
    return rounded(mining.recommend_by_rules(_rules(spark, sf_dir), BRAND_SEEDS, 10, "lift"), "score")


def sequential_patterns(spark, sf_dir):
    return rounded(mining.sequential_patterns(event_session(spark, sf_dir), min_support=0.002), "support")


def sequential_patterns_gap(spark, sf_dir):
    return rounded(mining.sequential_patterns(event_session(spark, sf_dir), min_support=0.001, max_gap=0), "support")


def _similarity(metric: str, view: Callable, **kw) -> Callable[[SparkSession, str], DataFrame]:
    return lambda spark, sf_dir: rounded(recommend.ItemSimilarity(view(spark, sf_dir), metric, **kw).table, "score")


def itemcf_recommend(spark, sf_dir):
    return rounded(recommend.ItemSimilarity(basket_brand(spark, sf_dir)).recommend(BRAND_SEEDS, 10), "score")


def itemcf_similar(spark, sf_dir):
    return rounded(recommend.ItemSimilarity(basket_brand(spark, sf_dir), "cosine").similar("Brand#11", 5), "score")


def popularity_global(spark, sf_dir):
    return rounded(recommend.popularity(table(spark, sf_dir, "interactions").dropna(subset=["set_id", "node_id"])), "score")


def popularity_trending(spark, sf_dir):
    return rounded(recommend.popularity(event_session(spark, sf_dir), "trending", window_days=7), "score")


def popularity_exclude(spark, sf_dir):
    return rounded(recommend.recommend_popular(recommend.popularity(basket_brand(spark, sf_dir)), 10, BRAND_SEEDS), "score")


def merge_union(spark, sf_dir):
    df = basket_brand(spark, sf_dir)
    tables = [GraphModel(df).recommend([s], 1, n=20) for s in BRAND_SEEDS]
    return rounded(recommend.merge_tables([t.select("recommended_item", "total_strength") for t in tables], "union", 10), "total_strength")


def graph_edges(spark, sf_dir):
    return GraphModel(basket_part(spark, sf_dir), 2).edges


def graph_adjacency(spark, sf_dir):
    a = GraphModel(event_session(spark, sf_dir)).adjacency()
    return a.select("source", F.array_join("neighbors", ",").alias("neighbors"), F.array_join(F.col("weights").cast("array<string>"), ",").alias("weights"))


def graph_neighbors(spark, sf_dir):
    return GraphModel(event_session(spark, sf_dir)).neighbors("click_1")


def _graph(seeds: list[str], alpha: float = 0.0, **kw) -> Callable[[SparkSession, str], DataFrame]:
    return lambda spark, sf_dir: rounded(GraphModel(event_session(spark, sf_dir), alpha=alpha).recommend(seeds, **kw), "total_strength")


def score_basket(spark, sf_dir):
    return rounded(GraphModel(event_type(spark, sf_dir)).score_basket(["click", "view"]), "score")


def rank_nodes(spark, sf_dir):
    return rounded(GraphModel(event_session(spark, sf_dir)).rank_nodes(EVENT_SEED), "score")


def sink_sccs(spark, sf_dir):
    return sink_components(event_session(spark, sf_dir), 5, 0.08)


def decay_edges(spark, sf_dir):
    return rounded(temporal.DecayGraph(event_session(spark, sf_dir), 7).edges, "decay_weight", "score")


def decay_recommend(spark, sf_dir):
    return rounded(temporal.DecayGraph(event_session(spark, sf_dir), 7).recommend(EVENT_SEEDS), "decay_score")


def sliding_window_recommend(spark, sf_dir):
    return rounded(temporal.SlidingGraph(event_session(spark, sf_dir), 7).recommend(EVENT_SEED), "total_strength")


def snapshot_timeline(spark, sf_dir):
    return temporal.SnapshotDiff(event_session(spark, sf_dir)).timeline()


def snapshot_diff(spark, sf_dir):
    return temporal.SnapshotDiff(event_session(spark, sf_dir)).diff(0, 3)


def _tracker(spark: SparkSession, sf_dir: str) -> temporal.ComponentTracker:
    return temporal.ComponentTracker(event_session(spark, sf_dir), 4, 2, 0.08)


def scc_tracker(spark, sf_dir):
    return _tracker(spark, sf_dir).timeline()


def scc_evolution(spark, sf_dir):
    return _tracker(spark, sf_dir).evolution(0.3)


def directed_edges(spark, sf_dir):
    return rounded(temporal.DirectedGraph(event_session(spark, sf_dir)).edges, "score")


def directed_recommend_next(spark, sf_dir):
    return rounded(temporal.DirectedGraph(event_session(spark, sf_dir), 0).recommend_next(EVENT_SEEDS, 2), "transition_prob")


def directed_reachable(spark, sf_dir):
    return rounded(temporal.DirectedGraph(event_session(spark, sf_dir), 0).reachable_from("click_1", 2), "transition_prob")


def node_per_window(spark, sf_dir):
    return aggregates.NodeWindows(event_session(spark, sf_dir)).per_window()


def node_rollup(spark, sf_dir):
    return aggregates.NodeWindows(event_session(spark, sf_dir)).rollup()


def edge_lifecycle(spark, sf_dir):
    return aggregates.EdgeWindows(event_session(spark, sf_dir)).rollup()


def graph_snapshots(spark, sf_dir):
    df = event_session(spark, sf_dir)
    return aggregates.graph_snapshots(df, 4, 1, temporal.ComponentTracker(df, 4, 2, 0.08))


def community_metrics(spark, sf_dir):
    return aggregates.community_metrics(_tracker(spark, sf_dir))


def node_synchrony(spark, sf_dir):
    return aggregates.NodeCorrelation(event_type(spark, sf_dir), 8).synchrony()


def leading_lagging(spark, sf_dir):
    return aggregates.NodeCorrelation(event_type(spark, sf_dir), 8, 2).leading_lagging()


def facet_composite(spark, sf_dir):
    return facets.composite_key(basket_facet(spark, sf_dir), "order_id", ["region", "day_period"]).groupBy("_context_key").agg(F.count(F.lit(1)).alias("n_rows"))


def facet_entities(spark, sf_dir):
    return facets.facet_entities(basket_facet(spark, sf_dir), "order_id", "item", ["region", "day_period"]).groupBy("item").agg(F.count(F.lit(1)).alias("n_rows"), F.count_distinct("order_id").alias("n_orders"))


def facet_split(spark, sf_dir):
    return facets.sliced(basket_facet(spark, sf_dir), ["region", "day_period"]).groupBy("slice").agg(F.count(F.lit(1)).alias("n_rows"), F.count_distinct("item").alias("n_items"))


def _facet_seeds(df: DataFrame) -> list[str]:
    """The two items with most rows, so that queries have results on any of the tables."""
    return [r.item for r in df.where(F.col("item").isNotNull()).groupBy("item").count().orderBy(F.desc("count"), "item").limit(2).collect()]


def facet_recommend(spark, sf_dir):
    df = basket_facet(spark, sf_dir)
    return rounded(facets.recommend_by_facet(df, _facet_seeds(df)[:1], "order_id", "item", ["region", "day_period"], n=5, max_depth=1), "total_strength")


def _lists(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Lists of the most popular other brands for every customer, and the brands that the customer bought after 1997."""
    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey")
    rows = basket_brand(spark, sf_dir).join(orders, F.col("set_id") == F.col("o_orderkey").cast("string")).select(F.col("o_custkey").cast("string").alias("user_id"), F.col("node_id").alias("item"), "sort_column")
    top = recommend.recommend_popular(recommend.popularity(basket_brand(spark, sf_dir)), 10).agg(F.sort_array(F.collect_list(F.struct((-F.round("score", 9)).alias("s"), "item_id"))).alias("x")).select(F.col("x.item_id").alias("recs"))
    late = rows.where(F.col("sort_column") >= F.lit("1997-01-01").cast("timestamp_ntz")).groupBy("user_id").agg(F.array_sort(F.collect_set("item")).alias("items"))
    return rows.select("user_id").distinct().crossJoin(F.broadcast(top)), late


def evaluate_recommendations(spark, sf_dir):
    recs, truth = _lists(spark, sf_dir)
    return rounded(evaluation.evaluate(recs, truth, 5), *evaluation.METRICS)


def catalogue_coverage(spark, sf_dir):
    recs, _ = _lists(spark, sf_dir)
    return rounded(evaluation.catalogue_coverage(recs, table(spark, sf_dir, "part").select(F.col("p_brand").alias("item"))), "coverage")


def temporal_split(spark, sf_dir):
    train, test = evaluation.temporal_split(event_session(spark, sf_dir), "sort_column", 0.2)
    side = lambda df, x: df.agg(F.lit(x).alias("side"), F.count(F.lit(1)).alias("n_rows"), F.min("sort_column").alias("first_time"), F.max("sort_column").alias("last_time"))
    return side(train, "train").unionByName(side(test, "test"))


def temporal_split_sets(spark, sf_dir):
    train, test = evaluation.temporal_split(event_session(spark, sf_dir), "sort_column", 0.2, "set_id")
    side = lambda df, x: df.groupBy("set_id").agg(F.count(F.lit(1)).alias("n_rows")).withColumn("side", F.lit(x))
    return side(train, "train").unionByName(side(test, "test"))


def random_split(spark, sf_dir):
    train, test = evaluation.random_split(basket_part(spark, sf_dir), 0.2, 42, "set_id")
    return train.agg(F.lit("train").alias("side"), F.count_distinct("set_id").alias("n_sets")).unionByName(test.agg(F.lit("test").alias("side"), F.count_distinct("set_id").alias("n_sets")))


def item_features(spark, sf_dir):
    features = profiling.item_features(_rules(spark, sf_dir))
    return rounded(features, *[c for c in features.columns if c not in ("item", "rule_count")])


def facet_recommend_rules(spark, sf_dir):
    df = basket_facet(spark, sf_dir)
    return rounded(facets.recommend_by_facet(df, _facet_seeds(df)[:1], "order_id", "item", ["region", "day_period"], "rules", n=5), "total_strength")


def recommend_by_profile(spark, sf_dir):
    return rounded(profiling.profile_rules(cut(_rules(spark, sf_dir), "rules"), 1, empty=True).recommend(BRAND_SEEDS, n=10), "score")


def recommend_by_archetype(spark, sf_dir):
    return rounded(profiling.profile_items(cut(_rules(spark, sf_dir), "rules"), 1, empty=True).recommend(BRAND_SEEDS, n=10), "score")


def interactions_edges(spark, sf_dir):
    return GraphModel(interactions(spark, sf_dir), 20).edges


def interactions_itemsets(spark, sf_dir):
    return rounded(mining.frequent_itemsets(interactions(spark, sf_dir), 0.01).drop("items"), "support")


def _interaction_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mining.association_rules(mining.frequent_itemsets(interactions(spark, sf_dir), 0.01), 0.1)


def interactions_rules(spark, sf_dir):
    """Convictions over a million, those of sure rules, are cut there: they only show the rounding of a confidence of 1."""
    rules = _interaction_rules(spark, sf_dir).drop("antecedent_items")
    return rounded(rules.withColumn("conviction", F.least("conviction", F.lit(1e6))), *mining.METRICS)


def interactions_recommend_rules(spark, sf_dir):
    """Recommendations for the two most frequent nodes."""
    seeds = [r.node_id for r in interactions(spark, sf_dir).groupBy("node_id").count().orderBy(F.desc("count"), "node_id").limit(2).collect()]
    return rounded(mining.recommend_by_rules(_interaction_rules(spark, sf_dir), seeds, 10, "lift"), "score")


def interactions_cf(spark, sf_dir):
    return rounded(recommend.ItemSimilarity(interactions(spark, sf_dir), "cosine", 8, 10).table, "score")


def interactions_snapshots(spark, sf_dir):
    return temporal.SnapshotDiff(interactions(spark, sf_dir), 4, 5).timeline()


def interactions_sccs(spark, sf_dir):
    return sink_components(interactions(spark, sf_dir), 8, 0.5)


def rule_profiles(spark, sf_dir):
    return profiling.profile_rules(cut(_rules(spark, sf_dir), "rules"), "auto", 5, empty=True).summary()


def item_profiles(spark, sf_dir):
    summary = profiling.profile_items(cut(_rules(spark, sf_dir), "rules"), 3, empty=True).summary()
    return summary.withColumn("members", F.array_join("members", ","))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    own = [
        p7_found, p7_per_key, interactions_load, session_load, matrix_unpivot, frequent_itemsets, frequent_itemsets_len1, frequent_itemsets_len3, association_rules, association_rules_min_lift, recommend_rules,
        sequential_patterns, sequential_patterns_gap, itemcf_recommend, itemcf_similar, popularity_global, popularity_trending, popularity_exclude, merge_union, graph_edges, graph_adjacency, graph_neighbors,
        score_basket, rank_nodes, sink_sccs, decay_edges, decay_recommend, sliding_window_recommend, snapshot_timeline, snapshot_diff, scc_tracker, scc_evolution, directed_edges, directed_recommend_next, directed_reachable,
        node_per_window, node_rollup, edge_lifecycle, graph_snapshots, community_metrics, node_synchrony, leading_lagging, facet_composite, facet_entities, facet_split, facet_recommend,
        evaluate_recommendations, catalogue_coverage, temporal_split, temporal_split_sets, random_split, item_features, rule_profiles, item_profiles, recommend_by_profile, recommend_by_archetype, facet_recommend_rules,
        interactions_edges, interactions_itemsets, interactions_rules, interactions_recommend_rules, interactions_cf, interactions_snapshots, interactions_sccs,
    ]
    return {f.__name__: f for f in own} | {
        "itemcf_jaccard": _similarity("jaccard", basket_brand), "itemcf_cosine": _similarity("cosine", basket_part, min_cooccurrence=2, top_k_similar=10), "itemcf_lift": _similarity("lift", basket_brand),
        "graph_recommend_frequency": _graph(EVENT_SEED), "graph_recommend_probability": _graph(EVENT_SEED, scoring="probability"), "graph_recommend_path": _graph(EVENT_SEED, scoring="path"),
        "graph_recommend_multi_seed": _graph(EVENT_SEEDS, scoring="probability", exclude_seed=False), "graph_recommend_alpha": _graph(EVENT_SEED, alpha=1.0, scoring="probability", min_weight=2),
    }

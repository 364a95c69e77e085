import warnings

import pandas as pd
import pytest
from pyspark.sql import functions as F

import weftline
from weftline.engine import Engine
from weftline.operators import evaluation, facets, list_metrics, profiling
from weftline.operators.skew import detect_heavy_keys, key_counts, key_profile, rows_with_key_totals
from weftline.plans.ranking import global_positions
from weftline.plans.shared import Cut, scope
from weftline.sources import datasets
from weftline.sources.interactions import canonical, from_matrix, read_source
from weftline.streaming import counts as streaming


def test_nulls_are_dropped_and_ids_are_strings(spark):
    raw = spark.createDataFrame([(1, "a"), (2, None), (None, "b"), (3, "c")], "o int, i string")
    assert sorted((r.set_id, r.node_id) for r in canonical(raw, "o", "i").collect()) == [("1", "a"), ("3", "c")]


def test_missing_columns_and_file_types(spark, tmp_path):
    raw = spark.createDataFrame([(1, "a")], "o int, i string")
    with pytest.raises(ValueError, match="Missing columns"):
        canonical(raw, "o", "nothing")
    with pytest.raises(ValueError, match="Unsupported"):
        read_source(spark, "x.xlsx")
    with pytest.raises(TypeError):
        read_source(spark, 3)
    raw.write.csv(str(tmp_path / "x.csv"), header=True)
    assert read_source(spark, str(tmp_path / "x.csv")).count() == 1


def test_matrix(spark):
    wide = pd.DataFrame({"set_id": ["a", "b"], "milk": [1, 0], "bread": [2, 1]})
    got = from_matrix(read_source(spark, wide))
    assert sorted(tuple(r) for r in got.collect()) == [("a", "bread"), ("a", "milk"), ("b", "bread")]


def test_engine(spark, baskets, tmp_path):
    with weftline.load(baskets, spark, set_col="set_id", node_col="node_id") as e:
        assert e.sql("SELECT count(*) AS n FROM interactions").first().n == 19
        with pytest.raises(RuntimeError):
            e.recommend_cf(["milk"])
        assert e.recommend(["milk"]).columns[0] == "recommended_item"
        assert e.fit_cf().recommend(["beer"], n=1).first().recommended_item == "diapers"
        e.association_rules(0.1)
        assert e.recommend(["beer"], n=1).columns == ["recommended_item", "score", "rule"]
        assert e.recommend(strategy="popular", n=2).count() == 2
        with pytest.raises(ValueError):
            e.recommend(["milk"], strategy="nonsense")
        e.save(str(tmp_path / "saved"))
        assert e.load(str(tmp_path / "saved")) == 19
        more = spark.createDataFrame([("T11", "milk", 5)], "o string, i string, t int")
        assert e.load_interactions(more, "o", "i", "t", append=True) == 20
        assert e.interactions.where("sort_column IS NULL").count() == 19
    assert "loaded=False" in repr(e)


def test_callback_that_fails_only_warns(spark, baskets):
    with warnings.catch_warnings(record=True) as seen:
        warnings.simplefilter("always")
        assert canonical(baskets, "set_id", "node_id", sort_callback=lambda df: df.select("nothing")).count() == 19
    assert seen


def test_heavy_keys_change_the_path_only(spark):
    rows = [("big", f"n{i % 50}", i) for i in range(900)] + [(f"s{i}", "n1", i) for i in range(100)] + [(None, "n2", 1), ("s1", None, None)]
    df = spark.createDataFrame(rows, "set_id string, node_id string, t int").withColumnsRenamed({"t": "n_rows"})
    heavy = detect_heavy_keys(df, ["node_id", "set_id"], 0.1)
    assert "big" in heavy.keys["set_id"] and heavy.totals == {"node_id": 1001, "set_id": 1001}
    got = {(r.field_name, r.key_value): r.n_rows for r in key_counts(df.select("set_id", "node_id"), ["node_id", "set_id"], heavy).collect()}
    plain = {("set_id", r.set_id): r["count"] for r in df.where("set_id IS NOT NULL").groupBy("set_id").count().collect()} | {("node_id", r.node_id): r["count"] for r in df.where("node_id IS NOT NULL").groupBy("node_id").count().collect()}
    assert got == plain
    profile = {(r.field_name, r.key_value): (r.n_rows, r.n_distinct_other, r.first_time, r.last_time) for r in key_profile(df, ["node_id", "set_id"], "n_rows", heavy).collect()}
    assert profile["set_id", "big"] == (900, 50, 0, 899) and profile["set_id", "s1"] == (2, 1, 1, 1)
    assert {(r.set_id, r.key_rows) for r in rows_with_key_totals(df, "set_id", heavy).where("set_id IN ('big', 's1')").collect()} == {("big", 900), ("s1", 2)}


def test_skew_on_nothing(spark):
    none = spark.createDataFrame([], "set_id string, node_id string, t int")
    assert key_counts(none, ["node_id", "set_id"]).count() == 0
    assert key_profile(none, ["node_id", "set_id"], "t").count() == 0


def test_positions(spark):
    df = spark.range(1000).withColumnRenamed("id", "v")
    got = global_positions(df.repartition(7), [F.col("v").desc()]).collect()
    assert all(r.position == 1000 - r.v for r in got)


def test_facets(spark):
    rows = [(1, "Pasta", "EU"), (1, "Wine", "EU"), (2, "Coffee", "BR"), (2, "Pasta", None), (3, "Pasta", "EU"), (3, "Wine", "EU")]
    df = spark.createDataFrame(rows, "o int, item string, region string")
    assert {r._context_key for r in facets.composite_key(df, "o", ["region"]).collect()} == {"1|EU", "2|BR", "2|None", "3|EU"}
    assert facets.facet_entities(df, "o", "item", ["region"]).where("item LIKE 'facet:%'").count() == 3
    assert set(facets.split_by_facet(df, "o", "item", "region")) == {"region=EU", "region=BR"}
    with pytest.raises(ValueError):
        facets.composite_key(df, "o", ["o"])
    with pytest.raises(ValueError):
        facets.composite_key(df, "o", ["nothing"])
    got = {(r.slice, r.recommended_item): (r.total_strength, r.level) for r in facets.recommend_by_facet(df, ["Pasta"], "o", "item", ["region"], max_depth=1).collect()}
    assert got["region=EU", "Wine"] == (1.0 * 2, 0) and got["region=BR", "Wine"][1] == 1 and ("global", "Coffee") in got


def test_metrics(spark):
    recs = spark.createDataFrame([("u1", ["a", "b", "c", "d"]), ("u2", ["x", "a", "y", "b"]), ("u3", ["q"])], "user_id string, recs array<string>")
    truth = spark.createDataFrame([("u1", ["a", "c"]), ("u2", ["x", "b", "z"]), ("u3", ["m"]), ("u4", ["m"])], "user_id string, items array<string>")
    got = {r.user_id: r for r in evaluation.evaluate(recs, truth, 4).collect()}
    assert (got["u1"].precision, got["u1"].recall, round(got["u1"].ap, 4), round(got["u1"].ndcg, 5)) == (0.5, 1.0, 0.8333, 0.91972)
    assert got["u4"].rr == 0 and len(got) == 5 and got["AVERAGE"].hit_rate == 0.5
    assert evaluation.evaluate(recs.limit(0), truth.limit(0)).count() == 0
    cat = spark.createDataFrame([(x,) for x in "abzz"], "item string")
    assert round(evaluation.catalogue_coverage(recs, cat).first().coverage, 4) == 0.6667


def test_list_metrics_agree_with_tables(spark):
    recs, real = ["x", "a", "y", "b"], ["x", "b", "z"]
    got = evaluation.user_metrics(spark.createDataFrame([("u", recs)], "user_id string, recs array<string>"), spark.createDataFrame([("u", real)], "user_id string, items array<string>"), 3).first()
    want = {"precision": list_metrics.precision_at_k(recs, real, 3), "recall": list_metrics.recall_at_k(recs, real, 3), "f1": list_metrics.f1_at_k(recs, real, 3), "ndcg": list_metrics.ndcg_at_k(recs, real, 3), "ap": list_metrics.average_precision(recs, real), "hit_rate": list_metrics.hit_rate_at_k(recs, real, 3), "rr": list_metrics.reciprocal_rank(recs, real)}
    assert {k: round(got[k], 9) for k in want} == {k: round(v, 9) for k, v in want.items()}
    assert list_metrics.precision_at_k([], [], 0) == list_metrics.ndcg_at_k([], [], 3) == list_metrics.recall_at_k(["a"], [], 1) == 0


def test_facet_strategies(spark):
    rows = [(1, "Pasta", "EU"), (1, "Wine", "EU"), (2, "Coffee", "BR"), (3, "Pasta", "EU"), (3, "Wine", "EU")]
    df = spark.createDataFrame(rows, "o int, item string, region string")
    popular = {(r.slice, r.recommended_item): r.total_strength for r in facets.recommend_by_facet(df, [], "o", "item", "region", strategy="popular").collect()}
    assert popular["region=EU", "Wine"] == 0.5 and popular["region=BR", "Coffee"] == 1.0 and popular["global", "Coffee"] == 0.2
    near = {(r.slice, r.recommended_item): (r.total_strength, r.level) for r in facets.recommend_by_facet(df, ["Pasta"], "o", "item", "region", strategy="cf").collect()}
    assert near == {("region=EU", "Wine"): (1.0, 0), ("region=BR", "Wine"): (1.0, 1), ("global", "Wine"): (1.0, 0)}
    with pytest.raises(ValueError):
        facets.recommend_by_facet(df, [], "o", "item", "region", strategy="nonsense")


def test_rules_inside_slices(spark):
    rows = [(1, "Pasta", "EU", 1), (1, "Wine", "EU", 2), (2, "Coffee", "BR", 1), (3, "Pasta", "EU", 1), (3, "Wine", "EU", 2), (4, "Salt", "EU", None)]
    df = spark.createDataFrame(rows, "o int, item string, region string, t int")
    found = facets.recommend_by_facet(df, ["Pasta"], "o", "item", "region", "rules", sort_col="t", extra_cols=["t"], sort_callback=lambda x: x.where("sort_column IS NOT NULL"))
    assert {(r.slice, r.recommended_item): (r.total_strength, r.level) for r in found.collect()} == {("region=EU", "Wine"): (1.0, 0), ("region=BR", "Wine"): (1.5, 1), ("global", "Wine"): (1.5, 0)}
    with pytest.raises(ValueError):
        facets.recommend_by_facet(df, ["Pasta"], "o", "item", "region", "rules", metric="charm")


def test_an_engine_finds_what_another_kept(spark, tmp_path):
    path = str(tmp_path / "kept")
    rows = [("1", "a|b"), ("1", "c"), ("2", "a|b"), ("2", "c"), ("3", "d"), (None, "a"), ("4", None)]
    df = spark.createDataFrame(rows, "o string, i string")
    with Engine(spark, "kept_rows", path) as e:
        assert e.load_interactions(df, "o", "i") == 5
        e.association_rules(0.1)
        e.fit_cf()
        e.fit_graph()
        assert e.load_interactions(df.limit(2), "o", "i", table_name="others") == 2 and e.table_exists("others")
        assert e.load_interactions(df.limit(1), "o", "i", append=True, table_name="others") == 3
        assert e.interactions.count() == 5
    with Engine(spark, "kept_rows", path) as e:
        assert e.interactions.count() == 5
        assert e.recommend(["a|b"], "rules").first().recommended_item == "c"
        assert e.recommend(["a|b"], "cf").first().recommended_item == e.recommend(["a|b"], "graph").first().recommended_item == "c"
        assert e.load_interactions(df.limit(2), "o", "i", append=True) == 7
        with pytest.raises(RuntimeError):
            e.recommend(["a"], "rules")
    assert Engine(spark, "kept_rows", path).interactions.count() == 7
    assert Engine(spark, "kept_rows", str(tmp_path / "empty")).interactions is None


def test_a_scope_drops_what_was_cut_inside(spark):
    with scope():
        inside = Cut(spark.range(3).toDF("x"))
        assert inside.df.count() == 3
    jvm = spark.sparkContext._jvm
    path = jvm.org.apache.hadoop.fs.Path(inside.path)
    assert not path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(path)


def test_windows_by_arithmetic(spark):
    """Every instant is in the windows whose two ends hold it; on a border, in both."""
    from weftline.operators.windows import Windows

    for low, high, n in ((0, 1000, 7), (5, 5, 3), (-10, 3, 4), (1_600_000_000_000_000, 1_700_000_000_000_003, 13)):
        w = Windows(n, low, high)
        times = sorted({low, high, *(w.start(i) + d for i in range(n + 1) for d in (-1, 0, 1)), (low + high) // 2})
        got = {r.us: sorted(r.win) for r in spark.createDataFrame([(t,) for t in times], "us long").select("us", w.ids(F.col("us")).alias("win")).collect()}
        assert got == {t: [i for i in range(n) if w.start(i) <= t <= w.start(i + 1)] for t in times}


def test_splits_are_exact(spark):
    df = spark.range(100).selectExpr("cast(id % 10 as string) as s", "id as t")
    train, test = evaluation.temporal_split(df, "t", 0.2)
    assert (train.count(), test.count(), train.agg({"t": "max"}).first()[0]) == (80, 20, 79)
    train, test = evaluation.random_split(df, 0.3, 1, "s")
    assert (train.select("s").distinct().count(), test.select("s").distinct().count()) == (7, 3)
    train, test = evaluation.random_split(df, 0.3, 1)
    assert (train.count(), test.count()) == (70, 30)
    with pytest.raises(ValueError):
        evaluation.random_split(df, 1.0)


def test_profiles(spark):
    rows = [(f"a{i}", f"b{i}", 0.1, c, lift, 0.0, float("inf"), 0.0) for i, (c, lift) in enumerate([(0.1, 1.0), (0.11, 1.1), (0.9, 9.0), (0.91, 9.1)])]
    rules = spark.createDataFrame(rows, "antecedents string, consequents string, support double, confidence double, lift double, leverage double, conviction double, zhang double")
    p = profiling.profile_rules(rules, 2)
    assert sorted(c["size"] for c in p.clusters) == [2, 2] and all(c["dominant_metric"] in ("confidence", "lift") for c in p.clusters)
    p.label({p.clusters[0]["cluster_id"]: "mine"})
    assert "mine" in {r.label for r in p.summary().collect()}
    with pytest.warns(UserWarning):
        p.label({99: "none"})
    assert {c for c in p.summary().columns} >= {"cluster_id", "label", "dominant_metric", "size", "lift", "zhang"}
    found = p.recommend(["a3"]).first()
    held = p.cluster_of("b3")
    assert (found.item_id, found.rule, found.cluster_id, found.dominant_metric) == ("b3", "a3 → b3", held["cluster_id"], held["dominant_metric"])
    assert p.recommend(["a3"], cluster="mine").count() + p.recommend(["a0"], cluster="mine").count() == 1
    with pytest.raises(ValueError):
        p.recommend(["a3"], cluster="nothing")
    items = profiling.profile_items(rules, 1)
    assert items.clusters[0]["size"] == 4 and items.recommend(["a3"]).first().item_id == "b3"
    assert items.summary().first().members == ["b0", "b1", "b2", "b3"] and items.cluster_of("none") is None
    with pytest.raises(ValueError):
        profiling.profile_rules(rules.limit(0))


def test_data_sets(spark):
    assert datasets.retail_transactions(spark).count() == 17
    assert datasets.benchmark_patterns(spark).count() == 550
    assert datasets.playlists(spark).count() == 14
    assert datasets.headlines(spark).count() == 21
    assert datasets.filter_bubble(spark).count() == 610
    assert datasets.genomics(spark).count() == 1200
    assert datasets.large_scale(spark, 100, 50).count() == 800
    rows, facts = datasets.three_groups(spark)
    assert rows.select("basket_id").distinct().count() == facts["n_baskets"]
    assert {r.item_id for r in datasets.temporal_interactions(spark).select("item_id").distinct().collect()} == set("ABCDEFGHIX")
    chains = datasets.directed_sequences(spark).groupBy("session_id").agg({"item_id": "count"}).collect()
    assert len(chains) == 100 and max(r[1] for r in chains) <= 4


def test_stream_totals(spark, tmp_path):
    rows = spark.createDataFrame([("s", "a"), ("s", "b"), ("t", "a"), ("t", None)], "set_id string, node_id string")
    rows.write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(rows.schema).parquet(str(tmp_path / "in"))
    streaming.keep_totals(stream, str(tmp_path / "out"), str(tmp_path / "cp")).awaitTermination(60)
    assert {(r.node_id, r.n_rows) for r in streaming.totals(spark, str(tmp_path / "out")).collect()} == {("a", 2), ("b", 1)}

"""Pairs, clusters, sequences, frequent items, top N and ranking against brute force."""

import collections
import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from weftline.llm import clusters, heavy_items, sequences, top_n
from weftline.llm.borda import borda_ranking, head_on_all
from weftline.llm.pairs import co_occurring_pairs

NAN, INF = float("nan"), float("inf")


def sets_frame(spark, seed=1, n=300):
    random.seed(seed)
    rows = [(f"s{min(int(random.expovariate(0.04)), 60)}", f"n{min(int(random.expovariate(0.25)), 30)}", random.choice([None, *range(40)])) for _ in range(n)]
    rows += rows[:20] + [(None, "n1", 1), ("s1", None, 2), ("s1", "it's 100% ß|_", 3)]
    return spark.createDataFrame(rows, "set_id string, node_id string, sort_column int").withColumn("n", F.lit("clash")).withColumn("items", F.lit(1)), rows


@pytest.mark.parametrize("max_coded", [1000, 3])
def test_pairs(spark, max_coded):
    df, rows = sets_frame(spark)
    sets = collections.defaultdict(set)
    for s, x, _ in rows:
        if s is not None and x is not None:
            sets[s].add(x)
    one, two = collections.Counter(), collections.Counter()
    for xs in sets.values():
        one.update(xs)
        two.update((a, b) for a in xs for b in xs if a < b)
    want = {(a, b, c, one[a], one[b]) for (a, b), c in two.items() if c >= 3 and c >= 0.05 * len(sets) and c * len(sets) >= 1.2 * one[a] * one[b]}
    got = co_occurring_pairs(df, min_count=3, min_share=0.05, min_lift=1.2, max_coded=max_coded).collect()
    assert want == {(r.node_a, r.node_b, r.n_ab, r.n_a, r.n_b) for r in got} and len(got) == len(want) > 3
    assert all(math.isclose(r.pmi, math.log2(r.lift)) for r in got)
    assert co_occurring_pairs(df.limit(0)).count() == 0


def brute_clusters(points, width):
    parent = list(range(len(points)))

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i, p in enumerate(points):
        for j in range(i):
            if all(abs(a - b) <= width for a, b in zip(p[1:], points[j][1:])):
                parent[find(i)] = find(j)
    groups = collections.defaultdict(list)
    for i, p in enumerate(points):
        groups[find(i)].append(p[0])
    return {x: min(g) for g in groups.values() for x in g}


def test_clusters_join_across_cells(spark):
    random.seed(5)
    for d in (1, 2):
        points = [(i, *[round(random.random() * (4 if d == 1 else 2), 4) for _ in range(d)]) for i in range(150)]
        df = spark.createDataFrame([*points, (900, *[None] * d), (901, *[NAN] * d)], "id long, " + ", ".join(f"x{i} double" for i in range(d)))
        got = clusters.grid_clusters(df, "id", {f"x{i}": F.col(f"x{i}") for i in range(d)}, 0.1)
        assert {r.id: r.cluster for r in got.collect()} == brute_clusters(points, 0.1)


def test_cluster_description(spark):
    rows = [(i, 0.5) for i in (7, 3, 9)] + [(i, 0.58) for i in (1, 2)] + [(20, 5.0)]
    got = clusters.grid_clusters(spark.createDataFrame(rows, "id long, x double"), "id", {"x": F.col("x")}, 0.1)
    out = clusters.describe_clusters(got, 2, 2).collect()
    assert [(r.cluster, r.n_records, r.typical) for r in out] == [(1, 5, [1, 2])]
    assert clusters.grid_clusters(spark.createDataFrame([], "id long, x double"), "id", {"x": F.col("x")}).count() == 0


def brute_sequences(rows, length):
    sets = collections.defaultdict(list)
    for s, x, t in rows:
        if None not in (s, x, t):
            sets[s].append((t, x))
    out = collections.Counter()
    for ev in sets.values():
        ev = sorted(set(ev))
        found = set()

        def go(i, last, p):
            if len(p) == length:
                found.add(p)
                return
            for j in range(i, len(ev)):
                t, x = ev[j]
                if t > last and x not in p:
                    go(j + 1, t, (*p, x))

        go(0, -1, ())
        out.update(found)
    return out


@pytest.mark.parametrize(("heavy_rows", "broadcast", "portion"), [(20_000, 50_000, 200_000), (8, 50_000, 3), (8, 0, 200_000)])
def test_sequences(spark, monkeypatch, heavy_rows, broadcast, portion):
    """Heavy sets thinned or not, codes and heavy sets too many to broadcast, candidates in portions: the same result."""
    monkeypatch.setattr(sequences, "HEAVY_ROWS", heavy_rows)
    monkeypatch.setattr(sequences, "MOST_BROADCAST", broadcast)
    monkeypatch.setattr(sequences, "MOST_CANDIDATES", portion)
    df, rows = sets_frame(spark, 3)
    n = len({s for s, x, _ in rows if s is not None and x is not None})
    least = max(3, math.ceil(0.05 * n))
    want = {(k, v) for k, v in brute_sequences(rows, 3).items() if v >= least}
    got = sequences.frequent_subsequences(df, min_count=3, min_share=0.05, length=3)
    assert want == {((r.step_1, r.step_2, r.step_3), r.n_sets) for r in got.collect()} and want
    assert sequences.frequent_subsequences(df.limit(0), min_count=1).count() == 0


def test_equal_times_have_no_order(spark):
    df = spark.createDataFrame([("s", "a", 1), ("s", "b", 1), ("s", "c", 2), ("s", "c", 2)], "set_id string, node_id string, sort_column int")
    assert {tuple(r)[:2] for r in sequences.frequent_subsequences(df, length=2).collect()} == {("a", "c"), ("b", "c")}


def test_walked_sequences_count_as_the_diagram_does():
    random.seed(3)
    for _ in range(40):
        seqs = collections.Counter(tuple(2 * random.randrange(4) + (random.random() < 0.2) for _ in range(random.randint(2, 9))) for _ in range(8))
        seqs = {(*s[:-1], s[-1] & ~1): n for s, n in seqs.items()}
        for distinct in (True, False):
            for prefixes in (None, {(0, 1): {2, 3}, (1, 2): {0}, (3, 0): {1, 2}}):
                walked = collections.defaultdict(int)
                for s, n in seqs.items():
                    sequences.walk_supports(s, n, prefixes and sequences.prefix_tree(prefixes), distinct, walked)
                assert walked == sequences.local_supports(dict(seqs), prefixes, distinct)


def test_long_sequences(spark, monkeypatch):
    """One set of thousands of rows, and patterns of four steps."""
    rows = [("long", f"n{i % 50}", i) for i in range(3000)] + [("short", x, i) for i, x in enumerate(["n1", "n2", "n3", "n4", "n1"])]
    df = spark.createDataFrame(rows, "set_id string, node_id string, sort_column int")
    found = {tuple(r)[:4]: r.n_sets for r in sequences.frequent_subsequences(df, min_count=2, length=4).collect()}
    assert found == {("n1", "n2", "n3", "n4"): 2, ("n2", "n3", "n4", "n1"): 2}


def test_thinned_ranges_keep_all_patterns():
    random.seed(9)
    for _ in range(60):
        events = sorted((random.randrange(20), random.randrange(4)) for _ in range(random.randint(5, 50)))
        cut = random.randrange(20)
        kept = []
        for part in ([e for e in events if e[0] < cut], [e for e in events if e[0] >= cut]):
            t = sequences.Thinner(3)
            kept += [e for e in part if t.feed(*e)]
            kept += t.rest()
        rows = lambda ev: [("s", x, t) for t, x in ev]
        assert brute_sequences(rows(events), 3) == brute_sequences(rows(kept), 3)


def test_frequent_items(spark):
    random.seed(4)
    values = [random.choice(["a", "b", "c", "d%|"]) if random.random() < 0.6 else f"x{random.randrange(4000)}" for _ in range(6000)] + [None] * 50
    df = spark.createDataFrame([(v,) for v in values], "v string").repartition(5)
    counts = collections.Counter(v for v in values if v is not None)
    want = {(k, n) for k, n in counts.items() if n >= 0.01 * 6000}
    for width in (512, 4):
        assert {(r["item"], r.n_rows) for r in heavy_items.frequent_items(df, "v", 0.01, width=width).collect()} == want
    assert heavy_items.frequent_items(df.limit(0), "v").count() == 0


def test_sketches_add_up():
    rng = np.random.default_rng(1)
    h = rng.integers(0, 2**63, 500, dtype=np.uint64)
    whole, a, b = (heavy_items.GroupTestSketch(2, 64) for _ in range(3))
    whole.add(np.concatenate([h, h[:10]]))
    a.add(h)
    b.add(h[:10])
    assert (whole.counts == a.counts + b.counts).all()
    one = heavy_items.GroupTestSketch(2, 64)
    one.add(np.repeat(h[:1], 900))
    one.add(h)
    assert h[0] in one.decode(450)


def test_top_n(spark):
    random.seed(6)
    rows = [(random.choice("gG" + "h" * 6), f"x{random.randrange(30)}", random.choice([None, NAN, 0.0, -0.0, 0.5, random.random()])) for _ in range(800)] + [("g", None, 1.0), (None, "x1", 1.0), ("g", "g", 9.0), ("one", "ä", 0.1), ("one", "z", 0.1)]
    best = {}
    for g, x, s in rows:
        if g is not None and x is not None and s is not None and s == s and g != x:
            best[g, x] = max(best.get((g, x), -INF), s)
    want = set()
    for g in {g for g, _ in best}:
        own = sorted(((-s, x) for (h, x), s in best.items() if h == g))[:5]
        want |= {(g, x, k + 1) for k, (_, x) in enumerate(own)}
    df = spark.createDataFrame(rows, "item_a string, item_b string, score double").withColumn("run", F.lit(1)).repartition(7)
    for buckets in (1, 64):
        got = top_n.top_per_group(df, "item_a", "item_b", "score", 5, buckets).collect()
        assert {(r.group_key, r["item"], r["rank"]) for r in got} == want and len(got) == len(want)
    assert top_n.top_per_group(df.limit(0), "item_a", "item_b", "score").count() == 0


def test_loser_tree_merges():
    random.seed(8)
    for k in range(1, 9):
        runs = [sorted(random.randrange(50) for _ in range(random.randrange(12))) for _ in range(k)]
        tree, out = top_n.LoserTree(runs), []
        while (x := tree.head()) is not None:
            out.append(x)
            tree.move(tree.at[tree.winner] + 1)
        assert out == sorted(x for r in runs for x in r)


def test_borda(spark):
    rows = [(1, 1.0, 100.0), (2, 2.0, INF), (3, 2.0, None), (4, NAN, 100.0), (5, 0.0, -5e9)]
    df = spark.createDataFrame(rows, "rule_id long, a double, b double").withColumn("value", F.lit("x")).withColumn("n", F.lit(2))
    got = {r.id: (round(r.points, 6), r.n_missing, r.position) for r in borda_ranking(df, "rule_id", {"a": 1.0, "b": 1.0}).collect()}
    a = {1: 1 / 3, 2: 5 / 6, 3: 5 / 6, 4: 0.5, 5: 0.0}
    b = {1: 0.5, 2: 1.0, 3: 0.5, 4: 0.5, 5: 0.0}
    points = {i: round(a[i] + b[i], 6) for i in a}
    order = sorted(points, key=lambda i: (-points[i], i))
    assert got == {i: (points[i], int(i in (3, 4)), order.index(i) + 1) for i in points}
    assert borda_ranking(df.limit(0), "rule_id", {"a": 1.0}).count() == 0


def test_head(spark):
    rows = [(i, float(i), INF if i > 95 else float(i)) for i in range(100)] + [(200, NAN, 1.0), (201, 1e9, None)]
    df = spark.createDataFrame(rows, "rule_id long, a double, b double")
    assert {r.id for r in head_on_all(df, "rule_id", ["a", "b"], 0.1).collect()} == set(range(90, 100))
    assert head_on_all(df.limit(0), "rule_id", ["a", "b"]).count() == 0

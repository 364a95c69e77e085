import datetime as dt

import pytest

from weftline.operators import aggregates, temporal
from weftline.operators.windows import Windows, windowed_edges
from weftline.sources import datasets
from weftline.sources.interactions import canonical


@pytest.fixture(scope="module")
def sessions(spark):
    raw = datasets.temporal_interactions(spark)
    return canonical(raw.withColumn("t", raw.timestamp.cast("timestamp_ntz")), "session_id", "item_id", "t").cache()


def test_border_rows_are_in_two_windows(spark):
    day = lambda d: dt.datetime(2024, 1, d)
    df = spark.createDataFrame([("s", x, day(d)) for x, d in (("a", 1), ("b", 3), ("c", 5))], "set_id string, node_id string, sort_column timestamp_ntz")
    got = {(r.win, r.node_id) for r in Windows.of(df, 2).tag(df).collect()}
    assert got == {(0, "a"), (0, "b"), (1, "b"), (1, "c")}
    assert [r.label for r in Windows.of(df, 2).frame(spark).orderBy("win").collect()] == ["W1[2024-01-01→2024-01-03]", "W2[2024-01-03→2024-01-05]"]


def test_no_times_no_windows(spark):
    df = spark.createDataFrame([("s", "a", None)], "set_id string, node_id string, sort_column timestamp_ntz")
    assert temporal.SnapshotDiff(df).timeline().count() == 0
    assert aggregates.NodeWindows(df).rollup().count() == 0
    assert aggregates.NodeCorrelation(df).leading_lagging().count() == 0


def test_activity_is_conserved(sessions):
    windows = Windows.of(sessions, 4)
    total = sum(r.activity for r in aggregates.NodeWindows(sessions).per_window().collect())
    assert total == windows.tag(sessions).count()


def test_phases_show(sessions):
    roll = {r.node_id: r for r in aggregates.NodeWindows(sessions, 3).rollup().collect()}
    assert roll["A"].peak_window.startswith("W1") and roll["G"].status == "emerging" and roll["X"].active_windows == 3
    kinds = {r.kind for r in temporal.SnapshotDiff(sessions, 3).diff(0, 2).collect()}
    assert {"emerging", "fading"} <= kinds


def test_decay_prefers_the_recent(sessions):
    d = temporal.DecayGraph(sessions, 7)
    edges = {(r.source, r.target): r.decay_weight for r in d.edges.collect()}
    assert edges.get(("G", "H"), 0) > edges.get(("A", "B"), 0)
    assert d.recommend([]).count() == 0


def test_sliding_gives_new_models(sessions):
    s = temporal.SlidingGraph(sessions, 14)
    early = s.slide("2024-01-15 00:00:00")
    assert {r.node_id for r in early.rows.select("node_id").distinct().collect()} <= set("ABCX")
    assert s.anchor_date is None


def test_directed_chain(spark):
    rows = [("s", x, dt.datetime(2024, 1, 1, 10, i)) for i, x in enumerate("ABC")]
    df = spark.createDataFrame(rows, "set_id string, node_id string, sort_column timestamp_ntz")
    assert {(r.source, r.target): r.score for r in temporal.DirectedGraph(df, 0).edges.collect()} == {("A", "B"): 1.0, ("B", "C"): 1.0}
    assert {(r.source, r.target): r.weight for r in temporal.DirectedGraph(df).edges.collect()} == {("A", "B"): 1, ("A", "C"): 1, ("B", "C"): 1}
    assert [(r.next_item, r.steps) for r in temporal.DirectedGraph(df, 0).recommend_next(["A"]).collect()] == [("B", 1), ("C", 2)]
    assert {r.next_item for r in temporal.DirectedGraph(df, 0).reachable_from("B").collect()} == {"C"}


def test_long_sets_count_alike(spark, monkeypatch):
    rows = [("s", "ABC"[(i * i) % 7 % 3], dt.datetime(2024, 1, 1, 10, i)) for i in range(40)]
    df = spark.createDataFrame(rows, "set_id string, node_id string, sort_column timestamp_ntz")
    want = {}
    for i, (_, a, _) in enumerate(rows):
        for _, b, _ in rows[i + 1 :]:
            want[a, b] = want.get((a, b), 0) + 1
    for few in (0, 10_000):
        monkeypatch.setattr(temporal, "FEW_PAIRS", few)
        assert {(r.source, r.target): r.weight for r in temporal.DirectedGraph(df).edges.collect()} == want


def test_report_has_all_parts(sessions):
    report = aggregates.temporal_report(sessions, 3, 1, 0.1)
    assert len(report) == 8
    assert {r.part: r.n_rows for r in aggregates.report_summary(report).collect()}["graph_snapshots"] == 3
    assert report["graph_snapshots"].count() == 3
    assert all(r.cohesion >= 0 for r in report["communities"].collect())
    diagonal = report["synchrony"].where("node_a = node_b AND correlation IS NOT NULL").collect()
    assert diagonal and all(r.correlation == 1.0 for r in diagonal)


def test_pairs_of_wide_sets_are_not_shuffled(spark):
    times = [dt.datetime(2024, 1, d) for d in (1, 2, 9)]
    wide = [("s", f"n{i:03}", times[i % 2 * 2]) for i in range(150)] + [("s", "n000", times[1]), ("s", "n002", None)]
    df = spark.createDataFrame(wide + [("t", "n000", times[2]), ("t", "n001", times[2])], "set_id string, node_id string, sort_column timestamp_ntz")
    edges = windowed_edges(df, Windows.of(df, 2))
    shuffles = [x for x in edges._jdf.queryExecution().executedPlan().toString().split("\n") if "Exchange hashpartitioning" in x]
    assert shuffles and not any("source" in x or "target" in x for x in shuffles)
    found = {(r.win, r.source, r.target): r.weight for r in edges.collect()}
    assert len(found) == 150 * 149 + 1 and found[0, "n000", "n001"] == 2 and found[1, "n001", "n000"] == 3 and found[1, "n000", "n001"] == 1
    assert found[0, "n004", "n002"] == 2 and found[0, "n002", "n004"] == 1 and (1, "n002", "n004") not in found

"""Temporal aggregates of nodes, edges, whole graphs and communities."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from weftline.operators.temporal import ComponentTracker, SnapshotDiff
from weftline.operators.windows import Windows, windowed_edges, windowed_incidence, windowed_pairs
from weftline.plans.shared import cut


def _sd(n: int, s1: Column, s2: Column) -> Column:
    """Sample standard deviation over n windows from sums of values and squares; missing windows are zeros."""
    return F.sqrt(F.greatest((s2 - s1 * s1 / n) / (n - 1), F.lit(0.0))) if n > 1 else F.lit(None).cast("double")


def _slope(n: int, s1: Column, sx: Column) -> Column:
    """Least-squares slope of the values over window numbers 0..n-1, from their sum and their sum weighted by window."""
    mean = (n - 1) / 2
    spread = n * (n * n - 1) / 12
    return (sx - s1 * F.lit(mean)) / F.lit(spread) if n > 1 else F.lit(0.0)


def _label_map(labels: DataFrame, df: DataFrame, pairs: dict[str, str]) -> DataFrame:
    """Window numbers in columns replaced by labels under new names."""
    for old, new in pairs.items():
        df = df.join(F.broadcast(labels.select(F.col("win").alias(old), F.col("label").alias(new))), old, "left").drop(old)
    return df


@dataclass(frozen=True)
class NodeWindows:
    """Per-node activity in every window, and its course."""

    interactions: DataFrame
    n_windows: int = 4
    min_cooccurrence: int = 1

    def per_window(self, w: Windows | None = None) -> DataFrame:
        """(win, label, node_id, activity, sessions, out_degree): out-degree only where the node has enough row pairs in the window."""
        w = w or Windows.of(self.interactions, self.n_windows)
        active = w.tag(self.interactions).groupBy("win", "node_id", "set_id").agg(F.count(F.lit(1)).alias("m")).groupBy("win", "node_id").agg(F.sum("m").alias("activity"), F.count(F.lit(1)).alias("sessions"))
        degree = windowed_edges(self.interactions, w).groupBy("win", F.col("source").alias("node_id")).agg(F.count(F.lit(1)).alias("out_degree"), F.sum("weight").alias("_w")).where(F.col("_w") >= self.min_cooccurrence).drop("_w")
        out = active.join(degree, ["win", "node_id"], "left").withColumn("out_degree", F.coalesce("out_degree", F.lit(0)).cast("long"))
        return out.join(F.broadcast(w.frame(self.interactions.sparkSession)), "win").select("win", "label", "node_id", "activity", "sessions", "out_degree")

    def rollup(self) -> DataFrame:
        """One row a node: first, last and peak window, activity mean over active windows, deviation and trend over all, status."""
        n = self.n_windows
        w = Windows.of(self.interactions, n)
        a = F.col("activity").cast("double")
        s = self.per_window(w).groupBy("node_id").agg(
            F.min("win").alias("first"), F.max("win").alias("last"), F.min_by("win", F.struct(-F.col("activity"), F.col("win"))).alias("peak"), F.count(F.lit(1)).cast("int").alias("active_windows"),
            F.sum("activity").cast("long").alias("total_activity"), F.sum(a * a).alias("s2"), F.sum(a * F.col("win")).alias("sx"), F.sum("sessions").cast("long").alias("total_sessions"),
        )
        s1 = F.col("total_activity").cast("double")
        out = s.withColumn("lifetime_windows", F.col("last") - F.col("first") + 1).withColumn("mean_activity", F.round(s1 / F.col("active_windows"), 3)).withColumn("activity_std", F.round(_sd(n, s1, F.col("s2")), 3))
        out = out.withColumn("activity_trend", F.round(_slope(n, s1, F.col("sx")), 3)).withColumn("status", F.when(F.col("first") > 0, "emerging").when(F.col("last") < n - 1, "churned").otherwise("active"))
        out = _label_map(w.frame(self.interactions.sparkSession), out, {"first": "first_window", "last": "last_window", "peak": "peak_window"})
        return out.select("node_id", "first_window", "last_window", "peak_window", "active_windows", "lifetime_windows", "total_activity", "mean_activity", "activity_std", "activity_trend", "total_sessions", "status")


@dataclass(frozen=True)
class EdgeWindows:
    """Per-edge weights in every window, and the edge's life."""

    interactions: DataFrame
    n_windows: int = 4
    min_cooccurrence: int = 1

    def per_window(self) -> DataFrame:
        return SnapshotDiff(self.interactions, self.n_windows, self.min_cooccurrence).timeline()

    def rollup(self) -> DataFrame:
        """One row an edge: stability, weights, trend (0 if active once), first, last and peak window, kind."""
        n = self.n_windows
        w = Windows.of(self.interactions, n)
        v = F.col("weight").cast("double")
        s = windowed_edges(self.interactions, w, self.min_cooccurrence).groupBy("source", "target").agg(
            F.min("win").alias("first"), F.max("win").alias("last"), F.min_by("win", F.struct(-F.col("weight"), F.col("win"))).alias("peak"), F.count(F.lit(1)).cast("int").alias("active_windows"),
            F.sum(v).alias("s1"), F.sum(v * v).alias("s2"), F.sum(v * F.col("win")).alias("sx"), F.max(v).alias("weight_max"),
        )
        k = F.col("active_windows")
        out = s.withColumn("stability", F.round(k / n, 3)).withColumn("weight_mean", F.round(F.col("s1") / k, 3)).withColumn("weight_std", F.round(_sd(n, F.col("s1"), F.col("s2")), 3))
        out = out.withColumn("weight_trend", F.when(k > 1, F.round(_slope(n, F.col("s1"), F.col("sx")), 4)).otherwise(F.lit(0.0))).withColumn("edge_kind", F.when(k > n * 0.5, "persistent").when(k == 1, "transient").otherwise("sporadic"))
        out = _label_map(w.frame(self.interactions.sparkSession), out, {"first": "first_window", "last": "last_window", "peak": "peak_window"})
        return out.select("source", "target", "active_windows", "stability", "weight_mean", "weight_std", "weight_max", "weight_trend", "peak_window", "first_window", "last_window", "edge_kind")


def graph_snapshots(df: DataFrame, n_windows: int = 4, min_cooccurrence: int = 1, tracker: ComponentTracker | None = None) -> DataFrame:
    """One row a window with activity: nodes, edges, density, sessions, arrivals and departures, and the tracker's components if given.

    Departures count in the window after a node's last one. Rows by window, set
    and node are counted once, at the call, and written; all parts read them.
    """
    w = Windows.of(df, n_windows)
    tagged = cut(windowed_incidence(df, w), "windowed")
    seen = tagged.groupBy("win", "node_id").agg(F.sum("m").alias("m"))
    nodes = seen.groupBy("win").agg(F.count(F.lit(1)).alias("n_nodes"))
    sessions = tagged.select("win", "set_id").distinct().groupBy("win").agg(F.count(F.lit(1)).alias("n_sessions"))
    edges = windowed_pairs(df, w, min_cooccurrence, tagged=tagged).groupBy("win").agg(F.count(F.lit(1)).alias("n_edges"))
    life = seen.groupBy("node_id").agg(F.min("win").alias("first"), F.max("win").alias("last"))
    new = life.groupBy(F.col("first").alias("win")).agg(F.count(F.lit(1)).alias("new_nodes"))
    gone = life.where(F.col("last") < n_windows - 1).groupBy((F.col("last") + 1).alias("win")).agg(F.count(F.lit(1)).alias("churned_nodes"))
    out = nodes
    for part in (edges, sessions, new, gone):
        out = out.join(part, "win", "left")
    zero = ["n_edges", "n_sessions", "new_nodes", "churned_nodes"]
    out = out.select("win", "n_nodes", *[F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in zero])
    pairs = F.col("n_nodes") * (F.col("n_nodes") - 1) / 2.0
    out = out.withColumn("density", F.round(F.col("n_edges") / F.nullif(pairs, F.lit(0.0)), 4)).withColumn("avg_degree", F.round(2.0 * F.col("n_edges") / F.col("n_nodes"), 3))
    if tracker is not None:
        sets = tracker.timeline(w, tagged if tracker.interactions is df and tracker.n_windows == n_windows else None).groupBy("win").agg(F.count_distinct("scc_id").alias("n_sccs"), F.max("scc_size").cast("long").alias("largest_scc_size"), F.count(F.lit(1)).alias("_members"))
        out = out.join(sets, "win", "left").withColumn("scc_coverage", F.round(F.coalesce("_members", F.lit(0)) / F.col("n_nodes"), 3))
        out = out.withColumn("n_sccs", F.coalesce("n_sccs", F.lit(0)).cast("long")).withColumn("largest_scc_size", F.coalesce("largest_scc_size", F.lit(0)).cast("long"))
    else:
        out = out.withColumn("n_sccs", F.lit(None).cast("long")).withColumn("largest_scc_size", F.lit(None).cast("long")).withColumn("scc_coverage", F.lit(None).cast("double"))
    out = out.join(F.broadcast(w.frame(df.sparkSession)), "win")
    return out.select("win", "label", "n_nodes", "n_edges", "density", "avg_degree", "n_sessions", "new_nodes", "churned_nodes", "n_sccs", "largest_scc_size", "scc_coverage")


def community_metrics(tracker: ComponentTracker) -> DataFrame:
    """One row a window and sink component: cohesion (weights inside over possible pairs), weights leaving it, and the members they leave from."""
    df = tracker.interactions
    w = tracker.windows
    parts = tracker.timeline(w)
    pairs = windowed_pairs(df, w)
    side = lambda c, x: parts.select("win", F.col("node").alias(c), F.col("scc_id").alias(x))
    met = pairs.join(side("source", "sid"), ["win", "source"], "left").join(side("target", "tid"), ["win", "target"], "left").where(F.col("sid").isNotNull() | F.col("tid").isNotNull())
    inside = met.where("sid = tid").groupBy("win", F.col("sid").alias("scc_id")).agg(F.sum("weight").alias("internal_edges"))
    leaves = met.where("sid is distinct from tid")
    out = leaves.where("sid is not null").select("win", F.col("sid").alias("scc_id"), "weight", F.col("source").alias("bridge")).unionByName(leaves.where("tid is not null").select("win", F.col("tid").alias("scc_id"), "weight", F.col("target").alias("bridge")))
    outside = out.groupBy("win", "scc_id").agg(F.sum("weight").alias("external_edges"), F.array_sort(F.collect_set("bridge")).alias("b"))
    sets = parts.groupBy("win", "scc_id").agg(F.max("scc_size").cast("long").alias("size"), F.max("members").alias("members"))
    all_ = sets.join(inside, ["win", "scc_id"], "left").join(outside, ["win", "scc_id"], "left").join(F.broadcast(w.frame(df.sparkSession)), "win")
    possible = (F.col("size") * (F.col("size") - 1) / 2).cast("long")
    inner = F.coalesce("internal_edges", F.lit(0)).cast("long")
    return all_.select(
        F.col("win").alias("window"), F.col("label").alias("window_label"), "scc_id", "size", "members", inner.alias("internal_edges"), possible.alias("possible_edges"),
        F.when(possible > 0, F.round(inner / F.nullif(possible, F.lit(0)), 3)).otherwise(F.lit(1.0)).alias("cohesion"), F.coalesce("external_edges", F.lit(0)).cast("long").alias("external_edges"),
        F.coalesce(F.array_join("b", "|"), F.lit("")).alias("bridge_nodes"), F.when(F.col("b").isNull(), 0).otherwise(F.size("b")).cast("long").alias("n_bridge_nodes"),
    )


@dataclass(frozen=True)
class NodeCorrelation:
    """How the activities of nodes move together over the windows that have any row.

    The moments of a pair are summed over windows that hold both; windows that
    lack one add nothing to the mixed sum. Pairs of nodes number the square of
    the nodes, so it suits node vocabularies, not open-ended ids.
    """

    interactions: DataFrame
    n_windows: int = 4
    max_lag: int = 2

    def _series(self) -> tuple[DataFrame, int]:
        """((node, a): activities by used window as an array), and the number of used windows. Window numbers are closed up."""
        w = Windows.of(self.interactions, self.n_windows)
        counts = w.tag(self.interactions).groupBy("win", "node_id").agg(F.count(F.lit(1)).cast("double").alias("c"))
        used = sorted(r.win for r in counts.select("win").distinct().collect())
        at = F.array(*[F.coalesce(F.sum(F.when(F.col("win") == i, F.col("c"))), F.lit(0.0)) for i in used])
        return counts.groupBy(F.col("node_id").alias("node")).agg(at.alias("a")), len(used)

    def synchrony(self) -> DataFrame:
        """(node_a, node_b, correlation) of all ordered pairs, itself included; null where an activity never changes."""
        s, n = self._series()
        a, b = s.select(F.col("node").alias("node_a"), F.col("a").alias("x")), s.select(F.col("node").alias("node_b"), F.col("a").alias("y"))
        return a.join(b, F.lit(True)).select("node_a", "node_b", F.round(pearson("x", "y", n), 3).alias("correlation"))

    def leading_lagging(self) -> DataFrame:
        """(node_a, node_b, lag, correlation, relationship): for each pair and lag the direction that correlates more, if one does."""
        s, n = self._series()
        a, b = s.select(F.col("node").alias("na"), F.col("a").alias("x")), s.select(F.col("node").alias("nb"), F.col("a").alias("y"))
        pairs = a.join(b, F.col("na") < F.col("nb"))
        rows = [F.struct(F.lit(k).alias("lag"), F.coalesce(pearson("x", "y", n, k), F.lit(0.0)).alias("ab"), F.coalesce(pearson("y", "x", n, k), F.lit(0.0)).alias("ba")) for k in range(1, min(self.max_lag, n - 1) + 1)]
        if not rows:
            return pairs.select(F.col("na").alias("node_a"), F.col("nb").alias("node_b"), F.lit(0).alias("lag"), F.lit(0.0).alias("correlation"), F.lit("").alias("relationship")).limit(0)
        each = pairs.select("na", "nb", F.explode(F.array(*rows)).alias("r")).select("na", "nb", "r.*").where(F.abs(F.abs("ab") - F.abs("ba")) > 1e-6)
        first = F.abs("ab") > F.abs("ba")
        lead, follow = F.when(first, F.col("na")).otherwise(F.col("nb")), F.when(first, F.col("nb")).otherwise(F.col("na"))
        return each.select(lead.alias("node_a"), follow.alias("node_b"), "lag", F.round(F.when(first, F.col("ab")).otherwise(F.col("ba")), 3).alias("correlation"), F.concat(lead, F.lit(" leads "), follow).alias("relationship"))


def pearson(x: str, y: str, n: int, lag: int = 0) -> Column:
    """Correlation of two array columns, the second shifted by ``lag``; null where one has no spread."""
    m = n - lag
    if m < 2:
        return F.lit(None).cast("double")
    xs, ys = f"slice({x}, 1, {m})", f"slice({y}, {1 + lag}, {m})"
    total = lambda a: F.expr(f"aggregate({a}, 0.0D, (s, v) -> s + v)")
    times = lambda a, b: f"zip_with({a}, {b}, (p, q) -> p * q)"
    sx, sy = total(xs), total(ys)
    cov = total(times(xs, ys)) - sx * sy / m
    vx, vy = total(times(xs, xs)) - sx * sx / m, total(times(ys, ys)) - sy * sy / m
    return F.when((vx > 1e-9) & (vy > 1e-9), cov / F.nullif(F.sqrt(F.abs(vx)) * F.sqrt(F.abs(vy)), F.lit(0.0)))


def temporal_report(df: DataFrame, n_windows: int = 4, min_cooccurrence: int = 1, min_confidence: float = 0.0, max_lag: int = 2) -> dict[str, DataFrame]:
    """All aggregates by name."""
    tracker = ComponentTracker(df, n_windows, max(2, min_cooccurrence), min_confidence)
    nodes, edges, links = NodeWindows(df, n_windows, min_cooccurrence), EdgeWindows(df, n_windows, min_cooccurrence), NodeCorrelation(df, n_windows, max_lag)
    return {
        "node_per_window": nodes.per_window(), "node_rollup": nodes.rollup(), "edge_per_window": edges.per_window(), "edge_rollup": edges.rollup(),
        "graph_snapshots": graph_snapshots(df, n_windows, min_cooccurrence, tracker), "communities": community_metrics(tracker), "synchrony": links.synchrony(), "leading_lagging": links.leading_lagging(),
    }




def report_summary(report: dict[str, DataFrame]) -> DataFrame:
    """(part, n_rows) of a report."""
    parts = [df.agg(F.lit(name).alias("part"), F.count(F.lit(1)).alias("n_rows")) for name, df in report.items()]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out

"""Graphs in time: decayed, sliding, directed, compared between windows."""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass, replace

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from weftline.operators.components import confident_edges, scc_table
from weftline.operators.graph import GraphModel, best_rows, path_integral, seed_rows, simple_paths
from weftline.operators.windows import Windows, windowed_edges, windowed_incidence
from weftline.plans.instants import from_micros, micros


def _with_time(df: DataFrame) -> DataFrame:
    """``sort_column`` as a timestamp without zone."""
    return df.withColumn("sort_column", from_micros(micros(df, "sort_column")))


@dataclass(frozen=True)
class DecayGraph:
    """Co-occurrence in which a row of age d days weighs 2 ** (-d / half_life_days); an edge has the age of its source row."""

    interactions: DataFrame
    half_life_days: float = 30.0
    reference_date: str | None = None
    min_weight: float = 0.01

    def _aged(self) -> DataFrame:
        df = _with_time(self.interactions)
        latest = df.agg(F.max("sort_column").alias("_ref")) if self.reference_date is None else df.sparkSession.range(1).select(F.lit(self.reference_date).cast("timestamp_ntz").alias("_ref"))
        rate = math.log(2) / self.half_life_days
        age = F.datediff("_ref", "sort_column")
        return df.crossJoin(F.broadcast(latest)).select("set_id", "node_id", F.exp(F.lit(-rate) * age).alias("w")).where(F.col("w").isNotNull())

    @property
    def edges(self) -> DataFrame:
        """(source, target, decay_weight, score)."""
        aged = self._aged()
        items = aged.groupBy("set_id", "node_id").agg(F.sum("w").alias("w"))
        rows = self.interactions.groupBy("set_id", "node_id").agg(F.count(F.lit(1)).alias("m"))
        met = items.withColumnRenamed("node_id", "source").join(rows.withColumnRenamed("node_id", "target"), "set_id").where(F.col("source") != F.col("target"))
        edges = met.groupBy("source", "target").agg(F.sum(F.col("w") * F.col("m")).alias("decay_weight")).where(F.col("decay_weight") >= self.min_weight)
        totals = aged.groupBy(F.col("node_id").alias("source")).agg(F.sum("w").alias("_total"))
        return edges.join(totals, "source").select("source", "target", "decay_weight", (F.col("decay_weight") / F.col("_total")).alias("score"))

    def edge_table(self) -> DataFrame:
        """The edges by falling score."""
        return self.edges.orderBy(F.desc("score"), "source", "target")

    def recommend(self, seeds: list[str], max_depth: int = 2, n: int = 10, exclude_seed: bool = True) -> DataFrame:
        """(recommended_item, decay_score, min_hops, reason)."""
        found = path_integral(simple_paths(self.edges, seed_rows(self.interactions, seeds), max_depth))
        found = found.where(~F.col("item").isin(seeds)) if exclude_seed else found
        return best_rows(found.select(F.col("item").alias("recommended_item"), F.col("total_strength").alias("decay_score"), "min_hops", "reason"), "decay_score", "recommended_item", n)


@dataclass(frozen=True)
class SlidingGraph:
    """The graph of the rows within ``window_days`` before an anchor, both ends inclusive; sliding gives a new one."""

    interactions: DataFrame
    window_days: int = 30
    anchor_date: str | None = None
    min_cooccurrence: int = 1
    alpha: float = 0.0

    @property
    def rows(self) -> DataFrame:
        df = _with_time(self.interactions)
        anchor = df.agg(F.max("sort_column").alias("_a")) if self.anchor_date is None else df.sparkSession.range(1).select(F.lit(self.anchor_date).cast("timestamp_ntz").alias("_a"))
        held = df.crossJoin(F.broadcast(anchor)).where(F.col("sort_column").between(F.col("_a") - F.expr(f"interval {int(self.window_days)} days"), F.col("_a")))
        return held.drop("_a")

    @property
    def model(self) -> GraphModel:
        return GraphModel(self.rows, self.min_cooccurrence, self.alpha)

    def recommend(self, seeds: list[str], **kw) -> DataFrame:
        return self.model.recommend(seeds, **kw)

    def slide(self, anchor_date: str) -> SlidingGraph:
        return replace(self, anchor_date=anchor_date)


@dataclass(frozen=True)
class SnapshotDiff:
    """Edge weights by window, and how they change between two windows."""

    interactions: DataFrame
    n_windows: int = 4
    min_cooccurrence: int = 1

    @property
    def windows(self) -> Windows:
        return Windows.of(self.interactions, self.n_windows)

    def timeline(self) -> DataFrame:
        """(win, label, source, target, weight)."""
        w = self.windows
        return windowed_edges(self.interactions, w, self.min_cooccurrence).join(F.broadcast(w.frame(self.interactions.sparkSession)), "win").select("win", "label", "source", "target", "weight")

    def diff(self, a: int, b: int) -> DataFrame:
        """(source, target, weight_a, weight_b, delta, kind), the largest changes first: emerging and fading edges are missing on one side; equal weights count as weakening."""
        edges = windowed_edges(self.interactions, self.windows, self.min_cooccurrence).where(F.col("win").isin(a, b))
        at = lambda i: F.coalesce(F.sum(F.when(F.col("win") == i, F.col("weight"))), F.lit(0)).cast("long")
        both = edges.groupBy("source", "target").agg(at(a).alias("weight_a"), at(b).alias("weight_b"))
        kind = F.when(F.col("weight_a") == 0, "emerging").when(F.col("weight_b") == 0, "fading").when(F.col("weight_b") > F.col("weight_a"), "strengthening").otherwise("weakening")
        return both.withColumn("delta", F.col("weight_b") - F.col("weight_a")).withColumn("kind", kind).orderBy(F.abs("delta").desc(), "source", "target")


@dataclass(frozen=True)
class ComponentTracker:
    """Sink components of each window, all windows in one run, and how they go over into each other."""

    interactions: DataFrame
    n_windows: int = 4
    min_cooccurrence: int = 2
    min_confidence: float = 0.0

    @property
    def windows(self) -> Windows:
        return Windows.of(self.interactions, self.n_windows)

    def timeline(self, windows: Windows | None = None, items: DataFrame | None = None) -> DataFrame:
        """(win, node, scc_id, scc_size, is_sink, members). ``items`` is the windowed incidence, where it is there already."""
        items = windowed_incidence(self.interactions, windows or self.windows) if items is None else items
        return scc_table(confident_edges(self.interactions, self.min_cooccurrence, self.min_confidence, ("win",), items), ("win",))

    def evolution(self, threshold: float = 0.5) -> DataFrame:
        """(transition, event, prev_members, curr_members, jaccard) of consecutive windows.

        Each component is matched with the previous one of highest Jaccard
        overlap, from ``threshold`` on: stable above 0.8, else evolving. What has
        no match is emerging or dissolving.
        """
        w = self.windows
        spark = self.interactions.sparkSession
        t = self.timeline(w)
        sets = t.groupBy("win", "scc_id").agg(F.max("scc_size").alias("size"), F.max("members").alias("members"))
        curr = t.select("win", "node", F.col("scc_id").alias("cid"), F.col("scc_size").alias("cs"), F.col("members").alias("cm"))
        prev = t.select((F.col("win") + 1).alias("win"), "node", F.col("scc_id").alias("pid"), F.col("scc_size").alias("ps"), F.col("members").alias("pm"))
        met = curr.join(prev, ["win", "node"]).groupBy("win", "cid", "pid", "cs", "ps", "cm", "pm").agg(F.count(F.lit(1)).alias("c"))
        scored = met.withColumn("j", F.col("c") / (F.col("cs") + F.col("ps") - F.col("c")))
        best = Window.partitionBy("win", "cid").orderBy(F.desc("j"), "pid")
        kept = scored.withColumn("k", F.row_number().over(best)).where((F.col("k") == 1) & (F.col("j") >= threshold))
        event = F.when(F.col("j") > 0.8, "stable").otherwise("evolving")
        out = kept.select("win", event.alias("event"), F.col("pm").alias("prev_members"), F.col("cm").alias("curr_members"), F.round("j", 3).alias("jaccard"))
        gone = sets.where(F.col("win") < self.n_windows - 1).select((F.col("win") + 1).alias("win"), F.col("scc_id").alias("pid"), "members").join(kept.select("win", "pid"), ["win", "pid"], "left_anti")
        new = sets.where(F.col("win") > 0).select("win", F.col("scc_id").alias("cid"), "members").join(kept.select("win", "cid"), ["win", "cid"], "left_anti")
        out = out.unionByName(gone.select("win", F.lit("dissolving").alias("event"), F.col("members").alias("prev_members"), F.lit("").alias("curr_members"), F.lit(0.0).alias("jaccard")))
        out = out.unionByName(new.select("win", F.lit("emerging").alias("event"), F.lit("").alias("prev_members"), F.col("members").alias("curr_members"), F.lit(0.0).alias("jaccard")))
        labels = w.frame(spark)
        names = labels.join(labels.select((F.col("win") + 1).alias("win"), F.col("label").alias("before")), "win").select("win", F.concat_ws(" → ", "before", "label").alias("transition"))
        return out.join(F.broadcast(names), "win").select("transition", "event", "prev_members", "curr_members", "jaccard")


#: Up to so many pairs of positions are compared one by one, without leaving the JVM.
FEW_PAIRS = 256


def _in_order(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """For two sorted lists of positions, how many pairs have the first before the second."""
    for b in batches:
        first, second = (x.to_numpy(zero_copy_only=False) for x in (b.column(2), b.column(3)))
        counts = [int(np.searchsorted(p, q).sum()) for p, q in zip(first, second)]
        yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(counts, pa.int64())], ["source", "target", "c"])


@dataclass(frozen=True)
class DirectedGraph:
    """Edges from what comes before to what comes after in a set; rows of a set are numbered by time, then node.

    With ``max_gap`` each row looks ahead ``max_gap + 1`` rows. Without it every
    later row counts: positions of two nodes of a set are sorted lists, of
    which, unless they are short, a binary search counts the pairs in order.
    """

    interactions: DataFrame
    max_gap: int | None = None
    min_support: int = 1

    @property
    def edges(self) -> DataFrame:
        """(source, target, weight, score): score is the share among the source's kept edges, self-pairs included."""
        df = self.interactions
        order = Window.partitionBy("set_id").orderBy(micros(df, "sort_column").asc_nulls_last(), "node_id")
        if self.max_gap is not None:
            ahead = F.array_compact(F.array(*[F.lead("node_id", k).over(order) for k in range(1, self.max_gap + 2)]))
            raw = df.withColumn("_ahead", ahead).select(F.col("node_id").alias("source"), F.explode("_ahead").alias("target")).groupBy("source", "target").agg(F.count(F.lit(1)).alias("weight"))
        else:
            placed = df.select("set_id", "node_id", F.row_number().over(order).alias("pos"))
            runs = placed.groupBy("set_id", "node_id").agg(F.array_sort(F.collect_list("pos")).alias("p"))
            a, b = runs.select("set_id", F.col("node_id").alias("source"), F.col("p").alias("pa")), runs.select("set_id", F.col("node_id").alias("target"), F.col("p").alias("pb"))
            met = a.join(b, "set_id").select("source", "target", "pa", "pb")
            few = F.size("pa").cast("long") * F.size("pb") <= FEW_PAIRS
            one_by_one = F.expr("aggregate(pb, 0L, (n, y) -> n + size(filter(pa, x -> x < y)))")
            pairs = met.where(few).select("source", "target", one_by_one.alias("c")).unionByName(met.where(~few).mapInArrow(_in_order, "source string, target string, c long"))
            raw = pairs.where("c > 0").groupBy("source", "target").agg(F.sum("c").alias("weight"))
        raw = raw.where(F.col("weight") >= self.min_support)
        totals = raw.groupBy("source").agg(F.sum("weight").alias("_out"))
        return raw.join(totals, "source").select("source", "target", "weight", (F.col("weight") / F.col("_out")).alias("score"))

    def edge_table(self) -> DataFrame:
        """The edges by falling score."""
        return self.edges.orderBy(F.desc("score"), "source", "target")

    def recommend_next(self, seeds: list[str], max_depth: int = 3, n: int = 10, exclude_seed: bool = True) -> DataFrame:
        """(next_item, transition_prob, steps, path): steps are those of the strongest path. No seeds, no rows."""
        found = path_integral(simple_paths(self.edges, seed_rows(self.interactions, seeds), max_depth))
        found = found.where(~F.col("item").isin(seeds)) if exclude_seed else found
        return best_rows(found.select(F.col("item").alias("next_item"), F.col("total_strength").alias("transition_prob"), F.col("best_depth").alias("steps"), F.col("reason").alias("path")), "transition_prob", "next_item", n)

    def reachable_from(self, node: str, max_depth: int = 3, n: int | None = 1000) -> DataFrame:
        """The ``n`` nodes reached with the highest probability, all of them with None."""
        return self.recommend_next([node], max_depth, n=n)

"""Strongly connected components, and those that no edge leaves."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weftline.operators.graph import cooccurrence, mirrored, node_totals, pair_counts
from weftline.plans.ranking import range_offsets
from weftline.plans.shared import Cut

#: Up to so many edges, each group is solved in one task; beyond, by colouring over the cluster.
SMALL_EDGES = 200_000


def confident_edges(df: DataFrame, min_cooccurrence: int, min_confidence: float, by: tuple[str, ...] = (), items: DataFrame | None = None) -> DataFrame:
    """(by.., source, target): co-occurrences over rows of the source, from ``min_confidence`` on. ``items`` is the incidence of ``df``, where it is there already."""
    if items is None:
        edges, totals = cooccurrence(df, by, min_cooccurrence).alias("e"), node_totals(df, by).alias("t")
    else:
        edges = mirrored(pair_counts(items, by).where(F.col("weight") >= min_cooccurrence)).alias("e")
        totals = items.groupBy(*by, "node_id").agg(F.sum("m").alias("total")).alias("t")
    on = [F.col(f"e.{b}") == F.col(f"t.{b}") for b in by] + [F.col("e.source") == F.col("t.node_id")]
    return edges.join(totals, on).where(F.col("weight") / F.col("total") >= min_confidence).select(*[F.col(f"e.{b}").alias(b) for b in by], "source", "target")


def tarjan(pairs: list[tuple[str, str]]) -> dict[str, str]:
    """The least member of each node's component; no recursion."""
    after: dict[str, list[str]] = {}
    for s, t in pairs:
        after.setdefault(s, []).append(t)
        after.setdefault(t, [])
    number: dict[str, int] = {}
    low: dict[str, int] = {}
    path: list[str] = []
    on_path: set[str] = set()
    out: dict[str, str] = {}
    for root in after:
        if root in number:
            continue
        work = [(root, iter(after[root]))]
        number[root] = low[root] = len(number)
        path.append(root)
        on_path.add(root)
        while work:
            v, rest = work[-1]
            for w in rest:
                if w not in number:
                    number[w] = low[w] = len(number)
                    path.append(w)
                    on_path.add(w)
                    work.append((w, iter(after[w])))
                    break
                if w in on_path:
                    low[v] = min(low[v], number[w])
            else:
                work.pop()
                if work:
                    low[work[-1][0]] = min(low[work[-1][0]], low[v])
                if low[v] == number[v]:
                    at = path.index(v) if len(path) < 64 else len(path) - 1 - path[::-1].index(v)
                    members = path[at:]
                    del path[at:]
                    on_path.difference_update(members)
                    least = min(members)
                    out.update((m, least) for m in members)
    return out


def _solve_group(by: list[str]):
    def run(frame: pd.DataFrame) -> pd.DataFrame:
        found = tarjan(list(zip(frame["source"], frame["target"])))
        out = pd.DataFrame({"node": list(found), "component": list(found.values())})
        for b in by:
            out[b] = frame[b].iloc[0]
        return out[[*by, "node", "component"]]

    return run


def _spread(edges: DataFrame, start: DataFrame, keys: list[str]) -> Cut:
    """Least label that reaches each node: ``start`` has (keys, node, label), labels run along (source, target) until nothing changes."""
    now = Cut(start, "colour")
    while True:
        labels = now.df
        sent = edges.join(labels.withColumnRenamed("node", "source"), [*keys, "source"]).groupBy(*keys, F.col("target").alias("node")).agg(F.min("label").alias("seen"))
        new = Cut(labels.join(sent, [*keys, "node"], "left").select(*keys, "node", F.col("label").alias("old"), F.least("label", F.coalesce("seen", "label")).alias("label")), "colour")
        changed = not new.df.where(F.col("label") < F.col("old")).isEmpty()
        now.drop()
        now = new
        if not changed:
            return now


def coloured_components(edges: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    """(by.., node, component) over the whole cluster: the least node that reaches a node is its colour; nodes of a colour that reach back to it are its component."""
    keys = list(by)
    rest = Cut(edges.select(*keys, "source", "target").distinct(), "edges")
    nodes = lambda e: e.select(*keys, F.col("source").alias("node")).union(e.select(*keys, "target")).distinct()
    open_nodes = Cut(nodes(rest.df), "nodes")
    done: list[DataFrame] = []
    while not open_nodes.df.isEmpty():
        colours = _spread(rest.df, open_nodes.df.select(*keys, "node", F.col("node").alias("label")), keys).df.select(*keys, "node", F.col("label").alias("colour"))
        inside = rest.df.join(colours.select(*keys, F.col("node").alias("source"), F.col("colour").alias("c1")), [*keys, "source"]).join(colours.select(*keys, F.col("node").alias("target"), F.col("colour").alias("c2")), [*keys, "target"]).where("c1 = c2")
        back = Cut(inside.select(*keys, F.col("target").alias("source"), F.col("source").alias("target")), "back")
        far = F.lit("\U0010ffff")
        marks = colours.select(*keys, "node", F.when(F.col("node") == F.col("colour"), F.col("node")).otherwise(far).alias("label"))
        reached = _spread(back.df, marks, keys).df.where(F.col("label") != far).select(*keys, "node", F.col("label").alias("component"))
        done.append(reached)
        open_nodes = Cut(open_nodes.df.join(reached, [*keys, "node"], "left_anti"), "nodes")
        left = open_nodes.df
        rest = Cut(rest.df.join(left.withColumnRenamed("node", "source"), [*keys, "source"], "left_semi").join(left.withColumnRenamed("node", "target"), [*keys, "target"], "left_semi"), "edges")
    if not done:
        return edges.select(*keys, F.col("source").alias("node"), F.col("target").alias("component")).limit(0)
    out = done[0]
    for d in done[1:]:
        out = out.unionByName(d)
    return out


def strong_components(edges: DataFrame, by: tuple[str, ...] = (), small: int = SMALL_EDGES) -> DataFrame:
    """(by.., node, component): the least node of each node's strongly connected component. Only nodes with edges appear."""
    held = Cut(edges, "edges").df
    if held.count() > small:
        return coloured_components(held, by)
    kinds = dict(held.dtypes)
    schema = ", ".join([*(f"`{b}` {kinds[b]}" for b in by), "node string, component string"])
    return held.groupBy(*by).applyInPandas(_solve_group(list(by)), schema)


def scc_table(edges: DataFrame, by: tuple[str, ...] = (), include_transient: bool = False) -> DataFrame:
    """(by.., node, scc_id, scc_size, is_sink, members): sink components, numbered from 0 in order of their least member."""
    edges = Cut(edges, "edges").df
    parts = Cut(strong_components(edges, by), "components").df
    keys = list(by)
    ends = edges.join(parts.select(*keys, F.col("node").alias("source"), F.col("component").alias("c")), [*keys, "source"]).join(parts.select(*keys, F.col("node").alias("target"), F.col("component").alias("c2")), [*keys, "target"])
    leaving = ends.where("c <> c2").select(*keys, F.col("c").alias("component")).distinct().withColumn("_leaves", F.lit(True))
    groups = parts.groupBy(*keys, "component").agg(F.count(F.lit(1)).cast("int").alias("scc_size"), F.array_join(F.array_sort(F.collect_list("node")), "|").alias("members"))
    groups = groups.join(leaving, [*keys, "component"], "left").withColumn("is_sink", F.col("_leaves").isNull()).drop("_leaves")
    if not include_transient:
        groups = groups.where("is_sink")
    groups = range_offsets(groups.withColumn("_all", F.lit(0)), keys or ["_all"], [F.col("component")]).withColumn("scc_id", F.col("_before").cast("int"))
    return parts.join(groups, [*keys, "component"]).select(*keys, "node", "scc_id", "scc_size", "is_sink", "members")


def sink_components(df: DataFrame, min_cooccurrence: int = 5, min_confidence: float = 0.0) -> DataFrame:
    """Sink components of the co-occurrence graph of interactions."""
    return scc_table(confident_edges(df, min_cooccurrence, min_confidence))

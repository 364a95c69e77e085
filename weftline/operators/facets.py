"""Contexts with facets: composite keys, facet entities, slices, and recommendations by slice."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce
from itertools import combinations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from weftline.operators.graph import cooccurrence, node_totals, path_integral, simple_paths
from weftline.operators.mining import METRICS, rule_measures
from weftline.sources.interactions import reworked


def require_columns(df: DataFrame, names: list[str]) -> None:
    missing = [c for c in names if c not in df.columns]
    if missing:
        raise ValueError(f"Missing columns: {missing}")


def require_disjoint(**roles: str | list[str] | None) -> None:
    """Each column may have one role only."""
    seen: dict[str, str] = {}
    for role, names in roles.items():
        for c in [names] if isinstance(names, str) else names or []:
            if c in seen:
                raise ValueError(f"column {c!r} is both {seen[c]} and {role}")
            seen[c] = role


def shown(c: str) -> Column:
    """A facet value as text; null as 'None'."""
    return F.coalesce(F.col(c).cast("string"), F.lit("None"))


def composite_key(df: DataFrame, set_col: str, facet_cols: list[str], sep: str = "|", out_col: str = "_context_key") -> DataFrame:
    """``df`` with a key of the set and its facet values."""
    require_columns(df, [set_col, *facet_cols])
    require_disjoint(set_col=set_col, facet_cols=facet_cols)
    return df.withColumn(out_col, F.concat_ws(sep, shown(set_col), *[shown(c) for c in facet_cols]))


def facet_entities(df: DataFrame, set_col: str, node_col: str, facet_cols: list[str], prefix: str = "facet", sep: str = "|", extra_cols: list[str] | None = None) -> DataFrame:
    """(set, node, extras): the rows, and for every set one row more whose node is the label of its facets.

    Where facets differ inside a set, the least label (by text) is taken, with
    the least extras of its rows. A set that is null has no such row.
    """
    extra = extra_cols or []
    require_columns(df, [set_col, node_col, *facet_cols, *extra])
    require_disjoint(set_col=set_col, node_col=node_col, facet_cols=facet_cols, extra_cols=extra)
    label = F.concat_ws(sep, *[F.concat(F.lit(f"{prefix}:{c}="), shown(c)) for c in facet_cols])
    first = df.where(F.col(set_col).isNotNull()).groupBy(set_col).agg(F.min(F.struct(label.alias("l"), *extra)).alias("x"))
    return df.select(set_col, node_col, *extra).unionByName(first.select(set_col, F.col("x.l").alias(node_col), *[F.col(f"x.{c}").alias(c) for c in extra]))


def facet_label(facet_cols: list[str]) -> Column:
    return F.concat_ws("|", *[F.concat(F.lit(f"{c}="), F.col(c).cast("string")) for c in facet_cols])


def sliced(df: DataFrame, facet_cols: list[str]) -> DataFrame:
    """``df`` with ``slice``, the label of its facet values; rows with a null facet are in no slice."""
    require_columns(df, facet_cols)
    return df.dropna(subset=facet_cols).withColumn("slice", facet_label(facet_cols))


def split_by_facet(df: DataFrame, set_col: str, node_col: str, facet_cols: str | list[str], extra_cols: list[str] | None = None, max_slices: int = 10_000) -> dict[str, DataFrame]:
    """{label: rows}: one lazy frame a combination of facet values; more than ``max_slices`` are an error (use :func:`sliced`)."""
    facets = [facet_cols] if isinstance(facet_cols, str) else facet_cols
    require_columns(df, [set_col, node_col, *facets, *(extra_cols or [])])
    require_disjoint(set_col=set_col, node_col=node_col, facet_cols=facets, extra_cols=extra_cols)
    tagged = sliced(df, facets)
    labels = [r.slice for r in tagged.select("slice").distinct().orderBy("slice").limit(max_slices + 1).collect()]
    if len(labels) > max_slices:
        raise ValueError(f"more than {max_slices} slices")
    keep = list(dict.fromkeys([set_col, node_col, *(extra_cols or [])]))
    return {x: tagged.where(F.col("slice") == x).select(*keep) for x in labels}


def _all_known(names: list[str]) -> Column:
    return reduce(lambda a, b: a & b, [F.col(c).isNotNull() for c in names])


def _popular(every: DataFrame, seeds: list[str], *_: object) -> DataFrame:
    totals = node_totals(every, ("slice",))
    sums = totals.groupBy("slice").agg(F.sum("total").alias("_n"))
    return totals.join(sums, "slice").select("slice", F.col("node_id").alias("item"), (F.col("total") / F.col("_n")).alias("total_strength"))


def _similar(every: DataFrame, seeds: list[str], scoring: str, max_depth: int, min_cooccurrence: int) -> DataFrame:
    totals = node_totals(every, ("slice",))
    a, b = totals.select("slice", F.col("node_id").alias("source"), F.col("total").alias("na")), totals.select("slice", F.col("node_id").alias("target"), F.col("total").alias("nb"))
    near = cooccurrence(every, ("slice",), min_cooccurrence).where(F.col("source").isin(seeds) & ~F.col("target").isin(seeds)).join(a, ["slice", "source"]).join(b, ["slice", "target"])
    return near.groupBy("slice", F.col("target").alias("item")).agg(F.sum(F.col("weight") / (F.col("na") + F.col("nb") - F.col("weight"))).alias("total_strength"))


def _ruled(every: DataFrame, seeds: list[str], min_support: float, min_confidence: float, metric: str) -> DataFrame:
    """Rules of one node to another mined inside each slice; the best from a seed counts."""
    n = every.groupBy("slice").agg(F.count_distinct("set_id").alias("_n"))
    kept = node_totals(every, ("slice",)).join(n, "slice").select("slice", "node_id", (F.col("total") / F.col("_n")).alias("s")).where(F.col("s") >= min_support)
    pairs = cooccurrence(every, ("slice",)).where(F.col("source").isin(seeds) & ~F.col("target").isin(seeds)).join(n, "slice").withColumn("support", F.col("weight") / F.col("_n")).where(F.col("support") >= min_support)
    met = pairs.join(kept.select("slice", F.col("node_id").alias("source"), F.col("s").alias("s_a")), ["slice", "source"]).join(kept.select("slice", F.col("node_id").alias("target"), F.col("s").alias("s_b")), ["slice", "target"])
    rules = met.withColumns(rule_measures(F.col("support"), F.col("s_a"), F.col("s_b"))).where(F.col("confidence") >= min_confidence)
    return rules.groupBy("slice", F.col("target").alias("item")).agg(F.max(metric).alias("total_strength"))


def _paths(every: DataFrame, seeds: list[str], scoring: str, max_depth: int, min_cooccurrence: int) -> DataFrame:
    by = ("slice",)
    edges = cooccurrence(every, by, min_cooccurrence)
    if scoring in ("probability", "path"):
        edges = edges.join(node_totals(every, by).withColumnRenamed("node_id", "source"), ["slice", "source"]).withColumn("score", F.col("weight") / F.col("total"))
    else:
        edges = edges.withColumn("score", F.col("weight").cast("double"))
    own = every.where(F.col("node_id").isin(seeds)).groupBy("slice", "node_id").agg(F.count(F.lit(1)).alias("mult"))
    start = own.withColumn("unit", 1.0 / F.sum("mult").over(Window.partitionBy("slice")))
    return path_integral(simple_paths(edges.select("slice", "source", "target", "score"), start, max_depth, by), scoring == "path", by).where(~F.col("item").isin(seeds))


def recommend_by_facet(
    df: DataFrame, seeds: list[str], set_col: str, node_col: str, facet_cols: str | list[str], strategy: str = "graph", n: int = 10, scoring: str = "frequency", max_depth: int = 2, min_cooccurrence: int = 1, fallback_merge: str = "union",
    extra_cols: list[str] | None = None, sort_col: str | None = None, sort_callback: Callable[[DataFrame], DataFrame] | None = None, min_support: float = 0.05, min_confidence: float = 0.1, metric: str = "lift",
) -> DataFrame:
    """(slice, recommended_item, total_strength, level): a ranking inside each facet slice, and 'global'.

    ``strategy`` is 'graph' (or 'auto'): paths from the seeds; 'cf': Jaccard
    similarities to the seeds, added; 'popular': shares of the slice's rows;
    'rules': the best ``metric`` of rules from a seed, of ``min_support`` and
    ``min_confidence`` inside the slice.

    ``sort_callback`` may rework the rows, as it does in loading, where they have
    the columns set_id, node_id, the facets, ``extra_cols`` and, for ``sort_col``,
    sort_column; no strategy here reads a time.

    All slices run at once: rows are spread to every coarser slice (a subset of
    the facets kept), edges and paths carry the slice. A slice without results
    takes those of the fewest facets dropped; several at that level are merged
    by 'union' (sums), 'best' (highest sum) or 'first' (facets kept in their
    order). Repeated rows count in the finest slices only. Rows without set or
    node are left out; a null facet value belongs to the coarser slices alone.
    """
    facets = [facet_cols] if isinstance(facet_cols, str) else facet_cols
    extra = [c for c in dict.fromkeys([*(extra_cols or []), *([sort_col] if sort_col else [])]) if c not in facets]
    require_columns(df, [set_col, node_col, *facets, *extra])
    if fallback_merge not in ("union", "best", "first"):
        raise ValueError(f"Unknown merge strategy={fallback_merge!r}")
    if strategy not in ("graph", "auto", "cf", "popular", "rules"):
        raise ValueError(f"Unknown strategy: {strategy}")
    if strategy == "rules" and metric not in METRICS:
        raise ValueError(f"metric must be one of {METRICS}")
    rows = df.select(F.col(set_col).cast("string").alias("set_id"), F.col(node_col).cast("string").alias("node_id"), *[F.col(c).cast("string").alias(c) for c in facets], *[F.col(c).alias("sort_column" if c == sort_col else c) for c in extra if c not in (set_col, node_col)])
    rows = reworked(rows, sort_callback).dropna(subset=["set_id", "node_id"])
    slices = [F.when(_all_known(facets), facet_label(facets))]
    kept_of: list[tuple[int, int, list[str]]] = []
    for drop in range(1, len(facets) + 1):
        for order, keep in enumerate(combinations(facets, len(facets) - drop)):
            kept_of.append((drop, order, list(keep)))
            slices.append(F.when(_all_known(list(keep)), F.concat(F.lit("~"), facet_label(list(keep)))) if keep else F.lit("~"))
    spread = rows.select("set_id", "node_id", F.explode(F.array_compact(F.array(*slices))).alias("slice"))
    every = spread.where(~F.col("slice").startswith("~")).unionByName(spread.where(F.col("slice").startswith("~")).distinct())
    if strategy == "rules":
        found = _ruled(every, seeds, min_support, min_confidence, metric)
    else:
        found = {"cf": _similar, "popular": _popular}.get(strategy, _paths)(every, seeds, scoring, max_depth, min_cooccurrence)
    best = Window.partitionBy("slice").orderBy(F.round("total_strength", 9).desc(), "item")
    top = found.select("slice", "item", "total_strength", F.row_number().over(best).alias("k")).where(F.col("k") <= n)
    names = rows.dropna(subset=facets).select(*facets).distinct()
    options = names.select(facet_label(facets).alias("slice"), F.explode(F.array(F.struct(F.lit(0).alias("level"), F.lit(0).alias("order"), facet_label(facets).alias("from")), *[F.struct(F.lit(d).alias("level"), F.lit(o).alias("order"), F.concat(F.lit("~"), facet_label(k) if k else F.lit("")).alias("from")) for d, o, k in kept_of])).alias("o")).select("slice", "o.*")
    options = options.unionByName(options.sparkSession.createDataFrame([("global", 0, 0, "~")], "slice string, level int, order int, from string"))
    met = options.join(top.withColumnRenamed("slice", "from"), "from")
    near = Window.partitionBy("slice")
    met = met.withColumn("_least", F.min("level").over(near)).where(F.col("level") == F.col("_least"))
    if fallback_merge == "first":
        met = met.withColumn("_o", F.min("order").over(near)).where(F.col("order") == F.col("_o"))
    elif fallback_merge == "best":
        sums = met.groupBy("slice", "order").agg(F.sum("total_strength").alias("s"))
        won = sums.groupBy("slice").agg(F.max_by("order", F.struct("s", -F.col("order"))).alias("order"))
        met = met.join(won, ["slice", "order"])
    merged = met.groupBy("slice", "item").agg(F.sum("total_strength").alias("total_strength"), F.min("level").alias("level"))
    again = Window.partitionBy("slice").orderBy(F.round("total_strength", 9).desc(), "item")
    return merged.withColumn("_k", F.row_number().over(again)).where(F.col("_k") <= n).select("slice", F.col("item").alias("recommended_item"), "total_strength", "level")

"""Co-occurrence edges and the path integral over them.

Counts are of rows, not of distinct sets: a node that a set holds m times pairs
m times. Rows are first counted by (set, node), so the self-join works on
distinct nodes of a set, and each unordered pair is joined once and mirrored. A
set too large for one task is split by the adaptive skew join, which cuts its
partition by the tasks that wrote it.
"""

from __future__ import annotations

from dataclasses import dataclass, replace

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from weftline.plans.shared import cut

PRIOR_VOCABULARY = 100
PATH_ARROW = " -> "


def incidence(df: DataFrame, by: tuple[str, ...] = (), distinct: bool = False) -> DataFrame:
    """(by.., set_id, node_id, m): rows of each node in each set; 1 if only distinct sets count."""
    m = F.lit(1).cast("long") if distinct else F.count(F.lit(1))
    kept = df.where(F.col("set_id").isNotNull() & F.col("node_id").isNotNull())
    return kept.select(*by, "set_id", "node_id").distinct().withColumn("m", m) if distinct else kept.groupBy(*by, "set_id", "node_id").agg(m.alias("m"))


def pair_counts(items: DataFrame, by: tuple[str, ...] = (), weight: Column | None = None) -> DataFrame:
    """(by.., source, target, weight) with source < target, from :func:`incidence`."""
    keys = [*by, "set_id"]
    a = items.select(*keys, F.col("node_id").alias("source"), F.col("m").alias("ma"))
    b = items.select(*keys, F.col("node_id").alias("target"), F.col("m").alias("mb"))
    met = a.join(b, keys).where(F.col("source") < F.col("target"))
    return met.groupBy(*by, "source", "target").agg(F.sum(weight if weight is not None else F.col("ma") * F.col("mb")).alias("weight"))


def mirrored(pairs: DataFrame) -> DataFrame:
    """Both directions of each pair."""
    swapped = {"source": "target", "target": "source"}
    return pairs.unionByName(pairs.select(*[F.col(c).alias(swapped.get(c, c)) for c in pairs.columns]))


def cooccurrence(df: DataFrame, by: tuple[str, ...] = (), min_count: int = 1, directed: bool = True, distinct: bool = False) -> DataFrame:
    """(by.., source, target, weight): pairs of nodes of a set with at least ``min_count`` row pairs."""
    pairs = pair_counts(incidence(df, by, distinct), by).where(F.col("weight") >= min_count)
    return mirrored(pairs) if directed else pairs


def node_totals(df: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    """(by.., node_id, total): rows of each node."""
    return df.groupBy(*by, "node_id").agg(F.count(F.lit(1)).alias("total"))


def seed_rows(df: DataFrame, seeds: list[str]) -> DataFrame:
    """(node_id, unit, mult): each seed once, with its rows as multiplicity and 1 / (rows of all seeds) as unit strength."""
    own = df.where(F.col("node_id").isin(seeds)).groupBy("node_id").agg(F.count(F.lit(1)).alias("mult"))
    every = df.where(F.col("node_id").isin(seeds)).agg(F.count(F.lit(1)).alias("_n"))
    return own.crossJoin(F.broadcast(every)).select("node_id", (F.lit(1.0) / F.col("_n")).alias("unit"), "mult")


def simple_paths(edges: DataFrame, seeds: DataFrame, depth: int, by: tuple[str, ...] = ()) -> DataFrame:
    """(by.., item, strength, mult, depth, path): every simple path of 1 to ``depth`` steps from the seeds.

    ``edges`` has (by.., source, target, score); for more than one step they are
    written once, not worked out at every step. The loop only builds the plan.
    Paths grow as the mean degree to the power of the depth, so edges should be
    cut by weight first.
    """
    if depth > 1:
        edges = cut(edges, "edges")
    front = seeds.select(*by, F.col("node_id").alias("item"), F.col("unit").alias("strength"), "mult", F.array("node_id").alias("path"))
    steps = []
    for d in range(1, depth + 1):
        on = [F.col(f"f.{b}") == F.col(f"e.{b}") for b in by] + [F.col("f.item") == F.col("e.source")]
        met = front.alias("f").join(edges.alias("e"), on).where(~F.array_contains("f.path", F.col("e.target")))
        front = met.select(*[F.col(f"f.{b}").alias(b) for b in by], F.col("e.target").alias("item"), (F.col("f.strength") * F.col("e.score")).alias("strength"), "f.mult", F.array_append("f.path", F.col("e.target")).alias("path"))
        steps.append(front.withColumn("depth", F.lit(d)))
    out = steps[0]
    for s in steps[1:]:
        out = out.unionByName(s)
    return out


def path_integral(paths: DataFrame, best: bool = False, by: tuple[str, ...] = ()) -> DataFrame:
    """(by.., item, total_strength, min_hops, reason, best_depth): sums (or the best) of path strengths; of equally strong paths the first by text."""
    text = F.array_join("path", PATH_ARROW)
    rank = F.struct(-F.round("strength", 12), text)
    total = F.max("strength") if best else F.sum(F.col("strength") * F.col("mult"))
    return paths.groupBy(*by, "item").agg(total.alias("total_strength"), F.min("depth").alias("min_hops"), F.min_by(text, rank).alias("reason"), F.min_by("depth", rank).alias("best_depth"))


def best_rows(df: DataFrame, score: str, item: str, n: int | None) -> DataFrame:
    """The n rows of highest score, all with None; scores equal to nine decimals go by item."""
    ordered = df.orderBy(F.round(score, 9).desc(), item)
    return ordered if n is None else ordered.limit(n)


@dataclass(frozen=True)
class GraphModel:
    """Edges and node totals of an interaction relation; nothing is shared between models."""

    interactions: DataFrame
    min_cooccurrence: int = 1
    alpha: float = 0.0
    prior_vocabulary: int = PRIOR_VOCABULARY
    stored_edges: DataFrame | None = None
    stored_totals: DataFrame | None = None

    @property
    def edges(self) -> DataFrame:
        return cooccurrence(self.interactions, min_count=self.min_cooccurrence) if self.stored_edges is None else self.stored_edges

    @property
    def totals(self) -> DataFrame:
        return node_totals(self.interactions) if self.stored_totals is None else self.stored_totals

    def build(self) -> GraphModel:
        """The same with its edges and totals written once; edges are laid out by source, as lookups and paths read them."""
        edges = cut(self.edges.repartitionByRange("source", "target").sortWithinPartitions("source", "target"), "edges")
        return replace(self, stored_edges=edges, stored_totals=cut(self.totals, "totals"))

    def scored(self, scoring: str = "frequency", min_weight: float = 1) -> DataFrame:
        """(source, target, weight, score): weight itself, or (weight + alpha) / (total + alpha * vocabulary) for 'probability' and 'path'."""
        edges = self.edges.where(F.col("weight") >= min_weight)
        if scoring not in ("probability", "path"):
            return edges.withColumn("score", F.col("weight").cast("double"))
        score = (F.col("weight") + F.lit(float(self.alpha))) / (F.col("total") + F.lit(float(self.alpha) * self.prior_vocabulary))
        return edges.join(self.totals, F.col("source") == F.col("node_id")).select("source", "target", "weight", score.alias("score"))

    def adjacency(self) -> DataFrame:
        """(source, neighbors, weights), neighbours in order of their names."""
        packed = self.edges.groupBy("source").agg(F.array_sort(F.collect_list(F.struct("target", "weight"))).alias("x"))
        return packed.select("source", F.col("x.target").alias("neighbors"), F.col("x.weight").alias("weights"))

    def neighbors(self, item: str) -> DataFrame:
        return self.edges.where(F.col("source") == item).select(F.col("target").alias("neighbor"), "weight")

    def recommend(self, seeds: list[str], max_depth: int = 2, min_weight: float = 1, n: int = 10, exclude_seed: bool = True, scoring: str = "frequency") -> DataFrame:
        """(recommended_item, total_strength, min_hops, reason); empty for no seeds or unknown ones."""
        found = path_integral(simple_paths(self.scored(scoring, min_weight), seed_rows(self.interactions, seeds), max_depth), scoring == "path")
        found = found.where(~F.col("item").isin(seeds)) if exclude_seed else found
        return best_rows(found.select(F.col("item").alias("recommended_item"), "total_strength", "min_hops", "reason"), "total_strength", "recommended_item", n)

    def score_basket(self, items: list[str]) -> DataFrame:
        """(score): strength of the paths from the first item to the others; 1 for an empty basket."""
        spark = self.interactions.sparkSession
        if not items:
            return spark.createDataFrame([(1.0,)], "score double")
        found = path_integral(simple_paths(self.scored("probability"), seed_rows(self.interactions, items[:1]), len(items) + 1))
        return found.where(F.col("item").isin(items[1:])).agg(F.coalesce(F.sum("total_strength"), F.lit(0.0)).alias("score"))

    def rank_nodes(self, seeds: list[str], steps: int = 2, scoring: str = "probability", limit: int = 10) -> DataFrame:
        """(node, score, steps, reason): the same ranking under the names of the graph view."""
        return self.recommend(seeds, steps, n=limit, scoring=scoring).withColumnsRenamed({"recommended_item": "node", "total_strength": "score", "min_hops": "steps"})

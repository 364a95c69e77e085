"""Item-to-item similarity, popularity and merging of recommendation tables."""

from __future__ import annotations

from dataclasses import dataclass, replace
from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from weftline.functions import jaccard, lift
from weftline.operators.graph import best_rows, cooccurrence, node_totals
from weftline.plans.shared import cut


@dataclass(frozen=True)
class ItemSimilarity:
    """Item-to-item similarities from co-occurrence: jaccard, cosine or lift over row counts."""

    interactions: DataFrame
    metric: str = "jaccard"
    min_cooccurrence: int = 1
    top_k_similar: int = 50
    stored: DataFrame | None = None

    def __post_init__(self):
        if self.metric not in ("jaccard", "cosine", "lift"):
            raise ValueError(f"Unknown metric: {self.metric}")

    @property
    def table(self) -> DataFrame:
        """(item_a, item_b, score): the most similar items of each item; scores equal to nine decimals go by name."""
        if self.stored is not None:
            return self.stored
        pairs = cooccurrence(self.interactions, min_count=self.min_cooccurrence)
        totals = node_totals(self.interactions)
        joined = pairs.join(totals.select(F.col("node_id").alias("source"), F.col("total").alias("a")), "source").join(totals.select(F.col("node_id").alias("target"), F.col("total").alias("b")), "target")
        c, a, b = F.col("weight"), F.col("a"), F.col("b")
        if self.metric == "lift":
            joined = joined.crossJoin(F.broadcast(self.interactions.agg(F.count_distinct("set_id").alias("_n"))))
        score = {"jaccard": lambda: jaccard(c, a, b), "cosine": lambda: c / (F.sqrt(a) * F.sqrt(b)), "lift": lambda: lift(c, a, b, F.col("_n"))}[self.metric]()
        scored = joined.select(F.col("source").alias("item_a"), F.col("target").alias("item_b"), score.alias("score"))
        best = Window.partitionBy("item_a").orderBy(F.round("score", 9).desc(), "item_b")
        return scored.withColumn("_k", F.row_number().over(best)).where(F.col("_k") <= self.top_k_similar).drop("_k")

    def fit(self) -> ItemSimilarity:
        """The same with its table written once."""
        return replace(self, stored=cut(self.table, "similarity"))

    def similar(self, item: str, n: int = 10) -> DataFrame:
        return best_rows(self.table.where(F.col("item_a") == item).select(F.col("item_b").alias("item_id"), "score"), "score", "item_id", n)

    def recommend(self, seeds: list[str], n: int = 10, exclude_seed: bool = True) -> DataFrame:
        """(item_id, score): similarities to the seeds, added up."""
        near = self.table.where(F.col("item_a").isin(seeds))
        near = near.where(~F.col("item_b").isin(seeds)) if exclude_seed else near
        return best_rows(near.groupBy(F.col("item_b").alias("item_id")).agg(F.sum("score").alias("score")), "score", "item_id", n)


def popularity(df: DataFrame, strategy: str = "global", timestamp_col: str | None = None, window_days: int = 30) -> DataFrame:
    """(node_id, score): each node's share of all rows, or of those within ``window_days`` of the latest."""
    if strategy not in ("global", "trending"):
        raise ValueError(f"Unknown strategy: {strategy}")
    if strategy == "trending":
        timestamp_col = timestamp_col or ("sort_column" if "sort_column" in df.columns else None)
        if not timestamp_col:
            raise ValueError("timestamp_col required for trending strategy.")
        latest = df.agg(F.max(timestamp_col).alias("_latest"))
        df = df.crossJoin(F.broadcast(latest)).where(F.col(timestamp_col) >= F.col("_latest") - F.expr(f"interval {int(window_days)} days"))
    every = df.agg(F.count(F.lit(1)).alias("_n"))
    return node_totals(df).crossJoin(F.broadcast(every)).select("node_id", (F.col("total") / F.col("_n")).alias("score"))


def recommend_popular(scores: DataFrame, n: int = 10, exclude: list[str] | None = None) -> DataFrame:
    """(item_id, score, rank): ranked after the exclusion, equal scores sharing a rank.

    The first n rows are taken before they are ranked: no row of the first n has
    a better one outside them, so the window runs over n rows.
    """
    left = scores.where(~F.col("node_id").isin(exclude)) if exclude else scores
    first = best_rows(left.select(F.col("node_id").alias("item_id"), "score"), "score", "item_id", n)
    return first.withColumn("rank", F.rank().over(Window.orderBy(F.round("score", 9).desc())).cast("long"))


def merge_tables(tables: list[DataFrame], strategy: str = "union", n: int = 10, score_col: str | None = None, item_col: str = "recommended_item") -> DataFrame:
    """One table from several: 'union' adds scores, 'best' takes the table of the highest sum, 'first' the first."""
    if not tables:
        raise ValueError("tables must not be empty")
    if strategy not in ("union", "best", "first"):
        raise ValueError(f"Unknown merge strategy={strategy!r}")
    if score_col is None:
        score_col = next((c for c, t in tables[0].dtypes if c != item_col and t in ("double", "float", "bigint", "int")), None)
    if len(tables) == 1 or strategy == "first":
        return tables[0].orderBy(F.desc(score_col), item_col).limit(n) if score_col else tables[0].limit(n)
    if strategy == "best":
        tagged = reduce(DataFrame.unionByName, [t.withColumn("_table", F.lit(i)) for i, t in enumerate(tables)])
        sums = tagged.groupBy("_table").agg(F.sum(score_col).alias("_s") if score_col else F.count(F.lit(1)).alias("_s")).orderBy(F.desc("_s"), "_table").limit(1)
        won = tagged.join(F.broadcast(sums.select("_table")), "_table").drop("_table")
        return won.orderBy(F.desc(score_col), item_col).limit(n) if score_col else won.limit(n)
    if score_col:
        both = reduce(DataFrame.unionByName, [t.select(item_col, score_col) for t in tables])
        return best_rows(both.groupBy(item_col).agg(F.sum(score_col).alias(score_col)), score_col, item_col, n)
    return reduce(DataFrame.unionByName, [t.select(item_col) for t in tables]).distinct().orderBy(item_col).limit(n)

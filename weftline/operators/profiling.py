"""Clusters of rules and of items by their rule metrics."""

from __future__ import annotations

import warnings
from dataclasses import dataclass, field

from pyspark.ml.clustering import KMeans
from pyspark.ml.evaluation import ClusteringEvaluator
from pyspark.ml.feature import StandardScaler, VectorAssembler
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from weftline.operators.mining import METRICS, recommend_by_rules

CAP = 1e6


def bounded(c: str) -> Column:
    """A metric between -1e6 and 1e6; null, NaN and infinities become 1e6."""
    x = F.col(c).cast("double")
    return F.when(x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")), F.lit(CAP)).otherwise(F.greatest(F.least(x, F.lit(CAP)), F.lit(-CAP)))


def item_features(rules: DataFrame) -> DataFrame:
    """(item, <metric>_mean, <metric>_max, rule_count) by consequent."""
    aggs = [f(bounded(m)).alias(f"{m}_{n}") for m in METRICS for n, f in (("mean", F.avg), ("max", F.max))]
    return rules.groupBy(F.col("consequents").alias("item")).agg(*aggs, F.count(F.lit(1)).alias("rule_count"))


@dataclass
class Profile:
    """Rows with their cluster, and the description of each cluster (as many as clusters)."""

    table: DataFrame
    clusters: list[dict]
    key: str
    labels: dict[int, str] = field(default_factory=dict)
    rules: DataFrame | None = None
    features: list[str] = field(default_factory=list)

    def label(self, names: dict[int, str]) -> Profile:
        unknown = sorted(set(names) - {c["cluster_id"] for c in self.clusters})
        if unknown:
            warnings.warn(f"unknown clusters: {unknown}", stacklevel=2)
        self.labels.update({i: x for i, x in names.items() if i not in unknown})
        return self

    def summary(self) -> DataFrame:
        """(cluster_id, label, dominant_metric, size, centroid by feature), and of items also ``members``, the sorted items."""
        names = self.features
        rows = [(c["cluster_id"], self.labels.get(c["cluster_id"], ""), c["dominant_metric"], c["size"], *(float(c["centroid"][f]) for f in names)) for c in self.clusters]
        out = self.table.sparkSession.createDataFrame(rows, "cluster_id int, label string, dominant_metric string, size long, " + ", ".join(f"`{f}` double" for f in names))
        if self.key != "item":
            return out
        return out.join(self.table.groupBy("cluster_id").agg(F.array_sort(F.collect_list("item")).alias("members")), "cluster_id")

    def cluster_of(self, item: str) -> dict | None:
        """The description of the cluster that an item is in; None for an unknown item, or one in rules of several clusters."""
        found = self.table.where(F.col(self.key) == item).select("cluster_id").distinct().limit(2).collect()
        return next(c for c in self.clusters if c["cluster_id"] == found[0].cluster_id) if len(found) == 1 else None

    def rules_table(self) -> DataFrame:
        """The rows with their cluster and its dominant metric."""
        return self.table

    def recommend(self, seeds: list[str], cluster: int | str | None = None, n: int = 10, rules: DataFrame | None = None) -> DataFrame:
        """(item_id, score, cluster_id, dominant_metric, rule); an item profile ranks ``rules``."""
        return recommend_by_profile(self, seeds, cluster, n) if self.key != "item" else recommend_by_archetype(self, rules if rules is not None else self.rules, seeds, cluster, n)

    def chosen(self, cluster: int | str | None) -> list[int]:
        known = [c["cluster_id"] for c in self.clusters]
        if cluster is None:
            return known
        found = [i for i in known if i == cluster or self.labels.get(i) == cluster]
        if not found:
            raise ValueError(f"unknown cluster: {cluster!r}")
        return found


def _cluster(df: DataFrame, features: list[str], n_clusters: int | str, max_k: int, seed: int, key: str, empty: bool = False) -> Profile:
    """K-means on standardised features; 'auto' takes the k of the best silhouette. No rows are an error, or with ``empty`` a profile without clusters. The dominant metric is the one whose cluster mean is furthest from the overall mean, in deviations."""
    n = df.count()
    if not n and empty:
        return Profile(df.withColumns({"cluster_id": F.lit(0), "dominant_metric": F.lit("")}), [], key, features=features)
    if not n:
        raise ValueError("no rows to profile")
    raw = VectorAssembler(inputCols=features, outputCol="_raw").transform(df)
    scaled = StandardScaler(inputCol="_raw", outputCol="_f", withMean=True).fit(raw).transform(raw) if n > 1 else raw.withColumn("_f", F.col("_raw"))
    distinct = scaled.select(*features).distinct().limit(max_k + 1).count()
    fit = lambda k: KMeans(k=k, seed=seed, featuresCol="_f", predictionCol="cluster_id").fit(scaled)
    top = min(max_k, n - 1, distinct)
    if n_clusters == "auto":
        best, model = -2.0, None
        for k in range(2, top + 1):
            m = fit(k)
            placed = m.transform(scaled)
            if placed.select("cluster_id").distinct().count() < 2:
                continue
            score = ClusteringEvaluator(featuresCol="_f", predictionCol="cluster_id").evaluate(placed)
            if score > best:
                best, model = score, m
    else:
        k = min(int(n_clusters), n, distinct)
        model = fit(k) if k > 1 else None
    placed = (model.transform(scaled) if model else scaled.withColumn("cluster_id", F.lit(0))).drop("_raw", "_f")
    whole = placed.agg(*[F.avg(f).alias(f"m_{f}") for f in features], *[F.stddev_pop(f).alias(f"s_{f}") for f in features]).first()
    clusters = []
    for r in placed.groupBy("cluster_id").agg(F.count(F.lit(1)).alias("size"), *[F.avg(f).alias(f) for f in features]).orderBy("cluster_id").collect():
        away = {f: abs(r[f] - whole[f"m_{f}"]) / whole[f"s_{f}"] if whole[f"s_{f}"] else 0.0 for f in features}
        clusters.append({"cluster_id": r.cluster_id, "size": r["size"], "dominant_metric": max(features, key=lambda f: away[f]), "centroid": {f: round(r[f], 6) for f in features}})
    names = df.sparkSession.createDataFrame([(c["cluster_id"], c["dominant_metric"]) for c in clusters], "cluster_id int, dominant_metric string")
    return Profile(placed.join(F.broadcast(names), "cluster_id"), clusters, key, features=features)


def profile_rules(rules: DataFrame, n_clusters: int | str = "auto", max_k: int = 8, seed: int = 0, empty: bool = False) -> Profile:
    """Rules with cluster_id and dominant_metric."""
    named = [f"_{m}" for m in METRICS]
    held = rules.select("*", *[bounded(m).alias(f) for m, f in zip(METRICS, named)])
    p = _cluster(held, named, n_clusters, max_k, seed, "consequents", empty)
    p.features = METRICS
    for c in p.clusters:
        c["dominant_metric"] = c["dominant_metric"].lstrip("_")
        c["centroid"] = {k.lstrip("_"): v for k, v in c["centroid"].items()}
    p.table = p.table.drop(*named).withColumn("dominant_metric", F.ltrim("dominant_metric", F.lit("_")))
    return p


def profile_items(rules: DataFrame, n_clusters: int | str = "auto", max_k: int = 8, seed: int = 0, empty: bool = False) -> Profile:
    """Items (consequents) with their features, cluster_id and dominant_metric."""
    features = item_features(rules)
    out = _cluster(features, [c for c in features.columns if c != "item"], n_clusters, max_k, seed, "item", empty)
    out.rules = rules
    return out


def _by_dominant(names: list[str], dominant: Column | None = None) -> Column:
    """The value of the metric that the dominant one names, lift where it names none."""
    dominant = F.col("dominant_metric") if dominant is None else dominant
    out = F.col("lift")
    for m in names:
        out = F.when(dominant == m, F.col(m)).otherwise(out)
    return out


def recommend_by_profile(profile: Profile, seeds: list[str], cluster: int | str | None = None, n: int = 10) -> DataFrame:
    """(item_id, score, cluster_id, dominant_metric, rule) from a rule profile: rules of the chosen clusters, each ranked by its cluster's dominant metric; of an item's rules the best."""
    ranked = profile.table.where(F.col("cluster_id").isin(profile.chosen(cluster))).withColumn("_score", _by_dominant(METRICS))
    return recommend_by_rules(ranked, seeds, n, score="_score", keep=["cluster_id", "dominant_metric"], arrow=" → ")


def recommend_by_archetype(profile: Profile, rules: DataFrame, seeds: list[str], archetype: int | str | None = None, n: int = 10) -> DataFrame:
    """(item_id, score, cluster_id, dominant_metric, rule) from an item profile: rules whose consequent is in the chosen clusters.

    A dominant mean or maximum ranks by its metric; one that is no metric, the number of rules, by lift.
    """
    items = profile.table.where(F.col("cluster_id").isin(profile.chosen(archetype))).select(F.col("item").alias("consequents"), "cluster_id", "dominant_metric")
    ranked = rules.join(items, "consequents").withColumn("_score", _by_dominant(METRICS, F.regexp_replace("dominant_metric", "_(mean|max)$", "")))
    return recommend_by_rules(ranked, seeds, n, score="_score", keep=["cluster_id", "dominant_metric"], arrow=" → ")

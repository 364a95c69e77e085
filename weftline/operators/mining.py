"""Frequent itemsets, association rules and ordered patterns."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from weftline.operators.graph import incidence, pair_counts
from weftline.plans.shared import cut

# The measures of a rule, in the order of the rule table.
METRICS = ["support", "confidence", "lift", "leverage", "conviction", "zhang"]
SEP = "|"


def frequent_itemsets(df: DataFrame, min_support: float = 0.05, max_len: int | None = None, distinct: bool = False) -> DataFrame:
    """(itemset, support, length, items): itemsets of one and two nodes, and up to ``max_len`` if that is 3 or more.

    Support is rows (row pairs) over distinct sets, so repeated rows raise it;
    ``distinct`` counts sets instead, as do itemsets of three nodes and more.
    """
    if not 0 < min_support <= 1:
        raise ValueError("min_support must be in (0, 1]")
    known = df.where(F.col("set_id").isNotNull() & F.col("node_id").isNotNull())
    items = incidence(known, distinct=distinct)
    n = known.agg(F.count_distinct("set_id").alias("_n"))
    share = (F.col("c") / F.col("_n")).alias("support")
    singles = items.groupBy("node_id").agg(F.sum("m").alias("c")).crossJoin(F.broadcast(n)).select(F.array("node_id").alias("items"), share).where(F.col("support") >= min_support)
    levels = [singles]
    if max_len is None or max_len >= 2:
        kept = items.join(singles.select(F.col("items")[0].alias("node_id")), "node_id", "left_semi")
        pairs = pair_counts(kept).withColumnRenamed("weight", "c").crossJoin(F.broadcast(n))
        levels.append(pairs.select(F.array("source", "target").alias("items"), share).where(F.col("support") >= min_support))
    held = None
    for _ in range(3, (max_len or 2) + 1):
        held = _held_pairs(kept, levels[1]) if held is None else held.join(levels[-1].select("items"), "items", "left_semi")
        held = _grow(items, held, levels[1])
        counted = held.groupBy("items").agg(F.count(F.lit(1)).alias("c")).crossJoin(F.broadcast(n))
        levels.append(counted.select("items", share).where(F.col("support") >= min_support))
    out = levels[0]
    for level in levels[1:]:
        out = out.unionByName(level)
    return out.select(F.array_join("items", SEP).alias("itemset"), "support", F.size("items").alias("length"), "items")


def _held_pairs(items: DataFrame, pairs: DataFrame) -> DataFrame:
    """(set_id, items): the frequent pairs that each set holds."""
    a, b = items.select("set_id", F.col("node_id").alias("x")), items.select("set_id", F.col("node_id").alias("y"))
    return a.join(b, "set_id").where("x < y").select("set_id", F.array("x", "y").alias("items")).join(pairs.select("items"), "items", "left_semi")


def _grow(items: DataFrame, held: DataFrame, pairs: DataFrame) -> DataFrame:
    """(set_id, items) one longer: what a set holds, with a later node of it that is a frequent pair with the last one."""
    step = pairs.select(F.col("items")[0].alias("_end"), F.col("items")[1].alias("node_id"))
    ends = held.withColumn("_end", F.element_at("items", -1)).join(items.select("set_id", "node_id"), "set_id").where("node_id > _end")
    return ends.join(step, ["_end", "node_id"], "left_semi").select("set_id", F.array_append("items", F.col("node_id")).alias("items"))


def association_rules(itemsets: DataFrame, min_confidence: float = 0.1, min_lift: float = 0.0, max_antecedent_len: int | None = None) -> DataFrame:
    """(antecedents, consequents, support, confidence, lift, leverage, conviction, zhang, antecedent_items) from itemsets with their ``items``.

    Every proper part of an itemset is tried as antecedent, by equi-joins on the
    parts. Itemsets are looked at three times, so they are written once.
    """
    if not 0 < min_confidence <= 1:
        raise ValueError("min_confidence must be in (0, 1]")
    if min_lift < 0:
        raise ValueError("min_lift must be non-negative")
    itemsets = cut(itemsets.select("items", "support", "length"), "itemsets")
    masks = F.expr("sequence(1L, shiftleft(1L, size(items)) - 2)")
    part = F.expr("filter(items, (x, i) -> (shiftright(mask, i) & 1) = 1)")
    whole = itemsets.where(F.col("length") > 1).select("items", F.col("support").alias("s_ab")).withColumn("mask", F.explode(masks))
    parts = whole.withColumn("ants", part).withColumn("cons", F.array_except("items", "ants"))
    if max_antecedent_len is not None:
        parts = parts.where(F.size("ants") <= max_antecedent_len)
    known = itemsets.select("items", "support")
    joined = parts.join(known.select(F.col("items").alias("ants"), F.col("support").alias("s_a")), "ants").join(known.select(F.col("items").alias("cons"), F.col("support").alias("s_b")), "cons")
    measures = rule_measures(F.col("s_ab"), F.col("s_a"), F.col("s_b"))
    out = joined.select(F.array_join("ants", SEP).alias("antecedents"), F.array_join("cons", SEP).alias("consequents"), *[x.alias(m) for m, x in measures.items()], F.col("ants").alias("antecedent_items"))
    return out.where((F.col("confidence") >= min_confidence) & (F.col("lift") >= min_lift))


def rule_measures(s_ab: Column, s_a: Column, s_b: Column) -> dict[str, Column]:
    """The measures by name, from the supports of a rule and of its two sides."""
    conf = s_ab / s_a
    bound = F.greatest(conf * (1 - s_b), s_b * (1 - conf))
    zhang = F.when(bound > 0, (conf - s_b) / bound).otherwise(F.lit(0.0))
    return dict(zip(METRICS, (s_ab, conf, conf / s_b, s_ab - s_a * s_b, (1 - s_b) / (1 - conf + F.lit(1e-9)), zhang)))


def by_lift(rules: DataFrame) -> DataFrame:
    return rules.orderBy(F.desc("lift"), "antecedents", "consequents")


def recommend_by_rules(rules: DataFrame, seeds: list[str], n: int = 10, metric: str | None = "lift", score: str | None = None, keep: list[str] | None = None, arrow: str = " -> ") -> DataFrame:
    """(item_id, score, kept columns, rule): the best rule for each consequent among those whose antecedents are all seeds.

    Antecedents are read from ``antecedent_items``; only where a table of rules
    lacks them, as one stored as text does, is their text split at '|'.
    """
    if score is None and metric not in METRICS:
        raise ValueError(f"metric must be one of {METRICS}")
    wanted = F.array(*[F.lit(s) for s in seeds]) if seeds else F.array().cast("array<string>")
    own = F.col("antecedent_items") if "antecedent_items" in rules.columns else F.split("antecedents", r"\|")
    match = (F.size(F.array_except(own, wanted)) == 0) & ~F.col("consequents").isin(seeds)
    value = F.col(score or metric)
    rule = F.concat_ws(arrow, "antecedents", "consequents")
    best = Window.partitionBy("consequents").orderBy(F.round(value, 9).desc(), rule)
    ranked = rules.where(match).withColumn("_k", F.row_number().over(best)).where("_k = 1")
    return ranked.select(F.col("consequents").alias("item_id"), value.alias("score"), *(keep or []), rule.alias("rule")).orderBy(F.round("score", 9).desc(), "item_id").limit(n)


def sequential_patterns(df: DataFrame, timestamp_col: str = "event_time", min_support: float = 0.05, max_gap: int | None = None) -> DataFrame:
    """(prefix, suffix, pattern, count, support): pairs that distinct sets hold at strictly rising times, at most ``max_gap`` rows between.

    Without a gap only the first time of the prefix and the last of the suffix
    matter, so rows are reduced to those before they meet. With a gap rows are
    numbered by time and node, and each looks ahead ``max_gap + 1`` rows.
    """
    if timestamp_col not in df.columns:
        if "sort_column" not in df.columns:
            raise ValueError(f"Column '{timestamp_col}' not found.")
        timestamp_col = "sort_column"
    n = df.agg(F.count_distinct("set_id").alias("_n"))
    if max_gap is None:
        ends = df.where(F.col(timestamp_col).isNotNull()).groupBy("set_id", "node_id").agg(F.min(timestamp_col).alias("first"), F.max(timestamp_col).alias("last"))
        a, b = ends.select("set_id", F.col("node_id").alias("prefix"), "first"), ends.select("set_id", F.col("node_id").alias("suffix"), "last")
        met = a.join(b, "set_id").where(F.col("first") < F.col("last"))
        counted = met.groupBy("prefix", "suffix").agg(F.count(F.lit(1)).alias("count"))
    else:
        order = Window.partitionBy("set_id").orderBy(F.col(timestamp_col).asc_nulls_last(), "node_id")
        ahead = F.array(*[F.struct(F.lead("node_id", k).over(order).alias("node"), F.lead(timestamp_col, k).over(order).alias("t")) for k in range(1, max_gap + 2)])
        met = df.withColumn("_ahead", ahead).select("set_id", F.col("node_id").alias("prefix"), F.col(timestamp_col).alias("t0"), F.explode("_ahead").alias("x")).where(F.col("t0") < F.col("x.t"))
        counted = met.groupBy("prefix", F.col("x.node").alias("suffix")).agg(F.count_distinct("set_id").alias("count"))
    shared = counted.crossJoin(F.broadcast(n)).withColumn("support", F.col("count") / F.col("_n")).where(F.col("support") >= min_support)
    return shared.select("prefix", "suffix", F.concat_ws(" -> ", "prefix", "suffix").alias("pattern"), "count", "support")

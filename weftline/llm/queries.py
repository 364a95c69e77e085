"""Queries of the operators in this package, each over the whole of its tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weftline.llm.abuse import FLAG_FROM, learn_wording, rates, score_texts
from weftline.llm.borda import borda_ranking, head_on_all
from weftline.llm.clusters import describe_clusters, grid_clusters, log_feature
from weftline.llm.encoding import count_tokens, encode_texts
from weftline.llm.heavy_items import frequent_items
from weftline.llm.packing import check_packing, pack_documents, packing_summary
from weftline.llm.pairs import co_occurring_pairs
from weftline.llm.sequences import frequent_subsequences
from weftline.llm.top_n import top_per_group
from weftline.plans.shared import cut

BORDA_MEASURES = ["lift", "conviction", "zhang", "leverage"]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def p1_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return co_occurring_pairs(table(spark, sf_dir, "interactions"), min_count=8, min_share=0.0015, min_lift=2.5)


def p1_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return p1_pairs(spark, sf_dir).select("node_a", "node_b")


def _rule_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    features = {"confidence": F.col("confidence"), "support": log_feature(F.col("support")), "lift": log_feature(F.col("lift")), "conviction": log_feature(F.col("conviction"), 1e6)}
    return grid_clusters(table(spark, sf_dir, "rules"), "rule_id", features, width=0.1)


def p2_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    members = _rule_clusters(spark, sf_dir).select("id", "cluster")
    large = members.groupBy("cluster").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= 5).select("cluster")
    return members.join(large, "cluster").where(F.col("id") != F.col("cluster")).select(F.col("cluster").alias("first_rule_id"), F.col("id").alias("rule_id"))


def p2_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    described = describe_clusters(_rule_clusters(spark, sf_dir), n_typical=3, min_size=5)
    return described.select(F.col("cluster").alias("first_rule_id"), "n_records", "n_cells", "densest_cell_size", F.array_join(F.col("typical").cast("array<string>"), "|").alias("typical_rule_ids"))


def p3_sequences(spark: SparkSession, sf_dir: str) -> DataFrame:
    return frequent_subsequences(table(spark, sf_dir, "interactions"), min_count=8, min_share=0.01, length=3)


def p3_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return p3_sequences(spark, sf_dir).select("step_1", "step_2", "step_3")


def p4_frequent(spark: SparkSession, sf_dir: str) -> DataFrame:
    return frequent_items(table(spark, sf_dir, "interactions"), "node_id", share=0.005).select(F.col("item").alias("node_id"), "n_rows")


def p4_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return p4_frequent(spark, sf_dir).select("node_id")


def p5_top(spark: SparkSession, sf_dir: str) -> DataFrame:
    best = top_per_group(table(spark, sf_dir, "item_similarity"), "item_a", "item_b", "score", n=5)
    return best.select(F.col("group_key").alias("item_a"), F.col("item").alias("item_b"), "score", "rank")


def p5_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return p5_top(spark, sf_dir).select("item_a", "item_b")


def _ranked_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return borda_ranking(table(spark, sf_dir, "rules"), "rule_id", dict.fromkeys(BORDA_MEASURES, 1.0))


def p6_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rules in the order of the ranking, those that the exact test of every measure keeps."""
    ranked = _ranked_rules(spark, sf_dir).where(F.col("n_missing") == 0)
    head = head_on_all(table(spark, sf_dir, "rules"), "rule_id", BORDA_MEASURES, share=0.1)
    return ranked.join(head.select("id"), "id", "left_semi").orderBy("position").select(F.col("id").alias("rule_id"))


def p6_ranking(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _ranked_rules(spark, sf_dir).select(F.col("id").alias("rule_id"), F.round("points", 9).alias("points"), "n_missing", "position")


def p8_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encode_texts(table(spark, sf_dir, "documents"))


def p9_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack_documents(count_tokens(table(spark, sf_dir, "documents")), table(spark, sf_dir, "containers"))


def p9_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing_summary(cut(p9_packing(spark, sf_dir), "packing"), table(spark, sf_dir, "containers"))


def p9_whole(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What must hold of any packing: every document is placed once, no container is overfull, none is split without need, no token is lost."""
    sizes = cut(count_tokens(table(spark, sf_dir, "documents")), "sizes")
    containers = table(spark, sf_dir, "containers")
    return check_packing(cut(pack_documents(sizes, containers), "packing"), sizes, containers)


def _abuse_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents, terms = table(spark, sf_dir, "documents"), table(spark, sf_dir, "flag_terms")
    wording = learn_wording(documents, table(spark, sf_dir, "labels"), group_col="page_id", terms=terms)
    return score_texts(documents, ["doc_id", "source"], terms=terms, wording=wording)


def p10_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _abuse_scores(spark, sf_dir).where(F.col("score") >= FLAG_FROM).select("doc_id")


def p10_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _abuse_scores(spark, sf_dir).select("doc_id", "score", "category")


def p10_rates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rates(_abuse_scores(spark, sf_dir), "source")


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "p1_found": p1_found,
        "p1_pairs": p1_pairs,
        "p2_found": p2_found,
        "p2_clusters": p2_clusters,
        "p3_found": p3_found,
        "p3_sequences": p3_sequences,
        "p4_found": p4_found,
        "p4_frequent": p4_frequent,
        "p5_found": p5_found,
        "p5_top": p5_top,
        "p6_found": p6_found,
        "p6_ranking": p6_ranking,
        "p8_ids": p8_ids,
        "p9_packing": p9_packing,
        "p9_summary": p9_summary,
        "p9_whole": p9_whole,
        "p10_found": p10_found,
        "p10_scores": p10_scores,
        "p10_rates": p10_rates,
    }

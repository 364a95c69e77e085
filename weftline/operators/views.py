"""Interaction views over the test tables: the same relation for Spark and for SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def basket_brand(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders and the brands of their parts."""
    lines = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_partkey", "l_shipdate")
    parts = table(spark, sf_dir, "part").select("p_partkey", "p_brand")
    return lines.join(parts, F.col("l_partkey") == F.col("p_partkey")).select(F.col("l_orderkey").cast("string").alias("set_id"), F.col("p_brand").alias("node_id"), F.col("l_shipdate").alias("sort_column"))


def basket_part(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders and their parts."""
    return table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").cast("string").alias("set_id"), F.col("l_partkey").cast("string").alias("node_id"), F.col("l_shipdate").alias("sort_column"))


def event_session(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Days of users and the kinds of their events."""
    node = F.concat_ws("_", "event_type", (F.get_json_object("props", "$.k").cast("int") % 10).cast("string"))
    return table(spark, sf_dir, "events").select(F.concat_ws("|", F.col("user_id").cast("string"), F.date_format("ts", "yyyy-MM-dd")).alias("set_id"), node.alias("node_id"), F.col("ts").alias("sort_column"))


def event_type(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Days of users and the types of their events."""
    return event_session(spark, sf_dir).withColumn("node_id", F.regexp_replace("node_id", "_[0-9]+$", ""))


def basket_facet(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders with facets as delivered: (order_id, item, region, day_period)."""
    return table(spark, sf_dir, "basket_facets")


def interactions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stored relation, with its hot node, wide sets, repeated rows and ids of any letters."""
    return table(spark, sf_dir, "interactions").dropna(subset=["set_id", "node_id"]).select("set_id", "node_id", "sort_column")


SQL = {
    "interactions": "SELECT set_id, node_id, sort_column FROM interactions WHERE set_id IS NOT NULL AND node_id IS NOT NULL",
    "basket_brand": "SELECT l_orderkey::VARCHAR AS set_id, p_brand AS node_id, l_shipdate AS sort_column FROM lineitem JOIN part ON l_partkey = p_partkey",
    "basket_part": "SELECT l_orderkey::VARCHAR AS set_id, l_partkey::VARCHAR AS node_id, l_shipdate AS sort_column FROM lineitem",
    "event_session": "SELECT user_id || '|' || strftime(ts, '%Y-%m-%d') AS set_id, event_type || '_' || (json_extract_string(props, '$.k')::INTEGER % 10) AS node_id, ts AS sort_column FROM events",
    "event_type": "SELECT user_id || '|' || strftime(ts, '%Y-%m-%d') AS set_id, event_type AS node_id, ts AS sort_column FROM events",
}

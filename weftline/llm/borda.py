"""One ranking from several differently scaled scores: Borda count."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weftline.operators.skew import skew_join
from weftline.plans.ranking import global_positions, range_offsets
from weftline.plans.shared import Cut, least_count

#: Values held by more than this share of the records join by broadcast; there are at most 1 / HOT_SHARE of them a measure.
HOT_SHARE = 0.001


def measure_ranks(df: DataFrame, id_col: str, measures: list[str]) -> tuple[DataFrame, dict[str, int]]:
    """((id, measure, value, n_greater, n_equal), valid records by measure); rows only where the measure is neither null nor NaN.

    Infinity is the greatest value. Equal values are counted before anything is
    sorted, so a value that a third of the records share is one row; positions
    come from range partitions and their totals, never from one task's window.
    """
    structs = [F.struct(F.lit(m).alias("measure"), (F.col(m).cast("double") + F.lit(0.0)).alias("value")) for m in measures]
    long = df.select(F.col(id_col).alias("id"), F.explode(F.array(*structs)).alias("k")).select("id", "k.measure", "k.value").where(F.col("value").isNotNull() & ~F.isnan("value"))
    values = Cut(range_offsets(long.groupBy("measure", "value").agg(F.count(F.lit(1)).alias("n_equal")), ["measure"], [F.col("value").desc()], "n_equal"), "values").df.withColumnRenamed("_before", "n_greater")
    totals = {r.measure: r.n for r in values.groupBy("measure").agg(F.sum("n_equal").alias("n")).collect()}
    sizes = df.sparkSession.createDataFrame([(m, totals.get(m, 0)) for m in measures], "measure string, n long")
    hot = values.join(F.broadcast(sizes), "measure").where(F.col("n_equal") >= F.col("n") * HOT_SHARE).select("measure", "value")
    return skew_join(long, values, ["measure", "value"], hot), totals


def borda_ranking(df: DataFrame, id_col: str, measures: dict[str, float]) -> DataFrame:
    """(id, points, n_missing, position): all records in one order.

    ``measures`` gives each measure's weight. In each measure a record's rank is
    the competition rank with ties averaged, and its points are the share of
    valid records it is ahead of, 1 for the first and 0 for the last; a missing
    (null or NaN) measure has the middle rank, 0.5. Points are weighted and
    added; equal sums go by id. Only ranks count, so no scale can dominate.
    Empty input gives no rows; ids are expected to be unique and not null.
    """
    ranks, totals = measure_ranks(df, id_col, list(measures))
    spark = df.sparkSession
    facts = spark.createDataFrame([(m, float(w), totals.get(m, 0)) for m, w in measures.items()], "measure string, weight double, n long")
    rank = F.col("n_greater") + (F.col("n_equal") + 1) / F.lit(2.0)
    share = F.when(F.col("n") > 1, (F.col("n") - rank) / (F.col("n") - 1)).otherwise(F.lit(0.5))
    valid = ranks.join(F.broadcast(facts), "measure").groupBy("id").agg(F.sum(F.col("weight") * (share - 0.5)).alias("above"), F.count(F.lit(1)).cast("int").alias("n_valid"))
    all_ids = df.select(F.col(id_col).alias("id"))
    half = sum(measures.values()) / 2
    points = all_ids.join(valid, "id", "left").select("id", F.round(F.coalesce("above", F.lit(0.0)) + F.lit(half), 12).alias("points"), (F.lit(len(measures)) - F.coalesce("n_valid", F.lit(0))).cast("int").alias("n_missing"))
    return global_positions(points, [F.col("points").desc(), F.col("id")])


def head_on_all(df: DataFrame, id_col: str, measures: list[str], share: float = 0.1) -> DataFrame:
    """(id, worst_rank_share): records complete in all measures that are, on each of them, within the first ``share`` of complete records.

    On each measure fewer than ``share`` of the complete records have a strictly greater value.
    """
    complete = df
    for m in measures:
        complete = complete.where(F.col(m).isNotNull() & ~F.isnan(m))
    ranks, totals = measure_ranks(complete, id_col, measures)
    n = max(totals.values(), default=0)
    worst = ranks.groupBy("id").agg(F.max("n_greater").alias("worst"))
    return worst.where(F.col("worst") < least_count(n, share)).select("id", (F.col("worst") / F.lit(max(n, 1))).alias("worst_rank_share"))

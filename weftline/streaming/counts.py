"""Windowed node counts of a stream, and totals merged batch by batch into a stored table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery


def windowed_popularity(stream: DataFrame, time_col: str = "sort_column", window: str = "1 day", late: str = "2 days") -> DataFrame:
    """(window_start, node_id, n_rows) of a streaming relation; rows later than ``late`` no longer count."""
    timed = stream.withColumn("_t", F.col(time_col).cast("timestamp")).withWatermark("_t", late)
    return timed.groupBy(F.window("_t", window).alias("w"), "node_id").agg(F.count(F.lit(1)).alias("n_rows")).select(F.col("w.start").alias("window_start"), "node_id", "n_rows")


def keep_totals(stream: DataFrame, path: str, checkpoint: str, once: bool = True) -> StreamingQuery:
    """Writes (node_id, n_rows) of every batch below ``path``, one folder a batch, so a batch that is run again replaces itself."""

    def write(batch: DataFrame, number: int) -> None:
        batch.where(F.col("node_id").isNotNull()).groupBy("node_id").agg(F.count(F.lit(1)).alias("n_rows")).write.mode("overwrite").parquet(f"{path}/batch={number}")

    q = stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint)
    return (q.trigger(availableNow=True) if once else q).start()


def totals(spark: SparkSession, path: str) -> DataFrame:
    """(node_id, n_rows) over all batches so far."""
    return spark.read.parquet(path).groupBy("node_id").agg(F.sum("n_rows").alias("n_rows"))

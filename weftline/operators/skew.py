"""Per-key results at an even load when a few keys hold most rows.

Heavy keys are found with a mergeable frequent-items sketch in one pass. Their
rows are picked out by a broadcast join with the (provably short) list of heavy
keys and spread over tasks by everything but the key; all other keys go through
an ordinary shuffle on the key; the two results are united. Whether a key was
called heavy decides only the path its rows take, never the result.

Nulls: a row whose key is null belongs to no key and is left out; a null in
``other`` isn't counted as a distinct value. Empty input gives an empty result.
Repeated rows count each time. Columns not named are never read.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


@dataclass(frozen=True)
class HeavyKeys:
    """What one pass of the sketch gives: exact row totals and heavy keys by field."""

    totals: dict[str, int]
    keys: dict[str, list[str]]
    share: float

    def table(self, spark) -> DataFrame:
        """(field_name, key_value), at most ``1.5 / share + 1`` rows a field."""
        rows = [(f, k) for f, ks in self.keys.items() for k in ks]
        return spark.createDataFrame(rows, "field_name string, key_value string")


def detect_heavy_keys(df: DataFrame, fields: list[str], share: float = 0.001, tracked: int = 0) -> HeavyKeys:
    """Keys with at least about ``share`` of a field's non-null rows, in one pass.

    The sketch tracks ``tracked`` items (by default ``32 / share``, rounded up
    to a power of two), so its memory is fixed and its error is below
    ``share / 20`` of the rows; keys are kept from ``0.9 * share`` on, and no
    more than ``1 / (0.9 - 0.05) / share`` keys can reach that.
    """
    most = math.ceil(1.5 / share) + 1
    tracked = tracked or 1 << math.ceil(math.log2(32 / share))
    aggs: list[Column] = []
    for i, f in enumerate(fields):
        aggs.append(F.count(f).alias(f"n{i}"))
        aggs.append(F.expr(f"approx_top_k(cast(`{f}` as string), {most}, {max(tracked, most)})").alias(f"t{i}"))
    row = df.select(*dict.fromkeys(fields)).agg(*aggs).first()
    totals, keys = {}, {}
    for i, f in enumerate(fields):
        totals[f] = row[f"n{i}"]
        keys[f] = sorted(x["item"] for x in row[f"t{i}"] or [] if x["item"] is not None and x["count"] >= 0.9 * share * totals[f])
    return HeavyKeys(totals, keys, share)


def by_field(df: DataFrame, fields: list[str], keep: list[str] | None = None, other: bool = False) -> DataFrame:
    """One row per row and field: (field_name, key_value[, other][, kept columns]).

    ``other`` is the remaining field of a pair of fields. Null keys are left out.
    """
    parts = []
    for i, f in enumerate(fields):
        cols = [F.lit(f).alias("field_name"), F.col(f).cast("string").alias("key_value")]
        if other:
            cols.append(F.col(fields[1 - i]).cast("string").alias("other"))
        parts.append(F.struct(*cols))
    return df.select(F.explode(F.array(*parts)).alias("_k"), *(keep or [])).select("_k.*", *(keep or [])).where(F.col("key_value").isNotNull())


def split_heavy(rows: DataFrame, heavy: HeavyKeys) -> tuple[DataFrame, DataFrame]:
    """(heavy rows, other rows). The list of heavy keys is broadcast; its length is bounded by ``HeavyKeys.table``."""
    table = F.broadcast(heavy.table(rows.sparkSession))
    on = ["field_name", "key_value"]
    return rows.join(table, on, "left_semi"), rows.join(table, on, "left_anti")


def key_counts(df: DataFrame, fields: list[str], heavy: HeavyKeys | None = None, share: float = 0.001) -> DataFrame:
    """(field_name, key_value, n_rows, is_heavy) of every key of every field.

    Counts are combined before the shuffle, so a heavy key sends one row a task.
    """
    heavy = heavy or detect_heavy_keys(df, fields, share)
    out = []
    for rows, is_heavy in zip(split_heavy(by_field(df, fields), heavy), (True, False)):
        out.append(rows.groupBy("field_name", "key_value").agg(F.count(F.lit(1)).alias("n_rows")).withColumn("is_heavy", F.lit(is_heavy)))
    return out[0].unionByName(out[1])


def key_profile(df: DataFrame, fields: list[str], time_col: str, heavy: HeavyKeys | None = None, share: float = 0.001) -> DataFrame:
    """Results per key that a plain group would pile up in one task.

    (field_name, key_value, n_rows, n_distinct_other, first_time, last_time,
    is_heavy), where ``other`` is the second of the two ``fields``. Heavy keys:
    rows are first grouped by key *and* other value, which spreads one key over
    all tasks, and only the grouped rows meet by key. Other keys: one shuffle by
    key, inside which distinct values are counted; few of their rows repeat, so
    grouping them before would only add a second shuffle.
    """
    if len(fields) != 2:
        raise ValueError("key_profile takes two fields")
    heavy = heavy or detect_heavy_keys(df, fields, share)
    rows = by_field(df.select(*fields, F.col(time_col).alias("_time")), fields, ["_time"], other=True)
    hot, rest = split_heavy(rows, heavy)
    on = ["field_name", "key_value"]
    partial = [F.count(F.lit(1)).alias("n_rows"), F.min("_time").alias("first_time"), F.max("_time").alias("last_time")]
    hot = hot.groupBy(*on, "other").agg(*partial).groupBy(*on)
    hot = hot.agg(F.sum("n_rows").alias("n_rows"), F.count("other").alias("n_distinct_other"), F.min("first_time").alias("first_time"), F.max("last_time").alias("last_time"))
    rest = rest.repartition(*on).groupBy(*on, "other").agg(*partial).groupBy(*on)
    rest = rest.agg(F.sum("n_rows").alias("n_rows"), F.count("other").alias("n_distinct_other"), F.min("first_time").alias("first_time"), F.max("last_time").alias("last_time"))
    return hot.withColumn("is_heavy", F.lit(True)).unionByName(rest.withColumn("is_heavy", F.lit(False)))


def skew_join(left: DataFrame, right: DataFrame, on: list[str], heavy: DataFrame, how: str = "inner") -> DataFrame:
    """``left`` join ``right`` where ``right`` has one row a key and ``heavy`` lists the hot keys of ``left``.

    The hot keys' rows of ``right`` number at most as many as ``heavy``, so they
    are broadcast; all other rows take an ordinary shuffle join. Null keys match
    nothing, as in SQL.
    """
    hot_right = right.join(F.broadcast(heavy), on, "left_semi")
    hot = left.join(F.broadcast(heavy), on, "left_semi").join(F.broadcast(hot_right), on, how)
    rest = left.join(F.broadcast(heavy), on, "left_anti").join(right.join(F.broadcast(heavy), on, "left_anti"), on, how)
    return hot.unionByName(rest)


def rows_with_key_totals(df: DataFrame, key: str, heavy: HeavyKeys | None = None, share: float = 0.001) -> DataFrame:
    """Every row with a non-null key, and the number of rows of its key (``key_rows``)."""
    heavy = heavy or detect_heavy_keys(df, [key], share)
    counts = key_counts(df, [key], heavy).select(F.col("key_value").alias("_key"), F.col("n_rows").alias("key_rows"))
    hot = df.sparkSession.createDataFrame([(k,) for k in heavy.keys[key]], T.StructType([T.StructField("_key", T.StringType())]))
    return skew_join(df.where(F.col(key).isNotNull()).withColumn("_key", F.col(key).cast("string")), counts, ["_key"], hot).drop("_key")

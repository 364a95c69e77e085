"""Metrics of recommendation lists, and splits into training and test rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weftline.plans.instants import micros
from weftline.plans.ranking import global_positions

METRICS = ["precision", "recall", "f1", "ndcg", "ap", "hit_rate", "rr"]


def user_metrics(recs: DataFrame, truth: DataFrame, k: int = 10) -> DataFrame:
    """(user_id, metrics): ``recs`` has (user_id, recs array), ``truth`` (user_id, items array); users of either side.

    precision = hits / k, recall = hits / relevant, both over the first k; ap and
    rr run over the whole list. A missing list is an empty one; k of 0 gives 0.
    """
    both = recs.select(F.col("user_id").cast("string"), "recs").join(truth.select(F.col("user_id").cast("string"), "items"), "user_id", "full_outer")
    both = both.select("user_id", F.coalesce("recs", F.array().cast("array<string>")).alias("recs"), F.array_distinct(F.coalesce("items", F.array().cast("array<string>"))).alias("real"), F.size(F.coalesce("items", F.array().cast("array<string>"))).alias("n_real"))
    marked = both.withColumn("hit", F.expr("transform(recs, x -> cast(array_contains(real, x) as int))"))
    top = F.slice("hit", 1, max(k, 1)) if k > 0 else F.array().cast("array<int>")
    hits = F.aggregate(top, F.lit(0), lambda a, x: a + x)
    n = F.col("n_real")
    zero = F.lit(0.0)
    p = hits / F.lit(k) if k > 0 else zero
    r = F.when(n > 0, hits / n).otherwise(zero)
    gain = F.expr(f"aggregate(transform(slice(hit, 1, {max(k, 1)}), (x, i) -> x / log2(i + 2)), 0.0D, (a, x) -> a + x)") if k > 0 else zero
    ideal = F.expr(f"aggregate(transform(sequence(1, greatest(least(n_real, {max(k, 1)}), 1)), i -> 1 / log2(i + 1)), 0.0D, (a, x) -> a + x)")
    found = F.expr("aggregate(hit, named_struct('i', 0, 'h', 0, 's', 0.0D), (a, x) -> named_struct('i', a.i + 1, 'h', a.h + x, 's', a.s + x * (a.h + x) / double(a.i + 1)), a -> a.s)")
    at = F.array_position("hit", 1)
    out = marked.select("user_id", p.alias("precision"), r.alias("recall"), F.when((n > 0), gain / ideal).otherwise(zero).alias("ndcg"), F.when(n > 0, found / n).otherwise(zero).alias("ap"), F.when(hits > 0, 1.0).otherwise(zero).alias("hit_rate"), F.when(at > 0, 1.0 / F.nullif(at, F.lit(0))).otherwise(zero).alias("rr"))
    f1 = F.when(F.col("precision") + F.col("recall") > 0, 2 * F.col("precision") * F.col("recall") / F.nullif(F.col("precision") + F.col("recall"), zero)).otherwise(zero)
    return out.withColumn("f1", f1).select("user_id", *METRICS)


def evaluate(recs: DataFrame, truth: DataFrame, k: int = 10) -> DataFrame:
    """:func:`user_metrics` and a row 'AVERAGE'; no users, no rows."""
    each = user_metrics(recs, truth, k)
    mean = each.agg(*[F.avg(m).alias(m) for m in METRICS], F.count(F.lit(1)).alias("_n")).where("_n > 0").select(F.lit("AVERAGE").alias("user_id"), *METRICS)
    return each.unionByName(mean)


def catalogue_coverage(recs: DataFrame, catalogue: DataFrame, item_col: str = "item") -> DataFrame:
    """(coverage): share of the catalogue's distinct items that some list holds; 0 for an empty catalogue."""
    items = catalogue.select(item_col).where(F.col(item_col).isNotNull()).distinct()
    held = recs.select(F.explode("recs").alias(item_col)).distinct().withColumn("_hit", F.lit(1))
    return items.join(held, item_col, "left").agg(F.when(F.count(F.lit(1)) > 0, F.count("_hit") / F.count(F.lit(1))).otherwise(F.lit(0.0)).alias("coverage"))


def _fraction(f: float) -> None:
    if not 0 < f < 1:
        raise ValueError("fraction must be in (0, 1)")


def temporal_split(df: DataFrame, timestamp_col: str, test_fraction: float = 0.2, set_col: str | None = None) -> tuple[DataFrame, DataFrame]:
    """(train, test): the first rows by time, or, with ``set_col``, the sets that begin first.

    Exactly int(n (1 - test_fraction)) rows (sets) train. Rows without a time come
    last; equal times go by the other columns. Positions come from range
    partitions, so no task sorts the whole table.
    """
    _fraction(test_fraction)
    timed = df.withColumn("_t", micros(df, timestamp_col))
    if set_col:
        starts = timed.groupBy(set_col).agg(F.min("_t").alias("_t"))
        return _cut_sets(df, global_positions(starts, [F.col("_t").asc_nulls_last(), F.col(set_col)]), set_col, test_fraction)
    others = [F.col(c).asc_nulls_last() for c, t in df.dtypes if c != timestamp_col and not t.startswith("map")]
    return _cut_rows(global_positions(timed, [F.col("_t").asc_nulls_last(), *others]).drop("_t"), df, test_fraction)


def random_split(df: DataFrame, test_fraction: float = 0.2, seed: int = 42, set_col: str | None = None) -> tuple[DataFrame, DataFrame]:
    """(train, test) of exact sizes, in an order that hashes of the seed and the row (or set) fix."""
    _fraction(test_fraction)
    if set_col:
        keys = df.select(set_col).distinct().withColumn("_h", F.xxhash64(F.lit(seed), F.col(set_col)))
        return _cut_sets(df, global_positions(keys, [F.col("_h"), F.col(set_col)]), set_col, test_fraction)
    hashed = df.withColumn("_h", F.xxhash64(F.lit(seed), *df.columns))
    return _cut_rows(global_positions(hashed, [F.col("_h"), *[F.col(c).asc_nulls_last() for c, t in df.dtypes if not t.startswith("map")]]).drop("_h"), df, test_fraction)


def _cut_rows(placed: DataFrame, df: DataFrame, test_fraction: float) -> tuple[DataFrame, DataFrame]:
    n = placed.agg(F.count(F.lit(1)).alias("_n"))
    sized = placed.crossJoin(F.broadcast(n))
    first = F.col("position") <= F.floor(F.col("_n") * F.lit(1 - test_fraction))
    return sized.where(first).select(*df.columns), sized.where(~first).select(*df.columns)


def _cut_sets(df: DataFrame, placed: DataFrame, set_col: str, test_fraction: float) -> tuple[DataFrame, DataFrame]:
    n = placed.agg(F.count(F.lit(1)).alias("_n"))
    train = placed.crossJoin(F.broadcast(n)).where(F.col("position") <= F.floor(F.col("_n") * F.lit(1 - test_fraction))).select(F.col(set_col).alias("_s"))
    same = F.col(set_col).eqNullSafe(F.col("_s"))
    return df.join(train, same, "left_semi"), df.join(train, same, "left_anti")

"""Items that appear together more often than chance."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weftline.functions import lift, pmi
from weftline.operators.skew import detect_heavy_keys, skew_join
from weftline.plans.shared import least_count

#: Up to so many candidate nodes are numbered and broadcast (about 2 MB); beyond it, or in baskets larger than it, baskets are cut in blocks.
MAX_CODED = 20_000


def count_baskets(df: DataFrame, set_col: str, node_col: str) -> int:
    """N: distinct sets over rows whose set and node are both not null."""
    return df.where(F.col(set_col).isNotNull() & F.col(node_col).isNotNull()).select(set_col).distinct().count()


def candidate_nodes(df: DataFrame, set_col: str, node_col: str, least: int) -> DataFrame:
    """(node, n_rows) of nodes with ``least`` rows or more: a superset of those in ``least`` sets.

    At most (rows / least) nodes; with least = s * N that is (mean basket size / s), whatever the size of the data.
    """
    return df.where(F.col(set_col).isNotNull() & F.col(node_col).isNotNull()).groupBy(F.col(node_col).alias("node")).agg(F.count(F.lit(1)).alias("n_rows")).where(F.col("n_rows") >= least)


def co_occurring_pairs(
    df: DataFrame, set_col: str = "set_id", node_col: str = "node_id", min_count: int = 1, min_share: float = 0.0, min_lift: float = 0.0, max_coded: int = MAX_CODED
) -> DataFrame:
    """(node_a, node_b, n_ab, n_a, n_b, n_sets, lift, pmi) of pairs of different nodes, node_a < node_b by bytes.

    Counts are of distinct sets, so repeated rows count once. Kept are pairs with
    ``n_ab >= min_count``, ``n_ab >= min_share * n_sets`` and
    ``n_ab * n_sets >= min_lift * n_a * n_b``. A pair is never more frequent than
    its rarer node, so nodes below the count are left out first; no other pair
    is lost. Items are deduplicated per basket, ordered pairs (with the diagonal,
    which carries the marginals) are emitted and combined before the shuffle.

    Rows with a null set or node are left out. Empty input gives no rows.
    """
    n_sets = count_baskets(df, set_col, node_col)
    least = max(min_count, least_count(n_sets, min_share), 1)
    rows = df.where(F.col(set_col).isNotNull() & F.col(node_col).isNotNull()).select(F.col(set_col).alias("s"), F.col(node_col).alias("node"))
    candidates = [r.node for r in candidate_nodes(df, set_col, node_col, least).select("node").limit(max_coded + 1).collect()]
    if len(candidates) > max_coded:
        counts = _blocked_counts(rows, candidate_nodes(df, set_col, node_col, least).select("node"), max_coded)
    else:
        counts = _coded_counts(rows, sorted(candidates, key=lambda x: x.encode()))
    return _measure(counts, n_sets, least, min_lift, len(candidates) <= max_coded)


def _coded_counts(rows: DataFrame, nodes: list[str]) -> DataFrame:
    """(a, b, n) by strings, with the diagonal; nodes are numbered in byte order, so a < b holds for numbers and strings alike."""
    spark = rows.sparkSession
    codes = spark.createDataFrame([(n, i) for i, n in enumerate(nodes)], "node string, code int")
    baskets = rows.join(F.broadcast(codes), "node").groupBy("s").agg(F.array_sort(F.collect_set("code")).alias("items"))
    firsts = baskets.select("items", F.posexplode("items").alias("i", "a"))
    pairs = firsts.select("a", F.explode(F.slice("items", F.col("i") + 1, F.size("items"))).alias("b"))
    counts = pairs.select((F.col("a").cast("long") * (1 << 32) + F.col("b")).alias("ab")).groupBy("ab").agg(F.count(F.lit(1)).alias("n"))
    named = counts.select(F.shiftright("ab", 32).cast("int").alias("ca"), F.col("ab").bitwiseAND((1 << 32) - 1).cast("int").alias("cb"), "n")
    left, right = codes.select(F.col("node").alias("a"), F.col("code").alias("ca")), codes.select(F.col("node").alias("b"), F.col("code").alias("cb"))
    return named.join(F.broadcast(left), "ca").join(F.broadcast(right), "cb").select("a", "b", "n")


def _blocked_counts(rows: DataFrame, nodes: DataFrame, block: int) -> DataFrame:
    """The same for any number of nodes: a basket of more than ``block`` items is cut by hash in blocks, and each pair of blocks is its own group."""
    single = rows.distinct()
    items = skew_join(single, nodes, ["node"], detect_heavy_keys(single, ["node"]).table(rows.sparkSession).select(F.col("key_value").alias("node")))
    blocks = items.groupBy("s").agg(F.ceil(2 * F.count(F.lit(1)) / F.lit(block)).cast("int").alias("k"))
    placed = items.join(blocks, "s").withColumn("own", F.pmod(F.xxhash64("node"), F.col("k")).cast("int"))
    spread = placed.withColumn("j", F.explode(F.sequence(F.lit(0), F.col("k") - 1))).select("s", F.least("own", "j").alias("i"), F.greatest("own", "j").alias("j"), (F.col("own") <= F.col("j")).alias("is_i"), "own", "node")
    groups = spread.groupBy("s", "i", "j").agg(F.collect_list(F.when(F.col("own") == F.col("i"), F.col("node"))).alias("left"), F.collect_list(F.when(F.col("own") == F.col("j"), F.col("node"))).alias("right"))
    pairs = groups.select("i", "j", F.explode("left").alias("x"), "right").select("i", "j", "x", F.explode("right").alias("y")).where((F.col("i") < F.col("j")) | (F.col("x") <= F.col("y")))
    return pairs.select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).groupBy("a", "b").agg(F.count(F.lit(1)).alias("n"))


def _measure(counts: DataFrame, n_sets: int, least: int, min_lift: float, small: bool) -> DataFrame:
    hint = F.broadcast if small else (lambda x: x)
    counts = counts.where(F.col("n") >= least)
    own = counts.where(F.col("a") == F.col("b"))
    n_a, n_b = own.select("a", F.col("n").alias("n_a")), own.select(F.col("a").alias("b"), F.col("n").alias("n_b"))
    pairs = counts.where(F.col("a") < F.col("b")).join(hint(n_a), "a").join(hint(n_b), "b")
    exact = F.col("n") * F.lit(n_sets)
    terms = (F.col("n"), F.col("n_a"), F.col("n_b"), F.lit(n_sets))
    return pairs.where(exact >= F.lit(float(min_lift)) * F.col("n_a") * F.col("n_b")).select(
        F.col("a").alias("node_a"), F.col("b").alias("node_b"), F.col("n").alias("n_ab"), "n_a", "n_b", F.lit(n_sets).cast("long").alias("n_sets"), lift(*terms).alias("lift"), pmi(*terms).alias("pmi")
    )

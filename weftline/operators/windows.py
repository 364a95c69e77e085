"""Equal-width windows over the time of interactions."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from weftline.plans.instants import from_micros, micros


@dataclass(frozen=True)
class Windows:
    """``n`` windows between the first and last time, both ends inclusive, so a row on a border is in two.

    Bounds are microseconds; window i runs from ``low + span * i div n`` to the
    start of the next. ``low`` is None when no row has a time.
    """

    n: int
    low: int | None
    high: int | None

    @classmethod
    def of(cls, df: DataFrame, n: int, time_col: str = "sort_column") -> Windows:
        row = df.agg(F.min(micros(df, time_col)).alias("a"), F.max(micros(df, time_col)).alias("b")).first()
        return cls(n, row.a, row.b)

    def start(self, i: int) -> int:
        return self.low + (self.high - self.low) * i // self.n

    def frame(self, spark) -> DataFrame:
        """(win, label), one row a window; empty without any time."""
        rows = [] if self.low is None else [(i, self.start(i), self.start(i + 1)) for i in range(self.n)]
        day = lambda c: F.date_format(from_micros(F.col(c)), "yyyy-MM-dd")
        label = F.concat(F.lit("W"), (F.col("win") + 1).cast("string"), F.lit("["), day("a"), F.lit("→"), day("b"), F.lit("]"))
        return spark.createDataFrame(rows, "win int, a long, b long").select("win", label.alias("label"))

    def ids(self, us: Column) -> Column:
        """The windows that hold an instant, as an array, by arithmetic: the one that it falls in and, where it is on a border, a neighbour."""
        if self.low is None:
            return F.array().cast("array<int>")
        low, span, n = F.lit(self.low), self.high - self.low, F.lit(self.n).cast("long")
        if not span:
            return F.when(us == low, F.sequence(F.lit(0), F.lit(self.n - 1))).otherwise(F.array().cast("array<int>"))
        at = F.floor((us - low).cast("decimal(38,0)") * n / F.lit(span).cast("decimal(19,0)")).cast("int")
        start = lambda i: low + F.floor(F.lit(span).cast("decimal(19,0)") * i / n).cast("long")
        near = F.array(at - 1, at, at + 1)
        return F.filter(near, lambda i: (i >= 0) & (i < self.n) & us.between(start(i), start(i + 1)))

    def tag(self, df: DataFrame, time_col: str = "sort_column") -> DataFrame:
        """``df`` with ``win``, one row for each window a row is in. Rows without a time are in none."""
        return df.withColumn("win", F.explode(self.ids(micros(df, time_col))))


def windowed_incidence(df: DataFrame, windows: Windows) -> DataFrame:
    """(win, set_id, node_id, m): rows of each node in each set by window."""
    return windows.tag(df).groupBy("win", "set_id", "node_id").agg(F.count(F.lit(1)).alias("m"))


def windowed_pairs(df: DataFrame, windows: Windows, min_count: int = 1, both_sides: bool = False, tagged: DataFrame | None = None) -> DataFrame:
    """(win, source, target, weight) with source < target, counted by row pairs.

    The window is that of the source row, whatever the time of the other, or of
    both rows with ``both_sides``. ``tagged`` is the windowed incidence, where it is there already.
    """
    tagged = windowed_incidence(df, windows) if tagged is None else tagged
    a = tagged.select("win", "set_id", F.col("node_id").alias("source"), F.col("m").alias("ma"))
    if both_sides:
        met = a.join(tagged.select("win", "set_id", F.col("node_id").alias("target"), F.col("m").alias("mb")), ["win", "set_id"])
    else:
        rows = df.groupBy("set_id", "node_id").agg(F.count(F.lit(1)).alias("mb"))
        met = a.join(rows.select("set_id", F.col("node_id").alias("target"), "mb"), "set_id")
    met = met.where(F.col("source") < F.col("target"))
    return met.groupBy("win", "source", "target").agg(F.sum(F.col("ma") * F.col("mb")).alias("weight")).where(F.col("weight") >= min_count)


#: Sets of more nodes than this, and than twice the tasks, are paired where their sources are counted.
WIDE = 64


def _task_keys(spark: SparkSession, tasks: int) -> list[int]:
    """An integer for each of ``tasks`` partitions that hashing sends there, so that each task gets one."""
    keys = spark.range(64 * tasks, numPartitions=1).select(F.col("id").cast("int").alias("key"))
    found = {r.at: r.key for r in keys.select("key", F.pmod(F.hash("key"), F.lit(tasks)).alias("at")).collect()}
    return list(found.values())


def _half_pairs(df: DataFrame, windows: Windows) -> DataFrame:
    """(block, win, source, target, there, back) with source < target: the weights of both directions, in parts that a sum by these keys completes.

    Rows go to the task of their set, which counts them and adds up the pairs of
    its narrow sets. Only these sums go on, to the task of their source. Pairs
    of wide sets, n squared of them, are not sent: the n nodes go to every task,
    which pairs those that are its sources.
    """
    spark = df.sparkSession
    tasks = int(spark.conf.get("spark.sql.shuffle.partitions"))
    keys = F.array(*[F.lit(k) for k in _task_keys(spark, tasks)])
    task = lambda c: F.element_at(keys, F.pmod(F.hash(c), F.size(keys)) + 1)
    us, every = micros(df, "sort_column"), range(windows.n)
    inside = [F.lit(False) if windows.low is None else F.coalesce(us.between(windows.start(i), windows.start(i + 1)), F.lit(False)) for i in every]
    rows = df.where(F.col("set_id").isNotNull() & F.col("node_id").isNotNull()).select(task("set_id").alias("part"), "set_id", "node_id", *[x.alias(f"w{i}") for i, x in enumerate(inside)])
    held = rows.repartition(tasks, "part").groupBy("part", "set_id", "node_id").agg(F.count(F.lit(1)).alias("m"), *[F.count_if(f"w{i}").alias(f"w{i}") for i in every])
    node = F.struct(F.col("node_id").alias("node"), "m", F.array(*[f"w{i}" for i in every]).alias("w"))
    sets = held.groupBy("part", "set_id").agg(F.array_sort(F.collect_list(node)).alias("nodes"), *[F.max(f"w{i}").alias(f"w{i}") for i in every])
    wins = F.array_compact(F.array(*[F.when(F.col(f"w{i}") > 0, F.lit(i)) for i in every]))
    sets = sets.where((F.size("nodes") > 1) & (F.size(wins) > 0)).select("part", wins.alias("wins"), "nodes")
    wide = F.size("nodes") > max(WIDE, 2 * tasks)
    later = F.explode(F.expr("slice(nodes, i + 2, size(nodes))")).alias("b")
    ends = [F.col("a.node").alias("source"), F.col("b.node").alias("target")]
    there, back = lambda win: F.element_at("a.w", win + 1) * F.col("b.m"), lambda win: F.element_at("b.w", win + 1) * F.col("a.m")

    near = sets.where(~wide).select("part", F.explode("wins").alias("win"), "nodes").select("part", "win", "nodes", F.posexplode("nodes").alias("i", "a")).select("part", "win", "a", later)
    near = near.groupBy("part", "win", *ends).agg(F.sum(there(F.col("win"))).alias("there"), F.sum(back(F.col("win"))).alias("back"))
    near = near.select(task("source").alias("block"), "win", "source", "target", "there", "back").where("there > 0 OR back > 0").repartition(tasks, "block")

    far = sets.where(wide).select(F.explode(keys).alias("block"), "nodes").repartition(tasks, "block")
    far = far.select("block", "nodes", F.posexplode("nodes").alias("i", "a")).where(F.col("block") == task("a.node")).select("block", "a", later)
    far = far.groupBy("block", *ends).agg(*[F.sum(f(F.lit(i))).alias(f"{n}{i}") for i in every for n, f in (("there", there), ("back", back))])
    far = far.select("block", "source", "target", F.inline(F.array(*[F.struct(F.lit(i).alias("win"), F.col(f"there{i}").alias("there"), F.col(f"back{i}").alias("back")) for i in every])))
    return near.unionByName(far.where("there > 0 OR back > 0"))


def windowed_edges(df: DataFrame, windows: Windows, min_count: int = 1) -> DataFrame:
    """(win, source, target, weight) in both directions; each counts in the windows of its own source rows."""
    pairs = _half_pairs(df, windows).groupBy("block", "win", "source", "target").agg(F.sum("there").alias("there"), F.sum("back").alias("back"))
    ways = F.array(F.struct("source", "target", F.col("there").alias("weight")), F.struct(F.col("target").alias("source"), F.col("source").alias("target"), F.col("back").alias("weight")))
    return pairs.select("win", F.inline(F.filter(ways, lambda x: x["weight"] >= max(min_count, 1))))

"""Clusters of similar records by grid density, in SQL operations only.

Features are quantised in cells as wide as the distance up to which records are
alike, so all records of a cell are alike. Occupied (dense) cells that adjoin
are joined when records of both are alike, which their bounding boxes decide;
where boxes can't, the two cells are cut in halves along every feature and only
the undecided parts are looked at again, down to single points. Minimum labels
then run along the joined cells, with pointer jumps, until nothing changes.

No step looks at pairs of records: work is per cell, and a cell has at most
``3**d - 1`` neighbours. Records that hold the same values are one point.
"""

from __future__ import annotations

from itertools import product

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from weftline.operators.skew import skew_join
from weftline.plans.shared import Cut

#: Stands for the logarithm of zero: alike only to itself.
LOG_OF_ZERO = -1000.0
#: Halvings after which doubles can't be told apart; pairs still undecided are an error.
MAX_HALVINGS = 60
HOT_SHARE = 0.001


def log_feature(x: Column, most: float | None = None) -> Column:
    """log10 of ``x``, with ``x`` cut off at ``most``."""
    top = F.least(x, F.lit(float(most))) if most is not None else x
    return F.when(x.isNull() | F.isnan(x), None).when(top <= 0, F.lit(LOG_OF_ZERO)).otherwise(F.log10(top))


def grid_points(df: DataFrame, id_col: str, features: dict[str, Column], width: float) -> DataFrame:
    """(id, f0.., c0..): records whose features are all neither null nor NaN, and their cells."""
    names = [f"f{i}" for i in range(len(features))]
    points = df.select(F.col(id_col).alias("id"), *[x.cast("double").alias(n) for n, x in zip(names, features.values())])
    for n in names:
        points = points.where(F.col(n).isNotNull() & ~F.isnan(n))
    return points.select("*", *[F.floor(F.col(n) / F.lit(width)).alias(f"c{i}") for i, n in enumerate(names)])


def _boxes(points: DataFrame, by: list[str], d: int) -> DataFrame:
    return points.groupBy(*by).agg(F.min("id").alias("cell"), F.count(F.lit(1)).alias("n"), *[F.min(f"f{i}").alias(f"lo{i}") for i in range(d)], *[F.max(f"f{i}").alias(f"hi{i}") for i in range(d)])


def _all(parts: list[Column]) -> Column:
    out = parts[0]
    for p in parts[1:]:
        out = out & p
    return out


def _verdict(d: int, width: float) -> tuple[Column, Column]:
    """(some records may be alike, all records are alike) of boxes l and r."""
    may = [(F.col(f"r.lo{i}") - F.col(f"l.hi{i}") <= width) & (F.col(f"l.lo{i}") - F.col(f"r.hi{i}") <= width) for i in range(d)]
    sure = [F.greatest(f"l.hi{i}", f"r.hi{i}") - F.least(f"l.lo{i}", f"r.lo{i}") <= width for i in range(d)]
    return _all(may), _all(sure)


def neighbour_cells(cells: DataFrame, d: int, width: float) -> DataFrame:
    """(a, b, sure) of adjoining cells that may hold alike records, each pair once."""
    half = [o for o in product((-1, 0, 1), repeat=d) if o > (0,) * d]
    offsets = F.array(*[F.struct(*[F.lit(x).cast("long").alias(f"o{i}") for i, x in enumerate(o)]) for o in half])
    left = cells.select("cell", *[f"c{i}" for i in range(d)]).withColumn("o", F.explode(offsets)).select(F.col("cell").alias("a"), *[(F.col(f"c{i}") + F.col(f"o.o{i}")).alias(f"c{i}") for i in range(d)])
    met = left.join(cells.select(F.col("cell").alias("b"), *[f"c{i}" for i in range(d)]), [f"c{i}" for i in range(d)]).select("a", "b")
    may, sure = _verdict(d, width)
    boxes = cells.select("cell", *[f"{x}{i}" for i in range(d) for x in ("lo", "hi")])
    return met.join(boxes.alias("l"), F.col("a") == F.col("l.cell")).join(boxes.alias("r"), F.col("b") == F.col("r.cell")).where(may).select("a", "b", sure.alias("sure"))


def _decide(points: DataFrame, unsure: DataFrame, d: int, width: float) -> DataFrame:
    """The pairs of ``unsure`` (a, b) of which records are alike, by halving cells until boxes decide."""
    spark = points.sparkSession
    linked = spark.createDataFrame([], unsure.schema)
    open_pairs = unsure.select("a", "b", F.col("a").alias("x"), F.col("b").alias("y"), F.lit(None).cast("string").alias("kx"), F.lit(None).cast("string").alias("ky"))
    key = F.lit("")
    may, sure = _verdict(d, width)
    for level in range(1, MAX_HALVINGS):
        touched = open_pairs.select(F.col("a").alias("cell")).union(open_pairs.select(F.col("b"))).distinct()
        w = width / (1 << level)
        parent, key = key, F.concat_ws(",", *[F.floor(F.col(f"f{i}") / F.lit(w)).cast("string") for i in range(d)])
        parts = points.join(touched, "cell").withColumn("key", key).withColumn("parent", parent)
        boxes = parts.groupBy("cell", "key").agg(F.min("parent").alias("parent"), *[F.min(f"f{i}").alias(f"lo{i}") for i in range(d)], *[F.max(f"f{i}").alias(f"hi{i}") for i in range(d)])
        left, right = boxes.alias("l"), boxes.alias("r")
        on_left = (F.col("p.a") == F.col("l.cell")) & (F.col("p.kx").isNull() | (F.col("p.kx") == F.col("l.parent")))
        on_right = (F.col("p.b") == F.col("r.cell")) & (F.col("p.ky").isNull() | (F.col("p.ky") == F.col("r.parent")))
        tested = Cut(open_pairs.alias("p").join(left, on_left).join(right, on_right).where(may).select("a", "b", F.col("l.key").alias("kx"), F.col("r.key").alias("ky"), sure.alias("sure")), "halved")
        linked = linked.union(tested.df.where("sure").select("a", "b").distinct())
        open_pairs = tested.df.where(~F.col("sure")).join(tested.df.where("sure").select("a", "b").distinct(), ["a", "b"], "left_anti")
        if open_pairs.isEmpty():
            return linked.distinct()
    raise RuntimeError(f"boxes of cells halved {MAX_HALVINGS} times still leave pairs undecided")


def min_labels(edges: DataFrame) -> DataFrame:
    """(cell, label): the least cell each cell is connected to by ``edges`` (a, b).

    Minimum labels of neighbours, then two pointer jumps, each round written to
    the shared folder; rounds grow with the logarithm of a component's length.
    """
    both = Cut(edges.select("a", "b").union(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct(), "edges")
    now = Cut(both.df.groupBy("a").agg(F.least(F.col("a"), F.min("b")).alias("label")).select(F.col("a").alias("cell"), "label"), "labels")
    while True:
        labels = now.df
        near = both.df.join(labels.select(F.col("cell").alias("b"), "label"), "b").groupBy(F.col("a").alias("cell")).agg(F.min("label").alias("seen"))
        step = labels.join(near, "cell").select("cell", F.col("label").alias("old"), F.least("label", "seen").alias("label"))
        jump = labels.select(F.col("cell").alias("label"), F.col("label").alias("far"))
        new = Cut(step.join(jump, "label").select("cell", "old", F.least("label", "far").alias("label")), "labels")
        changed = not new.df.where(F.col("label") < F.col("old")).isEmpty()
        now.drop()
        now = new
        if not changed:
            both.drop()
            return now.df.select("cell", "label")


def grid_clusters(df: DataFrame, id_col: str, features: dict[str, Column], width: float = 0.1, min_cell: int = 1) -> DataFrame:
    """(id, cell, cell_size, cluster): every record with complete features in a dense cell, with its cluster.

    Two records are alike when each feature differs by at most ``width``;
    clusters are the connected groups of alike records over cells of at least
    ``min_cell`` records. ``cluster`` is the least id in it, ``cell`` the least
    id in the cell. Records with a null or NaN feature belong to no cluster.
    Repeated rows are kept. Empty input gives no rows.
    """
    d = len(features)
    points = grid_points(df, id_col, features, width)
    keys = [f"c{i}" for i in range(d)]
    cells = Cut(_boxes(points, keys, d).where(F.col("n") >= min_cell), "cells").df
    met = Cut(neighbour_cells(cells, d, width), "met").df
    # cells with more than HOT_SHARE of the records, at most 1 / HOT_SHARE, are joined by broadcast
    hot = cells.where(F.col("n") > HOT_SHARE * (cells.agg(F.sum("n")).first()[0] or 0)).select(*keys)
    placed = skew_join(points, cells.select(*keys, "cell", F.col("n").alias("cell_size")), keys, hot).drop(*keys)
    unsure = met.where(~F.col("sure")).select("a", "b")
    edges = met.where("sure").select("a", "b")
    if not unsure.isEmpty():
        edges = edges.union(_decide(placed, unsure, d, width))
    labels = min_labels(edges)
    return placed.join(labels, "cell", "left").select("id", "cell", "cell_size", F.coalesce("label", "cell").alias("cluster"), *[f"f{i}" for i in range(d)])


def describe_clusters(members: DataFrame, n_typical: int = 3, min_size: int = 5) -> DataFrame:
    """(cluster, n_records, n_cells, densest_cell_size, typical): sizes and the most typical members.

    Typical are the ``n_typical`` least ids of the densest cell, ties of cells going to the least one.
    """
    cells = members.groupBy("cluster", "cell").agg(F.count(F.lit(1)).alias("n"))
    best = F.max_by("cell", F.struct("n", -F.col("cell")))
    clusters = cells.groupBy("cluster").agg(F.sum("n").alias("n_records"), F.count(F.lit(1)).alias("n_cells"), F.max("n").alias("densest_cell_size"), best.alias("cell")).where(F.col("n_records") >= min_size)
    first = Window.partitionBy("cluster").orderBy("id")
    typical = members.join(clusters.select("cluster", "cell"), ["cluster", "cell"]).withColumn("k", F.row_number().over(first)).where(F.col("k") <= n_typical)
    named = typical.groupBy("cluster").agg(F.array_sort(F.collect_list("id")).alias("typical"))
    return clusters.drop("cell").join(named, "cluster")

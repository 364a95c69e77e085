"""Filling containers of fixed capacity with documents: sum-of-squares packing.

An item goes to the fill level that leaves the least sum of squared numbers of
open containers by level; the numbers are kept in an array by level. The method
is an online one; here a group's documents are all known, so they come largest
first, which leaves less room unused. Documents are packed in groups of bounded size, one task each; the containers that a
group leaves open are then items themselves and are packed with those of the
other groups. A document longer than a container fills whole containers, and
only its rest is an item.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weftline.plans.shared import Cut

#: Documents, and open containers, that one task packs at most (as a mean of a hash).
GROUP_ITEMS = 20_000


class SumOfSquares:
    """Open containers by fill level; ``levels[h]`` counts those filled to h."""

    def __init__(self, capacity: int):
        self.capacity = capacity
        self.levels = np.zeros(capacity + 1, dtype=np.int64)
        self.open: list[list[int]] = [[] for _ in range(capacity + 1)]
        self.fill: list[int] = []

    def place(self, size: int) -> int:
        """The container that an item of ``size`` (1 to capacity) goes to.

        Moving one container from level h to h + size changes the sum of squares
        by 2 (n[h + size] - n[h]) + 2, without the first term at the brim; a new
        one by 2 n[size] + 1. Of equal changes the fuller container is taken.
        """
        room = self.capacity - size
        best, level = (2 * self.levels[size] + 1 if room else 0), 0
        if room:
            n = self.levels[1 : room + 1]
            change = 2 * (self.levels[size + 1 :] - n) + 2
            change[-1] = 1 - 2 * n[-1]
            change[n == 0] = np.iinfo(np.int64).max
            at = room - 1 - int(np.argmin(change[::-1]))
            if change[at] <= best:
                level = at + 1
        if level:
            which = self.open[level].pop()
            self.levels[level] -= 1
        else:
            which = len(self.fill)
            self.fill.append(0)
        level += size
        self.fill[which] = level
        if level < self.capacity:
            self.open[level].append(which)
            self.levels[level] += 1
        return which


def pack_items(sizes: list[int], capacity: int) -> list[int]:
    """The container number of each item, in the order given; items of size 0 go to container 0."""
    packer = SumOfSquares(capacity)
    return [packer.place(s) if s else 0 for s in sizes]


def _pack_group(frame: pd.DataFrame) -> pd.DataFrame:
    """Items (kind, capacity, grp, item, size), largest first, as containers."""
    f = frame.sort_values(["size", "item"], ascending=[False, True], kind="stable")
    f["bin"] = pack_items(f["size"].tolist(), int(f["capacity"].iloc[0]))
    return f[["kind", "capacity", "grp", "item", "size", "bin"]]


_PACKED = "kind string, capacity long, grp long, item long, size long, bin long"


def _pack(items: DataFrame, groups: int) -> DataFrame:
    grp = F.pmod(F.xxhash64("item"), F.lit(groups))
    return items.withColumn("grp", grp).groupBy("kind", "grp").applyInPandas(_pack_group, _PACKED)


def pack_documents(sizes: DataFrame, containers: DataFrame, group_items: int = GROUP_ITEMS) -> DataFrame:
    """(container_kind, container_id, doc_id, piece, n_tokens): where every document goes, for each capacity.

    ``sizes`` has (doc_id, n_tokens), doc_id unique and not null, nulls counting
    as 0; ``containers`` has (container_kind, capacity_tokens), null capacities
    left out. Pieces of a document count from 0; only one longer than the
    capacity has several. Documents without tokens share a container of their
    group. Nothing is left out; empty input gives no rows.
    """
    docs = Cut(sizes.select("doc_id", F.coalesce("n_tokens", F.lit(0)).cast("long").alias("n_tokens")), "sizes").df
    kinds = containers.where(F.col("capacity_tokens") > 0).select(F.col("container_kind").alias("kind"), F.col("capacity_tokens").cast("long").alias("capacity"))
    groups = max(1, -(-docs.count() // group_items))
    each = docs.crossJoin(F.broadcast(kinds)).withColumn("whole", F.floor(F.col("n_tokens") / F.col("capacity")).cast("long")).withColumn("rest", F.col("n_tokens") % F.col("capacity"))
    full = each.where(F.col("whole") > 0).select("kind", "doc_id", F.explode(F.sequence(F.lit(0).cast("long"), F.col("whole") - 1)).alias("piece"), F.col("capacity").alias("n_tokens"))
    full = full.select("kind", F.concat_ws("-", F.lit("w"), "doc_id", "piece").alias("container_id"), "doc_id", "piece", "n_tokens")
    items = each.where((F.col("rest") > 0) | (F.col("whole") == 0)).select("kind", "capacity", F.col("doc_id").alias("item"), F.col("rest").alias("size"))
    first = Cut(_pack(items, groups), "packed").df
    bins = first.groupBy("kind", "capacity", "grp", "bin").agg(F.sum("size").alias("size"))
    number = (F.col("grp") * F.lit(1 << 32) + F.col("bin")).alias("item")
    partly = Cut(bins.where(F.col("size") < F.col("capacity")).select("kind", "capacity", number, "size"), "open").df
    again = _pack(partly, max(1, -(-partly.count() // (group_items * max(1, kinds.count())))))
    merged = again.select("kind", F.col("item").alias("old"), F.concat_ws("-", F.lit("m"), "grp", "bin").alias("new"))
    placed = first.select("kind", number.alias("old"), F.col("item").alias("doc_id"), "size").join(merged, ["kind", "old"], "left")
    placed = placed.join(docs, "doc_id").join(F.broadcast(kinds), "kind").select(
        "kind", F.coalesce("new", F.concat(F.lit("f-"), F.col("old").cast("string"))).alias("container_id"), "doc_id", F.floor(F.col("n_tokens") / F.col("capacity")).cast("long").alias("piece"), F.col("size").alias("n_tokens")
    )
    return full.unionByName(placed).withColumnRenamed("kind", "container_kind")


def packing_summary(packed: DataFrame, containers: DataFrame) -> DataFrame:
    """(container_kind, n_containers, n_documents, n_tokens, least_possible, fill): how full the containers are."""
    by_kind = packed.groupBy("container_kind", "container_id").agg(F.sum("n_tokens").alias("n")).groupBy("container_kind").agg(F.count(F.lit(1)).alias("n_containers"), F.sum("n").alias("n_tokens"))
    documents = packed.where(F.col("piece") == 0).groupBy("container_kind").agg(F.count(F.lit(1)).alias("n_documents"))
    out = by_kind.join(documents, "container_kind").join(F.broadcast(containers.select("container_kind", "capacity_tokens")), "container_kind")
    full = F.col("n_tokens") / F.col("capacity_tokens")
    return out.select("container_kind", "n_containers", "n_documents", "n_tokens", F.ceil(full).alias("least_possible"), F.round(full / F.col("n_containers"), 6).alias("fill"))


def check_packing(packed: DataFrame, sizes: DataFrame, containers: DataFrame) -> DataFrame:
    """(container_kind, n_documents, n_repeated, n_overfull, n_split_without_need, n_tokens_lost) of a packing: documents placed, pieces placed more than once, containers over their capacity, documents split that fit, and tokens of documents that no container has."""
    kinds = F.broadcast(containers.where(F.col("capacity_tokens") > 0).select("container_kind", F.col("capacity_tokens").cast("long").alias("capacity")))
    bins = packed.groupBy("container_kind", "container_id").agg(F.sum("n_tokens").alias("n")).join(kinds, "container_kind")
    overfull = bins.groupBy("container_kind").agg(F.sum(F.when(F.col("n") > F.col("capacity"), 1).otherwise(0)).alias("n_overfull"), F.sum("n").alias("placed"))
    pieces = packed.groupBy("container_kind", "doc_id", "piece").agg(F.count(F.lit(1)).alias("times"))
    docs = pieces.groupBy("container_kind", "doc_id").agg(F.sum(F.col("times") - 1).alias("more"), F.count(F.lit(1)).alias("pieces"))
    docs = docs.join(sizes.select("doc_id", F.coalesce("n_tokens", F.lit(0)).alias("tokens")), "doc_id").join(kinds, "container_kind")
    by_kind = docs.groupBy("container_kind").agg(
        F.count(F.lit(1)).alias("n_documents"), F.sum("more").alias("n_repeated"), F.sum(F.when((F.col("pieces") > 1) & (F.col("tokens") <= F.col("capacity")), 1).otherwise(0)).alias("n_split_without_need"), F.sum("tokens").alias("tokens")
    )
    out = by_kind.join(F.broadcast(overfull), "container_kind")
    return out.select("container_kind", "n_documents", *[F.col(c).cast("long").alias(c) for c in ("n_repeated", "n_overfull", "n_split_without_need")], (F.col("tokens") - F.col("placed")).cast("long").alias("n_tokens_lost"))

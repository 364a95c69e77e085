"""The N best items of every group by merging sorted runs with a loser tree.

A run is what one input partition holds, sorted by group, score (falling) and
item. A run passes on only the first N distinct items of each group, so a group
that holds a third of all rows sends N rows a run. Runs are then brought
together by buckets of groups and merged with a loser tree; once a group has
its N items, every run jumps to its next group.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


class LoserTree:
    """Merges sorted runs; each inner node remembers the loser of its match, the winner goes up.

    ``keys[r]`` is the sorted list of run r; ``at[r]`` is its cursor. A run that
    is used up loses against all others; of equal keys the lower run wins.
    """

    def __init__(self, keys: list[list]):
        self.keys, self.at, self.k = keys, [0] * len(keys), len(keys)
        self.losers = [-1] * self.k
        self.winner = self._play(1) if self.k > 1 else 0

    def _beats(self, a: int, b: int) -> bool:
        ka, kb = self.keys[a], self.keys[b]
        if self.at[a] >= len(ka):
            return False
        if self.at[b] >= len(kb):
            return True
        x, y = ka[self.at[a]], kb[self.at[b]]
        return x < y or (x == y and a < b)

    def _play(self, node: int) -> int:
        if node >= self.k:
            return node - self.k
        a, b = self._play(2 * node), self._play(2 * node + 1)
        won, lost = (a, b) if self._beats(a, b) else (b, a)
        self.losers[node] = lost
        return won

    def head(self):
        """The least key of all, or None at the end."""
        w = self.winner
        return self.keys[w][self.at[w]] if self.at[w] < len(self.keys[w]) else None

    def move(self, to: int) -> None:
        """Sets the winning run's cursor and replays its matches up to the root."""
        w = self.winner
        self.at[w] = to
        node = (w + self.k) // 2
        while node >= 1:
            if self._beats(self.losers[node], w):
                self.losers[node], w = w, self.losers[node]
            node //= 2
        self.winner = w


def merge_top(runs: list[list[tuple]], ends: list[list[int]], n: int) -> Iterator[tuple]:
    """(group, item, score, rank) from runs of (group, -score, item).

    ``ends[r][i]`` is where the group of row i of run r ends. An item that comes
    again in its group has a lower or equal score there and is passed over.
    """
    tree, group, seen = LoserTree(runs), None, set()
    while (key := tree.head()) is not None:
        w = tree.winner
        i = tree.at[w]
        if group is None or key[0] != group:
            group, seen = key[0], set()
        if len(seen) >= n:
            tree.move(ends[w][i])
            continue
        if key[2] not in seen:
            seen.add(key[2])
            yield key[0], key[2], -key[1], len(seen)
        tree.move(i + 1)


def _cut_run(n: int):
    """Of rows sorted by group, falling score and item: the first n distinct items of each group."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        group, seen = None, set()
        for b in batches:
            keep = []
            for g, x in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                if g != group:
                    group, seen = g, set()
                new = len(seen) < n and x not in seen
                if new:
                    seen.add(x)
                keep.append(new)
            yield b.filter(pa.array(keep))

    return run


def _merge_bucket(n: int):
    """Rows of one partition, sorted by bucket, run and the run's order; a bucket is merged when all its rows are there."""

    def merge(runs: list[list[tuple]]) -> Iterator[tuple]:
        ends = []
        for r in runs:
            end = [len(r)] * len(r)
            for i in range(len(r) - 2, -1, -1):
                end[i] = end[i + 1] if r[i][0] == r[i + 1][0] else i + 1
            ends.append(end)
        return merge_top(runs, ends, n)

    def batch(rows: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), (pa.string(), pa.string(), pa.float64(), pa.int32()))], ["group_key", "item", "score", "rank"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bucket, number, runs, out = None, None, [], []
        for b in batches:
            for g, x, score, r, k in zip(*(b.column(i).to_pylist() for i in range(5))):
                if k != bucket:
                    out += merge(runs) if runs else ()
                    bucket, number, runs = k, None, []
                if r != number:
                    number = r
                    runs.append([])
                runs[-1].append((g, -score, x))
            if len(out) >= 10_000:
                yield batch(out)
                out = []
        out += merge(runs) if runs else ()
        if out:
            yield batch(out)

    return run


def top_per_group(df: DataFrame, group_col: str, item_col: str, score_col: str, n: int = 5, buckets: int = 1 << 20) -> DataFrame:
    """(group_key, item, score, rank): for each group its n items of highest score.

    Left out are rows with a null group or item, a null or NaN score, or an item
    equal to its group. A pair with several rows has its highest score. Of equal
    scores the smaller item (by bytes) comes first; -0.0 equals 0.0. A group
    with fewer items gives all of them. Empty input gives no rows.

    ``buckets`` is the number of merge units. A task holds one unit at a time,
    the cut runs of (groups / buckets) groups, so there should be many.
    """
    score = F.col(score_col).cast("double") + F.lit(0.0)
    rows = df.select(F.col(group_col).alias("g"), F.col(item_col).alias("x"), score.alias("score"))
    rows = rows.where(F.col("g").isNotNull() & F.col("x").isNotNull() & F.col("score").isNotNull() & ~F.isnan("score") & (F.col("g") != F.col("x")))
    order = [F.col("g"), F.col("score").desc(), F.col("x")]
    runs = rows.sortWithinPartitions(*order).mapInArrow(_cut_run(n), "g string, x string, score double").withColumn("run", F.spark_partition_id()).withColumn("bucket", F.pmod(F.xxhash64("g"), F.lit(buckets)).cast("int"))
    bucketed = runs.repartition("bucket").sortWithinPartitions("bucket", "run", *order)
    return bucketed.mapInArrow(_merge_bucket(n), "group_key string, item string, score double, rank int")

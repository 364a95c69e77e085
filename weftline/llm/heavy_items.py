"""The most frequent items of a huge column, by combinatorial group testing.

Every row falls into one bucket of each of ``depth`` hash rows. A bucket keeps
its number of rows and, for each of the 64 bits of the item's hash, the number
of rows that have the bit set. Where one item makes up more than half of a
bucket, the majorities of the bits spell out its hash. Sketches are linear:
those of partitions are added, and counters of known items can be taken off.

Decoded hashes are verified by counting their rows exactly. A missing item of
at least the threshold would sit, in every hash row, in a bucket that still
holds that many unexplained rows; if some hash row has no such bucket, nothing
is missing. Otherwise decoding goes on after the known items are taken off,
and, if need be, with a wider sketch.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weftline.plans.shared import least_count

BITS = 64
WORD = (1 << 64) - 1


def _mix(x: np.ndarray, seed: int) -> np.ndarray:
    """A 64-bit mix of hashes; another seed gives another hash row."""
    z = x + np.uint64((seed * 0x9E3779B97F4A7C15 + 0x632BE59BD9B4E019) & WORD)
    z = (z ^ (z >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    z = (z ^ (z >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return z ^ (z >> np.uint64(31))


def buckets_of(hashes: np.ndarray, row: int, width: int) -> np.ndarray:
    return (_mix(hashes, row) % np.uint64(width)).astype(np.int64)


#: Buckets of a hash row that a sketch has at most.
MOST_BUCKETS = 1 << 16


class GroupTestSketch:
    """counts[row, bucket, 0] is the total, counts[row, bucket, 1 + i] that of bit i."""

    def __init__(self, depth: int, width: int, counts: np.ndarray | None = None):
        self.depth, self.width = depth, width
        self.counts = np.zeros((depth, width, BITS + 1), dtype=np.int64) if counts is None else counts

    def add(self, hashes: np.ndarray, weights: np.ndarray | None = None) -> None:
        """Equal hashes of a batch are counted first, so bits are added up for distinct items only."""
        items, n = np.unique(hashes, return_counts=True)
        if weights is not None:
            items, at = np.unique(hashes, return_inverse=True)
            n = np.bincount(at, weights=weights, minlength=len(items)).astype(np.int64)
        bits = np.unpackbits(items.astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        parts = np.empty((len(items), BITS + 1), dtype=np.int64)
        parts[:, 0] = n
        np.multiply(bits, n[:, None], out=parts[:, 1:])
        for row in range(self.depth):
            at = buckets_of(items, row, self.width)
            order = np.argsort(at, kind="stable")
            where, first = np.unique(at[order], return_index=True)
            self.counts[row, where] += np.add.reduceat(parts[order], first, axis=0) if len(items) else 0

    def decode(self, least: int) -> np.ndarray:
        """Hashes spelt out by buckets of at least ``least`` rows that fall into the bucket they are read from."""
        found = []
        for row in range(self.depth):
            full = np.nonzero(self.counts[row, :, 0] >= least)[0]
            totals, ones = self.counts[row, full, 0], self.counts[row, full, 1:]
            bits = (2 * ones > totals[:, None]).astype(np.uint8)
            hashes = np.packbits(bits, axis=1, bitorder="little").view("<u8").reshape(-1).astype(np.uint64)
            found.append(hashes[buckets_of(hashes, row, self.width) == full])
        return np.unique(np.concatenate(found)) if found else np.array([], dtype=np.uint64)

    def complete(self, least: int) -> bool:
        """Whether some hash row has no bucket with ``least`` unexplained rows."""
        return bool((self.counts[:, :, 0] < least).all(axis=1).any())


def _sketch_partition(depth: int, width: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sketch, kept, size = GroupTestSketch(depth, width), [], 0
        for b in batches:
            kept.append(b.column(0).to_numpy(zero_copy_only=False).view(np.uint64))
            size += len(b)
            if size >= 1 << 18:
                sketch.add(np.concatenate(kept))
                kept, size = [], 0
        if kept:
            sketch.add(np.concatenate(kept))
        flat = sketch.counts.reshape(depth * width, BITS + 1)
        used = np.nonzero(flat[:, 0])[0]
        if len(used):
            values = pa.ListArray.from_arrays(pa.array(np.arange(len(used) + 1, dtype=np.int32) * (BITS + 1)), pa.array(flat[used].reshape(-1)))
            yield pa.RecordBatch.from_arrays([pa.array(used.astype(np.int32)), values], ["bucket", "counters"])

    return run


def sketch_column(hashed: DataFrame, depth: int, width: int) -> GroupTestSketch:
    """The sketch of a one-column frame of hashes: one partial sketch a partition, added bucket by bucket.

    What reaches the driver is the one sketch, of depth * width * 65 numbers.
    """
    parts = hashed.mapInArrow(_sketch_partition(depth, width), "bucket int, counters array<long>")
    added = parts.groupBy("bucket").agg(F.array(*[F.sum(F.col("counters")[i]) for i in range(BITS + 1)]).alias("counters"))
    counts = np.zeros((depth * width, BITS + 1), dtype=np.int64)
    for r in added.toArrow().to_batches():
        if len(r):
            counts[r.column(0).to_numpy()] = r.column(1).flatten().to_numpy().reshape(-1, BITS + 1)
    return GroupTestSketch(depth, width, counts.reshape(depth, width, BITS + 1))


def frequent_items(df: DataFrame, item_col: str, share: float = 0.005, depth: int = 3, width: int = 512) -> DataFrame:
    """(item, n_rows, share_of_rows) of all items with at least ``share`` of the rows whose item is not null.

    Every row counts, repeated rows too. Memory is that of the sketch, however
    many distinct items there are; ``width`` (about 2.5 / share is enough for most
    data) is doubled only when a round leaves something undecided, up to
    ``MOST_BUCKETS`` (about 100 MB); beyond it there is an error, never a short result. Counts are exact. A null item is no item. Empty input gives no rows.
    """
    spark = df.sparkSession
    column = df.where(F.col(item_col).isNotNull()).select(F.col(item_col).cast("string").alias("item"))
    hashed = column.select(F.xxhash64("item").alias("h"))
    total, exact, known = None, None, np.array([], dtype=np.uint64)
    while True:
        sketch = sketch_column(hashed, depth, width)
        total = int(sketch.counts[0, :, 0].sum())
        least = max(1, least_count(total, share))
        rest = GroupTestSketch(depth, width, sketch.counts.copy())
        while True:
            new = np.setdiff1d(rest.decode(least), known)
            if exact is None or len(new):
                known = np.union1d(known, new)
                exact = _verify(spark, column, known)
            rest = GroupTestSketch(depth, width, sketch.counts.copy())
            if exact:
                hashes = np.array([h for _, h, _ in exact], dtype=np.int64).view(np.uint64)
                rest.add(hashes, -np.array([n for _, _, n in exact], dtype=np.int64))
            if total == 0 or rest.complete(least) or not len(new):
                break
        if total == 0 or rest.complete(least):
            break
        width *= 2
        if width > MOST_BUCKETS:
            raise RuntimeError(f"a sketch of {MOST_BUCKETS} buckets a hash row leaves items undecided: raise the share")
    rows = [(x, n, n / total) for x, _, n in exact if n >= least]
    return spark.createDataFrame(rows, "item string, n_rows long, share_of_rows double")


def _verify(spark, column: DataFrame, hashes: np.ndarray) -> list[tuple[str, int, int]]:
    """(item, hash, rows) of the items with these hashes. There are at most depth * width hashes a round, so their table is broadcast."""
    table = spark.createDataFrame([(int(h),) for h in hashes.view(np.int64)], "h long")
    counted = column.withColumn("h", F.xxhash64("item")).join(F.broadcast(table), "h").groupBy("item", "h").agg(F.count(F.lit(1)).alias("n"))
    return [(r.item, r.h, r.n) for r in counted.collect()]

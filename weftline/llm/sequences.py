"""Frequent subsequences with gaps, mined on sequence decision diagrams.

A set's events, in time order, become a sequence of tokens. Equal sequences are
counted, and each task compresses its share into a shared directed acyclic
graph: a node (token, lo, hi) holds the sequences that begin with the token
(hi, without it) and those that don't (lo); equal parts exist once; leaves hold
how many sequences end there. For each prefix item the conditional diagram (what
follows its first occurrence) is pushed through the graph, and results of equal
subproblems are looked up, not computed again. Supports of different tasks add
up, since a set is in one task; a pattern grows only from frequent patterns.

What a task holds is bounded by numbers, not by shares of the data: sets of many
rows are thinned in time ranges first, a diagram takes sequences up to a weight,
very long sequences share nothing and are walked one by one, and candidates are
tried in portions.
"""

from __future__ import annotations

import sys
from bisect import bisect_right
from collections import defaultdict
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weftline.operators.skew import detect_heavy_keys, skew_join
from weftline.plans.instants import micros
from weftline.plans.ranking import global_positions
from weftline.plans.shared import Cut, least_count

#: Entries (half the squared lengths of its sequences) that the supports of one diagram may have; a task with more builds several, one after the other.
DIAGRAM_ENTRIES = 8_000_000
#: A sequence of more tokens than this is walked on its own.
LONG_TOKENS = 400
#: A set with more rows than this is thinned in time ranges first.
HEAVY_ROWS = 20_000
#: So many heavy sets, or nodes with codes, are broadcast at most; beyond it every set is thinned, and codes are joined by shuffle.
MOST_BROADCAST = 50_000
#: Candidates (a pattern and the item to follow it) that go to the tasks at once.
MOST_CANDIDATES = 200_000


class Diagram:
    """Hash-consed nodes of weighted sequences. Node 0 is the empty multiset.

    A token is ``2 * item + tie``; ``tie`` says that the next token has the same
    time, so it can't follow this one in a pattern.
    """

    def __init__(self):
        self.tok, self.lo, self.hi, self.total = [-1], [0], [0], [0]
        self.unique: dict[tuple[int, int, int], int] = {}
        self.leaves: dict[int, int] = {0: 0}
        self._after: dict[int, dict[int, int]] = {}
        self._conditional: dict[int, dict[int, dict[int, int]]] = {}
        self._supports: dict[int, dict[int, int]] = {}

    def leaf(self, weight: int) -> int:
        """The empty sequence, ``weight`` times."""
        if weight not in self.leaves:
            self.leaves[weight] = self._new(-1, 0, 0, weight)
        return self.leaves[weight]

    def node(self, tok: int, lo: int, hi: int) -> int:
        if hi == 0:
            return lo
        key = (tok, lo, hi)
        if key not in self.unique:
            self.unique[key] = self._new(tok, lo, hi, self.total[lo] + self.total[hi])
        return self.unique[key]

    def _new(self, tok: int, lo: int, hi: int, total: int) -> int:
        self.tok.append(tok)
        self.lo.append(lo)
        self.hi.append(hi)
        self.total.append(total)
        return len(self.tok) - 1

    def build(self, sequences: list[tuple[tuple[int, ...], int]]) -> int:
        """The diagram of (sequence, weight) pairs, which are sorted by sequence and distinct."""
        path: list[int] = []
        kids: list[list[tuple[int, int]]] = [[]]
        ends = [0]

        def close() -> int:
            out = self.leaf(ends.pop())
            for tok, child in reversed(kids.pop()):
                out = self.node(tok, out, child)
            return out

        for seq, weight in sequences:
            same = 0
            while same < len(path) and same < len(seq) and path[same] == seq[same]:
                same += 1
            while len(path) > same:
                done = close()
                kids[-1].append((path.pop(), done))
            for tok in seq[same:]:
                path.append(tok)
                kids.append([])
                ends.append(0)
            ends[-1] += weight
        while path:
            done = close()
            kids[-1].append((path.pop(), done))
        return close()

    def after(self, p: int) -> dict[int, int]:
        """What may follow the first token of node p, as nodes and how often: its hi part, or, inside an element, what is left once the element has ended."""
        if not self.tok[p] & 1:
            return {self.hi[p]: 1}
        out = self._after.get(p)
        if out is None:
            out = self._after[p] = defaultdict(int)
            q = self.hi[p]
            while self.tok[q] != -1:
                for r, n in self.after(q).items():
                    out[r] += n
                q = self.lo[q]
        return out

    def conditional(self, p: int) -> dict[int, dict[int, int]]:
        """For each item, its conditional diagram: the nodes that follow the element of its first occurrence, and how often.

        Parts stay where they are in the graph; a conditional diagram only points at them.
        """
        out = self._conditional.get(p)
        if out is None:
            out = self._conditional[p] = defaultdict(lambda: defaultdict(int))
            stack = [(p, 0)]
            while stack:
                q, seen = stack.pop()
                while self.tok[q] != -1:
                    bit = 1 << (self.tok[q] >> 1)
                    if not seen & bit:
                        at = out[self.tok[q] >> 1]
                        for r, n in self.after(q).items():
                            at[r] += n
                    if self.tok[self.hi[q]] != -1:
                        stack.append((self.hi[q], seen | bit))
                    q = self.lo[q]
        return out

    def supports(self, p: int) -> dict[int, int]:
        """For each item, the weight of the sequences that hold it."""
        if self.tok[p] == -1:
            return {}
        out = self._supports.get(p)
        if out is None:
            out = dict(self.supports(self.hi[p]))
            out[self.tok[p] >> 1] = self.total[self.hi[p]]
            for x, n in self.supports(self.lo[p]).items():
                out[x] = out.get(x, 0) + n
            self._supports[p] = out
        return out


def walk_supports(seq: tuple[int, ...], weight: int, tree: dict | None, distinct: bool, out: dict[tuple[int, ...], int]) -> None:
    """Adds what one sequence supports, as ``local_supports`` counts it, by leftmost matches; holds its events once."""
    places: dict[int, list[int]] = defaultdict(list)
    element = 0
    for tok in seq:
        places[tok >> 1].append(element)
        element += not tok & 1
    if tree is None:
        for a, at in places.items():
            for b, other in places.items():
                if other[-1] > at[0] and not (distinct and a == b):
                    out[a, b] += weight
        return
    stack = [(-1, tree, ())]
    while stack:
        end, at, prefix = stack.pop()
        for x, deeper in at.items():
            if x is None:
                for y in deeper:
                    if y in places and places[y][-1] > end:
                        out[(*prefix, y)] += weight
            elif x in places and places[x][-1] > end:
                stack.append((places[x][bisect_right(places[x], end)], deeper, (*prefix, x)))


def prefix_tree(prefixes: dict[tuple[int, ...], set[int]]) -> dict:
    """Prefixes by their items, one level an item; at None the items to try."""
    tree: dict = {}
    for prefix, items in prefixes.items():
        at = tree
        for x in prefix:
            at = at.setdefault(x, {})
        at[None] = items
    return tree


def local_supports(sequences: dict[tuple[int, ...], int], prefixes: dict[tuple[int, ...], set[int]] | None, distinct: bool) -> dict[tuple[int, ...], int]:
    """Supports, within these sequences, of patterns one longer than the prefixes.

    ``prefixes`` gives for each prefix the items worth trying; None means every single item with every other.
    """
    if sys.getrecursionlimit() < 200_000:
        sys.setrecursionlimit(200_000)
    dd = Diagram()
    root = dd.build(sorted(sequences.items()))
    out: dict[tuple[int, ...], int] = defaultdict(int)
    if prefixes is None:
        for a, nodes in dd.conditional(root).items():
            for d, times in nodes.items():
                for b, n in dd.supports(d).items():
                    if not (distinct and a == b):
                        out[a, b] += n * times
        return out
    tree = prefix_tree(prefixes)

    def push(nodes: dict[int, int], at: dict, prefix: tuple[int, ...]) -> None:
        deeper: dict[int, dict[int, int]] = defaultdict(lambda: defaultdict(int))
        wanted = at.get(None, ())
        for d, times in nodes.items():
            if wanted:
                for x, n in dd.supports(d).items():
                    if x in wanted:
                        out[(*prefix, x)] += n * times
            if len(at) > (None in at):
                for x, follow in dd.conditional(d).items():
                    if x in at:
                        for r, n in follow.items():
                            deeper[x][r] += n * times
        for x, follow in deeper.items():
            push(follow, at[x], (*prefix, x))

    push({root: 1}, tree, ())
    return out


def _mine_partition(prefixes: dict[tuple[int, ...], set[int]] | None, distinct: bool):
    wanted = None if prefixes is None else {x for p, xs in prefixes.items() for x in (*p, *xs)}

    def thin(seq: list[int]) -> tuple[int, ...]:
        """Without items that no prefix needs; the tie of what stays follows from the elements."""
        if wanted is None:
            return tuple(seq)
        out: list[int] = []
        open_tie = False
        for tok in seq:
            if tok >> 1 in wanted:
                if out and open_tie:
                    out[-1] |= 1
                out.append(tok & ~1)
                open_tie = bool(tok & 1)
            elif not tok & 1:
                open_tie = False
        return tuple(out)

    tree = None if prefixes is None else prefix_tree(prefixes)

    def batch(found: dict[tuple[int, ...], int]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(list(found), pa.list_(pa.int32())), pa.array(list(found.values()), pa.int64())], ["pattern", "n"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sequences: dict[tuple[int, ...], int] = defaultdict(int)
        long: dict[tuple[int, ...], int] = defaultdict(int)
        entries = 0
        for b in batches:
            for seq, n in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                if len(seq := thin(seq)) > LONG_TOKENS:
                    walk_supports(seq, n, tree, distinct, long)
                elif len(seq) > 1:
                    entries += 0 if seq in sequences else len(seq) ** 2 // 2
                    sequences[seq] += n
                    if entries >= DIAGRAM_ENTRIES:
                        yield batch(local_supports(sequences, prefixes, distinct))
                        sequences, entries = defaultdict(int), 0
            if len(long) >= MOST_CANDIDATES:
                yield batch(long)
                long = defaultdict(int)
        if sequences:
            yield batch(local_supports(sequences, prefixes, distinct))
        if long:
            yield batch(long)

    return run


class Thinner:
    """Keeps of a long series of events what patterns of up to ``max_len`` steps need.

    Kept are the first event of each item, then (level by level, ``max_len - 1``
    times) its first event after each event kept before, and its last event.
    Leftmost matches use nothing else. A series cut in time ranges may be
    thinned range by range, and again when the ranges come together.
    """

    def __init__(self, max_len: int):
        self.levels = max(1, max_len - 1)
        self.passed = [0] * self.levels
        self.passed[0] = 1
        self.fresh = [0] * self.levels
        self.seen = [dict() for _ in range(self.levels)]
        self.now = None
        self.last: dict[int, int] = {}
        self.kept: set[tuple[int, int]] = set()

    def feed(self, t: int, item: int) -> bool:
        """Events come in order of time. Whether this one is kept for its first occurrence."""
        if t != self.now:
            for k in range(self.levels):
                self.passed[k] += self.fresh[k]
                self.fresh[k] = 0
            self.now = t
        keep = False
        for k in range(self.levels):
            if self.seen[k].get(item, 0) < self.passed[k]:
                self.seen[k][item] = self.passed[k]
                keep = True
                if k + 1 < self.levels:
                    self.fresh[k + 1] = 1
        self.last[item] = t
        if keep:
            self.kept.add((t, item))
        return keep

    def rest(self) -> list[tuple[int, int]]:
        """The last events that weren't kept yet."""
        return [(t, x) for x, t in self.last.items() if (t, x) not in self.kept]


def _thin_partition(max_len: int):
    """Rows (s, t, code) sorted by s and t; sets that go on in another partition are thinned there on their own."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        current, thinner = None, None
        for b in batches:
            out: list[tuple[str, int, int]] = []
            for s, t, x in zip(*(b.column(i).to_pylist() for i in range(3))):
                if s != current:
                    if thinner:
                        out += [(current, u, y) for u, y in thinner.rest()]
                    current, thinner = s, Thinner(max_len)
                if thinner.feed(t, x):
                    out.append((s, t, x))
            yield _rows(out)
        if thinner:
            yield _rows([(current, u, y) for u, y in thinner.rest()])

    return run


def _rows(rows: list[tuple[str, int, int]]) -> pa.RecordBatch:
    s, t, x = zip(*rows) if rows else ((), (), ())
    return pa.RecordBatch.from_arrays([pa.array(s, pa.string()), pa.array(t, pa.int64()), pa.array(x, pa.int32())], ["s", "t", "code"])


def _coded(timed: DataFrame, least: int) -> tuple[DataFrame, DataFrame, bool]:
    """(events (s, t, code), codes (node, code), whether codes are few) of the nodes with ``least`` rows or more, numbered in byte order."""
    frequent = timed.groupBy("node").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= least).select("node")
    codes = Cut(global_positions(frequent, [F.col("node")], "code").select("node", (F.col("code") - 1).cast("int").alias("code")), "codes").df
    few = codes.count() <= MOST_BROADCAST
    if few:
        events = timed.join(F.broadcast(codes), "node")
    else:
        hot = detect_heavy_keys(timed, ["node"]).table(timed.sparkSession).select(F.col("key_value").alias("node"))
        events = skew_join(timed, codes, ["node"], hot)
    return events.select("s", micros(timed, "t").alias("t"), "code"), codes, few


def _thinned(events: DataFrame, length: int) -> DataFrame:
    """Events of which sets with more than ``HEAVY_ROWS`` rows keep only what patterns need."""
    hot = events.groupBy("s").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > HEAVY_ROWS).select("s")
    found = hot.limit(MOST_BROADCAST + 1).collect()
    thin = lambda rows: rows.repartitionByRange("s", "t").sortWithinPartitions("s", "t").mapInArrow(_thin_partition(length), "s string, t long, code int")
    if not found:
        return events
    if len(found) > MOST_BROADCAST:
        return thin(events)
    hot = events.sparkSession.createDataFrame(found, hot.schema)
    return events.join(F.broadcast(hot), "s", "left_anti").unionByName(thin(events.join(F.broadcast(hot), "s", "left_semi")))


def _candidates(mined: DataFrame, k: int, distinct: bool) -> DataFrame:
    """(pattern, item) of patterns of ``k`` items and items that may follow them: every part of ``k`` items of the longer pattern is frequent."""
    left = mined.select("pattern", F.slice("pattern", 1, k - 1).alias("head"))
    right = mined.select(F.slice("pattern", 1, k - 1).alias("head"), F.col("pattern")[k - 1].alias("item"))
    met = left.join(right, "head").drop("head")
    if distinct:
        met = met.where(~F.array_contains("pattern", F.col("item")))
    for i in range(k - 1):
        rest = F.concat(*([F.slice("pattern", 1, i)] if i else []), F.slice("pattern", i + 2, k - 1 - i), F.array("item"))
        met = met.withColumn("rest", rest).join(mined.select(F.col("pattern").alias("rest")), "rest", "left_semi").drop("rest")
    return met


def frequent_subsequences(
    df: DataFrame, set_col: str = "set_id", node_col: str = "node_id", time_col: str = "sort_column", min_count: int = 1, min_share: float = 0.0, length: int = 3, distinct: bool = True
) -> DataFrame:
    """(step_1 .. step_length, n_sets): patterns of ``length`` items that enough sets run through in order, others between allowed.

    A set supports a pattern when it has rows of its items with strictly rising
    times. Kept are patterns of at least ``min_count`` sets and ``min_share`` of
    the sets that have a row with set and node not null. ``distinct`` asks for
    different items. Rows without set, node or time take no part; repeated rows
    change nothing; rows of equal time have no order. Empty input: no rows.
    Jobs for all lengths but the last run while the plan is built; nothing but
    counts and portions of ``MOST_CANDIDATES`` candidates reaches the driver.
    """
    if length < 2:
        raise ValueError("length must be at least 2")
    spark = df.sparkSession
    there = df.where(F.col(set_col).isNotNull() & F.col(node_col).isNotNull())
    n_sets = there.select(set_col).distinct().count()
    least = max(min_count, least_count(n_sets, min_share), 1)
    timed = there.where(F.col(time_col).isNotNull()).select(F.col(set_col).cast("string").alias("s"), F.col(node_col).cast("string").alias("node"), F.col(time_col).alias("t"))
    events, codes, few = _coded(timed, least)
    series = _thinned(events, length).groupBy("s").agg(F.array_sort(F.collect_set(F.struct("t", "code"))).alias("e"))
    token = lambda x, i: x["code"] * 2 + F.when(F.try_element_at("e", i + 2)["t"] == x["t"], 1).otherwise(0)
    sequences = Cut(series.where(F.size("e") >= length).select(F.transform("e", token).alias("seq")).groupBy("seq").agg(F.count(F.lit(1)).alias("n")), "sequences")
    tasks = max(int(spark.conf.get("spark.sql.shuffle.partitions")), spark.sparkContext.defaultParallelism)
    spread = sequences.df.repartition(tasks)

    def count(portions: list[dict[tuple[int, ...], set[int]] | None]) -> DataFrame:
        found = [spread.mapInArrow(_mine_partition(p, distinct), "pattern array<int>, n long") for p in portions]
        whole = found[0]
        for part in found[1:]:
            whole = whole.unionByName(part)
        return whole.groupBy("pattern").agg(F.sum("n").alias("n")).where(F.col("n") >= least)

    mined = count([None])
    for k in range(2, length):
        before = Cut(mined, "patterns")
        tried = Cut(_candidates(before.df.select("pattern"), k, distinct), "candidates")
        portions = []
        n_portions = -(-tried.df.count() // MOST_CANDIDATES)
        for i in range(n_portions):
            follows: dict[tuple[int, ...], set[int]] = defaultdict(set)
            for r in tried.df.where(F.pmod(F.xxhash64("pattern", "item"), F.lit(n_portions)) == i).toLocalIterator():
                follows[tuple(r.pattern)].add(r.item)
            portions.append(dict(follows))
        mined = count(portions or [{}])
        before.drop()
        tried.drop()
    hint = F.broadcast if few else (lambda x: x)
    for i in range(length):
        mined = mined.withColumn(f"_c{i}", F.col("pattern")[i]).join(hint(codes.select(F.col("node").alias(f"step_{i + 1}"), F.col("code").alias(f"_c{i}"))), f"_c{i}")
    return mined.select(*[f"step_{i + 1}" for i in range(length)], F.col("n").alias("n_sets"))

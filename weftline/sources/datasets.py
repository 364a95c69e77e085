"""Small known data sets, and generators of any size.

Generated values come from hashes of the seed and the row number, so rows are
made where they are needed, in any number of tasks, and are the same each time.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# The literal data sets.
RETAIL = """
O1,iPhone 15,2024-01-01 10:00:00
O1,Silicone Case,2024-01-01 10:00:05
O2,iPhone 15,2024-01-01 11:00:00
O2,Silicone Case,2024-01-01 11:00:10
O3,iPhone 15,2024-01-01 12:00:00
O3,Screen Protector,2024-01-01 12:00:15
O4,Pasta,2024-01-02 09:00:00
O4,Tomato Sauce,2024-01-02 09:00:05
O5,Pasta,2024-01-02 10:00:00
O5,Tomato Sauce,2024-01-02 10:00:10
O5,Parmesan,2024-01-02 10:00:20
O6,Whole Milk,2024-01-03 08:00:00
O6,Oat Cereal,2024-01-03 08:00:10
O7,Whole Milk,2024-01-03 09:00:00
O7,Oat Cereal,2024-01-03 09:00:15
O8,Oat Cereal,2024-01-03 10:00:00
O8,Banana,2024-01-03 10:00:05
"""
PLAYLISTS = """
Playlist_1,Stairway to Heaven
Playlist_1,Comfortably Numb
Playlist_2,Stairway to Heaven
Playlist_2,Whole Lotta Love
Playlist_3,Comfortably Numb
Playlist_3,Wish You Were Here
Playlist_4,So What
Playlist_4,Blue in Green
Playlist_5,So What
Playlist_5,Giant Steps
Playlist_6,Blue in Green
Playlist_6,My Favorite Things
Playlist_Bridge,Wish You Were Here
Playlist_Bridge,So What
"""
HEADLINES = """
S1,Economy,1
S1,Interest Rates,2
S1,Inflation,3
S2,Economy,1
S2,Interest Rates,2
S2,Recession,3
S3,Federal Reserve,1
S3,Interest Rates,2
S3,Economy,3
S4,Tech,1
S4,AI,2
S4,Silicon Valley,3
S5,Tech,1
S5,AI,2
S5,Nvidia,3
S6,Generative AI,1
S6,AI,2
S6,GPU,3
S7,AI,1
S7,Economy,2
S7,Jobs,3
"""
GAMES = """
P1,Mario
P1,Zelda
P2,Zelda
P2,Metroid
P3,Metroid
P3,Mario
P4,Halo
P4,CoD
P5,CoD
P5,Battlefield
P6,Battlefield
P6,Halo
"""
CHAINS = [(["A", "B", "C"], 0.8), (["D", "E"], 0.9), (["F", "G", "H", "I"], 0.7)]


def _lines(text: str) -> list[list[str]]:
    return [line.split(",") for line in text.strip().splitlines()]


def uniform(seed: int, salt: str, *parts: Column) -> Column:
    """A number in [0, 1) fixed by the seed, the salt and the parts."""
    return F.pmod(F.xxhash64(F.lit(seed), F.lit(salt), *parts), F.lit(1 << 52)) / F.lit(float(1 << 52))


def below(n: int, seed: int, salt: str, *parts: Column) -> Column:
    """A whole number in [0, n)."""
    return F.floor(uniform(seed, salt, *parts) * n).cast("int")


def _pick(options: list[str], at: Column) -> Column:
    return F.element_at(F.array(*[F.lit(o) for o in options]), at + 1)


def retail_transactions(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([tuple(x) for x in _lines(RETAIL)], "order_id string, item_name string, timestamp string")


def benchmark_patterns(spark: SparkSession) -> DataFrame:
    """550 rows: a pair bought 50 times in each of two orders, a triple in 50 orders, a single item in 200."""
    rows = [(o, i) for _ in range(50) for o in ("T1_a", "T1_b") for i in ("Beer", "Diaper")]
    rows += [(f"T2_{k}", i) for k in range(50) for i in ("Milk", "Bread", "Butter")] + [(f"T3_{k}", "Coke") for k in range(200)]
    return spark.createDataFrame(rows, "order_id string, item_id string")


def playlists(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([tuple(x) for x in _lines(PLAYLISTS)], "playlist_id string, song_name string")


def headlines(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([(s, t, int(k)) for s, t, k in _lines(HEADLINES)], "sentence_id string, token string, pos int")


def filter_bubble(spark: SparkSession) -> DataFrame:
    """Two closed groups of games, 50 times each session, and five users who lead into one of them."""
    rows = [(u, g) for _ in range(50) for u, g in _lines(GAMES)]
    rows += [(f"Bridge_User_{i}", g) for i in range(5) for g in ("Generic_Game", "Mario")]
    return spark.createDataFrame(rows, "user_id string, game_title string")


def genomics(spark: SparkSession, n_patients: int = 500, n_genes: int = 100, n_mutations: int = 1000, seed: int = 42) -> DataFrame:
    """Two genes that up to 100 patients share, and random mutations of all patients in turn."""
    patient = lambda c: F.concat(F.lit("Patient_"), c.cast("string")).alias("sample_id")
    strong = spark.range(min(100, n_patients)).select(patient(F.col("id")), F.explode(F.array(F.lit("BRCA1"), F.lit("TP53"))).alias("gene_id"))
    noise = spark.range(n_mutations).select(patient(F.col("id") % n_patients), F.concat(F.lit("Gene_"), below(n_genes, seed, "gene", F.col("id")).cast("string")).alias("gene_id"))
    return strong.unionByName(noise)


def large_scale(spark: SparkSession, n_transactions: int = 100_000, n_items: int = 1_000, density: int = 8, seed: int = 42) -> DataFrame:
    """``density`` rows an order; four fifths of them on the first fifth of the items."""
    popular = max(1, n_items // 5)
    hit = uniform(seed, "side", F.col("id")) < (0.8 if n_items > popular else 1.1)
    item = F.when(hit, below(popular, seed, "top", F.col("id"))).otherwise(F.lit(popular) + below(max(1, n_items - popular), seed, "tail", F.col("id")))
    return spark.range(n_transactions * density).select(F.concat(F.lit("T"), F.floor(F.col("id") / density).cast("string")).alias("order_id"), F.concat(F.lit("I"), item.cast("string")).alias("item_id"))


def three_groups(spark: SparkSession, nodes: int = 20, transient: int = 10, baskets: int = 500, seed: int = 42) -> tuple[DataFrame, dict]:
    """(basket_id, product_id) of three closed groups, transient nodes with 20 baskets each into one group, and ten stray baskets; and what is in them."""
    b = F.col("id")
    group = F.floor(b / baskets).cast("int")
    size = below(3, seed, "size", b) + 2
    start, step = below(nodes, seed, "start", b), below(max(1, nodes // 4), seed, "step", b) + 1
    items = F.transform(F.sequence(F.lit(0), size - 1), lambda j: group * nodes + (start + j * step) % nodes)
    inner = spark.range(3 * baskets).select(b.alias("n"), F.explode(F.array_distinct(items)).alias("p"))
    t = F.floor(b / 20).cast("int")
    target = below(3, seed, "group", t) * nodes + (below(nodes, seed, "target", t) + below(3, seed, "which", b) * 3) % nodes
    bridges = spark.range(20 * transient).select((b + 3 * baskets).alias("n"), F.explode(F.array(F.lit(3 * nodes) + t, target)).alias("p"))
    side = below(3, seed, "side", b)
    strays = spark.range(10).select((b + 3 * baskets + 20 * transient).alias("n"), F.explode(F.array(side * nodes + below(nodes, seed, "a", b), (side + 1) % 3 * nodes + below(nodes, seed, "b", b))).alias("p"))
    rows = inner.unionByName(bridges).unionByName(strays).select(F.concat(F.lit("B"), F.col("n").cast("string")).alias("basket_id"), F.concat(F.lit("P"), F.col("p").cast("string")).alias("product_id"))
    facts = {"groups": [list(range(k * nodes, (k + 1) * nodes)) for k in range(3)], "transient": list(range(3 * nodes, 3 * nodes + transient)), "n_nodes": 3 * nodes + transient, "n_baskets": 3 * baskets + 20 * transient + 10}
    return rows, facts


def temporal_interactions(spark: SparkSession, n_weeks: int = 12, seed: int = 0) -> DataFrame:
    """15 sessions a week of two or three items of the phase's group (A-C, D-F, G-I), X in 40 %, an item of the phase before in 15 %."""
    s = F.col("id")
    week = F.floor(s / 15).cast("int")
    phase = F.least(F.floor(week / max(1, n_weeks // 3)).cast("int"), F.lit(2))
    letters = list("ABCDEFGHI")
    first, k = below(3, seed, "first", s), below(2, seed, "k", s) + 2
    own = F.transform(F.sequence(F.lit(0), k - 1), lambda j: _pick(letters, phase * 3 + (first + j) % 3))
    none = F.array().cast("array<string>")
    bridge = F.when(uniform(seed, "bridge", s) < 0.4, F.array(F.lit("X"))).otherwise(none)
    before = F.when((phase > 0) & (uniform(seed, "before", s) < 0.15), F.array(_pick(letters, F.greatest(phase - 1, F.lit(0)) * 3 + below(3, seed, "which", s)))).otherwise(none)
    day = week * 7 + below(7, seed, "day", s)
    rows = spark.range(15 * n_weeks).select(s, day.alias("day"), F.posexplode(F.concat(own, bridge, before)).alias("pos", "item_id"))
    minute = F.col("pos") * 5 + below(4, seed, "minute", s, F.col("pos"))
    time = F.timestamp_add("MINUTE", minute, F.timestamp_add("DAY", F.col("day"), F.lit("2024-01-01 00:00:00").cast("timestamp_ntz")))
    return rows.select(F.concat(F.lit("S"), F.lpad((s + 1).cast("string"), 4, "0")).alias("session_id"), "item_id", F.date_format(time, "yyyy-MM-dd HH:mm:ss").alias("timestamp"))


def directed_sequences(spark: SparkSession, n_trials: int = 100, seed: int = 0) -> DataFrame:
    """Trials of three chains; each step is taken with the chain's probability, else the trial ends."""
    s = F.col("id")
    which = below(len(CHAINS), seed, "chain", s)
    steps = F.element_at(F.array(*[F.array(*[F.lit(x) for x in c]) for c, _ in CHAINS]), which + 1)
    keep = F.element_at(F.array(*[F.lit(p) for _, p in CHAINS]), which + 1)
    taken = sum((F.when(F.lit(True), uniform(seed, "go", s, F.lit(k)) < keep).cast("int") * F.lit(1 << (3 - k)) for k in range(1, 4)), F.lit(0))
    length = F.when(taken < 4, 1).when(taken < 6, 2).when(taken < 7, 3).otherwise(4)
    rows = spark.range(n_trials).select(s, F.posexplode(F.slice(steps, F.lit(1), length)).alias("pos", "item_id"))
    hours = F.floor(s / 5) * 24 + below(24, seed, "hour", s)
    time = F.timestamp_add("MINUTE", F.col("pos") * 10, F.timestamp_add("HOUR", hours.cast("int"), F.lit("2024-03-01 00:00:00").cast("timestamp_ntz")))
    return rows.select(F.concat(F.lit("T"), F.lpad((s + 1).cast("string"), 3, "0")).alias("session_id"), "item_id", F.date_format(time, "yyyy-MM-dd HH:mm:ss").alias("timestamp"))

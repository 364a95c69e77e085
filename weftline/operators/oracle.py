"""SQL with the same results as the core queries, written from the definitions, row by row."""

from __future__ import annotations

from weftline.operators.views import SQL

FIELDS = ("node_id", "set_id")


def on(view: str, *ctes: str) -> str:
    return "WITH RECURSIVE i AS (" + SQL[view] + "), " + ", ".join(ctes)


TOTALS = "t AS (SELECT node_id, count(*) AS total FROM i GROUP BY 1)"
N_SETS = "n AS (SELECT count(DISTINCT set_id) AS n FROM i)"


def edges(least: int = 1) -> str:
    return f"e AS (SELECT a.node_id AS source, b.node_id AS target, count(*) AS weight FROM i a JOIN i b ON a.set_id = b.set_id AND a.node_id <> b.node_id GROUP BY 1, 2 HAVING count(*) >= {least})"


def seeds(names: list[str]) -> str:
    return ", ".join(f"'{s}'" for s in names)


def walk(names: list[str], depth: int, scored: str, rows: str = "i") -> str:
    """Simple paths from every seed row."""
    return (
        f"w(item, strength, depth, path) AS (SELECT node_id, 1.0::DOUBLE / count(*) OVER (), 0, [node_id] FROM {rows} WHERE node_id IN ({seeds(names)}) UNION ALL "
        f"SELECT s.target, w.strength * s.score, w.depth + 1, list_append(w.path, s.target) FROM w JOIN {scored} s ON w.item = s.source WHERE w.depth < {depth} AND NOT list_contains(w.path, s.target))"
    )


def integral(names: list[str], n: int, agg: str = "sum", exclude: bool = True, cols: str = "recommended_item total_strength min_hops reason", steps: str = "min(depth)") -> str:
    item, score, hops, reason = cols.split()
    out = f"AND item NOT IN ({seeds(names)})" if exclude else ""
    text = "array_to_string(path, ' -> ')"
    inner = f"SELECT item AS {item}, {agg}(strength) AS s, {steps} AS {hops}, first({text} ORDER BY round(strength, 12) DESC, {text}) AS {reason} FROM w WHERE depth > 0 {out} GROUP BY item"
    return f" SELECT {item}, round(s, 6) AS {score}, {hops}::INTEGER AS {hops}, {reason} FROM ({inner}) ORDER BY round(s, 9) DESC, {item} LIMIT {n}"


LAST_DEPTH = "first(depth ORDER BY round(strength, 12) DESC, array_to_string(path, ' -> '))"

ITEMSETS = (
    TOTALS + ", " + N_SETS + ", f1 AS (SELECT node_id AS itemset, total / n AS support, 1 AS length FROM t, n WHERE total / n >= 0.03), "
    "f2 AS (SELECT a.node_id || '|' || b.node_id AS itemset, count(*) / any_value(n) AS support, 2 AS length FROM i a JOIN i b ON a.set_id = b.set_id AND a.node_id < b.node_id, n "
    "WHERE a.node_id IN (SELECT itemset FROM f1) AND b.node_id IN (SELECT itemset FROM f1) GROUP BY 1 HAVING count(*) / any_value(n) >= 0.03)"
)
RULES = (
    ITEMSETS + ", r0 AS (SELECT split_part(itemset, '|', 1) AS x, split_part(itemset, '|', 2) AS y, support AS s FROM f2), r1 AS (SELECT x AS antecedents, y AS consequents, s FROM r0 UNION ALL SELECT y, x, s FROM r0), "
    "r2 AS (SELECT antecedents, consequents, s AS support, s / a.support AS confidence, s / a.support / b.support AS lift, s - a.support * b.support AS leverage, (1 - b.support) / (1 - s / a.support + 1e-9) AS conviction, "
    "greatest(s / a.support * (1 - b.support), b.support * (1 - s / a.support)) AS z, s / a.support - b.support AS d FROM r1 JOIN f1 a ON a.itemset = antecedents JOIN f1 b ON b.itemset = consequents), "
    "rules AS (SELECT antecedents, consequents, support, confidence, lift, leverage, conviction, CASE WHEN z > 0 THEN d / z ELSE 0 END AS zhang FROM r2 WHERE confidence >= 0.1 AND lift >= {lift})"
)
METRICS = ["support", "confidence", "lift", "leverage", "conviction", "zhang"]
RULE_COLS = "antecedents, consequents, " + ", ".join(f"round({m}, 6) AS {m}" for m in METRICS)


# Rules over ids that may hold '|': the two items stay apart.
_RULES_OF_ANY = (
    TOTALS + ", " + N_SETS + ", f1 AS (SELECT node_id AS x, total / n AS support FROM t, n WHERE total / n >= 0.01), "
    "r1 AS (SELECT a.node_id AS antecedents, b.node_id AS consequents, count(*) / any_value(n) AS s FROM i a JOIN i b ON a.set_id = b.set_id AND a.node_id <> b.node_id, n "
    "WHERE a.node_id IN (SELECT x FROM f1) AND b.node_id IN (SELECT x FROM f1) GROUP BY 1, 2 HAVING count(*) / any_value(n) >= 0.01), "
    "r2 AS (SELECT antecedents, consequents, s AS support, s / a.support AS confidence, s / a.support / b.support AS lift, s - a.support * b.support AS leverage, (1 - b.support) / (1 - s / a.support + 1e-9) AS conviction, "
    "greatest(s / a.support * (1 - b.support), b.support * (1 - s / a.support)) AS z, s / a.support - b.support AS d FROM r1 JOIN f1 a ON a.x = antecedents JOIN f1 b ON b.x = consequents), "
    "rules AS (SELECT antecedents, consequents, support, confidence, lift, leverage, conviction, CASE WHEN z > 0 THEN d / z ELSE 0 END AS zhang FROM r2 WHERE confidence >= 0.1)"
)


def similarity(view: str, metric: str, least: int = 1, top: int = 50) -> str:
    score = {"jaccard": "weight / (a.total + b.total - weight)", "cosine": "weight / (sqrt(a.total) * sqrt(b.total))", "lift": "weight * n / (a.total::DOUBLE * b.total)"}[metric]
    return on(view, TOTALS, N_SETS, edges(least), f"s0 AS (SELECT source AS item_a, target AS item_b, {score} AS score FROM e JOIN t a ON a.node_id = source JOIN t b ON b.node_id = target, n)", f"sim AS (SELECT * FROM s0 QUALIFY row_number() OVER (PARTITION BY item_a ORDER BY round(score, 9) DESC, item_b) <= {top})")


def windows(n: int = 4) -> str:
    """Windows, the rows in them, and their labels."""
    return (
        "b AS (SELECT min(epoch_us(sort_column)) AS lo, max(epoch_us(sort_column)) AS hi FROM i), "
        f"g AS (SELECT k::INTEGER AS win, lo + (hi - lo) * k // {n} AS a, lo + (hi - lo) * (k + 1) // {n} AS z FROM b, range({n}) r(k)), "
        "l AS (SELECT win, a, z, 'W' || (win + 1) || '[' || strftime(make_timestamp(a), '%Y-%m-%d') || '→' || strftime(make_timestamp(z), '%Y-%m-%d') || ']' AS label FROM g), "
        "x AS (SELECT l.win, l.label, i.* FROM i JOIN l ON epoch_us(sort_column) BETWEEN a AND z)"
    )


WIN_EDGES = "we AS (SELECT x.win, x.label, x.node_id AS source, b.node_id AS target, count(*) AS weight FROM x JOIN i b ON x.set_id = b.set_id AND x.node_id <> b.node_id GROUP BY ALL)"
WIN_PAIRS = "wp AS (SELECT x.win, x.node_id AS source, b.node_id AS target, count(*) AS weight FROM x JOIN i b ON x.set_id = b.set_id AND x.node_id < b.node_id GROUP BY ALL)"


def closure(source: str, key: str = "") -> str:
    """Components of edges in ``source``(win, source, target): mutual reachability."""
    return (
        f"nodes AS (SELECT win, source AS node FROM {source} UNION SELECT win, target FROM {source}), "
        f"reach(win, a, b) AS (SELECT win, node, node FROM nodes UNION SELECT r.win, r.a, s.target FROM reach r JOIN {source} s ON s.win = r.win AND s.source = r.b), "
        "comp AS (SELECT p.win, p.a AS node, min(p.b) AS c, count(*) AS scc_size, string_agg(p.b, '|' ORDER BY p.b) AS members FROM reach p JOIN reach q ON p.win = q.win AND p.a = q.b AND p.b = q.a GROUP BY 1, 2), "
        f"leaving AS (SELECT DISTINCT s.win, p.c FROM {source} s JOIN comp p ON p.win = s.win AND p.node = s.source JOIN comp q ON q.win = s.win AND q.node = s.target WHERE p.c <> q.c), "
        "sinks AS (SELECT win, node, c, scc_size::INTEGER AS scc_size, members, (dense_rank() OVER (PARTITION BY win ORDER BY c) - 1)::INTEGER AS scc_id FROM comp ANTI JOIN leaving USING (win, c))"
    )


WIN_SCC = (
    windows()
    + ", wt AS (SELECT win, node_id, count(*) AS total FROM x GROUP BY 1, 2), we2 AS (SELECT a.win, a.node_id AS source, b.node_id AS target, count(*) AS c FROM x a JOIN x b ON a.win = b.win AND a.set_id = b.set_id AND a.node_id <> b.node_id GROUP BY 1, 2, 3 HAVING count(*) >= 2), "
    "se AS (SELECT e.win, source, target FROM we2 e JOIN wt ON wt.win = e.win AND wt.node_id = e.source WHERE c / total >= 0.08), "
    + closure("se")
)
NEXT_GAP0 = "p AS (SELECT *, row_number() OVER (PARTITION BY set_id ORDER BY sort_column, node_id) AS pos FROM i), raw AS (SELECT a.node_id AS source, b.node_id AS target, count(*) AS weight FROM p a JOIN p b ON a.set_id = b.set_id AND b.pos > a.pos {gap} GROUP BY 1, 2), de AS (SELECT source, target, weight, weight / sum(weight) OVER (PARTITION BY source) AS score FROM raw)"


def _corr(n: int, x: str, y: str, lag: int = 0) -> str:
    m = n - lag
    xs, ys = [f"{x}[{k + 1}]" for k in range(m)], [f"{y}[{k + 1 + lag}]" for k in range(m)]
    s = lambda parts: "(" + " + ".join(parts) + ")"
    sx, sy = s(xs), s(ys)
    cov = f"({s([f'{p} * {q}' for p, q in zip(xs, ys)])} - {sx} * {sy} / {m})"
    vx, vy = f"({s([f'{p} * {p}' for p in xs])} - {sx} * {sx} / {m})", f"({s([f'{q} * {q}' for q in ys])} - {sy} * {sy} / {m})"
    return f"CASE WHEN {vx} > 1e-9 AND {vy} > 1e-9 THEN {cov} / (sqrt({vx}) * sqrt({vy})) END"


SERIES = windows(8) + ", c AS (SELECT win, node_id, count(*)::DOUBLE AS c FROM x GROUP BY 1, 2), grid AS (SELECT node_id, win, coalesce(c, 0) AS v FROM (SELECT DISTINCT node_id FROM c) CROSS JOIN (SELECT DISTINCT win FROM c) LEFT JOIN c USING (node_id, win)), s AS (SELECT node_id, list(v ORDER BY win) AS a FROM grid GROUP BY 1)"

_FACET = "coalesce(region, 'None')", "coalesce(day_period, 'None')"
_LEVELS = "(0, 0, TRUE, TRUE), (1, 0, TRUE, FALSE), (1, 1, FALSE, TRUE), (2, 0, FALSE, FALSE)"

_FACET_ROWS = f"""WITH r AS (SELECT order_id::VARCHAR AS s, item AS x, region, day_period FROM basket_facets WHERE order_id IS NOT NULL AND item IS NOT NULL),
seed AS (SELECT item FROM basket_facets WHERE item IS NOT NULL GROUP BY item ORDER BY count(*) DESC, item LIMIT 1),
v(level, ord, kr, kd) AS (VALUES {_LEVELS}),
k AS (SELECT level, ord, kr, kd, s, x, CASE WHEN kr THEN region END AS region, CASE WHEN kd THEN day_period END AS day_period FROM r, v WHERE (NOT kr OR region IS NOT NULL) AND (NOT kd OR day_period IS NOT NULL)),
rows AS (SELECT * FROM k WHERE level = 0 UNION ALL SELECT DISTINCT * FROM k WHERE level > 0),"""
FACET_RECOMMEND = (
    _FACET_ROWS
    + """
own AS (SELECT a.level, a.ord, a.region, a.day_period, b.x AS item, count(*)::DOUBLE AS c FROM rows a JOIN rows b ON a.level = b.level AND a.ord = b.ord AND a.region IS NOT DISTINCT FROM b.region AND a.day_period IS NOT DISTINCT FROM b.day_period AND a.s = b.s WHERE a.x = (SELECT item FROM seed) AND b.x <> a.x GROUP BY ALL),"""
)
FACET_RULES = (
    _FACET_ROWS
    + """
nr AS (SELECT level, ord, region, day_period, count(DISTINCT s) AS n FROM rows GROUP BY ALL), nx AS (SELECT level, ord, region, day_period, x, count(*) AS c FROM rows GROUP BY ALL),
pr AS (SELECT a.level, a.ord, a.region, a.day_period, b.x AS item, count(*) AS w FROM rows a JOIN rows b ON a.level = b.level AND a.ord = b.ord AND a.region IS NOT DISTINCT FROM b.region AND a.day_period IS NOT DISTINCT FROM b.day_period AND a.s = b.s WHERE a.x = (SELECT item FROM seed) AND b.x <> a.x GROUP BY ALL),
own AS (SELECT p.level, p.ord, p.region, p.day_period, p.item, (p.w / nr.n) / (na.c / nr.n) / (nb.c / nr.n) AS c FROM pr p
 JOIN nr ON nr.level = p.level AND nr.ord = p.ord AND nr.region IS NOT DISTINCT FROM p.region AND nr.day_period IS NOT DISTINCT FROM p.day_period
 JOIN nx na ON na.level = p.level AND na.ord = p.ord AND na.region IS NOT DISTINCT FROM p.region AND na.day_period IS NOT DISTINCT FROM p.day_period AND na.x = (SELECT item FROM seed)
 JOIN nx nb ON nb.level = p.level AND nb.ord = p.ord AND nb.region IS NOT DISTINCT FROM p.region AND nb.day_period IS NOT DISTINCT FROM p.day_period AND nb.x = p.item
 WHERE p.w / nr.n >= 0.05 AND na.c / nr.n >= 0.05 AND nb.c / nr.n >= 0.05 AND (p.w / nr.n) / (na.c / nr.n) >= 0.1),"""
)
_FACET_BEST = """
top AS (SELECT * FROM own QUALIFY row_number() OVER (PARTITION BY level, ord, region, day_period ORDER BY round(c, 9) DESC, item) <= 5),
names AS (SELECT DISTINCT region, day_period, 'region=' || region || '|day_period=' || day_period AS slice FROM r WHERE region IS NOT NULL AND day_period IS NOT NULL),
met AS (SELECT n.slice, t.level, t.item, t.c FROM names n JOIN v ON TRUE JOIN top t ON t.level = v.level AND t.ord = v.ord AND (NOT kr OR t.region = n.region) AND (NOT kd OR t.day_period = n.day_period)
 UNION ALL SELECT 'global', 0, item, c FROM top WHERE level = 2),
best AS (SELECT slice, item, sum(c) AS c, level FROM met WHERE level = (SELECT min(level) FROM met m WHERE m.slice = met.slice) GROUP BY slice, item, level)
SELECT slice, item AS recommended_item, round(c, 6) AS total_strength, level FROM best QUALIFY row_number() OVER (PARTITION BY slice ORDER BY round(c, 9) DESC, item) <= 5"""

EVALUATION = """WITH i AS ({view}), rows AS (SELECT o_custkey::VARCHAR AS user_id, node_id AS item, sort_column FROM i JOIN orders ON set_id = o_orderkey::VARCHAR),
top AS (SELECT list(node_id ORDER BY c DESC, node_id) AS recs FROM (SELECT node_id, count(*) AS c FROM i GROUP BY 1 ORDER BY c DESC, node_id LIMIT 10)),
truth AS (SELECT user_id, list(DISTINCT item) AS items FROM rows WHERE sort_column >= TIMESTAMP '1997-01-01' GROUP BY 1),
u AS (SELECT DISTINCT user_id, recs, coalesce(items, []) AS items FROM (SELECT DISTINCT user_id FROM rows) CROSS JOIN top LEFT JOIN truth USING (user_id)),
p AS (SELECT user_id, len(items) AS n, k::INTEGER AS k, list_contains(items, recs[k])::INTEGER AS hit FROM u, range(1, 11) g(k)),
c AS (SELECT *, sum(hit) OVER (PARTITION BY user_id ORDER BY k) AS seen FROM p),
m AS (SELECT user_id, n, sum(hit) FILTER (k <= 5) AS h, sum(hit / log2(k + 1)) FILTER (k <= 5) AS dcg, sum(hit * seen / k) AS s, min(k) FILTER (hit = 1) AS f FROM c GROUP BY 1, 2),
d AS (SELECT user_id, h / 5 AS precision, CASE WHEN n > 0 THEN h / n ELSE 0 END AS recall, CASE WHEN n > 0 THEN dcg / (SELECT sum(1 / log2(k + 1)) FROM range(1, least(n, 5) + 1) g(k)) ELSE 0 END AS ndcg,
 CASE WHEN n > 0 THEN s / n ELSE 0 END AS ap, CASE WHEN h > 0 THEN 1.0::DOUBLE ELSE 0 END AS hit_rate, coalesce(1.0::DOUBLE / f, 0) AS rr FROM m),
z AS (SELECT *, CASE WHEN precision + recall > 0 THEN 2 * precision * recall / (precision + recall) ELSE 0 END AS f1 FROM d),
a AS (SELECT {cols} FROM z UNION ALL SELECT 'AVERAGE', {means} FROM z)
SELECT user_id, {rounds} FROM a"""
_EV = ["precision", "recall", "f1", "ndcg", "ap", "hit_rate", "rr"]


def _key_counts(f: str) -> str:
    return f"SELECT '{f}' AS field_name, {f} AS key_value FROM interactions WHERE {f} IS NOT NULL GROUP BY {f} HAVING count(*) * 100 >= (SELECT count({f}) FROM interactions)"


def _key_profile(f: str, o: str) -> str:
    return f"SELECT '{f}' AS field_name, {f} AS key_value, count(*) AS n_rows, count(DISTINCT {o}) AS n_distinct_other, min(sort_column) AS first_time, max(sort_column) AS last_time FROM interactions WHERE {f} IS NOT NULL GROUP BY {f}"


def _course(v: str, n: int, digits: int) -> str:
    """Least-squares slope of v over all n windows, missing ones being 0."""
    return f"round((sum({v} * win) - sum({v}) * {(n - 1) / 2}::DOUBLE) / {n * (n * n - 1) / 12}::DOUBLE, {digits})"


def _spread(v: str, n: int) -> str:
    return f"round(sqrt(greatest((sum({v} * {v}) - sum({v}) * sum({v}) / {n}) / {n - 1}, 0)), 3)"


def oracle_sql() -> dict[str, str]:
    ev, two, scored = ["click_1"], ["click_1", "view_2"], lambda a, least=1: f"sc AS (SELECT source, target, (weight + {a}) / (total + {a} * 100) AS score FROM e JOIN t ON t.node_id = e.source WHERE weight >= {least})"
    brands = ["Brand#11", "Brand#23"]
    plain = "sc AS (SELECT source, target, weight::DOUBLE AS score FROM e)"
    decay = "ref AS (SELECT max(sort_column) AS r FROM i), dt AS (SELECT node_id, sum(exp(-ln(2) / 7 * date_diff('day', sort_column, r))) AS total FROM i, ref GROUP BY 1), dw AS (SELECT a.node_id AS source, b.node_id AS target, sum(exp(-ln(2) / 7 * date_diff('day', a.sort_column, r))) AS w FROM i a JOIN i b ON a.set_id = b.set_id AND a.node_id <> b.node_id, ref GROUP BY 1, 2 HAVING w >= 0.01), de AS (SELECT source, target, w AS decay_weight, w / total AS score FROM dw JOIN dt ON node_id = source)"
    held = "h AS (SELECT * FROM i WHERE sort_column >= (SELECT max(sort_column) FROM i) - INTERVAL 7 DAY), e AS (SELECT a.node_id AS source, b.node_id AS target, count(*)::DOUBLE AS score FROM h a JOIN h b ON a.set_id = b.set_id AND a.node_id <> b.node_id GROUP BY 1, 2)"
    best_of = lambda seed: f"(SELECT target AS recommended_item, weight::DOUBLE AS s FROM e WHERE source = '{seed}' ORDER BY s DESC, target LIMIT 20)"
    label = lambda c: f"(SELECT label FROM l WHERE l.win = {c})"
    timeline = on("event_session", WIN_SCC)
    pair = lambda c: f"(SELECT p.label || ' → ' || q.label FROM l p JOIN l q ON q.win = p.win + 1 WHERE q.win = {c})"
    evolution = (
        timeline + ", sets AS (SELECT DISTINCT win, scc_id, scc_size, members FROM sinks), met AS (SELECT c.win, c.scc_id AS cid, p.scc_id AS pid, c.members AS cm, p.members AS pm, count(*) / (any_value(c.scc_size) + any_value(p.scc_size) - count(*)) AS j FROM sinks c JOIN sinks p ON p.win + 1 = c.win AND p.node = c.node GROUP BY ALL), "
        "kept AS (SELECT * FROM (SELECT * FROM met QUALIFY row_number() OVER (PARTITION BY win, cid ORDER BY j DESC, pid) = 1) WHERE j >= 0.3), out AS ("
        "SELECT win, CASE WHEN j > 0.8 THEN 'stable' ELSE 'evolving' END AS event, pm AS prev_members, cm AS curr_members, round(j, 3) AS jaccard FROM kept "
        "UNION ALL SELECT win + 1, 'dissolving', members, '', 0.0 FROM sets s WHERE win < 3 AND NOT EXISTS (FROM kept k WHERE k.win = s.win + 1 AND k.pid = s.scc_id) "
        "UNION ALL SELECT win, 'emerging', '', members, 0.0 FROM sets s WHERE win > 0 AND NOT EXISTS (FROM kept k WHERE k.win = s.win AND k.cid = s.scc_id)) "
        f"SELECT {pair('out.win')} AS transition, event, prev_members, curr_members, jaccard::DOUBLE AS jaccard FROM out"
    )
    features = ", ".join(f"round({f}({m}), 6) AS {m}_{n}" for m in METRICS for n, f in (("mean", "avg"), ("max", "max")))
    lag_rows = " UNION ALL ".join(f"SELECT na, nb, {k} AS lag, coalesce({_corr(8, 'x', 'y', k)}, 0) AS ab, coalesce({_corr(8, 'y', 'x', k)}, 0) AS ba FROM pr" for k in (1, 2))
    # one cluster, in which no measure is further from the mean than another: the first one ranks
    profile = (
        f", m AS (SELECT consequents AS item_id, support AS s, antecedents || ' → ' || consequents AS rule FROM rules WHERE antecedents IN ({seeds(brands)}) AND consequents NOT IN ({seeds(brands)}) "
        "QUALIFY row_number() OVER (PARTITION BY consequents ORDER BY round(support, 9) DESC, rule) = 1) SELECT item_id, round(s, 6) AS score, 0 AS cluster_id, '{shown}' AS dominant_metric, rule FROM m ORDER BY round(s, 9) DESC, item_id LIMIT 10"
    )
    return {
        "p7_found": " UNION ALL ".join(_key_counts(f) for f in FIELDS),
        "p7_per_key": _key_profile("node_id", "set_id") + " UNION ALL " + _key_profile("set_id", "node_id"),
        "interactions_load": "SELECT node_id, count(*) AS n_rows, count(DISTINCT set_id) AS n_sets, max(sort_column) AS last_time FROM interactions WHERE set_id IS NOT NULL AND node_id IS NOT NULL GROUP BY 1",
        "session_load": "SELECT item_id AS node_id, count(*) AS n_rows, count(TRY_CAST(rtrim(event_time, 'Z') AS TIMESTAMP)) AS n_timed FROM session_items WHERE session_id IS NOT NULL AND item_id IS NOT NULL GROUP BY 1",
        "matrix_unpivot": on("basket_brand", "u AS (SELECT DISTINCT set_id, node_id FROM i)") + " SELECT node_id, count(*) AS n_sets FROM u GROUP BY 1",
        "frequent_itemsets": on("basket_brand", ITEMSETS) + " SELECT itemset, round(support, 6) AS support, length FROM (FROM f1 UNION ALL FROM f2)",
        "frequent_itemsets_len1": on("basket_brand", ITEMSETS) + " SELECT itemset, round(support, 6) AS support, length FROM f1",
        "frequent_itemsets_len3": on("event_session", N_SETS, "d AS (SELECT DISTINCT set_id, node_id FROM i)")
        + " SELECT itemset, round(c / n, 6) AS support, length FROM (SELECT node_id AS itemset, count(*) AS c, 1 AS length FROM d GROUP BY 1 UNION ALL SELECT a.node_id || '|' || b.node_id, count(*), 2 FROM d a JOIN d b ON a.set_id = b.set_id AND a.node_id < b.node_id GROUP BY 1 "
        "UNION ALL SELECT a.node_id || '|' || b.node_id || '|' || c.node_id, count(*), 3 FROM d a JOIN d b ON a.set_id = b.set_id AND a.node_id < b.node_id JOIN d c ON a.set_id = c.set_id AND b.node_id < c.node_id GROUP BY 1), n WHERE c / n >= 0.0005",
        "association_rules": on("basket_brand", RULES.format(lift=0)) + f" SELECT {RULE_COLS} FROM rules",
        "association_rules_min_lift": on("basket_brand", RULES.format(lift=0.9)) + f" SELECT {RULE_COLS} FROM rules",
        "recommend_rules": on("basket_brand", RULES.format(lift=0)) + f", m AS (SELECT consequents AS item_id, lift AS s, antecedents || ' -> ' || consequents AS rule FROM rules WHERE antecedents IN ({seeds(brands)}) AND consequents NOT IN ({seeds(brands)}) QUALIFY row_number() OVER (PARTITION BY consequents ORDER BY round(lift, 9) DESC, rule) = 1) SELECT item_id, round(s, 6) AS score, rule FROM m ORDER BY round(s, 9) DESC, item_id LIMIT 10",
        "sequential_patterns": on("event_session", N_SETS) + " SELECT a.node_id AS prefix, b.node_id AS suffix, a.node_id || ' -> ' || b.node_id AS pattern, count(DISTINCT a.set_id) AS count, round(count(DISTINCT a.set_id) / any_value(n), 6) AS support FROM i a JOIN i b ON a.set_id = b.set_id AND a.sort_column < b.sort_column, n GROUP BY 1, 2, 3 HAVING count(DISTINCT a.set_id) / any_value(n) >= 0.002",
        "sequential_patterns_gap": on("event_session", N_SETS, "p AS (SELECT *, row_number() OVER (PARTITION BY set_id ORDER BY sort_column, node_id) AS pos FROM i)") + " SELECT a.node_id AS prefix, b.node_id AS suffix, a.node_id || ' -> ' || b.node_id AS pattern, count(DISTINCT a.set_id) AS count, round(count(DISTINCT a.set_id) / any_value(n), 6) AS support FROM p a JOIN p b ON a.set_id = b.set_id AND a.sort_column < b.sort_column AND b.pos - a.pos - 1 <= 0, n GROUP BY 1, 2, 3 HAVING count(DISTINCT a.set_id) / any_value(n) >= 0.001",
        "itemcf_jaccard": similarity("basket_brand", "jaccard") + " SELECT item_a, item_b, round(score, 6) AS score FROM sim",
        "itemcf_cosine": similarity("basket_part", "cosine", 2, 10) + " SELECT item_a, item_b, round(score, 6) AS score FROM sim",
        "itemcf_lift": similarity("basket_brand", "lift") + " SELECT item_a, item_b, round(score, 6) AS score FROM sim",
        "itemcf_recommend": similarity("basket_brand", "jaccard") + f", q AS (SELECT item_b AS item_id, sum(score) AS s FROM sim WHERE item_a IN ({seeds(brands)}) AND item_b NOT IN ({seeds(brands)}) GROUP BY 1) SELECT item_id, round(s, 6) AS score FROM q ORDER BY round(s, 9) DESC, item_id LIMIT 10",
        "itemcf_similar": similarity("basket_brand", "cosine") + " SELECT item_b AS item_id, round(score, 6) AS score FROM (SELECT * FROM sim WHERE item_a = 'Brand#11' ORDER BY round(score, 9) DESC, item_b LIMIT 5)",
        "popularity_global": "WITH i AS (SELECT * FROM interactions WHERE set_id IS NOT NULL AND node_id IS NOT NULL) SELECT node_id, round(count(*) / (SELECT count(*) FROM i), 6) AS score FROM i GROUP BY 1",
        "popularity_trending": on("event_session", "h AS (SELECT * FROM i WHERE sort_column >= (SELECT max(sort_column) FROM i) - INTERVAL 7 DAY)") + " SELECT node_id, round(count(*) / (SELECT count(*) FROM h), 6) AS score FROM h GROUP BY 1",
        "popularity_exclude": on("basket_brand", TOTALS) + f" SELECT node_id AS item_id, round(total / (SELECT sum(total) FROM t), 6) AS score, rank() OVER (ORDER BY total DESC) AS rank FROM t WHERE node_id NOT IN ({seeds(brands)}) ORDER BY total DESC, node_id LIMIT 10",
        "merge_union": on("basket_brand", edges()) + f" SELECT recommended_item, round(sum(s), 6) AS total_strength FROM (FROM {best_of(brands[0])} UNION ALL FROM {best_of(brands[1])}) GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 10",
        "graph_edges": on("basket_part", edges(2)) + " FROM e",
        "graph_adjacency": on("event_session", edges()) + " SELECT source, string_agg(target, ',' ORDER BY target) AS neighbors, string_agg(weight::VARCHAR, ',' ORDER BY target) AS weights FROM e GROUP BY 1",
        "graph_neighbors": on("event_session", edges()) + " SELECT target AS neighbor, weight FROM e WHERE source = 'click_1'",
        "graph_recommend_frequency": on("event_session", edges(), plain, walk(ev, 2, "sc")) + integral(ev, 10),
        "graph_recommend_probability": on("event_session", TOTALS, edges(), scored(0), walk(ev, 2, "sc")) + integral(ev, 10),
        "graph_recommend_path": on("event_session", TOTALS, edges(), scored(0), walk(ev, 2, "sc")) + integral(ev, 10, "max"),
        "graph_recommend_multi_seed": on("event_session", TOTALS, edges(), scored(0), walk(two, 2, "sc")) + integral(two, 10, exclude=False),
        "graph_recommend_alpha": on("event_session", TOTALS, edges(), scored(1, 2), walk(ev, 2, "sc")) + integral(ev, 10),
        "score_basket": on("event_type", TOTALS, edges(), scored(0), walk(["click"], 3, "sc", "(SELECT DISTINCT node_id FROM i)")) + " SELECT round(coalesce(sum(strength), 0), 6) AS score FROM w WHERE depth > 0 AND item = 'view'",
        "rank_nodes": on("event_session", TOTALS, edges(), scored(0), walk(ev, 2, "sc")) + integral(ev, 10, cols="node score steps reason"),
        "sink_sccs": on("event_session", TOTALS, edges(5), "se AS (SELECT 0 AS win, source, target FROM e JOIN t ON node_id = source WHERE weight / total >= 0.08)", closure("se")) + " SELECT node, scc_id, scc_size, TRUE AS is_sink, members FROM sinks",
        "decay_edges": on("event_session", decay) + " SELECT source, target, round(decay_weight, 6) AS decay_weight, round(score, 6) AS score FROM de",
        "decay_recommend": on("event_session", decay, walk(two, 2, "de")) + integral(two, 10, cols="recommended_item decay_score min_hops reason"),
        "sliding_window_recommend": on("event_session", held, walk(ev, 2, "e", "h")) + integral(ev, 10),
        "snapshot_timeline": on("event_session", windows(), WIN_EDGES) + " FROM we",
        "snapshot_diff": on("event_session", windows(), WIN_EDGES) + ", d AS (SELECT source, target, coalesce(sum(weight) FILTER (win = 0), 0)::BIGINT AS weight_a, coalesce(sum(weight) FILTER (win = 3), 0)::BIGINT AS weight_b FROM we WHERE win IN (0, 3) GROUP BY 1, 2) SELECT *, weight_b - weight_a AS delta, CASE WHEN weight_a = 0 THEN 'emerging' WHEN weight_b = 0 THEN 'fading' WHEN weight_b > weight_a THEN 'strengthening' ELSE 'weakening' END AS kind FROM d",
        "scc_tracker": timeline + " SELECT win, node, scc_id, scc_size, TRUE AS is_sink, members FROM sinks",
        "scc_evolution": evolution,
        "directed_edges": on("event_session", NEXT_GAP0.format(gap="")) + " SELECT source, target, weight, round(score, 6) AS score FROM de",
        "directed_recommend_next": on("event_session", NEXT_GAP0.format(gap="AND b.pos - a.pos - 1 <= 0"), walk(two, 2, "de")) + integral(two, 10, cols="next_item transition_prob steps path", steps=LAST_DEPTH),
        "directed_reachable": on("event_session", NEXT_GAP0.format(gap="AND b.pos - a.pos - 1 <= 0"), walk(ev, 2, "de")) + integral(ev, 1000, cols="next_item transition_prob steps path", steps=LAST_DEPTH),
        "node_per_window": on("event_session", windows(), WIN_EDGES) + ", d AS (SELECT win, source AS node_id, count(*) AS out_degree FROM we GROUP BY 1, 2) SELECT x.win, x.label, x.node_id, count(*) AS activity, count(DISTINCT set_id) AS sessions, coalesce(any_value(out_degree), 0)::BIGINT AS out_degree FROM x LEFT JOIN d ON d.win = x.win AND d.node_id = x.node_id GROUP BY ALL",
        "node_rollup": on("event_session", windows()) + ", a AS (SELECT win, node_id, count(*)::DOUBLE AS v, count(DISTINCT set_id) AS s FROM x GROUP BY 1, 2), r AS (SELECT node_id, min(win) AS f, max(win) AS la, first(win ORDER BY v DESC, win) AS pk, count(*)::INTEGER AS active_windows, sum(v)::BIGINT AS total_activity, "
        f"round(sum(v) / count(*), 3) AS mean_activity, {_spread('v', 4)} AS activity_std, {_course('v', 4, 3)} AS activity_trend, sum(s)::BIGINT AS total_sessions FROM a GROUP BY 1) "
        f"SELECT node_id, {label('f')} AS first_window, {label('la')} AS last_window, {label('pk')} AS peak_window, active_windows, la - f + 1 AS lifetime_windows, total_activity, mean_activity, activity_std, activity_trend, total_sessions, CASE WHEN f > 0 THEN 'emerging' WHEN la < 3 THEN 'churned' ELSE 'active' END AS status FROM r",
        "edge_lifecycle": on("event_session", windows(), WIN_EDGES) + f", r AS (SELECT source, target, min(win) AS f, max(win) AS la, first(win ORDER BY weight DESC, win) AS pk, count(*)::INTEGER AS k, sum(weight) AS s1, {_spread('weight::DOUBLE', 4)} AS weight_std, max(weight)::DOUBLE AS weight_max, {_course('weight::DOUBLE', 4, 4)} AS tr FROM we GROUP BY 1, 2) "
        f"SELECT source, target, k AS active_windows, round(k / 4, 3) AS stability, round(s1 / k, 3)::DOUBLE AS weight_mean, weight_std, weight_max, CASE WHEN k > 1 THEN tr ELSE 0.0 END AS weight_trend, {label('pk')} AS peak_window, {label('f')} AS first_window, {label('la')} AS last_window, CASE WHEN k > 2 THEN 'persistent' WHEN k = 1 THEN 'transient' ELSE 'sporadic' END AS edge_kind FROM r",
        "graph_snapshots": timeline + ", " + WIN_PAIRS + ", nw AS (SELECT DISTINCT win, node_id FROM x), fl AS (SELECT node_id, min(win) AS f, max(win) AS la FROM nw GROUP BY 1), c AS (SELECT l.win, l.label, (SELECT count(*) FROM nw WHERE nw.win = l.win) AS n_nodes, (SELECT count(*) FROM wp WHERE wp.win = l.win) AS n_edges, (SELECT count(DISTINCT set_id) FROM x WHERE x.win = l.win) AS n_sessions, (SELECT count(*) FROM fl WHERE f = l.win) AS new_nodes, (SELECT count(*) FROM fl WHERE la + 1 = l.win AND la < 3) AS churned_nodes, "
        "(SELECT count(DISTINCT scc_id) FROM sinks WHERE sinks.win = l.win) AS n_sccs, (SELECT coalesce(max(scc_size), 0) FROM sinks WHERE sinks.win = l.win)::BIGINT AS largest_scc_size, (SELECT count(*) FROM sinks WHERE sinks.win = l.win) AS m FROM l) "
        "SELECT win, label, n_nodes, n_edges, round(n_edges / nullif(n_nodes * (n_nodes - 1) / 2, 0), 4) AS density, round(2 * n_edges / n_nodes, 3) AS avg_degree, n_sessions, new_nodes, churned_nodes, n_sccs, largest_scc_size, round(m / n_nodes, 3) AS scc_coverage FROM c WHERE n_nodes > 0",
        "community_metrics": timeline + ", " + WIN_PAIRS + ", s AS (SELECT DISTINCT win, scc_id, scc_size::BIGINT AS size, members FROM sinks), j AS (SELECT s.win, s.scc_id, w.source, w.target, w.weight, EXISTS (FROM sinks k WHERE k.win = s.win AND k.scc_id = s.scc_id AND k.node = w.source) AS a, EXISTS (FROM sinks k WHERE k.win = s.win AND k.scc_id = s.scc_id AND k.node = w.target) AS b FROM s JOIN wp w ON w.win = s.win), "
        "q AS (SELECT win, scc_id, coalesce(sum(weight) FILTER (a AND b), 0)::BIGINT AS inner_, coalesce(sum(weight) FILTER (a <> b), 0)::BIGINT AS outer_, string_agg(DISTINCT CASE WHEN a THEN source ELSE target END, '|' ORDER BY CASE WHEN a THEN source ELSE target END) FILTER (a <> b) AS br, count(DISTINCT CASE WHEN a THEN source ELSE target END) FILTER (a <> b) AS nb FROM j GROUP BY 1, 2) "
        f"SELECT s.win AS window, {label('s.win')} AS window_label, s.scc_id, size, members, coalesce(inner_, 0) AS internal_edges, (size * (size - 1) // 2) AS possible_edges, CASE WHEN size > 1 THEN round(coalesce(inner_, 0) / (size * (size - 1) / 2), 3) ELSE 1.0 END AS cohesion, coalesce(outer_, 0) AS external_edges, coalesce(br, '') AS bridge_nodes, coalesce(nb, 0) AS n_bridge_nodes FROM s LEFT JOIN q ON q.win = s.win AND q.scc_id = s.scc_id",
        "node_synchrony": on("event_type", SERIES) + f", pr AS (SELECT p.node_id AS na, q.node_id AS nb, p.a AS x, q.a AS y FROM s p, s q) SELECT na AS node_a, nb AS node_b, round({_corr(8, 'x', 'y')}, 3) AS correlation FROM pr",
        "leading_lagging": on("event_type", SERIES) + f", pr AS (SELECT p.node_id AS na, q.node_id AS nb, p.a AS x, q.a AS y FROM s p JOIN s q ON p.node_id < q.node_id), lg AS ({lag_rows}), f AS (SELECT *, abs(ab) > abs(ba) AS fst FROM lg WHERE abs(abs(ab) - abs(ba)) > 1e-6) "
        "SELECT CASE WHEN fst THEN na ELSE nb END AS node_a, CASE WHEN fst THEN nb ELSE na END AS node_b, lag, round(CASE WHEN fst THEN ab ELSE ba END, 3) AS correlation, CASE WHEN fst THEN na || ' leads ' || nb ELSE nb || ' leads ' || na END AS relationship FROM f",
        "facet_composite": f"SELECT coalesce(order_id::VARCHAR, 'None') || '|' || {_FACET[0]} || '|' || {_FACET[1]} AS _context_key, count(*) AS n_rows FROM basket_facets GROUP BY 1",
        "facet_entities": f"SELECT item, count(*) AS n_rows, count(DISTINCT order_id) AS n_orders FROM (SELECT order_id, item FROM basket_facets UNION ALL SELECT order_id, min('facet:region=' || {_FACET[0]} || '|facet:day_period=' || {_FACET[1]}) FROM basket_facets WHERE order_id IS NOT NULL GROUP BY 1) GROUP BY 1",
        "facet_split": "SELECT 'region=' || region || '|day_period=' || day_period AS slice, count(*) AS n_rows, count(DISTINCT item) AS n_items FROM basket_facets WHERE region IS NOT NULL AND day_period IS NOT NULL GROUP BY 1",
        "facet_recommend": FACET_RECOMMEND + _FACET_BEST,
        "facet_recommend_rules": FACET_RULES + _FACET_BEST,
        "recommend_by_profile": on("basket_brand", RULES.format(lift=0)) + profile.format(shown="support"),
        "recommend_by_archetype": on("basket_brand", RULES.format(lift=0)) + profile.format(shown="support_mean"),
        "interactions_edges": on("interactions", edges(20)) + " FROM e",
        "interactions_itemsets": on("interactions", ITEMSETS.replace("0.03", "0.01")) + " SELECT itemset, round(support, 6) AS support, length FROM (FROM f1 UNION ALL FROM f2)",
        "interactions_rules": on("interactions", _RULES_OF_ANY) + f" SELECT {RULE_COLS} FROM rules".replace("round(conviction, 6)", "round(least(conviction, 1e6), 6)"),
        "interactions_recommend_rules": on("interactions", _RULES_OF_ANY) + ", s AS (SELECT node_id FROM t ORDER BY total DESC, node_id LIMIT 2), m AS (SELECT consequents AS item_id, lift, antecedents || ' -> ' || consequents AS rule FROM rules WHERE antecedents IN (FROM s) AND consequents NOT IN (FROM s) "
        "QUALIFY row_number() OVER (PARTITION BY consequents ORDER BY round(lift, 9) DESC, rule) = 1) SELECT item_id, round(lift, 6) AS score, rule FROM m ORDER BY round(lift, 9) DESC, item_id LIMIT 10",
        "interactions_cf": similarity("interactions", "cosine", 8, 10) + " SELECT item_a, item_b, round(score, 6) AS score FROM sim",
        "interactions_snapshots": on("interactions", windows(), WIN_EDGES) + " FROM we WHERE weight >= 5",
        "interactions_sccs": on("interactions", TOTALS, edges(8), "se AS (SELECT 0 AS win, source, target FROM e JOIN t ON node_id = source WHERE weight / total >= 0.5)", closure("se")) + " SELECT node, scc_id, scc_size, TRUE AS is_sink, members FROM sinks",
        "evaluate_recommendations": EVALUATION.format(view=SQL["basket_brand"], cols="user_id, " + ", ".join(_EV), means=", ".join(f"avg({m})" for m in _EV), rounds=", ".join(f"round({m}, 6) AS {m}" for m in _EV)),
        "catalogue_coverage": on("basket_brand", TOTALS) + ", top AS (SELECT node_id FROM t ORDER BY total DESC, node_id LIMIT 10) SELECT round(count(DISTINCT p_brand) FILTER (p_brand IN (FROM top)) / count(DISTINCT p_brand), 6) AS coverage FROM part",
        "temporal_split": on("event_session", "p AS (SELECT *, row_number() OVER (ORDER BY sort_column) AS k, count(*) OVER () AS n FROM i)") + " SELECT CASE WHEN k <= floor(n * 0.8) THEN 'train' ELSE 'test' END AS side, count(*) AS n_rows, min(sort_column) AS first_time, max(sort_column) AS last_time FROM p GROUP BY 1",
        "temporal_split_sets": on("event_session", "f AS (SELECT set_id, min(sort_column) AS t, count(*) AS n_rows FROM i GROUP BY 1), p AS (SELECT *, row_number() OVER (ORDER BY t, set_id) AS k, count(*) OVER () AS n FROM f)") + " SELECT set_id, n_rows, CASE WHEN k <= floor(n * 0.8) THEN 'train' ELSE 'test' END AS side FROM p",
        "random_split": on("basket_part", "n AS (SELECT count(DISTINCT set_id) AS n FROM i)") + " SELECT 'train' AS side, floor(n * 0.8)::BIGINT AS n_sets FROM n UNION ALL SELECT 'test', (n - floor(n * 0.8))::BIGINT FROM n",
        "item_features": on("basket_brand", RULES.format(lift=0)) + f" SELECT consequents AS item, {features}, count(*) AS rule_count FROM rules GROUP BY 1",
    }

"""SQL with the same results as the queries of this package, where SQL can say them."""

from __future__ import annotations

_SETS = """WITH x AS (SELECT DISTINCT set_id, node_id FROM interactions WHERE set_id IS NOT NULL AND node_id IS NOT NULL),
t AS (SELECT count(DISTINCT set_id) AS n FROM x),
k AS (SELECT node_id, count(*) AS c FROM x GROUP BY node_id)"""

_PAIRS = (
    _SETS
    + """, f AS (SELECT x.* FROM x JOIN k USING (node_id), t WHERE k.c >= 8 AND k.c * 10000 >= 15 * t.n),
p AS (SELECT a.node_id AS node_a, b.node_id AS node_b, count(*) AS n_ab FROM f a JOIN f b ON a.set_id = b.set_id AND a.node_id < b.node_id GROUP BY 1, 2),
r AS (SELECT node_a, node_b, n_ab, ka.c AS n_a, kb.c AS n_b, t.n AS n_sets FROM p JOIN k ka ON ka.node_id = node_a JOIN k kb ON kb.node_id = node_b, t
      WHERE n_ab >= 8 AND n_ab * 10000 >= 15 * t.n AND 2 * n_ab * t.n >= 5 * ka.c * kb.c)
"""
)

_TOP = """WITH b AS (SELECT item_a, item_b, max(score) AS score FROM item_similarity
 WHERE item_a IS NOT NULL AND item_b IS NOT NULL AND score IS NOT NULL AND NOT isnan(score) AND item_a <> item_b GROUP BY 1, 2),
r AS (SELECT item_a, item_b, score, CAST(row_number() OVER (PARTITION BY item_a ORDER BY score DESC, item_b) AS INTEGER) AS rank FROM b)
"""

_SEQUENCES = """WITH v AS (SELECT set_id AS s, node_id AS x, sort_column AS t FROM interactions WHERE set_id IS NOT NULL AND node_id IS NOT NULL),
q AS (SELECT count(DISTINCT s) AS n FROM v), e0 AS (SELECT DISTINCT s, x, t FROM v WHERE t IS NOT NULL),
k AS (SELECT x FROM e0, q GROUP BY x HAVING count(DISTINCT s) >= 8 AND count(DISTINCT s) * 100 >= any_value(q.n)),
e AS (SELECT e0.* FROM e0 JOIN k USING (x)), f AS (SELECT s, x, min(t) AS t FROM e GROUP BY 1, 2), l AS (SELECT s, x, max(t) AS t FROM e GROUP BY 1, 2),
ab AS (SELECT f.s, f.x AS a, e.x AS b, min(e.t) AS t FROM f JOIN e ON e.s = f.s AND e.t > f.t AND e.x <> f.x GROUP BY 1, 2, 3),
g AS (SELECT a, b FROM ab, q GROUP BY 1, 2 HAVING count(*) >= 8 AND count(*) * 100 >= any_value(q.n)),
r AS (SELECT ab.a AS step_1, ab.b AS step_2, l.x AS step_3, count(*) AS n_sets FROM ab JOIN g ON g.a = ab.a AND g.b = ab.b JOIN l ON l.s = ab.s AND l.t > ab.t AND l.x <> ab.a AND l.x <> ab.b, q
      GROUP BY 1, 2, 3 HAVING count(*) >= 8 AND count(*) * 100 >= any_value(q.n))
"""

_CLUSTERS = """WITH RECURSIVE p AS (SELECT rule_id, confidence AS c, CASE WHEN support <= 0 THEN -1000 ELSE log10(support) END AS s, CASE WHEN lift <= 0 THEN -1000 ELSE log10(lift) END AS l,
  CASE WHEN conviction <= 0 THEN -1000 ELSE log10(least(conviction, 1e6)) END AS v FROM rules
  WHERE confidence IS NOT NULL AND NOT isnan(confidence) AND support IS NOT NULL AND NOT isnan(support) AND lift IS NOT NULL AND NOT isnan(lift) AND conviction IS NOT NULL AND NOT isnan(conviction)),
e AS (SELECT a.rule_id AS a, b.rule_id AS b FROM p a JOIN p b ON b.c BETWEEN a.c - 0.1 AND a.c + 0.1 AND abs(a.s - b.s) <= 0.1 AND abs(a.l - b.l) <= 0.1 AND abs(a.v - b.v) <= 0.1 AND abs(a.c - b.c) <= 0.1),
r AS (SELECT a AS id, b AS other FROM e UNION SELECT r.id, e.b FROM r JOIN e ON e.a = r.other),
m AS (SELECT id, min(other) AS cluster FROM r GROUP BY id), big AS (SELECT cluster, count(*) AS n_records FROM m GROUP BY cluster HAVING count(*) >= 5)
"""

_CELLS = """, w AS (SELECT m.cluster, p.rule_id, min(p.rule_id) OVER (PARTITION BY floor(c / 0.1), floor(s / 0.1), floor(l / 0.1), floor(v / 0.1)) AS cell FROM m JOIN p ON p.rule_id = m.id JOIN big USING (cluster)),
k AS (SELECT cluster, cell, count(*) AS n, row_number() OVER (PARTITION BY cluster ORDER BY count(*) DESC, cell) AS place FROM w GROUP BY 1, 2),
t AS (SELECT w.cluster, w.rule_id, row_number() OVER (PARTITION BY w.cluster ORDER BY w.rule_id) AS i FROM w JOIN k ON k.cluster = w.cluster AND k.cell = w.cell AND k.place = 1)
SELECT cluster AS first_rule_id, n_records, (SELECT count(*) FROM k WHERE k.cluster = big.cluster) AS n_cells, (SELECT max(n) FROM k WHERE k.cluster = big.cluster) AS densest_cell_size,
  (SELECT string_agg(rule_id::VARCHAR, '|' ORDER BY rule_id) FROM t WHERE t.cluster = big.cluster AND i <= 3) AS typical_rule_ids FROM big"""

_RANKS = """WITH v AS (SELECT rule_id, CASE WHEN isnan(lift) THEN NULL ELSE lift END AS lift, CASE WHEN isnan(conviction) THEN NULL ELSE conviction END AS conviction,
  CASE WHEN isnan(zhang) THEN NULL ELSE zhang END AS zhang, CASE WHEN isnan(leverage) THEN NULL ELSE leverage END AS leverage FROM rules)"""


def _share(m: str) -> str:
    n, above, equal = f"count({m}) OVER ()", f"rank() OVER (ORDER BY {m} DESC NULLS LAST) - 1", f"count(*) OVER (PARTITION BY {m})"
    return f"CASE WHEN {m} IS NULL OR {n} < 2 THEN 0.0 ELSE ({n} - (({above}) + ({equal} + 1) / 2.0)) / ({n} - 1)::DOUBLE - 0.5 END"


def oracle_sql() -> dict[str, str]:
    measures = ["lift", "conviction", "zhang", "leverage"]
    return {
        "p1_found": _PAIRS + "SELECT node_a, node_b FROM r",
        "p1_pairs": _PAIRS + "SELECT node_a, node_b, n_ab, n_a, n_b, n_sets, n_ab * n_sets / (n_a::DOUBLE * n_b::DOUBLE) AS lift, log2(n_ab * n_sets / (n_a::DOUBLE * n_b::DOUBLE)) AS pmi FROM r",
        "p2_found": _CLUSTERS + "SELECT cluster AS first_rule_id, id AS rule_id FROM m JOIN big USING (cluster) WHERE id <> cluster",
        "p2_clusters": _CLUSTERS + _CELLS,
        "p3_found": _SEQUENCES + "SELECT step_1, step_2, step_3 FROM r",
        "p3_sequences": _SEQUENCES + "SELECT step_1, step_2, step_3, n_sets FROM r",
        "p4_found": "SELECT node_id FROM interactions WHERE node_id IS NOT NULL GROUP BY node_id HAVING count(*) * 200 >= (SELECT count(node_id) FROM interactions)",
        "p4_frequent": "SELECT node_id, count(*) AS n_rows FROM interactions WHERE node_id IS NOT NULL GROUP BY node_id HAVING count(*) * 200 >= (SELECT count(node_id) FROM interactions)",
        "p5_found": _TOP + "SELECT item_a, item_b FROM r WHERE rank <= 5",
        "p5_top": _TOP + "SELECT * FROM r WHERE rank <= 5",
        "p6_found": _RANKS
        + ", c AS (SELECT * FROM v WHERE lift IS NOT NULL AND conviction IS NOT NULL AND zhang IS NOT NULL AND leverage IS NOT NULL), g AS (SELECT rule_id, count(*) OVER () AS n, "
        + ", ".join(f"rank() OVER (ORDER BY {m} DESC) - 1 AS g_{m}" for m in measures)
        + " FROM c) SELECT rule_id FROM g WHERE greatest(g_lift, g_conviction, g_zhang, g_leverage) * 10 < n",
        "p9_whole": "SELECT container_kind, (SELECT count(*) FROM documents) AS n_documents, CAST(0 AS BIGINT) AS n_repeated, CAST(0 AS BIGINT) AS n_overfull, CAST(0 AS BIGINT) AS n_split_without_need, CAST(0 AS BIGINT) AS n_tokens_lost FROM containers WHERE capacity_tokens > 0",
        "p6_ranking": _RANKS
        + ", s AS (SELECT rule_id, "
        + ", ".join(f"{_share(m)} AS s_{m}" for m in measures)
        + ", (lift IS NULL)::INTEGER + (conviction IS NULL)::INTEGER + (zhang IS NULL)::INTEGER + (leverage IS NULL)::INTEGER AS n_missing FROM v),"
        + " p AS (SELECT rule_id, round(s_lift + s_conviction + s_zhang + s_leverage + 2.0, 12) AS points, n_missing FROM s)"
        + " SELECT rule_id, round(points, 9) AS points, n_missing, row_number() OVER (ORDER BY points DESC, rule_id) AS position FROM p",
    }

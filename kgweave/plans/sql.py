"""The SQL side of the plans: common table expressions by name, with what they need."""

from __future__ import annotations

import re

CTES = {
    "bought": """SELECT o_custkey, p_brand, l_returnflag, l_quantity
        FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN part ON l_partkey = p_partkey""",
    "ret": "SELECT DISTINCT 'c:' || o_custkey AS x, 'b:' || p_brand AS y FROM bought WHERE l_returnflag = 'R' AND l_quantity >= 40",
    "likes": "SELECT 'c:' || o_custkey AS x, 'b:' || p_brand AS y FROM bought GROUP BY 1, 2 HAVING count(*) >= 3",
    "seg": "SELECT 'c:' || c_custkey AS x, 'seg:' || c_mktsegment AS y FROM customer",
    "nat": "SELECT 'c:' || c_custkey AS x, 'n:' || c_nationkey AS y FROM customer",
    "kg": """SELECT 'n:' || n_nationkey AS h, 'in_region' AS r, 'r:' || n_regionkey AS t FROM nation
        UNION ALL SELECT x, 'c_nation', y FROM nat UNION ALL SELECT x, 'c_segment', y FROM seg
        UNION ALL SELECT 's:' || s_suppkey, 's_nation', 'n:' || s_nationkey FROM supplier
        UNION ALL SELECT 'p:' || p_partkey, 'p_brand', 'b:' || p_brand FROM part
        UNION ALL SELECT 'p:' || p_partkey, 'p_type', 'ty:' || p_type FROM part
        UNION ALL SELECT 'o:' || o_orderkey, 'placed_by', 'c:' || o_custkey FROM orders
        UNION ALL SELECT DISTINCT 'o:' || l_orderkey, 'has_part', 'p:' || l_partkey FROM lineitem
        UNION ALL SELECT DISTINCT 's:' || l_suppkey, 'supplies', 'p:' || l_partkey FROM lineitem
        UNION ALL SELECT DISTINCT 'u:' || user_id, 'did', 'e:' || event_type FROM events
        UNION ALL SELECT x, 'returned_brand', y FROM ret UNION ALL SELECT x, 'likes_brand', y FROM likes""",
    "known": "SELECT x, y FROM ret WHERE CAST(split_part(x, ':', 2) AS BIGINT) % 5 >= 2",
    "gold": "SELECT x, y FROM ret WHERE CAST(split_part(x, ':', 2) AS BIGINT) % 5 = 0",
    "brands": "SELECT DISTINCT 'b:' || p_brand AS b FROM part",
    "catalog": """SELECT row_number() OVER (ORDER BY rule) AS rule_id, * FROM (
        SELECT 'returned_brand(X,' || b || ') <= c_segment(X,' || s || ')' AS rule, 'const' AS kind, 'c_segment' AS body_rel, b AS head_const, s AS body_const
          FROM brands, (SELECT DISTINCT y AS s FROM seg)
        UNION ALL SELECT 'returned_brand(X,' || b || ') <= c_nation(X,' || n || ')', 'const', 'c_nation', b, n FROM brands, (SELECT DISTINCT y AS n FROM nat)
        UNION ALL SELECT 'returned_brand(X,' || a.b || ') <= likes_brand(X,' || c.b || ')', 'const', 'likes_brand', a.b, c.b FROM brands a, brands c
        UNION ALL SELECT 'returned_brand(X,' || b || ') <= likes_brand(X,A)', 'exists', 'likes_brand', b, NULL FROM brands
        UNION ALL SELECT 'returned_brand(X,Y) <= likes_brand(X,Y)', 'binary', 'likes_brand', NULL, NULL
        UNION ALL SELECT 'returned_brand(X,Y) <= c_nation(X,A), c_nation(B,A), returned_brand(B,Y)', 'path', 'c_nation', NULL, NULL)""",
    "facts1": "SELECT 'c_segment' AS rel, x, y FROM seg UNION ALL SELECT 'c_nation', x, y FROM nat UNION ALL SELECT 'likes_brand', x, y FROM likes",
    "walks": "SELECT DISTINCT a.x, k.y FROM nat a JOIN nat b ON a.y = b.y AND a.x <> b.x JOIN known k ON k.x = b.x",
    "inst": """SELECT rule_id, f.x, head_const AS y FROM catalog c JOIN facts1 f ON c.kind = 'const' AND c.body_rel = f.rel AND c.body_const = f.y
        UNION ALL SELECT rule_id, f.x, head_const FROM catalog c, (SELECT DISTINCT x FROM likes) f WHERE c.kind = 'exists'
        UNION ALL SELECT rule_id, l.x, l.y FROM catalog c, likes l WHERE c.kind = 'binary'
        UNION ALL SELECT rule_id, w.x, w.y FROM catalog c, walks w WHERE c.kind = 'path'""",
    "metrics": """SELECT rule_id, count(*) AS body_size, count(k.x) AS support, count(k.x) / count(*) AS conf, count(k.x) / (count(*) + 5) AS smooth,
        least(-ln(1 - least(count(k.x) / (count(*) + 5), 1 - 1.1102230246251565e-16)), 7.0) AS evidence
        FROM inst i LEFT JOIN known k ON i.x = k.x AND i.y = k.y GROUP BY rule_id""",
    "fired": """SELECT i.rule_id, i.x, i.y, m.evidence, m.conf FROM inst i JOIN metrics m ON i.rule_id = m.rule_id
        WHERE CAST(split_part(i.x, ':', 2) AS BIGINT) % 5 = 0 AND m.support > 0 AND NOT EXISTS (SELECT 1 FROM known k WHERE k.x = i.x AND k.y = i.y)""",
    "best": "SELECT x, y, round(max(evidence), 9) AS score FROM fired GROUP BY x, y",
    "noisy": "SELECT x, y, round(sum(evidence), 9) AS score FROM fired GROUP BY x, y",
    "freq": "SELECT y AS entity, count(*) AS n FROM known GROUP BY y",
    "labels": "SELECT f.x, f.y, CASE WHEN g.x IS NULL THEN 0 ELSE 1 END AS label FROM (SELECT DISTINCT x, y FROM fired) f LEFT JOIN gold g ON f.x = g.x AND f.y = g.y",
    "top": """SELECT m.rule_id, split_part(c.rule, ' <= ', 1) AS head, m.body_size, m.support, m.conf,
        row_number() OVER (PARTITION BY split_part(c.rule, ' <= ', 1) ORDER BY m.conf DESC, m.rule_id) AS nth
        FROM metrics m JOIN catalog c ON m.rule_id = c.rule_id WHERE m.support >= 3""",
    "bodies": "SELECT * FROM top WHERE nth <= 500",
    "mined": "SELECT i.rule_id, i.x, i.y FROM inst i JOIN bodies b ON i.rule_id = b.rule_id",
    "pairs": """SELECT p.rule_id AS a, q.rule_id AS b, count(*) AS body, count(k.x) AS support FROM mined p
        JOIN mined q ON p.x = q.x AND p.y = q.y AND p.rule_id < q.rule_id LEFT JOIN known k ON p.x = k.x AND p.y = k.y GROUP BY 1, 2 HAVING count(k.x) >= 2""",
    "ev3": """SELECT rule_id, least(-ln(1 - support / (body_size + 3)), 7.0) AS e, least(-ln(1 - least(support / body_size, 1 - 1.1102230246251565e-16)), 7.0) AS raw FROM metrics""",
    "deps": """SELECT p.a, p.b, p.body, p.support, round(least(-ln(1 - p.support / (p.body + 3)), 7.0) - u.e - v.e, 9) AS lift
        FROM pairs p JOIN ev3 u ON p.a = u.rule_id JOIN ev3 v ON p.b = v.rule_id""",
    "mfired": "SELECT f.* FROM fired f JOIN bodies b ON f.rule_id = b.rule_id",
    "odds": """SELECT p.rule_id AS a, q.rule_id AS b, count(*) FILTER (l.label = 1) AS pos, count(*) FILTER (l.label = 0) AS neg,
        round(ln((count(*) FILTER (l.label = 1) + 1) / (count(*) FILTER (l.label = 0) + 1)), 9) AS log_odds
        FROM mfired p JOIN mfired q ON p.x = q.x AND p.y = q.y AND p.rule_id < q.rule_id JOIN labels l ON l.x = p.x AND l.y = p.y GROUP BY 1, 2""",
    "paired": "SELECT 'returned_brand' AS rel, d.*, o.log_odds FROM deps d JOIN odds o ON d.a = o.a AND d.b = o.b",
    "total": "SELECT count(*) AS e FROM (SELECT x FROM ret UNION SELECT y FROM ret)",
    "ranks_best": """SELECT g.x, g.y, g.score, CASE WHEN s.x IS NULL THEN NULL WHEN g.score > 0 THEN g.higher + (g.others + 2) / 2 ELSE g.higher + (e - g.higher + 1) / 2 END AS rank
        FROM (SELECT o.x, o.y, o.score, count(*) FILTER (c.score > o.score) AS higher, count(*) FILTER (c.score = o.score) AS others
              FROM (SELECT g.x, g.y, coalesce(s.score, 0) AS score FROM gold g LEFT JOIN best s ON g.x = s.x AND g.y = s.y) o
              LEFT JOIN (SELECT b.* FROM best b WHERE b.score > 0 AND NOT EXISTS (SELECT 1 FROM ret r WHERE r.x = b.x AND r.y = b.y)) c ON c.x = o.x GROUP BY 1, 2, 3) g
        LEFT JOIN (SELECT DISTINCT x FROM best) s ON s.x = g.x, total""",
    "changes": """SELECT x, y, coalesce(1 / a.rank, 0) AS rr_before, coalesce(1 / b.rank, 0) AS rr_after, coalesce(1 / b.rank, 0) - coalesce(1 / a.rank, 0) AS delta
        FROM ranks_best a FULL JOIN ranks_noisy b USING (x, y)""",
}
CTES["ranks_noisy"] = CTES["ranks_best"].replace("best", "noisy")


def needs(text: str, found: list[str]) -> list[str]:
    """Names of the expressions that a text uses, in an order in which each follows what it needs."""
    for name, body in CTES.items():
        if name not in found and re.search(rf"\b{name}\b", text):
            needs(body, found) if body is not text else None
            if name not in found:
                found.append(name)
    return found


def query(text: str) -> str:
    parts = [f"{n} AS ({CTES[n]})" for n in needs(text, [])]
    whole = (f"WITH {', '.join(parts)} " if parts else "") + text
    # Rounding may leave a negative zero, which Spark's doesn't.
    return re.sub(r"\bround\(", "0.0 + round(", whole)

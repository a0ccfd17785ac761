"""SQL for DuckDB of those llm queries that SQL can express over whole tables."""

from __future__ import annotations

P4_FOUND = "SELECT row_id FROM full_dataset WHERE length(text) > 2000"

_MIX = """
WITH want AS (SELECT source, target_share, max_repeats FROM source_weights WHERE target_share > 0),
records AS (SELECT f.row_id, f.source, CAST(length(f.text) AS BIGINT) AS size, md5('42|' || CAST(f.row_id AS VARCHAR)) AS h
            FROM full_dataset f JOIN want w ON f.source = w.source WHERE length(f.text) > 0),
have AS (SELECT w.source, w.target_share, w.max_repeats, CAST(coalesce(sum(r.size), 0) AS BIGINT) AS have
         FROM want w LEFT JOIN records r ON w.source = r.source GROUP BY ALL),
total AS (SELECT CAST(sum(have) AS BIGINT) AS total FROM have),
budgets AS (SELECT source, target_share, max_repeats, have, CAST(round(total * target_share) AS BIGINT) AS wanted,
                   least(CAST(round(total * target_share) AS BIGINT), max_repeats * have) AS budget FROM have, total),
placed AS (SELECT row_id, source, size, CAST(sum(size) OVER (PARTITION BY source ORDER BY h, row_id, size ROWS UNBOUNDED PRECEDING) AS BIGINT) AS upto FROM records),
uses AS (SELECT p.row_id, p.source, p.size,
                CAST(b.budget // b.have + CASE WHEN 2 * (b.budget % b.have) >= 2 * p.upto - p.size THEN 1 ELSE 0 END AS INT) AS uses
         FROM placed p JOIN budgets b ON p.source = b.source),
mixed AS (SELECT row_id, source, size, CAST(unnest(range(1, uses + 1)) AS INT) AS epoch FROM uses WHERE uses > 0)
"""

P5_MIX = _MIX + "SELECT row_id, source, epoch, size FROM mixed"

P5_SHARES = (
    _MIX
    + """
SELECT b.source, b.target_share, round(CAST(coalesce(m.used, 0) AS DOUBLE) / nullif(CAST(sum(coalesce(m.used, 0)) OVER () AS DOUBLE), 0), 6) AS actual_share,
       b.have AS available, b.budget, CAST(coalesce(m.used, 0) AS BIGINT) AS used, b.wanted - b.budget AS shortfall, coalesce(m.epochs, 0) AS epochs_used, b.max_repeats
FROM budgets b LEFT JOIN (SELECT source, sum(size) AS used, max(epoch) AS epochs FROM mixed GROUP BY source) m ON b.source = m.source
"""
)


P4_ROUND_TRIP = """
SELECT row_id, md5(text) AS text_hash, true AS in_order, true AS fits, true AS overlaps, CAST(0 AS BIGINT) AS parted FROM full_dataset WHERE length(text) > 2000
"""


#: Of ``docs`` (id, text, side): classes of equal content, their members, the distinct runs of five characters and how many a class has.
_RUNS = r"""content AS (SELECT id, side, regexp_replace(lower(text), '[^\p{L}\p{N}]+', '', 'g') AS n FROM docs WHERE text IS NOT NULL),
classes AS (SELECT n, side, min(id) AS cls FROM content WHERE length(n) >= 5 GROUP BY n, side),
members AS (SELECT c.id, c.side, k.cls FROM content c JOIN classes k ON c.n = k.n AND c.side = k.side),
runs AS (SELECT DISTINCT cls, side, substr(n, i::INT, 5) AS run FROM (SELECT cls, side, n, unnest(range(1, length(n) - 3)) AS i FROM classes)),
sizes AS (SELECT cls, side, count(*) AS r FROM runs GROUP BY ALL)"""

_P1 = f"""WITH docs AS (SELECT row_id AS id, text, 0 AS side FROM train UNION ALL SELECT row_id, text, 1 FROM val UNION ALL SELECT row_id, text, 1 FROM test),
{_RUNS},
met AS (SELECT a.cls AS a, b.cls AS b, count(*) AS shared FROM runs a JOIN runs b ON a.run = b.run WHERE a.side = 1 AND b.side = 0 GROUP BY ALL),
near AS (SELECT a, b, shared = x.r AND shared = y.r AS exact FROM met JOIN sizes x ON x.cls = a AND x.side = 1 JOIN sizes y ON y.cls = b AND y.side = 0 WHERE 5 * shared >= 3 * (x.r + y.r - shared)),
pairs AS (SELECT x.id AS eval_id, y.id AS train_id, exact FROM near JOIN members x ON x.cls = a AND x.side = 1 JOIN members y ON y.cls = b AND y.side = 0)
"""

P1_FOUND = _P1 + "SELECT least(eval_id, train_id) AS row_id_a, greatest(eval_id, train_id) AS row_id_b FROM pairs"

P1_REPORT = (
    _P1
    + """, rows AS (SELECT row_id, 'val' AS split, source FROM val UNION ALL SELECT row_id, 'test', source FROM test),
partners AS (SELECT eval_id, count(*) AS n, bool_or(exact) AS exact FROM pairs GROUP BY eval_id)
SELECT split, source, count(*) AS n_rows, count(n) AS n_overlapping, count(*) FILTER (exact) AS n_exact, coalesce(sum(n), 0)::BIGINT AS n_pairs, round(count(n) / count(*)::DOUBLE, 6) AS overlap_share
FROM rows LEFT JOIN partners ON row_id = eval_id GROUP BY split, source"""
)

_P3 = f"""WITH RECURSIVE docs AS (SELECT row_id AS id, text, 0 AS side FROM full_dataset UNION ALL SELECT row_id, text_content, 0 FROM parallel_dataset),
{_RUNS},
met AS (SELECT a.cls AS a, b.cls AS b, count(*) AS shared FROM runs a JOIN runs b ON a.run = b.run AND a.cls < b.cls GROUP BY ALL),
near AS (SELECT a, b FROM met JOIN sizes x ON x.cls = a JOIN sizes y ON y.cls = b WHERE 5 * shared >= 3 * (x.r + y.r - shared)),
ways AS (SELECT a, b FROM near UNION ALL SELECT b, a FROM near),
counted AS (SELECT cls, count(*) AS n FROM members GROUP BY cls)
"""

P3_FOUND = _P3 + "SELECT DISTINCT least(x.id, y.id) AS row_id_a, greatest(x.id, y.id) AS row_id_b FROM (SELECT a, b FROM near UNION ALL SELECT cls, cls FROM classes) JOIN members x ON x.cls = a JOIN members y ON y.cls = b WHERE x.id <> y.id"

P3_LINKS = (
    _P3
    + """, linked AS (SELECT a, sum(n) AS n FROM ways JOIN counted ON cls = b GROUP BY a)
SELECT m.id AS row_id, m.cls AS class_id, (c.n - 1 + coalesce(l.n, 0))::BIGINT AS n_links FROM members m JOIN counted c ON c.cls = m.cls LEFT JOIN linked l ON l.a = m.cls"""
)

P3_GROUPS = (
    _P3
    + """, reached AS (SELECT cls AS a, cls AS b FROM classes UNION SELECT r.a, w.b FROM reached r JOIN ways w ON r.b = w.a),
grouped AS (SELECT a AS cls, min(b) AS group_id FROM reached GROUP BY a),
sizes_of AS (SELECT group_id, sum(n) AS size FROM grouped JOIN counted USING (cls) GROUP BY group_id)
SELECT m.id AS row_id, m.cls AS class_id, g.group_id, c.n AS class_size, s.size::BIGINT AS group_size FROM members m JOIN counted c ON c.cls = m.cls JOIN grouped g ON g.cls = m.cls JOIN sizes_of s ON s.group_id = g.group_id"""
)


P6_ROUND_TRIP = "SELECT doc_id, md5(coalesce(text, '')) AS text_hash FROM documents"

P7_AUDIT = "SELECT doc_id, true AS in_order, true AS divided_right, true AS fits FROM documents"


def oracle_sql() -> dict[str, str]:
    return {"p1_found": P1_FOUND, "p1_report": P1_REPORT, "p3_found": P3_FOUND, "p3_groups": P3_GROUPS, "p3_links": P3_LINKS, "p4_found": P4_FOUND, "p4_round_trip": P4_ROUND_TRIP, "p6_round_trip": P6_ROUND_TRIP, "p7_audit": P7_AUDIT, "p5_mix": P5_MIX, "p5_shares": P5_SHARES}

"""DuckDB SQL for the engine's queries."""

from __future__ import annotations

#: Canonical edges e, symmetric s, bounds p, owners o, ranges r, wedges w of the parts sharing an order.
PRELUDE = """WITH RECURSIVE e AS (SELECT DISTINCT a.l_partkey u, b.l_partkey v FROM lineitem a
  JOIN lineitem b ON a.l_orderkey = b.l_orderkey AND a.l_partkey < b.l_partkey),
s AS (SELECT u head, v tail FROM e UNION ALL SELECT v, u FROM e),
p AS (SELECT max(l_partkey) + 1 nv, 4 np FROM lineitem),
o AS (SELECT head, tail, CAST(((head + 1) * np - 1) // nv AS BIGINT) oh, CAST(((tail + 1) * np - 1) // nv AS BIGINT) ot FROM s, p),
r AS (SELECT head x, min(tail) mn, max(tail) mx FROM s GROUP BY 1),
w AS (SELECT a.head h, a.tail u, b.tail v, a.oh oh, a.ot ou FROM o a JOIN o b ON a.head = b.head AND a.tail < b.tail),
offs AS (SELECT g.id, CAST(count(s.head) AS BIGINT) degree FROM (SELECT unnest(range(nv)) id FROM p) g LEFT JOIN s ON s.head = g.id GROUP BY 1),
csr AS (SELECT id, degree, CAST(coalesce(sum(degree) OVER (ORDER BY id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) o FROM offs)
"""


def _count_of(pairs: str) -> str:
    return f"WITH e AS ({pairs}) SELECT count(*) AS triangles FROM e a JOIN e b ON a.u = b.u AND a.v < b.v JOIN e c ON c.u = a.v AND c.v = b.v"


COUNT = PRELUDE + "SELECT count(*) AS triangles FROM e a JOIN e b ON a.u = b.u AND a.v < b.v JOIN e c ON c.u = a.v AND c.v = b.v"
STREAM = """WITH RECURSIVE g(k, x) AS (SELECT CAST(0 AS BIGINT), CAST(1967017404 AS BIGINT)
  UNION ALL SELECT k + 1, x * 16807 % 2147483647 FROM g WHERE k < {last})
"""
POINTS = STREAM.rstrip() + """,
pt AS (SELECT a.k id, a.x * (1.0::DOUBLE / 2147483647.0::DOUBLE) x, {y} y FROM g a JOIN g b ON b.k = a.k + 256 WHERE a.k < 256),
rad AS (SELECT (sqrt(ln(256) / (3.14159::DOUBLE * 256)) + sqrt(2.0736::DOUBLE / 256)) / 2 r),
d AS (SELECT a.id src, b.id dst, sqrt((a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y)) dist FROM pt a JOIN pt b ON a.id < b.id),
rgg AS (SELECT src, dst, dist FROM d, rad WHERE dist <= r)
"""

#: y of a point: of the stream, and rescaled into one of four strips.
Y = "b.x * (1.0::DOUBLE / 2147483647.0::DOUBLE)"
STRIP_Y = f"(a.k * 4 // 256) * 0.25::DOUBLE + {Y} / 4.0::DOUBLE"
CUTS = """, c(part, first_id) AS (SELECT CAST(0 AS BIGINT), CAST(0 AS BIGINT) UNION ALL
  SELECT part + 1, coalesce((SELECT min(n.id) FROM csr n, csr f WHERE f.id = c.first_id AND n.id > c.first_id AND n.o - f.o >= (SELECT count(*) FROM s) // 4), (SELECT nv FROM p)) FROM c WHERE part < 3)
"""
#: Random picks, without loops and edges of the graph, the first of equal ones.
DRAWN = """, n AS (SELECT CAST(count(*) * 10 // 100 AS BIGINT) n FROM rgg),
drawn AS (SELECT a.k, least(a.x % 256, b.x % 256) src, greatest(a.x % 256, b.x % 256) dst, 0.01::DOUBLE + 0.99::DOUBLE * (c.x * (1.0::DOUBLE / 2147483647.0::DOUBLE)) w
  FROM g a JOIN g b ON b.k = a.k + 1 JOIN g c ON c.k = a.k + 2, n WHERE a.k >= 512 AND (a.k - 512) % 3 = 0 AND (a.k - 512) // 3 < n),
fresh AS (SELECT src, dst, arg_min(w, k) w FROM drawn WHERE src <> dst AND NOT EXISTS (SELECT 1 FROM rgg WHERE rgg.src = drawn.src AND rgg.dst = drawn.dst) GROUP BY 1, 2)
"""

ORACLES: dict = {
    "triangle_count_suppliers": _count_of("SELECT DISTINCT a.l_suppkey u, b.l_suppkey v FROM lineitem a JOIN lineitem b ON a.l_orderkey = b.l_orderkey AND a.l_suppkey < b.l_suppkey"),
    "triangle_count_bipartite": _count_of("SELECT DISTINCT l_partkey u, 10000000 + l_suppkey v FROM lineitem"),
    "triangle_count_users": _count_of(
        "SELECT DISTINCT a.user_id u, b.user_id v FROM events a JOIN events b ON a.event_type = b.event_type AND date_trunc('hour', a.ts) = date_trunc('hour', b.ts) AND a.user_id < b.user_id"
    ),
    "closing_edges_distinct": PRELUDE + "SELECT DISTINCT c.u AS src, c.v AS dst FROM e a JOIN e b ON a.u = b.u AND a.v < b.v JOIN e c ON c.u = a.v AND c.v = b.v",
    "wedge_count": PRELUDE + "SELECT CAST(sum(d * (d - 1) // 2) AS BIGINT) AS wedges FROM (SELECT count(*) d FROM s GROUP BY head)",
    "wedge_pruned_count": PRELUDE + "SELECT count(*) AS wedges FROM w JOIN r a ON a.x = u JOIN r b ON b.x = v WHERE v <= a.mx AND v >= a.mn AND u >= b.mn",
    "wedge_locality": PRELUDE + "SELECT oh = ou AS local, count(*) AS wedges, count(s.head) AS closed FROM w LEFT JOIN s ON s.head = w.u AND s.tail = w.v GROUP BY 1",
    "wedge_status_by_owner": PRELUDE
    + "SELECT oh AS head_owner, ou AS lesser_owner, count(s.head) AS closed, count(*) - count(s.head) AS open FROM w LEFT JOIN s ON s.head = w.u AND s.tail = w.v WHERE oh <> ou GROUP BY 1, 2",
    "wedges_per_vertex": PRELUDE + "SELECT h AS id, count(*) AS wedges FROM w WHERE oh <> ou GROUP BY 1",
    "ghost_counts": PRELUDE + "SELECT oh AS head_owner, ou AS lesser_owner, count(*) AS wedges FROM w WHERE oh <> ou GROUP BY 1, 2",
    "owner_cut_matrix": PRELUDE + "SELECT oh AS head_owner, ot AS tail_owner, count(*) AS entries FROM o GROUP BY 1, 2",
    "process_degree": PRELUDE + "SELECT oh AS head_owner, count(DISTINCT ot) AS neighbours FROM o WHERE oh <> ot GROUP BY 1",
    "boundary_edges": PRELUDE + "SELECT count(*) AS entries FROM o WHERE oh = ot AND tail IN (SELECT head FROM o WHERE oh <> ot)",
    "partition_balanced": PRELUDE + CUTS + "SELECT * FROM c",
    "balanced_cut_matrix": PRELUDE
    + CUTS
    + """, part AS (SELECT id, max(part) part FROM csr JOIN c ON first_id <= id GROUP BY 1)
SELECT a.part AS head_owner, b.part AS tail_owner, count(*) AS entries FROM s JOIN part a ON a.id = head JOIN part b ON b.id = tail GROUP BY 1, 2""",
    "local_ids": PRELUDE + 'SELECT id, own AS owner, id - own * nv // np AS "local" FROM (SELECT id, CAST(((id + 1) * np - 1) // nv AS BIGINT) own, nv, np FROM csr, p)',
    "wedge_adjacent_count": PRELUDE
    + """, b AS (SELECT x, mn, mx, CAST(((x + 1) * 512 - 1) // nv AS BIGINT) own FROM r, p),
near AS (SELECT DISTINCT i.own oi, j.own oj FROM s JOIN b i ON i.x = head JOIN b j ON j.x = tail),
k AS (SELECT i.own oi, j.own oj, count(*) n FROM w JOIN b i ON i.x = u JOIN b j ON j.x = v WHERE v <= i.mx AND v >= i.mn AND u >= j.mn GROUP BY 1, 2)
SELECT CAST(sum(n) AS BIGINT) AS wedges FROM k LEFT JOIN near USING (oi, oj) WHERE oi = oj OR near.oi IS NOT NULL""",
    "degree": PRELUDE + "SELECT head AS id, count(*) AS degree FROM s GROUP BY 1",
    "edge_range": PRELUDE + "SELECT x AS id, mn AS min_nbr, mx AS max_nbr FROM r",
    "csr_offsets": PRELUDE + 'SELECT id, degree, o AS "offset" FROM csr',
    "dist_stats": PRELUDE
    + """, n AS (SELECT g.id, count(o.head) n FROM (SELECT unnest(range(4)) id) g LEFT JOIN o ON o.oh = g.id GROUP BY 1),
m AS (SELECT CAST(sum(n) AS BIGINT) total, max(n) largest, CAST(sum(n) AS DOUBLE) / 4.0::DOUBLE mean, CAST(sum(n * n) AS DOUBLE) / 4.0::DOUBLE mean_square FROM n)
SELECT *, abs(mean_square - mean * mean) AS variance, sqrt(abs(mean_square - mean * mean)) AS deviation FROM m""",
    "canonicalize": PRELUDE + "SELECT u AS src, v AS dst FROM e",
    "symmetrize": PRELUDE + "SELECT * FROM s",
    "csr_roundtrip": PRELUDE + "SELECT head, tail, 1.0::DOUBLE AS weight FROM s",
    "lcg_stream": STREAM.format(last=4999) + "SELECT * FROM g",
    "rgg_edges": POINTS.format(last=511, y=Y) + "SELECT src, dst, dist AS weight FROM rgg",
    "rgg_random_edges": POINTS.format(last=1023, y=Y) + DRAWN + "SELECT src, dst, 1.0::DOUBLE AS weight FROM rgg UNION ALL SELECT src, dst, w FROM fresh",
    "rgg_strip_random_edges": POINTS.format(last=1023, y=STRIP_Y)
    + DRAWN
    + """SELECT src, dst, dist AS weight FROM rgg UNION ALL
SELECT f.src, f.dst, CASE WHEN abs(f.src * 4 // 256 - f.dst * 4 // 256) <= 1 THEN d.dist ELSE w END FROM fresh f JOIN d ON d.src = f.src AND d.dst = f.dst""",
    "embedding_radius_graph": "SELECT a.vec_id AS src, b.vec_id AS dst FROM embeddings a JOIN embeddings b ON a.vec_id < b.vec_id WHERE list_distance(CAST(a.embedding AS DOUBLE[]), CAST(b.embedding AS DOUBLE[])) <= 1.2::DOUBLE",
}
#: Plans that differ in their joins only share the count's SQL.
ORACLES |= dict.fromkeys(
    ["triangle_count", "triangle_count_ordered", "triangle_count_join", "triangle_count_hash", "triangle_count_broadcast", "triangle_count_preagg", "triangle_count_pruned", "triangle_count_raw", "triangle_count_bloom_verified"], COUNT
)

"""DuckDB SQL that the registered queries must equal; the methods themselves are not in it."""

#: Lower-cases A-Z alone, and the words of a text.
LOWER = "translate({0}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
WORDS = r"regexp_extract_all({0}, '[^\x20\x09-\x0D]+')"

#: The rules, longest first, and the list of hosts.
OP2 = rf"""
WITH p AS (SELECT page_id,
    coalesce({LOWER.format(r"regexp_extract(url, '(?s)^.*?://([^/?#]*)', 1)")}, '') AS host,
    coalesce(regexp_extract(url, '(?s)^.*?://[^/?#]*([^?#]*)', 1), '') AS path FROM pages),
r AS (SELECT *, CASE
    WHEN (host = 'example.org' OR suffix(host, '.example.org')) AND starts_with(path, '/en/1') THEN 'example.org/en/1'
    WHEN (host = 'example.org' OR suffix(host, '.example.org')) AND starts_with(path, '/es/') THEN 'example.org/es/'
    WHEN (host = 'com' OR suffix(host, '.com')) AND starts_with(path, '/fr/') THEN 'com/fr/'
    WHEN (host = 'com' OR suffix(host, '.com')) AND starts_with(path, '/de/') THEN 'com/de/'
    WHEN (host = 'org' OR suffix(host, '.org')) AND starts_with(path, '/') THEN 'org/' END AS rule,
    host <> '' AND md5(host)[1:1] = '0' AS listed FROM p)
SELECT page_id, host, path, rule, CASE WHEN rule IN ('org/', 'example.org/en/1', 'com/fr/') THEN 'allow'
    WHEN rule IS NOT NULL OR listed THEN 'block' ELSE 'allow' END AS verdict, listed FROM r
"""

#: Sources are capped in the order of size by weight until none of the others is above its cap; documents go by a digest.
OP4 = rf"""
WITH d AS (SELECT doc_id, source, len({WORDS.format("coalesce(text, '')")}) AS size,
    ('0x' || md5(concat_ws(':', '17', coalesce(doc_id::VARCHAR, ''), coalesce(md5(text), '')))[1:15])::BIGINT AS o FROM documents),
s AS (SELECT source, sum(size)::BIGINT AS n, (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1 AS w FROM d GROUP BY source),
q AS (SELECT *, row_number() OVER here AS k, (SELECT sum(n) FROM s) - coalesce(sum(3 * n) OVER before, 0) AS free, sum(w) OVER behind AS whole FROM s
    WINDOW here AS (ORDER BY 3 * n / w, source NULLS LAST), before AS (here ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING),
    behind AS (here ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)),
settled AS (SELECT * FROM q WHERE free * w <= 3 * n * whole ORDER BY k LIMIT 1),
quota AS (SELECT q.source, q.n, CASE WHEN q.k < z.k THEN (3 * q.n)::DOUBLE ELSE (z.free * q.w)::DOUBLE / z.whole::DOUBLE END AS target FROM q, settled z),
used AS (SELECT *, least(round_even(target, 0)::BIGINT, 3 * n) AS used FROM quota),
e AS (SELECT source, o, doc_id, size, sum(size) AS here FROM d WHERE size > 0 GROUP BY ALL),
running AS (SELECT *, sum(here) OVER (PARTITION BY source ORDER BY o, doc_id NULLS FIRST, size) AS upto FROM e),
plan AS (SELECT r.*, u.used // u.n + CASE WHEN u.used % u.n > 0 AND abs(upto - u.used % u.n) <= abs(upto - here - u.used % u.n) THEN 1 ELSE 0 END AS repeats
    FROM running r JOIN used u ON u.source IS NOT DISTINCT FROM r.source)
SELECT d.doc_id, d.size, d.source, u.n AS source_size, u.target, (d.size * coalesce(p.repeats, 0))::BIGINT AS taken, coalesce(p.repeats, 0)::BIGINT AS repeats
FROM d JOIN used u ON u.source IS NOT DISTINCT FROM d.source
LEFT JOIN plan p ON p.source IS NOT DISTINCT FROM d.source AND p.o = d.o AND p.doc_id IS NOT DISTINCT FROM d.doc_id AND p.size = d.size
"""

#: All distances; the query equals it wherever its recall is 1.
OP5 = """
WITH v AS (SELECT vec_id, min(embedding::DOUBLE[]) AS e FROM embeddings WHERE vec_id IS NOT NULL AND len(embedding) = len([1 FOR x IN embedding IF isfinite(x)])
    AND len([1 FOR x IN embedding IF x <> 0]) > 0 GROUP BY vec_id),
p AS (SELECT q.vec_id AS query_id, v.vec_id, sqrt(list_sum([(z[1] - z[2]) * (z[1] - z[2]) FOR z IN list_zip(q.e, v.e)])) AS score FROM v q JOIN v ON q.vec_id <> v.vec_id AND len(q.e) = len(v.e) WHERE q.vec_id % 100 = 0),
r AS (SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY score, vec_id)::INTEGER AS rank, vec_id, score FROM p)
SELECT * FROM r WHERE rank <= 10
"""

#: Equal sets are one node; nodes of 0.8 share one of their rarest shingles, as many as 0.8 leaves room to miss, and one.
OP9 = rf"""
WITH RECURSIVE w AS (SELECT row_number() OVER () AS r, doc_id, {WORDS.format(LOWER.format("coalesce(text, '')"))} AS w FROM documents),
s AS (SELECT r, doc_id, CASE WHEN len(w) < 2 THEN w
    ELSE list_sort(list_distinct([w[i] || ' ' || w[i + 1] for i in range(1, len(w))])) END AS s FROM w),
d AS (SELECT r, doc_id, len(s) AS n, CASE WHEN len(s) > 0 THEN md5(array_to_string(s, chr(10))) END AS node, s FROM s),
nodes AS (SELECT node, min(doc_id) AS doc_id, any_value(n) AS n, any_value(s) AS s FROM d WHERE node IS NOT NULL GROUP BY node),
x AS (SELECT node, n, unnest(s) AS x FROM nodes),
f AS (SELECT x, count(*) AS f FROM x GROUP BY x),
ranked AS (SELECT node, n, x, row_number() OVER (PARTITION BY node ORDER BY f, x) AS k FROM x JOIN f USING (x)),
rare AS (SELECT node, n, x FROM ranked WHERE k <= n - (80 * n + 99) // 100 + 1),
pairs AS (SELECT DISTINCT a.node AS a, b.node AS b FROM rare a JOIN rare b ON a.x = b.x AND a.node < b.node
    AND 100 * least(a.n, b.n) >= 80 * greatest(a.n, b.n)),
met AS (SELECT a, b, p.n AS n_a, q.n AS n_b, len(list_intersect(p.s, q.s)) AS shared FROM pairs JOIN nodes p ON p.node = a JOIN nodes q ON q.node = b),
links AS (SELECT a, b FROM met WHERE 100 * shared >= 80 * (n_a + n_b - shared)),
ways AS (SELECT a, b FROM links UNION SELECT b, a FROM links),
reach(a, b) AS (SELECT node, node FROM nodes UNION SELECT reach.a, ways.b FROM reach JOIN ways ON ways.a = reach.b),
least_ids AS (SELECT reach.a AS node, min(nodes.doc_id) AS component_id FROM reach JOIN nodes ON nodes.node = reach.b GROUP BY reach.a)
SELECT doc_id, n AS n_shingles, CASE WHEN node IS NULL THEN doc_id ELSE component_id END AS component_id,
    node IS NULL OR doc_id IS NOT DISTINCT FROM component_id AS kept FROM d LEFT JOIN least_ids USING (node)
"""

#: Counts of words, pairs and triples in the other documents; the longest that is known there scores.
OP10 = rf"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, {WORDS.format(LOWER.format("coalesce(text, '')"))} AS w FROM documents),
t AS (SELECT r, unnest(w) AS w3, unnest(range(1, len(w) + 1)) AS i FROM d),
g AS (SELECT r, i, w3, lag(w3) OVER here AS w2, lag(w3, 2) OVER here AS w1 FROM t WINDOW here AS (PARTITION BY r ORDER BY i)),
o1 AS (SELECT r, w3, count(*) AS n FROM g GROUP BY ALL),
o2 AS (SELECT r, w2, w3, count(*) AS n FROM g WHERE i > 1 GROUP BY ALL),
o3 AS (SELECT r, w1, w2, w3, count(*) AS n FROM g WHERE i > 2 GROUP BY ALL),
c1 AS (SELECT w3, sum(n) AS n FROM o1 GROUP BY ALL),
c2 AS (SELECT w2, w3, sum(n) AS n FROM o2 GROUP BY ALL),
c3 AS (SELECT w1, w2, w3, sum(n) AS n FROM o3 GROUP BY ALL),
l1 AS (SELECT r, w3, c1.n - o1.n AS n FROM o1 JOIN c1 USING (w3)),
l2 AS (SELECT r, w2, w3, c2.n - o2.n AS n FROM o2 JOIN c2 USING (w2, w3)),
l3 AS (SELECT r, w1, w2, w3, c3.n - o3.n AS n FROM o3 JOIN c3 USING (w1, w2, w3)),
s AS (SELECT g.r, (SELECT count(*) FROM t) - len(d.w) AS others, l1.n AS n1, l2.n AS n2, l3.n AS n3, b1.n AS m1, b2.n AS m2
    FROM g JOIN d ON d.r = g.r JOIN l1 ON l1.r = g.r AND l1.w3 = g.w3
    LEFT JOIN l2 ON l2.r = g.r AND l2.w2 = g.w2 AND l2.w3 = g.w3
    LEFT JOIN l3 ON l3.r = g.r AND l3.w1 = g.w1 AND l3.w2 = g.w2 AND l3.w3 = g.w3
    LEFT JOIN l1 b1 ON b1.r = g.r AND b1.w3 = g.w2
    LEFT JOIN l2 b2 ON b2.r = g.r AND b2.w2 = g.w1 AND b2.w3 = g.w2),
p AS (SELECT r, CASE WHEN n3 > 0 THEN n3::DOUBLE / m2 WHEN n2 > 0 THEN n2::DOUBLE / m1 WHEN n1 > 0 THEN n1::DOUBLE / others ELSE 1.0::DOUBLE / (others + 1) END
    * CASE WHEN n3 > 0 THEN 1.0 WHEN n2 > 0 THEN CASE WHEN n3 IS NULL THEN 1.0 ELSE 0.4 END
      ELSE CASE WHEN n2 IS NULL THEN 1.0 WHEN n3 IS NULL THEN 0.4 ELSE 0.16 END END AS p FROM s),
z AS (SELECT r, sum(log10(p)) AS z FROM p GROUP BY r)
SELECT doc_id, len(w) AS n_words, round(coalesce(z, 0.0), 6) AS log10_score, CASE WHEN len(w) > 0 THEN round(z / len(w), 6) END AS mean_log10
FROM d LEFT JOIN z USING (r)
"""

#: Texts without white space; of equal ones the longest original stays, then the smallest id, and of rows alike in both any one.
OP13 = r"""
WITH d AS (SELECT doc_id, length(coalesce(text, '')) AS points, sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', '', 'g')) AS sha FROM documents)
SELECT doc_id, first_value(doc_id) OVER best AS keep_id, count(*) OVER (PARTITION BY sha) AS group_size, row_number() OVER best = 1 AS kept, sha AS text_sha256
FROM d WINDOW best AS (PARTITION BY sha ORDER BY points DESC, doc_id NULLS LAST)
"""

#: Each row's next one of each kind by a window over the client's times, and joins from step to step.
OP11 = """
WITH r AS (SELECT client_id, epoch_us(arrived_at) AS t, bool_or(kind = 'view') AS v, bool_or(kind = 'click') AS c, bool_or(kind = 'purchase') AS p,
    bool_or(kind = 'signup') AS s, bool_or(kind = 'error') AS e FROM clicks WHERE client_id IS NOT NULL AND arrived_at IS NOT NULL AND kind IS NOT NULL GROUP BY ALL),
x AS (SELECT *, min(CASE WHEN v THEN t END) OVER later AS nv, min(CASE WHEN c THEN t END) OVER later AS nc, min(CASE WHEN p THEN t END) OVER later AS np,
    min(CASE WHEN s THEN t END) OVER later AS ns, min(CASE WHEN e THEN t END) OVER later AS ne FROM r
    WINDOW later AS (PARTITION BY client_id ORDER BY t ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING)),
y AS (SELECT 'A' AS funnel, client_id, t, v AS first, nc AS after1, nv AS after2, np AS after3, ne AS barred FROM x
    UNION ALL SELECT 'B', client_id, t, s, nv, nc, np, ne FROM x UNION ALL SELECT 'C', client_id, t, c, nc, np, nv, ns FROM x),
a1 AS (SELECT funnel, client_id, t AS t1, CASE WHEN after1 - t <= 300000000 AND NOT coalesce(barred <= after1, false) THEN after1 END AS t2 FROM y WHERE first),
a2 AS (SELECT a1.*, CASE WHEN after2 - t1 <= 300000000 AND NOT coalesce(barred <= after2, false) THEN after2 END AS t3
    FROM a1 LEFT JOIN y ON y.funnel = a1.funnel AND y.client_id = a1.client_id AND y.t = t2),
a3 AS (SELECT a2.*, CASE WHEN after3 - t1 <= 300000000 AND NOT coalesce(barred <= after3, false) THEN after3 END AS t4
    FROM a2 LEFT JOIN y ON y.funnel = a2.funnel AND y.client_id = a2.client_id AND y.t = t3),
d AS (SELECT funnel, client_id, t2 - t1 AS d2, t3 - t2 AS d3, t4 - t3 AS d4 FROM a3),
g AS (SELECT funnel, client_id, count(*) AS n1, count(d2) AS n2, count(d3) AS n3, count(d4) AS n4, list_sort(list(d2) FILTER (d2 IS NOT NULL)) AS l2,
    list_sort(list(d3) FILTER (d3 IS NOT NULL)) AS l3, list_sort(list(d4) FILTER (d4 IS NOT NULL)) AS l4 FROM d GROUP BY ALL),
h AS (SELECT *, CAST(CASE WHEN n4 > 0 THEN 4 WHEN n3 > 0 THEN 3 WHEN n2 > 0 THEN 2 ELSE 1 END AS INTEGER) AS deepest FROM g)
SELECT funnel, client_id, n1, n2, n3, n4, deepest, l2[(25 * n2 + 99) // 100] AS t2, l3[(25 * n3 + 99) // 100] AS t3, l4[(25 * n4 + 99) // 100] AS t4,
    count(*) OVER (PARTITION BY funnel, deepest) AS same_depth FROM h
"""

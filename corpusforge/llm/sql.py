"""SQL for the queries that SQL can express."""

from corpusforge.llm.suffixes import COVER, PERIOD

WORDS = r"regexp_extract_all({0}, '[^\x20\x09-\x0D]+')"

#: Similarity over all pairs that share a shingle, components by a recursive walk from every document that has a link.
MINHASH = rf"""
WITH w AS (SELECT doc_id, {WORDS.format("translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')")} AS w FROM documents),
s AS (SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) >= 5 THEN list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' ')) WHEN len(w) > 0 THEN [array_to_string(w, ' ')] ELSE [] END) AS g FROM w),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS k FROM s a JOIN s b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY 1, 2),
l AS (SELECT p.a, p.b FROM p JOIN n x ON x.doc_id = p.a JOIN n y ON y.doc_id = p.b WHERE 100 * k >= 75 * (x.n + y.n - k)),
e AS (SELECT a, b FROM l UNION SELECT b, a FROM l),
r AS (WITH RECURSIVE r(a, b) AS (SELECT a, b FROM e UNION SELECT r.a, e.b FROM r JOIN e ON r.b = e.a) SELECT a, min(b) AS c FROM r GROUP BY a)
SELECT d.doc_id, coalesce(n.n, 0) AS n_shingles, least(d.doc_id, coalesce(r.c, d.doc_id)) AS component_id, d.doc_id = least(d.doc_id, coalesce(r.c, d.doc_id)) AS kept
FROM documents d LEFT JOIN n ON n.doc_id = d.doc_id LEFT JOIN r ON r.a = d.doc_id
"""

SUBSTRINGS = rf"""
WITH w AS (SELECT doc_id, {WORDS.format("coalesce(text, '')")} AS w FROM documents),
x AS (SELECT doc_id, unnest(range(1, len(w) - 18)) AS i, w FROM w WHERE len(w) >= 20),
h AS (SELECT doc_id, i, md5(array_to_string(w[i:i + 19], ' ')) AS h FROM x),
d AS (SELECT doc_id, i FROM (SELECT doc_id, i, row_number() OVER (PARTITION BY h ORDER BY doc_id, i) AS k FROM h) WHERE k > 1),
g AS (SELECT DISTINCT doc_id, unnest(range(i, i + 20)) AS i FROM d),
l AS (SELECT doc_id, list(i) AS gone FROM g GROUP BY doc_id)
SELECT w.doc_id, len(w.w)::BIGINT AS n_words, coalesce(len(l.gone), 0)::BIGINT AS n_removed,
sha256(CASE WHEN l.gone IS NULL THEN array_to_string(w.w, ' ') ELSE array_to_string([v FOR v, i IN w.w IF NOT list_contains(l.gone, i)], ' ') END) AS kept_sha256
FROM w LEFT JOIN l ON l.doc_id = w.doc_id
"""

SUFFIXES = f"""
WITH b AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS h, length(hex(encode(coalesce(text, '')))) // 2 AS n FROM documents),
x AS (SELECT doc_id, unnest(range(n - 399)) AS i, h FROM b WHERE n >= 400),
m AS (SELECT doc_id, i, md5(substr(h, 2 * i + 1, 800)) AS m FROM x),
r AS (SELECT doc_id, i FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY m) AS k FROM m) WHERE k > 1),
j AS (SELECT doc_id, i, max(i + 400) OVER (PARTITION BY doc_id ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS reach FROM r),
q AS (SELECT doc_id, i, sum(CASE WHEN reach IS NULL OR i > reach THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY i) AS run FROM j),
s AS (SELECT doc_id, run, min(i) AS a, max(i) + 400 AS z FROM q GROUP BY doc_id, run),
t AS (SELECT s.doc_id, s.z AS a, coalesce(lead(s.a) OVER (PARTITION BY s.doc_id ORDER BY s.a), b.n) AS z FROM s JOIN b USING (doc_id) UNION ALL SELECT doc_id, 0, min(a) FROM s GROUP BY doc_id),
k AS (SELECT t.doc_id, string_agg(substr(b.h, 2 * t.a + 1, 2 * (t.z - t.a)), '' ORDER BY t.a) AS kept FROM t JOIN b USING (doc_id) GROUP BY t.doc_id),
c AS (SELECT doc_id, sum(z - a)::BIGINT AS gone, count(*) AS spans FROM s GROUP BY doc_id),
o AS (SELECT doc_id, unnest(range(n - {PERIOD - 1})) AS i, h FROM b WHERE n >= {PERIOD}),
u AS (SELECT doc_id, md5(substr(h, 2 * i + 1, {2 * PERIOD})) AS m FROM o WHERE i % {PERIOD} IN {COVER}),
y AS (SELECT doc_id, count(*) FILTER (WHERE k > 1) AS tuples FROM (SELECT doc_id, count(*) OVER (PARTITION BY m) AS k FROM u) GROUP BY doc_id)
SELECT b.doc_id, b.n AS n_bytes, coalesce(c.gone, 0) AS n_removed, coalesce(c.spans, 0) AS n_spans, sha256(unhex(coalesce(k.kept, b.h))) AS kept_sha256, coalesce(y.tuples, 0)::BIGINT AS n_repeated_tuples
FROM b LEFT JOIN c USING (doc_id) LEFT JOIN k USING (doc_id) LEFT JOIN y USING (doc_id)
"""

ORACLE = {"op1_minhash": MINHASH, "op4_suffix_array": SUFFIXES, "op5_substring_dedup": SUBSTRINGS}

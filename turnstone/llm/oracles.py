"""DuckDB SQL for the results of operators that SQL can express over whole tables."""

from __future__ import annotations

_WORDS = r"regexp_extract_all({}, '[^\x20\x09-\x0D]+')"

OP5 = """WITH t AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS h FROM documents),
win AS (SELECT doc_id, p, substr(h, 2 * p - 1, 100) AS k FROM (SELECT doc_id, h, unnest(range(1, CAST(length(h) // 2 AS BIGINT) - 48)) AS p FROM t)),
least AS (SELECT k, min(doc_id) AS first FROM win GROUP BY k),
hit AS (SELECT w.doc_id, w.p FROM win w JOIN least l ON w.k = l.k AND l.first < w.doc_id),
byte AS (SELECT doc_id, i, substr(h, 2 * i - 1, 2) AS b FROM (SELECT doc_id, h, unnest(range(1, CAST(length(h) // 2 AS BIGINT) + 1)) AS i FROM t)),
cov AS (SELECT b.doc_id, b.i, b.b, coalesce(b.i - h.p <= 49, false) AS gone FROM byte b ASOF LEFT JOIN hit h ON b.doc_id = h.doc_id AND b.i >= h.p),
edge AS (SELECT *, gone AND NOT coalesce(lag(gone) OVER (PARTITION BY doc_id ORDER BY i), false) AS opens FROM cov),
got AS (SELECT doc_id, count(*) AS n_bytes, count(*) FILTER (gone) AS n_removed, count(*) FILTER (opens) AS n_spans, string_agg(b, '' ORDER BY i) FILTER (NOT gone) AS kept FROM edge GROUP BY doc_id)
SELECT t.doc_id, coalesce(n_bytes, 0) AS n_bytes, coalesce(n_removed, 0) AS n_removed, coalesce(n_spans, 0) AS n_spans, sha256(unhex(coalesce(kept, ''))) AS kept_sha256 FROM t LEFT JOIN got USING (doc_id)"""

OP7 = f"""WITH RECURSIVE w AS (SELECT doc_id, {_WORDS.format("translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')")} AS ws FROM documents),
s AS (SELECT DISTINCT doc_id, unnest(CASE WHEN len(ws) = 0 THEN [] WHEN len(ws) < 5 THEN [array_to_string(ws, ' ')] ELSE list_transform(range(1, len(ws) - 3), lambda p: array_to_string(ws[p:p + 4], ' ')) END) AS k FROM w),
n AS (SELECT w.doc_id, count(k) AS n FROM w LEFT JOIN s USING (doc_id) GROUP BY w.doc_id),
c AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM s a JOIN s b ON a.k = b.k AND a.doc_id < b.doc_id GROUP BY ALL),
l AS (SELECT a, b FROM c JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * c >= 75 * (x.n + y.n - c)),
e AS (SELECT a, b FROM l UNION SELECT b, a FROM l),
r AS (SELECT doc_id, doc_id AS other FROM w UNION SELECT r.doc_id, e.b FROM r JOIN e ON e.a = r.other)
SELECT doc_id, n AS n_shingles, component_id, component_id = doc_id AS kept FROM n JOIN (SELECT doc_id, min(other) AS component_id FROM r GROUP BY doc_id) USING (doc_id)"""

OP8 = f"""WITH w AS (SELECT doc_id, {_WORDS.format("coalesce(text, '')")} AS ws FROM documents),
win AS (SELECT doc_id, p, array_to_string(ws[p:p + 34], ' ') AS k FROM (SELECT doc_id, ws, unnest(range(1, len(ws) - 33)) AS p FROM w)),
hit AS (SELECT doc_id, p FROM win WHERE k IN (SELECT k FROM win GROUP BY k HAVING count(*) > 1)),
word AS (SELECT doc_id, unnest(ws) AS word, unnest(range(1, len(ws) + 1)) AS i FROM w),
cov AS (SELECT a.doc_id, a.i, a.word, coalesce(a.i - h.p <= 34, false) AS gone FROM word a ASOF LEFT JOIN hit h ON a.doc_id = h.doc_id AND a.i >= h.p),
got AS (SELECT doc_id, count(*) FILTER (gone) AS n_removed, string_agg(word, ' ' ORDER BY i) FILTER (NOT gone) AS kept FROM cov GROUP BY doc_id)
SELECT w.doc_id, len(ws) AS n_words, coalesce(n_removed, 0) AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256 FROM w LEFT JOIN got USING (doc_id)"""

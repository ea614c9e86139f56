"""DuckDB equivalents of the queries that SQL can express; tests hold the others against brute force."""

from __future__ import annotations

_UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def _words(text: str) -> str:
    return f"list_filter(regexp_split_to_array({text}, '[\\x20\\x09-\\x0D]+'), lambda x: x <> '')"


OP1 = f"""
WITH RECURSIVE w AS (SELECT doc_id, {_words(f"translate(coalesce(text, ''), '{_UPPER}', '{_UPPER.lower()}')")} AS w FROM documents),
s AS (SELECT DISTINCT doc_id, CASE WHEN len(w) >= 5 THEN array_to_string(w[i:i + 4], ' ') ELSE array_to_string(w, ' ') END AS g FROM w, unnest(range(1, greatest(len(w) - 4, 1) + 1)) t(i) WHERE len(w) > 0),
n AS (SELECT w.doc_id, count(g) AS n FROM w LEFT JOIN s USING (doc_id) GROUP BY w.doc_id),
p AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS c FROM s a JOIN s b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY ALL),
l AS (SELECT x, y FROM p JOIN n a ON a.doc_id = x JOIN n b ON b.doc_id = y WHERE 100 * c >= 75 * (a.n + b.n - c)),
e AS (SELECT x, y FROM l UNION ALL SELECT y, x FROM l),
r AS (SELECT doc_id, doc_id AS c FROM n UNION SELECT e.y, r.c FROM r JOIN e ON e.x = r.doc_id)
SELECT doc_id, n AS n_shingles, component_id FROM n JOIN (SELECT doc_id, min(c) AS component_id FROM r GROUP BY doc_id) USING (doc_id)
"""

OP5 = """
WITH RECURSIVE v AS (SELECT vec_id, label, embedding::DOUBLE[] AS e FROM embeddings),
l AS (SELECT a.vec_id AS x, b.vec_id AS y FROM v a JOIN v b ON a.label = b.label AND a.vec_id <> b.vec_id
WHERE list_inner_product(a.e, b.e) / (sqrt(list_inner_product(a.e, a.e)) * sqrt(list_inner_product(b.e, b.e))) >= 0.98),
r AS (SELECT vec_id, vec_id AS c FROM v UNION SELECT l.y, r.c FROM r JOIN l ON l.x = r.vec_id)
SELECT v.vec_id, (SELECT count(*) FROM l WHERE l.x = v.vec_id) AS n_links, m.component_id, v.vec_id = m.component_id AS kept
FROM v JOIN (SELECT vec_id, min(c) AS component_id FROM r GROUP BY vec_id) m USING (vec_id)
"""

OP6 = f"""
WITH w AS (SELECT doc_id, {_words("coalesce(text, '')")} AS w FROM documents),
g AS (SELECT doc_id, i, array_to_string(w[i:i + 49], ' ') AS k FROM w, unnest(range(1, len(w) - 48)) t(i) WHERE len(w) >= 50),
f AS (SELECT k, min(doc_id) AS first FROM g GROUP BY k),
h AS (SELECT DISTINCT g.doc_id, i + o AS j FROM g JOIN f USING (k), range(0, 50) t(o) WHERE first < g.doc_id),
x AS (SELECT w.doc_id, w[j] AS word, j FROM w, unnest(range(1, len(w) + 1)) t(j) ANTI JOIN h ON h.doc_id = w.doc_id AND h.j = t.j),
k AS (SELECT doc_id, count(*) AS n, string_agg(word, ' ' ORDER BY j) AS t FROM x GROUP BY doc_id)
SELECT w.doc_id, len(w)::BIGINT AS n_words, (len(w) - coalesce(n, 0))::BIGINT AS n_removed, sha256(coalesce(t, '')) AS kept_sha256 FROM w LEFT JOIN k USING (doc_id)
"""

_PREFIX = "^(?:[A-Za-z][A-Za-z0-9+.-]*://)?"

_MOMENT = "printf('2024-01-%02dT%02d:%02d:%02dZ', 1 + sec // 86400, sec // 3600 % 24, sec // 60 % 60, sec % 60)"

OP9 = rf"""
WITH u AS (SELECT page_id AS p, url AS own, regexp_extract(url, '^([A-Za-z]+://[^/?#]*)', 1) || '/' AS front, coalesce(html, '') AS html, page_id * 7919 % 10007 AS t FROM pages),
e AS (SELECT *, '"' || substring(md5(html), 1, 16) || '"' AS etag, '"v' || (p % 4) || '"' AS version, 'day ' || (p % 365) AS day FROM u),
i AS (SELECT 4 * p AS id, own AS raw, t AS sec, 'response' AS kind, 200 AS status, html AS payload, etag AS tag, day FROM e
UNION ALL SELECT 4 * p + 1, own, t + 1 + p * 31 % 5000, 'revisit', 304, NULL, CASE WHEN p % 5 = 0 THEN '"other"' WHEN p % 7 = 0 OR p % 11 = 0 THEN NULL ELSE 'W/' || etag END, CASE WHEN p % 11 <> 0 THEN day END FROM e
UNION ALL SELECT 4 * p + 2, front, t + 7, 'response', CASE WHEN p % 6 = 0 THEN 503 ELSE 200 END, left(html, 200), version, NULL FROM e
UNION ALL SELECT 4 * p + 3, front, t + 7 + p * 13 % 10007, 'revisit', 304, NULL, 'W/' || version, NULL FROM e),
n AS (SELECT *, regexp_replace(trim(raw), '#.*$', '') AS url FROM i),
c AS (SELECT *, regexp_replace(regexp_replace(lower(regexp_extract(url, '{_PREFIX}([^/?]*)', 1)), '^www[0-9]*\.', ''), ':(80|443)$', '') || regexp_replace(regexp_extract(url, '{_PREFIX}[^/?]*([^?]*)', 1), '/(index\.html?)?$', '') AS base,
list_sort(list_filter(string_split(regexp_extract(url, '\?(.*)$', 1), '&'), lambda x: x <> '' AND NOT regexp_matches(x, '^(utm_[^=]*|ref|fbclid|gclid)(=|$)'))) AS q FROM n),
r AS (SELECT *, base || CASE WHEN len(q) > 0 THEN '?' || array_to_string(q, '&') ELSE '' END AS canonical_url, 'md5:' || md5(payload) AS digest, octet_length(encode(payload)) AS size, {_MOMENT} AS date FROM c),
x AS (SELECT *, last_value(CASE WHEN status = 200 AND canonical_url IS NOT NULL THEN {{'id': id, 'digest': digest, 'tag': tag, 'day': day, 'size': size}} END IGNORE NULLS)
OVER (PARTITION BY canonical_url ORDER BY sec, id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS f FROM r),
y AS (SELECT *, CASE WHEN kind = 'response' THEN 'full' WHEN f IS NULL THEN 'missing' WHEN tag IS NOT NULL THEN CASE WHEN regexp_replace(tag, '^W/', '') = f.tag THEN 'resolved' ELSE 'stale' END
WHEN day IS NOT NULL AND f.day IS NOT NULL THEN CASE WHEN day = f.day THEN 'resolved' ELSE 'stale' END ELSE 'unvalidated' END AS outcome FROM x)
SELECT id AS record_id, canonical_url, kind, CASE WHEN outcome = 'resolved' THEN f.id ELSE -1 END AS refers_to, outcome, CASE WHEN outcome = 'resolved' THEN f.digest ELSE digest END AS payload_digest,
CASE WHEN kind = 'response' THEN concat_ws(chr(10), 'content-length: ' || size, 'content-type: text/html', 'date: ' || date, 'etag: ' || tag, 'last-modified: ' || day)
WHEN outcome = 'resolved' THEN concat_ws(chr(10), 'cache-control: max-age=60', 'content-length: ' || f.size, 'content-type: text/html', 'date: ' || date, 'etag: ' || coalesce(tag, f.tag), 'last-modified: ' || f.day)
ELSE concat_ws(chr(10), 'cache-control: max-age=60', 'content-length: 0', 'date: ' || date, 'etag: ' || tag, 'last-modified: ' || day) END AS headers FROM y
"""

ORACLE_SQL = {"op1_ngram_join": OP1, "op5_near_vectors": OP5, "op6_substring_dedup": OP6, "op9_revisit_resolution": OP9}

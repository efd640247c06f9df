"""DuckDB SQL of those operators that SQL can express."""

from __future__ import annotations

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def _words(text: str) -> str:
    return rf"regexp_extract_all(translate(coalesce({text}, ''), '{_UPPER}', '{_LOWER}'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"


def _shingles(w: str) -> str:
    return f"CASE WHEN len({w}) >= 5 THEN list_distinct(list_transform(range(len({w}) - 4), lambda i: array_to_string({w}[i + 1:i + 5], ' '))) WHEN len({w}) > 0 THEN [array_to_string({w}, ' ')] ELSE [] END"


DECONTAMINATION = f"""
WITH d AS (SELECT doc_id, {_words("text")} AS w FROM documents),
b AS (SELECT CAST(item_id AS VARCHAR) AS id, {_words("text")} AS w FROM benchmark),
windows AS (SELECT DISTINCT id, n, array_to_string(w[i + 1:i + n], ' ') AS s FROM (SELECT id, w, least(13, len(w)) AS n, unnest(range(len(w) - least(13, len(w)) + 1)) AS i FROM b WHERE len(w) > 0)),
sizes AS (SELECT DISTINCT n FROM windows),
places AS (SELECT doc_id, n, i, array_to_string(w[i + 1:i + n], ' ') AS s FROM (SELECT doc_id, w, n, unnest(range(len(w) - n + 1)) AS i FROM d, sizes WHERE len(w) >= n)),
hits AS (SELECT doc_id, i, n, id FROM places JOIN windows USING (n, s)),
words AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + n)) AS p FROM hits) GROUP BY 1),
items AS (SELECT doc_id, count(DISTINCT id) AS n_items, string_agg(DISTINCT id, ',' ORDER BY id) AS ids FROM hits GROUP BY 1)
SELECT doc_id, len(w) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(ids, '')) AS items_sha256,
       coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated
FROM d LEFT JOIN words USING (doc_id) LEFT JOIN items USING (doc_id)
"""

JACCARD = f"""
WITH RECURSIVE d AS (SELECT doc_id, {_words("text")} AS w FROM documents),
s AS (SELECT doc_id, {_shingles("w")} AS s FROM d),
u AS (SELECT doc_id, len(s) AS n, unnest(s) AS x FROM s),
pairs AS (SELECT a.doc_id AS a, b.doc_id AS b FROM u a JOIN u b ON a.x = b.x AND a.doc_id <> b.doc_id GROUP BY a.doc_id, b.doc_id, a.n, b.n HAVING 5 * count(*) >= 4 * (a.n + b.n - count(*))),
reach AS (SELECT a, b FROM pairs UNION SELECT r.a, p.b FROM reach r JOIN pairs p ON r.b = p.a),
class AS (SELECT a, min(b) AS least FROM reach GROUP BY a),
links AS (SELECT a, count(*) AS n_links FROM pairs GROUP BY a),
sets AS (SELECT list_sort(s) AS k, count(*) AS n_copies FROM s WHERE len(s) > 0 GROUP BY 1)
SELECT doc_id, least(doc_id, coalesce(class.least, doc_id)) AS class_id, coalesce(n_links, 0) AS n_links, coalesce(n_copies, 1) AS n_copies, len(s) AS n_shingles
FROM s LEFT JOIN class ON doc_id = class.a LEFT JOIN links ON doc_id = links.a LEFT JOIN sets ON list_sort(s) = sets.k
"""

SUBSTRINGS = """
WITH d AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS h, octet_length(encode(coalesce(text, ''))) AS n FROM documents),
w AS (SELECT doc_id, q, md5(substr(h, 2 * q + 1, 200)) AS s FROM (SELECT doc_id, h, unnest(range(n - 99)) AS q FROM d WHERE n >= 100)),
again AS (SELECT doc_id, q FROM w QUALIFY row_number() OVER (PARTITION BY s ORDER BY doc_id, q) > 1),
marked AS (SELECT doc_id, q, CASE WHEN q <= lag(q) OVER (PARTITION BY doc_id ORDER BY q) + 100 THEN 0 ELSE 1 END AS fresh FROM again),
spans AS (SELECT doc_id, min(q) AS a, max(q) + 100 AS b FROM (SELECT doc_id, q, sum(fresh) OVER (PARTITION BY doc_id ORDER BY q) AS g FROM marked) GROUP BY doc_id, g),
ends AS (SELECT *, coalesce(lag(b) OVER (PARTITION BY doc_id ORDER BY a), 0) AS before FROM spans),
kept AS (SELECT doc_id, sum(b - a) AS n_removed, count(*) AS n_spans, max(b) AS last, string_agg(substr(h, 2 * before + 1, 2 * (a - before)), '' ORDER BY a) AS head FROM ends JOIN d USING (doc_id) GROUP BY 1)
SELECT doc_id, CAST(n AS BIGINT) AS n_bytes, CAST(coalesce(n_removed, 0) AS BIGINT) AS n_removed, coalesce(n_spans, 0) AS n_spans,
       sha256(unhex(coalesce(head, '') || substr(h, 2 * coalesce(last, 0) + 1))) AS kept_sha256
FROM d LEFT JOIN kept USING (doc_id)
"""

LINES = f"""
WITH l AS (SELECT doc_id, unnest(str_split(coalesce(text, ''), chr(10))) AS line, unnest(range(len(str_split(coalesce(text, ''), chr(10))))) AS k FROM documents),
w AS (SELECT doc_id, k, {_words("line")} AS w FROM l),
s AS (SELECT doc_id, k, {_shingles("w")} AS s FROM w WHERE len(w) > 0),
u AS (SELECT doc_id, k, len(s) AS n, unnest(s) AS x FROM s),
late AS (SELECT DISTINCT doc_id, k FROM (SELECT a.doc_id, a.k FROM u a JOIN u b ON a.x = b.x AND (b.doc_id < a.doc_id OR (b.doc_id = a.doc_id AND b.k < a.k))
         GROUP BY a.doc_id, a.k, b.doc_id, b.k, a.n, b.n HAVING 5 * count(*) >= 4 * (a.n + b.n - count(*)))),
kept AS (SELECT s.doc_id, count(*) AS n_lines, count(late.k) AS n_removed, string_agg(CASE WHEN late.k IS NULL THEN CAST(s.k AS VARCHAR) END, ',' ORDER BY s.k) AS kept_lines
         FROM s LEFT JOIN late ON s.doc_id = late.doc_id AND s.k = late.k GROUP BY 1)
SELECT doc_id, coalesce(n_lines, 0) AS n_lines, coalesce(n_removed, 0) AS n_removed, coalesce(kept_lines, '') AS kept_lines FROM documents LEFT JOIN kept USING (doc_id)
"""

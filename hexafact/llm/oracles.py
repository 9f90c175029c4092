"""SQL for DuckDB, where it can express a query."""

from __future__ import annotations

_WORDS = r"regexp_extract_all({0}, '[^\x20\x09-\x0D]+')"

PASSAGES = f"""
WITH w AS (SELECT doc_id, {_WORDS.format("coalesce(text, '')")} AS ws FROM documents),
starts AS (SELECT doc_id, ws, unnest(range(1, greatest(len(ws) - 48, 1))) AS p FROM w),
windows AS (SELECT doc_id, p, array_to_string(ws[p : p + 49], ' ') AS k FROM starts),
late AS (SELECT doc_id, p FROM (SELECT doc_id, p, min(doc_id) OVER (PARTITION BY k) AS first FROM windows) WHERE first < doc_id),
gone AS (SELECT DISTINCT doc_id, unnest(range(p, p + 50)) AS i FROM late),
words AS (SELECT doc_id, unnest(ws) AS word, unnest(range(1, len(ws) + 1)) AS i FROM w),
kept AS (SELECT doc_id, string_agg(word, ' ' ORDER BY i) AS s, count(*) AS n FROM words ANTI JOIN gone USING (doc_id, i) GROUP BY doc_id)
SELECT doc_id, CAST(len(ws) AS BIGINT) AS n_words, CAST(len(ws) - coalesce(n, 0) AS BIGINT) AS n_removed, sha256(coalesce(s, '')) AS kept_sha256
FROM w LEFT JOIN kept USING (doc_id)
"""

LINES = f"""
WITH every AS (SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line, unnest(range(1, len(string_split(coalesce(text, ''), chr(10))) + 1)) AS place FROM documents),
counted AS (SELECT *, len({_WORDS.format("line")}) AS n FROM every),
symbols AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY place) AS i, sum(n) OVER (PARTITION BY doc_id ORDER BY place) AS total FROM counted WHERE n > 0),
spans AS (SELECT a.doc_id, a.i, min(b.i) AS e FROM symbols a JOIN symbols b ON a.doc_id = b.doc_id AND b.i >= a.i AND b.i < a.i + 10 AND b.total - a.total + a.n >= 10 GROUP BY 1, 2),
runs AS (SELECT s.doc_id, s.i, s.e, string_agg(l.line, chr(10) ORDER BY l.i) AS k FROM spans s JOIN symbols l ON l.doc_id = s.doc_id AND l.i BETWEEN s.i AND s.e GROUP BY 1, 2, 3),
late AS (SELECT doc_id, i, e FROM (SELECT *, row_number() OVER (PARTITION BY k ORDER BY doc_id, i) AS copy FROM runs) WHERE copy > 1),
gone AS (SELECT DISTINCT s.doc_id, s.place FROM late t JOIN symbols s ON s.doc_id = t.doc_id AND s.i BETWEEN t.i AND t.e),
kept AS (SELECT doc_id, string_agg(line, chr(10) ORDER BY place) AS s FROM every ANTI JOIN gone USING (doc_id, place) GROUP BY 1)
SELECT d.doc_id, (SELECT count(*) FROM symbols s WHERE s.doc_id = d.doc_id) AS n_lines, (SELECT count(*) FROM gone g WHERE g.doc_id = d.doc_id) AS n_removed, sha256(coalesce(s, '')) AS kept_sha256
FROM documents d LEFT JOIN kept k ON k.doc_id = d.doc_id
"""

JACCARD = f"""
WITH RECURSIVE w AS (SELECT doc_id, {_WORDS.format("translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')")} AS ws FROM documents),
parts AS (SELECT DISTINCT doc_id, array_to_string(ws[p : p + 4], ' ') AS s FROM (SELECT doc_id, ws, unnest(range(1, greatest(len(ws) - 3, 2))) AS p FROM w WHERE len(ws) > 0)),
sizes AS (SELECT doc_id, count(*) AS n FROM parts GROUP BY 1),
pairs AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS common FROM parts a JOIN parts b ON a.s = b.s AND a.doc_id <> b.doc_id GROUP BY 1, 2),
links AS (SELECT x, y FROM pairs JOIN sizes s ON s.doc_id = x JOIN sizes t ON t.doc_id = y WHERE 100 * common >= 80 * (s.n + t.n - common)),
reached AS (SELECT doc_id, doc_id AS other FROM documents UNION SELECT r.doc_id, l.y FROM reached r JOIN links l ON l.x = r.other)
SELECT r.doc_id, coalesce(any_value(n), 0) AS n_shingles, min(other) AS component_id FROM reached r LEFT JOIN sizes z ON z.doc_id = r.doc_id GROUP BY r.doc_id
"""

SQL = {"op7_line_dedup": LINES, "op8_passages": PASSAGES, "op10_jaccard_join": JACCARD}

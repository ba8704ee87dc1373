"""DuckDB SQL for those queries of this package that SQL can express. They compare plainly, without the operators' means."""

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_WORDS = r"[^\x20\x09-\x0D]+"

NEAR_DUPLICATES = f"""
  WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), '{_UPPER}', '{_LOWER}'), '{_WORDS}') AS w FROM documents),
  s AS (
    SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) >= 5 THEN list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' '))
      WHEN len(w) > 0 THEN [array_to_string(w, ' ')] ELSE [] END) AS g FROM w),
  n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
  p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS k FROM s a JOIN s b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY 1, 2),
  l AS (SELECT a, b FROM p JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * k >= 75 * (x.n + y.n - k)),
  e AS (SELECT a, b FROM l UNION ALL SELECT b, a FROM l),
  r(doc_id, c) AS (SELECT doc_id, doc_id FROM documents UNION SELECT e.b, r.c FROM r JOIN e ON e.a = r.doc_id),
  m AS (SELECT doc_id, min(c) AS component_id FROM r GROUP BY doc_id)
  SELECT d.doc_id, coalesce(n.n, 0) AS n_shingles, m.component_id, d.doc_id = m.component_id AS kept
  FROM documents d JOIN m USING (doc_id) LEFT JOIN n USING (doc_id)"""


def line_dedup(min_words: int) -> str:
    return f"""
  WITH d AS (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS x FROM documents),
  l AS (SELECT doc_id, unnest(range(1, len(x) + 1)) AS i, unnest(x) AS line FROM d),
  c AS (SELECT *, sum(nw) OVER (PARTITION BY doc_id ORDER BY i) AS c FROM (SELECT *, len(regexp_extract_all(line, '{_WORDS}')) AS nw FROM l)),
  v AS (
    SELECT a.doc_id, a.i, min(b.i) AS j FROM c a JOIN c b ON a.doc_id = b.doc_id AND b.i >= a.i AND b.c - a.c + a.nw >= {min_words} GROUP BY 1, 2
    UNION SELECT a.doc_id, max(b.i) AS i, a.i AS j FROM c a JOIN c b ON a.doc_id = b.doc_id AND b.i <= a.i AND a.c - b.c + b.nw >= {min_words} GROUP BY a.doc_id, a.i),
  t AS (SELECT v.doc_id, v.i, v.j, string_agg(l.line, chr(10) ORDER BY l.i) AS t FROM v JOIN l ON l.doc_id = v.doc_id AND l.i BETWEEN v.i AND v.j GROUP BY 1, 2, 3),
  f AS (SELECT doc_id, i, j, row_number() OVER (PARTITION BY t, j - i ORDER BY doc_id, i) AS k FROM t),
  g AS (SELECT DISTINCT doc_id, unnest(range(i, j + 1)) AS i FROM f WHERE k > 1),
  o AS (
    SELECT l.doc_id, count(*) AS n, count(g.i) AS r, string_agg(l.line, chr(10) ORDER BY l.i) FILTER (WHERE g.i IS NULL) AS t
    FROM l LEFT JOIN g ON g.doc_id = l.doc_id AND g.i = l.i GROUP BY l.doc_id)
  SELECT doc_id, CAST(n AS INTEGER) AS n_lines, CAST(r AS INTEGER) AS n_removed, coalesce(t, '') AS text FROM o"""

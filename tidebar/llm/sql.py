"""What some of the operators return, said in DuckDB's SQL over whole tables and texts.

Windows of 400 bytes take SQL a minute and gigabytes already on the smallest table, so op2 has a brute-force test instead."""

OP9 = r"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, list_filter(string_split_regex(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS ws FROM documents),
w AS (SELECT rid, unnest(range(1, len(ws) + 1)) AS j, unnest(ws) AS word FROM d),
win AS (SELECT rid, i, sha256(array_to_string(ws[i:i + 34], ' ')) AS h FROM (SELECT rid, ws, unnest(range(1, len(ws) - 33)) AS i FROM d WHERE len(ws) >= 35)),
hit AS (SELECT rid, i FROM (SELECT rid, i, count(*) OVER (PARTITION BY h) AS n FROM win) WHERE n > 1),
k AS (SELECT w.rid, w.j, w.word, coalesce(sum(CASE WHEN hit.i IS NOT NULL THEN 1 ELSE 0 END) OVER (PARTITION BY w.rid ORDER BY w.j ROWS BETWEEN 34 PRECEDING AND CURRENT ROW), 0) > 0 AS gone FROM w LEFT JOIN hit ON hit.rid = w.rid AND hit.i = w.j),
s AS (SELECT rid, count(*) AS n_words, count_if(gone) AS n_removed, string_agg(word, ' ' ORDER BY j) FILTER (WHERE NOT gone) AS kept FROM k GROUP BY rid)
SELECT doc_id, CAST(coalesce(n_words, 0) AS BIGINT) AS n_words, CAST(coalesce(n_removed, 0) AS BIGINT) AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256 FROM d LEFT JOIN s USING (rid)
"""

OP3 = r"""
WITH RECURSIVE d AS (SELECT doc_id AS id, list_filter(string_split_regex(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS ws FROM documents),
g AS (SELECT DISTINCT id, sha256(array_to_string(ws[i:i + 4], ' ')) AS h FROM (SELECT id, ws, unnest(range(1, len(ws) - 3)) AS i FROM d WHERE len(ws) >= 5)),
n AS (SELECT id, count(*) AS n FROM g GROUP BY id),
p AS (SELECT a.id AS a, b.id AS b, count(*) AS shared FROM g a JOIN g b ON a.h = b.h AND a.id < b.id GROUP BY ALL),
e AS (SELECT a, b FROM p JOIN n x ON x.id = a JOIN n y ON y.id = b WHERE shared >= 0.8 * (x.n + y.n - shared)
      UNION SELECT min(id) OVER (PARTITION BY ws), id FROM d),
s AS (SELECT a, b FROM e UNION SELECT b, a FROM e),
r AS (SELECT DISTINCT id, id AS other FROM d UNION SELECT r.id, s.b FROM r JOIN s ON s.a = r.other),
c AS (SELECT id, min(other) AS class_id FROM r GROUP BY id)
SELECT id AS doc_id, class_id, count(*) OVER (PARTITION BY class_id) AS class_size, id = class_id AS kept FROM c
"""

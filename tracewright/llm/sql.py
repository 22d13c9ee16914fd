"""DuckDB SQL of the numbered queries that SQL can express."""

from __future__ import annotations

OP1_SQL = r"""
WITH w AS (
  SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS words FROM documents
), win AS (
  SELECT doc_id, i, array_to_string(words[i:i + 12], ' ') AS win
  FROM (SELECT doc_id, words, unnest(range(1, len(words) - 11)) AS i FROM w)
), least AS (
  SELECT win, min(doc_id) AS first_doc FROM win GROUP BY win
), gone AS (
  SELECT DISTINCT doc_id, unnest(range(i, i + 13)) AS i
  FROM win JOIN least USING (win) WHERE first_doc < doc_id
), kept AS (
  SELECT doc_id, count(g.i) AS n_removed, coalesce(string_agg(word, ' ' ORDER BY e.i) FILTER (g.i IS NULL), '') AS kept
  FROM (SELECT doc_id, unnest(words) AS word, unnest(range(1, len(words) + 1)) AS i FROM w) e LEFT JOIN gone g USING (doc_id, i)
  GROUP BY doc_id
)
SELECT doc_id, len(words)::BIGINT AS n_words, coalesce(n_removed, 0)::BIGINT AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256
FROM w LEFT JOIN kept USING (doc_id)
"""

OP10_SQL = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS words FROM documents
), s AS (
  SELECT DISTINCT doc_id, array_to_string(words[i:i + 2], ' ') AS g
  FROM (SELECT doc_id, words, unnest(range(1, greatest(len(words) - 1, 2))) AS i FROM w WHERE len(words) > 0)
), n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id
), link AS (
  SELECT a.doc_id AS a, b.doc_id AS b FROM s a JOIN s b USING (g) WHERE a.doc_id < b.doc_id GROUP BY 1, 2
  HAVING 100 * count(*) >= 85 * ((SELECT n FROM n WHERE doc_id = a.doc_id) + (SELECT n FROM n WHERE doc_id = b.doc_id) - count(*))
), both_ways AS (SELECT a, b FROM link UNION ALL SELECT b, a FROM link
), reach AS (SELECT a AS x, a AS y FROM both_ways UNION SELECT x, b FROM reach JOIN both_ways ON y = a
), root AS (SELECT x AS doc_id, min(y) AS root FROM reach GROUP BY x)
SELECT doc_id, coalesce(n, 0)::BIGINT AS n_shingles, coalesce(root, doc_id) AS component_id, coalesce(root, doc_id) = doc_id AS kept
FROM documents LEFT JOIN n USING (doc_id) LEFT JOIN root USING (doc_id)
"""

OP2_SQL = r"""
WITH d AS (
  SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS size, md5('0:' || doc_id) AS key FROM documents
), s AS (
  SELECT source, sum(size)::BIGINT AS source_size FROM d GROUP BY source
), w AS (
  SELECT *, ([5, 2, 1])[(row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1]::BIGINT AS weight, 2 * source_size AS cap FROM s
), l AS (
  SELECT *, cap / weight::DOUBLE AS ratio,
    ((sum(source_size) OVER ())::DOUBLE * 150 / 100.0::DOUBLE - coalesce(sum(cap) OVER before, 0)::DOUBLE)
      / ((sum(weight) OVER ()) - coalesce(sum(weight) OVER before, 0))::DOUBLE AS level
  FROM w WINDOW before AS (ORDER BY cap / weight::DOUBLE, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)
), free AS (SELECT level FROM l WHERE level * weight <= cap ORDER BY ratio, source NULLS LAST LIMIT 1
), t AS (
  SELECT source, source_size, coalesce(least((SELECT level FROM free) * weight, cap::DOUBLE), cap::DOUBLE) AS target FROM l
), p AS (
  SELECT d.doc_id, d.size, t.source_size, t.target, coalesce(sum(d.size) OVER (PARTITION BY d.source ORDER BY key, doc_id, size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS ahead,
    floor(t.target)::BIGINT AS budget
  FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source
), e AS (SELECT *, CASE WHEN source_size > 0 THEN budget // source_size ELSE 0 END AS epochs FROM p)
SELECT doc_id, size, source_size, target, (size * epochs + least(greatest(budget - epochs * source_size - ahead, 0), size))::BIGINT AS taken FROM e
"""

OP5_SQL = r"""
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: floor(x::DOUBLE * 1024)) AS v FROM embeddings
  WHERE len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), s AS (
  SELECT q.vec_id AS query_id, c.vec_id, list_dot_product(q.v, c.v)::BIGINT AS score
  FROM v q JOIN v c ON q.vec_id % 100 = 0 AND c.vec_id <> q.vec_id AND len(q.v) = len(c.v)
)
SELECT query_id, rank::INTEGER AS rank, vec_id, score
FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s) WHERE rank <= 10
"""

OP7_SQL = r"""
WITH w AS (
  SELECT doc_id, lang, source, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS words FROM documents
), win AS (
  SELECT doc_id, i, array_to_string(words[i:i + 4], ' ') AS win FROM (SELECT doc_id, words, unnest(range(1, len(words) - 3)) AS i FROM w)
), again AS (
  SELECT doc_id, count(DISTINCT i + k) AS n FROM (SELECT *, count(*) OVER (PARTITION BY doc_id, win) AS c FROM win), (SELECT unnest(range(0, 5)) AS k) WHERE c > 1 GROUP BY doc_id
), lines AS (
  SELECT doc_id, count(*) AS n_lines, count(*) - count(DISTINCT line) AS n_dup
  FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS line FROM w) WHERE regexp_matches(line, '[^\x20\x09-\x0D]') GROUP BY doc_id
), stats AS (
  SELECT doc_id, lang, source, len(words)::BIGINT AS n_words, length(array_to_string(words, ''))::BIGINT AS word_chars, length(regexp_replace(text, '[^#*$%&|<>]', '', 'g'))::BIGINT AS n_symbols,
    coalesce(n_dup, 0)::BIGINT AS n_dup_lines, coalesce(again.n, 0)::BIGINT AS n_repeat_words, coalesce(n_lines, 0)::BIGINT AS n_lines
  FROM w LEFT JOIN again USING (doc_id) LEFT JOIN lines USING (doc_id)
), judged AS (
  SELECT *, n_words < 10 OR 100 * n_repeat_words > 20 * n_words AS base_failed,
    1000 * n_symbols // greatest(word_chars, 1) AS symbols, 1000 * n_dup_lines // greatest(n_lines, 1) AS dup_lines, 100 * word_chars // greatest(n_words, 1) AS word_length FROM stats
), vals AS (
  SELECT lang, source, unnest(['symbols', 'dup_lines', 'word_length']) AS value, unnest([symbols, dup_lines, word_length]) AS x FROM judged WHERE NOT base_failed
), bins AS (
  SELECT lang, source, value, (x >> greatest(length(bin(x)) - 7, 0)) << greatest(length(bin(x)) - 7, 0) AS bin FROM vals
), ranked AS (
  SELECT lang, source, value, bin, row_number() OVER (PARTITION BY lang, source, value ORDER BY bin) AS r, count(*) OVER (PARTITION BY lang, source, value) AS n,
    row_number() OVER (PARTITION BY lang, value ORDER BY bin) AS lr, count(*) OVER (PARTITION BY lang, value) AS ln, row_number() OVER (PARTITION BY value ORDER BY bin) AS cr, count(*) OVER (PARTITION BY value) AS cn FROM bins
), g AS (SELECT lang, source, value, any_value(n) AS n, min(bin) FILTER (4 * r >= n) AS lo, min(bin) FILTER (4 * r >= 3 * n) AS hi FROM ranked GROUP BY ALL
), l AS (SELECT lang, value, any_value(ln) AS n, min(bin) FILTER (4 * lr >= ln) AS lo, min(bin) FILTER (4 * lr >= 3 * ln) AS hi FROM ranked GROUP BY ALL
), c AS (SELECT value, min(bin) FILTER (4 * cr >= cn) AS lo, min(bin) FILTER (4 * cr >= 3 * cn) AS hi FROM ranked GROUP BY ALL
), picked AS (
  SELECT g.lang, g.source, g.value, CASE WHEN g.n >= 50 THEN g.lo WHEN l.n >= 50 THEN l.lo ELSE c.lo END AS lo, CASE WHEN g.n >= 50 THEN g.hi WHEN l.n >= 50 THEN l.hi ELSE c.hi END AS hi,
    CASE g.value WHEN 'symbols' THEN 50 ELSE 200 END AS slack
  FROM g JOIN l ON g.lang IS NOT DISTINCT FROM l.lang AND g.value = l.value JOIN c ON c.value = g.value
), fences AS (
  SELECT lang, source, max(hi + 3 * (hi - lo) + slack) FILTER (value = 'symbols') AS most_symbols, max(hi + 3 * (hi - lo) + slack) FILTER (value = 'dup_lines') AS most_dup_lines,
    max(lo - 3 * (hi - lo) - slack) FILTER (value = 'word_length') AS least_length, max(hi + 3 * (hi - lo) + slack) FILTER (value = 'word_length') AS most_length FROM picked GROUP BY lang, source)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
  NOT base_failed AND coalesce(symbols <= most_symbols AND dup_lines <= most_dup_lines AND word_length BETWEEN least_length AND most_length, true) AS kept, most_symbols, most_dup_lines, least_length, most_length
FROM judged j LEFT JOIN fences f ON j.lang IS NOT DISTINCT FROM f.lang AND j.source IS NOT DISTINCT FROM f.source
"""

OP8_SQL = r"""
WITH RECURSIVE calls AS (
  SELECT conv_id, turn::VARCHAR AS call_id, turn, CASE WHEN role = 'user' THEN 'reply' ELSE 'configure' END AS name, text, CASE WHEN turn >= 2 THEN (turn - 2)::VARCHAR END AS parent FROM conversations WHERE role <> 'assistant'
), results AS (SELECT conv_id, (turn - 1)::VARCHAR AS call_id, turn, text AS content FROM conversations WHERE role = 'assistant'),
chains AS (
  SELECT c.conv_id, c.call_id, 0::BIGINT AS level FROM calls c LEFT JOIN calls p ON p.conv_id = c.conv_id AND p.call_id = c.parent WHERE p.conv_id IS NULL
  UNION ALL SELECT c.conv_id, c.call_id, h.level + 1 FROM chains h JOIN calls c ON c.conv_id = h.conv_id AND c.parent = h.call_id
)
SELECT coalesce(c.conv_id, r.conv_id) AS conv_id, coalesce(c.call_id, r.call_id) AS call_id, coalesce(c.turn, r.turn) AS turn, h.level,
  CASE WHEN c.parent IS NOT NULL AND NOT EXISTS (SELECT 1 FROM calls p WHERE p.conv_id = c.conv_id AND p.call_id = c.parent) THEN 1 ELSE 0 END::BIGINT AS missing,
  c.conv_id IS NOT NULL AND r.conv_id IS NOT NULL AS linked, c.conv_id IS NOT NULL AND (c.name = 'configure' OR length(c.text) > 0) AS valid,
  CASE WHEN c.conv_id IS NULL THEN 'call' WHEN c.name = 'reply' AND length(c.text) = 0 THEN 'prompt:minLength' ELSE '' END AS problems,
  '{' || CASE WHEN c.conv_id IS NULL THEN '' WHEN c.name = 'reply' THEN '"arguments":{"prompt":' || to_json(c.text)::VARCHAR || ',"turn":' || c.turn || '},' ELSE '"arguments":{"text":' || to_json(c.text)::VARCHAR || '},' END
    || CASE WHEN r.conv_id IS NULL THEN '' ELSE '"content":' || to_json(r.content)::VARCHAR || ',' END || '"id":"' || coalesce(c.call_id, r.call_id) || '"'
    || CASE WHEN c.conv_id IS NULL THEN '' ELSE ',"name":"' || c.name || '","turn":' || c.turn END || '}' AS record
FROM calls c FULL OUTER JOIN results r ON c.conv_id = r.conv_id AND c.call_id = r.call_id
LEFT JOIN chains h ON h.conv_id = c.conv_id AND h.call_id = c.call_id
"""

OP12_SQL = r"""
WITH d AS (
  SELECT row_number() OVER () AS row, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS words FROM documents
), i AS (
  SELECT item_id::VARCHAR AS item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS words FROM benchmark
), item AS (
  SELECT DISTINCT item_id, m, array_to_string(words[k:k + m - 1], ' ') AS win
  FROM (SELECT item_id, words, least(len(words), 10) AS m, unnest(range(1, len(words) - least(len(words), 10) + 2)) AS k FROM i WHERE len(words) > 0)
), win AS (
  SELECT row, k, m, array_to_string(words[k:k + m - 1], ' ') AS win
  FROM (SELECT row, words, m, unnest(range(1, len(words) - m + 2)) AS k FROM d, (SELECT DISTINCT m FROM item))
), hit AS (SELECT row, k, m, item_id FROM win JOIN item USING (m, win)
), n AS (SELECT row, count(DISTINCT p) AS n_hit FROM (SELECT row, unnest(range(k, k + m)) AS p FROM hit) GROUP BY row
), ids AS (SELECT row, count(*) AS n_items, string_agg(item_id, ',' ORDER BY item_id) AS ids FROM (SELECT DISTINCT row, item_id FROM hit WHERE item_id IS NOT NULL) GROUP BY row)
SELECT doc_id, len(words)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items, sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN n USING (row) LEFT JOIN ids USING (row)
"""

OP13_SQL = r"""
WITH RECURSIVE crc AS (
  SELECT list(v ORDER BY i) AS t FROM (
    SELECT i, list_reduce([i] || range(8), lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END) AS v FROM (SELECT unnest(range(256)) AS i))
), run AS (
  SELECT doc_id, translate(unnest(regexp_extract_all(coalesce(text, ''), '[A-Za-z\x{C0}-\x{FF}]+')), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS run FROM documents
), each AS (SELECT doc_id, run, count(*) AS n FROM run WHERE length(run) >= 6 GROUP BY ALL
), hashed AS (
  SELECT run, n, xor(list_reduce([4294967295] || flatten(list_transform(string_split(coalesce(doc_id || ':', '') || run, ''), lambda c: CASE WHEN unicode(c) < 128 THEN [unicode(c)::BIGINT] ELSE [192 | (unicode(c)::BIGINT >> 6), 128 | (unicode(c)::BIGINT & 63)] END)),
    lambda h, b: xor(h >> 8, t[(xor(h, b) & 255) + 1])), 4294967295) AS h, doc_id IS NULL AS whole FROM each, crc
), word AS (
  SELECT word, sum(n)::BIGINT AS n FROM (SELECT CASE WHEN NOT whole AND h % 199 = 0 THEN substr(run, 1, h % length(run)) || substr(run, h % length(run) + 2) ELSE run END AS word, n FROM hashed)
  WHERE length(word) >= 6 GROUP BY word HAVING sum(n) >= 5
), cut AS (SELECT word, n, i, substr(word, 1, i - 1) AS a, substr(word, i + 1) AS b FROM (SELECT word, n, unnest(range(1, length(word) + 1)) AS i FROM word)
), pair AS (
  SELECT x.word, y.word AS near FROM cut x JOIN cut y USING (i, a, b) WHERE x.word <> y.word
  UNION SELECT c.word, w.word FROM cut c JOIN word w ON c.a || c.b = w.word
  UNION SELECT w.word, c.word FROM cut c JOIN word w ON c.a || c.b = w.word
), best AS (
  SELECT p.word, w.word AS near, w.n AS near_n, count(*) OVER (PARTITION BY p.word) AS n_near, row_number() OVER (PARTITION BY p.word ORDER BY w.n DESC, w.word) AS r FROM pair p JOIN word w ON p.near = w.word
), f AS (
  SELECT w.word, w.n, coalesce(n_near, 0)::BIGINT AS n_near, CASE WHEN near_n >= 5 * w.n THEN near END AS form, CASE WHEN near_n >= 5 * w.n THEN near_n END AS form_n FROM word w LEFT JOIN best b ON b.word = w.word AND r = 1
), chain AS (SELECT word, word AS last FROM f UNION ALL SELECT c.word, f.form FROM chain c JOIN f ON f.word = c.last WHERE f.form IS NOT NULL
), root AS (SELECT c.word, c.last AS root FROM chain c JOIN f ON f.word = c.last WHERE f.form IS NULL)
SELECT word, form, root, n, n_near, form_n FROM f JOIN root USING (word)
"""

"""DuckDB SQL that must give the rows of the queries which SQL can express. Each states the contract
plainly, by joins on whole shingles, windows and lines rather than by signatures or automata."""

from __future__ import annotations

LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
WORD = r"'[^\x20\x09-\x0D]+'"
#: Words of benchmark items and of the documents held against them.
FOLDED = r"'[^\x00-\x2F\x3A-\x60\x7B-\x7F]+'"

NEAR_DUPLICATES = f"""
WITH RECURSIVE d AS (SELECT doc_id, regexp_extract_all({LOWER}, {WORD}) AS w FROM documents),
  s AS (SELECT doc_id, list_sort(list_distinct(CASE WHEN len(w) = 0 THEN []::VARCHAR[] WHEN len(w) < 5 THEN [array_to_string(w, ' ')]
      ELSE list_transform(range(1, len(w) - 3), lambda p: array_to_string(w[p:p + 4], ' ')) END)) AS grams FROM d),
  c AS MATERIALIZED (SELECT min(doc_id) AS id, grams FROM s WHERE len(grams) > 0 GROUP BY grams),
  g AS MATERIALIZED (SELECT id, len(grams) AS n, unnest(grams) AS gram FROM c),
  shared AS (SELECT a.id AS a, b.id AS b FROM g a JOIN g b ON a.gram = b.gram AND a.id < b.id
      GROUP BY a.id, b.id, a.n, b.n HAVING 100 * count(*) >= 85 * (a.n + b.n - count(*))),
  e AS MATERIALIZED (SELECT a, b FROM shared UNION ALL SELECT b, a FROM shared),
  reach(id, other) AS (SELECT a, b FROM e UNION SELECT reach.id, e.b FROM reach JOIN e ON reach.other = e.a),
  label AS (SELECT id, least(id, min(other)) AS component FROM reach GROUP BY id)
SELECT doc_id, len(s.grams)::BIGINT AS n_shingles, coalesce(component, c.id, doc_id) AS component_id, doc_id = coalesce(component, c.id, doc_id) AS kept
FROM s LEFT JOIN c ON c.grams = s.grams LEFT JOIN label ON label.id = c.id"""

CONTAMINATION = f"""
WITH i AS (SELECT item_id::VARCHAR AS item_id, regexp_extract_all({LOWER}, {FOLDED}) AS w FROM benchmark),
  n AS (SELECT item_id, w, least(len(w), 13) AS k FROM i WHERE len(w) > 0),
  g AS MATERIALIZED (SELECT DISTINCT item_id, k, array_to_string(w[p:p + k - 1], ' ') AS gram FROM (SELECT *, unnest(range(1, len(w) - k + 2)) AS p FROM n)),
  d AS MATERIALIZED (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all({LOWER}, {FOLDED}) AS w FROM documents),
  x AS (SELECT r, k, p, array_to_string(w[p:p + k - 1], ' ') AS gram FROM (SELECT r, w, k, unnest(range(1, len(w) - k + 2)) AS p FROM d, (SELECT DISTINCT k FROM g))),
  m AS MATERIALIZED (SELECT r, x.p, x.k, item_id FROM x JOIN g ON g.k = x.k AND g.gram = x.gram),
  h AS (SELECT r, count(DISTINCT q) AS n_hit FROM (SELECT r, unnest(range(p, p + k)) AS q FROM m) GROUP BY r),
  t AS (SELECT r, count(DISTINCT item_id) AS n_items, string_agg(DISTINCT item_id, ',' ORDER BY item_id) AS ids FROM m GROUP BY r)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(ids, '')) AS items_sha256,
  coalesce(n_hit > 0 AND 20 * n_hit >= len(w), false) AS contaminated FROM d LEFT JOIN h USING (r) LEFT JOIN t USING (r)"""

LINE_DEDUP = f"""
WITH l AS MATERIALIZED (SELECT doc_id, place, line AS text, doc_id * 2147483648 + place AS own, array_to_string(w, ' ') AS s, w
    FROM (SELECT *, regexp_extract_all({LOWER.replace('text', 'line')}, {WORD}) AS w FROM (SELECT doc_id,
      unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS place FROM documents WHERE text IS NOT NULL))),
  f AS MATERIALIZED (SELECT s, w, min(own) AS first FROM l WHERE len(w) > 0 GROUP BY s, w),
  u AS MATERIALIZED (SELECT first, w AS u, true AS by_word, CASE WHEN len(w) >= 8 THEN len(w) ELSE 0 END AS last FROM f WHERE len(w) >= 7
    UNION ALL SELECT first, string_split(s, ''), false, CASE WHEN length(s) >= 20 THEN length(s) ELSE 0 END FROM f WHERE len(w) < 8 AND length(s) >= 19),
  v AS MATERIALIZED (SELECT first, by_word, p AS at, CASE WHEN by_word THEN array_to_string(x, ' ') ELSE array_to_string(x, '') END AS key
    FROM (SELECT *, CASE WHEN p = 0 THEN u ELSE u[1:p - 1] || u[p + 1:] END AS x FROM (SELECT *, unnest(range(0, last + 1)) AS p FROM u))),
  bad AS (SELECT DISTINCT a.first FROM v a JOIN v b ON a.key = b.key AND a.by_word = b.by_word AND (a.at = b.at OR a.at = 0 OR b.at = 0) AND a.first > b.first),
  k AS (SELECT l.doc_id, l.place, l.text, f.first IS NOT NULL AND (l.own > f.first OR bad.first IS NOT NULL) AS gone
    FROM l LEFT JOIN f ON f.s = l.s LEFT JOIN bad ON bad.first = f.first),
  t AS (SELECT doc_id, count(*) AS n_lines, count(*) FILTER (gone) AS n_removed, coalesce(string_agg(text, chr(10) ORDER BY place) FILTER (NOT gone), '') AS text FROM k GROUP BY doc_id)
SELECT doc_id, n_lines, coalesce(n_removed, 0) AS n_removed, sha256(t.text) AS text_sha256 FROM documents LEFT JOIN t USING (doc_id)"""

#: One round after the other, each with the distances of all parts to all entries.
_FAR = """SELECT vec_id, part, min(e * 256 + entry) AS m FROM (SELECT p.vec_id, p.part, c.entry, CAST(sum((p.v - c.v) * (p.v - c.v)) AS BIGINT) AS e
    FROM parts p JOIN c{n} c ON c.part = p.part AND c.j = p.j GROUP BY p.vec_id, p.part, c.entry) GROUP BY vec_id, part"""
_ROUND = """
  a{n} AS MATERIALIZED (""" + _FAR + """),
  s{n} AS (SELECT p.part, CAST(a.m % 256 AS BIGINT) AS entry, p.j, CAST(sum(p.v) AS BIGINT) AS s, count(*) AS n FROM parts p JOIN a{n} a ON a.vec_id = p.vec_id AND a.part = p.part GROUP BY ALL),
  c{next} AS MATERIALIZED (SELECT c.part, c.entry, c.j, CASE WHEN n IS NULL THEN v ELSE (s - (s % n + n) % n) // n END AS v
    FROM c{n} c LEFT JOIN s{n} s ON s.part = c.part AND s.entry = c.entry AND s.j = c.j),"""

VECTOR_CODES = """
WITH x AS (SELECT vec_id, unnest(embedding) AS x, unnest(range(len(embedding))) AS i, len(embedding) // 8 AS w FROM embeddings),
  kept AS (SELECT vec_id, label FROM embeddings WHERE embedding IS NOT NULL AND vec_id NOT IN (SELECT vec_id FROM x WHERE x IS NULL OR isnan(x) OR isinf(x))),
  parts AS MATERIALIZED (SELECT vec_id, i // w AS part, i % w AS j, CAST(floor(4096 * CAST(x AS DOUBLE)) AS BIGINT) AS v FROM x WHERE vec_id IN (SELECT vec_id FROM kept)),
  c0 AS MATERIALIZED (SELECT part, row_number() OVER (PARTITION BY part, j ORDER BY vec_id) - 1 AS entry, j, v FROM parts
    WHERE vec_id IN (SELECT vec_id FROM kept ORDER BY vec_id LIMIT 16)),""" + "".join(_ROUND.format(n=n, next=n + 1) for n in range(6)) + """
  a6 AS MATERIALIZED (""" + _FAR.format(n=6) + """),
  f AS (SELECT vec_id, string_agg(format('{:02x}', m % 256), '' ORDER BY part) AS code, CAST(sum(m // 256) AS BIGINT) AS error FROM a6 GROUP BY vec_id)
SELECT vec_id, code, error, CAST(sum(error) OVER (PARTITION BY label) AS BIGINT) AS label_error,
  (SELECT sha256(string_agg(CAST(v AS VARCHAR), ',' ORDER BY part, entry, j)) FROM c6) AS codebooks_sha256
FROM f JOIN kept USING (vec_id)"""

#: crc32 is taken bit by bit; a node is the list of its turns, and each node adds to all that it goes through.
PREFIX_TRIE = """
WITH RECURSIVE t AS MATERIALIZED (SELECT conv_id AS c, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, coalesce(role, ''), coalesce(text, '')) AS p,
    coalesce(role, '') AS r, coalesce(text, '') AS x FROM conversations WHERE conv_id IS NOT NULL),
  crc(c, k, bit, v) AS (SELECT DISTINCT c, 0, 0, 4294967295::BIGINT FROM t UNION ALL
    SELECT c, CASE WHEN bit = 8 THEN k + 1 ELSE k END, CASE WHEN bit = 8 THEN 0 ELSE bit + 1 END, CASE WHEN bit = 0 THEN xor(v, ascii(substr(c::VARCHAR, k + 1, 1))::BIGINT)
      WHEN v % 2 = 1 THEN xor(v // 2, 3988292384) ELSE v // 2 END FROM crc WHERE k < length(c::VARCHAR)),
  h AS MATERIALIZED (SELECT c, xor(v, 4294967295) % 9 AS h, c - c % 5 AS b FROM crc WHERE k = length(c::VARCHAR)),
  o AS (SELECT h.c, 0 AS tail, t.p, t.r, t.x FROM h JOIN t ON t.c = h.b AND t.p <= h.h UNION ALL SELECT h.c, 1, t.p, t.r, t.x FROM h JOIN t ON t.c = h.c AND t.p > h.h),
  s AS MATERIALIZED (SELECT c, row_number() OVER w AS d, x, list(struct_pack(r := r, x := x)) OVER (w ROWS UNBOUNDED PRECEDING) AS path FROM o WINDOW w AS (PARTITION BY c ORDER BY tail, p)),
  m AS MATERIALIZED (SELECT c, 0 AS d, '' AS x, CAST([] AS STRUCT(r VARCHAR, x VARCHAR)[]) AS path FROM h UNION ALL SELECT c, d, x, path FROM s),
  n AS MATERIALIZED (SELECT d, path, min(c) AS conv_id, count(*) AS n_convs, (count(*) - 1) * strlen(min(x)) AS cost FROM m GROUP BY d, path),
  k AS (SELECT u.d, u.path, count(*) AS n_children FROM n JOIN m u ON u.c = n.conv_id AND u.d = n.d - 1 GROUP BY u.d, u.path),
  v AS MATERIALIZED (SELECT n.*, coalesce(n_children, 0) AS n_children FROM n LEFT JOIN k ON k.d = n.d AND k.path = n.path),
  q AS (SELECT u.d, u.path, count(*) FILTER (v.n_children = 0) AS n_leaves, sum(v.cost) AS saved FROM v JOIN m u ON u.c = v.conv_id AND u.d <= v.d GROUP BY u.d, u.path),
  e AS (SELECT d, path, string_agg(c::VARCHAR, ',' ORDER BY c) AS ids FROM (SELECT *, max(d) OVER (PARTITION BY c) AS last FROM m) WHERE d = last GROUP BY d, path),
  up AS (SELECT n.conv_id, n.d, w.conv_id AS parent FROM n JOIN m u ON u.c = n.conv_id AND u.d = n.d - 1 JOIN n w ON w.d = u.d AND w.path = u.path)
SELECT v.conv_id, v.d::BIGINT AS depth, parent AS parent_conv_id, n_convs, n_children, n_leaves, CAST(saved AS BIGINT) AS saved_tokens, sha256(coalesce(ids, '')) AS ends_sha256
FROM v JOIN q ON q.d = v.d AND q.path = v.path LEFT JOIN e ON e.d = v.d AND e.path = v.path LEFT JOIN up ON up.conv_id = v.conv_id AND up.d = v.d"""

ORACLES = {
    "op11_vector_codes": VECTOR_CODES,
    "op12_prefix_trie": PREFIX_TRIE,
    "op4_minhash_hamming": NEAR_DUPLICATES,
    "op8_suffix_automaton": CONTAMINATION,
    "op9_deletion_neighbourhood": LINE_DEDUP,
}

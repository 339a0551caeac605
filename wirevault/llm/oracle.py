"""DuckDB SQL that gives the same rows as a registered query, where SQL can say it."""

OP4 = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(
    translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w
  FROM documents
), s AS (
  SELECT doc_id, CASE WHEN w IS NULL OR len(w) = 0 THEN []
    WHEN len(w) < 4 THEN [array_to_string(w, ' ')]
    ELSE list_distinct(list_transform(range(1, len(w) - 2), lambda i: array_to_string(w[i:i + 3], ' '))) END AS s
  FROM w
), e AS (SELECT doc_id, len(s) AS n, unnest(s) AS g FROM s),
pairs AS (
  SELECT a.doc_id AS a, b.doc_id AS b, a.n AS na, b.n AS nb, count(*) AS common
  FROM e a JOIN e b ON a.g = b.g AND a.doc_id <> b.doc_id GROUP BY ALL
), links AS (SELECT a, b FROM pairs WHERE 100 * common >= 80 * (na + nb - common)),
reach AS (
  SELECT doc_id AS a, doc_id AS b FROM documents
  UNION
  SELECT reach.a, links.b FROM reach JOIN links ON links.a = reach.b
), c AS (SELECT a AS doc_id, min(b) AS component_id FROM reach GROUP BY a)
SELECT s.doc_id, CAST(len(s.s) AS BIGINT) AS n_shingles, c.component_id, s.doc_id = c.component_id AS kept
FROM s JOIN c USING (doc_id)
"""

# Common words of a document and an item that stand at one offset to each other form runs; the
# longest run is the longest verbatim match, and only runs with a whole window count.
OP6 = r"""
WITH d AS (
  SELECT doc_id, coalesce(regexp_extract_all(
    translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+'), []) AS w
  FROM documents
), b AS (
  SELECT item_id, regexp_extract_all(
    translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
  FROM benchmark WHERE text IS NOT NULL
), bw AS (SELECT item_id, least(len(w), 10) AS m, unnest(range(1, len(w) - least(len(w), 10) + 2)) AS p, w FROM b WHERE len(w) > 0),
win AS (SELECT item_id, m, p AS q, array_to_string(w[p:p + m - 1], ' ') AS g FROM bw),
sizes AS (SELECT DISTINCT m FROM win),
dw AS (SELECT doc_id, w, m, unnest(range(1, len(w) - m + 2)) AS p FROM d, sizes WHERE len(w) >= m),
occ AS (
  SELECT dw.doc_id, win.item_id, dw.p, win.q, win.m
  FROM dw JOIN win ON win.m = dw.m AND win.g = array_to_string(dw.w[dw.p:dw.p + dw.m - 1], ' ')
), hit AS (
  SELECT doc_id, count(DISTINCT k) AS n_hit FROM (SELECT doc_id, unnest(range(p, p + m)) AS k FROM occ) GROUP BY doc_id
), found AS (
  SELECT doc_id, count(DISTINCT item_id) AS n_items,
    array_to_string(list_sort(list(DISTINCT CAST(item_id AS VARCHAR))), ',') AS ids
  FROM occ GROUP BY doc_id
), run AS (
  SELECT doc_id, max(n) AS longest FROM (
    SELECT doc_id, count(*) + any_value(m) - 1 AS n FROM (
      SELECT *, p - row_number() OVER (PARTITION BY doc_id, item_id, p - q ORDER BY p) AS r FROM (SELECT DISTINCT * FROM occ)
    ) GROUP BY doc_id, item_id, p - q, r
  ) GROUP BY doc_id
)
SELECT d.doc_id, CAST(len(d.w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit,
  CAST(coalesce(n_items, 0) AS BIGINT) AS n_items, sha256(coalesce(ids, '')) AS items_sha256,
  coalesce(n_hit, 0) > 0 AS contaminated, CAST(coalesce(longest, 0) AS BIGINT) AS longest_match
FROM d LEFT JOIN hit USING (doc_id) LEFT JOIN found USING (doc_id) LEFT JOIN run USING (doc_id)
"""

# The checksum bit by bit, then a search of four states (cost, edits, repaired lines) row by row:
# s0 nothing yet, s1 after a system row, s2 after a user row, s3 after an assistant row.
OP11 = r"""
WITH RECURSIVE bits AS (
  SELECT list_transform(range(256), lambda n: list_reduce(range(8),
    lambda c, i: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END, n)) AS t
), keyed AS (
  SELECT *, coalesce(CAST(conv_id AS VARCHAR), ' ') || ':' || coalesce(CAST(turn AS VARCHAR), ' ') AS key FROM conversations
), summed AS (
  SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text, xor(list_reduce(
    list_transform(range(1, length(key) + 1), lambda i: CAST(ascii(substr(key, i, 1)) AS BIGINT)),
    lambda c, b: xor(c >> 8, t[(xor(c, b) & 255) + 1]), 4294967295), 4294967295) % 20 AS kind
  FROM keyed, bits
), damaged AS (
  SELECT conv_id, turn, CASE WHEN kind = 4 THEN 'user' ELSE role END AS role,
    CASE kind WHEN 1 THEN '' WHEN 2 THEN translate(text, '.!?', '') ELSE text END AS text
  FROM summed, range(CASE kind WHEN 3 THEN 2 ELSE 1 END) WHERE kind <> 0
), placed AS (
  SELECT *, row_number() OVER (PARTITION BY conv_id, role, text ORDER BY k) AS copy,
    regexp_extract(text, '([^\x20\x09-\x0D])[\x20\x09-\x0D]*$', 1) AS last
  FROM (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) AS k FROM damaged)
), faulty AS (
  SELECT *, left(role, 1) AS i, CASE WHEN last = '' THEN 'blank' WHEN copy > 1 THEN 'duplicate'
    WHEN last NOT IN ('.', '!', '?') THEN 'truncated' ELSE '' END AS fault,
    lag(left(role, 1)) OVER (PARTITION BY conv_id ORDER BY k) || left(role, 1) AS pair
  FROM placed
), counted AS (
  SELECT conv_id, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps,
    count(*) FILTER (fault = 'blank') AS blank, count(*) FILTER (fault = 'duplicate') AS duplicate,
    count(*) FILTER (fault = 'truncated') AS truncated, count(*) FILTER (pair NOT IN ('su', 'ua', 'au')) AS illegal
  FROM faulty GROUP BY conv_id
), search AS (
  SELECT DISTINCT conv_id, CAST(0 AS BIGINT) AS k, {'c': CAST(0 AS BIGINT), 'a': '', 'r': ''} AS s0,
    CAST(NULL AS STRUCT(c BIGINT, a VARCHAR, r VARCHAR)) AS s1, CAST(NULL AS STRUCT(c BIGINT, a VARCHAR, r VARCHAR)) AS s2,
    CAST(NULL AS STRUCT(c BIGINT, a VARCHAR, r VARCHAR)) AS s3
  FROM conversations
  UNION ALL
  SELECT conv_id, k, CASE WHEN s0 IS NOT NULL THEN {'c': s0.c + 3, 'a': s0.a || 'D', 'r': s0.r} END,
    list_sort([CASE WHEN s1 IS NOT NULL THEN {'c': s1.c + 3, 'a': s1.a || 'D', 'r': s1.r} END,
      CASE WHEN s0 IS NOT NULL AND stays AND i = 's' THEN {'c': s0.c + late, 'a': s0.a || 'K', 'r': s0.r || own} END], 'ASC', 'NULLS LAST')[1],
    list_sort([CASE WHEN s2 IS NOT NULL THEN {'c': s2.c + 3, 'a': s2.a || 'D', 'r': s2.r} END,
      CASE WHEN s0 IS NOT NULL AND stays AND i = 'u' THEN {'c': s0.c + late, 'a': s0.a || 'K', 'r': s0.r || own} END,
      CASE WHEN s1 IS NOT NULL AND stays AND i = 'u' THEN {'c': s1.c + late, 'a': s1.a || 'K', 'r': s1.r || own} END,
      CASE WHEN s3 IS NOT NULL AND stays AND i = 'u' THEN {'c': s3.c + late, 'a': s3.a || 'K', 'r': s3.r || own} END,
      CASE WHEN s0 IS NOT NULL AND stays THEN {'c': s0.c + 2 + late, 'a': s0.a || 'R', 'r': s0.r || chr(10) || 'user:' || text} END,
      CASE WHEN s1 IS NOT NULL AND stays THEN {'c': s1.c + 2 + late, 'a': s1.a || 'R', 'r': s1.r || chr(10) || 'user:' || text} END,
      CASE WHEN s3 IS NOT NULL AND stays THEN {'c': s3.c + 2 + late, 'a': s3.a || 'R', 'r': s3.r || chr(10) || 'user:' || text} END], 'ASC', 'NULLS LAST')[1],
    list_sort([CASE WHEN s3 IS NOT NULL THEN {'c': s3.c + 3, 'a': s3.a || 'D', 'r': s3.r} END,
      CASE WHEN s2 IS NOT NULL AND stays AND i = 'a' THEN {'c': s2.c + late, 'a': s2.a || 'K', 'r': s2.r || own} END,
      CASE WHEN s2 IS NOT NULL AND stays THEN {'c': s2.c + 2 + late, 'a': s2.a || 'R', 'r': s2.r || chr(10) || 'assistant:' || text} END], 'ASC', 'NULLS LAST')[1]
  FROM (
    SELECT conv_id, k, i, text, own, stays, late, s0, s1, s2, list_sort([s3,
      CASE WHEN s2 IS NOT NULL THEN {'c': s2.c + 2, 'a': s2.a || 'I', 'r': s2.r || chr(10) || 'assistant:'} END], 'ASC', 'NULLS LAST')[1] AS s3
    FROM (
      SELECT f.conv_id, f.k, f.i, f.text, chr(10) || f.role || ':' || f.text AS own, f.fault NOT IN ('blank', 'duplicate') AS stays,
        CASE f.fault WHEN 'truncated' THEN 1 ELSE 0 END AS late, s.s0, s.s1, s.s3, list_sort([s.s2,
        CASE WHEN s.s0 IS NOT NULL THEN {'c': s.s0.c + 2, 'a': s.s0.a || 'I', 'r': s.s0.r || chr(10) || 'user:'} END,
        CASE WHEN s.s1 IS NOT NULL THEN {'c': s.s1.c + 2, 'a': s.s1.a || 'I', 'r': s.s1.r || chr(10) || 'user:'} END,
        CASE WHEN s.s3 IS NOT NULL THEN {'c': s.s3.c + 2, 'a': s.s3.a || 'I', 'r': s.s3.r || chr(10) || 'user:'} END], 'ASC', 'NULLS LAST')[1] AS s2
      FROM search s JOIN faulty f ON f.conv_id IS NOT DISTINCT FROM s.conv_id AND f.k = s.k + 1
    )
  )
), ended AS (
  SELECT conv_id, list_sort([s0, s3, CASE WHEN s2 IS NOT NULL THEN {'c': s2.c + 2, 'a': s2.a || 'I', 'r': s2.r || chr(10) || 'assistant:'} END,
    CASE WHEN s1 IS NOT NULL THEN {'c': s1.c + 4, 'a': s1.a || 'II', 'r': s1.r || chr(10) || 'user:' || chr(10) || 'assistant:'} END], 'ASC', 'NULLS LAST')[1] AS e
  FROM search QUALIFY k = max(k) OVER (PARTITION BY conv_id)
)
SELECT e.conv_id, CAST(coalesce(gaps, 0) AS BIGINT) AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate,
  coalesce(truncated, 0) AS truncated, coalesce(illegal, 0) AS illegal, e.e.c AS cost, e.e.a AS audit,
  sha256(substr(e.e.r, 2)) AS repaired_sha256
FROM ended e LEFT JOIN counted c ON c.conv_id IS NOT DISTINCT FROM e.conv_id
"""

OP12 = r"""
WITH pieces AS (
  SELECT lang, unnest(string_split_regex(t, '[.,;:!?\x0A-\x0D]')) AS piece FROM (
    SELECT coalesce(lang, 'und') AS lang,
      translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS t FROM documents)
), places AS MATERIALIZED (
  SELECT lang, w[p] AS w1, w[p + 1] AS w2, w[p + 2] AS w3
  FROM (SELECT lang, w, unnest(range(1, len(w) + 1)) AS p FROM (SELECT lang, regexp_extract_all(piece, '[^\x20\x09]+') AS w FROM pieces))
), f1 AS MATERIALIZED (SELECT lang, w1, count(*) AS f FROM places GROUP BY ALL),
f2 AS MATERIALIZED (SELECT lang, w1, w2, count(*) AS f FROM places WHERE w2 IS NOT NULL GROUP BY ALL HAVING count(*) >= 10),
f3 AS MATERIALIZED (SELECT lang, w1, w2, w3, count(*) AS f FROM places WHERE w3 IS NOT NULL GROUP BY ALL HAVING count(*) >= 10),
n AS (SELECT lang, sum(f)::BIGINT AS n FROM f1 GROUP BY lang),
inside AS (
  SELECT lang, w1, w2, max(f) AS most
  FROM (SELECT lang, w1, w2, f FROM f3 UNION ALL SELECT lang, w2, w3, f FROM f3) GROUP BY ALL
), cuts AS (
  SELECT c.lang, c.w1 || ' ' || c.w2 AS phrase, c.f AS a, 1 AS k, l.f AS l, r.f AS r
  FROM f2 c JOIN f1 l ON l.lang = c.lang AND l.w1 = c.w1 JOIN f1 r ON r.lang = c.lang AND r.w1 = c.w2
  LEFT JOIN inside i ON i.lang = c.lang AND i.w1 = c.w1 AND i.w2 = c.w2 WHERE i.most IS NULL OR 100 * i.most < 50 * c.f
  UNION ALL
  SELECT c.lang, c.w1 || ' ' || c.w2 || ' ' || c.w3, c.f, 1, l.f, r.f
  FROM f3 c JOIN f1 l ON l.lang = c.lang AND l.w1 = c.w1 JOIN f2 r ON r.lang = c.lang AND r.w1 = c.w2 AND r.w2 = c.w3
  UNION ALL
  SELECT c.lang, c.w1 || ' ' || c.w2 || ' ' || c.w3, c.f, 2, l.f, r.f
  FROM f3 c JOIN f2 l ON l.lang = c.lang AND l.w1 = c.w1 AND l.w2 = c.w2 JOIN f1 r ON r.lang = c.lang AND r.w1 = c.w3
), scored AS (
  SELECT *, (CAST(1000000 AS HUGEINT) * a * a // (CAST(l AS HUGEINT) * r))::BIGINT AS score FROM cuts
), weakest AS (SELECT * FROM scored QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) = 1)
SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank, phrase, a, l, r, n, score
FROM weakest JOIN n USING (lang) QUALIFY rank <= 2000
"""

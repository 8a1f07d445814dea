"""DuckDB SQL for the rows of the registered queries, over the same whole tables."""

QUALITY_RULES = r"""
WITH w AS (
  SELECT doc_id, source, coalesce(text, '') AS text,
    list_filter(string_split_regex(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w,
    list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS lines,
    row_number() OVER () AS r
  FROM documents),
grams AS (
  SELECT r, i, w[i:i + 2] AS g FROM (SELECT r, w, unnest(range(1, len(w) - 1)) AS i FROM w WHERE len(w) >= 3)),
twice AS (SELECT r, i FROM (SELECT r, i, count(*) OVER (PARTITION BY r, g) AS n FROM grams) WHERE n > 1),
covered AS (SELECT r, count(DISTINCT i + k) AS n FROM twice, (SELECT unnest(range(3)) AS k) GROUP BY r),
counted AS (
  SELECT doc_id, source, w.r, CAST(len(w) AS BIGINT) AS n_words,
    CAST(coalesce(list_sum(list_transform(w, lambda x: length(x))), 0) AS BIGINT) AS word_chars,
    CAST(length(text) - length(regexp_replace(text, '[#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols,
    CAST(len(lines) - len(list_distinct(lines)) AS BIGINT) AS n_dup_lines,
    CAST(coalesce(covered.n, 0) AS BIGINT) AS n_repeat_words
  FROM w LEFT JOIN covered ON covered.r = w.r),
judged AS (
  SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed,
    10 * n_symbols > word_chars AS fail_symbols, 2 * n_dup_lines > n_words AS fail_lines
  FROM counted),
fails AS (
  SELECT source, 'base' AS rule, base_failed AS failed FROM judged
  UNION ALL SELECT source, 'symbols', fail_symbols FROM judged
  UNION ALL SELECT source, 'lines', fail_lines FROM judged),
hosts AS (
  SELECT source, rule, CAST(count(*) AS DOUBLE) AS n, CAST(count(*) FILTER (WHERE failed) AS DOUBLE) AS k
  FROM fails GROUP BY source, rule),
totals AS (
  SELECT rule, sum(k) / sum(n) AS m, sum(n) AS n, count(*) AS hosts, sum(n * n) AS squares, sum(k * k / n) AS q
  FROM hosts GROUP BY rule),
prior AS (
  SELECT rule, m, CASE WHEN n - squares / n > 0 THEN (q - n * m * m - (hosts - 1) * m * (1 - m)) / (n - squares / n) ELSE 0 END AS v
  FROM totals),
strength AS (
  SELECT rule, m, least(1e6, greatest(1.0, CASE WHEN v > 0 THEN m * (1 - m) / v - 1 ELSE 1e6 END)) AS s FROM prior),
bad AS (
  SELECT DISTINCT source, 1 AS is_bad FROM hosts JOIN strength USING (rule) WHERE (k + m * s) / (n + s) > 0.5)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
  NOT base_failed AND is_bad IS NULL AS kept
FROM judged LEFT JOIN bad ON judged.source IS NOT DISTINCT FROM bad.source
"""

MIX_SOURCES = r"""
WITH sizes AS (
  SELECT doc_id, source, md5('mix:' || coalesce(CAST(doc_id AS VARCHAR), '') || ':' || md5(coalesce(text, ''))) AS key,
    CAST(len(list_filter(string_split_regex(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '')) AS BIGINT) AS size
  FROM documents),
sources AS (
  SELECT source, CAST(sum(size) AS BIGINT) AS source_size,
    CAST(1 + (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 AS DOUBLE) AS weight
  FROM sizes GROUP BY source),
caps AS (SELECT *, CAST(3 * source_size AS DOUBLE) AS cap, 3 * source_size / weight AS full_at FROM sources),
summed AS (
  SELECT *, sum(source_size) OVER () AS total, sum(weight) OVER () AS all_weight,
    coalesce(sum(cap) OVER w, 0) AS cap_before, coalesce(sum(weight) OVER w, 0) AS weight_before
  FROM caps WINDOW w AS (ORDER BY full_at, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
level AS (
  SELECT (total - cap_before) / (all_weight - weight_before) AS level FROM summed
  WHERE (total - cap_before) / (all_weight - weight_before) <= full_at ORDER BY full_at, cap_before LIMIT 1),
targets AS (SELECT source, source_size, least(cap, weight * level) AS target FROM summed, level),
placed AS (
  SELECT s.doc_id, s.size, t.source_size, t.target, CAST(floor(t.target) AS BIGINT) AS budget,
    CAST(coalesce(sum(s.size) OVER (PARTITION BY s.source ORDER BY s.key, s.doc_id, s.size
      ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS before
  FROM sizes s JOIN targets t ON s.source IS NOT DISTINCT FROM t.source)
SELECT doc_id, size, source_size, target,
  CAST(CASE WHEN source_size > 0 THEN budget // source_size ELSE 0 END * size + least(size, greatest(0,
    budget - CASE WHEN source_size > 0 THEN budget // source_size ELSE 0 END * source_size - before)) AS BIGINT) AS taken
FROM placed
"""

CHAT = r"""
WITH turns AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -1, 0, 'user', '<|im_end|><|im_start|>assistant ok'
  UNION ALL SELECT -1, 1, 'assistant', '<|im_end|><|im_start|>assistant ok')
SELECT conv_id, count(*) AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, text)) AS turns_sha256,
  CAST(sum(CASE WHEN role = 'assistant' THEN length(text) ELSE 0 END) AS BIGINT) AS loss_chars,
  sha256(string_agg(CASE WHEN role = 'assistant' THEN text ELSE '' END, '' ORDER BY turn NULLS FIRST, role, text)) AS loss_sha256,
  CAST(sum(12 + length(replace(replace(replace(role, '\', '\\'), '<|', '<\|'), chr(10), '\n')) + 1
    + length(replace(replace(text, '\', '\\'), '<|', '<\|')) + 11) AS BIGINT) AS formatted_chars, FALSE AS rewritten
FROM turns GROUP BY conv_id
"""

LINE_DEDUP = r"""
WITH docs AS (SELECT row_number() OVER () AS r, doc_id, string_split(coalesce(text, ''), chr(10)) AS l FROM documents),
lines AS (SELECT r, doc_id, generate_subscripts(l, 1) AS i, unnest(l) AS line FROM docs),
keyed AS (
  SELECT *, translate(regexp_replace(line, '^[\x20\x09-\x0D]+|[\x20\x09-\x0D]+$', '', 'g'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS k
  FROM lines),
common AS (
  SELECT k AS key, max(doc_id) AS last FROM keyed WHERE length(k) >= 20 GROUP BY k
  HAVING count(DISTINCT doc_id) + max(CASE WHEN doc_id IS NULL THEN 1 ELSE 0 END) >= 3),
judged AS (SELECT r, doc_id, i, line, key IS NOT NULL AND doc_id IS DISTINCT FROM last AS gone FROM keyed LEFT JOIN common ON k = key)
SELECT any_value(doc_id) AS doc_id, count(*) AS n_lines, count(*) FILTER (WHERE gone) AS n_dropped,
  sha256(coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (WHERE NOT gone), '')) AS kept_sha256
FROM judged GROUP BY r
"""

SPELLING = r"""
WITH RECURSIVE runs AS (
  SELECT coalesce(CAST(doc_id AS VARCHAR), '') AS id,
    translate(unnest(regexp_extract_all(text, '[A-Za-z\x{C0}-\x{FF}]+')), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS w
  FROM documents),
counted AS (SELECT id, w, count(*) AS n, id || ':' || w AS s FROM runs WHERE length(w) >= 5 GROUP BY id, w),
-- crc32 bit by bit over the UTF-8 bytes
bytes AS (
  SELECT w, n, flatten(list_transform(list_transform(string_split(s, ''), lambda c: unicode(c)),
    lambda c: CASE WHEN c < 128 THEN [c] ELSE [192 + c // 64, 128 + c % 64] END)) AS b FROM counted),
bits AS (SELECT w, n, flatten(list_transform(b, lambda x: [x % 2, x // 2 % 2, x // 4 % 2, x // 8 % 2, x // 16 % 2, x // 32 % 2, x // 64 % 2, x // 128 % 2])) AS b FROM bytes),
hashed AS (
  SELECT w, n, xor(list_reduce(list_transform(b, lambda x: CAST(x AS BIGINT)),
    lambda c, x: xor(c // 2, 3988292384 * (xor(c, x) % 2)), CAST(4294967295 AS BIGINT)), 4294967295) AS h FROM bits),
words AS (
  SELECT word, CAST(sum(n) AS BIGINT) AS n FROM (
    SELECT n, CASE WHEN h % 97 = 0 THEN left(w, h % length(w)) || substr(w, h % length(w) + 2) ELSE w END AS word FROM hashed)
  WHERE length(word) >= 5 GROUP BY word HAVING sum(n) >= 3),
cuts AS (SELECT word, n, left(word, i) AS a, substr(word, i + 2) AS b, left(word, i) || substr(word, i + 2) AS less FROM (SELECT word, n, unnest(range(length(word))) AS i FROM words)),
pairs AS (
  SELECT x.word, x.n, y.word AS near, y.n AS near_n FROM cuts x JOIN cuts y ON x.a = y.a AND x.b = y.b AND x.word <> y.word
  UNION SELECT x.word, x.n, y.word, y.n FROM cuts x JOIN words y ON x.less = y.word
  UNION SELECT y.word, y.n, x.word, x.n FROM cuts x JOIN words y ON x.less = y.word),
best AS (
  SELECT word, n, CAST(count(*) AS BIGINT) AS n_near, arg_min(near, {'m': -near_n, 'w': near}) AS near, max(near_n) AS near_n FROM pairs GROUP BY word, n),
formed AS (
  SELECT w.word, w.n, coalesce(n_near, 0) AS n_near, CASE WHEN near_n >= 2 * w.n THEN near END AS form, CASE WHEN near_n >= 2 * w.n THEN near_n END AS form_n
  FROM words w LEFT JOIN best b ON w.word = b.word),
chains AS (
  SELECT word, form AS root FROM formed WHERE form IS NOT NULL
  UNION ALL SELECT c.word, f.form FROM chains c JOIN formed f ON c.root = f.word WHERE f.form IS NOT NULL),
ends AS (SELECT c.word, c.root FROM chains c JOIN formed f ON c.root = f.word WHERE f.form IS NULL)
SELECT f.word, n, n_near, form, form_n, coalesce(root, f.word) AS root FROM formed f LEFT JOIN ends e ON f.word = e.word
"""

"""DuckDB SQL for the corpus queries that SQL can express."""

OP7 = r"""WITH d AS (SELECT doc_id, source, coalesce(text, '') AS t FROM documents),
  w AS (SELECT doc_id, source, t, list_filter(regexp_split_to_array(t, '[\x20\x09-\x0D]+'), lambda x: x <> '') AS ws, list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS ls FROM d),
  n AS (SELECT doc_id, source, len(ws) AS n_words, coalesce(list_sum(list_transform(ws, lambda x: length(x))), 0) AS word_chars, length(regexp_replace(t, '[^#*$%&|<>]+', '', 'g')) AS n_symbols, len(ls) - len(list_distinct(ls)) AS n_dup_lines FROM w),
  g AS (SELECT doc_id, i, array_to_string(ws[i:i + 7], ' ') AS gram FROM w, unnest(range(1, len(ws) - 6)) r(i)),
  twice AS (SELECT doc_id, i FROM (SELECT *, count(*) OVER (PARTITION BY doc_id, gram) AS k FROM g) WHERE k > 1),
  covered AS (SELECT doc_id, count(DISTINCT p) AS n_repeat_words FROM (SELECT doc_id, unnest(range(i, i + 8)) AS p FROM twice) GROUP BY doc_id),
  l AS (SELECT doc_id, source, lower(trim(regexp_replace(x, '[\x20\x09-\x0D]+', ' ', 'g'))) AS line FROM (SELECT doc_id, source, unnest(ls) AS x FROM w)),
  f AS (SELECT source, line, count(DISTINCT doc_id) AS k FROM l GROUP BY 1, 2),
  r AS (SELECT doc_id, sum(length(l.line)) AS line_chars, coalesce(sum(length(l.line)) FILTER (WHERE k > 10), 0) AS removed_chars FROM l JOIN f ON l.source = f.source AND l.line = f.line GROUP BY 1),
  b AS (SELECT n.*, coalesce(n_repeat_words, 0) AS n_repeat_words, coalesce(removed_chars, 0) AS removed_chars, coalesce(line_chars, 0) AS line_chars FROM n LEFT JOIN covered c ON n.doc_id = c.doc_id LEFT JOIN r ON n.doc_id = r.doc_id)
  SELECT doc_id, CAST(n_words AS BIGINT) AS n_words, CAST(word_chars AS BIGINT) AS word_chars, CAST(n_symbols AS BIGINT) AS n_symbols, CAST(n_dup_lines AS BIGINT) AS n_dup_lines, CAST(n_repeat_words AS BIGINT) AS n_repeat_words,
    n_words < 20 OR 100 * n_repeat_words > 30 * n_words AS base_failed, CAST(removed_chars AS BIGINT) AS removed_chars, CAST(line_chars AS BIGINT) AS line_chars,
    NOT (n_words < 20 OR 100 * n_repeat_words > 30 * n_words) AND NOT 2 * removed_chars > line_chars AS kept FROM b"""

OP12 = r"""WITH RECURSIVE w AS (SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS ws FROM documents),
  s AS (SELECT DISTINCT doc_id, unnest(CASE WHEN len(ws) = 0 THEN [] WHEN len(ws) < 3 THEN [array_to_string(ws, ' ')] ELSE list_transform(range(1, len(ws) - 1), lambda i: array_to_string(ws[i:i + 2], ' ')) END) AS shingle FROM w),
  n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY 1),
  shared AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS k FROM s a JOIN s b ON a.shingle = b.shingle AND a.doc_id <> b.doc_id GROUP BY ALL),
  links AS (SELECT a, b FROM shared JOIN n x ON a = x.doc_id JOIN n y ON b = y.doc_id WHERE 100 * k >= 90 * (x.n + y.n - k)),
  reach(doc_id, seen) AS (SELECT doc_id, doc_id FROM w UNION SELECT reach.doc_id, b FROM reach JOIN links ON seen = a)
  SELECT w.doc_id, coalesce(n, 0) AS n_shingles, least_id AS component_id FROM w LEFT JOIN n ON w.doc_id = n.doc_id JOIN (SELECT doc_id, min(seen) AS least_id FROM reach GROUP BY 1) r ON w.doc_id = r.doc_id"""

#: crc32 is worked out byte by byte, from a table that follows from its polynomial.
OP13 = r"""WITH RECURSIVE tab AS (SELECT list(list_reduce([i::UBIGINT, 0, 0, 0, 0, 0, 0, 0, 0], lambda c, s: CASE WHEN c % 2 = 1 THEN xor(c >> 1, 3988292384::UBIGINT) ELSE c >> 1 END) ORDER BY i) AS t FROM range(256) r(i)),
  runs AS (SELECT doc_id, word, count(*) AS n FROM (SELECT doc_id, translate(unnest(regexp_extract_all(text, '[A-Za-zÀ-ÿ]+')), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS word FROM documents) GROUP BY ALL HAVING length(word) >= 6),
  coded AS (SELECT word, n, hex(encode(coalesce(CAST(doc_id AS VARCHAR), '') || ':' || word)) AS x FROM runs),
  hashed AS (SELECT word, n, xor(list_reduce(list_prepend(4294967295::UBIGINT, list_transform(range(0, length(x) // 2), lambda i: CAST('0x' || x[2 * i + 1:2 * i + 2] AS UBIGINT))), lambda c, b: xor(c >> 8, t[CAST(xor(c, b) & 255 AS BIGINT) + 1])), 4294967295::UBIGINT) AS h FROM coded, tab),
  planted AS (SELECT CASE WHEN h % 199 = 0 THEN word[:CAST(h % length(word) AS BIGINT)] || word[CAST(h % length(word) AS BIGINT) + 2:] ELSE word END AS word, n FROM hashed),
  words AS (SELECT word, CAST(sum(n) AS BIGINT) AS n FROM planted WHERE length(word) >= 6 GROUP BY 1 HAVING sum(n) >= 5),
  cut AS (SELECT word, n, i, word[:i - 1] || word[i + 1:] AS rest FROM words, unnest(range(1, length(word) + 1)) r(i)),
  pairs AS (SELECT a.word, b.word AS other, b.n AS m FROM cut a JOIN cut b ON a.i = b.i AND a.rest = b.rest AND a.word <> b.word
    UNION SELECT a.word, b.word, b.n FROM cut a JOIN words b ON a.rest = b.word
    UNION SELECT b.word, a.word, a.n FROM cut a JOIN words b ON a.rest = b.word),
  best AS (SELECT word, count(*) AS n_near, arg_min(other, (-m, other)) AS other, max(m) AS m FROM pairs GROUP BY 1),
  forms AS (SELECT w.word, w.n, coalesce(n_near, 0) AS n_near, CASE WHEN m >= 5 * w.n THEN other END AS form, CASE WHEN m >= 5 * w.n THEN m END AS form_n FROM words w LEFT JOIN best b ON w.word = b.word),
  way(word, last) AS (SELECT word, word FROM forms UNION ALL SELECT way.word, f.form FROM way JOIN forms f ON way.last = f.word WHERE f.form IS NOT NULL),
  ends AS (SELECT way.word, way.last AS root FROM way JOIN forms f ON way.last = f.word WHERE f.form IS NULL)
  SELECT forms.word, form, root, n, n_near, form_n FROM forms JOIN ends ON forms.word = ends.word"""

ORACLES = {"op7_line_frequency": OP7, "op12_similar_sets": OP12, "op13_spelling_variants": OP13}

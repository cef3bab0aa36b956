"""DuckDB SQL for the corpus queries that SQL can state."""

SPACE = r"[\x20\x09-\x0D]+"

RULES = rf"""
WITH d AS (SELECT doc_id, coalesce(source, '') AS host, coalesce(text, '') AS t FROM documents),
word AS (
  SELECT doc_id, unnest(ws) AS w, generate_subscripts(ws, 1) AS i
  FROM (SELECT doc_id, list_filter(regexp_split_to_array(t, '{SPACE}'), lambda x: x <> '') AS ws FROM d)),
triple AS (
  SELECT doc_id, i, w, lead(w, 1) OVER p AS w2, lead(w, 2) OVER p AS w3 FROM word WINDOW p AS (PARTITION BY doc_id ORDER BY i)),
again AS (
  SELECT doc_id, i FROM triple WHERE w3 IS NOT NULL QUALIFY count(*) OVER (PARTITION BY doc_id, w, w2, w3) > 1),
covered AS (
  SELECT doc_id, count(DISTINCT i + k) AS n FROM (SELECT doc_id, i, unnest([0, 1, 2]) AS k FROM again) GROUP BY doc_id),
line AS (
  SELECT doc_id, host, l, regexp_replace(lower(trim(regexp_replace(l, '{SPACE}', ' ', 'g'))), '[1-9]', '0', 'g') AS norm
  FROM (SELECT doc_id, host, unnest(string_split(t, chr(10))) AS l FROM d)),
dup AS (
  SELECT doc_id, count(*) - count(DISTINCT l) AS n FROM line WHERE norm <> '' GROUP BY doc_id),
held AS (
  SELECT doc_id, host, norm, sum(length(norm) - length(replace(norm, ' ', '')) + 1) AS w
  FROM line WHERE norm <> '' GROUP BY ALL),
over_limit AS (
  SELECT host, norm, count(*) AS n, min(doc_id) AS earliest FROM held GROUP BY host, norm
  HAVING count(*) >= 10 AND count(*) > 0.01 * (SELECT count(*) FROM d WHERE d.host = held.host)),
removed AS (
  SELECT h.doc_id, sum(h.w) AS w FROM held h JOIN over_limit o ON h.host = o.host AND h.norm = o.norm AND h.doc_id <> o.earliest
  GROUP BY h.doc_id),
total AS (SELECT doc_id, count(*) AS n FROM word GROUP BY doc_id),
m AS (
  SELECT d.doc_id, coalesce(total.n, 0) AS n_words,
    CAST(length(regexp_replace(t, '{SPACE}', '', 'g')) AS BIGINT) AS word_chars,
    CAST(length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols,
    coalesce(dup.n, 0) AS n_dup_lines, coalesce(covered.n, 0) AS n_repeat_words,
    CAST(coalesce(removed.w, 0) AS BIGINT) AS removed_words
  FROM d LEFT JOIN total USING (doc_id) LEFT JOIN dup USING (doc_id) LEFT JOIN covered USING (doc_id) LEFT JOIN removed USING (doc_id))
SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed,
  NOT (n_words < 50 OR 100 * n_repeat_words > 50 * n_words) AND NOT removed_words > 0.7 * n_words AS kept
FROM m
"""

LINES = rf"""
WITH line AS (
  SELECT doc_id, generate_subscripts(ls, 1) AS pos, unnest(ls) AS l
  FROM (SELECT doc_id, string_split(text, chr(10)) AS ls FROM documents)),
words AS (
  SELECT doc_id, pos, l, norm, string_split(norm, ' ') AS ws, len(string_split(norm, ' ')) AS n
  FROM (SELECT *, trim(regexp_replace(lower(l), '[\x20\x09\x0B-\x0D]+', ' ', 'g')) AS norm FROM line) WHERE norm <> ''),
earliest AS (
  SELECT norm, any_value(ws) AS ws, any_value(n) AS n, min((doc_id, pos)) AS born FROM words WHERE n >= 3 GROUP BY norm),
variant AS (
  SELECT norm, born, n, i, array_to_string(list_concat(ws[:i - 1], ws[i + 1:]), ' ') AS v
  FROM (SELECT *, unnest(range(1, n + 1)) AS i FROM earliest WHERE n >= 10)),
near AS (
  SELECT a.norm FROM variant a JOIN variant b ON a.n = b.n AND a.i = b.i AND a.v = b.v AND b.born < a.born
  UNION SELECT a.norm FROM variant a JOIN earliest b ON a.v = b.norm AND b.n >= 10 AND b.born < a.born
  UNION SELECT b.norm FROM variant a JOIN earliest b ON a.v = b.norm AND b.n >= 10 AND a.born < b.born),
gone AS (
  SELECT w.doc_id, w.pos FROM words w JOIN earliest e USING (norm)
  WHERE w.n >= 3 AND ((w.doc_id, w.pos) <> e.born OR w.norm IN (SELECT norm FROM near)))
SELECT d.doc_id, CASE WHEN d.text IS NULL THEN NULL ELSE coalesce(s.text, '') END AS text, coalesce(s.lines_removed, 0)::INTEGER AS lines_removed
FROM documents d LEFT JOIN (
  SELECT doc_id, string_agg(l, chr(10) ORDER BY pos) FILTER (g IS NULL) AS text, count(g) AS lines_removed
  FROM (SELECT line.*, gone.pos AS g FROM line LEFT JOIN gone USING (doc_id, pos)) GROUP BY doc_id) s USING (doc_id)
"""

AUDIT = rf"""
WITH d AS (SELECT doc_id, coalesce(source, '') AS part, coalesce(text, '') AS t FROM documents),
w AS (SELECT *, regexp_extract_all(t, '[^\x20\x09-\x0D]+') AS ws, min(doc_id) OVER (PARTITION BY t) AS original FROM d),
f AS (
  SELECT doc_id, part, [len(ws) < 200, 100 * len(list_distinct(ws)) < 50 * len(ws),
    100 * length(regexp_replace(t, '[^A-Z]', '', 'g')) > 2 * length(t), regexp_matches(t, '[#$%&*|]'), doc_id > original] AS fails
  FROM w),
label AS (SELECT doc_id, bool_or(quality = 1) AS good, bool_or(toxic = 1) AS toxic FROM labels GROUP BY doc_id),
cell AS (
  SELECT part, fails, count(*) AS n, count(*) FILTER (WHERE good) AS good, count(*) FILTER (WHERE toxic) AS toxic
  FROM f LEFT JOIN label USING (doc_id) GROUP BY part, fails),
letter AS (SELECT unnest([1, 2, 3, 4, 5]) AS i),
orders AS (
  SELECT [a.i, b.i, c.i, d.i, e.i] AS o FROM letter a, letter b, letter c, letter d, letter e
  WHERE len(list_distinct([a.i, b.i, c.i, d.i, e.i])) = 5),
steps AS (SELECT o, list_aggregate(list_transform(o, lambda x: substr('ABCDE', x, 1)), 'string_agg', '') AS filter_order, unnest([1, 2, 3, 4, 5]) AS step FROM orders),
walked AS (
  SELECT cell.*, filter_order, step, o[step] AS i, fails[o[step]] AS now,
    list_bool_or(list_transform(o[:step - 1], lambda x: fails[x])) AS before, len(list_filter(fails, lambda x: x)) AS n_fails
  FROM cell, steps),
counted AS (
  SELECT part, filter_order, step, any_value(i) AS i,
    coalesce(sum(n) FILTER (WHERE NOT now AND NOT coalesce(before, false)), 0) AS kept,
    coalesce(sum(n) FILTER (WHERE now AND NOT coalesce(before, false)), 0) AS removed,
    coalesce(sum(n) FILTER (WHERE now AND coalesce(before, false)), 0) AS redundant,
    coalesce(sum(n) FILTER (WHERE now AND n_fails = 1), 0) AS unique_fails,
    coalesce(sum(good) FILTER (WHERE now AND NOT coalesce(before, false)), 0) AS good_lost,
    coalesce(sum(toxic) FILTER (WHERE now AND NOT coalesce(before, false)), 0) AS toxic_lost
  FROM walked GROUP BY part, filter_order, step)
SELECT part, filter_order, CAST(step AS INTEGER) AS step, CAST(kept AS BIGINT) AS kept, CAST(removed AS BIGINT) AS removed,
  CAST(redundant AS BIGINT) AS redundant, CAST(unique_fails AS BIGINT) AS unique_fails, CAST(good_lost AS BIGINT) AS good_lost,
  CAST(toxic_lost AS BIGINT) AS toxic_lost, CAST(sum(removed) OVER (PARTITION BY part, i) AS BIGINT) AS shapley
FROM counted
"""

ORACLE_SQL = {"op9_quality_rules": RULES, "op2_line_dedup": LINES, "op11_filter_audit": AUDIT}

"""DuckDB SQL for the training-data queries that SQL can express: each computes its result in its own way."""

from __future__ import annotations

from narrata.llm import licenses, quality_rules
from narrata.llm.common import PLAIN, WORD


def quoted(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def quality() -> str:
    cfg = quality_rules.DEFAULTS
    common = ", ".join(f"({quoted(lang)}, {quoted(w)}, {k})" for lang, top in quality_rules.COMMON.items() for k, w in enumerate(top))
    return rf"""
WITH common(lang, word, k) AS (VALUES {common}),
docs AS (SELECT row_number() OVER () AS r, doc_id, coalesce(lang, chr(1)) AS lang, coalesce(text, '') AS text FROM documents),
w AS (SELECT *, regexp_extract_all(text, '{WORD}') AS ws, regexp_replace(text, '[a-z\x09-\x0D\x20]+', '', 'g') AS rest FROM docs),
windows AS (SELECT r, i, ws[i] || ' ' || ws[i+1] || ' ' || ws[i+2] AS g FROM w, unnest(range(1, len(ws) - 1)) AS u(i)),
twice AS (SELECT r, i FROM (SELECT r, i, count(*) OVER (PARTITION BY r, g) AS n FROM windows) WHERE n > 1),
covered AS (SELECT r, count(DISTINCT i + d) AS n_repeat_words FROM twice, (VALUES (0), (1), (2)) AS x(d) GROUP BY r),
lines AS (SELECT r, count(*) - count(DISTINCT line) AS n_dup_lines FROM w, unnest(string_split(text, chr(10))) AS u(line)
  WHERE regexp_matches(line, '{WORD}') GROUP BY r),
base AS (SELECT r, doc_id, lang, len(ws) AS n_words, length(array_to_string(ws, '')) AS word_chars, length(text) AS n,
    length(regexp_replace(rest, '[^#*$%&|<>]+', '', 'g')) AS n_symbols,
    length(regexp_replace(rest, '[^\p{{Lu}}]+', '', 'g')) AS c1, length(regexp_replace(rest, '[^0-9]+', '', 'g')) AS c2,
    length(regexp_replace(rest, '[^.,;:?!''"()\-]+', '', 'g')) AS c3,
    length(regexp_replace(rest, '[^#*$%&|<>=+_@/\\^~{{}}\[\]]+', '', 'g')) AS c4 FROM w),
chars AS (SELECT r, lang, n, k, c::DOUBLE AS c FROM (SELECT r, lang, n, unnest([0, 1, 2, 3, 4, 5]) AS k,
    unnest([n - word_chars, c1, c2, c3, c4, word_chars - c1 - c2 - c3 - c4]) AS c FROM base)),
spoken AS (SELECT r, lower(word) AS word FROM w, unnest(ws) AS u(word)),
hits AS (SELECT b.r, b.lang, c.k, count(*) AS c FROM base b JOIN spoken s USING (r) JOIN common c ON c.lang = b.lang AND c.word = s.word GROUP BY ALL),
wordy AS (SELECT r, lang, k, c::DOUBLE AS c FROM hits UNION ALL
  SELECT b.r, b.lang, 99, n_words - coalesce(s, 0) FROM base b LEFT JOIN (SELECT r, sum(c) AS s FROM hits GROUP BY r) USING (r) WHERE b.lang IN (SELECT lang FROM common)),
full_words AS (SELECT g.r, g.lang, v.k, coalesce(x.c, 0) AS c FROM base g JOIN (SELECT DISTINCT lang, k FROM wordy) v USING (lang) LEFT JOIN wordy x ON x.r = g.r AND x.k = v.k),
pq AS (SELECT 'c' AS what, * FROM (SELECT r, k, c / nullif(sum(c) OVER (PARTITION BY r), 0) AS p, sum(c) OVER (PARTITION BY lang, k) / nullif(sum(c) OVER (PARTITION BY lang), 0) AS q FROM chars)
  UNION ALL SELECT 'w', * FROM (SELECT r, k, c / nullif(sum(c) OVER (PARTITION BY r), 0) AS p, sum(c) OVER (PARTITION BY lang, k) / nullif(sum(c) OVER (PARTITION BY lang), 0) AS q FROM full_words)),
jsd AS (SELECT what, r, sqrt(greatest(0, sum(CASE WHEN p > 0 THEN p * log2(2 * p / (p + q)) ELSE 0 END + CASE WHEN q > 0 THEN q * log2(2 * q / (p + q)) ELSE 0 END) / 2)) AS d
  FROM pq GROUP BY what, r),
judged AS (SELECT b.*, coalesce(n_repeat_words, 0) AS n_repeat_words, coalesce(n_dup_lines, 0) AS n_dup_lines,
    n_words < 50 OR 100 * coalesce(n_repeat_words, 0) > 50 * n_words AS base_failed,
    CASE WHEN n >= {cfg["min_chars"]} THEN coalesce(jc.d, 0) ELSE 0 END AS dc, CASE WHEN n_words >= {cfg["min_words"]} THEN coalesce(jw.d, 0) ELSE 0 END AS dw
  FROM base b LEFT JOIN covered USING (r) LEFT JOIN lines USING (r) LEFT JOIN jsd jc ON jc.r = b.r AND jc.what = 'c' LEFT JOIN jsd jw ON jw.r = b.r AND jw.what = 'w')
SELECT doc_id, n_words::BIGINT AS n_words, word_chars::BIGINT AS word_chars, n_symbols::BIGINT AS n_symbols, n_dup_lines::BIGINT AS n_dup_lines,
  n_repeat_words::BIGINT AS n_repeat_words, base_failed, NOT base_failed AND dc <= {cfg["max_char_distance"]} AND dw <= {cfg["max_word_distance"]} AS kept FROM judged"""


def near() -> str:
    return rf"""
WITH RECURSIVE w AS (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(lower(text), '{PLAIN}') AS ws FROM documents),
g AS (SELECT r, i, array_to_string(ws[i:i + 4], ' ') AS s FROM w, unnest(range(1, greatest(2, len(ws) - 3))) AS u(i) WHERE len(ws) > 0),
e AS MATERIALIZED (SELECT r, s, row_number() OVER (PARTITION BY r, s ORDER BY i) AS nth FROM g), n AS (SELECT r, count(*) AS n FROM e GROUP BY r),
p AS (SELECT a.r AS x, b.r AS y, count(*) AS c FROM e a JOIN e b ON a.s = b.s AND a.nth = b.nth AND a.r <> b.r GROUP BY ALL),
l AS MATERIALIZED (SELECT x, y FROM p JOIN n a ON a.r = x JOIN n b ON b.r = y WHERE c / (a.n + b.n - c) >= 0.8),
reach AS (SELECT r AS x, r AS y FROM w UNION SELECT reach.x, l.y FROM reach JOIN l ON l.x = reach.y),
c AS (SELECT x AS r, min(y) AS root FROM reach GROUP BY x)
SELECT doc_id, min(doc_id) OVER (PARTITION BY root) AS class_id, count(*) OVER (PARTITION BY root) AS class_size,
  row_number() OVER (PARTITION BY root ORDER BY doc_id) = 1 AS kept FROM w JOIN c USING (r)"""


def leaks() -> str:
    grams = rf"SELECT *, ws[i] || ' ' || ws[i+1] || ' ' || ws[i+2] || ' ' || ws[i+3] || ' ' || ws[i+4] AS g FROM (SELECT *, unnest(range(1, len(ws) - 3)) AS i FROM (SELECT *, regexp_extract_all(lower(text), '{PLAIN}') AS ws FROM %s))"
    return f"""
WITH items AS (SELECT DISTINCT item_id, g FROM ({grams % "benchmark"})), sizes AS (SELECT item_id, count(*) AS n_item FROM items GROUP BY item_id),
docs AS (SELECT DISTINCT doc_id, text, g FROM ({grams % "documents"})),
shared AS (SELECT doc_id, text, item_id, count(*) AS n_shared FROM docs JOIN items USING (g) GROUP BY ALL)
SELECT doc_id, item_id, n_shared::BIGINT AS n_shared, n_item::BIGINT AS n_item, n_shared / n_item AS containment
FROM shared JOIN sizes USING (item_id) WHERE n_shared / n_item >= 0.8"""


def scanned() -> str:
    given = ", ".join(f"({k}, {quoted(label)}, {quoted(text)})" for k, (label, text) in enumerate(licenses.TEMPLATES))
    phrases = ", ".join(f"({quoted(label)}, {quoted(p)})" for p, label in licenses.PHRASES.items())
    return f"""
WITH phrases AS (SELECT label, string_split(p, ' ') AS ps FROM (VALUES {phrases}) AS x(label, p)),
templates AS (SELECT t, label, list_distinct(regexp_extract_all(text, '{PLAIN}')) AS ts FROM (VALUES {given}) AS x(t, label, text)),
docs AS (SELECT row_number() OVER () AS r, doc_id, lower(coalesce(text, '')) AS low FROM documents),
w AS (SELECT r, doc_id, low, regexp_extract_all(low, '{PLAIN}') AS ws FROM docs),
spots AS (SELECT r, label, i - 1 AS spot FROM (SELECT r, ws, label, ps, unnest(range(1, len(ws) - len(ps) + 2)) AS i FROM w, phrases WHERE list_has_all(ws, ps)) WHERE ws[i:i + len(ps) - 1] = ps),
base AS (SELECT r, count(*) AS n_base, min(spot) AS first_word, max(spot) AS last_word, list(DISTINCT label) AS base FROM spots GROUP BY r),
wanted AS (SELECT t, label, len(ts) AS size, ceil(len(ts) * {licenses.THRESHOLD} - 1e-9) AS need, unnest(ts) AS token FROM templates),
longest AS (SELECT max(len(regexp_extract_all(text, '{PLAIN}'))) AS most FROM (VALUES {given}) AS x(t, label, text)),
likely AS (SELECT DISTINCT r FROM w, templates WHERE len(list_intersect(list_distinct(ws), ts)) >= ceil(len(ts) * {licenses.THRESHOLD} - 1e-9)),
split AS (SELECT r, unnest(string_split(low, chr(10))) AS line, generate_subscripts(string_split(low, chr(10)), 1) AS i FROM docs WHERE r IN (SELECT r FROM likely)),
lines AS (SELECT r, i, b, len(b) AS n, sum(len(b)) OVER (PARTITION BY r ORDER BY i) AS total, sum(CASE WHEN len(b) = 0 THEN 1 ELSE 0 END) OVER (PARTITION BY r ORDER BY i) AS gaps
  FROM (SELECT r, i, regexp_extract_all(line, '{PLAIN}') AS b FROM split)),
runs AS (SELECT x.r, x.i, y.i AS j FROM lines x JOIN lines y ON x.r = y.r AND x.gaps = y.gaps AND y.i >= x.i AND (y.i = x.i OR y.total - y.n - x.total <= (SELECT most FROM longest)) WHERE x.n > 0 AND y.n > 0),
said AS (SELECT DISTINCT r, i AS j, unnest(b) AS token FROM lines),
found AS (SELECT r, i, t, any_value(label) AS label, count(DISTINCT token) / any_value(size) AS share FROM runs JOIN said USING (r, j) JOIN wanted USING (token) GROUP BY r, i, t HAVING count(DISTINCT token) >= any_value(need)),
more AS (SELECT r, list(DISTINCT label) AS more, max(share) AS most FROM found GROUP BY r)
SELECT doc_id, len(ws)::BIGINT AS n_words, coalesce(n_base, 0)::BIGINT AS n_base, first_word::BIGINT AS first_word, last_word::BIGINT AS last_word,
  array_to_string(list_sort(coalesce(base, []::VARCHAR[])), ',') AS base_labels,
  array_to_string(list_sort(list_distinct(list_concat(coalesce(base, []::VARCHAR[]), coalesce(more, []::VARCHAR[])))), ',') AS labels,
  CASE WHEN n_base > 0 THEN 1.0::DOUBLE ELSE coalesce(most, 0)::DOUBLE END AS score
FROM w LEFT JOIN base USING (r) LEFT JOIN more USING (r)"""


def oracle_sql() -> dict[str, str]:
    return {"op2_near_dedup": near(), "op6_benchmark_decontamination": leaks(), "op7_quality_rules": quality(), "op10_license_scan": scanned()}

"""DuckDB SQL for the native operators: line dedup, license scan, chat formatting. Each says the result, not the method."""

from __future__ import annotations

from . import licenses, linededup

LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
ALNUM = r"'[^\x00-\x2F\x3A-\x60\x7B-\x7F]+'"

#: Near lines by the definition: every pair whose lengths and letters allow it is measured. DuckDB's levenshtein() counts
#: bytes, so characters beyond ASCII (26 kinds at most) stand as capitals, which normalised lines don't have.
OP2 = rf"""
WITH RECURSIVE place AS (
  SELECT doc_id, pos - 1 AS pos, lower(trim(x, ' ' || chr(9) || chr(13))) AS line
  FROM (SELECT doc_id, unnest(w) AS x, generate_subscripts(w, 1) AS pos FROM (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS w FROM documents))),
own AS (SELECT * FROM place WHERE length(line) >= 1),
alien AS (SELECT coalesce(string_agg(DISTINCT c, '' ORDER BY c), '') AS cs FROM (SELECT unnest(string_split(line, '')) AS c FROM own) WHERE ord(c) > 127),
kind AS (SELECT line, length(line) AS n, translate(line, cs, left('ABCDEFGHIJKLMNOPQRSTUVWXYZ', length(cs))) AS code FROM (SELECT DISTINCT line FROM own), alien),
long AS MATERIALIZED (SELECT *, CASE WHEN n < 40 THEN 1 WHEN n < 64 THEN 2 WHEN n < 80 THEN 3 WHEN n < 112 THEN 4 ELSE 5 END AS most,
          list_transform(string_split('abcdefghijklmnopqrstuvwxyz .', ''), lambda c: n - length(replace(code, c, ''))) AS v FROM kind WHERE n >= {linededup.LEAST}),
near AS (SELECT a.line AS a, b.line AS b FROM long a JOIN long b ON b.n BETWEEN a.n AND a.n + 5
         WHERE a.line <> b.line AND b.n - a.n <= a.most AND list_sum(list_transform(list_zip(a.v, b.v), lambda p: abs(p[1] - p[2]))) <= 2 * a.most
         AND levenshtein(a.code, b.code) <= a.most),
link AS (SELECT a, b FROM near UNION SELECT b, a FROM near),
walk AS (SELECT a, b FROM link UNION SELECT walk.a, link.b FROM walk JOIN link ON walk.b = link.a),
class AS (SELECT line, least(line, coalesce(min(b), line)) AS class FROM kind LEFT JOIN walk ON a = line GROUP BY line),
placed AS (SELECT doc_id, pos, min({{'d': doc_id, 'i': pos}}) OVER (PARTITION BY class) AS f FROM own JOIN class USING (line)),
gone AS (SELECT DISTINCT doc_id, pos FROM placed WHERE NOT (doc_id = f.d AND pos = f.i)),
gaps AS (SELECT doc_id, count(*) AS n, string_agg(CAST(pos AS VARCHAR), ',' ORDER BY pos) AS dropped FROM gone GROUP BY doc_id)
SELECT doc_id, max(pos) + 1 AS n_lines, CAST(coalesce(any_value(n), 0) AS BIGINT) AS n_dropped, coalesce(any_value(dropped), '') AS dropped
FROM place LEFT JOIN gaps USING (doc_id) GROUP BY doc_id
"""


def license_sql() -> str:
    """A span is accepted at a diagonal if enough places of the template stand, in the document, on it or near it."""
    every = [t._replace(base=True) for t in licenses.BASE] + licenses.METHOD
    rows = [(i, licenses.template_words(t.text), t.label, t.base) for i, t in enumerate(every)]
    values = ", ".join(f"({i}, {w!r}, '{label}', {base})" for i, w, label, base in rows)
    k = licenses.K
    return rf"""
WITH t(t, w, label, base) AS (VALUES {values}),
size AS (SELECT t, w AS tw, len(w) - {k - 1} AS grams, CASE WHEN base THEN 0 ELSE least({licenses.DRIFT}, len(w) // 4) END AS drift, label, base FROM t),
spot AS (SELECT t, p - 1 AS place, array_to_string(w[p:p + {k - 1}], ' ') AS g FROM t, range(1, len(w) - {k - 2}) AS r(p)),
d AS (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all({LOWER}, {ALNUM}) AS w FROM documents),
anchor AS (SELECT DISTINCT r, t, pos - 1 - place AS a
           FROM (SELECT r, i AS pos, array_to_string(w[i:i + {k - 1}], ' ') AS g FROM d, range(1, len(w) - {k - 2}) AS x(i)) JOIN spot USING (g)),
span AS (SELECT r, t, a, grams, label, base,
           len(list_filter(range(0, grams), lambda p: len(list_filter(range(-drift, drift + 1), lambda e: a + p + e >= 0 AND w[a + p + e + 1:a + p + e + {k}] = tw[p + 1:p + {k}])) > 0)) AS covered
         FROM anchor JOIN size USING (t) JOIN d USING (r)),
good AS (SELECT * FROM span WHERE covered >= grams * CASE WHEN base THEN 1 ELSE {licenses.LEAST_COVER} END),
found AS (SELECT r, count(*) FILTER (base) AS n_base, min(a) FILTER (base) AS first_word, max(a) FILTER (base) AS last_word,
            string_agg(DISTINCT label, ',' ORDER BY label) FILTER (base) AS base_labels, string_agg(DISTINCT label, ',' ORDER BY label) AS labels, max(covered / grams) AS score
          FROM good GROUP BY r)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_base, 0) AS BIGINT) AS n_base, CAST(first_word AS BIGINT) AS first_word, CAST(last_word AS BIGINT) AS last_word,
       coalesce(base_labels, '') AS base_labels, coalesce(labels, '') AS labels, CAST(coalesce(score, 0) AS DOUBLE) AS score
FROM d LEFT JOIN found USING (r)
"""


OP5 = license_sql()

_MARKS = r"^[ \t]*((?:>[ \t]?)+)"

_CHAT = rf"""
m AS (SELECT row_number() OVER () AS r, conv_id, turn, role, string_split(coalesce(text, ''), chr(10)) AS w, md5(coalesce(role, '') || chr(10) || coalesce(text, '')) AS d FROM chat),
l AS (SELECT r, conv_id, turn, d, i, length(regexp_replace(regexp_extract(x, '{_MARKS}', 1), '[^>]', '', 'g')) AS level,
        trim(regexp_replace(lower(regexp_replace(x, '{_MARKS}', '')), '\s+', ' ', 'g')) AS t
      FROM (SELECT r, conv_id, turn, d, unnest(w) AS x, generate_subscripts(w, 1) AS i FROM m WHERE conv_id IS NOT NULL AND turn IS NOT NULL)),
b AS (SELECT *, sum(CASE WHEN t = '' OR before = '' OR above <> level THEN 1 ELSE 0 END) OVER (PARTITION BY r ORDER BY i) AS p
      FROM (SELECT *, lag(t) OVER (PARTITION BY r ORDER BY i) AS before, lag(level) OVER (PARTITION BY r ORDER BY i) AS above FROM l)),
u AS (SELECT r, conv_id, turn, d, level, p, string_agg(t, ' ' ORDER BY i) AS t FROM b WHERE t <> '' GROUP BY ALL),
whole AS (SELECT q.r, q.p, max({{'turn': o.turn, 'd': o.d, 'r': o.r}}) AS original FROM u q JOIN u o ON o.level = 0 AND o.conv_id = q.conv_id AND o.t = q.t AND o.turn < q.turn WHERE q.level > 0 GROUP BY q.r, q.p),
line AS (SELECT q.r, q.i, max({{'turn': o.turn, 'd': o.d, 'r': o.r}}) AS original FROM b q JOIN b o ON o.level = 0 AND o.conv_id = q.conv_id AND o.t = q.t AND o.turn < q.turn WHERE q.level > 0 AND q.t <> '' GROUP BY q.r, q.i),
s AS (SELECT q.r, q.level, coalesce(whole.original, line.original) AS o FROM b q LEFT JOIN whole ON whole.r = q.r AND whole.p = q.p LEFT JOIN line ON line.r = q.r AND line.i = q.i WHERE q.level > 0 AND q.t <> ''),
v AS (SELECT r, o, count(*) FILTER (level = 1) AS votes, count(*) AS n FROM s GROUP BY r, o),
a AS (SELECT r, max(CASE WHEN votes > 0 AND o IS NOT NULL THEN {{'v': votes, 'o': o}} END).o AS best, sum(n) AS n_quoted, coalesce(sum(n) FILTER (o IS NOT NULL), 0) AS n_linked FROM v GROUP BY r),
walk AS (SELECT r, best.r AS above, 1 AS depth FROM a WHERE best IS NOT NULL UNION ALL SELECT w.r, a.best.r, depth + 1 FROM walk w JOIN a ON a.r = w.above WHERE a.best IS NOT NULL),
root AS (SELECT r, arg_max(above, depth) AS root FROM walk GROUP BY r),
plain AS (SELECT r, conv_id, turn, role, d, regexp_replace(array_to_string(list_filter(w, lambda x, i: NOT regexp_matches(x, '{_MARKS}')
            AND NOT (regexp_matches(x, '(?i)\b(wrote|writes|said|schrieb|a écrit|escribió)\b.{{0,40}}:\s*$') AND coalesce(regexp_matches(w[i + 1], '{_MARKS}'), false))), chr(10)), '^\s+|\s+$', '', 'g') AS text FROM m),
threaded AS (SELECT p.*, coalesce(root.root, p.r) AS root FROM plain p LEFT JOIN root USING (r))
SELECT t.conv_id, t.turn, t.role, a.best.turn AS reply_to, f.turn AS thread,
       CASE WHEN t.conv_id IS NULL OR t.turn IS NULL THEN 0 ELSE row_number() OVER (PARTITION BY t.root ORDER BY t.turn, t.d, t.r) - 1 END AS place,
       CAST(coalesce(n_quoted, 0) AS BIGINT) AS n_quoted, CAST(coalesce(n_linked, 0) AS BIGINT) AS n_linked, t.text, '<|' || coalesce(t.role, 'user') || '|>' || chr(10) || t.text || chr(10) || '<|end|>' AS formatted
FROM threaded t JOIN m f ON f.r = t.root LEFT JOIN a ON a.r = t.r
"""

OP7 = f"WITH RECURSIVE chat AS (SELECT * FROM conversations), {_CHAT}"

#: The same over conversations whose messages quote those before them.
QUOTED = f"""
WITH RECURSIVE before AS (SELECT conv_id, turn + 1 AS turn, max(text) AS text FROM conversations WHERE text IS NOT NULL GROUP BY conv_id, turn),
chat AS (
  SELECT c.conv_id, c.turn, c.role, coalesce(CASE c.turn % 4
      WHEN 1 THEN '> ' || replace(replace(p.text, chr(10), chr(10) || '> '), '. ', '.' || chr(10) || '> ')
      WHEN 2 THEN coalesce('>> ' || replace(g.text, chr(10), chr(10) || '>> ') || chr(10), '') || '> ' || replace(p.text, chr(10), chr(10) || '> ')
      WHEN 3 THEN '> ' || string_split(p.text, chr(10))[-1] END || chr(10) || coalesce(c.text, ''), c.text) AS text
  FROM conversations c LEFT JOIN before p ON p.conv_id = c.conv_id AND p.turn = c.turn LEFT JOIN before g ON g.conv_id = c.conv_id AND g.turn = c.turn - 1), {_CHAT}"""

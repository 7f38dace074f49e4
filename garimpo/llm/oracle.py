"""DuckDB SQL for the operators' queries that SQL can express at a small scale.

Token ids, trained models and the pipeline have none; tests/llm holds them
against brute force, round trips or held-out labels.
"""

from __future__ import annotations

from .chat import CONTROL, END, START

ASCII_LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
SPACED = r"[^\x20\x09-\x0D]+"

OP2 = rf"""
WITH d AS (SELECT doc_id, regexp_extract_all({ASCII_LOWER}, '{WORD}') AS w FROM documents),
b AS (SELECT item_id, w, least(10, len(w)) AS n FROM (SELECT item_id, regexp_extract_all({ASCII_LOWER}, '{WORD}') AS w FROM benchmark) WHERE len(w) > 0),
p AS (SELECT DISTINCT CAST(item_id AS VARCHAR) AS item, n, array_to_string(w[i : i + n - 1], ' ') AS phrase FROM (SELECT *, unnest(range(1, len(w) - n + 2)) AS i FROM b)),
s AS (SELECT doc_id, n, i, array_to_string(w[i : i + n - 1], ' ') AS phrase FROM (SELECT *, unnest(range(1, len(w) - n + 2)) AS i FROM d, (SELECT DISTINCT n FROM p) WHERE len(w) >= n)),
h AS (SELECT doc_id, item, i, n FROM s JOIN p USING (n, phrase)),
c AS (SELECT doc_id, count(DISTINCT j) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + n)) AS j FROM h) GROUP BY 1),
o AS (SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items FROM (SELECT DISTINCT doc_id, item FROM h) GROUP BY 1)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN c USING (doc_id) LEFT JOIN o USING (doc_id)"""


def _escaped(text: str) -> str:
    out = rf"replace({text}, '\', '\\')"
    for c in sorted(CONTROL, key=len, reverse=True):
        out = rf"replace({out}, '{c}', '{c[0]}\{c[1:]}')"
    return out


OP3 = rf"""
WITH c AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '</s>[INST] ok [/INST]' UNION ALL SELECT -7, 1, 'assistant', '</s>[INST] ok [/INST]')
SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, text)) AS turns_sha256,
  CAST(coalesce(sum(length(text)) FILTER (role = 'assistant'), 0) AS BIGINT) AS loss_chars, sha256(coalesce(string_agg(text, '' ORDER BY turn NULLS FIRST, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
  CAST(sum({len(START) + len(END) + 2} + length(role) + length({_escaped("text")})) AS BIGINT) AS formatted_chars
FROM c GROUP BY conv_id"""

CHAT_MIXED = rf"""
WITH r AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations),
c AS (SELECT conv_id, turn, role AS o, text AS p, 0 AS k, CASE WHEN (conv_id + turn) % 5 = 4 THEN 'user' ELSE role END AS role, text FROM r UNION ALL SELECT conv_id, turn, role, text, 1, 'assistant', 'ok' FROM r WHERE (conv_id + turn) % 5 = 4)
SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, o, p, k)) AS turns_sha256,
  CAST(coalesce(sum(length(text)) FILTER (role = 'assistant'), 0) AS BIGINT) AS loss_chars, sha256(coalesce(string_agg(text, '' ORDER BY turn, o, p, k) FILTER (role = 'assistant'), '')) AS loss_sha256,
  CAST(sum({len(START) + len(END) + 2} + length(role) + length({_escaped("text")})) AS BIGINT) AS formatted_chars
FROM c GROUP BY conv_id"""

OP5 = rf"""
WITH d AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '{SPACED}') AS w FROM documents),
x AS (SELECT doc_id, i, md5(array_to_string(w[i : i + 34], ' ')) AS h FROM (SELECT *, unnest(range(1, len(w) - 33)) AS i FROM d WHERE len(w) >= 35)),
r AS (SELECT h FROM x GROUP BY h HAVING count(*) > 1),
g AS (SELECT DISTINCT doc_id, unnest(range(i, i + 35)) AS j FROM x JOIN r USING (h)),
k AS (SELECT doc_id, j, w[j] AS t FROM (SELECT doc_id, w, unnest(range(1, len(w) + 1)) AS j FROM d)),
s AS (SELECT doc_id, string_agg(t, ' ' ORDER BY j) AS kept FROM k ANTI JOIN g USING (doc_id, j) GROUP BY 1),
n AS (SELECT doc_id, count(*) AS n_removed FROM g GROUP BY 1)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_removed, 0) AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256 FROM d LEFT JOIN n USING (doc_id) LEFT JOIN s USING (doc_id)"""

#: crc32 of a number's decimal digits, bit by bit.
CRC32 = "xor(list_reduce(list_prepend(4294967295::BIGINT, flatten(list_transform(string_split(CAST({0} AS VARCHAR), ''), lambda x: [ascii(x)::BIGINT, -1, -1, -1, -1, -1, -1, -1, -1]))), lambda c, x: CASE WHEN x >= 0 THEN xor(c, x) WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384::BIGINT) ELSE c >> 1 END), 4294967295::BIGINT)"

OP7 = rf"""
WITH d AS (SELECT doc_id, lang, coalesce({CRC32.format("doc_id")} % 4 = 2, FALSE) AS held_out, trim(regexp_replace(lower(coalesce(text, '')), '[^\p{{L}}]+', ' ', 'g'), ' ') AS t FROM documents),
p AS (SELECT doc_id, lang, held_out, ' ' || t || ' ' AS t FROM d WHERE t <> ''),
u AS (SELECT doc_id, lang, held_out, unnest(string_split(t, '')) AS a, generate_subscripts(string_split(t, ''), 1) AS i FROM p),
w AS (SELECT *, lead(a) OVER s AS b, lead(a, 2) OVER s AS c FROM u WINDOW s AS (PARTITION BY doc_id ORDER BY i)),
g AS (SELECT doc_id, lang, held_out, a AS g FROM w WHERE a <> ' ' UNION ALL SELECT doc_id, lang, held_out, a || b FROM w WHERE b IS NOT NULL UNION ALL SELECT doc_id, lang, held_out, a || b || c FROM w WHERE c IS NOT NULL),
own AS (SELECT doc_id, g, row_number() OVER (PARTITION BY doc_id ORDER BY count(*) DESC, length(g), g) - 1 AS r FROM g GROUP BY doc_id, g),
mine AS (SELECT * FROM own WHERE r < 400),
ranked AS (SELECT lang, g, row_number() OVER (PARTITION BY lang ORDER BY count(*) DESC, length(g), g) - 1 AS r FROM g WHERE lang IS NOT NULL AND NOT held_out GROUP BY lang, g),
prof AS (SELECT * FROM ranked WHERE r < 400), langs AS (SELECT DISTINCT lang FROM prof),
cost AS (SELECT doc_id, l.lang, sum(coalesce(abs(p.r - m.r), 400)) / (count(*) * 400)::DOUBLE AS c FROM mine m CROSS JOIN langs l LEFT JOIN prof p ON p.lang = l.lang AND p.g = m.g GROUP BY ALL),
best AS (SELECT doc_id, arg_min(lang, {{'c': c, 'l': lang}}) AS lang_pred, min(c) AS m FROM cost GROUP BY 1),
soft AS (SELECT doc_id, 1 / sum(exp(-25 * (c - m))) AS score FROM cost JOIN best USING (doc_id) GROUP BY 1)
SELECT doc_id, held_out, coalesce(lang_pred, 'und') AS lang_pred, round(coalesce(score, 0), 6) AS score FROM d LEFT JOIN best USING (doc_id) LEFT JOIN soft USING (doc_id)"""

OP9 = """
WITH RECURSIVE v AS (SELECT vec_id, embedding::DOUBLE[] AS e FROM embeddings WHERE embedding IS NOT NULL AND len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0 AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
l AS (SELECT a.vec_id AS a, b.vec_id AS b FROM v a JOIN v b ON a.vec_id <> b.vec_id AND len(a.e) = len(b.e) AND list_inner_product(a.e, b.e) / (sqrt(list_inner_product(a.e, a.e)) * sqrt(list_inner_product(b.e, b.e))) >= 0.9),
r AS (SELECT vec_id AS a, vec_id AS b FROM embeddings UNION SELECT r.a, l.b FROM r JOIN l ON r.b = l.a),
c AS (SELECT a AS vec_id, min(b) AS component_id FROM r GROUP BY 1), n AS (SELECT a AS vec_id, count(*) AS n_links FROM l GROUP BY 1)
SELECT vec_id, coalesce(n_links, 0) AS n_links, component_id, vec_id = component_id AS kept FROM embeddings JOIN c USING (vec_id) LEFT JOIN n USING (vec_id)"""

OP10 = rf"""
WITH RECURSIVE d AS (SELECT doc_id, regexp_extract_all({ASCII_LOWER}, '{SPACED}') AS w FROM documents),
s AS (SELECT DISTINCT doc_id, array_to_string(w[i : i + 2], ' ') AS g FROM (SELECT *, unnest(range(1, greatest(1, len(w) - 2) + 1)) AS i FROM d WHERE len(w) > 0)),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY 1),
p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS i FROM s a JOIN s b ON a.g = b.g AND a.doc_id <> b.doc_id GROUP BY ALL),
l AS (SELECT a, b FROM p JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * i >= 85 * (x.n + y.n - i)),
r AS (SELECT doc_id AS a, doc_id AS b FROM d UNION SELECT r.a, l.b FROM r JOIN l ON r.b = l.a),
c AS (SELECT a AS doc_id, min(b) AS component_id FROM r GROUP BY 1)
SELECT doc_id, coalesce(n, 0) AS n_shingles, component_id, doc_id = component_id AS kept FROM d JOIN c USING (doc_id) LEFT JOIN n USING (doc_id)"""

OP11 = rf"""
WITH d AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '{SPACED}') AS w, {CRC32.format("doc_id")} AS h FROM documents),
a AS (SELECT doc_id, w, len(w) AS n, h % 10 = 0 AND len(w) > 0 AS edited, (h // 10) % len(w) AS a, 3 + (h // 10) % 8 AS k FROM d),
p AS (SELECT doc_id, CASE WHEN edited THEN list_transform(range(n), lambda i: CASE WHEN i < a THEN w[i + 1] ELSE w[a + (i - a) % (1 + (n - a) // k) + 1] END) ELSE w END AS w FROM a),
u AS (SELECT doc_id, len(w) AS n, unnest(w) AS t, generate_subscripts(w, 1) - 1 AS i FROM p),
m AS (SELECT x.doc_id, y.i - x.i AS q, x.i FROM u x JOIN u y ON x.doc_id = y.doc_id AND x.t = y.t AND y.i > x.i AND 4 * (y.i - x.i) <= x.n),
g AS (SELECT *, i - row_number() OVER (PARTITION BY doc_id, q ORDER BY i) AS island FROM m),
s AS (SELECT doc_id, q, min(i) AS s, max(i) + 1 + q AS e FROM g GROUP BY doc_id, q, island HAVING count(*) >= greatest(6, 4 * q) - q),
r AS (SELECT doc_id, s, e - s AS n, min(q) AS q FROM s GROUP BY ALL),
x AS (SELECT DISTINCT doc_id, unnest(range(s + q, s + n)) AS i FROM r),
k AS (SELECT doc_id, string_agg(t, ' ' ORDER BY i) AS kept FROM u ANTI JOIN x USING (doc_id, i) GROUP BY 1),
b AS (SELECT doc_id, count(*) AS n_runs, string_agg(s || ',' || n || ',' || q || chr(10), '' ORDER BY s, q) AS runs, min({{'a': -n, 'b': s, 'c': q}}) AS top FROM r GROUP BY 1)
SELECT doc_id, coalesce(n_runs, 0) AS n_runs, CAST(top.b AS BIGINT) AS start, CAST(-top.a AS BIGINT) AS length, CAST(top.c AS BIGINT) AS period, CAST(1000 * -top.a // top.c AS BIGINT) AS exponent_milli, sha256(coalesce(runs, '')) AS runs_sha256, sha256(coalesce(kept, '')) AS collapsed_sha256
FROM d LEFT JOIN b USING (doc_id) LEFT JOIN k USING (doc_id)"""

TERM = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"

OP12 = rf"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all({ASCII_LOWER}, '{TERM}') AS w FROM documents),
c AS (SELECT count(*) AS n, sum(len(w)) AS l FROM d WHERE len(w) > 0),
t AS (SELECT r, any_value(doc_id) AS doc_id, term, count(*) AS tf, any_value(n) AS n FROM (SELECT r, doc_id, len(w) AS n, unnest(w) AS term FROM d) GROUP BY r, term),
q AS (SELECT DISTINCT item_id, unnest(regexp_extract_all({ASCII_LOWER}, '{TERM}')) AS term FROM benchmark),
f AS (SELECT term, CAST(floor(1000 * ln(CAST(2 * c.n + 2 AS DOUBLE) / (2 * count(*) + 1))) AS BIGINT) AS weight FROM t, c GROUP BY term, c.n),
s AS (SELECT item_id, r, any_value(doc_id) AS doc_id, CAST(sum(weight * ((1000000000 * tf) // (1000 * tf + 20 * (50 + CAST((50 * t.n * c.n) // c.l AS BIGINT))))) AS BIGINT) AS score FROM q JOIN t USING (term) JOIN f USING (term), c GROUP BY item_id, r)
SELECT item_id, CAST(row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS INTEGER) AS rank, doc_id, score FROM s WHERE score > 0 QUALIFY rank <= 50"""

MIX_TARGETS = rf"""
WITH s AS (SELECT source, CAST(sum(len(regexp_extract_all(coalesce(text, ''), '{SPACED}'))) AS BIGINT) AS n FROM documents GROUP BY 1),
w AS (SELECT source, n AS source_size, 3 * n AS most, CAST((row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1 AS BIGINT) AS weight FROM s),
c AS (SELECT *, row_number() OVER o AS k, sum(source_size) OVER () - coalesce(sum(most) OVER (o ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS words, sum(weight) OVER (o ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS free FROM w WINDOW o AS (ORDER BY most / weight, source)),
l AS (SELECT arg_min(CAST(words AS DOUBLE) / free, k) AS share FROM c WHERE CAST(words AS DOUBLE) / free * weight <= most)
SELECT source, source_size, weight, round(least(weight * share, most), 3) AS target, CAST(round(least(weight * share, most)) AS BIGINT) AS taken FROM w, l"""

"""DuckDB SQL of the queries whose results SQL can express."""

from __future__ import annotations

_REACH = """
ways AS (SELECT a, b FROM links UNION ALL SELECT b, a FROM links),
reach(a, b) AS (SELECT a, b FROM ways UNION SELECT r.a, l.b FROM reach r JOIN ways l ON r.b = l.a),
comp AS (SELECT a, min(b) AS least FROM reach GROUP BY a)"""

OP1 = rf"""
WITH RECURSIVE words AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
sets AS (
  SELECT doc_id, CASE WHEN len(w) >= 5 THEN list_distinct(list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' ')))
    WHEN len(w) > 0 THEN [array_to_string(w, ' ')] ELSE [] END AS s FROM words),
each AS (SELECT doc_id, len(s) AS n, unnest(s) AS g FROM sets),
shared AS (SELECT x.doc_id AS a, y.doc_id AS b, x.n AS na, y.n AS nb, count(*) AS k FROM each x JOIN each y ON x.g = y.g AND x.doc_id < y.doc_id GROUP BY ALL),
links AS (SELECT a, b FROM shared WHERE 100 * k >= 75 * (na + nb - k)), {_REACH}
SELECT doc_id, CAST(len(s) AS BIGINT) AS n_shingles, coalesce(least(doc_id, least), doc_id) AS component_id FROM sets LEFT JOIN comp ON a = doc_id
"""

OP3 = f"""
WITH RECURSIVE v AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS e FROM embeddings),
u AS (SELECT vec_id, e, sqrt(list_inner_product(e, e)) AS norm FROM v),
links AS (SELECT x.vec_id AS a, y.vec_id AS b FROM u x JOIN u y ON x.vec_id < y.vec_id WHERE list_inner_product(x.e, y.e) >= 0.9::DOUBLE * x.norm * y.norm), {_REACH},
degree AS (SELECT a AS d, count(*) AS n FROM ways GROUP BY a)
SELECT vec_id, coalesce(n, 0) AS n_links, coalesce(least(vec_id, least), vec_id) AS component_id, coalesce(least, vec_id) >= vec_id AS kept
FROM u LEFT JOIN comp ON a = vec_id LEFT JOIN degree ON d = vec_id
"""

OP8 = r"""
WITH t AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -1, i, r, '<|im_end|><|im_start|>assistant ok' FROM (VALUES (0, 'user'), (1, 'assistant')) v(i, r)),
f AS (SELECT *, '<|im_start|>' || replace(regexp_replace(role, '<(\\*)\|', '<\\\1|', 'g'), chr(10), '<|break|>') || chr(10) || regexp_replace(text, '<(\\*)\|', '<\\\1|', 'g') || '<|im_end|>' || chr(10) AS piece FROM t)
SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, piece)) AS turns_sha256,
  CAST(coalesce(sum(length(text)) FILTER (role = 'assistant'), 0) AS BIGINT) AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn NULLS FIRST, piece) FILTER (role = 'assistant'), '')) AS loss_sha256, CAST(sum(length(piece)) AS BIGINT) AS formatted_chars
FROM f GROUP BY conv_id
"""

_ESCAPED = r"length(regexp_replace({}, '<(\\*)\|', '<\\\1|', 'g'))"

ATTACHMENTS = rf"""
WITH t AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations),
p AS (
  SELECT conv_id, turn, length('<|im_start|>') + length(replace(regexp_replace(role, '<(\\*)\|', '<\\\1|', 'g'), chr(10), '<|break|>')) + 1 + {_ESCAPED.format("text[1:length(text) // 2]")} AS first, {_ESCAPED.format("text[length(text) // 2 + 1:]")} AS rest FROM t),
a AS (
  SELECT conv_id, turn, 'image' AS kind, 'i' AS r, first AS place, (turn % 4 + 1) * 2 AS tokens FROM p
  UNION ALL SELECT conv_id, turn, 'audio', 'a', first + 9 + rest, 25 * (turn % 5 + 1) FROM p WHERE turn % 3 = 0
  UNION ALL SELECT conv_id, turn, 'document', 'd', first + 9 + rest, 256 * (turn % 2 + 1) FROM p WHERE turn % 3 = 1
  UNION ALL SELECT conv_id, turn, 'image', 'n', first + 9 + rest + 15, 1 FROM p WHERE turn % 3 = 1)
SELECT conv_id, count(*) AS n_attachments, count(*) FILTER (kind = 'image') AS n_images, CAST(sum(tokens) AS BIGINT) AS expanded_tokens,
  CAST(sum(CAST('0x' || md5(turn || ':' || kind || ':' || r || '-' || conv_id || '-' || turn || ':' || place || ':' || tokens)[1:8] AS BIGINT)) AS BIGINT) AS attachments_sum FROM a GROUP BY conv_id
"""

_WORDS = r"regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')"
_COVER = "max(CASE WHEN dup THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id, n ORDER BY i ROWS BETWEEN {} PRECEDING AND CURRENT ROW)"

OP5 = rf"""
WITH texts AS (SELECT doc_id, coalesce(text, '') AS text, {_WORDS} AS w FROM documents),
each AS (
  SELECT doc_id, n, unnest(list_transform(range(1, len(w) + 1), lambda i: CASE WHEN i <= len(w) - n + 1 THEN array_to_string(w[i:i + n - 1], ' ') END)) AS g,
    unnest(w) AS x, unnest(range(1, len(w) + 1)) AS i FROM texts CROSS JOIN (VALUES (5), (8), (12)) v(n)),
flagged AS (SELECT *, g IS NOT NULL AND count(*) OVER (PARTITION BY doc_id, n, g) > 1 AS dup FROM each),
covered AS (SELECT doc_id, n, length(x) AS c, CASE n WHEN 5 THEN {_COVER.format(4)} WHEN 8 THEN {_COVER.format(7)} ELSE {_COVER.format(11)} END = 1 AS hit FROM flagged),
grams AS (
  SELECT doc_id, count(*) FILTER (n = 8) AS n_words, CAST(coalesce(sum(c) FILTER (n = 8), 0) AS BIGINT) AS word_chars, count(*) FILTER (n = 8 AND hit) AS n_repeat_words,
    CAST(coalesce(sum(c) FILTER (n = 5 AND hit), 0) AS BIGINT) AS g5, CAST(coalesce(sum(c) FILTER (n = 8 AND hit), 0) AS BIGINT) AS g8, CAST(coalesce(sum(c) FILTER (n = 12 AND hit), 0) AS BIGINT) AS g12
  FROM covered GROUP BY doc_id),
cut AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS i FROM texts),
lines AS (
  SELECT doc_id, count(*) AS n, CAST(sum(length(line)) AS BIGINT) AS c FROM (SELECT *, row_number() OVER (PARTITION BY doc_id, line ORDER BY i) AS r FROM cut)
  WHERE r > 1 AND regexp_matches(line, '[^\x20\x09-\x0D]') GROUP BY doc_id),
all_ AS (
  SELECT t.doc_id, coalesce(n_words, 0) AS n_words, coalesce(word_chars, 0) AS word_chars, length(text) - length(regexp_replace(text, '[#*$%&|<>]', '', 'g')) AS n_symbols, coalesce(lines.n, 0) AS n_dup_lines,
    coalesce(n_repeat_words, 0) AS n_repeat_words, coalesce(lines.c, 0) AS dup_line_chars, coalesce(g5, 0) AS gram_chars_5, coalesce(g8, 0) AS gram_chars_8, coalesce(g12, 0) AS gram_chars_12, length(text) AS size
  FROM texts t LEFT JOIN grams USING (doc_id) LEFT JOIN lines USING (doc_id)),
judged AS (SELECT *, n_words < 20 OR 100 * n_repeat_words > 30 * n_words AS base_failed FROM all_)
SELECT * EXCLUDE (size), NOT base_failed AND dup_line_chars <= 0.30::DOUBLE * size AND gram_chars_5 <= 0.45::DOUBLE * word_chars AND gram_chars_8 <= 0.35::DOUBLE * word_chars AND gram_chars_12 <= 0.30::DOUBLE * word_chars AS kept FROM judged
"""

OP7 = rf"""
WITH docs AS (SELECT doc_id, source, len({_WORDS}) AS size FROM documents),
hashed AS (SELECT *, md5('7:' || coalesce(CAST(doc_id AS VARCHAR), '') || ':' || size) AS h FROM docs),
sums AS (SELECT source, CAST(sum(size) AS BIGINT) AS s, count(*) AS many FROM docs GROUP BY source),
weighed AS (SELECT *, (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1 AS w FROM sums),
-- in the order in which sources reach their limit, those before k are at it if the level of the rest lifts them
ordered AS (SELECT *, row_number() OVER (ORDER BY s::DOUBLE / w, source NULLS LAST) AS k FROM weighed),
levels AS (SELECT k, sum(s) OVER () - coalesce(3 * sum(s) OVER before, 0) AS num, sum(w) OVER () - coalesce(sum(w) OVER before, 0) AS den, s, w FROM ordered WINDOW before AS (ORDER BY k ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
level AS (SELECT CAST(num AS BIGINT) AS num, CAST(den AS BIGINT) AS den, k FROM levels WHERE num * w <= 3 * s * den ORDER BY k LIMIT 1),
goal AS (
  SELECT o.source, o.s, o.many, CASE WHEN o.k < l.k THEN 3.0 * o.s ELSE (l.num * o.w)::DOUBLE / l.den::DOUBLE END::DOUBLE AS target,
    CASE WHEN o.k < l.k THEN 3 * o.s ELSE (2 * l.num * o.w + l.den) // (2 * l.den) END AS want FROM ordered o CROSS JOIN level l),
line AS (
  SELECT doc_id, size, s AS source_size, target, want,
    coalesce(sum(size) OVER (PARTITION BY d.source ORDER BY ('0x' || h[1:8])::BIGINT % CAST(ceil(many / 4096.0) AS BIGINT), h, doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS start
  FROM hashed d JOIN goal g ON d.source IS NOT DISTINCT FROM g.source)
SELECT doc_id, size, source_size, target, CAST(CASE WHEN size = 0 THEN 0 ELSE (want // source_size) * size + greatest(0, least(size, want % source_size - start)) END AS BIGINT) AS taken FROM line
"""

#: CRC-32, byte by byte, with the table of the polynomial 0xEDB88320.
_CRC_TABLE = "table_of AS (SELECT list_transform(range(256), lambda i: list_reduce(list_prepend(i, range(8)), lambda c, k: CASE WHEN c % 2 = 1 THEN xor(c // 2, 3988292384) ELSE c // 2 END)) AS t)"
_CRC = "xor(4294967295, list_reduce(list_prepend(4294967295, list_transform(range(strlen({x})), lambda k: CAST('0x' || hex(encode({x}))[2 * k + 1:2 * k + 2] AS BIGINT))), lambda c, b: xor(t[(xor(c, b) & 255) + 1], c >> 8)))"

OP11 = rf"""
WITH {_CRC_TABLE},
lowered AS (SELECT 's' AS corpus, doc_id AS id, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS x FROM documents UNION ALL SELECT 't', item_id, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') FROM benchmark),
texts AS (SELECT corpus, id, regexp_extract_all(x, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM lowered),
each AS (SELECT corpus, id, unnest(list_concat(w, list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1]))) AS f FROM texts),
feats AS (SELECT f, any_value(t) AS t FROM (SELECT DISTINCT f FROM each) CROSS JOIN table_of GROUP BY f),
bucketed AS (SELECT f, {_CRC.format(x="f")} % 10000 AS bucket FROM feats),
posted AS (SELECT corpus, id, bucket, count(*) AS n FROM each JOIN bucketed USING (f) GROUP BY ALL),
held AS (SELECT bucket, CAST(coalesce(sum(n) FILTER (corpus = 's'), 0) AS DOUBLE) AS s, CAST(coalesce(sum(n) FILTER (corpus = 't'), 0) AS DOUBLE) AS t FROM posted GROUP BY bucket),
gains AS (SELECT bucket, CAST(floor(1000 * ln((t + 1) * (sum(s) OVER () + 10000) / ((s + 1) * (sum(t) OVER () + 10000)))) AS BIGINT) AS gain FROM held),
weights AS (SELECT id, CAST(floor(sum(n * gain)::DOUBLE / sum(n)) AS BIGINT) AS weight FROM posted JOIN gains USING (bucket) WHERE corpus = 's' GROUP BY id),
scored AS (
  SELECT id AS doc_id, len(w) AS words, CAST(greatest(2 * len(w) - 1, 0) AS BIGINT) AS n_features, coalesce(weight, 0) AS weight,
    coalesce(weight, 0) + CAST(floor(-1000 * ln(-ln((CAST('0x' || sha256('7:' || id)[1:8] AS BIGINT) + 0.5::DOUBLE) / 4294967296))) AS BIGINT) AS score FROM texts LEFT JOIN weights USING (id) WHERE corpus = 's'),
ranked AS (SELECT *, row_number() OVER (PARTITION BY words >= 20 ORDER BY score DESC, doc_id) AS r, count(*) FILTER (words >= 20) OVER () AS able FROM scored)
SELECT doc_id, n_features, weight, score, CASE WHEN words >= 20 AND r <= 25 * able // 100 THEN r END AS rank FROM ranked
"""

OP12 = rf"""
WITH {_CRC_TABLE},
lists AS (SELECT doc_id, coalesce(CAST(doc_id AS VARCHAR), '') AS name, list_append(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+'), ' end') AS w FROM documents),
parted AS (SELECT doc_id, w, {_CRC.format(x="name")} % 7 = 2 AS held_out FROM lists CROSS JOIN table_of),
each AS (SELECT doc_id, held_out, unnest(w) AS x FROM parted),
counts AS (SELECT x, count(*) AS c FROM each WHERE NOT held_out GROUP BY x),
sizes AS (SELECT coalesce(CAST(sum(c) AS BIGINT), 0) AS n, count(*) AS v FROM counts)
SELECT doc_id, held_out, count(*) AS n_tokens, count(c) AS n_known, n AS train_tokens, sum(CAST(round(log10((coalesce(c, 0) + 1)::DOUBLE / (n + v + 1)) * 10000000000) AS BIGINT))::DOUBLE / 10000000000 AS base_score
FROM each LEFT JOIN counts USING (x) CROSS JOIN sizes GROUP BY doc_id, held_out, n
"""

OP13 = r"""
WITH units AS (
  SELECT doc_id, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+') AS u, sha256('42:' || coalesce(CAST(doc_id AS VARCHAR), '')) AS d FROM documents),
drawn AS (SELECT *, CAST(len(u) AS BIGINT) AS n, list_transform(range(4), lambda k: CAST('0x' || d[8 * k + 1:8 * k + 8] AS BIGINT)) AS h FROM units),
ranked AS (
  SELECT *, least(h[1] % (n + 1), h[2] % (n + 1)) AS a, greatest(h[1] % (n + 1), h[2] % (n + 1)) AS b,
    CASE WHEN text = '' OR contains(text, '<P>') OR contains(text, '<S>') OR contains(text, '<M>') OR h[3] % 100 >= 50 THEN 'plain' WHEN h[4] % 100 < 80 THEN 'spm' ELSE 'psm' END AS form FROM drawn),
cut AS (SELECT *, array_to_string(u[:a], '') AS p, array_to_string(u[a + 1:b], '') AS m, array_to_string(u[b + 1:], '') AS s FROM ranked)
SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN length(p) END AS prefix_chars, CASE WHEN form <> 'plain' THEN length(m) END AS middle_chars,
  sha256(CASE form WHEN 'plain' THEN text WHEN 'psm' THEN '<P>' || p || '<S>' || s || '<M>' || m ELSE '<S>' || s || '<P>' || p || '<M>' || m END) AS output_sha256, sha256(text) AS restored_sha256
FROM cut
"""

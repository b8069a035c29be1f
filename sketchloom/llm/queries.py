"""The queries of this subpackage, and their SQL where SQL can express them."""

from __future__ import annotations

from sketchloom.llm import additive_quantisation, byte_bpe, byte_cnn, conversation_repair, fingerprints, grammar_tokens, label_propagation, lsh_forest, mixing, periodic_runs, sentencepiece_codec, substring_dedup, toxic_passages

QUERIES = {
    "op1_grammar_tokens": grammar_tokens.op1_grammar_tokens,
    "op2_toxic_passages": toxic_passages.op2_toxic_passages,
    "op3_substring_dedup": substring_dedup.op3_substring_dedup,
    "op4_label_propagation": label_propagation.op4_label_propagation,
    "op5_mixing": mixing.op5_mixing,
    "op6_byte_cnn": byte_cnn.op6_byte_cnn,
    "op7_lsh_forest": lsh_forest.op7_lsh_forest,
    "op8_fingerprints": fingerprints.op8_fingerprints,
    "op9_sentencepiece": sentencepiece_codec.op9_sentencepiece,
    "op10_additive_quantisation": additive_quantisation.op10_additive_quantisation,
    "op11_periodic_runs": periodic_runs.op11_periodic_runs,
    "op12_conversation_repair": conversation_repair.op12_conversation_repair,
    "op13_byte_bpe": byte_bpe.op13_byte_bpe,
}

WORDS = r"regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')"

#: crc32 of a short string of ASCII characters, bit by bit.
CRC = ("xor(list_reduce(list_transform(range(1, length({x}) + 1), lambda i: CAST(ascii(substr({x}, CAST(i AS INT), 1)) AS BIGINT)), "
       "lambda c, b: list_reduce(range(0, 8), lambda x, k: xor(x >> 1, (x & 1) * 3988292384), xor(c, b)), CAST(4294967295 AS BIGINT)), 4294967295)")

ORACLES = {
    "op12_conversation_repair": rf"""
WITH RECURSIVE k AS (SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text, coalesce(CAST(conv_id AS VARCHAR), ' ') || ':' || coalesce(CAST(turn AS VARCHAR), ' ') AS key FROM conversations),
f AS (SELECT *, {CRC.format(x='key')} % 20 AS x FROM k),
g AS (SELECT conv_id, turn, CASE WHEN x = 4 THEN 'user' ELSE role END AS role, CASE WHEN x = 1 THEN '' WHEN x = 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text,
      unnest(CASE WHEN x = 3 THEN [0, 1] ELSE [0] END) AS copy FROM f WHERE x <> 0),
o AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, sha256(text)) - 1 AS i FROM g),
h AS (SELECT *, NOT regexp_matches(text, '[^ 	-]') AS blank, row_number() OVER (PARTITION BY conv_id, role, text ORDER BY i) > 1 AS seen,
      regexp_extract(text, '([^ 	-])[ 	-]*$', 1) NOT IN ('.', '!', '?') AS late FROM o),
r AS (SELECT conv_id, turn, i, role, text, left(role, 1) AS u, blank, seen AND NOT blank AS duplicate, late AND NOT seen AND NOT blank AS truncated, blank OR seen AS gone FROM h),
ins(s, m, c, l, t) AS (VALUES (0, 0, 0, '', ''), (0, 2, 2, 'I', chr(10) || 'user:'), (0, 3, 4, 'II', chr(10) || 'user:' || chr(10) || 'assistant:'), (1, 1, 0, '', ''), (1, 2, 2, 'I', chr(10) || 'user:'),
      (1, 3, 4, 'II', chr(10) || 'user:' || chr(10) || 'assistant:'), (2, 2, 0, '', ''), (2, 3, 2, 'I', chr(10) || 'assistant:'), (3, 3, 0, '', ''), (3, 2, 2, 'I', chr(10) || 'user:')),
fit(u, m, t) AS (VALUES ('s', 0, 1), ('u', 0, 2), ('u', 1, 2), ('u', 3, 2), ('a', 2, 3)),
arc AS (SELECT conv_id, i, m, m AS t, 3 AS c, 'D' AS l, '' AS line FROM r, (VALUES (0), (1), (2), (3)) v(m)
  UNION ALL SELECT conv_id, i, m, t, CASE WHEN truncated THEN 1 ELSE 0 END, 'K', chr(10) || role || ':' || text FROM r JOIN fit ON fit.u = r.u WHERE NOT gone
  UNION ALL SELECT conv_id, i, m, t, CASE WHEN truncated THEN 3 ELSE 2 END, 'R', chr(10) || n || ':' || text FROM r, (VALUES ('user'), ('assistant')) w(n) JOIN fit ON fit.u = left(n, 1) WHERE NOT gone),
step AS (SELECT a.conv_id, a.i, ins.s, a.t, ins.c + a.c AS c, ins.l || a.l AS l, ins.t || a.line AS line FROM arc a JOIN ins ON ins.m = a.m),
conv AS (SELECT conv_id, count(*) AS n FROM r GROUP BY conv_id),
walk(conv_id, i, s, b, line) AS (
  SELECT conv_id, CAST(0 AS BIGINT), 0, {{'c': 0, 'l': ''}}, '' FROM conv
  UNION ALL
  SELECT w.conv_id, w.i + 1, p.t, min({{'c': w.b.c + p.c, 'l': w.b.l || p.l}}), arg_min(w.line || p.line, {{'c': w.b.c + p.c, 'l': w.b.l || p.l}})
  FROM walk w JOIN step p ON p.conv_id IS NOT DISTINCT FROM w.conv_id AND p.i = w.i AND p.s = w.s GROUP BY w.conv_id, w.i, p.t),
last AS (SELECT w.conv_id, min({{'c': w.b.c + ins.c, 'l': w.b.l || ins.l}}) AS b, arg_min(w.line || ins.t, {{'c': w.b.c + ins.c, 'l': w.b.l || ins.l}}) AS line
  FROM walk w JOIN conv ON conv.conv_id IS NOT DISTINCT FROM w.conv_id AND conv.n = w.i JOIN ins ON ins.s = w.s AND ins.m IN (0, 3) GROUP BY w.conv_id),
pairs AS (SELECT conv_id, u || lead(u) OVER (PARTITION BY conv_id ORDER BY i) AS p FROM r),
bad AS (SELECT conv_id, count(*) FILTER (WHERE p NOT IN ('su', 'ua', 'au')) AS illegal FROM pairs GROUP BY conv_id),
sums AS (SELECT conv_id, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (WHERE blank) AS blank, count(*) FILTER (WHERE duplicate) AS duplicate, count(*) FILTER (WHERE truncated) AS truncated FROM r GROUP BY conv_id)
SELECT c.conv_id, coalesce(gaps, 0) AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate, coalesce(truncated, 0) AS truncated, coalesce(illegal, 0) AS illegal,
       CAST(coalesce(last.b.c, 0) AS BIGINT) AS cost, coalesce(last.b.l, '') AS audit, sha256(coalesce(substr(last.line, 2), '')) AS repaired_sha256
FROM (SELECT DISTINCT conv_id FROM conversations) c LEFT JOIN sums ON sums.conv_id IS NOT DISTINCT FROM c.conv_id LEFT JOIN bad ON bad.conv_id IS NOT DISTINCT FROM c.conv_id LEFT JOIN last ON last.conv_id IS NOT DISTINCT FROM c.conv_id""",
    "op3_substring_dedup": rf"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, {WORDS} AS ws FROM documents),
s AS (SELECT r, i, array_to_string(ws[i:i + 34], ' ') AS k
      FROM (SELECT r, ws, unnest(range(1, len(ws) - 33)) AS i FROM d WHERE len(ws) >= 35)),
t AS (SELECT r, i, count(*) OVER (PARTITION BY k) > 1 AS rep FROM s),
p AS (SELECT r, unnest(ws) AS w, unnest(range(1, len(ws) + 1)) AS i FROM d),
g AS (SELECT p.r, p.i, p.w,
             coalesce(max(CASE WHEN t.rep THEN 1 ELSE 0 END)
                      OVER (PARTITION BY p.r ORDER BY p.i ROWS BETWEEN 34 PRECEDING AND CURRENT ROW), 0) AS gone
      FROM p LEFT JOIN t ON p.r = t.r AND p.i = t.i),
a AS (SELECT r, sum(gone) AS n, coalesce(string_agg(w, ' ' ORDER BY i) FILTER (WHERE gone = 0), '') AS kept
      FROM g GROUP BY r)
SELECT d.doc_id, CAST(len(d.ws) AS BIGINT) AS n_words, CAST(coalesce(a.n, 0) AS BIGINT) AS n_removed,
       sha256(coalesce(a.kept, '')) AS kept_sha256
FROM d LEFT JOIN a ON d.r = a.r""",
    "op7_lsh_forest": rf"""
WITH RECURSIVE d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS ws FROM documents),
s AS (SELECT DISTINCT doc_id, CASE WHEN len(ws) = 1 THEN ws[1] ELSE ws[i] || ' ' || ws[i + 1] END AS sh
      FROM (SELECT doc_id, ws, unnest(range(1, greatest(len(ws), least(len(ws), 1) + 1))) AS i FROM d)),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
c AS (SELECT a.doc_id AS i, b.doc_id AS j, count(*) AS c FROM s a JOIN s b ON a.sh = b.sh AND a.doc_id < b.doc_id GROUP BY 1, 2),
l AS (SELECT i, j FROM c JOIN n x ON x.doc_id = i JOIN n y ON y.doc_id = j WHERE 100 * c >= 80 * (x.n + y.n - c)),
e AS (SELECT i, j FROM l UNION ALL SELECT j, i FROM l),
r(doc, root) AS (SELECT DISTINCT i, i FROM e UNION SELECT e.j, r.root FROM r JOIN e ON e.i = r.doc)
SELECT d.doc_id, coalesce(n.n, 0) AS n_shingles, coalesce(m.root, d.doc_id) AS component_id, d.doc_id = coalesce(m.root, d.doc_id) AS kept
FROM d LEFT JOIN n ON n.doc_id = d.doc_id LEFT JOIN (SELECT doc, min(root) AS root FROM r GROUP BY doc) m ON m.doc = d.doc_id""",
}

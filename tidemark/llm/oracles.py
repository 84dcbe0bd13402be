"""DuckDB SQL for the text queries that SQL can express."""

OP3 = """
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, hex(encode(coalesce(text, ''))) AS hx FROM documents),
g0 AS (SELECT rid, length(hx) // 2 AS n, 400 * j AS a, substr(hx, 800 * j + 1, 1600) AS part
       FROM (SELECT rid, hx, unnest(range((length(hx) // 2 - 400) // 400 + 1)) AS j FROM d WHERE length(hx) >= 800)),
w AS (SELECT rid, a + o AS p, md5_number(substr(part, 2 * o + 1, 800)) AS w
      FROM (SELECT rid, a, part, unnest(range(least(400, n - 399 - a))) AS o FROM g0)),
m AS (SELECT rid, p FROM w WHERE w IN (SELECT w FROM w GROUP BY w HAVING count(*) > 1)),
g AS (SELECT rid, p, sum(new) OVER (PARTITION BY rid ORDER BY p) AS island
      FROM (SELECT rid, p, CASE WHEN p <= lag(p) OVER (PARTITION BY rid ORDER BY p) + 400 THEN 0 ELSE 1 END AS new FROM m)),
s AS (SELECT rid, min(p) AS s, max(p) + 400 AS e FROM g GROUP BY rid, island),
c AS (SELECT rid, s, e, list_filter([0, 1, 2, 3], lambda x: substr(hx, 2 * (s - x) + 1, 1) NOT IN ('8', '9', 'A', 'B'))[1] AS before_s,
             list_filter([0, 1, 2, 3], lambda x: substr(hx, 2 * (e + x) + 1, 1) NOT IN ('8', '9', 'A', 'B'))[1] AS after_e FROM s JOIN d USING (rid)),
k AS (SELECT rid, s, e, coalesce(lag(e) OVER (PARTITION BY rid ORDER BY s), 0) AS before, s - before_s AS cs, e + after_e AS ce,
             coalesce(lag(e + after_e) OVER (PARTITION BY rid ORDER BY s), 0) AS cbefore FROM c),
j AS (SELECT d.rid, string_agg(substr(hx, 2 * before + 1, 2 * (s - before)), '' ORDER BY s) AS head, max(e) AS last,
             string_agg(substr(hx, 2 * cbefore + 1, greatest(0, 2 * (cs - cbefore))), '' ORDER BY s) AS chead, max(ce) AS clast,
             sum(e - s) AS gone, count(*) AS n FROM k JOIN d USING (rid) GROUP BY d.rid)
SELECT doc_id, CAST(length(hx) // 2 AS BIGINT) AS n_bytes, CAST(coalesce(gone, 0) AS BIGINT) AS n_removed,
       CAST(coalesce(n, 0) AS BIGINT) AS n_spans,
       sha256(unhex(coalesce(head, '') || substr(hx, 2 * coalesce(last, 0) + 1))) AS kept_sha256,
       decode(unhex(coalesce(chead, '') || substr(hx, 2 * coalesce(clast, 0) + 1))) AS text
FROM d LEFT JOIN j USING (rid)
"""

_WORDS = "list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\\x20\\x09-\\x0D]+'), lambda w: w <> '')"
_SHINGLES = "CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 5 THEN [array_to_string(w, ' ')] ELSE list_distinct(list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i+4], ' '))) END"

OP2 = f"""
WITH i AS (SELECT item_id, text, len(s) AS q, unnest(s) AS s FROM (SELECT item_id, text, {_SHINGLES} AS s FROM (SELECT DISTINCT item_id, text, {_WORDS} AS w FROM benchmark))),
d AS (SELECT doc_id, text, unnest({_SHINGLES}) AS s FROM (SELECT DISTINCT doc_id, text, {_WORDS} AS w FROM documents))
SELECT doc_id, item_id, CAST(q AS BIGINT) AS n_item, count(*) AS n_shared, count(*) / q AS containment
FROM d JOIN i USING (s) GROUP BY doc_id, d.text, item_id, i.text, q HAVING count(*) * 100 >= q * 80
"""

OP6 = """
WITH c AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
           UNION ALL SELECT -1, 0, 'user', '<|im_end|><|im_start|>assistant ok'
           UNION ALL SELECT -1, 1, 'assistant', '<|im_end|><|im_start|>assistant ok')
SELECT conv_id, count(*) AS n_turns,
       sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
       CAST(coalesce(sum(length(text)) FILTER (role = 'assistant'), 0) AS BIGINT) AS loss_chars,
       sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
       CAST(sum(24 + length(replace(replace(replace(role, '\\', '\\\\'), '<|', '<\\|'), chr(10), '\\n'))
                + length(replace(replace(text, '\\', '\\\\'), '<|', '<\\|'))) AS BIGINT) AS formatted_chars
FROM c GROUP BY conv_id
"""

OP9 = """
WITH p AS (SELECT page_id, encode(coalesce(html, '')) AS body FROM pages),
h AS (SELECT page_id, octet_length(body) AS n, sha1(body) AS x FROM p),
b AS (SELECT *, array_to_string(list_transform(range(1, 41), lambda i: lpad(bin(instr('123456789abcdef', x[i])), 4, '0')), '') AS bits FROM h),
d AS (SELECT page_id, n, array_to_string(list_transform(range(32), lambda i: 'ABCDEFGHIJKLMNOPQRSTUVWXYZ234567'[CAST(
        1 + list_sum(list_transform(range(5), lambda k: CAST(bits[i * 5 + k + 1] AS INT) * (1 << (4 - k)))) AS BIGINT)]), '') AS digest FROM b)
SELECT page_id, CAST(n AS BIGINT) AS payload_bytes, digest AS payload_digest,
       CASE WHEN page_id = first THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN page_id <> first THEN first END AS refers_to
FROM (SELECT *, min(page_id) OVER (PARTITION BY digest) AS first FROM d)
"""

_FIELD = "coalesce(CAST(octet_length(encode(CAST({0} AS VARCHAR))) AS VARCHAR) || ':' || CAST({0} AS VARCHAR), '-')"
_LEAF = "sha256(" + " || ".join(_FIELD.format(c) for c in ("doc_id", "source", "lang", "{n}", "text")) + ")"
_CRC = """xor(4294967295, list_reduce(list_prepend(CAST(4294967295 AS BIGINT), list_transform(string_split(CAST(doc_id AS VARCHAR), ''), lambda c: CAST(ascii(c) AS BIGINT))),
       lambda a, b: list_reduce(list_prepend(xor(a, b), range(8)), lambda c, k: xor(c >> 1, (c & 1) * 3988292384))))"""
_UP = "list_transform(range((len(hs) + 1) // 2), lambda i: sha256(hs[2 * i + 1] || coalesce(hs[2 * i + 2], '')))"

OP11 = f"""
WITH RECURSIVE d AS (
  SELECT doc_id, lang, leaf, CASE WHEN crc % 7 = 0 THEN bad ELSE leaf END AS seen, row_number() OVER (PARTITION BY lang ORDER BY doc_id NULLS FIRST, leaf) - 1 AS r
  FROM (SELECT doc_id, lang, {_LEAF.format(n="n_chars")} AS leaf, {_LEAF.format(n="(n_chars + 1)")} AS bad, {_CRC} AS crc FROM documents)),
t(lang, lvl, hs) AS (
  SELECT lang, 0, list(leaf ORDER BY r) FROM d GROUP BY lang
  UNION ALL SELECT lang, lvl + 1, {_UP} FROM t WHERE len(hs) > 1),
s AS (SELECT lang, hs[1] AS subroot, row_number() OVER (ORDER BY encode(lang) NULLS FIRST) - 1 AS q FROM t WHERE len(hs) = 1),
u(lvl, hs) AS (
  SELECT 0, list(subroot ORDER BY q) FROM s
  UNION ALL SELECT lvl + 1, {_UP} FROM u WHERE len(hs) > 1),
p AS (
  SELECT lang, r, list(mark ORDER BY lvl) AS marks FROM (
    SELECT d.lang, r, lvl, CASE WHEN (r >> lvl) & 1 = 1 THEN 'L' ELSE 'R' END || coalesce(hs[CAST(xor(r >> lvl, 1) AS BIGINT) + 1], '') AS mark
    FROM d JOIN t ON t.lang IS NOT DISTINCT FROM d.lang AND len(hs) > 1) GROUP BY lang, r),
v AS (
  SELECT lang, list(mark ORDER BY lvl) AS marks FROM (
    SELECT lang, lvl, CASE WHEN (q >> lvl) & 1 = 1 THEN 'L' ELSE 'R' END || coalesce(hs[CAST(xor(q >> lvl, 1) AS BIGINT) + 1], '') AS mark FROM s, u WHERE len(hs) > 1) GROUP BY lang),
j AS (
  SELECT d.*, subroot, (SELECT hs[1] FROM u WHERE len(hs) = 1) AS root, list_concat(coalesce(p.marks, []), coalesce(v.marks, [])) AS marks
  FROM d JOIN s ON s.lang IS NOT DISTINCT FROM d.lang LEFT JOIN p ON p.lang IS NOT DISTINCT FROM d.lang AND p.r = d.r LEFT JOIN v ON v.lang IS NOT DISTINCT FROM d.lang),
f AS (
  SELECT *, list_reduce(list_prepend(coalesce(seen, leaf), marks), lambda h, m: CASE WHEN m[1] = 'L' THEN sha256(substr(m, 2) || h) ELSE sha256(h || substr(m, 2)) END) AS folded_root FROM j)
SELECT doc_id, leaf, subroot, root, sha256(array_to_string(list_transform(marks, lambda m: substr(m, 2)), '')) AS proof_sha256, folded_root, folded_root = root AS verified FROM f
"""

OP12 = """
WITH v AS (
  SELECT row_number() OVER () AS rid, vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
         list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS q
  FROM embeddings WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (
  SELECT a.rid AS arid, a.vec_id AS anchor_id, a.label = c.label AS same, c.rid, c.vec_id,
         CAST(list_sum(list_transform(list_zip(a.q, c.q), lambda p: p[1] * p[2])) AS BIGINT) AS score
  FROM v a JOIN v c ON a.rid <> c.rid WHERE a.vec_id % 50 = 0),
p AS (SELECT * FROM s WHERE same QUALIFY row_number() OVER (PARTITION BY arid ORDER BY score DESC, vec_id NULLS LAST, rid) <= 5)
SELECT p.anchor_id, p.vec_id AS positive_id, CAST(row_number() OVER w AS INT) AS rank, n.vec_id AS negative_id, p.score AS positive_score, n.score AS negative_score
FROM p JOIN s n ON n.arid = p.arid AND NOT n.same AND 50 * p.score <= 100 * n.score AND 100 * n.score <= 95 * p.score
WINDOW w AS (PARTITION BY p.arid, p.rid ORDER BY n.score DESC, n.vec_id NULLS LAST, n.rid) QUALIFY row_number() OVER w <= 3
"""

ORACLES = {"op12_hard_negatives": OP12, "op11_merkle": OP11, "op6_chat": OP6, "op9_warc": OP9, "op2_decontamination": OP2, "op3_suffix_dedup": OP3}

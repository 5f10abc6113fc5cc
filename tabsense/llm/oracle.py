"""DuckDB SQL of the text operators that SQL can express."""

# The word class of the contract (fixed value).
_WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
_WORDS = ("regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', "
          f"'abcdefghijklmnopqrstuvwxyz'), '{_WORD}')")


def _hash52(expr: str) -> str:
    return (f"((('0x' || substr(md5({expr}), 1, 13))::BIGINT + 0.5) "
            "/ 4503599627370496.0)")


# Poisson draws: parts of mean at most 8, each inverted at its own uniform.
OP5 = f"""
WITH RECURSIVE counts AS (
  SELECT source, count(*) AS n_docs FROM documents GROUP BY source),
rates AS (
  SELECT source, (1.0 / (SELECT sum(1.0::DOUBLE) FROM counts))
         * (SELECT sum(n_docs) FROM counts) / n_docs AS rate
  FROM counts),
means AS (
  SELECT source, rate, ceil(rate / 8.0)::BIGINT AS parts, rate / ceil(rate / 8.0) AS mean
  FROM rates),
cdf(source, parts, mean, k, term, cdf) AS (
  SELECT source, parts, mean, 0::BIGINT, exp(-mean), exp(-mean) FROM means
  UNION ALL
  SELECT source, parts, mean, k + 1, term * mean / (k + 1), cdf + term * mean / (k + 1)
  FROM cdf WHERE k < 64),
parts AS (
  SELECT d.doc_id, d.source, m.mean, unnest(range(1, m.parts + 1)) AS part
  FROM documents d JOIN means m ON d.source IS NOT DISTINCT FROM m.source),
drawn AS (
  SELECT doc_id, source,
         {_hash52("'7|' || part || '|' || coalesce(doc_id::VARCHAR, 'null')")} AS u
  FROM parts),
copies AS (
  SELECT doc_id, source, sum((SELECT count(*) FROM cdf c
      WHERE c.source IS NOT DISTINCT FROM drawn.source AND c.cdf < u AND c.k < 64))::BIGINT
      AS n_copies
  FROM drawn GROUP BY doc_id, source)
SELECT doc_id, source, n_copies, copy, text_md5,
       md5('order-7|' || copy || '|' || coalesce(doc_id::VARCHAR, 'null')) AS shuffle_key
FROM (SELECT c.*, md5(d.text) AS text_md5, unnest(range(1, c.n_copies + 1)) AS copy
      FROM copies c JOIN documents d ON d.doc_id = c.doc_id)
"""

OP6 = f"""
WITH bench AS (
  SELECT item_id::VARCHAR AS item, {_WORDS} AS w FROM benchmark),
win AS (
  SELECT DISTINCT item, least(len(w), 10) AS n, array_to_string(w[i:i + 9], ' ') AS pattern
  FROM (SELECT item, w, unnest(range(1, greatest(len(w) - 10, 0) + 2)) AS i
        FROM bench WHERE len(w) > 0)),
docs AS (
  SELECT doc_id, coalesce({_WORDS}, []) AS w FROM documents),
places AS (
  SELECT doc_id, n, i, array_to_string(w[i:i + n - 1], ' ') AS pattern
  FROM (SELECT d.doc_id, d.w, l.n, unnest(range(1, len(d.w) - l.n + 2)) AS i
        FROM docs d, (SELECT DISTINCT n FROM win) l WHERE len(d.w) >= l.n)),
hits AS (
  SELECT p.doc_id, p.n, p.i, w.item FROM places p
  JOIN win w ON p.pattern = w.pattern AND p.n = w.n),
covered AS (
  SELECT doc_id, count(DISTINCT pos) AS n_hit
  FROM (SELECT doc_id, unnest(range(i, i + n)) AS pos FROM hits) GROUP BY doc_id),
named AS (
  SELECT doc_id, count(DISTINCT item) AS n_items,
         array_to_string(list_sort(list(DISTINCT item)), ',') AS ids
  FROM hits GROUP BY doc_id)
SELECT d.doc_id, len(d.w)::BIGINT AS n_words, coalesce(c.n_hit, 0)::BIGINT AS n_hit,
       coalesce(n.n_items, 0)::BIGINT AS n_items, sha256(coalesce(n.ids, '')) AS items_sha256,
       coalesce(c.n_hit, 0) > 0 AS contaminated
FROM docs d LEFT JOIN covered c USING (doc_id) LEFT JOIN named n USING (doc_id)
"""

# Paths along dependencies, walked one by one; calls that reach a cycle have none.
OP7 = """
WITH RECURSIVE call AS (
  SELECT conv_id, turn, conv_id || ':' || turn AS call_id, text,
         len(string_split(text, ' ')) AS w
  FROM conversations WHERE role = 'user'),
dep AS (
  SELECT DISTINCT conv_id, call_id, turn, dep FROM (
    SELECT conv_id, call_id, turn, unnest(CASE
        WHEN w % 6 = 0 THEN [conv_id || ':' || (turn + 2)]
        WHEN w % 6 = 1 THEN [CASE WHEN turn >= 2 THEN conv_id || ':' || (turn - 2) END,
                             CASE WHEN turn > 2 THEN conv_id || ':0' END]
        WHEN w % 6 <= 3 THEN [CASE WHEN turn >= 2 THEN conv_id || ':' || (turn - 2) END]
        ELSE [] END) AS dep FROM call) WHERE dep IS NOT NULL),
edge AS (
  SELECT d.conv_id, d.call_id, d.dep, ((c.turn, c.call_id) >= (d.turn, d.call_id))::BIGINT AS back
  FROM dep d JOIN call c ON c.conv_id = d.conv_id AND c.call_id = d.dep),
reach AS (
  SELECT conv_id, call_id, dep FROM edge
  UNION
  SELECT r.conv_id, r.call_id, e.dep FROM reach r
  JOIN edge e ON e.conv_id = r.conv_id AND e.call_id = r.dep),
stuck AS (
  SELECT conv_id, call_id FROM reach WHERE call_id = dep
  UNION
  SELECT r.conv_id, r.call_id FROM reach r
  JOIN reach c ON c.conv_id = r.conv_id AND c.call_id = r.dep AND c.dep = c.call_id),
free AS (
  SELECT c.* FROM call c ANTI JOIN stuck s ON s.conv_id = c.conv_id AND s.call_id = c.call_id),
path AS (
  SELECT conv_id, call_id, call_id AS at, 0::BIGINT AS steps, 0::BIGINT AS backs FROM free
  UNION
  SELECT p.conv_id, p.call_id, e.dep, p.steps + 1, p.backs + e.back FROM path p
  JOIN edge e ON e.conv_id = p.conv_id AND e.call_id = p.at),
lev AS (
  SELECT f.conv_id, f.call_id, max(p.steps) AS level,
         row_number() OVER (PARTITION BY f.conv_id
                            ORDER BY max(p.backs), f.turn, f.call_id) - 1 AS position
  FROM free f JOIN path p USING (conv_id, call_id) GROUP BY f.conv_id, f.call_id, f.turn),
asked AS (SELECT conv_id, call_id, count(*) AS n FROM dep GROUP BY ALL),
found AS (SELECT conv_id, call_id, count(*) AS n FROM edge GROUP BY ALL),
res AS (
  SELECT conv_id, conv_id || ':' || (turn - 1) AS call_id, min({'t': turn, 'x': text}) AS r,
         count(*) - 1 AS extra
  FROM conversations WHERE role = 'assistant' GROUP BY ALL)
SELECT coalesce(o.conv_id, r.conv_id) AS conv_id, coalesce(o.call_id, r.call_id) AS call_id,
       coalesce(o.turn, r.r.t) AS turn,
       CASE WHEN o.w % 13 = 0 THEN 'lookup' WHEN o.w IS NOT NULL THEN 'answer' END AS name,
       l.position::BIGINT AS position, l.level::BIGINT AS level,
       CASE WHEN o.w IS NOT NULL THEN coalesce(a.n, 0) - coalesce(f.n, 0) END AS dangling,
       CASE WHEN o.w IS NULL THEN 'noCall' WHEN r.r IS NULL THEN 'noResult'
            ELSE 'linked' END AS status,
       coalesce(r.extra, 0) AS extra_results,
       CASE WHEN o.w % 13 = 0 THEN 'unknownTool' WHEN o.w IS NOT NULL THEN
         array_to_string(list_filter([CASE WHEN o.w % 7 = 0 THEN 'missing:prompt' END,
                                      CASE WHEN o.w % 5 = 0 THEN 'type:words' END,
                                      CASE WHEN o.w % 11 = 0 THEN 'unknown:note' END],
                                     lambda e: e IS NOT NULL), ',') END AS errors,
       CASE WHEN o.w IS NOT NULL THEN
         '{"arguments":{' || CASE WHEN o.w % 11 = 0 THEN '"note":"long",' ELSE '' END
         || CASE WHEN o.w % 7 = 0 THEN '' ELSE '"prompt":' || to_json(o.text) || ',' END
         || '"turn":' || o.turn || ',"words":'
         || CASE WHEN o.w % 5 = 0 THEN '"' || o.w || '"' ELSE o.w::VARCHAR END
         || '},"id":' || to_json(o.call_id) || ',"name":"'
         || CASE WHEN o.w % 13 = 0 THEN 'lookup' ELSE 'answer' END || '"'
         || coalesce(',"position":' || l.position, '')
         || coalesce(',"result":' || to_json(r.r.x), '') || '}'
       END AS record
FROM call o FULL JOIN res r ON o.conv_id = r.conv_id AND o.call_id = r.call_id
LEFT JOIN lev l ON l.conv_id = o.conv_id AND l.call_id = o.call_id
LEFT JOIN asked a ON a.conv_id = o.conv_id AND a.call_id = o.call_id
LEFT JOIN found f ON f.conv_id = o.conv_id AND f.call_id = o.call_id
"""

# What is not a blank of any kind, Unicode's White_Space (fixed values).
_INK = (r"[^\x{9}-\x{D}\x{20}\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}"
        r"\x{202F}\x{205F}\x{3000}]+")

# Runs along diagonals as gaps and islands instead of array scans.
OP10 = f"""
WITH doc AS (
  SELECT DISTINCT doc_id, text FROM documents WHERE text IS NOT NULL),
key AS (
  SELECT row_number() OVER (ORDER BY doc_id NULLS FIRST, text) AS k, * FROM doc),
raw AS (
  SELECT k, unnest(string_split(text, chr(10))) AS line,
         generate_subscripts(string_split(text, chr(10)), 1) AS i FROM key),
ln AS (
  SELECT k, i, row_number() OVER (PARTITION BY k ORDER BY i) - 1 AS pos,
         ('0x' || substr(md5(trim(line)), 1, 15))::BIGINT AS h,
         len(regexp_extract_all(trim(line), '{_INK}')) AS words
  FROM raw WHERE trim(line) <> ''),
gram AS (
  SELECT k, pos, ('0x' || substr(md5(h || '|' || nxt), 1, 15))::BIGINT AS g,
         max(pos) OVER (PARTITION BY k) AS top, in_two >= 50 AS long
  FROM (SELECT *, lead(h) OVER (PARTITION BY k ORDER BY pos) AS nxt,
               words + lead(words) OVER (PARTITION BY k ORDER BY pos) AS in_two FROM ln)
  WHERE nxt IS NOT NULL),
win AS (
  SELECT k, w, arg_min({{'pos': pos, 'g': g}}, {{'g': g, 'at': -pos}}) AS x
  FROM (SELECT *, unnest(range(greatest(pos - 1, 0),
                               greatest(least(pos, top - 1), 0) + 1)) AS w FROM gram)
  GROUP BY k, w),
place AS (
  SELECT DISTINCT k, x.pos AS pos, 2 AS n, x.g AS fp FROM win
  UNION SELECT k, pos, 2, g FROM gram WHERE long
  UNION ALL SELECT k, pos, 1, h FROM ln WHERE words >= 50),
wide AS (
  SELECT k, pos, n, fp, 0 AS side, 0 AS near FROM place
  UNION ALL SELECT p.k, p.pos, n, fp, 1, l.h FROM place p JOIN ln l
    ON l.k = p.k AND l.pos = p.pos - 1
  UNION ALL SELECT p.k, p.pos, n, fp, 2, l.h FROM place p JOIN ln l
    ON l.k = p.k AND l.pos = p.pos + p.n),
fst AS (
  SELECT n, fp, side, near, min({{'k': k, 'pos': pos}}) AS f FROM wide
  GROUP BY n, fp, side, near HAVING count(*) > 1),
hit AS (
  SELECT DISTINCT p.k, p.pos, f.f.k AS k0, f.f.pos - p.pos AS shift
  FROM wide p JOIN fst f USING (n, fp, side, near) WHERE (p.k, p.pos) <> (f.f.k, f.f.pos)),
diag AS (
  SELECT DISTINCT k, k0, shift FROM hit),
same AS (
  SELECT d.k, d.k0, d.shift, a.pos,
         a.pos - row_number() OVER (PARTITION BY d.k, d.k0, d.shift ORDER BY a.pos) AS island
  FROM diag d JOIN ln a ON a.k = d.k
  JOIN ln b ON b.k = d.k0 AND b.pos = a.pos + d.shift AND b.h = a.h),
run AS (
  SELECT DISTINCT s.k, s.k0, s.shift, s.island FROM same s
  JOIN hit h ON h.k = s.k AND h.k0 = s.k0 AND h.shift = s.shift AND h.pos = s.pos),
span AS (
  SELECT s.k, min(l.i) AS lo, max(l.i) AS hi FROM same s
  JOIN run r USING (k, k0, shift, island) JOIN ln l ON l.k = s.k AND l.pos = s.pos
  GROUP BY s.k, s.k0, s.shift, s.island),
kept AS (
  SELECT k, array_to_string(list(line ORDER BY i), chr(10)) AS text,
         count(*) FILTER (trim(line) <> '') AS n
  FROM raw WHERE NOT EXISTS (
    SELECT 1 FROM span s WHERE s.k = raw.k AND raw.i BETWEEN s.lo AND s.hi) GROUP BY k),
cnt AS (SELECT k, count(*) AS n FROM ln GROUP BY k)
SELECT d.doc_id, coalesce(c.n, 0)::BIGINT AS n_lines,
       (coalesce(c.n, 0) - CASE WHEN k.k IS NULL THEN 0 ELSE coalesce(e.n, 0) END)::BIGINT
         AS n_removed,
       strlen(CASE WHEN k.k IS NULL THEN NULL ELSE coalesce(e.text, '') END)::BIGINT
         AS kept_bytes,
       md5(CASE WHEN k.k IS NULL THEN NULL ELSE coalesce(e.text, '') END) AS kept_md5
FROM documents d LEFT JOIN key k ON d.doc_id IS NOT DISTINCT FROM k.doc_id AND d.text = k.text
LEFT JOIN cnt c ON c.k = k.k LEFT JOIN kept e ON e.k = k.k
"""

# crc32 over the digits of the id, bit by bit; the levels as a recursive pivot of threes.
OP11 = """
WITH RECURSIVE cells AS (
  SELECT i, list_reduce(list_prepend(i::UBIGINT, range(8)::UBIGINT[]),
      lambda c, _: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384::UBIGINT) ELSE c >> 1 END) AS v
  FROM range(256) t(i)),
crc_table AS (SELECT list(v ORDER BY i) AS t FROM cells),
crc AS (
  SELECT doc_id, list_reduce(list_prepend(4294967295::UBIGINT,
      list_transform(string_split(doc_id::VARCHAR, ''), lambda ch: ord(ch)::UBIGINT)),
      lambda c, b: xor(t[((xor(c, b) & 255) + 1)::BIGINT], c >> 8)) AS c
  FROM (SELECT DISTINCT doc_id FROM documents WHERE doc_id IS NOT NULL), crc_table),
even AS (SELECT doc_id FROM crc WHERE xor(c, 4294967295::UBIGINT) % 2 = 0),
rows_ AS (
  SELECT d.doc_id, d.source,
         coalesce(strlen(d.doc_id::VARCHAR) || ':' || d.doc_id, '-')
         || coalesce(strlen(d.source) || ':' || d.source, '-')
         || coalesce(strlen(d.lang) || ':' || d.lang, '-')
         || coalesce(strlen(d.n_chars::VARCHAR) || ':' || d.n_chars, '-') AS head,
         d.text, CASE WHEN e.doc_id IS NULL THEN d.text ELSE replace(d.text, chr(10), '') END
         AS other
  FROM documents d LEFT JOIN even e USING (doc_id)),
leaf AS (
  SELECT doc_id, source,
         sha256(head || coalesce(strlen(text) || ':' || text, '-')) AS leaf,
         sha256(head || coalesce(strlen(other) || ':' || other, '-')) AS claimed
  FROM rows_),
placed AS (
  SELECT *, row_number() OVER (PARTITION BY source ORDER BY doc_id NULLS FIRST, leaf) - 1 AS pos,
         count(*) OVER (PARTITION BY source) AS n,
         dense_rank() OVER (ORDER BY source NULLS FIRST) - 1 AS tree,
         row_number() OVER () AS row
  FROM leaf),
up AS (
  SELECT 0 AS lev, tree, pos, n, leaf AS node FROM placed
  UNION ALL
  SELECT lev + 1, tree, pos // 3, (n + 2) // 3, sha256(string_agg(node, '' ORDER BY pos))
  FROM up WHERE n > 1 GROUP BY lev, tree, pos // 3, n),
sub AS (SELECT tree, node AS subroot FROM up WHERE n = 1),
top AS (
  SELECT 0 AS lev, tree AS pos, count(*) OVER () AS n, subroot AS node FROM sub
  UNION ALL
  SELECT lev + 1, pos // 3, (n + 2) // 3, sha256(string_agg(node, '' ORDER BY pos))
  FROM top WHERE n > 1 GROUP BY lev, pos // 3, n),
climb AS (
  SELECT row, tree, 0 AS lev, pos, n FROM placed
  UNION ALL
  SELECT row, tree, lev + 1, pos // 3, (n + 2) // 3 FROM climb WHERE n > 1),
over AS (
  SELECT tree, 0 AS lev, tree AS pos, count(*) OVER () AS n FROM sub
  UNION ALL
  SELECT tree, lev + 1, pos // 3, (n + 2) // 3 FROM over WHERE n > 1),
sib AS (
  SELECT c.row, c.lev, u.pos, u.pos < c.pos AS left_side, u.node FROM climb c
  JOIN up u ON u.tree = c.tree AND u.lev = c.lev AND u.pos // 3 = c.pos // 3 AND u.pos <> c.pos
  WHERE c.n > 1
  UNION ALL
  SELECT p.row, 1000 + o.lev, t.pos, t.pos < o.pos, t.node FROM placed p
  JOIN over o ON o.tree = p.tree
  JOIN top t ON t.lev = o.lev AND t.pos // 3 = o.pos // 3 AND t.pos <> o.pos
  WHERE o.n > 1),
proof AS (
  SELECT row, sha256(string_agg(node, '' ORDER BY lev, pos)) AS proof FROM sib GROUP BY row),
stair AS (
  SELECT row, lev, row_number() OVER (PARTITION BY row ORDER BY lev) AS step FROM (
    SELECT row, lev FROM climb WHERE n > 1
    UNION ALL SELECT p.row, 1000 + o.lev FROM placed p JOIN over o USING (tree) WHERE o.n > 1)),
around AS (
  SELECT s.row, s.step,
         coalesce(string_agg(b.node, '' ORDER BY b.pos) FILTER (b.left_side), '') AS l,
         coalesce(string_agg(b.node, '' ORDER BY b.pos) FILTER (NOT b.left_side), '') AS r
  FROM stair s LEFT JOIN sib b ON b.row = s.row AND b.lev = s.lev GROUP BY s.row, s.step),
fold AS (
  SELECT row, 0::BIGINT AS step, claimed AS node FROM placed
  UNION ALL
  SELECT f.row, a.step, sha256(a.l || f.node || a.r) FROM fold f
  JOIN around a ON a.row = f.row AND a.step = f.step + 1)
SELECT p.doc_id, p.leaf, s.subroot, t.node AS root,
       coalesce(f.proof, sha256('')) AS proof_sha256, x.folded_root,
       x.folded_root = t.node AS verified
FROM placed p JOIN sub s USING (tree) JOIN top t ON t.n = 1
LEFT JOIN proof f ON f.row = p.row
JOIN (SELECT row, arg_max(node, step) AS folded_root FROM fold GROUP BY row) x ON x.row = p.row
"""

OP13 = """
WITH v AS (
  SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
         list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS q
  FROM embeddings
  WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (
  SELECT a.vec_id AS a, b.vec_id AS b, a.label = b.label AS same,
         list_inner_product(a.q, b.q)::BIGINT AS score
  FROM v a JOIN v b ON a.vec_id <> b.vec_id WHERE a.vec_id % 100 = 0),
pos AS (
  SELECT a, b, score FROM s WHERE same
  QUALIFY row_number() OVER (PARTITION BY a ORDER BY score DESC, b) <= 5)
SELECT p.a AS anchor_id, p.b AS positive_id,
       row_number() OVER (PARTITION BY p.a, p.b ORDER BY n.score DESC, n.b)::INTEGER AS rank,
       n.b AS negative_id, p.score AS positive_score, n.score AS negative_score
FROM pos p JOIN s n ON n.a = p.a AND NOT n.same
  AND 80 * p.score <= 100 * n.score AND 100 * n.score <= 100 * p.score
QUALIFY rank <= 5
"""

ORACLE = {
    "op5_mixing": OP5, "op6_decontamination": OP6, "op7_tool_calls": OP7,
    "op10_winnowing": OP10, "op11_merkle": OP11, "op13_zone_negatives": OP13}

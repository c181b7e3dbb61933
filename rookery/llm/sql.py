"""DuckDB twins of the numbered operators that SQL can express."""

_LETTERS = "'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'"
_WORDS = rf"coalesce(regexp_extract_all(translate(text, {_LETTERS}), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+'), [])"

DECONTAMINATION = f"""
WITH items AS (SELECT item_id, {_WORDS} AS ws FROM benchmark),
grams AS (
  SELECT DISTINCT item_id, least(len(ws), 13) AS n, array_to_string(ws[i : i + least(len(ws), 13) - 1], ' ') AS g
  FROM items, unnest(range(1, greatest(len(ws) - 12, 1) + 1)) AS t(i) WHERE len(ws) > 0
),
docs AS (SELECT doc_id, {_WORDS} AS ws FROM documents),
places AS (
  SELECT doc_id, i, n, array_to_string(ws[i : i + n - 1], ' ') AS g
  FROM docs, (SELECT DISTINCT n FROM grams) AS lens, unnest(range(1, len(ws) - n + 2)) AS t(i)
),
found AS (SELECT doc_id, i, n, item_id FROM places JOIN grams USING (g, n)),
hit AS (SELECT doc_id, count(DISTINCT p) AS c FROM found, unnest(range(i, i + n)) AS t(p) GROUP BY doc_id),
named AS (
  SELECT doc_id, count(*) AS c, string_agg(s, ',' ORDER BY s) AS s
  FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS s FROM found) GROUP BY doc_id
)
SELECT doc_id, len(ws) AS n_words, coalesce(hit.c, 0) AS n_hit, coalesce(named.c, 0) AS n_items,
  sha256(coalesce(named.s, '')) AS items_sha256,
  coalesce(hit.c, 0) > 0 AND 20 * coalesce(hit.c, 0) >= len(ws) AS contaminated
FROM docs LEFT JOIN hit USING (doc_id) LEFT JOIN named USING (doc_id)
"""

# control strings after their first character, as in chat.CONTROL
_TAILS = (
    r"\|im_start\|>|\|im_end\|>|\|endoftext\|>|\|system\|>|\|user\|>|\|assistant\|>|s>|/s>|unk>|pad>|"
    r"INST\]|/INST\]|<SYS>>|</SYS>>"
)

CHAT = f"""
WITH rows AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '</s>[INST] ok [/INST]' UNION ALL SELECT -7, 1, 'assistant', '</s>[INST] ok [/INST]'
)
SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
  CAST(sum(CASE WHEN role = 'assistant' THEN length(text) ELSE 0 END) AS BIGINT) AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
  CAST(sum(24 + length(role) + length(text)
    + len(regexp_extract_all(text, '[<\\[]\\\\*(?:{_TAILS})'))) AS BIGINT) AS formatted_chars
FROM rows GROUP BY conv_id
"""

VECTORS = """
WITH RECURSIVE u AS (
  SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS e FROM embeddings WHERE label IS NOT NULL AND embedding IS NOT NULL
),
ok AS (
  SELECT vec_id, label, e, sqrt(list_dot_product(e, e)) AS len FROM u
  WHERE len(e) > 0 AND len([x FOR x IN e IF x IS NULL OR NOT isfinite(x)]) = 0
),
links AS (
  SELECT a.vec_id AS a, b.vec_id AS b FROM ok AS a JOIN ok AS b ON a.label = b.label AND a.vec_id <> b.vec_id
  WHERE a.len > 0 AND b.len > 0 AND list_dot_product(a.e, b.e) / (a.len * b.len) >= 0.93
),
reach AS (SELECT vec_id AS a, vec_id AS b FROM embeddings UNION SELECT r.a, l.b FROM reach AS r JOIN links AS l ON r.b = l.a),
tops AS (SELECT a AS vec_id, min(b) AS component_id FROM reach GROUP BY a),
degrees AS (SELECT a AS vec_id, count(*) AS n FROM links GROUP BY a)
SELECT vec_id, coalesce(n, 0) AS n_links, component_id, vec_id = component_id AS kept
FROM tops LEFT JOIN degrees USING (vec_id)
"""

LEXICAL = f"""
WITH docs AS (SELECT doc_id, {_WORDS} AS ws FROM documents),
sizes AS (SELECT doc_id, CAST(len(ws) AS BIGINT) AS n FROM docs WHERE len(ws) > 0),
corpus AS (SELECT count(*) AS n_docs, CAST(sum(n) AS BIGINT) AS total FROM sizes),
wanted AS (
  SELECT item_id, term, count(*) AS times FROM (SELECT item_id, unnest({_WORDS}) AS term FROM (SELECT DISTINCT item_id, text FROM benchmark))
  GROUP BY ALL
),
tf AS (
  SELECT doc_id, term, count(*) AS f FROM (SELECT doc_id, unnest(ws) AS term FROM docs)
  WHERE term IN (SELECT term FROM wanted) GROUP BY ALL
),
weights AS (
  SELECT term, CAST(floor(1000 * ln(CAST(2 * any_value(n_docs) + 2 AS DOUBLE) / (2 * count(*) + 1))) AS BIGINT) AS w
  FROM tf, corpus GROUP BY term
),
parts AS (
  SELECT doc_id, term, w * ((1000000000 * f) // (1000 * f + 12 * (75 + (25 * n * n_docs) // total))) AS part
  FROM tf JOIN weights USING (term) JOIN sizes USING (doc_id), corpus
),
scores AS (SELECT item_id, doc_id, CAST(sum(times * part) AS BIGINT) AS score FROM parts JOIN wanted USING (term) GROUP BY ALL),
ranked AS (
  SELECT *, CAST(row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS INTEGER) AS rank FROM scores WHERE score > 0
)
SELECT item_id, rank, doc_id, score FROM ranked WHERE rank <= 20
"""

SUFFIXES = """
WITH docs AS (SELECT doc_id, encode(coalesce(text, '')) AS b FROM documents),
sized AS (SELECT doc_id, octet_length(b) AS n, b FROM docs),
windows AS (
  SELECT doc_id, i, b[i : i + 49] AS w FROM sized, unnest(range(1, n - 48)) AS t(i)
),
first AS (SELECT w, min(doc_id) AS least FROM windows GROUP BY w),
hit AS (SELECT doc_id, i FROM windows JOIN first USING (w) WHERE doc_id > least),
marked AS (
  SELECT doc_id, i, i > 50 + coalesce(lag(i) OVER (PARTITION BY doc_id ORDER BY i), -99) AS new FROM hit
),
spans AS (
  SELECT doc_id, k, min(i) AS a, max(i) + 50 AS z
  FROM (SELECT doc_id, i, sum(CAST(new AS INTEGER)) OVER (PARTITION BY doc_id ORDER BY i) AS k FROM marked) GROUP BY doc_id, k
),
gone AS (SELECT doc_id, CAST(sum(z - a) AS BIGINT) AS n_removed, count(*) AS n_spans FROM spans GROUP BY doc_id),
edges AS (
  SELECT doc_id, a AS stop, coalesce(lag(z) OVER (PARTITION BY doc_id ORDER BY a), 1) AS start FROM spans
  UNION ALL SELECT doc_id, n + 1, coalesce(max(z), 1) FROM sized LEFT JOIN spans USING (doc_id) GROUP BY doc_id, n
),
kept AS (
  SELECT doc_id, string_agg(hex(b[start : stop - 1]), '' ORDER BY start) AS k FROM edges JOIN sized USING (doc_id) GROUP BY doc_id
)
SELECT doc_id, CAST(n AS BIGINT) AS n_bytes, coalesce(n_removed, 0) AS n_removed, coalesce(n_spans, 0) AS n_spans,
  sha256(unhex(k)) AS kept_sha256
FROM sized JOIN kept USING (doc_id) LEFT JOIN gone USING (doc_id)
"""

IMPORTANCE = f"""
WITH RECURSIVE bits AS (
  SELECT CAST(range AS BIGINT) AS b, 0 AS k, CAST(range AS BIGINT) AS c FROM range(256)
  UNION ALL SELECT b, k + 1, CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END FROM bits WHERE k < 8
),
crcs AS (SELECT list(c ORDER BY b) AS crc_table FROM bits WHERE k = 8),
docs AS (SELECT doc_id, {_WORDS} AS ws FROM documents),
source AS (SELECT doc_id, unnest(ws) AS word FROM docs),
target AS (SELECT unnest({_WORDS}) AS word FROM benchmark),
hexed AS (SELECT word, hex(encode(word)) AS h FROM (SELECT word FROM source UNION SELECT word FROM target)),
coded AS (
  SELECT word, list_transform(range(1, len(h), 2), lambda i:
    CAST(16 * (strpos('0123456789ABCDEF', h[i]) - 1) + strpos('0123456789ABCDEF', h[i + 1]) - 1 AS BIGINT)) AS codes FROM hexed
),
hashed AS (
  SELECT word, xor(list_reduce(list_prepend(4294967295, codes), lambda a, x: xor(a >> 8, crc_table[xor(a & 255, x) + 1])), 4294967295) % 10000 AS bucket
  FROM coded, crcs
),
s AS (SELECT bucket, count(*) AS s FROM source JOIN hashed USING (word) GROUP BY bucket),
t AS (SELECT bucket, count(*) AS t FROM target JOIN hashed USING (word) GROUP BY bucket),
totals AS (SELECT (SELECT count(*) FROM source) AS ss, (SELECT count(*) FROM target) AS tt),
gains AS (
  SELECT bucket, CAST(floor(1000 * ln(CAST(coalesce(t, 0) + 1 AS DOUBLE) * (ss + 10000) / (CAST(s + 1 AS DOUBLE) * (tt + 10000)))) AS BIGINT) AS gain
  FROM s LEFT JOIN t USING (bucket), totals
),
means AS (
  SELECT doc_id, count(*) AS n_features, CAST(floor(CAST(sum(gain) AS DOUBLE) / count(*)) AS BIGINT) AS weight
  FROM source JOIN hashed USING (word) JOIN gains USING (bucket) GROUP BY doc_id
),
hashes AS (SELECT doc_id, len(ws) AS n, sha256('2024:' || doc_id) AS x FROM docs),
scored AS (
  SELECT doc_id, n, coalesce(n_features, 0) AS n_features, coalesce(weight, 0) AS weight,
    coalesce(weight, 0) + CAST(floor(-1000 * ln(-ln((list_reduce(list_transform(range(1, 9), lambda i: CAST(strpos('0123456789abcdef', x[i]) - 1 AS BIGINT)),
      lambda a, d: 16 * a + d) + 0.5) / 4294967296.0))) AS BIGINT) AS score
  FROM hashes LEFT JOIN means USING (doc_id)
),
drawn AS (SELECT doc_id, row_number() OVER (ORDER BY score DESC, doc_id) AS rank FROM scored WHERE n >= 20)
SELECT doc_id, n_features, weight, score, CASE WHEN rank <= (SELECT count(*) * 10 // 100 FROM drawn) THEN rank END AS rank
FROM scored LEFT JOIN drawn USING (doc_id)
"""

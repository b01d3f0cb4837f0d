"""DuckDB SQL that recomputes queries of this subpackage from the tables alone."""

QUALITY = r"""
WITH t AS (SELECT doc_id, coalesce(text, '') AS text FROM documents),
w AS (
  SELECT doc_id, text,
         list_filter(regexp_split_to_array(text, '[\x20\x09-\x0D]+'), lambda x: x <> '') AS words,
         list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS lines
  FROM t),
g AS (SELECT doc_id, unnest(words) AS word, generate_subscripts(words, 1) AS pos FROM w),
win AS (
  SELECT doc_id, pos, word AS a, lead(word, 1) OVER d AS b, lead(word, 2) OVER d AS c
  FROM g WINDOW d AS (PARTITION BY doc_id ORDER BY pos)),
twice AS (
  SELECT doc_id, pos FROM win WHERE c IS NOT NULL
  QUALIFY count(*) OVER (PARTITION BY doc_id, a, b, c) > 1),
covered AS (
  SELECT doc_id, count(DISTINCT pos + k) AS n FROM twice, (VALUES (0), (1), (2)) AS o(k) GROUP BY doc_id),
m AS (
  SELECT w.doc_id, len(words)::BIGINT AS n_words,
         length(array_to_string(words, ''))::BIGINT AS word_chars,
         (length(text) - length(regexp_replace(text, '[#*$%&|<>]', '', 'g')))::BIGINT AS n_symbols,
         (len(lines) - len(list_distinct(lines)))::BIGINT AS n_dup_lines,
         coalesce(n, 0)::BIGINT AS n_repeat_words,
         len(lines) AS n_lines,
         length(text) - length(replace(text, '!', '')) AS bangs,
         length(text) - length(regexp_replace(text, '[A-Z]', '', 'g')) AS capitals
  FROM w LEFT JOIN covered USING (doc_id)),
f AS (SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed FROM m)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
       NOT (base_failed OR 10 * n_symbols > 3 * n_words OR word_chars < 2 * n_words OR word_chars > 20 * n_words
            OR 2 * n_dup_lines > n_lines OR 2 * bangs > n_words OR 2 * capitals > word_chars) AS kept
FROM f
"""

CONTAINMENT = r"""
WITH t AS (
  SELECT 'd' AS side, doc_id AS id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM documents
  UNION ALL
  SELECT 'i', item_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') FROM benchmark),
s AS (
  SELECT DISTINCT side, id, unnest(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 5 THEN [w]
    ELSE list_transform(range(1, len(w) - 3), lambda i: w[i:i + 4]) END) AS shingle FROM t),
n AS (SELECT id, count(*) AS n_item FROM s WHERE side = 'i' GROUP BY id)
SELECT d.id AS doc_id, i.id AS item_id, n_item::BIGINT AS n_item, count(*)::BIGINT AS n_shared, count(*) / n_item AS containment
FROM s d JOIN s i ON d.side = 'd' AND i.side = 'i' AND d.shingle = i.shingle JOIN n ON n.id = i.id
GROUP BY d.id, i.id, n_item HAVING 10 * count(*) >= 8 * n_item
"""

_DRAW = "('0x' || substr(md5(doc_id::VARCHAR || ':' || {k}), 1, 13))::BIGINT"
_BEST = "list_aggregate([{draws}], 'max')"


def _best(n: int) -> str:
    draws = ", ".join(f"{{'v': {_DRAW.format(k=k)}, 'neg': -{k}}}" for k in range(n))
    return f"-(list_max([{draws}])).neg"


#: CRC-32 four bits at a time: its table for half bytes, from the reflected polynomial.
def _half_byte_table() -> list[int]:
    out = []
    for v in range(16):
        for _ in range(4):
            v = (v >> 1) ^ (0xEDB88320 if v & 1 else 0)
        out.append(v)
    return out


SHARDING = f"""
WITH h AS (SELECT doc_id, text, hex(encode(coalesce(text, ''))) AS hexed FROM documents),
c AS (
  SELECT doc_id, octet_length(encode(coalesce(text, '')))::BIGINT + 8 AS size,
         xor(list_reduce(
           list_transform(string_split(regexp_replace(hexed, '(.)(.)', '\\2\\1', 'g'), ''),
             lambda h: (strpos('123456789ABCDEF', h))::BIGINT),
           lambda crc, v: xor(crc >> 4, {_half_byte_table()}[(xor(crc, v) & 15) + 1]),
           4294967295::BIGINT), 4294967295::BIGINT)::BIGINT AS text_crc32,
         ({_best(24)})::INTEGER AS shard, ({_best(25)})::INTEGER AS grown_shard
  FROM h)
SELECT doc_id, size, text_crc32, 'key' AS law, shard,
       row_number() OVER (PARTITION BY shard ORDER BY substr(md5(doc_id::VARCHAR), 1, 3), doc_id, text_crc32, size) - 1 AS slot,
       grown_shard
FROM c
"""

_LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_SPLIT = r"list_filter(regexp_split_to_array({0}, '[\x20\x09-\x0D]+'), lambda x: x <> '')"

NEAR_DUPLICATES = f"""
WITH RECURSIVE t AS (SELECT doc_id, {_SPLIT.format(_LOWER)} AS w FROM documents),
s AS (
  SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 4 THEN [array_to_string(w, ' ')]
    ELSE list_transform(range(1, len(w) - 2), lambda i: array_to_string(w[i:i + 3], ' ')) END) AS shingle FROM t),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM s a JOIN s b ON a.shingle = b.shingle AND a.doc_id < b.doc_id GROUP BY ALL),
link AS (SELECT a, b FROM p JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * c >= 80 * (x.n + y.n - c)),
e AS (SELECT a, b FROM link UNION ALL SELECT b, a FROM link),
r(node, root) AS (SELECT doc_id, doc_id FROM documents UNION SELECT e.b, r.root FROM r JOIN e ON e.a = r.node),
m AS (SELECT node, min(root) AS root FROM r GROUP BY node)
SELECT d.doc_id, coalesce(n, 0)::BIGINT AS n_shingles, root AS component_id, root = d.doc_id AS kept
FROM documents d JOIN m ON m.node = d.doc_id LEFT JOIN n ON n.doc_id = d.doc_id
"""

SUBSTRINGS = f"""
WITH t AS (SELECT doc_id, {_SPLIT.format("coalesce(text, '')")} AS w FROM documents),
g AS (SELECT doc_id, i AS pos, md5(array_to_string(w[i:i + 12], ' ')) AS win FROM t, unnest(range(1, greatest(len(w) - 11, 1))) AS u(i)),
late AS (SELECT doc_id, pos FROM g QUALIFY doc_id > min(doc_id) OVER (PARTITION BY win)),
gone AS (SELECT DISTINCT doc_id, pos + k AS pos FROM late, range(0, 13) AS r(k)),
tok AS (SELECT doc_id, unnest(w) AS word, generate_subscripts(w, 1) AS pos FROM t),
kept AS (SELECT doc_id, string_agg(word, ' ' ORDER BY pos) AS text FROM tok ANTI JOIN gone USING (doc_id, pos) GROUP BY doc_id),
c AS (SELECT doc_id, count(*) AS n FROM gone GROUP BY doc_id)
SELECT t.doc_id, len(w)::BIGINT AS n_words, coalesce(c.n, 0)::BIGINT AS n_removed, sha256(coalesce(kept.text, '')) AS kept_sha256
FROM t LEFT JOIN kept USING (doc_id) LEFT JOIN c USING (doc_id)
"""

TOP_K = """
WITH v AS (
  SELECT DISTINCT vec_id, list_transform(embedding, lambda x: floor(1024 * x::DOUBLE)::BIGINT) AS v FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (
  SELECT q.vec_id AS query_id, c.vec_id, list_sum(list_transform(range(1, len(q.v) + 1), lambda i: q.v[i] * c.v[i]))::BIGINT AS score
  FROM v q JOIN v c ON c.vec_id <> q.vec_id OR c.v <> q.v WHERE q.vec_id % 100 = 0)
SELECT query_id, (row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id))::INTEGER AS rank, vec_id, score
FROM s QUALIFY rank <= 10
"""

DIVERGENCE = r"""
WITH d AS (
  SELECT doc_id, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
         regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x40\x5B-\x60\x7B-\x7F]+') AS terms,
         row_number() OVER () AS row FROM documents),
w AS (SELECT lang, source, row, unnest(terms) AS term FROM d),
kept AS (SELECT lang, term FROM w GROUP BY ALL HAVING count(DISTINCT row) >= 3),
c AS (SELECT lang, source, term, count(*) AS n FROM w JOIN kept USING (lang, term) GROUP BY ALL),
v AS (SELECT g.lang, (SELECT count(*) FROM kept k WHERE k.lang = g.lang) AS v FROM (SELECT DISTINCT lang FROM d) g),
g AS (SELECT DISTINCT lang, source FROM d),
gs AS (SELECT g.lang, g.source, v.v, coalesce(sum(c.n), 0)::BIGINT AS total FROM g JOIN v USING (lang) LEFT JOIN c ON c.lang = g.lang AND c.source = g.source GROUP BY ALL),
ls AS (SELECT lang, v, sum(total)::BIGINT AS total FROM gs GROUP BY ALL),
lc AS (SELECT lang, term, sum(n)::BIGINT AS n FROM c GROUP BY ALL),
p AS (SELECT gs.lang, gs.source, k.term, coalesce(c.n, 0) AS n, 1 + (1000000000 * (coalesce(c.n, 0) + 1)) // (gs.total + gs.v) AS p
  FROM gs JOIN kept k ON k.lang = gs.lang LEFT JOIN c ON c.lang = gs.lang AND c.source = gs.source AND c.term = k.term),
pairs AS (SELECT a.lang, a.source, b.source AS item, coalesce(sum((a.p - b.p) * (a.p - b.p) // b.p), 0)::BIGINT AS value
  FROM p a JOIN p b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY ALL),
every AS (SELECT a.lang, a.source, b.source AS item, coalesce(value, 0)::BIGINT AS value
  FROM g a JOIN g b ON a.lang = b.lang AND a.source <> b.source LEFT JOIN pairs x ON x.lang = a.lang AND x.source = a.source AND x.item = b.source),
lp AS (SELECT ls.lang, lc.term, 1 + (1000000000 * (lc.n + 1)) // (ls.total + ls.v) AS q FROM ls JOIN lc USING (lang)),
terms AS (SELECT p.lang, p.source, p.term AS item, ((p.p - lp.q) * (p.p - lp.q) // lp.q)::BIGINT AS value FROM p JOIN lp USING (lang, term) WHERE p.n > 0 AND p.p > lp.q)
SELECT lang, source, 'pair' AS part, item, value, (row_number() OVER (PARTITION BY lang, source ORDER BY value DESC, item))::INTEGER AS rank FROM every
UNION ALL
SELECT * FROM (SELECT lang, source, 'term' AS part, item, value, (row_number() OVER (PARTITION BY lang, source ORDER BY value DESC, item))::INTEGER AS rank FROM terms) WHERE rank <= 200
"""

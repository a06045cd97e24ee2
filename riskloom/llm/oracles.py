"""DuckDB SQL for the queries that SQL can express."""

WORDS = r"regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')"

OP3 = rf"""
WITH d AS (
  SELECT doc_id, coalesce(text, '') AS text, {WORDS} AS words,
         list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS lines
  FROM documents),
w AS (SELECT doc_id, unnest(words) AS word, generate_subscripts(words, 1) AS i FROM d),
v AS (
  SELECT doc_id, i, CASE WHEN count(*) OVER five = 5 THEN string_agg(word, ' ') OVER five END AS five
  FROM w WINDOW five AS (PARTITION BY doc_id ORDER BY i ROWS BETWEEN CURRENT ROW AND 4 FOLLOWING)),
g AS (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, five) AS n FROM v WHERE five IS NOT NULL),
r AS (SELECT doc_id, count(DISTINCT pos) AS n_repeat_words FROM (SELECT doc_id, unnest(range(i, i + 5)) AS pos FROM g WHERE n > 1) GROUP BY doc_id),
m AS (
  SELECT d.doc_id, len(words) AS n_words, length(regexp_replace(text, '[\x20\x09-\x0D]+', '', 'g')) AS word_chars,
         length(text) - length(regexp_replace(text, '[#*$%&|<>]', '', 'g')) AS n_symbols,
         len(lines) - len(list_distinct(lines)) AS n_dup_lines, coalesce(n_repeat_words, 0) AS n_repeat_words, len(lines) AS n_lines,
         length(text) - length(regexp_replace(text, '[A-Z]', '', 'g')) AS n_upper
  FROM d LEFT JOIN r USING (doc_id)),
f AS (
  SELECT *, CASE WHEN n_words < 10 THEN 1 ELSE 0 END + CASE WHEN 100 * n_repeat_words > 20 * n_words THEN 2 ELSE 0 END
         + CASE WHEN 10 * n_symbols > n_words THEN 4 ELSE 0 END + CASE WHEN word_chars < 2 * n_words OR word_chars > 20 * n_words THEN 8 ELSE 0 END
         + CASE WHEN 2 * n_dup_lines > n_lines THEN 16 ELSE 0 END + CASE WHEN 10 * n_upper > 4 * word_chars THEN 32 ELSE 0 END AS failed
  FROM m)
SELECT doc_id, CAST(n_words AS BIGINT) AS n_words, CAST(word_chars AS BIGINT) AS word_chars, CAST(n_symbols AS BIGINT) AS n_symbols,
       CAST(n_dup_lines AS BIGINT) AS n_dup_lines, CAST(n_repeat_words AS BIGINT) AS n_repeat_words,
       failed & 3 <> 0 AS base_failed, failed = 0 AS kept, CAST(failed AS BIGINT) AS failed_rules
FROM f
"""

OP6 = rf"""
WITH d AS (SELECT doc_id, source, CAST(len({WORDS}) AS BIGINT) AS size, md5(coalesce(CAST(doc_id AS VARCHAR), '')) AS ord FROM documents),
s AS (SELECT source, sum(size) AS source_size, count(*) AS n_docs, row_number() OVER (ORDER BY source NULLS LAST) - 1 AS place FROM d GROUP BY source),
p AS (SELECT *, CAST(place % 3 + 1 AS DOUBLE) AS weight, CAST(source_size * 3 AS DOUBLE) AS cap FROM s),
q AS (SELECT *, CAST((SELECT sum(source_size) FROM p) AS DOUBLE) AS total, (SELECT count(*) FROM p) AS n_sources, cap / weight AS ratio FROM p),
l AS (
  -- the level at which a source is just full: the words that all sources hold then grow with it
  SELECT a.source, (any_value(a.total) - coalesce(sum(b.cap) FILTER (WHERE (b.ratio, b.place) < (a.ratio, a.place)), 0))
         / sum(b.weight) FILTER (WHERE (b.ratio, b.place) >= (a.ratio, a.place)) AS level,
         sum(least(b.cap, a.ratio * b.weight)) AS held
  FROM q a, q b GROUP BY a.source, a.ratio, a.place),
t AS (
  SELECT q.*, (SELECT l.level FROM l JOIN q o ON l.source IS NOT DISTINCT FROM o.source WHERE l.held >= o.total ORDER BY o.ratio, o.place LIMIT 1) AS level
  FROM q),
u AS (
  SELECT source, CAST(source_size AS BIGINT) AS source_size, least(cap, level * weight) AS target,
         0.8::DOUBLE * (2.0::DOUBLE * place / greatest(n_sources - 1, 1) - 1) AS slope FROM t),
a AS (
  SELECT d.doc_id, d.size, u.source_size, u.target, u.slope,
         CAST(coalesce(sum(d.size) OVER (PARTITION BY d.source ORDER BY d.ord, d.doc_id, d.size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS ahead
  FROM d JOIN u ON d.source IS NOT DISTINCT FROM u.source),
k AS (
  SELECT *, greatest(0, least(size, CAST(floor(target) AS BIGINT) - ahead)) AS t0,
         greatest(0, least(size, CAST(floor(target) AS BIGINT) - source_size - ahead)) AS t1,
         greatest(0, least(size, CAST(floor(target) AS BIGINT) - 2 * source_size - ahead)) AS t2,
         least(1.0::DOUBLE, CAST(ahead AS DOUBLE) / target) AS part
  FROM a)
SELECT doc_id, size, source_size, target, CAST(t0 + t1 + t2 AS BIGINT) AS taken,
       CASE WHEN t0 > 0 THEN round(2 * part / ((1 - slope) + sqrt((1 - slope) * (1 - slope) + 4 * slope * part)), 9) END AS position
FROM k
"""

OP2 = rf"""
WITH d AS (SELECT doc_id, {WORDS} AS words FROM documents),
w AS (SELECT doc_id, unnest(words) AS word, generate_subscripts(words, 1) AS i FROM d),
v AS (
  SELECT doc_id, i, word, CASE WHEN count(*) OVER s = 13 THEN string_agg(word, ' ') OVER s END AS stretch
  FROM w WINDOW s AS (PARTITION BY doc_id ORDER BY i ROWS BETWEEN CURRENT ROW AND 12 FOLLOWING)),
b AS (SELECT doc_id, i, word, CASE WHEN stretch IS NOT NULL AND min(doc_id) OVER (PARTITION BY stretch) < doc_id THEN 1 ELSE 0 END AS hit FROM v),
r AS (
  SELECT doc_id, i, word, max(hit) OVER (PARTITION BY doc_id ORDER BY i ROWS BETWEEN 12 PRECEDING AND CURRENT ROW) AS gone FROM b),
k AS (
  SELECT doc_id, count(*) AS n_words, CAST(sum(gone) AS BIGINT) AS n_removed,
         sha256(coalesce(string_agg(word, ' ' ORDER BY i) FILTER (WHERE gone = 0), '')) AS kept_sha256
  FROM r GROUP BY doc_id)
SELECT d.doc_id, coalesce(n_words, 0) AS n_words, coalesce(n_removed, 0) AS n_removed, coalesce(kept_sha256, sha256('')) AS kept_sha256
FROM d LEFT JOIN k USING (doc_id)
"""

OP4 = r"""
WITH d AS (
  SELECT doc_id, length(coalesce(text, '')) AS n, sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g')) AS text_sha256
  FROM documents)
SELECT doc_id, first_value(doc_id) OVER (PARTITION BY text_sha256 ORDER BY n DESC, doc_id) AS keep_id,
       count(*) OVER (PARTITION BY text_sha256) AS group_size,
       doc_id = first_value(doc_id) OVER (PARTITION BY text_sha256 ORDER BY n DESC, doc_id) AS kept, text_sha256
FROM d
"""

LETTERS = "'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'"
PLAIN = rf"regexp_extract_all(translate(coalesce(text, ''), {LETTERS}), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"

OP11 = rf"""
WITH d AS (SELECT doc_id, {PLAIN} AS words FROM documents),
i AS (SELECT CAST(item_id AS VARCHAR) AS item, {PLAIN} AS words FROM benchmark),
c AS (SELECT item, words, least(len(words), 10) AS n, unnest(range(1, len(words) - least(len(words), 10) + 2)) AS pos FROM i WHERE len(words) > 0),
g AS (SELECT DISTINCT item, n, array_to_string(words[pos : pos + n - 1], ' ') AS gram FROM c),
p AS (SELECT doc_id, words, n, unnest(range(1, len(words) - n + 2)) AS pos FROM d, (SELECT DISTINCT n FROM g) WHERE len(words) >= n),
v AS (SELECT doc_id, n, pos, array_to_string(words[pos : pos + n - 1], ' ') AS gram FROM p),
h AS (SELECT doc_id, pos, v.n, item FROM v JOIN g USING (gram)),
k AS (SELECT doc_id, count(DISTINCT place) AS n_hit FROM (SELECT DISTINCT doc_id, unnest(range(pos, pos + n)) AS place FROM h) GROUP BY doc_id),
t AS (SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items FROM (SELECT DISTINCT doc_id, item FROM h WHERE item IS NOT NULL) GROUP BY doc_id)
SELECT d.doc_id, CAST(len(words) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(items, '')) AS items_sha256,
       coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN k USING (doc_id) LEFT JOIN t USING (doc_id)
"""

OP12 = r"""
WITH e AS (
  SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
         list_transform(embedding, lambda x: floor(256 * CAST(x AS DOUBLE))) AS q
  FROM embeddings
  WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (
  SELECT a.vec_id AS anchor_id, o.vec_id, a.label = o.label AS same, CAST(list_dot_product(a.q, o.q) AS BIGINT) AS score
  FROM e a JOIN e o ON a.vec_id % 100 = 0 AND a.vec_id <> o.vec_id),
p AS (SELECT * FROM s WHERE same QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) <= 5),
n AS (
  SELECT p.anchor_id, p.vec_id AS positive_id, s.vec_id AS negative_id, p.score AS positive_score, s.score AS negative_score,
         row_number() OVER (PARTITION BY p.anchor_id, p.vec_id ORDER BY s.score DESC, s.vec_id) AS rank
  FROM p JOIN s ON p.anchor_id = s.anchor_id AND NOT s.same AND 80 * p.score <= 100 * s.score AND 100 * s.score <= 100 * p.score)
SELECT anchor_id, positive_id, CAST(rank AS INTEGER) AS rank, negative_id, positive_score, negative_score FROM n WHERE rank <= 5
"""

OP13 = r"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t, sha256('1:' || coalesce(CAST(doc_id AS VARCHAR), '')) AS h FROM documents),
r AS (
  SELECT doc_id, t, CAST(length(t) AS BIGINT) AS n, CAST('0x' || substr(h, 1, 8) AS BIGINT) AS h1, CAST('0x' || substr(h, 9, 8) AS BIGINT) AS h2,
         CAST('0x' || substr(h, 17, 8) AS BIGINT) AS h3, CAST('0x' || substr(h, 25, 8) AS BIGINT) AS h4
  FROM d),
f AS (
  SELECT doc_id, t, n, least(h1 % (n + 1), h2 % (n + 1)) AS a, greatest(h1 % (n + 1), h2 % (n + 1)) AS b,
         CASE WHEN t = '' OR contains(t, '<P>') OR contains(t, '<S>') OR contains(t, '<M>') OR h3 % 100 >= 90 THEN 'plain'
              WHEN h4 % 100 < 20 THEN 'spm' ELSE 'psm' END AS form
  FROM r),
c AS (SELECT *, substr(t, 1, a) AS p, substr(t, a + 1, b - a) AS m, substr(t, b + 1) AS s FROM f)
SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN a END AS prefix_chars, CASE WHEN form <> 'plain' THEN b - a END AS middle_chars,
       sha256(CASE form WHEN 'plain' THEN t WHEN 'psm' THEN concat('<P>', p, '<S>', s, '<M>', m) ELSE concat('<S>', s, '<P>', p, '<M>', m) END) AS output_sha256,
       sha256(t) AS restored_sha256
FROM c
"""

ORACLES: dict[str, str] = {
    "op2_phrase_automata": OP2, "op3_rule_ledger": OP3, "op4_stream_dedup": OP4, "op6_curriculum": OP6, "op11_ngram_screen": OP11,
    "op12_segment_bounds": OP12, "op13_fim_fenwick": OP13,
}

"""DuckDB SQL for the queries of this subpackage that SQL can express."""

_ALNUM_WORDS = r"regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"
_SPACE_WORDS = r"regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')"
_LOWER_WORDS = r"regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+')"

OP1 = f"""
WITH d AS (SELECT doc_id, {_ALNUM_WORDS} AS w FROM documents),
b AS (SELECT CAST(item_id AS VARCHAR) AS item, {_ALNUM_WORDS} AS w FROM benchmark),
bw AS (
  SELECT DISTINCT item, least(len(w), 13) AS k, array_to_string(w[i:i + least(len(w), 13) - 1], ' ') AS win
  FROM (SELECT item, w, unnest(range(1, len(w) - least(len(w), 13) + 2)) AS i FROM b WHERE len(w) > 0)),
ks AS (SELECT DISTINCT k FROM bw),
dw AS (
  SELECT doc_id, i, k, array_to_string(w[i:i + k - 1], ' ') AS win
  FROM (SELECT doc_id, w, k, unnest(range(1, len(w) - k + 2)) AS i FROM d, ks)),
hits AS (SELECT dw.doc_id, dw.i, dw.k, bw.item FROM dw JOIN bw ON dw.win = bw.win AND dw.k = bw.k),
pos AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + k)) AS p FROM (SELECT DISTINCT doc_id, i, k FROM hits)) GROUP BY doc_id),
its AS (SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS ids FROM (SELECT DISTINCT doc_id, item FROM hits) GROUP BY doc_id)
SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit,
  CAST(coalesce(n_items, 0) AS BIGINT) AS n_items, sha256(coalesce(ids, '')) AS items_sha256,
  coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated
FROM d LEFT JOIN pos USING (doc_id) LEFT JOIN its USING (doc_id)
"""

OP6 = f"""
WITH d AS (SELECT doc_id, {_SPACE_WORDS} AS w FROM documents),
win AS (SELECT doc_id, i, array_to_string(w[i:i + 12], ' ') AS g FROM (SELECT doc_id, w, unnest(range(1, len(w) - 11)) AS i FROM d)),
least AS (SELECT g, min(doc_id) AS first FROM win GROUP BY g),
gone AS (SELECT doc_id, list(DISTINCT p) AS gone FROM (SELECT win.doc_id, unnest(range(i, i + 13)) AS p FROM win JOIN least USING (g) WHERE first < win.doc_id) GROUP BY doc_id),
kept AS (SELECT d.doc_id, string_agg(x, ' ' ORDER BY i) AS t FROM (SELECT doc_id, unnest(w) AS x, unnest(range(1, len(w) + 1)) AS i FROM d) d LEFT JOIN gone USING (doc_id) WHERE gone IS NULL OR NOT list_contains(gone, i) GROUP BY d.doc_id)
SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(len(gone), 0) AS BIGINT) AS n_removed, sha256(coalesce(t, '')) AS kept_sha256
FROM d LEFT JOIN gone USING (doc_id) LEFT JOIN kept USING (doc_id)
"""

OP3 = r"""
WITH d AS (SELECT doc_id, coalesce(lang, '') AS lang, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
words AS (SELECT doc_id, lang, lower(unnest(w)) AS word FROM d),
top AS (SELECT lang, word, n, row_number() OVER (PARTITION BY lang ORDER BY n DESC, word) AS rank FROM (SELECT lang, word, count(*) AS n FROM words GROUP BY ALL) QUALIFY rank <= 16),
grams AS (SELECT doc_id, i, w[i:i + 2] AS g FROM (SELECT doc_id, w, unnest(range(1, len(w) - 1)) AS i FROM d)),
rep AS (SELECT doc_id, count(DISTINCT p) AS n FROM (SELECT doc_id, unnest(range(i, i + 3)) AS p FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, g) AS k FROM grams) WHERE k > 1) GROUP BY doc_id),
f AS (
  SELECT doc_id, lang, len(w) AS n_words, length(array_to_string(w, '')) AS word_chars, length(t) AS chars,
    len(regexp_extract_all(t, '[#*$%&|<>]')) AS n_symbols,
    len(list_filter(string_split(t, chr(10)), lambda l: regexp_matches(l, '[^\x20\x09-\x0D]'))) - len(list_distinct(list_filter(string_split(t, chr(10)), lambda l: regexp_matches(l, '[^\x20\x09-\x0D]')))) AS n_dup_lines,
    coalesce(rep.n, 0) AS n_repeat_words,
    len(regexp_extract_all(t, '[A-Z]')) AS c1, len(regexp_extract_all(t, '[0-9]')) AS c2, len(regexp_extract_all(t, '[.,;:!?''"()-]')) AS c4, len(regexp_extract_all(t, '[^\x00-\x7F]')) AS c5
  FROM d LEFT JOIN rep USING (doc_id)),
c AS (SELECT *, unnest([c1, c2, n_symbols, c4, c5, chars - word_chars, chars - c1 - c2 - n_symbols - c4 - c5 - (chars - word_chars)]) AS v, unnest(range(7)) AS k FROM f),
cs AS (SELECT doc_id, lang, k, v / chars AS p FROM c WHERE word_chars >= 200),
cr AS (SELECT lang, k, sum(v) / sum(sum(v)) OVER (PARTITION BY lang) AS q FROM c GROUP BY lang, k),
cd AS (SELECT doc_id, sqrt(greatest(sum(CASE WHEN p > 0 THEN p * log2(p / ((p + q) / 2)) ELSE 0 END + CASE WHEN q > 0 THEN q * log2(q / ((p + q) / 2)) ELSE 0 END) / 2, 0)) AS dist FROM cs JOIN cr USING (lang, k) GROUP BY doc_id),
wc AS (SELECT doc_id, rank, count(*) AS v FROM words JOIN top USING (lang, word) GROUP BY ALL),
ln AS (SELECT lang, sum(n_words) AS total FROM f GROUP BY lang),
wr AS (SELECT lang, rank, n / total AS q FROM top JOIN ln USING (lang) UNION ALL SELECT lang, 99, 1 - sum(n) / any_value(total) FROM top JOIN ln USING (lang) GROUP BY lang),
wp AS (SELECT f.doc_id, f.lang, top.rank, coalesce(v, 0) / n_words AS p FROM f JOIN top USING (lang) LEFT JOIN wc ON wc.doc_id = f.doc_id AND wc.rank = top.rank WHERE n_words >= 100),
wa AS (SELECT * FROM wp UNION ALL SELECT doc_id, lang, 99, 1 - sum(p) FROM wp GROUP BY doc_id, lang),
wd AS (SELECT doc_id, sqrt(greatest(sum(CASE WHEN p > 0 THEN p * log2(p / ((p + q) / 2)) ELSE 0 END + CASE WHEN q > 0 THEN q * log2(q / ((p + q) / 2)) ELSE 0 END) / 2, 0)) AS dist FROM wa JOIN wr USING (lang, rank) GROUP BY doc_id),
j AS (SELECT f.*, cd.dist AS cdist, wd.dist AS wdist, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS bad FROM f LEFT JOIN cd USING (doc_id) LEFT JOIN wd USING (doc_id))
SELECT doc_id, CAST(n_words AS BIGINT) AS n_words, CAST(word_chars AS BIGINT) AS word_chars, CAST(n_symbols AS BIGINT) AS n_symbols, CAST(n_dup_lines AS BIGINT) AS n_dup_lines, CAST(n_repeat_words AS BIGINT) AS n_repeat_words,
  bad AS base_failed, coalesce(round(cdist, 6), -1) AS class_distance, coalesce(round(wdist, 6), -1) AS word_distance, NOT bad AND coalesce(cdist, 0) <= 0.20 AND coalesce(wdist, 0) <= 0.30 AS kept
FROM j
"""

OP9 = """
WITH t AS (SELECT conv_id, turn, role, coalesce(text, '') AS text FROM conversations),
p AS (SELECT DISTINCT conv_id, role AS perspective FROM t WHERE role IS NOT NULL AND role NOT IN ('', 'system')),
r AS (
  SELECT t.conv_id, perspective, turn, role, text, coalesce(role = perspective, false) AS is_target,
    CASE WHEN role IS NULL OR role IN ('', 'system') THEN '<|im_start|>system' WHEN role = perspective THEN '<|im_start|>assistant' ELSE '<|im_start|>user name=' || role END || chr(10) AS head
  FROM t JOIN p ON t.conv_id IS NOT DISTINCT FROM p.conv_id)
SELECT conv_id, perspective, turn, role, head || text || '<|im_end|>' || chr(10) AS rendered, is_target,
  CAST(CASE WHEN is_target THEN length(head) ELSE -1 END AS BIGINT) AS mask_start, CAST(CASE WHEN is_target THEN length(head) + length(text) + 10 ELSE -1 END AS BIGINT) AS mask_stop, CAST(length(head) + length(text) + 11 AS BIGINT) AS n_chars
FROM r
"""

OP5 = f"""
WITH RECURSIVE d AS (SELECT doc_id, {_LOWER_WORDS} AS w FROM documents),
s AS (SELECT DISTINCT doc_id, array_to_string(w[i:i + 4], ' ') AS g FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 4, 1) + 1)) AS i FROM d WHERE len(w) > 0)),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
inter AS (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS i FROM s x JOIN s y ON x.g = y.g AND x.doc_id < y.doc_id GROUP BY ALL),
links AS (SELECT a, b FROM inter JOIN n na ON na.doc_id = a JOIN n nb ON nb.doc_id = b WHERE 100 * i >= 75 * (na.n + nb.n - i)),
twoway AS (SELECT a, b FROM links UNION ALL SELECT b, a FROM links),
reach AS (SELECT doc_id AS id, doc_id AS node FROM d UNION SELECT id, b FROM reach JOIN twoway ON node = a)
SELECT d.doc_id, CAST(coalesce(n.n, 0) AS BIGINT) AS n_shingles, m.component_id
FROM d LEFT JOIN n USING (doc_id) JOIN (SELECT id AS doc_id, min(node) AS component_id FROM reach GROUP BY id) m USING (doc_id)
"""

OP12 = f"""
WITH lab AS (SELECT doc_id, max(CAST(quality = 1 AS INT)) AS good, max(CAST(toxic = 1 AS INT)) AS toxic FROM labels WHERE doc_id IS NOT NULL GROUP BY doc_id),
d AS (SELECT doc_id, coalesce(lang, '') AS part, coalesce(text, '') AS t, {_SPACE_WORDS} AS w FROM documents),
f AS (
  SELECT part, coalesce(good, 0) AS good, coalesce(toxic, 0) AS toxic,
    [len(w) < 100, 100 * len(list_distinct(w)) < 80 * len(w), 100 * len(regexp_extract_all(t, '[A-Z]')) > 10 * length(t), regexp_matches(t, '[#$%&*|]'),
     coalesce(d.doc_id > min(d.doc_id) OVER (PARTITION BY t), false)] AS fails
  FROM d LEFT JOIN lab USING (doc_id)),
l AS (SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS x),
o AS (SELECT a.x || b.x || c.x || d.x || e.x AS filter_order FROM l a, l b, l c, l d, l e WHERE len(list_distinct([a.x, b.x, c.x, d.x, e.x])) = 5),
m AS (SELECT part, fails, count(*) AS n, sum(good) AS good, sum(toxic) AS toxic FROM f GROUP BY part, fails),
s AS (SELECT part, filter_order, step, substr(filter_order, step, 1) AS filter, fails, n, good, toxic, fails[ascii(substr(filter_order, step, 1)) - 64] AS bad,
    len(list_filter(range(1, step + 1), lambda k: fails[ascii(substr(filter_order, k, 1)) - 64])) AS so_far, len(list_filter(fails, lambda x: x)) AS in_all
  FROM m, o, (SELECT unnest(range(1, 6)) AS step)),
r AS (
  SELECT part, filter_order, step, filter, CAST(sum(CASE WHEN so_far = 0 THEN n ELSE 0 END) AS BIGINT) AS kept, CAST(sum(CASE WHEN bad AND so_far = 1 THEN n ELSE 0 END) AS BIGINT) AS removed,
    CAST(sum(CASE WHEN bad AND so_far > 1 THEN n ELSE 0 END) AS BIGINT) AS redundant, CAST(sum(CASE WHEN bad AND in_all = 1 THEN n ELSE 0 END) AS BIGINT) AS unique_fails,
    CAST(sum(CASE WHEN bad AND so_far = 1 THEN good ELSE 0 END) AS BIGINT) AS good_lost, CAST(sum(CASE WHEN bad AND so_far = 1 THEN toxic ELSE 0 END) AS BIGINT) AS toxic_lost
  FROM s GROUP BY ALL)
SELECT part, filter_order, CAST(step AS INT) AS step, kept, removed, redundant, unique_fails, good_lost, toxic_lost, CAST(sum(removed) OVER (PARTITION BY part, filter) AS BIGINT) AS shapley FROM r
"""

OP11 = """
WITH v AS (
  SELECT vec_id AS id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, list_transform(embedding, lambda x: floor(256 * CAST(x AS DOUBLE))) AS vec
  FROM embeddings WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT a.id AS anchor_id, v.id, a.label = v.label AS same, CAST(list_dot_product(a.vec, v.vec) AS BIGINT) AS score FROM v a JOIN v ON a.id <> v.id WHERE a.id % 100 = 0),
p AS (SELECT anchor_id, id AS positive_id, score AS positive_score FROM s WHERE same QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, id) <= 5)
SELECT p.anchor_id, positive_id, CAST(row_number() OVER (PARTITION BY p.anchor_id, positive_id ORDER BY score DESC, id) AS INT) AS rank, id AS negative_id, positive_score, score AS negative_score
FROM p JOIN s ON s.anchor_id = p.anchor_id AND NOT same AND 80 * positive_score <= 100 * score AND 100 * score <= 100 * positive_score
QUALIFY rank <= 5
"""

SQL = {"op11_hard_negatives": OP11, "op12_filter_audit": OP12, "op5_ngram_jaccard_join": OP5, "op3_quality_rules": OP3, "op9_chat_rotation": OP9, "op6_substring_dedup": OP6, "op1_decontaminate": OP1}

"""DuckDB SQL of the queries on raw transcripts, frames, paths, zipped streams and signals."""

REBUILT = r"""
WITH RECURSIVE raw AS (
  SELECT conv_id AS k, turn * 100000 + unnest(range(len(lines))) AS ln, unnest(lines) AS line FROM (
    SELECT conv_id, turn, list_concat(CASE role WHEN 'user' THEN ['US:'] WHEN 'assistant' THEN ['AS:'] ELSE CAST([] AS VARCHAR[]) END, flatten(list_transform(regexp_split_to_array(text, '[,\n]'), lambda x, i: list_concat(list_concat(
      CASE WHEN i > 1 AND (i - 1 + turn) % 3 = 0 THEN [''] ELSE CAST([] AS VARCHAR[]) END, CASE WHEN (i - 1) % 7 = 5 THEN [CAST(i - 1 AS VARCHAR)] ELSE CAST([] AS VARCHAR[]) END), list_concat(
      CASE WHEN i = 3 AND turn % 3 = 1 THEN ['Tape II', '00:0' || (turn % 10) || ':15'] ELSE CAST([] AS VARCHAR[]) END, [CASE WHEN (i - 1) % 5 = 1 THEN x || ' [note] ' ELSE x END]))))) AS lines FROM conversations)),
s AS (SELECT k, ln, regexp_replace(line, '^\s+|\s+$', '', 'g') AS line FROM raw),
cl AS (SELECT *, CASE WHEN regexp_matches(line, '^Tape\s+(I|II|III|IV)$') THEN 'tape' WHEN regexp_matches(line, '^\d\d:\d\d:\d\d$') THEN 'clock' END AS c FROM s),
cb AS (SELECT *, last_value(c IGNORE NULLS) OVER (PARTITION BY k ORDER BY ln ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS pc, last_value(CASE WHEN c = 'tape' THEN regexp_extract(line, '(I|II|III|IV)$') END IGNORE NULLS) OVER (PARTITION BY k ORDER BY ln ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS roman FROM cl),
kd AS (SELECT *, CASE WHEN line = '' THEN 'blank' WHEN line IN ('US:', 'AS:') THEN 'tag' WHEN c = 'tape' THEN 'tape' WHEN c = 'clock' AND pc = 'tape' THEN 'clock' WHEN regexp_matches(line, '^[0-9]{1,3}$') THEN 'furniture' ELSE 'text' END AS kind FROM cb),
mk AS (SELECT *, count(*) FILTER (WHERE kind = 'clock') OVER (PARTITION BY k ORDER BY ln) - 1 AS m FROM kd),
se AS (SELECT *, max(CASE WHEN kind = 'text' THEN ln END) OVER b AS tx, max(CASE WHEN kind = 'tag' THEN ln END) OVER b AS tg, max(CASE WHEN kind = 'clock' THEN ln END) OVER b AS ck, last_value(CASE WHEN kind = 'tag' THEN line[1:2] END IGNORE NULLS) OVER b AS sp, lag(kind) OVER (PARTITION BY k ORDER BY ln) AS pk FROM mk WINDOW b AS (PARTITION BY k ORDER BY ln ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
tx AS MATERIALIZED (SELECT k, row_number() OVER (PARTITION BY k ORDER BY ln) AS r, ln, sp, tg IS NOT NULL AND (tx IS NULL OR tg > tx) AS opens, coalesce(pk <> 'blank', false) AS wraps, regexp_matches(line, '[.?!–"'']\s*$') AS ended, CASE WHEN ck IS NOT NULL AND (tx IS NULL OR ck > tx) THEN chr(1) || m || chr(1) || ' ' ELSE '' END || line AS chunk FROM se WHERE kind = 'text'),
fold AS (
  SELECT DISTINCT k, CAST(0 AS BIGINT) AS r, CAST([] AS INT[]) AS open, 0 AS n, -1 AS at_turn FROM tx
  UNION ALL
  SELECT k, r, CASE WHEN ended THEN list_filter(open, lambda x: x <> a) ELSE list_sort(list_distinct(list_append(open, a))) END, CASE WHEN opens OR n = 0 THEN n + 1 ELSE n END, a FROM (
    SELECT t.k, t.r, open, n, opens, ended, CASE WHEN opens OR n = 0 THEN n WHEN wraps OR len(open) = 0 THEN n - 1 ELSE open[1] END AS a FROM fold JOIN tx t ON t.k = fold.k AND t.r = fold.r + 1)),
ts AS (SELECT f.k, at_turn AS turn, CASE WHEN arg_min(opens, ln) THEN arg_min(sp, ln) END AS sp, string_agg(chunk, ' ' ORDER BY ln) AS t FROM fold f JOIN tx USING (k, r) GROUP BY f.k, at_turn),
rp AS MATERIALIZED (SELECT k, turn, CASE sp WHEN 'US' THEN 'SUBJECT' WHEN 'AS' THEN 'INTERVIEWER' ELSE '' END AS speaker, trim(regexp_replace(regexp_replace(replace(replace(t, 'thth', 'th'), 'tiontion', 'tion'), '\[[^\]]*\]\s*', '', 'g'), '\s+', ' ', 'g')) AS t FROM ts),
full_text AS (SELECT k, string_agg(t, ' ' ORDER BY turn) AS flat FROM rp WHERE t <> '' GROUP BY k)"""

PIECES = r"string_split(replace(coalesce(text, ''), chr(65279), ''), chr(10))"

ORACLES = {
    "rebuilt_turns": REBUILT + r" SELECT k AS conv_id, turn, speaker, trim(regexp_replace(t, '\s*\x01[0-9]+\x01\s*', ' ', 'g')) AS text FROM rp WHERE trim(regexp_replace(t, '\s*\x01[0-9]+\x01\s*', ' ', 'g')) <> ''",
    "tape_marks": REBUILT + r""" SELECT k AS conv_id, m AS mark, CAST(list_position(['I', 'II', 'III', 'IV'], roman) AS INT) AS tape, CAST(line[1:2] AS INT) * 3600 + CAST(line[4:5] AS INT) * 60 + CAST(line[7:8] AS INT) AS tape_seconds,
  coalesce(CASE WHEN contains(flat, chr(1) || m || chr(1)) THEN array_to_string(list_filter(regexp_split_to_array(regexp_replace(flat[instr(flat, chr(1) || m || chr(1)) + length(chr(1) || m || chr(1)):], '\x01[0-9]+\x01', ' ', 'g'), '\s+'), lambda x: x <> '')[1:14], ' ') END, '') AS following_text
  FROM mk LEFT JOIN full_text USING (k) WHERE kind = 'clock'""",
    "clean_truth": rf"""WITH a AS (SELECT doc_id, {PIECES} AS l FROM documents),
b AS (SELECT doc_id, l, list_transform(l, lambda x: regexp_replace(x, '^Th[a-z]* ', '')) AS l1 FROM a), c AS (SELECT *, list_transform(l1, lambda x: regexp_replace(x, '[0-9]+$', '')) AS l2 FROM b),
d AS (SELECT doc_id, len(list_filter(range(1, len(l) + 1), lambda i: l[i] <> l1[i])) + len(list_filter(range(1, len(l) + 1), lambda i: l1[i] <> l2[i])) AS cuts, list_filter(list_transform(l2, lambda x: regexp_replace(x, '^\s+|\s+$', '', 'g')), lambda x: x <> '') AS s FROM c),
e AS (SELECT *, list_transform(s, lambda x: CASE WHEN regexp_matches(x, '^[0-9]{{1,3}}$') THEN 0 WHEN regexp_matches(x, '^[A-Za-z.]{{1,12}}$') THEN 1 WHEN regexp_matches(x, '[Ll]icen[sc]e') THEN 2 ELSE -1 END) AS why FROM d),
f AS (SELECT doc_id, cuts, why, array_to_string(list_filter(s, lambda x, i: why[i] < 0), ' ') AS t FROM e),
g AS (SELECT *, regexp_replace(t, '\{{[^}}]*\}}', '', 'g') AS t1 FROM f), h AS (SELECT *, replace(t1, 'tionti', 'tion ti') AS t2 FROM g)
SELECT doc_id, trim(regexp_replace(replace(t2, 'ofof ', 'of '), '\s+', ' ', 'g')) AS text,
  'cuts=' || cuts || ';page number=' || len(list_filter(why, lambda x: x = 0)) || ';debris=' || len(list_filter(why, lambda x: x = 1)) || ';license=' || len(list_filter(why, lambda x: x = 2)) || ';stage directions=' || len(regexp_extract_all(t, '\{{[^}}]*\}}')) || ';repairs=' || len(regexp_extract_all(t1, 'tionti')) || ';more repairs=' || len(regexp_extract_all(t2, 'ofof ')) AS counts FROM h""",
    "speech_segments": """WITH f AS (SELECT vec_id // 40 AS recording, 11000 - (vec_id // 40) % 3 * 200 AS total, row_number() OVER (PARTITION BY vec_id // 40 ORDER BY vec_id) - 1 AS n, NOT (embedding[1] > embedding[2] AND embedding[1] > embedding[3]) AS said FROM embeddings),
g AS (SELECT *, n - row_number() OVER (PARTITION BY recording ORDER BY n) AS run, n = max_n AS last FROM (SELECT *, max(n) OVER (PARTITION BY recording) AS max_n FROM f) WHERE said)
SELECT recording, round((721 + 270 * min(n)) / 16000, 7) AS start, round(CASE WHEN bool_or(last) THEN greatest(any_value(total), 721 + 270 * min(n)) ELSE 721 + 270 * (max(n) + 1) END / 16000, 7) AS "end" FROM g GROUP BY recording, run""",
    "interview_paths": "WITH c AS (SELECT conv_id AS number, printf('st%d_%d', conv_id, turn) AS statement, role, turn * 10.0::DOUBLE AS start_time FROM conversations) SELECT number, statement, start_time, printf('p%d_%s', number, role) AS person FROM c WHERE role = 'user'",
    "zipped_embeddings": "SELECT vec_id // 8 AS request, printf('st%d', vec_id) AS uid, round(embedding[1]::DOUBLE, 6) AS first FROM embeddings",
    "signal_offsets": "SELECT signal, signal * 37 % 200 AS lag, CAST(64 * n AS INT) AS overlap, 1.0::DOUBLE AS correlation FROM (SELECT vec_id // 25 AS signal, count(*) AS n FROM embeddings GROUP BY 1)",
}

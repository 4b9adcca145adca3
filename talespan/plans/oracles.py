"""DuckDB SQL for the archive queries."""

from talespan.plans import roster_sql, scoring_sql, search_sql, transcript_sql

STATEMENTS = "SELECT conv_id AS interview, printf('st%d_%d', conv_id, turn) AS uid, role AS speaker, text, turn * 10.0::DOUBLE AS start_time, turn * 10.0::DOUBLE + least(12.0::DOUBLE, 1.0::DOUBLE + length(text) / 20.0::DOUBLE) AS end_time, turn FROM conversations"
TICKS = "SELECT event_id, user_id, event_type, value, CAST(floor(epoch_us(ts) / 1000000) AS BIGINT) - 1704067200 AS t, row_number() OVER (PARTITION BY user_id ORDER BY CAST(floor(epoch_us(ts) / 1000000) AS BIGINT), event_id) AS seq FROM events"
WORDS = "SELECT doc_id, len(w) AS n, unnest(range(len(w))) AS idx, unnest(w) AS word FROM (SELECT doc_id, string_split(text, ' ') AS w FROM documents)"
TURN_PAIRS = "SELECT a.conv_id, a.turn, string_split(lower(a.text), ' ') AS truth, string_split(lower(b.text), ' ') AS heard FROM conversations a JOIN conversations b ON a.conv_id = b.conv_id AND b.turn = a.turn + 1"
SIDES = f"p AS ({TURN_PAIRS}), tt AS (SELECT conv_id, turn, unnest(range(len(truth))) AS idx, unnest(truth) AS truth FROM p), hh AS (SELECT conv_id, turn, unnest(range(len(heard))) AS idx, unnest(heard) AS heard FROM p)"
TEXT_SCORES = """
t AS (SELECT doc_id, list_filter(regexp_split_to_array(lower(text), '[^a-z]+'), lambda x: x <> '') AS terms FROM documents),
st AS (SELECT count(*) AS n, avg(len(terms)) AS mean FROM t),
post AS (SELECT doc_id, term, count(*) AS tf, any_value(l) AS l FROM (SELECT doc_id, len(terms) AS l, unnest(terms) AS term FROM t) WHERE term IN ('the', 'that', 'nicht', 'pour', 'para') GROUP BY doc_id, term),
df AS (SELECT term, count(*) AS df FROM post GROUP BY term),
ts AS (SELECT doc_id, round(sum(ln(1 + (n - df + 0.5) / (df + 0.5)) * tf * 2.2 / (tf + 1.2 * (1 - 0.75 + 0.75 * l / mean))), 6) AS score FROM post JOIN df USING (term), st GROUP BY doc_id)"""
VECTOR_SCORES = "vs AS (SELECT e.vec_id, round(1 - least(greatest(1 - list_dot_product(e.embedding::DOUBLE[], q.embedding::DOUBLE[]) / (sqrt(list_dot_product(e.embedding::DOUBLE[], e.embedding::DOUBLE[])) * sqrt(list_dot_product(q.embedding::DOUBLE[], q.embedding::DOUBLE[]))), 0), 2), 6) AS score FROM embeddings e, (SELECT embedding FROM embeddings WHERE vec_id = 7) q)"
ROSTER = "r AS (SELECT doc_id, grp FROM documents, (VALUES ('North', 'thtion'), ('East', 'keit'), ('South', 'ment'), ('West', 'ciones')) g(grp, p) WHERE contains(text, p))"

ORACLES = {
    "hybrid_wrrf": f"""WITH {TEXT_SCORES}, {VECTOR_SCORES},
a AS (SELECT doc_id AS id, row_number() OVER (ORDER BY score DESC, doc_id) AS rank FROM ts QUALIFY rank <= 100), b AS (SELECT vec_id AS id, row_number() OVER (ORDER BY score DESC, vec_id) AS rank FROM vs QUALIFY rank <= 100)
SELECT id, round(sum(part), 8) AS wrrf FROM (SELECT id, 1.0::DOUBLE / (60 + rank) AS part FROM a UNION ALL SELECT id, 0.8::DOUBLE / (60 + rank) FROM b) GROUP BY id ORDER BY wrrf DESC, id LIMIT 15""",
    "text_score_topk": f"WITH {TEXT_SCORES} SELECT doc_id, score, row_number() OVER (ORDER BY score DESC, doc_id) AS rank FROM ts QUALIFY rank <= 100",
    "vector_topk": f"WITH {VECTOR_SCORES} SELECT vec_id, score, row_number() OVER (ORDER BY score DESC, vec_id) AS rank FROM vs QUALIFY rank <= 100",
    "transcript_view": f"SELECT interview, uid, round(start_time, 3) AS start_time, round(end_time, 3) AS end_time, CASE WHEN speaker <> 'system' THEN 'p_' || speaker || '_' || interview ELSE '' END AS person FROM ({STATEMENTS})",
    "interviews_first5": "SELECT DISTINCT conv_id AS number, printf('iv%d', conv_id) AS uid, CAST(DATE '2020-01-01' + CAST(conv_id % 365 AS INTEGER) AS VARCHAR) AS date FROM conversations ORDER BY date, number LIMIT 5",
    "interview_lookup": "SELECT DISTINCT conv_id AS number, printf('iv%d', conv_id) AS uid, CAST(DATE '2020-01-01' + CAST(conv_id % 365 AS INTEGER) AS VARCHAR) AS date FROM conversations WHERE conv_id = 7",
    "span_at_time": f"WITH s AS ({STATEMENTS}), i AS (SELECT DISTINCT conv_id AS interview, unnest([0.5, 10.5, 21.75, 500.0])::DOUBLE AS t FROM (SELECT DISTINCT conv_id FROM conversations)) SELECT interview, t, arg_max(uid, (start_time, uid)) AS uid FROM i JOIN s USING (interview) WHERE start_time <= t AND end_time >= t GROUP BY ALL",
    "statement_text_match": f"SELECT interview, uid, start_time FROM ({STATEMENTS}) WHERE contains(text, 'tion')",
    "captions_vtt": f"WITH s AS ({STATEMENTS}), m AS (SELECT *, CAST(floor(round(start_time * 1000, 3)) AS BIGINT) AS a, greatest(CAST(floor(round(end_time * 1000, 3)) AS BIGINT) - 1, 0) AS b FROM s) SELECT interview, uid, uid || chr(10) || printf('%02d:%02d:%02d.%03d', a // 3600000, a // 60000 % 60, a // 1000 % 60, a % 1000) || ' --> ' || printf('%02d:%02d:%02d.%03d', b // 3600000, b // 60000 % 60, b // 1000 % 60, b % 1000) || chr(10) || text || chr(10) AS cue FROM m",
    "dominant_speaker": f"WITH t AS ({TICKS}), sp AS (SELECT user_id, event_type AS speaker, t AS a, lead(t) OVER (PARTITION BY user_id ORDER BY seq) AS b FROM t), c AS (SELECT DISTINCT user_id, t // 21600 AS segment FROM t), o AS (SELECT c.user_id, segment, speaker, sum(least(b, segment * 21600 + 21600) - greatest(a, segment * 21600)) AS total FROM c JOIN sp ON c.user_id = sp.user_id AND a < segment * 21600 + 21600 AND b > segment * 21600 AND b > a GROUP BY ALL), r AS (SELECT *, row_number() OVER (PARTITION BY user_id, segment ORDER BY total DESC, speaker) AS rn FROM o) SELECT user_id, segment, coalesce(speaker, '') AS speaker, CAST(coalesce(total, 0) AS BIGINT) AS total FROM c LEFT JOIN (SELECT * FROM r WHERE rn = 1) USING (user_id, segment)",
    "change_boundaries": f"SELECT user_id, t, before, event_type FROM (SELECT *, lag(event_type) OVER (PARTITION BY user_id ORDER BY seq) AS before FROM ({TICKS})) WHERE before <> event_type",
    "boundary_recall": f"WITH t AS (SELECT *, value > 50 AS high FROM ({TICKS})), l AS (SELECT *, lag(event_type) OVER (PARTITION BY user_id ORDER BY seq) AS be, lag(high) OVER (PARTITION BY user_id ORDER BY seq) AS bh FROM t), r AS (SELECT DISTINCT user_id, t FROM l WHERE be <> event_type), g AS (SELECT user_id, t AS m FROM l WHERE bh <> high) SELECT user_id, count(*) AS total, count(*) FILTER (WHERE EXISTS (SELECT 1 FROM g WHERE g.user_id = r.user_id AND abs(g.m - r.t) <= 3600)) AS detected FROM r GROUP BY user_id",
    "pairwise_diagnostic": "WITH e AS (SELECT vec_id, label, embedding::DOUBLE[] AS v, vec_id // 40 AS recording FROM embeddings) SELECT a.recording, a.label = b.label AS same, count(*) AS pairs, round(avg(least(greatest(1 - list_dot_product(a.v, b.v) / (sqrt(list_dot_product(a.v, a.v)) * sqrt(list_dot_product(b.v, b.v))), 0), 2)), 6) AS mean_distance FROM e a JOIN e b ON a.recording = b.recording AND a.vec_id < b.vec_id GROUP BY ALL",
    "speech_islands": f"WITH t AS ({TICKS}), o AS (SELECT *, seq - row_number() OVER (PARTITION BY user_id ORDER BY seq) AS g FROM t WHERE event_type <> 'view') SELECT user_id, min(seq) AS first, max(seq) AS last, count(*) AS frames FROM o GROUP BY user_id, g",
    "timeline_remap": "WITH c AS (SELECT DISTINCT conv_id, turn FROM conversations), r AS (SELECT conv_id, turn * 20.0::DOUBLE AS o, turn * 5.0::DOUBLE + 1 AS f FROM c), p AS (SELECT DISTINCT conv_id, unnest([0.5, 2.5, 4.75, 7.25, 99.0])::DOUBLE AS t FROM (SELECT DISTINCT conv_id FROM c)), x AS (SELECT p.conv_id, p.t, max(f) AS f FROM p LEFT JOIN r ON p.conv_id = r.conv_id AND f <= t GROUP BY ALL) SELECT x.conv_id, x.t, coalesce(r.o + least(x.t - x.f, 3.0::DOUBLE), (SELECT arg_min(o, f) FROM r r2 WHERE r2.conv_id = x.conv_id)) AS original FROM x LEFT JOIN r ON r.conv_id = x.conv_id AND r.f = x.f",
    "word_end_lead": f"SELECT doc_id, count(*) AS n, round(sum(greatest(idx * 0.5::DOUBLE, coalesce(nxt, n * 0.5::DOUBLE)) * (idx % 3 + 1)), 3) AS weighted_ends FROM (SELECT *, lead(idx * 0.5::DOUBLE) OVER (PARTITION BY doc_id ORDER BY idx) AS nxt FROM ({WORDS})) GROUP BY doc_id",
    "word_time_carry": f"SELECT doc_id, round(sum(greatest(coalesce(m, 0.25::DOUBLE), 0.25::DOUBLE) * (idx % 3 + 1)), 3) AS weighted_starts FROM (SELECT *, max(CASE WHEN idx % 7 <> 3 THEN idx * 0.5::DOUBLE - (idx % 5) * 0.25::DOUBLE END) OVER (PARTITION BY doc_id ORDER BY idx) AS m FROM ({WORDS})) GROUP BY doc_id",
    "drift_fit": "WITH p AS (SELECT o_custkey % 10 AS tape, o_orderkey, o_orderkey / 100.0::DOUBLE AS x, CASE WHEN o_orderkey % 7 <> 0 THEN o_totalprice / 1000.0::DOUBLE END AS y FROM orders), f AS (SELECT tape, regr_slope(y, x) AS s, regr_intercept(y, x) AS c FROM p WHERE y IS NOT NULL GROUP BY tape) SELECT o_orderkey, round(s, 6) AS slope, coalesce(round(y - (s * x + c), 4), -999) AS residual FROM p JOIN f USING (tape)",
    "structure_stats": f"WITH s AS (SELECT *, end_time - start_time AS l FROM ({STATEMENTS})) SELECT interview, count(*) AS segments, count(*) FILTER (WHERE l <= 0) AS no_duration, count(*) FILTER (WHERE contains(text, '[_')) AS control, count(*) FILTER (WHERE l > greatest(2.0, length(text) / 4.0)) AS too_long, list_sort(list(round(l, 6)))[count(*) // 2 + 1] AS upper_median, round(avg(CASE WHEN least(start_time % 30, 30 - start_time % 30) < 0.1 THEN 1.0 ELSE 0.0 END), 6) AS on_grid FROM s GROUP BY interview",
    "lexicon_recall": "WITH t AS (SELECT doc_id, unnest(list_filter(regexp_split_to_array(lower(text), '[^a-z]+'), lambda x: x <> '')) AS term FROM documents), c AS (SELECT term, count(*) FILTER (WHERE doc_id % 2 = 0) AS expected, count(*) FILTER (WHERE doc_id % 2 = 1) AS heard FROM t GROUP BY term) SELECT term, pos, expected, least(heard, expected) AS found, expected - least(heard, expected) AS missed FROM c JOIN (VALUES (0, 'the'), (1, 'that'), (2, 'nicht'), (3, 'pour'), (4, 'para'), (5, 'tion'), (6, 'zzzz')) v(pos, term) USING (term) WHERE expected > 0",
    "diagonal_votes": f"WITH {SIDES}, rare AS (SELECT * FROM tt QUALIFY count(*) OVER (PARTITION BY conv_id, turn, truth) <= 4), v AS (SELECT rare.conv_id, rare.turn, rare.idx - hh.idx AS off, count(*) AS votes FROM rare JOIN hh ON rare.conv_id = hh.conv_id AND rare.turn = hh.turn AND truth = heard GROUP BY ALL), pl AS (SELECT *, CAST(sum(votes) OVER (PARTITION BY conv_id, turn ORDER BY off RANGE BETWEEN 2 PRECEDING AND 2 FOLLOWING) AS BIGINT) AS pooled FROM v) SELECT conv_id, turn, off AS \"offset\", votes, pooled FROM pl QUALIFY row_number() OVER (PARTITION BY conv_id, turn ORDER BY pooled DESC, abs(off), off) = 1",
    "speaker_boundaries": f"WITH w AS (SELECT doc_id, idx AS pos, idx // 11 AS speaker, CASE WHEN length(word) % 3 > 0 THEN idx // 7 END AS seg FROM ({WORDS})), r AS (SELECT *, lag(speaker) OVER o AS was, last_value(seg IGNORE NULLS) OVER (PARTITION BY doc_id ORDER BY pos ROWS BETWEEN 25 PRECEDING AND 1 PRECEDING) AS lo, first_value(seg IGNORE NULLS) OVER (PARTITION BY doc_id ORDER BY pos ROWS BETWEEN CURRENT ROW AND 24 FOLLOWING) AS hi FROM w WINDOW o AS (PARTITION BY doc_id ORDER BY pos)) SELECT doc_id, count(*) AS changes, count(*) FILTER (WHERE hi > lo) AS covered FROM r WHERE was <> speaker AND lo IS NOT NULL AND hi IS NOT NULL GROUP BY doc_id",
    "topic_rank": "SELECT doc_id, count(*) AS hits FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS line FROM documents) WHERE regexp_matches(line, '(?i)thtion|nicht|queque') GROUP BY doc_id ORDER BY hits DESC, doc_id LIMIT 40",
    "group_roster": f"WITH {ROSTER} SELECT doc_id, grp FROM r",
    "bridges": f"WITH {ROSTER} SELECT doc_id, count(*) AS n_groups, string_agg(grp, ', ' ORDER BY grp) AS groups FROM r GROUP BY doc_id HAVING count(*) > 1",
    "sticky_speaker": r"""WITH l AS (SELECT conv_id, turn * 1000 + p AS line_no, CASE WHEN p = 0 AND role = 'user' THEN 'US: ' WHEN p = 0 AND role = 'assistant' THEN 'AS: ' ELSE '' END || line AS line FROM (SELECT conv_id, turn, role, unnest(string_split(text, chr(10))) AS line, unnest(range(len(string_split(text, chr(10))))) AS p FROM conversations)),
t AS (SELECT conv_id, line_no, trim(replace(line, chr(13), ''), ' ' || chr(9)) AS line FROM l),
k AS (SELECT * FROM t WHERE line <> '' AND NOT regexp_matches(line, 'Interview[ \t]+[0-9]+[ \t]*$') AND NOT regexp_matches(line, '^(January|February|March|April|May|June|July|August|September|October|November|December)[ \t]+[0-9]{1,2},?[ \t]*[0-9]{4}[ \t]*[0-9]*[ \t]*$') AND NOT regexp_matches(line, '^[0-9]{1,3}$') AND NOT regexp_matches(line, '^Tape[ \t]+[IVX0-9]+[ \t]*$') AND NOT regexp_matches(line, '^(Interview of|A Program of)')),
b AS (SELECT conv_id, line_no, regexp_replace(line, '^Tape[ \t]+[IVX]+[ \t]+', '') AS line FROM k),
g AS (SELECT conv_id, line_no, nullif(regexp_extract(line, '^([A-Z]{2,3}):[ \t]*', 1), '') AS tag, regexp_replace(line, '^([A-Z]{2,3}):[ \t]*', '') AS line FROM b),
s AS (SELECT *, coalesce(last_value(tag IGNORE NULLS) OVER (PARTITION BY conv_id ORDER BY line_no), '?') AS speaker FROM g)
SELECT conv_id, line_no, row_number() OVER (PARTITION BY conv_id ORDER BY line_no) AS seq, speaker, lower(line) AS line FROM s WHERE line <> ''""",
    "timecode_interp": f"""WITH t AS (SELECT user_id, seq, CASE WHEN event_id % 5 = 0 THEN (t // 60 % 7200)::DOUBLE END AS clock FROM ({TICKS})),
m AS (SELECT *, lag(clock) OVER (PARTITION BY user_id ORDER BY seq) AS pre FROM t WHERE clock IS NOT NULL),
a AS (SELECT user_id, seq, clock + sum(CASE WHEN clock < pre THEN pre + 300 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY seq) AS sec, row_number() OVER (PARTITION BY user_id ORDER BY seq) AS up, row_number() OVER (PARTITION BY user_id ORDER BY seq DESC) AS down FROM m),
e AS (SELECT user_id, max(CASE WHEN up = 2 THEN seq END) - max(CASE WHEN up = 1 THEN seq END) AS head, max(CASE WHEN down = 1 THEN seq END) - max(CASE WHEN down = 2 THEN seq END) AS tail FROM a GROUP BY user_id),
x AS (SELECT t.user_id, t.seq, max(a.seq) FILTER (WHERE a.seq <= t.seq) AS po, min(a.seq) FILTER (WHERE a.seq >= t.seq) AS no FROM t LEFT JOIN a ON a.user_id = t.user_id GROUP BY ALL)
SELECT x.user_id, x.seq, CAST(trunc(CASE WHEN po IS NULL AND no IS NULL THEN -1 WHEN po IS NULL THEN greatest(n.sec - (no - x.seq) * 300.0::DOUBLE / coalesce(head, 60), 0) WHEN no IS NULL THEN p.sec + (x.seq - po) * 300.0::DOUBLE / coalesce(tail, 60) WHEN no = po THEN p.sec ELSE p.sec + (x.seq - po) * (n.sec - p.sec) / (no - po) END) AS BIGINT) AS seconds
FROM x LEFT JOIN a p ON p.user_id = x.user_id AND p.seq = po LEFT JOIN a n ON n.user_id = x.user_id AND n.seq = no LEFT JOIN e ON e.user_id = x.user_id""",
    "stem_antijoin": r"WITH s AS (SELECT page_id, trim(regexp_replace(regexp_replace(regexp_replace(url, '^https?://', ''), '\.(mp4|mov|m4v|mkv|avi|wav|mp3)$', '', 'i'), '[^A-Za-z0-9]+', '_', 'g'), '_') AS stem FROM pages) SELECT page_id, stem FROM s WHERE stem NOT IN (SELECT stem FROM s WHERE page_id % 3 <> 0)",
    "best_download": "SELECT l_orderkey, arg_max(CAST(l_linenumber AS VARCHAR), (l_returnflag = 'R', l_quantity, l_extendedprice, CAST(l_linenumber AS VARCHAR))) AS link FROM lineitem GROUP BY l_orderkey",
    "low_conf_windows": f"WITH w AS (SELECT doc_id, idx, word, ((length(word) * 7 + idx) % 100) / 100.0::DOUBLE <= 0.05 AS low FROM ({WORDS})), f AS (SELECT doc_id, min(idx) AS spot FROM w WHERE low GROUP BY doc_id) SELECT doc_id, string_agg(CASE WHEN idx = spot THEN '«' || word || '»' ELSE word END, ' ' ORDER BY idx) AS context FROM w JOIN f USING (doc_id) WHERE idx BETWEEN spot - 3 AND spot + 3 GROUP BY doc_id",
    "collapse_repeats": f"SELECT doc_id, CAST(count(*) AS INTEGER) AS n, CAST(count(*) FILTER (WHERE pre IS DISTINCT FROM lower(word)) AS INTEGER) AS n_kept FROM (SELECT *, lag(lower(word)) OVER (PARTITION BY doc_id ORDER BY idx) AS pre FROM ({WORDS})) GROUP BY doc_id",
    "ingest_statements": f"WITH s AS (SELECT interview, CAST(row_number() OVER (PARTITION BY interview ORDER BY turn) - 1 AS INTEGER) AS pos, CASE WHEN speaker = 'system' THEN 'SPEAKER_??' ELSE speaker END AS speaker, text FROM ({STATEMENTS})) SELECT interview, pos, substring(sha256(interview || '|' || pos || '|' || text), 1, 12) AS uid, speaker, text FROM s",
    "upsert_parts": "SELECT p_partkey, p_name, CASE WHEN p_partkey % 3 = 0 THEN p_size + 100 ELSE p_size END AS p_size FROM part WHERE p_partkey % 3 = 0 OR p_partkey % 4 <> 0",
    "embedding_parameters": "WITH w AS (SELECT doc_id, list_filter(regexp_split_to_array(lower(text), '[^\\p{L}\\p{M}\\p{N}]+'), lambda x: x <> '')[1:3] AS w FROM documents) SELECT doc_id, coalesce(w[1], '') || coalesce(replace(upper(w[2][1]), 'ẞ', 'SS') || w[2][2:], '') || coalesce(replace(upper(w[3][1]), 'ẞ', 'SS') || w[3][2:], '') AS name FROM w",
    "mean_to_mono": "SELECT l_orderkey, (l_linenumber - 1) // 2 AS frame, avg(l_quantity) AS value FROM lineitem GROUP BY ALL HAVING count(*) = 2",
    "event_windows": "SELECT time_bucket(INTERVAL '1 hour', ts) AS window_start, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY ALL",
    "vad_regions": "WITH c AS (SELECT DISTINCT conv_id, turn FROM conversations), s AS (SELECT conv_id, turn, least(turn * 4.0::DOUBLE + 0.25, 25) AS a, turn * 4.0::DOUBLE + 2.5 + CASE WHEN lead(turn) OVER (PARTITION BY conv_id ORDER BY turn) IS NULL THEN 0 ELSE 0.1::DOUBLE END AS e FROM c), n AS (SELECT conv_id, turn, a, floor(least(greatest(e, a), 25) * 16000) - floor(a * 16000) AS k FROM s) SELECT conv_id, round(a, 6) AS orig_start, round(coalesce(sum(k + 1600) OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) / 16000, 6) AS filtered_start, round(k / 16000, 6) AS duration FROM n WHERE k > 0",
    "statement_chunks": f"WITH s AS (SELECT *, CASE WHEN turn % 4 < 3 THEN 'A' ELSE 'B' END AS sp FROM ({STATEMENTS})), r AS (SELECT *, sum(c) OVER (PARTITION BY interview ORDER BY start_time, uid) AS run FROM (SELECT *, CASE WHEN sp IS NOT DISTINCT FROM lag(sp) OVER (PARTITION BY interview ORDER BY start_time, uid) THEN 0 ELSE 1 END AS c FROM s)), p AS (SELECT *, floor((start_time - first_value(start_time) OVER (PARTITION BY interview, run ORDER BY start_time, uid)) / 20) AS slot, lag(text) OVER (PARTITION BY interview, run ORDER BY start_time, uid) AS pre FROM r), q AS (SELECT *, CASE WHEN slot > lag(slot) OVER (PARTITION BY interview, run ORDER BY start_time, uid) AND coalesce(regexp_matches(pre, '[.!?]\\s*$'), false) THEN 1 ELSE 0 END AS cut FROM p), z AS (SELECT *, CAST(sum(cut) OVER (PARTITION BY interview, run ORDER BY start_time, uid) AS BIGINT) AS part FROM q) SELECT interview, CAST(run AS BIGINT) AS run, part, any_value(sp) AS speaker, min(start_time) AS start_time, round(max(end_time), 3) AS end_time, CAST(length(string_agg(text, ' ' ORDER BY start_time, uid)) AS INTEGER) AS n_chars FROM z GROUP BY interview, run, part",
    "gold_transcript": r"SELECT doc_id, regexp_replace(array_to_string(list_filter(string_split('SARAH DOE: ' || text || chr(10) || 'A PROGRAM OF y' || chr(10) || 'AF: yes', chr(10)), lambda x: NOT regexp_matches(x, '(?i)A PROGRAM OF|Interviewee:|Interviewer:|Interview Number:|Date of Interview:|Interview of ')), chr(10)), '\b[A-Z]{2,}(?:\s+[A-Z]{2,})*:', ' ', 'g') AS gold FROM documents",
    "paper_match": "WITH p AS (SELECT split_part(paper, ' ', 1) AS number, min(paper) AS paper FROM (SELECT doc_id || ' ' || source AS paper FROM documents WHERE doc_id % 2 = 0) GROUP BY 1) SELECT doc_id, (doc_id % 300) || '.wav.json' AS file, coalesce(paper, '') AS paper FROM documents LEFT JOIN p ON p.number = CAST(doc_id % 300 AS VARCHAR)",
    "lexicon_phrases": "WITH t AS (SELECT doc_id, chr(1) || array_to_string(list_filter(regexp_split_to_array(lower(text), '[^a-z]+'), lambda x: x <> ''), chr(2) || chr(1)) || chr(2) AS s FROM documents), p AS (SELECT term, chr(1) || replace(term, ' ', chr(2) || chr(1)) || chr(2) AS k FROM (VALUES ('of the'), ('the the'), ('in the of')) v(term)), c AS (SELECT doc_id, term, (length(s) - length(replace(s, k, ''))) // length(k) AS n FROM t, p) SELECT doc_id, term, n FROM c WHERE n > 0",
    "vector_norms": "SELECT label, count(*) AS n, round(avg(x), 5) AS mean_norm, round(min(x), 5) AS least_norm, round(max(x), 5) AS most_norm FROM (SELECT label, sqrt(list_sum(list_transform(embedding, lambda v: v::DOUBLE * v::DOUBLE))) AS x FROM embeddings) GROUP BY label",
    "signal_compare": "WITH e AS (SELECT vec_id, embedding::DOUBLE[] AS v FROM embeddings), p AS (SELECT a.vec_id, a.v AS a, b.v AS b FROM e a JOIN e b ON b.vec_id = a.vec_id + 1), l AS (SELECT vec_id, a, lag, CASE WHEN lag < 0 THEN a[1 - lag:] ELSE a[:len(a) - lag] END AS x, CASE WHEN lag < 0 THEN b[:len(b) + lag] ELSE b[1 + lag:] END AS y FROM p, (VALUES (-2), (-1), (0), (1), (2)) g(lag)), c AS (SELECT vec_id, a, lag, list_dot_product(x, y) / (sqrt(list_dot_product(x, x)) * sqrt(list_dot_product(y, y))) AS r FROM l) SELECT vec_id, round(sqrt(list_dot_product(a, a) / len(a)), 5) AS level, round(sqrt(list_dot_product(a[49:], a[49:]) / len(a[49:])), 5) AS last_block, round(r, 5) AS correlation, lag FROM c QUALIFY row_number() OVER (PARTITION BY vec_id ORDER BY r DESC, lag) = 1",
    "ingest_edges": f"SELECT interview, uid AS statement_uid, speaker AS speaker_label, CASE WHEN speaker = 'system' THEN '' ELSE printf('p%d_%s', interview, speaker) END AS person_uid, start_time, round(end_time, 3) AS end_time FROM ({STATEMENTS})",
    "search_hits": f"WITH s AS ({STATEMENTS}), t AS (SELECT uid, list_filter(regexp_split_to_array(lower(text), '[^a-z]+'), lambda x: x <> '') AS terms FROM s), st AS (SELECT count(*) AS n, avg(len(terms)) AS mean FROM t), post AS (SELECT uid, term, count(*) AS tf, any_value(l) AS l FROM (SELECT uid, len(terms) AS l, unnest(terms) AS term FROM t) WHERE term IN ('nicht', 'the', 'pour') GROUP BY uid, term), df AS (SELECT term, count(*) AS df FROM post GROUP BY term), ts AS (SELECT uid, round(sum(ln(1 + (n - df + 0.5) / (df + 0.5)) * tf * 2.2 / (tf + 1.2 * (1 - 0.75 + 0.75 * l / mean))), 6) AS score FROM post JOIN df USING (term), st GROUP BY uid), b AS (SELECT uid, score, row_number() OVER (ORDER BY score DESC, uid) AS rank FROM ts QUALIFY rank <= 15) SELECT rank, uid, interview, speaker, start_time, score FROM b JOIN s USING (uid)",
}
ORACLES |= roster_sql.ORACLES | scoring_sql.ORACLES | search_sql.ORACLES | transcript_sql.ORACLES
ORACLES |= {
    "speaker_turns": f"""WITH x AS ({ORACLES["sticky_speaker"]}), o AS (SELECT *, CASE WHEN speaker IS NOT DISTINCT FROM lag(speaker) OVER (PARTITION BY conv_id ORDER BY seq) THEN 0 ELSE 1 END AS opens FROM x), n AS (SELECT *, CAST(sum(opens) OVER (PARTITION BY conv_id ORDER BY seq) AS BIGINT) AS turn FROM o)
SELECT conv_id, turn, any_value(speaker) AS speaker, string_agg(line, ' ' ORDER BY seq) AS text FROM n GROUP BY conv_id, turn""",
    "phrase_places": f"""WITH p AS (SELECT conv_id, turn, heard AS h, truth[1:5] AS p FROM ({TURN_PAIRS})),
t AS (SELECT conv_id, turn, list_filter(list_transform(range(len(p), greatest(least(len(p), 3), 1) - 1, -1), lambda n: list_min(list_filter(range(1, len(h) - n + 2), lambda i: h[i:i + n - 1] = p[1:n]))), lambda x: x IS NOT NULL) AS hit FROM p)
SELECT conv_id, turn, coalesce(hit[1] - 1, -1) AS place FROM t""",
    "diarization_score": f"""WITH t AS ({TICKS}), sp AS (SELECT user_id, seq, t, CASE WHEN value > 50 THEN 'high' ELSE 'low' END AS name, CASE WHEN event_type IN ('purchase', 'signup') THEN 'S1' ELSE 'S0' END AS label FROM (SELECT *, lead(t) OVER (PARTITION BY user_id ORDER BY seq) AS stop FROM t) WHERE stop > t),
g AS (SELECT user_id, CAST(count(*) AS INT) AS turns, count(*) FILTER (WHERE label = 'S0' AND name = 'high') AS a, count(*) FILTER (WHERE label = 'S0' AND name = 'low') AS b, count(*) FILTER (WHERE label = 'S1' AND name = 'high') AS c, count(*) FILTER (WHERE label = 'S1' AND name = 'low') AS d FROM sp GROUP BY user_id),
m AS (SELECT *, CASE WHEN a + b > 0 AND c + d > 0 AND a + c > 0 AND b + d > 0 THEN CASE WHEN a + d >= b + c THEN 'S0=high;S1=low' ELSE 'S0=low;S1=high' END WHEN a + b > 0 AND c + d > 0 THEN '' WHEN a + b > 0 THEN CASE WHEN a >= b THEN 'S0=high' ELSE 'S0=low' END ELSE CASE WHEN c >= d THEN 'S1=high' ELSE 'S1=low' END END AS mapping FROM g),
r AS (SELECT DISTINCT user_id, t FROM (SELECT *, lag(name) OVER (PARTITION BY user_id ORDER BY t, seq) AS was FROM sp) WHERE was <> name),
q AS (SELECT user_id, t FROM (SELECT *, lag(label) OVER (PARTITION BY user_id ORDER BY t, label) AS was FROM sp) WHERE was <> label),
h AS (SELECT user_id, count(*) AS changes, count(*) FILTER (WHERE EXISTS (SELECT 1 FROM q WHERE q.user_id = r.user_id AND abs(q.t - r.t) <= 3600)) AS detected FROM r GROUP BY user_id)
SELECT user_id, turns, round(CASE mapping WHEN 'S0=high;S1=low' THEN a + d WHEN 'S0=low;S1=high' THEN b + c WHEN 'S0=high' THEN a WHEN 'S0=low' THEN b WHEN 'S1=high' THEN c WHEN 'S1=low' THEN d ELSE 0 END / turns, 6) AS accuracy, mapping, coalesce(changes, 0) AS changes, coalesce(detected, 0) AS detected FROM m LEFT JOIN h USING (user_id)""",
}

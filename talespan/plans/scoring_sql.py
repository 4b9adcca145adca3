"""DuckDB SQL of the scoring queries: tokens, anchoring, edit scripts and what the reports derive from them."""

from talespan.functions.text import FILLER_PHRASES, FILLERS

#: (k, truth, heard) of the turn pairs, and of recordings.
TURN_PAIRS = "SELECT a.conv_id * 1000 + a.turn AS k, string_split(lower(a.text), ' ') AS truth, string_split(lower(b.text), ' ') AS heard FROM conversations a JOIN conversations b ON a.conv_id = b.conv_id AND b.turn = a.turn + 1"

RECORDINGS = """
c AS (SELECT conv_id, turn, role, text, string_split(lower(text), ' ') AS w, turn * 10.0::DOUBLE AS st FROM conversations),
said AS (SELECT conv_id AS k, flatten(list(w ORDER BY turn)) AS t FROM c GROUP BY conv_id),
spoke AS (SELECT conv_id - 1 AS k, flatten(list(w ORDER BY turn)) AS heard, count(*) AS segments FROM c GROUP BY conv_id),
rec AS (SELECT k, t, CASE WHEN k % 10 = 3 THEN list_append(t, 'extra') ELSE t END AS truth, heard, segments FROM said JOIN spoke USING (k))"""


def script(pairs: str) -> str:
    """CTEs sp (k, t0, t1, h0, h1, confidence, partial) and ops (k, idx, op, truth, heard, truth_pos, heard_pos)."""
    return f"""
p AS MATERIALIZED ({pairs}),
tt AS (SELECT k, unnest(range(len(truth))) AS pos, unnest(truth) AS tok FROM p),
hh AS (SELECT k, unnest(range(len(heard))) AS pos, unnest(heard) AS tok FROM p),
nm AS (SELECT k, len(truth) AS n, len(heard) AS m FROM p),
meet AS (SELECT r.k, r.pos AS tp, hh.pos AS hp FROM (SELECT * FROM tt QUALIFY count(*) OVER (PARTITION BY k, tok) <= 4) r JOIN hh ON hh.k = r.k AND hh.tok = r.tok),
probe AS (SELECT k, tp - hp AS off, unnest(list_filter([CASE WHEN tp < 400 THEN 1 END, CASE WHEN hp < 400 THEN 2 END, CASE WHEN tp >= n - 400 THEN 3 END, CASE WHEN hp >= m - 400 THEN 4 END], lambda x: x IS NOT NULL)) AS probe FROM meet JOIN nm USING (k)),
votes AS (SELECT k, probe, off, sum(count(*)) OVER (PARTITION BY k, probe ORDER BY off RANGE BETWEEN 2 PRECEDING AND 2 FOLLOWING) AS pooled FROM probe GROUP BY k, probe, off),
best AS (SELECT * FROM votes QUALIFY row_number() OVER (PARTITION BY k, probe ORDER BY pooled DESC, abs(off), off) = 1),
four AS (SELECT nm.k, n, m, {", ".join(f"coalesce(max(pooled) FILTER (WHERE probe = {i}), 0) AS c{i}, coalesce(max(off) FILTER (WHERE probe = {i}), 0) AS o{i}" for i in (1, 2, 3, 4))} FROM nm LEFT JOIN best USING (k) GROUP BY nm.k, n, m),
two AS (SELECT k, n, m, greatest(c1, c2) AS cs, greatest(c3, c4) AS ce, CASE WHEN c1 >= c2 THEN o1 ELSE o2 END AS os, CASE WHEN c3 >= c4 THEN o3 ELSE o4 END AS oe FROM four),
off AS (SELECT k, n, m, cs, ce, CASE WHEN cs >= 6 THEN os ELSE oe END AS os, CASE WHEN ce >= 6 THEN oe ELSE CASE WHEN cs >= 6 THEN os ELSE oe END END AS oe, n = 0 OR m = 0 OR (cs < 6 AND ce < 6) AS whole FROM two),
raw AS (SELECT *, greatest(greatest(os, 0) - 32, 0) AS bt, greatest(greatest(-os, 0) - 32, 0) AS bh FROM off),
sp AS MATERIALIZED (
  SELECT k, n, m, CASE WHEN whole THEN 0 ELSE bt END AS t0, CASE WHEN whole THEN n ELSE greatest(least(greatest(m + oe, 0) + 32, n), bt) END AS t1,
    CASE WHEN whole THEN 0 ELSE bh END AS h0, CASE WHEN whole THEN m ELSE greatest(least(greatest(n - oe, 0) + 32, m), bh) END AS h1,
    CASE WHEN whole THEN greatest(cs, ce) ELSE least(cs, ce) END AS confidence, NOT whole AND (10 * (t1 - t0) < 9 * n OR 10 * (h1 - h0) < 9 * m) AS partial FROM raw),
cut AS MATERIALIZED (SELECT k, t0, h0, truth[t0 + 1:t1] AS truth, heard[h0 + 1:h1] AS heard FROM p JOIN sp USING (k)),
dp AS MATERIALIZED (
  SELECT k, 0 AS s, [0] AS cur, CAST([] AS INT[]) AS pre, truth, heard FROM cut
  UNION ALL
  SELECT k, s + 1,
    list_transform(range(0, len(truth) + 1), lambda i: CASE WHEN i > s + 1 OR s + 1 - i > len(heard) THEN 4000000 ELSE least(
      CASE WHEN i > 0 AND s + 1 > i THEN (pre[i] // 4 + CAST(truth[i] <> heard[s + 1 - i] AS INT)) * 4 ELSE 4000000 END,
      CASE WHEN i > 0 THEN (cur[i] // 4 + 1) * 4 + 1 ELSE 4000000 END, CASE WHEN s + 1 > i THEN (cur[i + 1] // 4 + 1) * 4 + 2 ELSE 4000000 END) END),
    cur, truth, heard
  FROM dp WHERE s < len(truth) + len(heard)),
back AS (
  SELECT k, len(truth) AS i, len(heard) AS j, CAST(NULL AS INT) AS kind, CAST(NULL AS BIGINT) AS ti, CAST(NULL AS BIGINT) AS hj FROM cut
  UNION ALL
  SELECT back.k, i - CAST(d.cur[i + 1] % 4 <> 2 AS INT), j - CAST(d.cur[i + 1] % 4 <> 1 AS INT), d.cur[i + 1] % 4, i - CAST(d.cur[i + 1] % 4 <> 2 AS INT), j - CAST(d.cur[i + 1] % 4 <> 1 AS INT)
  FROM back JOIN dp d ON d.k = back.k AND d.s = i + j WHERE i + j > 0),
ops AS MATERIALIZED (
  SELECT k, row_number() OVER (PARTITION BY k ORDER BY ti, hj) - 1 AS idx,
    CASE WHEN kind = 1 THEN 'del' WHEN kind = 2 THEN 'ins' WHEN truth[ti + 1] = heard[hj + 1] THEN 'match' ELSE 'sub' END AS op,
    CASE WHEN kind <> 2 THEN truth[ti + 1] END AS truth, CASE WHEN kind <> 1 THEN heard[hj + 1] END AS heard, t0 + ti AS truth_pos, h0 + hj AS heard_pos
  FROM back JOIN cut USING (k) WHERE kind IS NOT NULL)"""


TURN_OPS = f"WITH RECURSIVE {script(TURN_PAIRS)}"
REC_OPS = f"WITH RECURSIVE {RECORDINGS}, {script('SELECT k, truth, heard FROM rec')}"

_WER = "count(*) FILTER (WHERE op = 'sub') AS sub, count(*) FILTER (WHERE op = 'del') AS del, count(*) FILTER (WHERE op = 'ins') AS ins, count(*) FILTER (WHERE op <> 'ins') AS truth_tokens, round(coalesce(count(*) FILTER (WHERE op <> 'match')::DOUBLE / nullif(count(*) FILTER (WHERE op <> 'ins'), 0), 0), 6) AS wer"

SPEAKERS = f"""{REC_OPS},
turn_tok AS (SELECT conv_id AS k, role, row_number() OVER (PARTITION BY conv_id ORDER BY turn, i) - 1 AS pos FROM (SELECT conv_id, turn, role, unnest(range(len(w))) AS i FROM c)),
seg_tok AS (SELECT conv_id - 1 AS k, dense_rank() OVER (PARTITION BY conv_id ORDER BY turn) - 1 AS seg, row_number() OVER (PARTITION BY conv_id ORDER BY turn, i) - 1 AS pos FROM (SELECT conv_id, turn, unnest(range(len(w))) AS i FROM c)),
near AS (SELECT t.k, t.pos, role, seg FROM turn_tok t JOIN rec ON rec.k = t.k AND len(rec.t) = len(rec.truth) LEFT JOIN ops ON ops.k = t.k AND op = 'match' AND truth_pos = t.pos LEFT JOIN seg_tok s ON s.k = t.k AND s.pos = heard_pos),
around AS (
  SELECT k, pos, role, lag(role) OVER o AS was, last_value(seg IGNORE NULLS) OVER (PARTITION BY k ORDER BY pos ROWS BETWEEN 25 PRECEDING AND 1 PRECEDING) AS lo, first_value(seg IGNORE NULLS) OVER (PARTITION BY k ORDER BY pos ROWS BETWEEN CURRENT ROW AND 24 FOLLOWING) AS hi
  FROM near WINDOW o AS (PARTITION BY k ORDER BY pos)),
spk AS (SELECT k, count(*) AS changes, count(*) FILTER (WHERE hi > lo) AS covered FROM around WHERE was <> role AND lo IS NOT NULL AND hi IS NOT NULL GROUP BY k)"""

LEXICON = f"""{REC_OPS},
lex AS (SELECT unnest(range(11)) AS term_id, unnest(['of', 'the', 'and', 'to', 'of of', 'an the', 'the of', 'to to', 'is', 'zzzz', '']) AS term),
joined AS (SELECT k, array_to_string(list_transform(truth, lambda x: chr(1) || x || chr(2)), '') AS t, array_to_string(list_transform(heard, lambda x: chr(1) || x || chr(2)), '') AS h FROM cut),
seek AS (SELECT term_id, term, string_split(term, ' ') AS words, chr(1) || replace(term, ' ', chr(2) || chr(1)) || chr(2) AS key FROM lex WHERE term <> ''),
hit AS (SELECT k, term_id, term, words, (length(t) - length(replace(t, key, ''))) // length(key) AS expected, (length(h) - length(replace(h, key, ''))) // length(key) AS heard FROM joined, seek),
lr AS (SELECT k, term_id, term, words, expected, least(heard, expected) AS found FROM hit WHERE expected > 0),
con AS (SELECT k, term_id, list_sort(list(DISTINCT ops.heard))[1:6] AS confusions FROM (SELECT k, term_id, unnest(words) AS tok FROM lr WHERE found < expected) x JOIN ops USING (k) WHERE op = 'sub' AND ops.truth = tok GROUP BY k, term_id),
overall AS (SELECT k, coalesce(sum(expected), 0) AS expected, coalesce(sum(found), 0) AS found FROM rec LEFT JOIN lr USING (k) GROUP BY k)"""

# anchors of a recording and the longest prefix of each in the timed stream, which is that of the segments' words
DRIFT = f"""{REC_OPS},
mk AS (SELECT k, j AS ma, j % 2 + 1 AS tape, printf('mark %d', j) AS label, j * 30.0::DOUBLE AS tape_seconds, CASE WHEN j < 6 THEN list_concat(heard[40 * j + 1:40 * j + 3], t[40 * j + 1:40 * j + 4]) ELSE t[1:j - 5] END AS phrase FROM rec, (SELECT unnest(range(9)) AS j)),
timed AS (SELECT conv_id - 1 AS k, tok, st + i * 0.25::DOUBLE AS start, row_number() OVER (PARTITION BY conv_id ORDER BY turn, i) - 1 AS pos FROM (SELECT conv_id, turn, st, unnest(w) AS tok, unnest(range(len(w))) AS i FROM c)),
tries AS (SELECT mk.k, ma, timed.pos, start, phrase, heard[timed.pos + 1:least(timed.pos + len(phrase), h1)] AS nxt FROM mk JOIN timed ON timed.k = mk.k AND timed.tok = phrase[1] JOIN sp ON sp.k = mk.k AND timed.pos >= h0 AND timed.pos < h1 JOIN rec ON rec.k = mk.k),
len AS (SELECT k, ma, pos, start, len(phrase) AS l, coalesce(list_max(list_filter(range(1, len(nxt) + 1), lambda x: nxt[:x] = phrase[:x])), 0) AS got FROM tries),
place AS (SELECT k, ma, start AS media FROM len WHERE got >= least(3, l) QUALIFY row_number() OVER (PARTITION BY k, ma ORDER BY got DESC, pos) = 1),
pts AS (SELECT mk.*, media FROM mk LEFT JOIN place USING (k, ma)),
fit AS (SELECT k, tape, regr_slope(media, tape_seconds) AS slope, regr_intercept(media, tape_seconds) AS base, count(*) AS n FROM pts WHERE media IS NOT NULL GROUP BY k, tape HAVING count(*) > 1),
longest AS (SELECT k, slope AS time_slope FROM fit WHERE slope IS NOT NULL QUALIFY row_number() OVER (PARTITION BY k ORDER BY n DESC, tape) = 1)"""

STRUCTURE = """
sw AS (SELECT conv_id - 1 AS k, turn, CASE WHEN i % 50 = 7 THEN word || '[_TT_' ELSE word END AS word, st + i * 0.25::DOUBLE AS a, st + i * 0.25::DOUBLE + ((length(word) * 3 + i) % 9 - 1) * 0.5::DOUBLE AS b FROM (SELECT conv_id, turn, st, unnest(string_split(text, ' ')) AS word, unnest(range(len(string_split(text, ' ')))) AS i FROM c)),
stats AS (SELECT k, count(*) AS words, count(*) FILTER (WHERE contains(word, '[_')) AS control_token_words, count(*) FILTER (WHERE b <= a) AS zero_duration_words, count(*) FILTER (WHERE b - a > greatest(2.0::DOUBLE, length(word) / 4.0::DOUBLE)) AS implausible_duration_words, count(*) FILTER (WHERE b < a) AS backwards_time_words FROM sw GROUP BY k),
sg AS (SELECT conv_id - 1 AS k, count(*) AS segments, round(avg(CASE WHEN least(st % 30, 30 - st % 30) < 0.1 THEN 1 ELSE 0 END), 6) AS boundary_quantization, round(list_sort(list(st + least(12.0::DOUBLE, 1.0::DOUBLE + length(text) / 20.0::DOUBLE) - st))[CAST(count(*) // 2 + 1 AS INT)], 6) AS median_segment_seconds FROM c GROUP BY conv_id)"""

def _parts(sql: str) -> str:
    """The tables that a report adds to the shared ones."""
    return sql[len(REC_OPS) :]


CARD = f"""{REC_OPS}{_parts(SPEAKERS)}{_parts(LEXICON)}{_parts(DRIFT)}, {STRUCTURE},
err AS (SELECT k, count(*) FILTER (WHERE op = 'sub') AS subs, count(*) FILTER (WHERE op = 'del') AS dels, count(*) FILTER (WHERE op = 'ins') AS ins FROM ops GROUP BY k),
top AS (SELECT k, truth || '>' || heard AS top_substitution FROM (SELECT k, truth, heard, count(*) AS n FROM ops WHERE op = 'sub' GROUP BY ALL) QUALIFY row_number() OVER (PARTITION BY k ORDER BY n DESC, truth, heard) = 1)
SELECT k AS conv_id, 4 AS harness_version, coalesce(subs, 0) AS subs, coalesce(dels, 0) AS dels, coalesce(ins, 0) AS ins, CAST(t1 - t0 AS INT) AS truth_tokens, CAST(h1 - h0 AS INT) AS hyp_tokens, CASE WHEN t1 > t0 THEN round((subs + dels + ins) / (t1 - t0), 6) ELSE 0.0::DOUBLE END AS rate,
  coalesce(round(time_slope, 5), -1.0::DOUBLE) AS time_slope, coalesce(covered, -1) AS covered, CASE WHEN expected = 0 THEN 1.0::DOUBLE ELSE round(found / expected, 6) END AS recall,
  CAST((SELECT count(*) FROM lr WHERE lr.k = rec.k) AS INT) AS terms, CAST((SELECT count(*) FROM place WHERE place.k = rec.k) AS INT) AS found_anchors, CAST(words AS INT) AS words, CAST(confidence AS INT) AS anchor_confidence, partial AS partial_coverage, coalesce(top_substitution, '') AS top_substitution
FROM rec JOIN sp USING (k) JOIN overall USING (k) JOIN stats USING (k) LEFT JOIN err USING (k) LEFT JOIN spk USING (k) LEFT JOIN longest USING (k) LEFT JOIN top USING (k)"""

_list = lambda words: "[" + ", ".join(f"'{w}'" for w in words) + "]"
INSERTIONS = f"""{TURN_OPS},
around AS (SELECT k, idx, op, heard, lag(CASE WHEN op = 'match' THEN truth END) OVER o AS b, lead(CASE WHEN op = 'match' THEN truth END) OVER o AS a FROM ops WINDOW o AS (PARTITION BY k ORDER BY idx)),
runs AS MATERIALIZED (SELECT k, grp, list(heard ORDER BY idx) AS w, arg_min(b, idx) AS b, arg_max(a, idx) AS a FROM (SELECT *, idx - row_number() OVER (PARTITION BY k ORDER BY idx) AS grp FROM around WHERE op = 'ins') GROUP BY k, grp),
walk AS (
  SELECT k, grp, w, a, b, CAST(1 AS BIGINT) AS pos, CAST(0 AS BIGINT) AS filler, CAST(0 AS BIGINT) AS content FROM runs
  UNION ALL
  SELECT k, grp, w, a, b, pos + greatest(light, 1), filler + light, content + CAST(light = 0 AS BIGINT) FROM (
    SELECT *, CAST(coalesce(list_max(list_transform(list_filter([{", ".join(_list(p) for p in FILLER_PHRASES)}], lambda p: w[pos:pos + len(p) - 1] = p), lambda p: len(p))), CAST(list_contains({_list(FILLERS)}, w[pos]) OR coalesce(w[pos] = a, false) OR coalesce(w[pos] = b, false) AS INT)) AS BIGINT) AS light FROM walk WHERE pos <= len(w))),
done AS (SELECT k, sum(filler) AS filler, sum(content) AS content FROM walk WHERE pos > len(w) GROUP BY k)
SELECT p.k // 1000 AS conv_id, p.k % 1000 AS turn, CAST(coalesce(filler, 0) AS BIGINT) AS filler, CAST(coalesce(content, 0) AS BIGINT) AS content FROM (SELECT DISTINCT k FROM ops) p LEFT JOIN done USING (k)"""

ORACLES = {
    "scorecards": CARD,
    "insertion_classes": INSERTIONS,
    "align_ops": f"{TURN_OPS} SELECT k // 1000 AS conv_id, k % 1000 AS turn, CAST(idx AS INT) AS idx, op, truth, heard FROM ops",
    "wer_from_ops": f"{TURN_OPS} SELECT k // 1000 AS conv_id, k % 1000 AS turn, {_WER} FROM ops GROUP BY k",
    "error_taxonomy": f"{TURN_OPS}, n AS (SELECT op, coalesce(truth, '') AS truth, coalesce(heard, '') AS heard, count(*) AS n FROM ops WHERE op <> 'match' GROUP BY ALL) SELECT *, CAST(row_number() OVER (PARTITION BY op ORDER BY n DESC, truth, heard) AS INT) AS rn FROM n QUALIFY rn <= 40",
    "recording_edits": f"{REC_OPS} SELECT k AS conv_id, CAST(idx AS INT) AS idx, op, truth, heard, truth_pos, heard_pos FROM ops",
    "speaker_report": f"{SPEAKERS} SELECT k AS conv_id, coalesce(changes, -1) AS changes, coalesce(covered, -1) AS covered, coalesce(changes - covered, -1) AS bleed, coalesce(round(changes * segments / len(heard), 6), -1) AS expected_by_chance, coalesce(round(covered / (changes * segments / len(heard)), 6), -1) AS lift, CASE WHEN changes > 0 THEN round(len(heard) / segments, 6) ELSE -1.0::DOUBLE END AS mean_segment_tokens FROM rec LEFT JOIN spk USING (k)",
    "lexicon_report": f"{LEXICON} SELECT k AS conv_id, CAST(row_number() OVER (PARTITION BY k ORDER BY expected - found DESC, expected DESC, term_id) AS INT) AS rank, term, CAST(expected AS INT) AS expected, CAST(found AS INT) AS found, coalesce(array_to_string(confusions, ' '), '') AS confusions FROM lr LEFT JOIN con USING (k, term_id)",
    "lexicon_overall": f"{LEXICON} SELECT k AS conv_id, CAST(expected AS BIGINT) AS expected, CAST(found AS BIGINT) AS found, CASE WHEN expected = 0 THEN 1.0::DOUBLE ELSE round(found / expected, 6) END AS recall FROM overall",
    "tape_drift": f"{DRIFT} SELECT pts.k AS conv_id, CAST(ma AS INT) AS mark, CAST(pts.tape AS INT) AS tape, label, tape_seconds, coalesce(round(media, 3), -999.0::DOUBLE) AS media_seconds, coalesce(round(media - (slope * tape_seconds + base), 4), -999.0::DOUBLE) + 0.0::DOUBLE AS residual, coalesce(round(time_slope, 5), -999.0::DOUBLE) AS time_slope FROM pts LEFT JOIN fit ON fit.k = pts.k AND fit.tape = pts.tape LEFT JOIN longest ON longest.k = pts.k",
    "structure_words": f"WITH {RECORDINGS}, {STRUCTURE} SELECT k AS conv_id, CAST(sg.segments AS INT) AS segments, CAST(words AS INT) AS words, CAST(control_token_words AS INT) AS control_token_words, CAST(zero_duration_words AS INT) AS zero_duration_words, CAST(implausible_duration_words AS INT) AS implausible_duration_words, CAST(backwards_time_words AS INT) AS backwards_time_words, boundary_quantization, median_segment_seconds FROM rec JOIN stats USING (k) JOIN sg USING (k)",
}

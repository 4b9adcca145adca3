"""DuckDB SQL of the queries on rosters, diagnostics, parameters and manifests."""

MEMBERS = r"m AS (SELECT doc_id, grp FROM (SELECT doc_id, trim(regexp_replace(coalesce(text, ''), '[ \t\r\n\f]+', ' ', 'g')) AS t FROM documents), (SELECT unnest(['The', 'und', 'de la', 'of the', 'queque']) AS grp) WHERE regexp_matches(t, '(^|[^A-Za-z0-9_])(?:' || grp || ')($|[^A-Za-z0-9_])'))"
_NAME = r"(SELECT vec_id, embedding, coalesce(w[1], '') || coalesce(replace(upper(w[2][1]), 'ẞ', 'SS') || w[2][2:], '') || coalesce(replace(upper(w[3][1]), 'ẞ', 'SS') || w[3][2:], '') AS name FROM (SELECT vec_id, embedding, list_filter(regexp_split_to_array(lower(text), '[^\p{L}\p{M}\p{N}]+'), lambda x: x <> '')[1:3] AS w FROM embeddings JOIN documents ON vec_id = doc_id))"

ORACLES = {
    "group_members": f"WITH {MEMBERS} SELECT doc_id, grp FROM m",
    "roster_totals": f"WITH {MEMBERS} SELECT count(*) AS memberships, count(DISTINCT doc_id) AS people, count(DISTINCT grp) AS groups FROM m",
    "embedding_diagnostic": """WITH e AS (SELECT vec_id, label, embedding::DOUBLE[] AS v, vec_id // 40 AS recording FROM embeddings),
n AS (SELECT recording, count(*) AS vectors, round(avg(x), 5) AS mean_norm, round(min(x), 5) AS least_norm, round(max(x), 5) AS most_norm FROM (SELECT recording, sqrt(list_dot_product(v, v)) AS x FROM e) GROUP BY recording),
p AS (SELECT a.recording, a.label = b.label AS same, least(greatest(1 - list_dot_product(a.v, b.v) / (sqrt(list_dot_product(a.v, a.v)) * sqrt(list_dot_product(b.v, b.v))), 0), 2) AS d FROM e a JOIN e b ON a.recording = b.recording AND a.vec_id < b.vec_id),
q AS (SELECT recording, count(*) FILTER (WHERE same) AS same_pairs, count(*) FILTER (WHERE NOT same) AS other_pairs, round(avg(d) FILTER (WHERE same), 5) AS same_distance, round(avg(d) FILTER (WHERE NOT same), 5) AS other_distance FROM p GROUP BY recording)
SELECT recording, vectors, mean_norm, least_norm, most_norm, coalesce(same_pairs, 0) AS same_pairs, coalesce(other_pairs, 0) AS other_pairs, coalesce(same_distance, -1.0::DOUBLE) AS same_distance, coalesce(other_distance, -1.0::DOUBLE) AS other_distance FROM n LEFT JOIN q USING (recording)""",
    "vector_parameters": f"SELECT vec_id, ':param ' || name || 'Embedding => vector([' || array_to_string(list_transform(embedding[1:4], lambda x: CAST(floor(x::DOUBLE * 8) / 8 AS VARCHAR)), ', ') || '], 4, FLOAT64);' AS parameter FROM {_NAME}",
    "manifest_entries": "SELECT page_id, 'pages' AS section, url, CASE WHEN page_id % 7 <> 0 THEN coalesce(CAST(TRY_CAST('2003-0' || (page_id % 10) || '-30' AS DATE) AS VARCHAR), '') ELSE '' END AS date FROM pages",
}

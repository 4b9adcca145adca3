"""DuckDB SQL of the search queries."""

WORDS = r"regexp_extract_all(lower(coalesce(text, '')), '[\p{L}\p{N}\p{M}]+(?:[''’][\p{L}\p{N}\p{M}]+)*')"


def _leaf(n: int, query: str, sought: str, prefix: bool = False) -> str:
    words = sought.split()
    test = f"starts_with(w[p], '{sought}')" if prefix else " AND ".join(f"w[p + {i}] = '{x}'" if i else f"w[p] = '{x}'" for i, x in enumerate(words))
    return f"SELECT '{query}' AS query, {n} AS leaf, {prefix} AS pre, doc_id, len(w) AS l, len(list_filter(range(1, len(w) + 1), lambda p: {test})) AS tf FROM t"


#: Query, its leaves (text, prefix, whether they count in scores), and the test of which leaves a document has.
SEARCHES = [
    ("the", [("the", 0, 1)], "h1"),
    ("nicht AND der", [("nicht", 0, 1), ("der", 0, 1)], "h1 AND h2"),
    ("para OR pour", [("para", 0, 1), ("pour", 0, 1)], "h1 OR h2"),
    ("the NOT and", [("the", 0, 1), ("and", 0, 0)], "h1 AND NOT h2"),
    ('"of the"', [("of the", 0, 1)], "h1"),
    ("verzu*", [("verzu", 1, 1)], "h1"),
    ("(das OR les) AND -en", [("das", 0, 1), ("les", 0, 1), ("en", 0, 0)], "(h1 OR h2) AND NOT h3"),
    ('+in "in the" OR tionen*', [("in", 0, 1), ("in the", 0, 1), ("tionen", 1, 1)], "h1 OR h2 OR h3"),
]

_leaves = " UNION ALL ".join(_leaf(i, q, text, bool(pre)) for q, leaves, _ in SEARCHES for i, (text, pre, _) in enumerate(leaves, 1))
_positive = " OR ".join(f"(query = '{q}' AND leaf = {i})" for q, leaves, _ in SEARCHES for i, (_, _, use) in enumerate(leaves, 1) if use)
_test = " OR ".join(f"(query = '{q}' AND ({test}))" for q, _, test in SEARCHES)
_has = ", ".join(f"bool_or(leaf = {i}) AS h{i}" for i in (1, 2, 3))

ORACLES = {
    "fulltext_syntax": f"""WITH t AS (SELECT doc_id, {WORDS} AS w FROM documents), st AS (SELECT count(*) AS n, avg(len(w)) AS mean FROM t),
lf AS ({_leaves}), f AS (SELECT *, count(*) OVER (PARTITION BY query, leaf) AS df FROM lf WHERE tf > 0),
s AS (SELECT query, doc_id, leaf, CASE WHEN NOT ({_positive}) THEN 0 WHEN pre THEN 1 ELSE ln(1 + (n - df + 0.5) / (df + 0.5)) * tf * 2.2 / (tf + 1.2 * (1 - 0.75 + 0.75 * l / mean)) END AS part FROM f, st),
d AS (SELECT query, doc_id, round(sum(part), 6) AS score, {_has} FROM s GROUP BY query, doc_id)
SELECT doc_id, score, query FROM d WHERE {_test}""",
    "hybrid_statements": """WITH s AS (SELECT conv_id AS interview, printf('st%d_%d', conv_id, turn) AS uid, role AS speaker, text, turn * 10.0::DOUBLE AS start_time, turn * 10.0::DOUBLE + least(12.0::DOUBLE, 1.0::DOUBLE + length(text) / 20.0::DOUBLE) AS end_time, turn FROM conversations),
t AS (SELECT uid, list_filter(regexp_split_to_array(lower(text), '[^a-z]+'), lambda x: x <> '') AS terms FROM s), st AS (SELECT count(*) AS n, avg(len(terms)) AS mean FROM t),
post AS (SELECT uid, term, count(*) AS tf, any_value(l) AS l FROM (SELECT uid, len(terms) AS l, unnest(terms) AS term FROM t) WHERE term IN ('nicht', 'the', 'pour') GROUP BY uid, term), df AS (SELECT term, count(*) AS df FROM post GROUP BY term),
ts AS (SELECT uid, round(sum(ln(1 + (n - df + 0.5) / (df + 0.5)) * tf * 2.2 / (tf + 1.2 * (1 - 0.75 + 0.75 * l / mean))), 6) AS score FROM post JOIN df USING (term), st GROUP BY uid),
ev AS (SELECT uid, embedding::DOUBLE[] AS v FROM embeddings JOIN s ON vec_id = interview * 7 + turn), q AS (SELECT embedding::DOUBLE[] AS v FROM embeddings WHERE vec_id = 7),
vs AS (SELECT uid, round(1 - least(greatest(1 - list_dot_product(ev.v, q.v) / (sqrt(list_dot_product(ev.v, ev.v)) * sqrt(list_dot_product(q.v, q.v))), 0), 2), 6) AS score FROM ev, q),
a AS (SELECT uid, row_number() OVER (ORDER BY score DESC, uid) AS rank FROM ts QUALIFY rank <= 100), b AS (SELECT uid, row_number() OVER (ORDER BY score DESC, uid) AS rank FROM vs QUALIFY rank <= 100),
w AS (SELECT uid, round(sum(part), 8) AS wrrf FROM (SELECT uid, 1.0::DOUBLE / (60 + rank) AS part FROM a UNION ALL SELECT uid, 0.8::DOUBLE / (60 + rank) FROM b) GROUP BY uid ORDER BY wrrf DESC, uid LIMIT 15)
SELECT uid, interview, speaker, start_time, round(end_time, 3) AS end_time, text, wrrf FROM w JOIN s USING (uid)""",
}

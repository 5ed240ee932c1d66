"""The same queries in SQL, over whole tables."""

#: An ideograph is a word of its own; other words are runs of letters and digits.
_SPACED = r"regexp_replace({}, '([一-鿿])', ' \1 ', 'g')"
_WORDS = r"list_transform(regexp_extract_all(" + _SPACED + r", '[\p{{L}}\p{{N}}]+'), lambda w: lower(w))"
_TOKENS = r"regexp_extract_all(" + _SPACED + r", '[\p{{L}}\p{{N}}]+|[^\s\p{{Z}}]')"
_DATA = "SELECT DISTINCT name, shelf, content ->> '$.data' AS data FROM knowledge WHERE json_valid(content) AND json_type(content, '$.data') = 'VARCHAR'"

P2 = f"""
WITH k AS ({_DATA}),
s AS (SELECT name, list_distinct({_WORDS.format("name || ' ' || data")}) AS ws FROM k),
b AS (SELECT DISTINCT name, ws FROM s WHERE len(ws) >= 24),
w AS (SELECT name, len(ws) AS n, unnest(ws) AS word FROM b),
c AS (SELECT x.name AS name_a, y.name AS name_b, x.n AS na, y.n AS nb, count(*) AS common FROM w x JOIN w y ON x.word = y.word AND x.name < y.name GROUP BY ALL)
SELECT DISTINCT name_a, name_b FROM c WHERE common >= 0.6::DOUBLE * (na + nb - common)
"""

P2_NEAR = f"""
WITH k AS ({_DATA}),
s AS (SELECT DISTINCT name, list_sort({_WORDS.format("data")}) AS ws FROM k),
m AS (SELECT name, array_to_string(ws, ' ') AS c, ws FROM s WHERE len(ws) > 0),
t AS (SELECT c, min(name) AS class, len(any_value(ws)) AS n, any_value(ws) AS ws FROM m GROUP BY c),
w AS (SELECT class, n, word, count(*) AS f FROM (SELECT class, n, unnest(ws) AS word FROM t) GROUP BY ALL),
p AS (SELECT x.class AS a, y.class AS b, x.n AS na, y.n AS nb, sum(least(x.f, y.f)) AS common FROM w x JOIN w y ON x.word = y.word AND x.class < y.class AND x.n >= 0.8 * y.n AND y.n >= 0.8 * x.n GROUP BY ALL),
l AS (SELECT a, b FROM p WHERE common >= 0.8::DOUBLE * (na + nb - common)),
e AS (SELECT class, count(*) AS links FROM (SELECT a AS class FROM l UNION ALL SELECT b FROM l) GROUP BY class),
r AS (SELECT m.name, t.class, coalesce(e.links, 0) AS links FROM m JOIN t USING (c) LEFT JOIN e ON e.class = t.class)
SELECT n.name, r.class, coalesce(r.links, 0) AS links FROM (SELECT DISTINCT name FROM knowledge WHERE name IS NOT NULL) n LEFT JOIN r ON r.name = n.name
"""

P3 = f"""
WITH k AS ({_DATA})
SELECT DISTINCT k.name FROM k LEFT JOIN local_config USING (shelf) WHERE len({_TOKENS.format("data")}) > coalesce(max_seq_length, 8192)
"""

_BORDA = """
f AS (SELECT question_id, key, min(rank) AS r FROM fts_result GROUP BY ALL),
v AS (SELECT question_id, key, min(distance) AS d FROM vec_result GROUP BY ALL),
u AS (SELECT question_id, key, r, d FROM f FULL JOIN v USING (question_id, key)),
o AS (SELECT *, count(*) OVER q AS n, count(r) OVER q AS nr, count(d) OVER q AS nd,
        rank() OVER (PARTITION BY question_id ORDER BY r NULLS LAST) AS rr, count(*) OVER (PARTITION BY question_id, r) AS er,
        rank() OVER (PARTITION BY question_id ORDER BY d NULLS LAST) AS rd, count(*) OVER (PARTITION BY question_id, d) AS ed
      FROM u WINDOW q AS (PARTITION BY question_id)),
p AS (SELECT question_id, key, nr, nd, (r IS NOT NULL)::INT + (d IS NOT NULL)::INT AS found_in,
        (n - (rr + (er - 1) / 2.0::DOUBLE)) + (n - (rd + (ed - 1) / 2.0::DOUBLE)) AS points FROM o)
"""

P4 = f"""
WITH {_BORDA}
SELECT question_id, key FROM p WHERE nr > 0 AND nd > 0 QUALIFY row_number() OVER (PARTITION BY question_id ORDER BY points DESC, key) = 1
"""

P4_RANKING = f"""
WITH {_BORDA}
SELECT question_id, key, points::DOUBLE AS points, found_in, row_number() OVER (PARTITION BY question_id ORDER BY points DESC, key)::INT AS place FROM p
"""

_LISTED = "SELECT to_json([run_id, question_id])::VARCHAR AS question_id, unnest({0}) AS key, generate_subscripts({0}, 1) AS {1} FROM eval_result WHERE run_id IS NOT NULL AND question_id IS NOT NULL"
P4_RUNS = f"""
WITH fts_result AS ({_LISTED.format("fts_top_keys", "rank")}), vec_result AS ({_LISTED.format("vec_top_keys", "distance")}), {_BORDA}
SELECT json_extract_string(question_id, '$[0]') AS run_id, json_extract_string(question_id, '$[1]') AS question_id, key, points::DOUBLE AS points, found_in,
  row_number() OVER (PARTITION BY p.question_id ORDER BY points DESC, key)::INT AS place FROM p WHERE key IS NOT NULL
"""

P5 = """
WITH e AS (SELECT DISTINCT key, embedding::DOUBLE[] AS x FROM (SELECT name AS key, embedding FROM knowledge UNION ALL SELECT triple, embedding FROM statement)
           WHERE embedding IS NOT NULL AND list_dot_product(embedding::DOUBLE[], embedding::DOUBLE[]) > 0),
p AS (SELECT a.key AS k, b.key AS o, round(list_cosine_similarity(a.x, b.x), 7) AS c FROM e a JOIN e b ON a.key <> b.key WHERE list_cosine_similarity(a.x, b.x) >= 0.949),
t AS (SELECT * FROM p WHERE c >= 0.95 QUALIFY row_number() OVER (PARTITION BY k ORDER BY c DESC, o) <= 5)
SELECT DISTINCT least(k, o) AS key_a, greatest(k, o) AS key_b FROM t
"""

_LATENCIES = r"""
once AS (SELECT DISTINCT run_id, question_id, regexp_replace(lower(trim(question_type, E' \t\n\r')), '_abs$', '') AS question_type, fts_latency_us AS f, vec_latency_us AS x FROM eval_result),
l AS (SELECT run_id, question_type, 'fts' AS side, f AS v FROM once UNION ALL SELECT run_id, question_type, 'vec', x FROM once),
g AS (SELECT run_id, question_type, side, list_sort(list(v)) AS vs, count(*) AS n FROM l WHERE v > 0 GROUP BY ALL)
"""

P6 = f"WITH {_LATENCIES} SELECT run_id, question_type, side FROM g WHERE n >= 30 AND vs[(n * 90) // 100 + 1] > 8 * vs[(n * 50) // 100 + 1]"

P6_PERCENTILES = f"WITH {_LATENCIES}, q AS (SELECT unnest([50, 90, 99]) AS q) SELECT run_id, question_type, side, q.q, n, vs[(n * q.q) // 100 + 1] AS value FROM g, q"

P8 = f"""
WITH d AS (SELECT doc_id, {_WORDS.format("text")} AS ws FROM documents),
i AS (SELECT item_id, {_WORDS.format("text")} AS ws FROM eval_item),
ds AS (SELECT doc_id, unnest(list_transform(range(1, len(ws) - 10), lambda a: array_to_string(ws[a : a + 11], ' '))) AS run FROM d),
si AS (SELECT item_id, unnest(list_transform(range(1, len(ws) - 10), lambda a: array_to_string(ws[a : a + 11], ' '))) AS run FROM i)
SELECT DISTINCT doc_id, item_id FROM ds JOIN si USING (run)
"""

ORACLES = {"p2_found": P2, "p2_near_duplicates": P2_NEAR, "p3_found": P3, "p4_found": P4, "p4_ranking": P4_RANKING, "p4_runs": P4_RUNS, "p5_found": P5, "p6_found": P6, "p6_percentiles": P6_PERCENTILES, "p8_found": P8}

"""Queries over the tables of a folder, and the same in SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from graphmill.functions.content import content_column, embedding_text, file_category, mime_type, triple_column
from graphmill.functions.vectors import cosine_distance
from graphmill.operators import metrics
from graphmill.operators.fulltext import FullTextIndex, fields, knowledge_docs, statement_docs
from graphmill.operators.graph import k_hop, reachable
from graphmill.operators.intervals import interval_gaps, merge_intervals
from graphmill.plans.execute import Tables, execute, similar
from graphmill.session import materialise, scratch_folder
from graphmill.sources.store import Shelf

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None) -> Callable[[Query], Query]:
    """Register a query under its function's name, with the SQL that gives the same rows."""

    def register(function: Query) -> Query:
        QUERIES[function.__name__] = function
        if sql:
            ORACLES[function.__name__] = sql
        return function

    return register


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


_COVERED = """
covered AS (
  SELECT DISTINCT subject, epoch_us(tr_start) AS s, CASE WHEN tr_end IS NULL THEN 9223372036854775807 ELSE epoch_us(tr_end) END AS e
  FROM statement WHERE subject IS NOT NULL AND tr_start IS NOT NULL AND (tr_end IS NULL OR tr_end > tr_start)),
reach AS (
  SELECT *, max(e) OVER (PARTITION BY subject ORDER BY s, e ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS before FROM covered)
"""


@query(f"WITH {_COVERED} SELECT subject, before AS gap_start_us, s AS gap_end_us FROM reach WHERE s > before")
def p1_found(spark: SparkSession, folder: str) -> DataFrame:
    """Holes in the validity of every subject's statements."""
    return interval_gaps(table(spark, folder, "statement"))


@query(f"""
WITH {_COVERED},
numbered AS (SELECT *, sum(CASE WHEN before IS NULL OR s > before THEN 1 ELSE 0 END) OVER (PARTITION BY subject ORDER BY s, e ROWS UNBOUNDED PRECEDING) AS n FROM reach)
SELECT subject, min(s) AS period_start_us, nullif(max(e), 9223372036854775807) AS period_end_us FROM numbered GROUP BY subject, n
""")
def p1_periods(spark: SparkSession, folder: str) -> DataFrame:
    """Continuous periods of validity of every subject's statements."""
    return merge_intervals(table(spark, folder, "statement"))


# ---- queries of the graph store, over the knowledge and statement tables


_shelves: dict[tuple, Shelf] = {}
_indexes: dict[tuple, FullTextIndex] = {}


def shelf(spark: SparkSession, folder: str) -> Shelf:
    """A shelf with a folder's tables, loaded once in a session: each row once, in the order of its key."""
    key = (spark.sparkContext.applicationId, folder)
    if key not in _shelves:
        made = Shelf(spark, scratch_folder(spark, "shelf"))
        for name in ("knowledge", "statement"):
            made.load(name, table(spark, folder, name).drop("shelf"))
        _shelves[key] = made
    return _shelves[key]


def knowledge_rows(spark: SparkSession, folder: str) -> DataFrame:
    """Each knowledge row once: the newest copy."""
    return shelf(spark, folder).knowledge


def statement_rows(spark: SparkSession, folder: str) -> DataFrame:
    return shelf(spark, folder).statement


def index(spark: SparkSession, folder: str, stem: bool) -> FullTextIndex:
    """The search index of a folder: the shelf's own, or one of unstemmed words, written once in a session."""
    if stem:
        return shelf(spark, folder).full_text()
    key = (spark.sparkContext.applicationId, folder)
    if key not in _indexes:
        docs = knowledge_docs(knowledge_rows(spark, folder)).unionByName(statement_docs(statement_rows(spark, folder)))
        _indexes[key] = FullTextIndex.build(docs, stem=False).save(scratch_folder(spark, "index"))
    return _indexes[key]


def tables(spark: SparkSession, folder: str) -> Tables:
    return Tables(knowledge_rows(spark, folder), statement_rows(spark, folder))


def searchable(spark: SparkSession, folder: str, stem: bool = True) -> Tables:
    found = tables(spark, folder)
    found.index = index(spark, folder, stem)
    return found


K = """k AS (SELECT name, max(content) AS content, max(created_at) AS created_at, max(embedding) AS embedding,
  CASE WHEN json_valid(max(content)) THEN max(content)::JSON END AS j FROM knowledge WHERE name IS NOT NULL GROUP BY name)"""
S = """s AS (SELECT triple, max(subject) AS subject, max(predicate) AS predicate, max(object) AS object, max(content) AS content, max(created_at) AS created_at,
  max(tr_start) AS tr_start, max(tr_end) AS tr_end, max(embedding) AS embedding, CASE WHEN json_valid(max(content)) THEN max(content)::JSON END AS j
  FROM statement WHERE triple IS NOT NULL GROUP BY triple)"""
K_OUT, S_OUT = "name, content, created_at", "triple, subject, predicate, object, content, created_at, tr_start, tr_end"


def expression(name: str, text: str, where: str, page: str | None = None) -> None:
    """Register a query of the language; ``page`` is the SQL that orders and limits, without it all rows come."""
    statement = text.lstrip("[{ ").startswith('"$statement')
    sql = f"WITH {S if statement else K} SELECT {S_OUT if statement else K_OUT} FROM {'s' if statement else 'k'} WHERE {where} {page or ''}"

    def run(spark: SparkSession, folder: str) -> DataFrame:
        return execute(text, tables(spark, folder), page is not None)

    run.__name__, run.__doc__ = name, f"``{text}``"
    query(sql)(run)


NEWEST_K, NEWEST_S = "ORDER BY created_at DESC, name", "ORDER BY created_at DESC, triple"
_X = "json_extract_string(j, '$.{}')"
expression("scan_knowledge", '["$knowledge"]', "true", f"{NEWEST_K} LIMIT 100")
expression("scan_statement", '["$statement"]', "true", f"{NEWEST_S} LIMIT 100")
expression("scan_page", '{"$knowledge": [], "limit": 20, "offset": 30}', "true", f"{NEWEST_K} LIMIT 20 OFFSET 30")
expression("scan_nested", '["$knowledge", ["$knowledge", ["$eq", "format", "plain"]], ["$statement"]]', f"{_X.format('format')} = 'plain'")
expression("eq", '["$knowledge", ["$eq", "format", "markdown"]]', f"{_X.format('format')} = 'markdown'")
expression("eq_json_value", '["$knowledge", ["$eq", "tags", ["architecture"]]]', f"{_X.format('tags')} = '[\"architecture\"]'")
expression("eq_one_operand", '["$knowledge", {"$eq": {"$like": ["name", "s0000%"]}}]', "name LIKE 's0000%'")
expression("ne", '["$statement", ["$ne", "predicate", "mentions"]]', "predicate <> 'mentions'")
expression("ne_missing_field", '["$knowledge", ["$ne", "no_such_field", "x"]]', f"{_X.format('no_such_field')} <> 'x'")
expression("gt_created", '["$knowledge", ["$gt", "created_at", "2025-01-01 00:00:00"]]', "created_at > TIMESTAMP '2025-01-01'")
expression("gte_lte_range", '["$statement", ["$gte", "created_at", "2024-06-01"], ["$lte", "$created_at", "2024-12-31 12:00:00"]]', "created_at BETWEEN TIMESTAMP '2024-06-01' AND TIMESTAMP '2024-12-31 12:00:00'")
expression("lt_validity", '["$statement", ["$lt", "tr_start", "2022-01-01"]]', "tr_start < TIMESTAMP '2022-01-01'")
expression("lt_lexicographic", '["$knowledge", ["$lt", "data", "M"]]', f"{_X.format('data')} < 'M'")
expression("contains_data", '["$knowledge", ["$contains", "data", "the window"]]', f"{_X.format('data')} LIKE '%the window%'")
expression("contains_tags", '["$knowledge", ["$contains", "tags", "architecture"]]', f"{_X.format('tags')} LIKE '%architecture%'")
expression("contains_scope_empty", '["$knowledge", ["$contains", "scopes", ""]]', f"{_X.format('scopes')} LIKE '%%'")
expression("contains_triple", '["$statement", ["$contains", "triple", "user"]]', f"{_X.format('triple')} LIKE '%user%'")
expression("like_name", '["$knowledge", ["$like", "name", "s%sess_1%turn__"]]', "name LIKE 's%sess_1%turn__'")
expression("like_created_at", '["$statement", ["$like", "created_at", "2024-1%"]]', "created_at::VARCHAR LIKE '2024-1%'")
expression("like_json", '["$knowledge", ["$like", "data", "[user]%"]]', f"{_X.format('data')} LIKE '[user]%'")
expression("content_pairs", '["$knowledge", ["$content", {"format": "plain", "tags": ["architecture"]}]]', f"{_X.format('format')} = 'plain' AND {_X.format('tags')} = " + "'[\"architecture\"]'")
expression("content_format", '["$knowledge", ["$content", {"format": "plain"}]]', f"{_X.format('format')} = 'plain'")
expression("content_empty", '["$knowledge", ["$content", {}]]', "true")
expression("and_or_not", '["$statement", ["$and", ["$or", ["$eq", "predicate", "prefers"], ["$eq", "predicate", "owns"]], ["$not", ["$like", "subject", "user%"]]]]', "(predicate = 'prefers' OR predicate = 'owns') AND NOT (subject LIKE 'user%')")
expression("or_empty", '["$statement", ["$or"]]', "true")
expression("and_empty", '["$statement", ["$and"]]', "true")
expression("not_null_semantics", '["$knowledge", ["$not", ["$eq", "scopes", "x"]]]', f"NOT ({_X.format('scopes')} = 'x')")
expression("literals_ignored", '{"$knowledge": ["$eq", "name", "x"], "limit": 50}', "true", f"{NEWEST_K} LIMIT 50")
expression("quote_ignored", '["$knowledge", ["$quote", ["$eq", "name", "x"]], ["$like", "name", "window%"]]', "name LIKE 'window%'")
expression("symbol_field", '["$statement", ["$eq", "$predicate", "owns"]]', "predicate = 'owns'")
expression("other_catalog", '{"$knowledge": [["$like", "name", "s%"]], "catalog": "statement", "limit": 10}', "name LIKE 's%'", f"{NEWEST_K} LIMIT 10")
expression("triple_subject", '["$statement", ["$triple", "user:primary", "$*", "$*"]]', "subject = 'user:primary'")
expression("triple_predicate", '["$statement", ["$triple", "$*", "mentions", "$*"]]', "predicate = 'mentions'")
expression("triple_pair", '["$statement", ["$triple", "user:primary", "prefers", "$*"]]', "subject = 'user:primary' AND predicate = 'prefers'")


@query(f"WITH {S} SELECT {S_OUT} FROM s WHERE triple = (SELECT max(triple) FROM s) AND object = (SELECT arg_max(object, triple) FROM s)")
def triple_full(spark: SparkSession, folder: str) -> DataFrame:
    """A statement by all three parts: a filter on its key."""
    found = tables(spark, folder)
    last = found.statement.groupBy().agg(F.max(F.struct("triple", "subject", "predicate", "object")).alias("m")).select("m.*").first()
    return execute(["$statement", ["$triple", last.subject, last.predicate, last.object]], found)


def _walk(depth: int, start: str, predicate: str | None, edges: str = "s") -> str:
    only = f"AND predicate = '{predicate}'" if predicate else ""
    return f"""r AS (SELECT '{start}' AS node, 0 AS d UNION SELECT e.object, r.d + 1 FROM r JOIN {edges} e ON e.subject = r.node {only} WHERE r.d + 1 < {depth}),
w AS (SELECT e.triple, min(r.d) + 1 AS hops FROM r JOIN {edges} e ON e.subject = r.node {only} GROUP BY ALL)"""


def walk(name: str, start: str, predicate: str | None, depth: int) -> None:
    @query(f"WITH RECURSIVE {S}, {_walk(depth, start, predicate)} SELECT triple, hops FROM w")
    def run(spark: SparkSession, folder: str) -> DataFrame:
        return k_hop(statement_rows(spark, folder), start, predicate, depth)

    QUERIES[name], ORACLES[name] = QUERIES.pop("run"), ORACLES.pop("run")


walk("khop_1", "user:primary", None, 1)
walk("khop_2_predicate", "user:primary", "prefers", 2)
walk("khop_3", "user:primary", None, 3)
walk("khop_cycle", "user:primary", None, 6)
walk("khop_nowhere", "no such node", None, 3)


@query(f"WITH RECURSIVE {S}, {_walk(2, 'user:primary', None)} SELECT {S_OUT} FROM s SEMI JOIN w USING (triple) WHERE predicate = 'mentions' {NEWEST_S} LIMIT 100")
def khop_in_query(spark: SparkSession, folder: str) -> DataFrame:
    """A walk and a predicate together; the order is that of creation."""
    return execute('["$statement", ["$k-hop", "user:primary", "$*", 2], ["$eq", "predicate", "mentions"]]', tables(spark, folder))


EDGES = """e AS (
  SELECT DISTINCT * FROM (
    SELECT c_name AS subject, 'located_in' AS predicate, n_name AS object FROM customer JOIN nation ON c_nationkey = n_nationkey
    UNION ALL SELECT n_name, 'part_of', r_name FROM nation JOIN region ON n_regionkey = r_regionkey
    UNION ALL SELECT s_name, 'located_in', n_name FROM supplier JOIN nation ON s_nationkey = n_nationkey
    UNION ALL SELECT c_name, 'placed', 'order:' || o_orderkey FROM customer JOIN orders ON c_custkey = o_custkey
    UNION ALL SELECT 'order:' || l_orderkey, 'contains', 'part:' || l_partkey FROM lineitem
    UNION ALL SELECT 'part:' || l_partkey, 'supplied_by', s_name FROM lineitem JOIN supplier ON l_suppkey = s_suppkey)),
g AS (SELECT subject || ',' || predicate || ',' || object AS triple, * FROM e)"""


def trade_graph(spark: SparkSession, folder: str) -> DataFrame:
    """Customers, orders, parts, suppliers, nations and regions as statements."""
    t = {n: table(spark, folder, n) for n in ("customer", "nation", "region", "supplier", "orders", "lineitem")}
    of = lambda df, s, p, o: df.select(s.alias("subject"), F.lit(p).alias("predicate"), o.alias("object"))
    order, part = (lambda c: F.concat(F.lit("order:"), F.col(c).cast("string"))), (lambda c: F.concat(F.lit("part:"), F.col(c).cast("string")))
    parts = [
        of(t["customer"].join(t["nation"], F.col("c_nationkey") == F.col("n_nationkey")), F.col("c_name"), "located_in", F.col("n_name")),
        of(t["nation"].join(t["region"], F.col("n_regionkey") == F.col("r_regionkey")), F.col("n_name"), "part_of", F.col("r_name")),
        of(t["supplier"].join(t["nation"], F.col("s_nationkey") == F.col("n_nationkey")), F.col("s_name"), "located_in", F.col("n_name")),
        of(t["customer"].join(t["orders"], F.col("c_custkey") == F.col("o_custkey")), F.col("c_name"), "placed", order("o_orderkey")),
        of(t["lineitem"], order("l_orderkey"), "contains", part("l_partkey")),
        of(t["lineitem"].join(t["supplier"], F.col("l_suppkey") == F.col("s_suppkey")), part("l_partkey"), "supplied_by", F.col("s_name")),
    ]
    rows = parts[0]
    for p in parts[1:]:
        rows = rows.unionByName(p)
    # By ranges of the subject, in its order: distinct needs no other shuffle, and a walk skips what it does not reach.
    return rows.repartitionByRange("subject").distinct().sortWithinPartitions("subject").withColumn("triple", triple_column(F.col("subject"), F.col("predicate"), F.col("object")))


@query(f"WITH RECURSIVE {EDGES}, {_walk(4, 'Customer#000000007', None, 'g')} SELECT triple, hops, subject, predicate, object FROM w JOIN g USING (triple)")
def khop_trade(spark: SparkSession, folder: str) -> DataFrame:
    """What can be reached from a customer in four steps: orders, parts, suppliers, nations."""
    return reachable(materialise(trade_graph(spark, folder), "graph"), "Customer#000000007", None, 4)


# vectors

_PROBE = "q AS (SELECT embedding::DOUBLE[] AS v FROM k WHERE embedding IS NOT NULL AND list_dot_product(embedding::DOUBLE[], embedding::DOUBLE[]) > 0 ORDER BY name LIMIT 1)"
_FAR = "CASE WHEN list_dot_product({0}.embedding::DOUBLE[], {0}.embedding::DOUBLE[]) > 0 THEN list_cosine_distance({0}.embedding::DOUBLE[], q.v) ELSE 'NaN'::DOUBLE END"


def probe(found: Tables) -> list[float]:
    """The vector that queries search for: that of the first name with one."""
    rows = found.knowledge.where(F.col("embedding").isNotNull() & F.exists("embedding", lambda v: v != 0))
    return rows.orderBy("name").select("embedding").first()[0]


def _nearest(t: str, key: str, limit: int) -> str:
    return f"(SELECT {key} AS key, {t}.content, round({_FAR.format(t)}, 6) AS distance FROM {t}, q WHERE embedding IS NOT NULL ORDER BY {_FAR.format(t)}, {key} LIMIT {limit})"


@query(f"WITH {K}, {_PROBE} SELECT key AS name, content, distance FROM {_nearest('k', 'name', 20)}")
def vector_knowledge(spark: SparkSession, folder: str) -> DataFrame:
    found = tables(spark, folder)
    return similar(found, probe(found), "knowledge", 20).withColumn("distance", F.round("distance", 6))


@query(f"WITH {K}, {S}, {_PROBE}, b AS (SELECT 'knowledge' AS catalog, * FROM {_nearest('k', 'name', 15)} UNION ALL SELECT 'statement', * FROM {_nearest('s', 'triple', 15)}) SELECT * FROM b ORDER BY distance, catalog, key LIMIT 15")
def vector_both(spark: SparkSession, folder: str) -> DataFrame:
    found = tables(spark, folder)
    return similar(found, probe(found), "both", 15).withColumn("distance", F.round("distance", 6))


@query(f"WITH {S}, {K}, {_PROBE} SELECT triple, round({_FAR.format('s')}, 6) AS distance FROM s, q WHERE embedding IS NOT NULL")
def vector_distances(spark: SparkSession, folder: str) -> DataFrame:
    """The distance of every statement with a vector; without one there is none."""
    found = tables(spark, folder)
    rows = found.statement.where(F.col("embedding").isNotNull())
    return rows.select("triple", F.round(cosine_distance(F.col("embedding"), probe(found)), 6).alias("distance"))


class _Stored:
    """Gives the same vector for any text."""

    def __init__(self, vector: list[float]):
        self.vector = vector

    def embed(self, text: str) -> list[float]:
        return self.vector


@query(f"WITH {K}, {_PROBE} SELECT {K_OUT} FROM k SEMI JOIN (SELECT key AS name FROM {_nearest('k', 'name', 30)}) USING (name) WHERE {_X.format('format')} = 'markdown' {NEWEST_K} LIMIT 30")
def similar_in_query(spark: SparkSession, folder: str) -> DataFrame:
    """Similarity first, on its own; the other conditions then apply to what it found."""
    found = tables(spark, folder)
    found.embedder = _Stored(probe(found))
    return execute('{"$knowledge": [["$similar", "any text"], ["$eq", "format", "markdown"]], "limit": 30}', found)


@query("WITH q AS (SELECT embedding::DOUBLE[] AS v, label FROM embeddings WHERE vec_id = 0), n AS (SELECT vec_id, e.label = q.label AS hit, list_cosine_distance(embedding::DOUBLE[], q.v) AS d FROM embeddings e, q WHERE vec_id <> 0) SELECT vec_id, round(d, 6) AS distance, hit FROM n ORDER BY d, vec_id LIMIT 50")
def vector_labels(spark: SparkSession, folder: str) -> DataFrame:
    """The embeddings closest to the first one, and whether they share its label."""
    rows = table(spark, folder, "embeddings")
    first = rows.where("vec_id = 0").first()
    near = rows.where("vec_id <> 0").select("vec_id", cosine_distance(F.col("embedding"), first.embedding).alias("d"), (F.col("label") == first.label).alias("hit"))
    return near.orderBy("d", "vec_id").limit(50).select("vec_id", F.round("d", 6).alias("distance"), "hit")


# full text, without stemming, which SQL lacks

_TEXT = "list_concat(regexp_extract_all(lower(strip_accents(regexp_replace({0}, '[一-鿿]+', ' ', 'g'))), '[\\p{{L}}\\p{{N}}\\p{{M}}]+'), flatten(list_transform(regexp_extract_all({0}, '[一-鿿]+'), lambda r: CASE WHEN len(r) = 1 THEN [r] ELSE list_transform(range(1, len(r)), lambda i: r[i : i + 1]) END)))"
_DOCS = f"""{K}, {S},
d0 AS (SELECT 'knowledge' AS catalog, name AS key, content, j FROM k UNION ALL SELECT 'statement', triple, content, j FROM s),
d AS (SELECT catalog, key, content, key AS t_key, coalesce(json_extract_string(j, '$.data'), '') AS t_data,
  coalesce(array_to_string(from_json(json_extract(j, '$.tags'), '["VARCHAR"]'), ' '), '') AS t_tags,
  CASE json_type(j, '$.synonyms') WHEN 'ARRAY' THEN array_to_string(from_json(json_extract(j, '$.synonyms'), '["VARCHAR"]'), ' ')
    WHEN 'OBJECT' THEN array_to_string(flatten(map_values(from_json(json_extract(j, '$.synonyms'), '{{"subject": ["VARCHAR"], "predicate": ["VARCHAR"], "object": ["VARCHAR"]}}')::JSON::MAP(VARCHAR, VARCHAR[]))), ' ') ELSE '' END AS t_synonyms FROM d0),
t AS (SELECT catalog, key, content, {_TEXT.format("t_key")} AS w_key, {_TEXT.format("t_data")} AS w_data, {_TEXT.format("t_tags")} AS w_tags, {_TEXT.format("coalesce(t_synonyms, '')")} AS w_synonyms FROM d),
l AS (SELECT *, (len(w_key) + len(w_data) + len(w_tags) + len(w_synonyms))::DOUBLE AS tokens FROM t),
st AS (SELECT count(*)::DOUBLE AS n_docs, avg(tokens) AS mean FROM l)"""


def _count(words: str, phrase: list[str]) -> str:
    test = " AND ".join(f"{words}[i + {k}] = '{w}'" for k, w in enumerate(phrase))
    return f"len(list_filter(range(1, len({words}) + 1), lambda i: {test}))"


def _search_sql(phrases: list[list[str]], holds: str, counted: list[str] | None = None) -> str:
    """Common tables up to ``m``: catalog, key, content, rank of matches, tf0.. being the weighted counts.

    ``counted`` says when a phrase adds to the rank, where that is not always.
    """
    tf = ", ".join(f"(10 * {_count('w_key', p)} + {_count('w_data', p)} + 5 * {_count('w_tags', p)} + 3 * {_count('w_synonyms', p)})::DOUBLE AS tf{i}" for i, p in enumerate(phrases))
    df = ", ".join(f"(count(*) FILTER (tf{i} > 0))::DOUBLE AS n{i}" for i in range(len(phrases)))
    idf = "(CASE WHEN ln((n_docs - n{0} + 0.5::DOUBLE) / (n{0} + 0.5::DOUBLE)) <= 0 THEN 1e-6::DOUBLE ELSE ln((n_docs - n{0} + 0.5::DOUBLE) / (n{0} + 0.5::DOUBLE)) END)"
    at = lambda i: f"(CASE WHEN {counted[i]} THEN tf{i} ELSE 0 END)" if counted else f"tf{i}"
    score = " + ".join(f"{idf.format(i)} * {at(i)} * 2.2::DOUBLE / ({at(i)} + 1.2::DOUBLE * (0.25::DOUBLE + 0.75::DOUBLE * tokens / mean))" for i in range(len(phrases)))
    return f"{_DOCS}, f AS (SELECT *, {tf} FROM l), df AS (SELECT {df} FROM f), m AS (SELECT catalog, key, content, -({score}) AS rank FROM f, df, st WHERE {holds})"


def search_query(name: str, text: str, phrases: list[list[str]], holds: str, catalog: str | None = None, counted: list[str] | None = None) -> None:
    only = f"WHERE catalog = '{catalog}'" if catalog else ""

    @query(f"WITH {_search_sql(phrases, holds, counted)} SELECT catalog, key, round(rank, 6) AS rank FROM m {only}")
    def run(spark: SparkSession, folder: str) -> DataFrame:
        found = searchable(spark, folder, stem=False).full_text().search(text, catalog, limit=None)
        return found.select("catalog", "key", F.round("rank", 6).alias("rank"))

    QUERIES[name], ORACLES[name] = QUERIES.pop("run"), ORACLES.pop("run")


search_query("search_word", "window", [["window"]], "tf0 > 0")
search_query("search_and", "the window had", [["the"], ["window"], ["had"]], "tf0 > 0 AND tf1 > 0 AND tf2 > 0")
search_query("search_phrase", "depends_on window", [["depends", "on"], ["window"]], "tf0 > 0 AND tf1 > 0")
search_query("search_or_not", "window garden OR bridge NOT user", [["window"], ["garden"], ["bridge"], ["user"]], "(tf0 > 0 AND tf1 > 0) OR (tf2 > 0 AND NOT tf3 > 0)", counted=["tf0 > 0 AND tf1 > 0"] * 2 + ["NOT tf3 > 0", "false"])
search_query("search_repeated_word", "window window", [["window"], ["window"]], "tf0 > 0")
search_query("search_catalog", "window", [["window"]], "tf0 > 0", "statement")
search_query("search_punctuation", "window? (garden)", [["window"], ["garden"]], "tf0 > 0 AND tf1 > 0")


@query(f"WITH {_search_sql([['window']], 'tf0 > 0')}, p AS (SELECT key FROM m WHERE catalog = 'knowledge' ORDER BY rank, key LIMIT 40) SELECT {K_OUT} FROM k WHERE name IN (SELECT key FROM p) AND {_X.format('format')} = 'plain' {NEWEST_K} LIMIT 40")
def search_in_query(spark: SparkSession, folder: str) -> DataFrame:
    """A search inside a query: its own page first, then the other conditions, then the order of creation."""
    return execute('{"$knowledge": [["$search", "window"], ["$eq", "format", "plain"]], "limit": 40}', searchable(spark, folder, stem=False))


@query(f"WITH {_search_sql([['window']], 'tf0 > 0')}, p AS (SELECT key FROM m WHERE catalog = 'knowledge' ORDER BY rank, key LIMIT 40 OFFSET 10) SELECT {K_OUT} FROM k WHERE name IN (SELECT key FROM p) {NEWEST_K} LIMIT 40 OFFSET 10")
def search_double_offset(spark: SparkSession, folder: str) -> DataFrame:
    """Limit and offset apply to the search and again to the query."""
    return execute('{"$knowledge": [["$search", "window"]], "limit": 40, "offset": 10}', searchable(spark, folder, stem=False))


@query(f"WITH {_DOCS} SELECT catalog, key, len(w_key) AS n_key, len(w_data) AS n_data, len(w_tags) AS n_tags, len(w_synonyms) AS n_synonyms FROM l")
def searched_texts(spark: SparkSession, folder: str) -> DataFrame:
    """How many words each searched text of each row has."""
    found = tables(spark, folder)
    docs = knowledge_docs(found.knowledge).unionByName(statement_docs(found.statement))
    size = lambda c: F.size(F.regexp_extract_all(F.lower(c), F.lit(r"([\p{L}\p{N}\p{M}]+)"), F.lit(1))).cast("long")
    return docs.select("catalog", "key", *[size(c).alias(f"n_{n}") for n, c in fields(F.col("key"), F.col("content")).items()])


@query(f"WITH {_DOCS}, w AS (SELECT DISTINCT catalog, key, unnest(list_concat(w_key, w_data, w_tags, w_synonyms)) AS term FROM l) SELECT term, count(*) AS docs FROM w GROUP BY term")
def vocabulary(spark: SparkSession, folder: str) -> DataFrame:
    """Every indexed word with the number of rows that have it."""
    return searchable(spark, folder, stem=False).full_text().postings.groupBy("term").agg(F.countDistinct("doc_id").alias("docs"))


# scalar functions

@query(f"WITH {K} SELECT name, concat_ws(chr(10), CASE WHEN json_array_length(j, '$.tags') > 0 THEN array_to_string(from_json(json_extract(j, '$.tags'), '[\"VARCHAR\"]'), ', ') END, name, coalesce(json_extract_string(j, '$.data'), '')) AS text FROM k")
def embedding_texts(spark: SparkSession, folder: str) -> DataFrame:
    """The text that a row's vector is made from."""
    return knowledge_rows(spark, folder).select("name", embedding_text(F.col("name"), F.col("content")).alias("text"))


_CSV = "CASE WHEN regexp_matches({0}, '[,\"\\n]') THEN '\"' || replace({0}, '\"', '\"\"') || '\"' ELSE {0} END"


@query(f"SELECT DISTINCT subject, predicate, object, {_CSV.format('subject')} || ',' || {_CSV.format('predicate')} || ',' || {_CSV.format('object')} AS made, triple FROM statement")
def triple_keys(spark: SparkSession, folder: str) -> DataFrame:
    """The key of each statement, made again from its parts."""
    rows = table(spark, folder, "statement")
    return rows.select("subject", "predicate", "object", triple_column(F.col("subject"), F.col("predicate"), F.col("object")).alias("made"), "triple").distinct()


@query("SELECT doc_id, json_object('format', 'markdown', 'data', text, 'tags', list_filter([lang, source], lambda x: x IS NOT NULL), 'synonyms', NULL, 'figures', NULL, 'scopes', CASE WHEN source IS NOT NULL THEN [source] END)::VARCHAR AS content FROM documents")
def content_json(spark: SparkSession, folder: str) -> DataFrame:
    """Documents as content JSON."""
    scopes = F.when(F.col("source").isNotNull(), F.array("source"))
    return table(spark, folder, "documents").select("doc_id", content_column(F.col("text"), F.array_compact(F.array("lang", "source")), scopes=scopes).alias("content"))


_MIME = "CASE lower(regexp_extract(f, '\\.([^./]+)$', 1)) WHEN 'png' THEN 'image/png' WHEN 'pdf' THEN 'application/pdf' WHEN 'mp4' THEN 'video/mp4' WHEN 'mp3' THEN 'audio/mpeg' WHEN 'jpeg' THEN 'image/jpeg' ELSE 'application/octet-stream' END"


@query(f"WITH f AS (SELECT p_partkey, p_name || '.' || ['PNG', 'pdf', 'mp4', 'mp3', 'jpeg', 'bin'][(p_partkey % 6)::INT + 1] AS f FROM part), m AS (SELECT *, {_MIME} AS mime FROM f) SELECT p_partkey, mime, CASE WHEN mime LIKE 'image/%' THEN 'image' WHEN mime LIKE 'video/%' THEN 'video' WHEN mime LIKE 'audio/%' THEN 'audio' ELSE 'file' END AS category FROM m")
def mime_types(spark: SparkSession, folder: str) -> DataFrame:
    """MIME type and category of file names."""
    kinds = F.array(*[F.lit(x) for x in ("PNG", "pdf", "mp4", "mp3", "jpeg", "bin")])
    mime = mime_type(F.concat("p_name", F.lit("."), F.get(kinds, F.pmod("p_partkey", F.lit(6)).cast("int"))))
    return table(spark, folder, "part").select("p_partkey", mime.alias("mime"), file_category(mime).alias("category"))


@query("SELECT event_id, props ->> '$.k' AS k FROM events WHERE (props ->> '$.k') < '5'")
def json_predicate(spark: SparkSession, folder: str) -> DataFrame:
    """Numbers in JSON compare as text."""
    field = F.get_json_object("props", "$.k")
    return table(spark, folder, "events").where(field < "5").select("event_id", field.alias("k"))


# metrics over evaluation results

_TYPES = "CASE WHEN contains(question_type, 'abs') THEN 'abstention' WHEN question_type IN ('single-session-user', 'single-session-assistant', 'single-session-preference') THEN 'information_extraction' WHEN question_type = 'multi-session' THEN 'multi_session_reasoning' WHEN question_type = 'knowledge-update' THEN 'knowledge_updates' WHEN question_type = 'temporal-reasoning' THEN 'temporal_reasoning' ELSE 'unknown' END"
_RUNS = f"e AS (SELECT DISTINCT run_id, question_id, lower(trim(question_type, E' \\t\\n\\r')) AS question_type, answer, question, answer_session_ids AS want, fts_retrieved_sessions AS fts, vec_retrieved_sessions AS vec, fts_top_keys, fts_latency_us, vec_latency_us FROM eval_result), a AS (SELECT *, {_TYPES} AS ability FROM e)"


def results(spark: SparkSession, folder: str) -> DataFrame:
    """Each run and question once, with tidy types."""
    rows = table(spark, folder, "eval_result").withColumn("question_type", F.lower(F.regexp_replace("question_type", r"^\s+|\s+$", "")))
    columns = ["question_type", "answer", "question", "answer_session_ids", "fts_retrieved_sessions", "vec_retrieved_sessions", "fts_top_keys", "fts_latency_us", "vec_latency_us"]
    once = rows.groupBy("run_id", "question_id").agg(F.max(F.struct(*columns)).alias("r")).select("run_id", "question_id", "r.*")
    return once.withColumn("ability", metrics.ability(F.col("question_type")))


_GAIN = "1.0::DOUBLE / len(bin(i::BIGINT))"
_CELLS = f"""c AS (SELECT method, ability, k, len(want) > 0 AS asked, want, coalesce(found, []) AS found FROM (SELECT 'fts' AS method, ability, want, fts AS found FROM a UNION ALL SELECT 'vec', ability, want, vec FROM a), (SELECT unnest([1, 3, 5, 10, 50]) AS k)),
r AS (SELECT method, ability, k,
  CASE WHEN NOT coalesce(asked, false) OR list_has_any(found[1:k], want) THEN 1.0 ELSE 0.0 END::DOUBLE AS recall,
  CASE WHEN NOT coalesce(asked, false) THEN 1.0::DOUBLE ELSE coalesce(list_sum(list_transform(range(1, least(len(found), k) + 1), lambda i: CASE WHEN list_contains(want, found[i]) THEN {_GAIN} ELSE 0 END)), 0)
    / list_sum(list_transform(range(1, least(len(want), k) + 1), lambda i: {_GAIN})) END AS ndcg FROM c)"""


@query(f"WITH {_RUNS}, {_CELLS} SELECT method, k, ability, count(*) AS n, round(avg(recall), 6) AS recall, round(avg(ndcg), 6) AS ndcg FROM r GROUP BY ALL")
def retrieval_metrics(spark: SparkSession, folder: str) -> DataFrame:
    """Recall and normalised gain at 1, 3, 5, 10 and 50 by method and ability."""
    report = metrics.retrieval_report(results(spark, folder), ["ability"], "answer_session_ids", {"fts": "fts_retrieved_sessions", "vec": "vec_retrieved_sessions"})
    return report.withColumns({"recall": F.round("recall", 6), "ndcg": F.round("ndcg", 6)})


@query(f"WITH {_RUNS}, {_CELLS} SELECT k, round(avg(recall) FILTER (method = 'vec') - avg(recall) FILTER (method = 'fts'), 6) AS delta FROM r GROUP BY k")
def improvement(spark: SparkSession, folder: str) -> DataFrame:
    """How much more vectors recall than words."""
    report = metrics.retrieval_report(results(spark, folder), [], "answer_session_ids", {"fts": "fts_retrieved_sessions", "vec": "vec_retrieved_sessions"})
    return metrics.improvement(report, "vec", "fts").withColumn("delta", F.round("delta", 6))


@query(f"WITH {_RUNS}, g AS (SELECT ability, list_sort(list(fts_latency_us)) AS v, count(*) AS n FROM a WHERE fts_latency_us IS NOT NULL GROUP BY ability) SELECT ability, n, v[1] AS min, v[n * 50 // 100 + 1] AS p50, v[n * 99 // 100 + 1] AS p99, v[n] AS max FROM g")
def latency_percentile(spark: SparkSession, folder: str) -> DataFrame:
    """Nearest-index percentiles of search times."""
    return metrics.latency_summary(results(spark, folder), ["ability"], "fts_latency_us")


@query(f"WITH {_RUNS}, t AS (SELECT CASE WHEN ability = 'abstention' THEN 'abstention' ELSE regexp_replace(question_type, '_abs$', '') END AS label, list_has_any(coalesce(fts[1:5], []), want) AS ok FROM a), b AS (SELECT label, sum(coalesce(ok, false)::INT)::BIGINT AS correct, count(*) AS n FROM t GROUP BY label), u AS (SELECT * FROM b UNION ALL SELECT 'overall', sum(correct)::BIGINT, sum(n)::BIGINT FROM b UNION ALL SELECT 'task-averaged', sum(correct)::BIGINT, sum(n)::BIGINT FROM b WHERE label <> 'abstention') SELECT label, correct, n, round(correct / n, 6) AS accuracy FROM u")
def accuracy(spark: SparkSession, folder: str) -> DataFrame:
    """Answers found among the first five sessions, by type, over all, and over answerable types."""
    ok = F.coalesce(F.arrays_overlap(F.slice("fts_retrieved_sessions", 1, 5), "answer_session_ids"), F.lit(False))
    return metrics.accuracy_report(results(spark, folder).withColumn("ok", ok), "question_type", "ok").withColumn("accuracy", F.round("accuracy", 6))


@query(f"WITH {_RUNS} SELECT coalesce(ability, 'OVERALL') AS ability, count(*) AS n, round(avg(CASE WHEN len(want) > 0 THEN list_has_any(coalesce(fts[1:10], []), want) ELSE true END::INT), 6) AS recall FROM a GROUP BY ROLLUP (ability)")
def recall_with_total(spark: SparkSession, folder: str) -> DataFrame:
    """Recall at ten by ability, with the total."""
    hit = metrics.recall_at(F.col("fts_retrieved_sessions"), F.col("answer_session_ids"), 10).cast("double")
    return metrics.with_totals(results(spark, folder), "ability", {"n": F.count(F.lit(1)), "recall": F.round(F.avg(hit), 6)})


@query(f"WITH {_RUNS}, k AS (SELECT run_id, question_id, unnest(fts_top_keys) AS key FROM a) SELECT DISTINCT key, CASE WHEN contains(key, '__') THEN split_part(key, '__', 2) END AS session FROM k")
def key_sessions(spark: SparkSession, folder: str) -> DataFrame:
    """The session that each retrieved key belongs to."""
    keys = results(spark, folder).select(F.explode("fts_top_keys").alias("key")).distinct()
    return keys.select("key", metrics.session_of(F.col("key")).alias("session"))


@query("SELECT l_returnflag, count(*) AS n, round(avg(l_quantity), 6) AS mean, median(l_quantity) AS median, round(stddev_samp(l_quantity), 6) AS deviation FROM lineitem GROUP BY ALL")
def score_summary(spark: SparkSession, folder: str) -> DataFrame:
    """Mean, median and sample deviation of scores."""
    found = metrics.score_summary(table(spark, folder, "lineitem"), ["l_returnflag"], "l_quantity")
    return found.withColumns({"mean": F.round("mean", 6), "deviation": F.round("deviation", 6)})


_STOP = "[" + ", ".join(f"'{w}'" for w in metrics.STOP_WORDS) + "]"
_STEM = "CASE WHEN len(w) <= 3 THEN w " + " ".join(f"WHEN ends_with(w, '{e}') AND len(w) >= {len(e) + 3} THEN left(w, len(w) - {len(e)})" for e in metrics.ENDINGS) + " WHEN ends_with(w, 's') AND NOT ends_with(w, 'ss') THEN left(w, len(w) - 1) ELSE w END"
_BAG = f"list_distinct(list_transform(list_filter(regexp_split_to_array(trim(regexp_replace(lower({{}}), '[^\\p{{{{L}}}}\\p{{{{N}}}}_]+', ' ', 'g')), ' +'), lambda w: len(w) > 1 AND NOT list_contains({_STOP}, w)), lambda w: {_STEM}))"


@query(f"WITH {_RUNS}, b AS (SELECT run_id, question_id, {_BAG.format('question')} AS p, {_BAG.format('answer')} AS g FROM a WHERE answer IS NOT NULL), f AS (SELECT *, len(list_intersect(p, g))::DOUBLE AS c FROM b) SELECT run_id, question_id, round(CASE WHEN c > 0 THEN 2 * (c / len(p)) * (c / len(g)) / (c / len(p) + c / len(g)) ELSE 0 END, 6) AS f1 FROM f")
def token_f1(spark: SparkSession, folder: str) -> DataFrame:
    """Overlap of the words of question and answer."""
    rows = results(spark, folder).where(F.col("answer").isNotNull())
    return rows.select("run_id", "question_id", F.round(metrics.token_f1(metrics.answer_tokens(F.col("question")), metrics.answer_tokens(F.col("answer"))), 6).alias("f1"))

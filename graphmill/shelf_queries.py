"""Queries that change, copy and reopen shelves, read and write files, and what the language refuses."""

from __future__ import annotations

import json
import os
import tempfile

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from graphmill import cli
from graphmill.errors import GraphmillError, ModelUnavailable
from graphmill.functions.content import archive_column, content_column, triple_column
from graphmill.operators.metrics import sample_rows
from graphmill.plans.compile import compile_query
from graphmill.plans.execute import Answer, Tables, execute
from graphmill.plans.expressions import parse_text
from graphmill.queries import _RUNS, K, K_OUT, NEWEST_K, S, S_OUT, _search_sql, index, query, results, shelf, table, tables
from graphmill.session import scratch_folder
from graphmill.sources import evaluation, synthetic
from graphmill.sources.embedding import HashEmbedder, NoEmbedder, pool
from graphmill.sources.registry import DEFAULT, Registry
from graphmill.sources.store import Shelf
from graphmill.workspace import Workspace


def copy_of(spark: SparkSession, folder: str, *names: str, embedder=None) -> Shelf:
    """A shelf of its own with a folder's tables, to be changed."""
    there, made = shelf(spark, folder), Shelf(spark, scratch_folder(spark, "copy"), embedder=embedder)
    for name in names:
        made.load(name, there.table(name))
    return made


# rows

_MADE = "json_object('format', 'markdown', 'data', {}, 'tags', {}, 'synonyms', NULL, 'figures', NULL, 'scopes', NULL)::VARCHAR"


@query(f"WITH {K} SELECT {K_OUT} FROM k WHERE name = (SELECT min(name) FROM k)")
def get_knowledge(spark: SparkSession, folder: str) -> DataFrame:
    """A row by its key."""
    there = shelf(spark, folder)
    row = there.get("knowledge", there.knowledge.agg(F.min("name")).first()[0])
    return spark.createDataFrame([(row.name, row.content, row.created_at)], "name string, content string, created_at timestamp_ntz")


@query(f"WITH {S} SELECT triple, subject, predicate, object, content FROM s WHERE triple = (SELECT max(triple) FROM s)")
def get_statement(spark: SparkSession, folder: str) -> DataFrame:
    there = shelf(spark, folder)
    row = there.get("statement", there.statement.agg(F.max("triple")).first()[0])
    return spark.createDataFrame([(row.triple, row.subject, row.predicate, row.object, row.content)], "triple string, subject string, predicate string, object string, content string")


@query(f"""WITH {K}, n AS (SELECT s_name AS name, {_MADE.format("'supplier of ' || n_name", "['supplier']")} AS content FROM supplier JOIN nation ON s_nationkey = n_nationkey)
SELECT name, content FROM k UNION ALL SELECT name, content FROM n WHERE name NOT IN (SELECT name FROM k)""")
def create_knowledge(spark: SparkSession, folder: str) -> DataFrame:
    """New rows beside those that exist."""
    made = copy_of(spark, folder, "knowledge")
    rows = table(spark, folder, "supplier").join(table(spark, folder, "nation"), F.col("s_nationkey") == F.col("n_nationkey"))
    made.create_many("knowledge", rows.select(F.col("s_name").alias("name"), content_column(F.concat(F.lit("supplier of "), "n_name"), F.array(F.lit("supplier"))).alias("content")), skip_existing=True)
    return made.knowledge.select("name", "content")


@query(f"""WITH {S}, n AS (SELECT s_name || ',located_in,' || n_name AS triple, s_name AS subject, 'located_in' AS predicate, n_name AS object FROM supplier JOIN nation ON s_nationkey = n_nationkey)
SELECT triple, subject, predicate, object FROM s UNION ALL SELECT * FROM n""")
def create_statement(spark: SparkSession, folder: str) -> DataFrame:
    made = copy_of(spark, folder, "statement")
    rows = table(spark, folder, "supplier").join(table(spark, folder, "nation"), F.col("s_nationkey") == F.col("n_nationkey"))
    rows = rows.select(F.col("s_name").alias("subject"), F.lit("located_in").alias("predicate"), F.col("n_name").alias("object"), content_column(F.lit("")).alias("content"))
    made.create_many("statement", rows.withColumn("triple", triple_column(F.col("subject"), F.col("predicate"), F.col("object"))))
    return made.statement.select("triple", "subject", "predicate", "object")


@query(r"SELECT r_name || ',path,c:\' || r_regionkey AS triple, 'c:\' || r_regionkey AS object FROM region WHERE r_regionkey > 0")
def like_backslash(spark: SparkSession, folder: str) -> DataFrame:
    """A backslash in a pattern stands for itself."""
    made = copy_of(spark, folder, "statement")
    object_ = F.concat(F.when(F.col("r_regionkey") > 0, F.lit("c:\\")).otherwise(F.lit("c:/")), F.col("r_regionkey").cast("string"))
    rows = table(spark, folder, "region").select(F.col("r_name").alias("subject"), F.lit("path").alias("predicate"), object_.alias("object"))
    made.create_many("statement", rows.withColumn("triple", triple_column(F.col("subject"), F.col("predicate"), F.col("object"))))
    return execute(["$statement", ["$like", "object", "%\\%"]], Tables(made.knowledge, made.statement)).select("triple", "object")


_NEW = """'{"data":"new words planned","tags":[]}'"""


@query(f"WITH {K} SELECT name, CASE WHEN name LIKE 'window%' THEN {_NEW} ELSE content END AS content, created_at FROM k")
def upsert_latest(spark: SparkSession, folder: str) -> DataFrame:
    """A second state of some rows; their time of creation stays."""
    made = copy_of(spark, folder, "knowledge")
    made.put_many("knowledge", made.knowledge.where("name LIKE 'window%'").withColumn("content", F.expr(_NEW)))
    return made.knowledge.select("name", "content", "created_at")


@query(f"WITH {S} SELECT triple, CASE WHEN predicate = 'owns' THEN TIMESTAMP '2030-01-01' ELSE tr_end END AS tr_end FROM s")
def update_statement(spark: SparkSession, folder: str) -> DataFrame:
    """A new end of validity for some statements."""
    made = copy_of(spark, folder, "statement")
    made.put_many("statement", made.statement.where("predicate = 'owns'").withColumn("tr_end", F.expr("timestamp_ntz'2030-01-01'")))
    return made.statement.select("triple", "tr_end")


_MENTIONED = "(SELECT object FROM statement WHERE predicate = 'mentions' AND object IS NOT NULL)"


@query(f"WITH {K} SELECT {K_OUT} FROM k WHERE name NOT IN {_MENTIONED}")
def delete_mentioned(spark: SparkSession, folder: str) -> DataFrame:
    """What is left when all mentioned rows are deleted."""
    made = copy_of(spark, folder, "knowledge")
    made.delete_many("knowledge", table(spark, folder, "statement").where("predicate = 'mentions' AND object IS NOT NULL").select("object"))
    return made.knowledge.select("name", "content", "created_at")


@query(f"WITH {S} SELECT triple, predicate FROM s WHERE predicate <> 'owns'")
def delete_statement(spark: SparkSession, folder: str) -> DataFrame:
    made = copy_of(spark, folder, "statement")
    made.delete_many("statement", made.statement.where("predicate = 'owns'").select("triple"))
    return made.statement.select("triple", "predicate")


@query(f"WITH {K} SELECT name, CASE WHEN name LIKE 'window%' THEN {_NEW} ELSE content END AS content FROM k WHERE name NOT IN {_MENTIONED}")
def compacted(spark: SparkSession, folder: str) -> DataFrame:
    """Changes and deletions, the base written anew, opened again."""
    made = copy_of(spark, folder, "knowledge")
    made.put_many("knowledge", made.knowledge.where("name LIKE 'window%'").withColumn("content", F.expr(_NEW)))
    made.delete_many("knowledge", table(spark, folder, "statement").where("predicate = 'mentions' AND object IS NOT NULL").select("object"))
    made.compact()
    return Shelf(spark, made.path).knowledge.select("name", "content")


@query(f"WITH {K}, {S} SELECT 'knowledge' AS catalog, name AS key, content FROM k UNION ALL SELECT 'statement', triple, content FROM s")
def exported(spark: SparkSession, folder: str) -> DataFrame:
    """Both tables of an exported shelf."""
    path = scratch_folder(spark, "export")
    shelf(spark, folder).export(path)
    out = Shelf(spark, path)
    return out.knowledge.select(F.lit("knowledge").alias("catalog"), F.col("name").alias("key"), "content").unionByName(out.statement.select(F.lit("statement").alias("catalog"), F.col("triple").alias("key"), "content"))


@query(f"WITH {K}, p AS (SELECT {K_OUT} FROM k WHERE name LIKE 's%' {NEWEST_K} LIMIT 30 OFFSET 5) SELECT name, (SELECT count(*) FROM p) AS total_count FROM p")
def total_count(spark: SparkSession, folder: str) -> DataFrame:
    """The rows of a page with their number."""
    return Answer(execute('{"$knowledge": [["$like", "name", "s%"]], "limit": 30, "offset": 5}', tables(spark, folder))).counted().select("name", "total_count")


# vectors

@query(f"""WITH {K}, c AS (SELECT min(name) FILTER (embedding IS NOT NULL) AS gone, min(name) FILTER (embedding IS NULL) AS come FROM k)
SELECT name, embedding IS NOT NULL AND name <> gone OR name = come AS has_vector FROM k, c""")
def set_and_clear_vectors(spark: SparkSession, folder: str) -> DataFrame:
    """One vector cleared and one stored; which rows have one then."""
    made = copy_of(spark, folder, "knowledge")
    made.set_embedding("knowledge", made.with_embeddings("knowledge").agg(F.min("name")).first()[0], None)
    without = shelf(spark, folder).without_embeddings("knowledge")
    made.set_embedding("knowledge", without.agg(F.min("name")).first()[0], [1.0] + [0.0] * 47)
    has = lambda rows, value: rows.select("name", F.lit(value).alias("has_vector"))
    return has(made.with_embeddings("knowledge"), True).unionByName(has(made.without_embeddings("knowledge"), False))


_TAGGED = "j IS NOT NULL AND json_type(j, '$.tags') <> 'NULL'"


@query(f"""WITH {K}, {S}, m AS (SELECT {_TAGGED} AS fits FROM k WHERE embedding IS NULL UNION ALL SELECT {_TAGGED} FROM s WHERE embedding IS NULL)
SELECT count(*) FILTER (fits) AS created, count(*) FILTER (NOT coalesce(fits, false)) AS errors, (SELECT count(embedding) FROM k) AS skipped,
  (SELECT count(embedding) FROM k) + (SELECT count(embedding) FROM s) + count(*) FILTER (fits) AS present FROM m""")
def backfill_missing(spark: SparkSession, folder: str) -> DataFrame:
    """Vectors for all rows of both tables that have none, and how many rows have one then."""
    made = copy_of(spark, folder, "knowledge", "statement", embedder=HashEmbedder(48))
    done = made.backfill()
    present = sum(made.with_embeddings(t).count() for t in ("knowledge", "statement"))
    return spark.createDataFrame([(done["created"], done["errors"], done["skipped"], present)], "created long, errors long, skipped long, present long")


@query("SELECT * FROM (VALUES ('cls', [1.0::DOUBLE, 0.0::DOUBLE]), ('last_token', [3.0::DOUBLE, 2.0::DOUBLE]), ('mean', [2.0::DOUBLE, 1.0::DOUBLE]), ('none', [])) t(pooling, vector)")
def pooling(spark: SparkSession, folder: str) -> DataFrame:
    """One vector of three tokens' vectors, the last being padding; no vector without a model."""
    hidden, mask = np.array([[1.0, 0], [3, 2], [9, 9]]), np.array([1, 1, 0])
    rows = [(p, pool(hidden, mask, p).tolist()) for p in ("cls", "last_token", "mean")]
    try:
        rows.append(("none", NoEmbedder().embed("text")))
    except ModelUnavailable:
        rows.append(("none", []))
    return spark.createDataFrame(rows, "pooling string, vector array<double>")


# the kept index: stems, and changes since it was written

#: The words whose stem is that of the searched one.
_FORMS = ("plan", "plans", "planned", "planning")


def _stemmed(changed: str = "") -> str:
    """SQL of a search for any of the forms; ``changed`` replaces the knowledge rows."""
    sql = f"WITH {_search_sql([['plan']], 'tf0 > 0')} SELECT catalog, key, round(rank, 6) AS rank FROM m"
    sql = sql.replace("= 'plan'", "IN (" + ", ".join(f"'{w}'" for w in _FORMS) + ")")
    return sql.replace(K, K.replace("k AS", "k0 AS", 1) + changed) if changed else sql


def _found(index) -> DataFrame:
    return index.search("planned", limit=None).select("catalog", "key", F.round("rank", 6).alias("rank"))


@query(_stemmed())
def search_stemmed(spark: SparkSession, folder: str) -> DataFrame:
    """All matches with stemming: planned finds plan, plans and planning."""
    return _found(index(spark, folder, True))


_LEFT = f""", k1 AS (SELECT name, CASE WHEN name LIKE 'window%' THEN {_NEW} ELSE content END AS content FROM k0 WHERE name NOT IN {_MENTIONED}),
k AS (SELECT *, CASE WHEN json_valid(content) THEN content::JSON END AS j FROM k1)"""


@query(_stemmed(_LEFT))
def search_after_changes(spark: SparkSession, folder: str) -> DataFrame:
    """A search after rows were changed and deleted since the index was written, in a shelf opened again."""
    made = copy_of(spark, folder, "knowledge", "statement")
    made.rebuild_index()
    made.put_many("knowledge", made.knowledge.where("name LIKE 'window%'").withColumn("content", F.expr(_NEW)))
    made.delete_many("knowledge", table(spark, folder, "statement").where("predicate = 'mentions' AND object IS NOT NULL").select("object"))
    return _found(Shelf(spark, made.path).full_text())


# files

@query("SELECT 'notes/' || r_name || '.txt' AS name, length(r_name || ' ' || r_regionkey) AS length FROM region")
def archives(spark: SparkSession, folder: str) -> DataFrame:
    """Files put into a shelf's archive, and listed."""
    made = Shelf(spark, scratch_folder(spark, "archive"))
    with tempfile.TemporaryDirectory() as local:
        for r in table(spark, folder, "region").collect():  # five rows
            path = os.path.join(local, "file")
            with open(path, "w") as out:
                out.write(f"{r.r_name} {r.r_regionkey}")
            made.store_archive(path, f"notes/{r.r_name}.txt")
    listed = spark.createDataFrame([(n,) for n in made.list_archives()], "name string")
    sizes = made.archive_files().select(F.concat(F.lit("notes/"), F.url_decode(F.element_at(F.split("path", "/"), -1))).alias("name"), "length")
    return listed.join(sizes, "name")


def workspace(spark: SparkSession, home: str) -> Workspace:
    """A workspace whose list of shelves is a file of the driver; the shelves lie in the shared folder."""
    known = Registry(home)
    if DEFAULT not in known.shelves:
        known.register(DEFAULT, scratch_folder(spark, "default"))
    return Workspace(spark, home, lambda _: None)


@query("SELECT 'pic.png' AS name, 'archive' AS tag1, 'image' AS tag2, 'png' AS tag3, 3 AS size_bytes, 'pic.png,is_a,archive' AS triple")
def archive_file(spark: SparkSession, folder: str) -> DataFrame:
    """A stored file's knowledge row and statement."""
    with tempfile.TemporaryDirectory() as home:
        space = workspace(spark, home)
        with open(os.path.join(home, "pic.png"), "w") as out:
            out.write("abc")
        space.store_file("default", os.path.join(home, "pic.png"))
        there = space.shelf()
        row, link = there.get("knowledge", "pic.png"), there.statement.first()
        content = json.loads(row.content)
        return spark.createDataFrame([("pic.png", *content["tags"], json.loads(content["data"])["size_bytes"], link.triple)], "name string, tag1 string, tag2 string, tag3 string, size_bytes int, triple string")


@query("SELECT p_partkey, CASE WHEN p_partkey % 3 > 0 THEN 'a/' || p_name || '.png' END AS path FROM part")
def archive_prefix(spark: SparkSession, folder: str) -> DataFrame:
    """The path behind an archived figure; other figures have none."""
    figure = F.concat(F.when(F.col("p_partkey") % 3 > 0, F.lit("archive://a/")).otherwise(F.lit("https://a/")), "p_name", F.lit(".png"))
    return table(spark, folder, "part").select("p_partkey", archive_column(figure).alias("path"))


@query("SELECT * FROM (VALUES ('default', true), ('other', true), ('other', false)) t(name, connected)")
def registry(spark: SparkSession, folder: str) -> DataFrame:
    """Shelves connected, known to the next workspace, and disconnected."""
    with tempfile.TemporaryDirectory() as home:
        workspace(spark, home).connect(scratch_folder(spark, "elsewhere"), "other")
        again = workspace(spark, home)
        rows = [(n, c) for n, _, c in again.list()]
        again.disconnect("other")
        rows += [(n, c) for n, c in (("other", "other" in again.open),)]
    return spark.createDataFrame(rows, "name string, connected boolean")


@query("SELECT * FROM (VALUES (0, ['a', 'b'], ['a', 'b']), (1, [], []), (2, ['x'], ['x', '']), (3, ['p', 'q'], ['p', 'q'])) t(i, listed, scopes)")
def command_lists(spark: SparkSession, folder: str) -> DataFrame:
    """Lists as commands take them."""
    return spark.createDataFrame([(i, cli.listed(t), cli.scopes(t)) for i, t in enumerate(("a, b", "", "x,", "p,,q"))], "i int, listed array<string>, scopes array<string>")


@query(f"WITH {S} SELECT triple, CASE WHEN epoch_us(s.created_at) % 1000000 = 0 THEN strftime(s.created_at, '%Y-%m-%d %H:%M:%S') ELSE strftime(s.created_at, '%Y-%m-%d %H:%M:%S.%f') END AS created_at, tr_end IS NOT NULL AS has_end FROM s ORDER BY s.created_at DESC, triple LIMIT 50")
def result_rows(spark: SparkSession, folder: str) -> DataFrame:
    """A page of statements as the JSON that commands print: absent ends are left out."""
    found = json.loads(cli.show(execute('{"$statement": [], "limit": 50}', tables(spark, folder))))
    return spark.createDataFrame([(r["triple"], r["created_at"], "tr_end" in r) for r in found], "triple string, created_at string, has_end boolean")


@query(f"WITH {_RUNS} SELECT run_id, question_id, answer, fts_top_keys, vec_latency_us FROM a")
def result_files(spark: SparkSession, folder: str) -> DataFrame:
    """Results written as JSON lines, a folder for each run, and read again."""
    path = scratch_folder(spark, "results")
    rows = results(spark, folder)
    rows.write.partitionBy("run_id").option("ignoreNullFields", False).json(path)
    back = spark.read.schema(evaluation.RESULTS + ", run_id string").json(path)
    return back.select("run_id", "question_id", "answer", "fts_top_keys", "vec_latency_us")


_SPEAKERS = "n_name || '_a'"


@query(f"""WITH t AS (SELECT r_name, n_name, n_nationkey, row_number() OVER (PARTITION BY n_regionkey ORDER BY n_nationkey) AS i FROM nation JOIN region ON n_regionkey = r_regionkey)
SELECT r_name || '__D1_' || i AS name, {_MADE.format("'[' || n_name || '] says ' || n_nationkey", "[r_name, 'session_1', n_name, 'Ann', 'Bo', 'May']")} AS content FROM t
UNION ALL SELECT r_name || '__summary_1', {_MADE.format("'all of ' || r_name", "[r_name, 'session_1', 'summary']")} FROM region""")
def dialogues(spark: SparkSession, folder: str) -> DataFrame:
    """A file of conversations as knowledge rows: a region is one, its nations speak."""
    regions = {r.r_regionkey: r.r_name for r in table(spark, folder, "region").collect()}
    nations = table(spark, folder, "nation").orderBy("n_nationkey").collect()  # 25 rows
    out = []
    for number, region in regions.items():
        own = [n for n in nations if n.n_regionkey == number]
        turns = [{"speaker": n.n_name, "dia_id": f"D1:{i}", "text": f"says {n.n_nationkey}"} for i, n in enumerate(own, 1)]
        conversation = {"speaker_a": "Ann", "speaker_b": "Bo", "session_1": turns, "session_1_date_time": "May"}
        out.append({"sample_id": region, "conversation": conversation, "session_summary": {"session_1": f"all of {region}"}, "qa": []})
    path = scratch_folder(spark, "dialogues")
    spark.createDataFrame([(json.dumps(out),)], "value string").coalesce(1).write.text(path)
    return evaluation.dialogues(spark, path)


@query(f"""WITH t AS (SELECT r_name AS q, r_regionkey AS o, n_name AS s, i FROM region JOIN nation ON n_regionkey = r_regionkey, (SELECT unnest([0, 1]) AS i) UNION ALL SELECT r_name, r_regionkey, 'shared', i FROM region, (SELECT unnest([0, 1]) AS i)),
f AS (SELECT * FROM t QUALIFY row_number() OVER (PARTITION BY s, i ORDER BY o) = 1)
SELECT q || '__' || s || '__turn_' || i AS name,
  {_MADE.format("'[' || ['user', 'assistant'][i + 1] || '] ' || s || ' ' || i", "list_filter([q, s, 'turn_' || i, ['user', 'assistant'][i + 1], 'May', CASE WHEN s = 'shared' OR i = 1 THEN 'evidence' END], lambda x: x IS NOT NULL)")} AS content FROM f""")
def haystacks(spark: SparkSession, folder: str) -> DataFrame:
    """A file of questions with their sessions: a region asks, its nations and one session that all share are the history."""
    nations = table(spark, folder, "nation").collect()
    out = []
    for region in table(spark, folder, "region").orderBy("r_regionkey").collect():
        names = [n.n_name for n in nations if n.n_regionkey == region.r_regionkey] + ["shared"]
        history = [[{"role": "user", "content": f"{s} 0"}, {"role": "assistant", "content": f"{s} 1", "has_answer": True}] for s in names]
        out.append({"question_id": region.r_name, "haystack_dates": ["May"] * len(names), "haystack_session_ids": names, "haystack_sessions": history, "answer_session_ids": ["shared"]})
    path = scratch_folder(spark, "haystacks")
    spark.createDataFrame([(json.dumps(out),)], "value string").coalesce(1).write.text(path)
    return evaluation.haystacks(spark, path)


@query("SELECT CASE WHEN i < 20 THEN 'needle_' || lpad(i::VARCHAR, 4, '0') ELSE 'knowledge_' || lpad((i - 20)::VARCHAR, 6, '0') END AS name, i < 20 AS needle FROM range(1000) t(i)")
def synthetic_knowledge(spark: SparkSession, folder: str) -> DataFrame:
    """Made-up rows, and which are needles by their tags."""
    return synthetic.knowledge(spark, 1_000, 20).select("name", F.contains(F.get_json_object("content", "$.tags"), F.lit("needle")).alias("needle"))


@query("SELECT 2000 AS n, 2000 AS different, 0 AS loops")
def synthetic_statements(spark: SparkSession, folder: str) -> DataFrame:
    made = synthetic.statements(spark, 2_000)
    return made.agg(F.count(F.lit(1)).alias("n"), F.count_distinct("subject", "predicate", "object").alias("different"), F.count_if(F.col("subject") == F.col("object")).alias("loops"))


@query("SELECT 100 AS n, 100 AS different, 0 AS others, true AS same")
def sample_of_results(spark: SparkSession, folder: str) -> DataFrame:
    """A fixed random sample: as many rows as asked for, all of the table, the same however it is partitioned."""
    rows = table(spark, folder, "orders").select("o_orderkey")
    one, two = sample_rows(rows, 100, "o_orderkey"), sample_rows(rows.repartition(7), 100, "o_orderkey")
    both = one.join(two, "o_orderkey", "left_semi").agg((F.count(F.lit(1)) == 100).alias("same"))
    counts = one.agg(F.count(F.lit(1)).alias("n"), F.count_distinct("o_orderkey").alias("different"))
    others = one.join(rows, "o_orderkey", "left_anti").agg(F.count(F.lit(1)).alias("others"))
    return counts.join(F.broadcast(others)).join(F.broadcast(both))


#: Queries of the language and what becomes of them.
LANGUAGE = {
    "[]": "EvaluationError",
    '["$knowledge"': "ParseError",
    '"$knowledge"': "EvaluationError",
    '["$count"]': "EvaluationError",
    '["$knowledge", ["$eq", "name"]]': "ok",
    '["$knowledge", ["$eq", "name", "a", "b"]]': "EvaluationError",
    '["$knowledge", ["$not"]]': "EvaluationError",
    '["$knowledge", ["$between", "name", 1, 2]]': "EvaluationError",
    '["$knowledge", ["$k-hop", "x", "$*", 2]]': "EvaluationError",
    '["$statement", ["$k-hop", "x", "$*", 0]]': "EvaluationError",
    '["$statement", ["$triple", "$*", "$*", "$*"]]': "EvaluationError",
    '["$statement", ["$triple", "x", "$*"]]': "EvaluationError",
    '["$knowledge", 42, true, null]': "ok",
    '["$knowledge", ["$eq", "$name", "$$name"]]': "ok",
}


def _outcome(text: str) -> str:
    try:
        compile_query(parse_text(text))
    except GraphmillError as error:
        return type(error).__name__
    return "ok"


@query("SELECT * FROM (VALUES " + ", ".join("('{}', '{}')".format(t.replace("'", "''"), o) for t, o in LANGUAGE.items()) + ") t(expression, outcome)")
def language_outcomes(spark: SparkSession, folder: str) -> DataFrame:
    """Which expressions are accepted, and how others are refused."""
    return spark.createDataFrame([(t, _outcome(t)) for t in LANGUAGE], "expression string, outcome string")

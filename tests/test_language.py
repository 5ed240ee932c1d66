import json

import pytest

from graphmill.errors import EvaluationError, ParseError, ValidationError
from graphmill.plans.compile import Predicate, Search, Similar, Value, Walk, compile_query, condition
from graphmill.plans.execute import Tables, execute, similar
from graphmill.plans.expressions import Call, Items, Literal, Mapping, Quoted, Symbol, parse, parse_text, to_text, to_value


def test_parse_forms():
    for plain in (-7.5, "two words", False, None):
        assert parse(plain) == Literal(plain)
    assert parse("$since") == Symbol("$since") and parse("$$since") == Literal("$since") and parse("$$") == Literal("$")
    # Names of operators stand for themselves outside operator position, but for $triple and the wildcard.
    assert parse("$lte") == Literal("$lte") and parse("$triple") == Symbol("$triple") and parse("$*") == Symbol("$*")
    assert len(parse(["$or", 1, 2, 3]).args) == 3 and parse(["$or"]).args == ()
    assert parse({"$not": None}) == Call("$not", (Literal(None),), {})
    assert parse({"$similar": "rivers", "limit": 3}).meta == {"limit": 3}
    assert parse([0.5, ["z"]]) == Items((Literal(0.5), Items((Literal("z"),)))) and parse([]) == Items(()) and parse({}) == Mapping({})
    assert parse(["$quote", ["$like", "a"]]) == Quoted(Call("$like", (Literal("a"),), {}))
    assert parse({"$quote": "$since"}) == Quoted(Symbol("$since"))
    assert parse(["$nowhere", []]).op == "$nowhere"


@pytest.mark.parametrize("bad", [["$quote"], ["$quote", 1, 2], {"$a": 1, "$b": 2}])
def test_parse_errors(bad):
    with pytest.raises(ParseError):
        parse(bad)


def test_bad_json():
    with pytest.raises(ParseError):
        parse_text("{not json")


def test_back_to_values():
    for value in (["$eq", "a", [1, {"b": None}]], {"$search": ["x"], "catalog": "k"}, [1, [2]], {"a": 1}):
        assert to_value(parse(value)) == value
    assert to_text(["a", "b"]) == '["a","b"]' and to_text(None) == "null" and to_text(True) == "true" and to_text(5) == "5" and to_text("x") == "x"


@pytest.mark.parametrize(
    "bad",
    ["not a query", 5, ["$eq", "a", "b"], ["$quote", ["$knowledge"]], ["$search", "x"], ["$knowledge", "$field"], ["$knowledge", [1]], ["$knowledge", {"a": 1}], ["$knowledge", ["$cond", 1]], ["$knowledge", ["$and", ["$search", "x"]]], ["$knowledge", ["$or", "x"]], ["$knowledge", ["$not"]], ["$knowledge", ["$not", ["$eq", "a", "b"], ["$eq", "a", "b"]]],
     ["$knowledge", ["$eq", "a", "b", "c"]], ["$knowledge", ["$eq"]], ["$knowledge", ["$eq", 5, "b"]], ["$knowledge", ["$contains", "a"]], ["$knowledge", ["$like", "a"]], ["$knowledge", ["$content", "x"]], ["$knowledge", ["$content"]], ["$knowledge", ["$search"]], ["$knowledge", ["$similar"]],
     ["$statement", ["$triple", "$*", "$*", "$*"]], ["$statement", ["$triple", "a", "b"]], ["$statement", ["$triple", "a", "b", 5]], ["$knowledge", ["$k-hop", "a", "$*", 1]], ["$statement", ["$k-hop", "a", "$*", 0]], ["$statement", ["$k-hop", "a", "$*", 1.5]], ["$statement", ["$k-hop", "a", "$*", "1"]], ["$statement", ["$k-hop", 1, "$*", 1]], ["$statement", ["$k-hop", "a", 5, 1]], ["$statement", ["$k-hop", "a", "$*"]],
     ["$knowledge", ["$eq", "a'b", "c"]], ["$knowledge", ["$eq", "$", "c"]]],
)
def test_evaluation_errors(spark, bad):
    with pytest.raises(EvaluationError):
        compile_query(parse(bad))


def test_conditions(spark):
    assert condition(parse(["$search", "x", "ignored"])) == Search("x") and condition(parse(["$similar", ["a"]])) == Similar('["a"]')
    assert condition(parse(["$k-hop", "a", "$*", 2])) == Walk("a", None, 2) and condition(parse(["$k-hop", "a", "p", 2])) == Walk("a", "p", 2)
    assert condition(parse("x")) == Value("x") and condition(parse(["$quote", ["$eq", 1]])) == Value(["$eq", 1])
    assert isinstance(condition(parse(["$statement"])), Predicate)


def test_options(spark):
    q = compile_query(parse({"$knowledge": [["$eq", "a", "b"]], "limit": 7, "offset": 2, "catalog": "statement", "other": 1}))
    assert (q.options.limit, q.options.offset, q.options.catalog, len(q.predicates)) == (7, 2, "statement", 1)
    q = compile_query(parse({"$statement": [], "limit": 1.5, "offset": "3", "catalog": 4}))
    assert (q.options.limit, q.options.offset, q.options.catalog) == (100, 0, None)
    assert compile_query(parse({"$knowledge": ["$eq", "name", "x"]})).predicates == []


@pytest.fixture(scope="module")
def small(spark):
    content = lambda **x: json.dumps({"format": "markdown", "data": "", "tags": [], "scopes": None} | x, separators=(",", ":"))
    k = [("a", content(data="Rust is fast", tags=["x", "y"], k=5, deep={"in": "v"}), "2024-01-01"), ("b", content(data="100%", scopes=["p", ""]), "2024-01-02"), ("c", content(k=10), "2024-01-02"), ("d", None, "2023-01-01")]
    s = [("A,knows,B", "A", "knows", "B"), ("B,knows,A", "B", "knows", "A"), ('"C, D",knows,A', "C, D", "knows", "A"), ("B,likes,E", "B", "likes", "E")]
    knowledge = spark.createDataFrame(k, "name string, content string, created_at string").selectExpr("name", "content", "cast(created_at AS timestamp_ntz) AS created_at", "array(1f, 0f) AS embedding")
    knowledge = knowledge.selectExpr("name", "content", "created_at", "CASE name WHEN 'a' THEN array(1f, 0f) WHEN 'b' THEN array(1f, 1f) WHEN 'c' THEN array(0f, 0f) END AS embedding")
    statement = spark.createDataFrame(s, "triple string, subject string, predicate string, object string").selectExpr("*", "'{}' AS content", "timestamp_ntz'2024-01-01' AS created_at", "cast(null AS timestamp_ntz) AS tr_start", "cast(null AS timestamp_ntz) AS tr_end", "array(0f, 1f) AS embedding")
    return Tables(knowledge, statement)


def names(rows, key="name"):
    return [r[key] for r in rows.collect()]


@pytest.mark.parametrize(
    "query,expected",
    [
        (["$knowledge"], ["b", "c", "a", "d"]),
        ({"$knowledge": [], "limit": 2, "offset": 1}, ["c", "a"]),
        (["$knowledge", ["$lt", "k", "5"]], ["c"]),  # text order: "10" < "5"
        (["$knowledge", ["$eq", "k", 5]], ["a"]),
        (["$knowledge", ["$eq", "deep.in", "v"]], ["a"]),
        (["$knowledge", ["$eq", "tags", ["x", "y"]]], ["a"]),
        (["$knowledge", ["$contains", "tags", "x"]], ["a"]),
        (["$knowledge", ["$contains", "data", "rust"]], []),
        (["$knowledge", ["$contains", "data", "%"]], ["b", "c", "a"]),
        (["$knowledge", ["$contains", "scopes", ""]], ["b"]),
        (["$knowledge", ["$like", "name", "_"]], ["b", "c", "a", "d"]),
        (["$knowledge", ["$like", "name", "a\\b"]], []),
        (["$knowledge", ["$content", {"format": "markdown", "k": 10}]], ["c"]),
        (["$knowledge", ["$not", ["$eq", "k", "5"]]], ["c"]),
        (["$knowledge", ["$ne", "missing", "x"]], []),
        (["$knowledge", ["$gt", "created_at", "2024-01-01"]], ["b", "c"]),
        (["$knowledge", ["$like", "created_at", "2024-01-02%"]], ["b", "c"]),
        (["$knowledge", ["$search", "rust"]], ["a"]),
        (["$knowledge", ["$search", "rust"], ["$eq", "name", "b"]], []),
    ],
)
def test_knowledge_queries(small, query, expected):
    assert names(execute(query, small)) == expected


def test_statement_queries(small):
    got = lambda *c: names(execute(["$statement", *c], small), "triple")
    assert got(["$triple", "C, D", "knows", "A"]) == ['"C, D",knows,A']
    assert got(["$triple", "$*", "knows", "A"]) == ['"C, D",knows,A', "B,knows,A"]
    assert got(["$contains", "triple", "A"]) == []
    assert sorted(got(["$k-hop", "A", "$*", 5])) == ["A,knows,B", "B,knows,A", "B,likes,E"]
    assert got(["$k-hop", "A", "knows", 5]) == ["A,knows,B", "B,knows,A"] and got(["$k-hop", "nobody", "$*", 3]) == []
    with pytest.raises(ValidationError):
        execute({"$statement": [], "limit": -1}, small)


def test_vectors_order_nulls_and_zeros(small):
    rows = similar(small, [1.0, 0.0], "knowledge", 10).collect()
    assert [r["name"] for r in rows] == ["a", "b", "c"] and rows[0]["distance"] == 0 and rows[2]["distance"] != rows[2]["distance"]
    both = similar(small, [1.0, 0.0], "both", 3).collect()
    assert [(r["catalog"], r["key"]) for r in both][:2] == [("knowledge", "a"), ("knowledge", "b")] and len(both) == 3
    with pytest.raises(ValidationError):
        similar(small, [1.0], "other")


def test_filters_reach_the_scan(spark, small, tmp_path):
    small.statement.write.parquet(str(tmp_path / "s"))
    tables = Tables(statement=spark.read.parquet(str(tmp_path / "s")))
    plan = execute(["$statement", ["$triple", "A", "knows", "$*"]], tables)._jdf.queryExecution().executedPlan().toString()
    assert "EqualTo(subject,A)" in plan and "embedding" not in plan.split("ReadSchema")[1]

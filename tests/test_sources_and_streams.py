import json

import pytest
from pyspark.sql import functions as F

from graphmill.errors import ValidationError
from graphmill.operators.fulltext import FullTextIndex, knowledge_docs
from graphmill.sources import evaluation, synthetic
from graphmill.sources.store import Shelf, latest
from graphmill.streaming.ingest import activity, ingest


def test_dialogues(spark, tmp_path):
    turn = lambda s, i, t: {"speaker": s, "dia_id": i, "text": t}
    conversation = {"speaker_a": "Ann", "speaker_b": "Bo", "session_1": [turn("Ann", "D1:1", "hi"), turn("Bo", "D1:2", "yo")], "session_1_date_time": "May", "session_x": [turn("A", "x", "no")], "session_10": [turn("Bo", "D10:1", "late")]}
    doc = [{"sample_id": "c1", "conversation": conversation, "session_summary": {"session_1": "a summary", "session_10": {"not": "text"}}, "event_summary": {"events_session_1": {"Ann": ["x"]}}, "observation": {"session_10_observation": ["o"]}, "qa": []}]
    (tmp_path / "d.json").write_text(json.dumps(doc))
    got = {r["name"]: json.loads(r["content"]) for r in evaluation.dialogues(spark, str(tmp_path / "d.json")).collect()}
    assert set(got) == {"c1__D1_1", "c1__D1_2", "c1__D10_1", "c1__summary_1", "c1__events_1", "c1__obs_10"}
    assert got["c1__D1_1"]["data"] == "[Ann] hi" and got["c1__D1_1"]["tags"] == ["c1", "session_1", "Ann", "Ann", "Bo", "May"] and got["c1__D10_1"]["tags"][-1] == "unknown date"
    assert json.loads(got["c1__events_1"]["data"]) == {"Ann": ["x"]}


def test_haystacks(spark, tmp_path):
    turn = lambda r, c, **x: {"role": r, "content": c} | x
    question = lambda q, ids, sessions, answers: {"question_id": q, "haystack_session_ids": ids, "haystack_dates": ["d1"], "haystack_sessions": sessions, "answer_session_ids": answers}
    data = [question("q1", ["s1"], [[turn("user", "a"), turn("assistant", "b", has_answer=True)], [turn("user", "c")]], ["s9"]), question("q2", ["s1"], [[turn("user", "other")]], ["s1"])]
    (tmp_path / "h.json").write_text(json.dumps(data))
    got = {r["name"]: json.loads(r["content"]) for r in evaluation.haystacks(spark, str(tmp_path / "h.json")).collect()}
    assert set(got) == {"q1__s1__turn_0", "q1__s1__turn_1", "q1__sess_1__turn_0"}
    assert got["q1__s1__turn_1"]["tags"] == ["q1", "s1", "turn_1", "assistant", "d1", "evidence"] and got["q1__sess_1__turn_0"]["tags"] == ["q1", "sess_1", "turn_0", "user"]


def test_result_files(spark, tmp_path):
    rows = spark.createDataFrame([("q", ["a"], None)], "question_id string, fts_top_keys array<string>, vec_latency_us bigint")
    evaluation.write_results(rows, str(tmp_path / "r"))
    back = evaluation.read_results(spark, str(tmp_path / "r")).first()
    assert (back["question_id"], back["fts_top_keys"], back["vec_latency_us"]) == ("q", ["a"], None)


def test_synthetic(spark):
    knowledge = synthetic.knowledge(spark, 120, 10)
    assert knowledge.select("name").distinct().count() == 120 and knowledge.where("name LIKE 'needle%'").count() == 10
    s = synthetic.statements(spark, 300)
    assert s.select("triple").distinct().count() == 300 and s.where("subject = object").count() == 0
    assert synthetic.statements(spark, synthetic.MOST_STATEMENTS).select("triple").distinct().count() == synthetic.MOST_STATEMENTS == 11_040
    with pytest.raises(ValidationError):
        synthetic.statements(spark, synthetic.MOST_STATEMENTS + 1)
    index = FullTextIndex.build(knowledge_docs(knowledge))
    for q in synthetic.queries(spark, 6).where("expected IS NOT NULL").collect():
        assert index.search(q["query"], limit=1).first()["key"] == q["expected"]
    assert synthetic.needle_query("one two, three four five six seven") == "one two three four five six" and synthetic.needle_query("") == ""


def test_latest(spark):
    df = spark.createDataFrame([("a", 1, "x"), ("a", 2, "y"), ("a", 2, "y"), ("b", 1, None), (None, 9, "z")], "k string, t int, v string")
    assert {tuple(r) for r in latest(df, "k", "t").collect()} == {("a", 2, "y"), ("b", 1, None)}
    assert latest(df.limit(0), "k", "t").count() == 0


def test_streams(spark, tmp_path):
    rows = [("a", '{"tags":[]}', "2024-01-01"), ("a", '{"tags":["new"]}', "2024-01-02"), ("b", "{}", "2024-01-01")]
    df = spark.createDataFrame(rows, "name string, content string, created_at string").withColumn("created_at", F.col("created_at").cast("timestamp_ntz"))
    df.write.parquet(str(tmp_path / "in"))
    shelf = Shelf(spark, tmp_path / "s")
    stream = spark.readStream.schema(df.schema).parquet(str(tmp_path / "in"))
    ingest(stream, shelf, "knowledge", str(tmp_path / "c")).awaitTermination()
    assert {r["name"]: r["content"] for r in shelf.knowledge.collect()} == {"a": '{"tags":["new"]}', "b": "{}"}
    late = spark.createDataFrame([("a", "{}", "2023-12-31"), ("b", "[]", "2024-01-03"), ("c", "{}", None)], "name string, content string, created_at string")
    late.withColumn("created_at", F.col("created_at").cast("timestamp_ntz")).write.mode("append").parquet(str(tmp_path / "in"))
    for _ in range(2):  # the second time nothing is new
        ingest(spark.readStream.schema(df.schema).parquet(str(tmp_path / "in")), shelf, "knowledge", str(tmp_path / "c")).awaitTermination()
    assert {r["name"]: r["content"] for r in shelf.knowledge.collect()} == {"a": '{"tags":["new"]}', "b": "[]", "c": "{}"}
    out = activity(stream, "created_at", "name", "1 day").writeStream.format("memory").queryName("seen").outputMode("complete").start()
    out.processAllAvailable()
    out.stop()
    assert {(r["name"], r["n"]) for r in spark.table("seen").collect()} >= {("a", 1), ("b", 1)}

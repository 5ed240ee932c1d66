"""Conversation and question files as knowledge rows, and result files as JSON lines."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Column, Window
from pyspark.sql import functions as F

from graphmill.functions.content import content_column

TURN = "struct<speaker:string,dia_id:string,text:string>"


def _rows(name: Column, data: Column, labels: Column) -> list[Column]:
    return [name.alias("name"), content_column(data, labels).alias("content")]


def dialogues(spark: SparkSession, path: str, lines: bool = False) -> DataFrame:
    """Conversation files as ``name, content``: turns, summaries, events, observations.

    A file is one JSON array, which one task reads, or with ``lines`` an object to a line, which many can.

    Sessions are the keys ``session_<number>``, in any number; other keys are ignored.  Only
    summaries that are strings count; event and observation entries are kept as JSON text.
    """
    schema = "sample_id string, conversation map<string,string>, session_summary map<string,string>, event_summary map<string,string>, observation map<string,string>"
    raw = spark.read.schema(schema).option("multiLine", not lines).json(path)
    sessions = raw.select("*", F.explode("conversation").alias("key", "turns_text")).where(F.col("key").rlike("^session_[0-9]+$"))
    number = F.regexp_extract("key", "([0-9]+)$", 1).try_cast("int").cast("string")
    sessions = sessions.select("*", number.alias("number")).withColumn("session", F.concat(F.lit("session_"), "number"))
    sid, session = F.col("sample_id"), F.col("session")
    date = F.coalesce(F.try_element_at("conversation", F.concat(session, F.lit("_date_time"))), F.lit("unknown date"))
    turn = sessions.select("sample_id", "conversation", "session", F.explode(F.from_json("turns_text", f"array<{TURN}>")).alias("t"))
    turns = turn.select(
        *_rows(
            F.concat(sid, F.lit("__"), F.replace(F.col("t.dia_id"), F.lit(":"), F.lit("_"))),
            F.concat(F.lit("["), "t.speaker", F.lit("] "), "t.text"),
            F.array(sid, session, F.col("t.speaker"), F.col("conversation")["speaker_a"], F.col("conversation")["speaker_b"], date),
        )
    )

    def extra(column: str, key: Column, label: str, tag: str, only_strings: bool) -> DataFrame:
        text = F.try_element_at(column, key)
        found = sessions.select("sample_id", "session", "number", text.alias("text")).where(F.col("text").isNotNull())
        found = found.where(~F.col("text").rlike(r"^\s*[\[{]")) if only_strings else found
        return found.select(*_rows(F.concat(sid, F.lit(f"__{label}_"), "number"), F.col("text"), F.array(sid, session, F.lit(tag))))

    parts = [
        extra("session_summary", session, "summary", "summary", True),
        extra("event_summary", F.concat(F.lit("events_"), session), "events", "events", False),
        extra("observation", F.concat(session, F.lit("_observation")), "obs", "observation", False),
    ]
    for part in parts:
        turns = turns.unionByName(part)
    return turns


def haystacks(spark: SparkSession, path: str, lines: bool = False) -> DataFrame:
    """Question files with their session histories as ``name, content``, each shared turn once; ``lines`` as for :func:`dialogues`.

    A turn that several questions share (same session and number) is kept for the first question in
    the file; turns of answer sessions and those marked as holding the answer are tagged evidence.
    """
    schema = "question_id string, haystack_dates array<string>, haystack_session_ids array<string>, haystack_sessions array<array<struct<role:string,content:string,has_answer:boolean>>>, answer_session_ids array<string>"
    raw = spark.read.schema(schema).option("multiLine", not lines).json(path).withColumn("_order", F.monotonically_increasing_id())
    sessions = raw.select("*", F.posexplode("haystack_sessions").alias("s", "turns"))
    sess = F.coalesce(F.get("haystack_session_ids", F.col("s")), F.concat(F.lit("sess_"), F.col("s").cast("string")))
    turns = sessions.select("question_id", "answer_session_ids", "_order", "s", sess.alias("sess"), F.coalesce(F.get("haystack_dates", F.col("s")), F.lit("")).alias("date"), F.posexplode("turns").alias("t", "turn"))
    first = Window.partitionBy("sess", "t").orderBy("_order", "s")
    turns = turns.withColumn("_n", F.row_number().over(first)).where("_n = 1")
    label = F.concat(F.lit("turn_"), F.col("t").cast("string"))
    evidence = F.array_contains("answer_session_ids", F.col("sess")) | F.coalesce(F.col("turn.has_answer"), F.lit(False))
    labels = F.array_compact(F.array("question_id", "sess", label, F.col("turn.role"), F.when(F.col("date") != "", F.col("date")), F.when(evidence, F.lit("evidence"))))
    return turns.select(*_rows(F.concat_ws("__", "question_id", "sess", label), F.concat(F.lit("["), "turn.role", F.lit("] "), "turn.content"), labels))


RESULTS = """question_id string, question_type string, ability string, question string, answer string, question_date string,
answer_session_ids array<string>, answer_turn_ids array<string>, fts_top_keys array<string>, fts_retrieved_sessions array<string>, fts_latency_us bigint,
vec_top_keys array<string>, vec_retrieved_sessions array<string>, vec_latency_us bigint"""


def read_results(spark: SparkSession, path: str) -> DataFrame:
    """Result files, one JSON object to a line."""
    return spark.read.schema(RESULTS).json(path)


def write_results(results: DataFrame, path: str) -> None:
    results.write.mode("overwrite").option("ignoreNullFields", False).json(path)

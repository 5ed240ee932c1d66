import json

import pytest
from hypothesis import given
from hypothesis import strategies as st
from pyspark.sql import functions as F

from graphmill.errors import ValidationError
from graphmill.functions.content import Content, archive_path, content_column, embedding_text, file_category, mime_type, split_triple, synonyms, tags, triple_column, triple_key

PART = st.text(st.sampled_from('ab,"\n é'), max_size=8)


@given(PART, PART, PART)
def test_triple_round_trip(s, p, o):
    assert split_triple(triple_key(s, p, o)) == (s, p, o)


def test_triple_keys(spark):
    assert triple_key("river", "flows into", "sea") == "river,flows into,sea"
    assert triple_key("Rhône, upper", "in", 'the "Valais"') == '"Rhône, upper",in,"the ""Valais"""'
    assert split_triple("") is None and split_triple("a,b,c,d") is None and split_triple('"a,b",c,') == ("a,b", "c", "")
    rows = [('a,"b', "x\ny", "plain")]
    df = spark.createDataFrame(rows, "s string, p string, o string")
    assert df.select(triple_column(F.col("s"), F.col("p"), F.col("o"))).first()[0] == triple_key(*rows[0])


def test_content_round_trip():
    c = Content.from_json('{"format":"markdown","data":"hello","tags":[],"other":1}')
    assert c == Content("hello") and json.loads(c.to_json())["synonyms"] is None
    assert Content(scopes=[]).scopes is None and Content(figures=[]).figures is None
    assert Content.from_json(Content("d", "json", ["t"], {"subject": ["s"]}, ["archive://f"], [""]).to_json()).scopes == [""]
    for bad in ("{}", "[]", "nope", '{"tags": 5}', '{"tags": [], "format": "xml"}'):
        with pytest.raises(ValidationError):
            Content.from_json(bad)
    assert Content("d", tags=["a", "b"]).embedding_text("n") == "a, b\nn\nd" and Content("d").embedding_text("n") == "n\nd"
    assert archive_path("archive://x/y.png") == "x/y.png" and archive_path("http://x") is None


def test_columns(spark):
    df = spark.createDataFrame([('{"data":"d","tags":["a","b"],"synonyms":{"object":["z"],"subject":["x","y"]}}',), ('{"data":"d","tags":[],"synonyms":["p","q"]}',), ("broken",), (None,)], "c string")
    got = df.select(tags(F.col("c")).alias("t"), synonyms(F.col("c")).alias("s"), embedding_text(F.lit("n"), F.col("c")).alias("e")).collect()
    assert [r["t"] for r in got] == [["a", "b"], [], None, None] and [r["s"] for r in got] == [["z", "x", "y"], ["p", "q"], None, None]
    assert [r["e"] for r in got] == ["a, b\nn\nd", "n\nd", "n\n", "n\n"]
    made = spark.range(1).select(content_column(F.lit("x"), F.array(F.lit("t")))).first()[0]
    assert made == Content("x", tags=["t"]).to_json()
    files = spark.createDataFrame([("a.PNG",), ("b/c.d.mp3",), ("x",), (".png",)], "f string").select(mime_type(F.col("f")).alias("m")).select("m", file_category(F.col("m")))
    assert [tuple(r) for r in files.collect()][:3] == [("image/png", "image"), ("audio/mpeg", "audio"), ("application/octet-stream", "file")]

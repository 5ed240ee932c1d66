import json

from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from graphmill.llm.bisect_split import DEFAULT_LIMIT, split_knowledge, split_oversized, split_text, token_starts

TEXTS = st.text(st.sampled_from("ab1 \n#.,;。，中文\t-_é"), max_size=300)


@given(TEXTS, st.integers(1, 40), st.integers(0, 30))
@settings(max_examples=300, deadline=None)
def test_pieces_cover_share_and_fit(text, limit, overlap):
    pieces = split_text(text, limit, overlap)
    shared = min(overlap, limit - 1)
    assert pieces[0][0] == 0 and pieces[-1][1] == len(text)
    starts = token_starts(text)
    for begin, end, first, n in pieces:
        assert n <= limit and len(token_starts(text[begin:end])) == n
    for one, two in zip(pieces, pieces[1:]):
        assert one[2] + one[3] - two[2] == shared and two[0] <= one[1] and two[0] > one[0]
    own = text[: pieces[0][1]] + "".join(text[a:b] for a, b in [(starts[f + shared], e) for _, e, f, _ in pieces[1:]])
    assert own == text  # an exact round trip without the overlaps


def test_cuts_at_the_strongest_boundary():
    text = "one two three. four five\n\n# Head\nsix seven, eight. nine ten"
    begins = [text[a:b] for a, b, *_ in split_text(text, 8, 0)]
    assert begins[1].startswith("# Head")


def test_overlap_of_more_than_half_the_limit_is_kept():
    text = " ".join(f"w{i}" for i in range(60))
    pieces = split_text(text, 10, 8)
    assert all(one[2] + one[3] - two[2] == 8 and two[3] <= 10 for one, two in zip(pieces, pieces[1:])) and pieces[-1][1] == len(text)


def test_a_far_boundary_is_better_than_none():
    text = "字" * 3 + "。" + "字" * 16
    assert [b - a for a, b, *_ in split_text(text, 18, 0)] == [4, 16]


def test_rows(spark):
    config = spark.createDataFrame([("s", 5, 2), ("n", None, None), (None, 1, 0), ("s", 6, 0)], "shelf string, max_seq_length long, chunk_overlap long")
    doc = lambda t: json.dumps({"data": t, "extra": 1})
    rows = [("a", "s", doc("a b c d e f g")), ("b", "s", doc("a b")), ("c", None, doc("w " * (DEFAULT_LIMIT + 1))), ("d", "n", doc("x")), ("e", "s", None), ("f", "s", '{"data": "a b c d e f'), ("g", "s", doc("")), (None, "t", doc("中文字符太长了")), ("a", "s", doc("a b c d e f g"))]
    knowledge = spark.createDataFrame(rows, "name string, shelf string, content string").withColumn("_c", F.lit(1)).withColumn("m", F.lit(2))
    got = split_knowledge(knowledge, config).collect()
    by = {}
    for r in got:
        by.setdefault(r["id"], []).append(r)
    assert set(by) == {"a", "b", "c", "d", "g", None}
    assert {r["pieces"] for r in by["b"] + by["d"] + by["g"] + by[None]} == {1} and max(r["n_tokens"] for r in by["a"]) <= 5
    assert {r["id"] for r in split_knowledge(knowledge, config, only_split=True).collect()} == {"a", "c"}
    assert split_knowledge(knowledge.limit(0), config).count() == 0 and split_knowledge(knowledge, config.limit(0)).count() > 0


def test_plain_text_column(spark):
    df = spark.createDataFrame([(1, "a b c d"), (2, None)], "id long, text string")
    got = split_oversized(df, "id", "text", F.lit(2), F.lit(None))
    assert [r["text"] for r in got.orderBy("piece").collect()] == ["a b ", "c d"]

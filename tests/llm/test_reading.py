import os
import random

import numpy as np
import pytest

from graphmill.llm.reading import fit_words, level_marks, prose, reading_levels

DATA = "/root/testdata/sf0.01"
LABELS = "doc_id long, rater string, reading_level long"


def test_prose_leaves_out_what_is_none():
    text = "# Head line\n\n[user] First words here\n- [ ] a list entry\n1. another one\n\n| a | b |\n| - | - |\n\n```\ncode = 1\n```\n> quoted text\nTitle\n=====\nlast"
    assert prose(text) == ["First words here", "a list entry", "another one", "quoted text", "last"]
    assert prose(None) == prose("") == prose("```\nunclosed code") == []


@pytest.mark.skipif(not os.path.isdir(DATA), reason="needs the test data")
def test_held_out_labels(spark):
    """Marks set with half the labels agree with the other half."""
    documents = spark.read.parquet(f"{DATA}/documents.parquet")
    labels = spark.read.parquet(f"{DATA}/reading_label.parquet")
    got = {r["doc_id"]: r for r in reading_levels(documents, labels.where("doc_id % 2 = 0")).collect()}
    assert len(got) == documents.select("doc_id").distinct().count()
    by = {}
    for r in labels.where("doc_id % 2 = 1 AND reading_level IS NOT NULL").collect():
        by.setdefault(r["doc_id"], set()).add(r["reading_level"])
    pairs = [(got[d]["level"], np.mean(list(v))) for d, v in by.items() if got[d]["level"]]
    assert np.mean([abs(a - b) <= 1 for a, b in pairs]) > 0.95
    assert np.mean([(a >= 4) == (b >= 3.5) for a, b in pairs]) >= 0.85
    assert {r["lang"] for r in got.values()} <= {"en", "de", "fr", "es", "zh", None}
    assert all(r["level"] is None for r in got.values() if r["lang"] in ("de", "zh"))


def test_odd_rows(spark):
    rnd = random.Random(9)
    easy, hard = "cat dog sun run big red".split(), "notwithstanding epistemology interoperability heterogeneous".split()
    rows = [(i, " ".join(rnd.choice(hard if i % 2 else easy) for _ in range(80)), rnd.choice(["en", "EN-us", None]), 0.0) for i in range(40)]
    rows += [(100, None, "en", 0.0), (101, "", None, 0.0), (102, "der die das und ist " * 30, "de", 0.0), (103, "x", "Klingon", 0.0), (None, "cat dog", "en", 0.0), (0, rows[0][1], rows[0][2], 0.0), (104, "cat dog sun " * 40_000, "en", 0.0)]
    documents = spark.createDataFrame(rows, "doc_id long, text string, lang string, difficulty double")
    labels = spark.createDataFrame([(0, "r", 1), (0, "r", 1), (1, "r", 5), (1, None, None), (2, "r", 9), (None, "r", 3), (4, "s", 2), (3, "s", 4)], LABELS)
    got = {r["doc_id"]: r for r in reading_levels(documents, labels, min_share=0.01).collect()}
    assert len(got) == 46 and got[100]["level"] is None and got[100]["n_words"] == 0 and got[102]["lang"] == "de"
    assert all((got[i]["level"] >= 4) == bool(i % 2) for i in range(40))
    assert got[104]["level"] <= 3 and got[104]["n_words"] == 120_000
    assert reading_levels(documents.limit(0), labels).count() == 0
    assert reading_levels(documents, labels.limit(0), min_share=0.01).count() == 46


def test_large_identifiers_beside_null_ones(spark):
    large = 2**60 + 1
    rows = [(large, "cat dog sun " * 30, "en"), (None, "cat dog", "en")]
    got = reading_levels(spark.createDataFrame(rows, "doc_id long, text string, lang string").coalesce(1), spark.createDataFrame([], LABELS), min_share=0.01)
    assert {r["doc_id"] for r in got.collect()} == {large, None}


def test_words_are_fitted():
    rng = np.random.default_rng(1)
    x = np.linspace(-2, 2, 21)
    ease, difficulty = rng.normal(-5, 1, 200), rng.normal(0, 0.7, 200)
    p = np.exp(ease[:, None] + difficulty[:, None] * x)
    p /= p.sum(0)
    table = np.stack([rng.multinomial(20_000, p[:, b]) for b in range(21)], 1).astype(float)
    _, found = fit_words(table, x)
    assert np.corrcoef(found, difficulty)[0, 1] > 0.98


def test_marks():
    level = np.array([-2, -1, 0, 1, 2.0])
    assert np.allclose(level_marks(level, np.array([1, 2, 3, 4, 5.0])), [-1.5, -0.5, 0.5, 1.5])
    assert (np.diff(level_marks(np.zeros(0), np.zeros(0))) > 0).all()
